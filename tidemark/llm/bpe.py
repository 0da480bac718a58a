"""Operator 10, BPE encoding and decoding over a trie of distinct words.

Each task takes Arrow batches of texts, splits them into the tokenizer's words
and puts the batch's distinct words into a trie. A depth-first walk gives every
node the last token of its prefix's encoding: the one token that ends there and
may follow the last token of the prefix before it. Words that share a prefix
share its nodes, so the prefix is encoded once; a word's ids are read back along
the chain of last tokens. Only maps over partitions: no shuffle, and a task
holds one slice of texts and its trie at a time.

Which tokens may stand side by side follows from the merge order alone: in the
encoding of two tokens' joint bytes, no merge across their border comes before
the merges that made the two sides.

Defined cases: a null text is empty and has no tokens; the strings of special
tokens in a text are the special tokens, as in the library's default; repeated
rows are encoded each on its own; the output has only the named columns, so
extra columns cannot clash; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
import types
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession


cloudpickle.register_pickle_by_value(sys.modules[__name__])

SPACE = regex.compile(r"\s+")
CONTROL = re.compile("[\x1c-\x1f]")
#: Characters of text that share one trie and leave the task as one batch; longer texts stand alone.
SLICE_CHARS = 1_000_000
#: Words whose encoding a task keeps for its later slices.
KEPT_WORDS = 400_000
#: Pairs of tokens whose side-by-side test an encoder keeps.
MOST_PAIRS = 2_000_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_names() -> list[str]:
    """The printable name of each byte in byte-level vocabularies: itself where printable, else the next free code point from 256."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class PrefixEncoder:
    """Encodes words through a trie whose nodes carry last tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"] or ""
        self.names = byte_names()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        pretokens = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words = regex.compile(pretokens)
        # rank of the merge that makes a token, and its two parts; single symbols have none
        self.rank: dict[str, int] = {}
        self.parts: dict[str, tuple[str, str]] = {}
        self.merge: dict[tuple[str, str], int] = {}
        for i, (a, b) in enumerate(map(tuple, model["merges"])):
            self.merge[a, b] = i
            if a + b not in self.parts:
                self.parts[a + b] = (a, b)
                self.rank[a + b] = i
        self.beside: dict[str, dict[str, bool]] = {}
        self.n_beside = 0
        # tokens that the merges do build from their own symbols
        self.whole: set[str] = set()
        for t in sorted(self.vocab, key=lambda t: self.rank.get(t, -1)):
            if t not in self.parts:
                if len(t.removesuffix(self.end)) == 1:
                    self.whole.add(t)
            elif self.whole.issuperset(self.parts[t]) and self._first_across(*self.parts[t]) == self.rank[t]:
                self.whole.add(t)

    def _first_across(self, a: str, b: str) -> int | None:
        """The rank of a merge across the border of two tokens that comes before the merges beside it; None if there is none.

        Undo the later of the two tokens' last merges again and again; if the tokens
        at the border could at any time have merged before what was undone, they would have.
        """
        limit = len(self.merge)
        while True:
            joint = self.merge.get((a, b))
            if joint is not None and joint < limit:
                return joint
            ra, rb = self.rank.get(a, -1), self.rank.get(b, -1)
            if ra < 0 and rb < 0:
                return None
            # the merge with the higher rank came last; of equal ranks, the right one
            if ra > rb:
                limit, a = ra, self.parts[a][1]
            else:
                # an equal merge across the border would have come first, being further left
                limit, b = rb + 1, self.parts[b][0]

    def may_follow(self, left: str, right: str) -> bool:
        """Whether left and right stay two tokens when their symbols are encoded together."""
        if self.n_beside > MOST_PAIRS:
            self.beside.clear()
            self.n_beside = 0
        fine = self._first_across(left, right) is None
        self.beside.setdefault(left, {})[right] = fine
        self.n_beside += 1
        return fine

    def encode_words(self, words: list[str]) -> dict[str, list[str]]:
        """The tokens of each distinct word."""
        names, end, whole, beside, may = self.names, self.end, self.whole, self.beside, self.may_follow
        # sorted words are the trie in depth-first order: the prefix shared with the
        # word before is the path that stays on the stack
        spelled = sorted(("".join([names[x] for x in w.encode("utf-8")]), w) for w in words)
        out: dict[str, list[str]] = {}
        before = ""
        last: list[str] = []  # last token of the encoding of each prefix on the path
        ends: list[int] = []  # the place before it
        nothing: dict[str, bool] = {}
        for s, w in spelled:
            # the last symbol carries the end mark, so it is a node of its own
            same, most = 0, min(len(before), len(s)) - 1
            while same < most and before[same] == s[same]:
                same += 1
            del last[same:], ends[same:]
            final = len(s) - 1
            for i in range(same, final + 1):
                tail = s[: i + 1] if i < final else s + end
                for j in range(i, -1, -1):
                    token = tail[j:]
                    if token in whole:
                        if j:
                            left = last[j - 1]
                            fine = beside.get(left, nothing).get(token)
                            if fine is None:
                                fine = may(left, token)
                            if not fine:
                                continue
                        last.append(token)
                        ends.append(j)
                        break
                else:
                    raise ValueError(f"no token ends at symbol {i} of {w!r}")
            tokens, i = [], final
            while i >= 0:
                tokens.append(last[i])
                i = ends[i] - 1
            out[w] = tokens[::-1]
            before = s
        return out

    def split(self, text: str) -> Iterator[tuple[bool, str]]:
        """(is special, piece) of a text."""
        if self.special_split is None:
            yield False, text
            return
        for i, piece in enumerate(self.special_split.split(text)):
            if piece:
                yield bool(i % 2), piece

    def normal(self, text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        # per code point, as the library does: no special form at a word's end
        return text.lower() if "Σ" not in text else "".join(c.lower() for c in text)

    def units(self, text: str) -> list[str]:
        """The words of a text; a special token is one unit, marked by a leading NUL."""
        if "<|" not in text:
            return self.words.findall(self.normal(text))
        out: list[str] = []
        for special, piece in self.split(text):
            if special:
                out.append("\x00" + piece)
            else:
                out += self.words.findall(self.normal(piece))
        return out

    def learn(self, chunks: set[str], known: dict) -> None:
        """Adds to known, for each chunk (a stretch without white space), its number of tokens, ids and tokens, joined."""
        split = {c: self.units(c) for c in chunks}
        words = set().union(*split.values())
        special = {w for w in words if w[0] == "\x00"}
        tokens = self.encode_words(list(words - special)) | {w: [w[1:]] for w in special}
        vocab = self.vocab | self.special if special else self.vocab
        for c, units in split.items():
            own = [t for u in units for t in tokens[u]]
            known[c] = (len(own), " ".join([str(vocab[t]) for t in own]), " ".join(own))


def chunks_of(text: str) -> list[str]:
    """Stretches between white space. Python also splits at four control characters that the tokenizer keeps."""
    return SPACE.split(text) if CONTROL.search(text) else text.split()


def worker_encoder(path: str) -> tuple[PrefixEncoder, dict]:
    """The encoder and its known chunks, kept in the Python worker for its later tasks."""
    held = sys.modules.setdefault("tidemark_bpe_worker", types.ModuleType("tidemark_bpe_worker"))
    if getattr(held, "path", None) != path:
        held.encoder, held.known, held.path = PrefixEncoder(path), {}, path
    return held.encoder, held.known


def _sliced(batch: pa.RecordBatch, chars: int) -> Iterator[tuple[list, list[str]]]:
    """ids and texts of parts of a batch with a bounded sum of lengths."""
    ids, texts, held = [], [], 0
    for i, t in zip(batch.column(0), batch.column(1), strict=True):
        t = t.as_py() or ""
        if held and held + len(t) > chars:
            yield ids, texts
            ids, texts, held = [], [], 0
        ids.append(i.as_py())
        texts.append(t)
        held += len(t)
    if ids:
        yield ids, texts


def encoder(path: str, with_ids: bool = False):
    """A map over Arrow batches (doc_id, text) -> token counts and digests, or the ids themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, known = worker_encoder(path)
        for batch in batches:
            for ids, texts in _sliced(batch, SLICE_CHARS):
                split = [chunks_of(t) for t in texts]
                new = set().union(*split).difference(known)
                if len(known) + len(new) > KEPT_WORDS:
                    known.clear()
                    new = set().union(*split)
                enc.learn(new, known)
                rows: list[list] = [[], [], []]
                for chunks in split:
                    each = [e for e in map(known.__getitem__, chunks) if e[0]]
                    joined, tokens = " ".join([e[1] for e in each]), " ".join([e[2] for e in each])
                    rows[0].append(sum([e[0] for e in each]))
                    if with_ids:
                        rows[1].append(np.fromstring(joined, dtype=np.int32, sep=" "))
                        rows[2].append(tokens)
                    else:
                        rows[1].append(hashlib.sha256(joined.encode()).hexdigest())
                        rows[2].append(hashlib.sha256(tokens.encode("utf-8")).hexdigest())
                kinds = (pa.list_(pa.int32()), pa.string()) if with_ids else (pa.string(), pa.string())
                names = ("ids", "decoded") if with_ids else ("ids_sha256", "decoded_sha256")
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(rows[0], pa.int64()), *map(pa.array, rows[1:], kinds)],
                    names=["doc_id", "n_tokens", *names],
                )

    return run


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids (array of int) and decoded (the text that the ids decode to)."""
    run = encoder(path or default_path(), with_ids=True)
    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, n_tokens long, ids array<int>, decoded string"
    )


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encode() with the ids and the text digested in the task."""
    return docs.select("doc_id", "text").mapInArrow(
        encoder(path or default_path()), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )


def decode(rows: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and decoded, the text of ids (array of int): the tokens joined by a space; null ids give an empty text, ids outside the vocabulary nothing."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, _ = worker_encoder(path)
        token = {i: t for t, i in (enc.vocab | enc.special).items()}
        for batch in batches:
            texts = [" ".join([token[i] for i in ids or () if i in token]) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "decoded"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
