"""Operator 1, license scans: fuzzy search for short notices.

A notice that may differ by k edits is split into k+1 seeds; by the pigeonhole
principle one of them stands in the text unchanged. One Aho-Corasick automaton
finds all seeds of all notices in one pass; around each hit the regex library
matches the notice with at most k edits and gives the span and its edits. The
text is compared as its words joined by single spaces, so marks, line breaks
and comment signs between words do not count. Places of the fixed base phrases
are exact. Only a map over partitions: no shuffle; a task holds one Arrow batch.

Defined cases: a null text is empty; a place where two notices overlap counts
for both; the output has only the named columns, so extra columns cannot clash;
repeated rows are scanned each on its own; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
import regex
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import read_table

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")

# The base phrases and their labels.
BASE = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)


class Notice(NamedTuple):
    words: str
    label: str
    edits: int


#: Short notices in normal form (lower-case words, single spaces) and the edits each may have.
NOTICES = (
    Notice("gnu general public license", "gpl", 2),
    Notice("gnu lesser general public license", "lgpl", 2),
    Notice("gnu affero general public license", "agpl", 2),
    Notice("this program is free software you can redistribute it", "gpl", 4),
    Notice("licensed under the apache license", "apache", 2),
    Notice("apache license", "apache", 1),
    Notice("released under the mit license", "mit", 2),
    Notice("mit license", "mit", 1),
    Notice("permission is hereby granted free of charge to any person obtaining a copy", "mit", 6),
    Notice("redistribution and use in source and binary forms", "bsd", 4),
    Notice("mozilla public license", "mpl", 2),
    Notice("creative commons attribution", "cc-by", 2),
    Notice("licensed under cc by", "cc-by", 1),
    Notice("creative commons zero", "cc0", 1),
    Notice("all rights reserved", "reserved", 1),
)

SPAN_TYPE = "array<struct<label:string,start:int,end:int,first_word:int,last_word:int,edits:int>>"


class Scanner:
    """Seeds, automaton and patterns for a table of notices."""

    def __init__(self, notices: tuple[Notice, ...] = NOTICES, base=BASE):
        self.notices, self.base = notices, [(f" {p} ", len(p.split()), label) for p, label in base]
        self.seeds = ahocorasick.Automaton()
        at: dict[str, list[tuple[int, int]]] = {}
        for i, n in enumerate(notices):
            size, parts = len(n.words), n.edits + 1
            cuts = [size * k // parts for k in range(parts + 1)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                at.setdefault(n.words[a:b], []).append((i, a))
        for seed, places in at.items():
            self.seeds.add_word(seed, (len(seed), places))
        self.seeds.make_automaton()
        self.patterns = [
            regex.compile(rf"(?b)(?<![^ ])(?:{regex.escape(n.words, literal_spaces=True)}){{e<={n.edits}}}(?![^ ])")
            for n in notices
        ]

    def base_places(self, norm: str) -> list[tuple[int, str]]:
        """(first word, label) of every place of a base phrase; norm has a space at both ends."""
        out = []
        for phrase, _, label in self.base:
            at, seen, word = norm.find(phrase), 0, 0
            while at >= 0:
                word += norm.count(" ", seen, at)
                seen = at
                out.append((word, label))
                at = norm.find(phrase, at + 1)
        return out

    def matches(self, norm: str) -> list[tuple[int, int, int, str, float]]:
        """(start, end, edits, label, likeness) of every fuzzy match in norm."""
        near: dict[int, list[list[int]]] = {}
        for last, (size, places) in self.seeds.iter(norm):
            for i, offset in places:
                n = self.notices[i]
                begin = last - size + 1 - offset
                window = [max(0, begin - n.edits - 1), min(len(norm), begin + len(n.words) + n.edits + 1)]
                spans = near.setdefault(i, [])
                if spans and window[0] <= spans[-1][1]:
                    spans[-1][0] = min(spans[-1][0], window[0])
                    spans[-1][1] = max(spans[-1][1], window[1])
                else:
                    spans.append(window)
        found = []
        for i, spans in near.items():
            n = self.notices[i]
            for a, b in spans:
                for m in self.patterns[i].finditer(norm, a, b):
                    if m.end() > m.start() and (b == len(norm) or norm[m.end()] == " "):
                        edits = sum(m.fuzzy_counts)
                        found.append((m.start(), m.end(), edits, n.label, 1 - edits / len(n.words)))
        return sorted(found)

    def scan(self, text: str) -> dict:
        low = text.encode("utf-8").lower().decode("utf-8")
        words = WORD.findall(low)
        norm = f" {' '.join(words)} "
        places = self.base_places(norm)
        found = self.matches(norm)
        own = sorted({label for _, label in places})
        labels = sorted({*own, *(x[3] for x in found)})
        spans = []
        if found:
            bounds = [m.span() for m in WORD.finditer(low)]
            for a, b, edits, label, _ in found:
                # a match may begin at the space before its first word
                first = norm.count(" ", 0, a + 1) - 1
                last = first + norm[a:b].strip().count(" ")
                spans.append(
                    {
                        "label": label, "start": bounds[first][0], "end": bounds[last][1],
                        "first_word": first, "last_word": last, "edits": edits,
                    }
                )
        return {
            "n_words": len(words),
            "n_base": len(places),
            "first_word": min((p for p, _ in places), default=None),
            "last_word": max((p for p, _ in places), default=None),
            "base_labels": ",".join(own),
            "labels": ",".join(labels),
            "score": 1.0 if places else max((x[4] for x in found), default=0.0),
            "spans": spans,
        }


OUT = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string,"
    f" score double, spans {SPAN_TYPE}"
)
_SPAN = pa.struct(
    [("label", pa.string())] + [(k, pa.int32()) for k in ("start", "end", "first_word", "last_word", "edits")]
)
_ARROW = pa.schema(
    [("doc_id", pa.int64())]
    + [(k, pa.int64()) for k in ("n_words", "n_base", "first_word", "last_word")]
    + [("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", pa.list_(_SPAN))]
)


def scan(docs: DataFrame, notices: tuple[Notice, ...] = NOTICES) -> DataFrame:
    """One row a document: counts, labels, score and the spans (code points of the text) of all fuzzy matches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(notices)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            rows = [scanner.scan(t.as_py() or "") for t in texts]
            columns = [ids] + [pa.array([r[f.name] for r in rows], f.type) for f in list(_ARROW)[1:]]
            yield pa.RecordBatch.from_arrays(columns, schema=_ARROW)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, OUT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read_table(spark, sf_dir, "documents")).withColumn("n_spans", F.size("spans")).drop("spans")
