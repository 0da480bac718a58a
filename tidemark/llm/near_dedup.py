"""Operator 7, near-duplicates by improved consistent weighted sampling.

A text's features are its shingles of five words; a shingle weighs its count
times its inverse document frequency, 1 + ln(1 / f), where f is the share of all
documents that hold it, and the floor where it is less. Frequencies of all
shingles are counted exactly, by ranges of their hashes, and stored; those of
all texts that meet another in a bucket are looked up there, and every link is
verified under these weights. The floor is COMMON unless the caller names a
lower one. Without any (0) a change that one text alone has weighs far more than
what a large group of copies shares, and such a group falls apart.

Candidates are drawn under the floor COMMON, so that a task has to know only the
shingles above it, at most (mean number of shingles in a text) / COMMON. With a
lower floor the limits on candidates are wider, as a pair at .8 may stand at .75
under COMMON.

Improved consistent weighted sampling draws one (shingle, level) per hash
function; two texts draw the same with the probability of their weighted
Jaccard similarity. Bands are subsets of the draws; texts that share a band meet
in a bucket, and pairs are verified by the exact weighted Jaccard of their
shingles. Two bits of every draw travel with a text, so that a join of a bucket
with its centres keeps only pairs that may reach the threshold.

Texts with the same words stand as one. In a bucket every text is held against
the one that shares most bands with others (a star, not all pairs); a text that
stays outside that one's class becomes a star's centre in turn and is held
against all that are not in its class, until each has had its turn. So pairs
within one class are not made, and no link between classes is skipped.

Defined cases: a text of one to four words is one shingle of all its words; a
text without words (null, empty, marks only) is a class of its own; a null
doc_id gets a null class; rows that share doc_id and words share the class;
extra columns pass through keep_one() and are not read elsewhere; an empty
table gives an empty result.
"""

from __future__ import annotations

import pickle
import sys
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import tokens as T
from tidemark.llm.blobs import add_up, pack, steps, unpack
from tidemark.llm.common import Members, cut_lineage, read_table
from tidemark.llm.graph import components

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SHINGLE = 5
THRESHOLD = 0.8
#: A pair at the threshold shares about 72 of the draws; with 72, 68 and 64 it shares no band with a probability of 1e-4, 3e-3 and 3e-2.
DRAWS, BANDS, ROWS = 90, 40, 7
SUBSETS = np.stack([np.random.default_rng([7, b]).choice(DRAWS, ROWS, replace=False) for b in range(BANDS)])
#: Of two bits of each draw a pair at the threshold shares 76.5 on average, and fewer than this with a probability of about 1e-5.
LEAST_SHARED = 62
#: Texts in buckets of CROWD or more have a finer signature, of FINE further draws. A pair at the threshold shares 435 of their
#: two bits on average, and fewer than FINE_LEAST with a probability of about 4e-4.
CROWD, FINE, FINE_LEAST = 32, 512, 407
#: Both limits where the floor is lower than COMMON: a pair at .75 misses them with probabilities of 5e-5 and 1e-5.
WIDE = 58, 378
#: While candidates are drawn, shingles in a smaller share of the documents weigh as if this share had them.
COMMON = 1e-3
#: Characters of text whose shingles a bucket of the frequencies holds.
BUCKET_CHARS = 12_000_000
MOST_BUCKETS = 65_536
COUNT_SLICE = 3_000_000
#: Shingles that a task holds before it adds up equal ones.
HELD_SHINGLES = 4_000_000
SLICE_BYTES = 1_000_000
#: Texts that a bucket's centres are held against in one round: all of its centres at once where the bucket is small, else in turns.
ROUND_TESTS = 4_000_000


def features(column: pa.Array):
    """Shingle hashes and bounds of each text, and two digests of its words."""
    texts = T.texts_of(column)
    words = T.words_of(texts, T.WORD_BYTES)
    h = T.hash_words(texts, words)
    d1, d2 = T.sequence_digests(h, words.bounds)
    s, bounds = T.shingles(h, words.bounds, SHINGLE)
    n = np.diff(words.bounds)
    short = np.flatnonzero((n > 0) & (n < SHINGLE))
    if len(short):  # one shingle of all words
        s = np.insert(s, bounds[short], d1[short])
        each = np.diff(bounds)
        each[short] = 1
        bounds = np.r_[0, np.cumsum(each)]
    return s, bounds, d1, d2


def distinct_features(s: np.ndarray, bounds: np.ndarray):
    """Each text's distinct shingles in ascending order, their counts, and bounds."""
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order = np.lexsort((s, doc))
    s, doc = s[order], doc[order]
    new = np.ones(len(s), dtype=bool)
    new[1:] = (s[1:] != s[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    count = np.diff(np.r_[at, len(s)])
    return s[at], count, np.searchsorted(doc[at], np.arange(len(bounds)))


class Idf(NamedTuple):
    """Inverse document frequencies: those of the common shingles (sorted), and the one that all others have."""

    shingles: np.ndarray
    values: np.ndarray
    rare: float

    def of(self, s: np.ndarray) -> np.ndarray:
        if not len(self.shingles):
            return np.full(len(s), self.rare)
        at = np.minimum(np.searchsorted(self.shingles, s), len(self.shingles) - 1)
        return np.where(self.shingles[at] == s, self.values[at], self.rare)


class Frequencies(NamedTuple):
    """The number of texts, and of each shingle that several of them hold the number of those, packed by range of hashes."""

    table: DataFrame
    n_buckets: int
    texts: int


ROWS_BY_BUCKET = "bucket int, kind int, slice long, blob binary"


def _by_bucket(s: np.ndarray, n_buckets: int) -> Iterator[tuple[int, slice]]:
    """The buckets of sorted shingles, each a range of hashes."""
    bucket = ((s >> np.uint64(48)) * np.uint64(n_buckets) >> np.uint64(16)).astype(np.int64)
    at = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True]) if len(s) else np.zeros(1, np.int64)
    for a, b in zip(at.tolist(), at[1:].tolist(), strict=False):
        yield int(bucket[a]), slice(a, b)


def _blob_rows(rows: list) -> pa.RecordBatch:
    bucket, kind, number, blob = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(bucket, pa.int32()), pa.array(kind, pa.int32()), pa.array(number, pa.int64()), pa.array(blob, pa.binary())],
        names=["bucket", "kind", "slice", "blob"],
    )


def frequencies(docs: DataFrame) -> Frequencies:
    """Exact document frequencies: each slice of texts sends a blob of its distinct shingles to each bucket, where they are added up."""
    size = docs.agg(F.count("*").alias("texts"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).first()
    n_buckets = min(MOST_BUCKETS, max(8, -(-size.chars // BUCKET_CHARS)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch, 0, COUNT_SLICE):
                s, bounds, _, _ = features(part.column(0))
                s, n = np.unique(distinct_features(s, bounds)[0], return_counts=True)
                n = n.astype(np.uint32)
                rows = [(b, 0, 0, pack(steps(s[at]), n[at])) for b, at in _by_bucket(s, n_buckets)]
                if rows:
                    yield _blob_rows(rows)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def whole(bucket: int, keys: list, counts: list) -> pa.RecordBatch:
            s, n = add_up(keys, counts)
            several = n > 1
            return _blob_rows([(bucket, 0, 0, pack(steps(s[several]), n[several]))])

        now, keys, counts, held = None, [], [], 0
        for batch in batches:
            for bucket, raw in zip(batch.column(0).to_pylist(), batch.column(3), strict=True):
                if bucket != now:
                    if keys:
                        yield whole(now, keys, counts)
                    now, keys, counts, held = bucket, [], [], 0
                s, n = unpack(raw.as_py())
                keys.append(np.cumsum(s))
                counts.append(n.astype(np.int64))
                held += len(s)
                if held > HELD_SHINGLES:
                    s, n = add_up(keys, counts)
                    keys, counts, held = [s], [n], 0
        if keys:
            yield whole(now, keys, counts)

    parts = docs.select("text").mapInArrow(count, ROWS_BY_BUCKET).repartitionById(n_buckets, F.col("bucket"))
    return Frequencies(cut_lineage(parts.sortWithinPartitions("bucket").mapInArrow(merge, ROWS_BY_BUCKET)), n_buckets, size.texts)


def floored(counts: Frequencies, common: float = COMMON) -> Idf:
    """Inverse document frequencies with a floor: those of the shingles that more than the share `common` of the texts hold, and the one of all others."""
    least = common * counts.texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0):
                s, n = unpack(raw.as_py())
                s, often = np.cumsum(s), n > least
                yield pa.RecordBatch.from_arrays([pa.array(s[often].view(np.int64)), pa.array(n[often])], names=["s", "n"])

    found = counts.table.select("blob").mapInArrow(run, "s long, n long").toArrow()  # at most mean shingles of a text / common
    s, n = found["s"].to_numpy().view(np.uint64), found["n"].to_numpy()
    order = np.argsort(s)
    return Idf(s[order], 1 + np.log(counts.texts / n[order]), float(1 + np.log(1 / common)))


def inverse_frequencies(docs: DataFrame, common: float = COMMON) -> Idf:
    """The inverse document frequencies that candidates are drawn under."""
    return floored(frequencies(docs), common)


def weighed(vecs: DataFrame, counts: Frequencies, floor: float) -> DataFrame:
    """node, vec: the texts' shingles with their weights, counts times inverse document frequencies; shares of holders under the floor weigh as it.

    Batches of texts ask each bucket for the frequencies of their distinct shingles; answers come back by batch.
    """
    n_buckets, texts = counts.n_buckets, counts.texts

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in T.slices(batch, 1, COUNT_SLICE):
                nodes, raw = part.column(0).to_pylist(), part.column(1).to_pylist()
                s = np.unique(np.concatenate([unpack_vec(x)[0] for x in raw]))
                rows = [(b, 1, number, pack(steps(s[at]))) for b, at in _by_bucket(s, n_buckets)]
                home = int(T.mix(np.array([number], dtype=np.uint64))[0] >> np.uint64(33)) % n_buckets
                yield _blob_rows([*rows, (home, 2, number, zstandard.compress(pickle.dumps((nodes, raw)), 1))])
                number += 1

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, often = None, np.empty(0, np.uint64), np.empty(0, np.int64)
        for batch in batches:
            out = []
            for bucket, kind, number, raw in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3), strict=True):
                raw = raw.as_py()
                if bucket != now:
                    now, held, often = bucket, np.empty(0, np.uint64), np.empty(0, np.int64)
                if kind == 0:
                    s, often = unpack(raw)
                    held = np.cumsum(s)
                    continue
                if kind == 1:
                    s = np.cumsum(unpack(raw)[0])
                    n = np.ones(len(s), dtype=np.int64)
                    if len(held):
                        at = np.minimum(np.searchsorted(held, s), len(held) - 1)
                        n = np.where(held[at] == s, often[at], 1)
                    raw = pack(n)
                out.append((bucket, kind, number, raw))
            if out:
                yield _blob_rows(out)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []
        for batch in batches:
            for kind, number, raw in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                if number != now:
                    now, parts = number, []
                if kind == 1:
                    parts.append(unpack(raw.as_py())[0])
                    continue
                nodes, vecs = pickle.loads(zstandard.decompress(raw.as_py()))  # after all answers, which stand in order of buckets
                both = [unpack_vec(x) for x in vecs]
                s = np.unique(np.concatenate([x[0] for x in both]))
                idf = 1 + np.log(texts / np.maximum(np.concatenate(parts), floor * texts)) if len(s) else np.empty(0)
                out = [x.tobytes() + (n * idf[np.searchsorted(s, x)]).tobytes() for x, n in both]
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(out, pa.binary())], names=["node", "vec"])

    rows = counts.table.unionByName(vecs.select("node", "vec").mapInArrow(ask, ROWS_BY_BUCKET))
    rows = rows.repartitionById(n_buckets, F.col("bucket")).sortWithinPartitions("bucket", "kind", "slice")
    back = rows.mapInArrow(answer, ROWS_BY_BUCKET).repartition("slice").sortWithinPartitions("slice", "kind", "bucket")
    return back.mapInArrow(finish, "node binary, vec binary")


def gamma_quantiles(n: int = 1 << 16) -> np.ndarray:
    """n quantiles of the Gamma(2, 1) law, by bisection of its distribution function."""
    q = (np.arange(n) + 0.5) / n
    low, high = np.zeros(n), np.full(n, 40.0)
    for _ in range(60):
        mid = (low + high) / 2
        below = 1 - (1 + mid) * np.exp(-mid) < q
        low, high = np.where(below, mid, low), np.where(below, high, mid)
    return (low + high) / 2


class Sampler:
    """Consistent weighted sampling with the random numbers of (shingle, function) taken from a hash."""

    def __init__(self, n: int = DRAWS):
        quantiles = gamma_quantiles()
        self.r, self.log_c = quantiles.astype(np.float32), np.log(quantiles).astype(np.float32)
        self.odd = T.mix(np.arange(1, n + 1, dtype=np.uint64)) | np.uint64(1)

    def sample(self, s: np.ndarray, log_w: np.ndarray, bounds: np.ndarray, j: int) -> np.ndarray:
        """A 64-bit code of the drawn (shingle, level) of each text; every text has a shingle."""
        x = s * self.odd[j]
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        r = self.r[(x >> np.uint64(48)).astype(np.int64)]
        log_c = self.log_c[((x >> np.uint64(32)) & np.uint64(0xFFFF)).astype(np.int64)]
        beta = ((x ^ (x >> np.uint64(29))) & np.uint64(0xFFFFFF)).astype(np.float32) * np.float32(2**-24)
        level = np.floor(log_w / r + beta)
        log_a = log_c - r * (level - beta + 1)
        # the smallest by a packed key: the float in sortable bits above, the place below
        bits = log_a.view(np.uint32)
        bits = np.where(bits >> 31 == 1, ~bits, bits | np.uint32(0x80000000)).astype(np.uint64)
        packed = (bits << np.uint64(32)) | np.arange(len(s), dtype=np.uint64)
        at = (np.minimum.reduceat(packed, bounds[:-1]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        return T.mix(s[at] ^ T.mix((level[at].astype(np.int64) + (1 << 20)).astype(np.uint64)))


def _lists(values: np.ndarray, full: np.ndarray, kind) -> pa.ListArray:
    """A list of a row of values for each full one, an empty list for the others."""
    ends = np.r_[0, np.cumsum(full * values.shape[1])].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.reshape(-1).view(kind)))


def nodes_of(d1: np.ndarray, d2: np.ndarray) -> pa.Array:
    """Both digests of a text's words as 16 bytes."""
    raw = pa.py_buffer(np.c_[d1, d2].astype(">u8").tobytes())
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(d1), [None, raw]).cast(pa.binary())


def sketches(docs: DataFrame, idf: Idf) -> DataFrame:
    """doc_id, t (hash of the text), node (digests of its words), bands (keys) and sig (two bits of each draw); both empty for a text without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler()
        for batch in batches:
            for part in T.slices(batch, 2, SLICE_BYTES):
                s, bounds, d1, d2 = features(part.column(2))
                full = np.diff(bounds) > 0
                codes = np.zeros((int(full.sum()), DRAWS), dtype=np.uint64)
                if len(codes):
                    s, count, own = distinct_features(s, bounds)
                    log_w = np.log(count * idf.of(s)).astype(np.float32)
                    own = np.r_[own[:-1][full], len(s)]
                    for j in range(DRAWS):
                        codes[:, j] = sampler.sample(s, log_w, own, j)
                keys = np.zeros((len(codes), BANDS), dtype=np.uint64)
                for b, subset in enumerate(SUBSETS):
                    for j in subset:
                        keys[:, b] = T.mix(keys[:, b] * T.BASE + codes[:, j] + np.uint64(b))
                sig = _two_bits(codes, 3)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), nodes_of(d1, d2), _lists(keys, full, np.int64), _lists(sig, full, np.int64)],
                    names=["doc_id", "t", "node", "bands", "sig"],
                )

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("t"), "text").mapInArrow(
        run, "doc_id long, t long, node binary, bands array<long>, sig array<long>"
    )


def _two_bits(codes: np.ndarray, words: int) -> np.ndarray:
    """The upper two bits of each row's codes, packed into so many 64-bit words."""
    each = codes.shape[1] // words
    bits = (codes >> np.uint64(62)).reshape(len(codes), words, each) << np.arange(0, 2 * each, 2, dtype=np.uint64)
    return np.bitwise_or.reduce(bits, axis=2)


def vectors(docs: DataFrame, wanted: DataFrame, idf: Idf) -> DataFrame:
    """node, vec (distinct shingles and counts as bytes) and fine (the finer signature of those in a crowd, else empty) of the texts in wanted (doc_id, t, node, crowd)."""
    places = cut_lineage(wanted.select(F.xxhash64("doc_id", "t").alias("place"), "crowd"))
    members = Members(places, "place", hashed=True)
    crowds = Members(places.where("crowd"), "place", hashed=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = None
        for batch in batches:
            batch = batch.filter(pa.array(members.inside_hashes(batch.column(1).to_numpy().view(np.uint64))))
            for part in T.slices(batch, 0, SLICE_BYTES):
                s, bounds, d1, d2 = features(part.column(0))
                s, count, own = distinct_features(s, bounds)
                raw = [
                    s[a:b].tobytes() + count[a:b].astype(np.uint32).tobytes() for a, b in zip(own, own[1:], strict=False)
                ]
                full = crowds.inside_hashes(part.column(1).to_numpy().view(np.uint64)) & (np.diff(own) > 0)
                kept = np.repeat(full, np.diff(own))
                s, log_w = s[kept], np.log(count * idf.of(s)).astype(np.float32)[kept]
                bounds = np.r_[0, np.cumsum(np.diff(own)[full])]
                codes = np.zeros((int(full.sum()), FINE), dtype=np.uint64)
                if len(codes):
                    sampler = sampler or Sampler(DRAWS + FINE)
                    for j in range(FINE):
                        codes[:, j] = sampler.sample(s, log_w, bounds, DRAWS + j)
                fine = _lists(_two_bits(codes, FINE // 32), full, np.int64)
                yield pa.RecordBatch.from_arrays([nodes_of(d1, d2), pa.array(raw, pa.binary()), fine], names=["node", "vec", "fine"])

    rows = docs.where("doc_id IS NOT NULL").select("text", F.xxhash64(F.col("doc_id").cast("long"), F.xxhash64("text")).alias("place"))
    made = rows.mapInArrow(run, "node binary, vec binary, fine array<long>")
    return made.join(wanted, "node", "left_semi").dropDuplicates(["node"])


def unpack_vec(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Shingles and counts."""
    n = len(raw) // 12
    return np.frombuffer(raw, np.uint64, n), np.frombuffer(raw, np.uint32, n, 8 * n)


def weighted_jaccard(x: bytes, y: bytes) -> float:
    """Of two texts' shingles with weights."""
    (a, w), (b, v) = ((np.frombuffer(r, np.uint64, len(r) // 16), np.frombuffer(r, np.float64, len(r) // 16, len(r) // 2)) for r in (x, y))
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    common = np.minimum(w[i], v[j]).sum()
    return float(common / (w.sum() + v.sum() - common))


def unlike(a: str, b: str, words: int) -> Column:
    """In how many places two arrays of two-bit draws differ."""
    odd = F.lit(0x5555555555555555)
    differ = [F.col(a)[i].bitwiseXOR(F.col(b)[i]) for i in range(words)]
    each = [F.bit_count(d.bitwiseOR(F.shiftrightunsigned(d, 1)).bitwiseAND(odd)) for d in differ]
    return reduce(lambda x, y: x + y, each)


def promising(least: int, fine_least: int) -> Column:
    """Whether the signatures of a text and a centre are so alike that the texts are worth comparing."""
    finer = (F.size("fine") == 0) | (F.size("centre_fine") == 0) | (unlike("fine", "centre_fine", FINE // 32) <= FINE - fine_least)
    return (unlike("sig", "centre_sig", 3) <= DRAWS - least) & finer


def verified(pairs: DataFrame, vecs: DataFrame, threshold: float) -> DataFrame:
    """The pairs (x, y) whose weighted Jaccard similarity reaches the threshold, with similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            j = [weighted_jaccard(p.as_py(), q.as_py()) for p, q in zip(b.column(2), b.column(3), strict=True)]
            out = pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(j, pa.float64())], names=["x", "y", "similarity"])
            yield out.filter(pa.compute.greater_equal(out.column(2), threshold))

    both = pairs.join(vecs.select(F.col("node").alias("x"), F.col("vec").alias("p")), "x").join(
        vecs.select(F.col("node").alias("y"), F.col("vec").alias("q")), "y"
    )
    return both.select("x", "y", "p", "q").mapInArrow(run, "x binary, y binary, similarity double")


def buckets(texts: DataFrame) -> DataFrame:
    """key, node, n (texts of the bucket), of buckets of two or more."""
    keys = texts.select("node", F.explode("bands").alias("key"))
    return cut_lineage(keys.join(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key"))


def classes(docs: DataFrame, threshold: float = THRESHOLD, floor: float = COMMON) -> DataFrame:
    """doc_id, class_id of every row: the smallest doc_id of its class of near-duplicates; floor: the share of holders below which idf does not rise."""
    limits = (LEAST_SHARED, FINE_LEAST) if floor >= COMMON else WIDE
    counts = frequencies(docs)
    idf = floored(counts)
    rows = cut_lineage(sketches(docs, idf))
    usable = rows.where("doc_id IS NOT NULL AND size(bands) > 0")
    texts = cut_lineage(usable.dropDuplicates(["node"]))
    met = buckets(texts)
    # degree: texts that the node meets in all its buckets
    nodes = met.groupBy("node").agg(F.sum("n").alias("degree"), (F.max("n") >= CROWD).alias("crowd"))
    nodes = cut_lineage(texts.select("doc_id", "t", "node", "sig").join(nodes, "node"))
    vecs = cut_lineage(vectors(docs, nodes.select("doc_id", "t", "node", "crowd"), idf))
    members = cut_lineage(met.join(nodes.join(vecs, "node").select("node", "degree", "sig", "fine"), "node"))
    vecs = cut_lineage(weighed(vecs, counts, floor))
    central = F.max(F.struct("degree", "node", "sig", "fine")).alias("c")
    hubs = members.groupBy("key").agg(central).select(
        "key", F.col("c.node").alias("hub"), F.col("c.sig").alias("centre_sig"), F.col("c.fine").alias("centre_fine")
    )
    hubs = cut_lineage(hubs)
    stars = members.join(hubs, "key").where((F.col("node") != F.col("hub")) & promising(*limits))
    tested = cut_lineage(stars.select(F.least("hub", "node").alias("x"), F.greatest("hub", "node").alias("y")).distinct())
    links = cut_lineage(verified(tested, vecs, threshold))
    labels = components(links, "x", "y")
    turns = hubs.select("key", F.col("hub").alias("node"))
    while True:
        named = members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        tops = hubs.join(labels, hubs["hub"] == labels["node"], "left").select("key", F.coalesce("label", "hub").alias("top"))
        outside = named.join(tops, "key").where("label <> top").join(turns, ["key", "node"], "left_anti")
        # a small bucket's texts have a lane each
        at_once = F.floor(F.lit(ROUND_TESTS) / F.col("n"))
        lane = F.when(F.col("n") <= at_once, F.hex("node")).otherwise(F.pmod(F.xxhash64("node"), at_once).cast("string"))
        chosen = outside.groupBy("key", lane.alias("lane")).agg(F.max(F.struct("degree", "node", "sig", "fine", "label")).alias("c"))
        centres = cut_lineage(
            chosen.select("key", *[F.col(f"c.{x}").alias(y) for x, y in (("node", "centre"), ("sig", "centre_sig"), ("fine", "centre_fine"), ("label", "centre_label"))])
        )
        if centres.isEmpty():
            break
        turns = cut_lineage(turns.union(centres.select("key", F.col("centre").alias("node"))))
        pairs = named.join(centres, "key").where((F.col("label") != F.col("centre_label")) & promising(*limits))
        pairs = pairs.select(F.least("centre", "node").alias("x"), F.greatest("centre", "node").alias("y")).distinct()
        fresh = cut_lineage(pairs.join(tested, ["x", "y"], "left_anti"))
        if fresh.isEmpty():
            continue
        tested = cut_lineage(tested.union(fresh))
        found = cut_lineage(verified(fresh, vecs, threshold))
        if not found.isEmpty():  # else the classes stay as they are
            links = cut_lineage(links.union(found))
            labels = components(links, "x", "y")
    first = usable.groupBy("node").agg(F.min("doc_id").alias("first_id"))
    labelled = cut_lineage(labels.join(first, "node"))
    lowest = labelled.groupBy("label").agg(F.min("first_id").alias("lowest"))
    classed = first.join(labelled.join(lowest, "label").select("node", "lowest"), "node", "left")
    named = classed.select("node", F.coalesce("lowest", "first_id").alias("named"))
    own = F.col("doc_id").isNull() | (F.size("bands") == 0)
    return rows.join(named, "node", "left").select("doc_id", F.when(own, F.col("doc_id")).otherwise(F.col("named")).alias("class_id"))


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the members of each class but the smallest doc_id; of rows that share that doc_id and text one stays."""
    lost = classes(docs, threshold).where("doc_id <> class_id").select(F.col("doc_id").alias("__lost")).distinct()
    left = docs.join(lost, F.col("doc_id").cast("long") == F.col("__lost"), "left_anti")
    # ids only: the texts move once more only where some ids do repeat
    counts = docs.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("__twice")).count()
    repeated = cut_lineage(counts.where("count > 1").select("__twice"))
    if repeated.isEmpty():
        return left
    once = left.join(repeated, F.col("doc_id") == F.col("__twice"), "left_anti")
    twice = left.join(repeated, F.col("doc_id") == F.col("__twice"), "left_semi").dropDuplicates(["doc_id", "text"])
    return once.unionByName(twice)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(read_table(spark, sf_dir, "documents"))
