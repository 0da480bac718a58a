"""Operator 8, removal of byte strings of LENGTH bytes that start more than once in a corpus.

The places of a text are its suffixes. A suffix enters the sort only if its first
LENGTH bytes can be repeated:

* texts that are copies of each other stand once; all of a copy of at least
  LENGTH bytes is repeated;
* the smallest of a prefix's GRAM-byte fingerprints, its anchor, is a function
  of the prefix, so equal prefixes share it; anchors are counted over all texts,
  and a prefix whose anchor stands once in the corpus is not repeated. The
  repeated anchors go to every task as a bit set of fixed size.

Neighbouring places with one anchor are a stretch: one row with the bytes that
their prefixes cover. Equal stretches meet and stand once, with their number.
Stretches are dealt out by anchor, and each task sorts the suffixes of a slice of
whole anchors by the difference-cover method: sampled triples are sorted and
named, names are sorted by the same method again, the other suffixes are put in
order by their first symbol and the sampled suffix behind it, and both are
merged. Neighbours in that order are compared over LENGTH bytes. An anchor with
more distinct stretches than a slice may hold is not sorted in one task: its
prefixes are grouped by a 128-bit digest over all tasks.

Repeated places come back to their texts as spans; overlapping spans join.

Defined cases: a null text is empty; a null doc_id is carried as it is; rows
that are equal are copies of each other, so at LENGTH bytes or more both go
whole; extra columns pass through remove() and are not read elsewhere; an empty
table gives an empty result. Texts and stretches are told apart by 128-bit
digests, prefixes in a slice by their bytes.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import tokens as T
from tidemark.llm.common import Members, cut_lineage, read_table

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LENGTH = 400
GRAM = 256
SLICE_BYTES = 500_000
#: Most bits of the set of repeated anchors (16 MB); a smaller set takes 64 bits a member or more.
ANCHOR_BITS = 27
#: Most bytes of one anchor's stretches that one task sorts, and the symbols of a slice (three names of which fit in 63 bits).
MOST_BYTES, SLICE_SYMBOLS = 250_000, 400_000


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """For each window of width values the place of its smallest, the leftmost of equal ones."""
    n = len(values)
    if n < width:
        return np.empty(0, dtype=np.int64)
    bits = np.uint64(max(16, int(n).bit_length()))
    packed = ((values >> bits) << bits) | np.arange(n, dtype=np.uint64)
    rows = np.r_[packed, np.full((-n) % width, np.iinfo(np.uint64).max, np.uint64)].reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).reshape(-1)
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    at = np.arange(n - width + 1)
    low = np.minimum(back[at], ahead[at + width - 1])
    return (low & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)


def windows_of(texts: T.Texts, length: int, gram: int):
    """Per text with at least length bytes: its number and start, and for all its places the anchor's fingerprint and place."""
    sums = T.prefix_sums(texts.data)
    for d in np.flatnonzero(np.diff(texts.offsets) >= length):
        a, b = texts.offsets[d], texts.offsets[d + 1]
        at = np.arange(a, b - gram + 1)
        grams = T.ranges(sums, at, at + gram)
        low = sliding_argmin(grams, length - gram + 1)
        # minima crowd at the low end of the range; mixed, they fill a bit set evenly
        yield int(d), int(a), T.mix(grams[low]), low


def _outside(batches: Iterator[pa.RecordBatch], members: Members | None) -> Iterator[pa.RecordBatch]:
    """The batches without the rows whose __slot may be among the members."""
    for batch in batches:
        yield batch if members is None else batch.filter(pa.array(~members.inside_hashes(batch.column("__slot").to_numpy().view(np.uint64))))


def anchors(texts: DataFrame, length: int, gram: int, but: Members | None = None) -> DataFrame:
    """a, n: fingerprints of anchors and how many anchors have them, of texts whose __slot is not in but; partial counts by slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _outside(batches, but):
            for part in T.slices(batch, 0, SLICE_BYTES):
                texts_in = T.texts_of(part.column(0), lower=False)
                each = [g[np.r_[True, low[1:] != low[:-1]]] for _, _, g, low in windows_of(texts_in, length, gram)]
                a, n = np.unique(np.concatenate(each) if each else np.empty(0, np.uint64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(n)], names=["a", "n"])

    return texts.select("text", "__slot").mapInArrow(run, "a long, n long")


def stretches(texts: DataFrame, repeated: Members, length: int, gram: int, but: Members | None = None) -> DataFrame:
    """a (anchor), __tkey, starts, bytes: the distinct stretches of each text whose __slot is not in but, and where they start in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _outside(batches, but):
            for part in T.slices(batch, 1, SLICE_BYTES):
                inside = T.texts_of(part.column(1), lower=False)
                whole = inside.data.tobytes()
                out: list[list] = [[], [], [], []]
                for d, begin, grams, low in windows_of(inside, length, gram):
                    start = np.flatnonzero(np.r_[True, low[1:] != low[:-1]])
                    end = np.r_[start[1:], len(low)]
                    may = repeated.inside_hashes(grams[start])
                    own: dict[tuple[int, bytes], list[int]] = {}
                    for a, b, g in zip(start[may].tolist(), end[may].tolist(), grams[start[may]].view(np.int64).tolist(), strict=True):
                        own.setdefault((g, whole[begin + a : begin + b - 1 + length]), []).append(a)
                    out[0] += [g for g, _ in own]
                    out[1] += [d] * len(own)
                    out[2] += own.values()
                    out[3] += [x for _, x in own]
                columns = [pa.array(out[0], pa.int64()), part.column(0).take(pa.array(out[1], pa.int64())), pa.array(out[2], pa.list_(pa.int32())), pa.array(out[3], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["a", "__tkey", "starts", "bytes"])

    return texts.select("__tkey", "text", "__slot").mapInArrow(run, "a long, __tkey binary, starts array<int>, bytes binary")


def _sieve(rows: DataFrame, members: Members, inside: bool = True) -> DataFrame:
    """The rows (with __slot) whose __slot may be, or is surely not, among the members."""
    schema = rows.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(members.inside_hashes(batch.column("__slot").to_numpy().view(np.uint64)) == inside))

    return rows.mapInArrow(run, schema)


def _packed(*parts: np.ndarray) -> np.ndarray:
    """Up to three symbols of 21 bits in one number, the first on top."""
    key = np.zeros(len(parts[0]), dtype=np.int64)
    for p in parts:
        key = (key << 21) | p
    return key


def suffix_order(x: np.ndarray) -> np.ndarray:
    """The places of x (numbers from 1 below 2**21, int64) in the order of the suffixes that start there."""
    n = len(x)
    x = np.r_[x, 0, 0, 0]
    # sampled suffixes: places 1 and 2 modulo 3; one more, all padding, where the last place is 0 modulo 3
    one = np.arange(1, n + (n % 3 == 1), 3)
    two = np.arange(2, n, 3)
    sampled = np.r_[one, two]
    triples = _packed(x[sampled], x[sampled + 1], x[sampled + 2])
    order = np.argsort(triples, kind="stable")
    new = np.r_[True, np.diff(triples[order]) != 0] if len(order) else np.empty(0, bool)
    names = np.empty(len(sampled), dtype=np.int64)
    names[order] = np.cumsum(new)
    if len(order) and not new.all():
        order = suffix_order(names)
    rank = np.zeros(n + 4, dtype=np.int64)
    rank[sampled[order]] = np.arange(1, len(order) + 1)
    rank[n:] = 0  # places behind the end come first
    sorted_sample = sampled[order]
    sorted_sample = sorted_sample[sorted_sample < n]
    rest = np.arange(0, n, 3)
    rest = rest[np.argsort(_packed(x[rest], rank[rest + 1]), kind="stable")]
    s1, s2 = sorted_sample[sorted_sample % 3 == 1], sorted_sample[sorted_sample % 3 == 2]
    before = np.searchsorted(_packed(x[s1], rank[s1 + 1]), _packed(x[rest], rank[rest + 1]))
    before += np.searchsorted(_packed(x[s2], x[s2 + 1], rank[s2 + 2]), _packed(x[rest], x[rest + 1], rank[rest + 2]))
    out = np.empty(n, dtype=np.int64)
    at = before + np.arange(len(rest))
    free = np.ones(n, dtype=bool)
    free[at] = False
    out[at], out[free] = rest, sorted_sample
    return out


def repeated_runs(parts: list[bytes], several: np.ndarray, length: int) -> list[list[int]]:
    """Of each stretch the runs of places (start, end, start, end, ...) whose prefix is repeated among the stretches, or all if it stands several times."""
    sizes = np.array([len(p) for p in parts])
    begin = np.cumsum(sizes + 1) - sizes - 1
    raw = np.frombuffer(b"\0".join([*parts, b""]), dtype=np.uint8)
    symbols = raw.astype(np.int64) + 2
    symbols[begin + sizes] = 1
    places = np.zeros(len(raw) + 1, dtype=np.int8)
    np.add.at(places, begin, 1)
    np.add.at(places, begin + sizes - length + 1, -1)
    place = np.cumsum(places[:-1]) > 0
    order = suffix_order(symbols)
    order = order[place[order]]
    a, b = order[:-1], order[1:]
    sums = T.prefix_sums(raw)
    h = T.ranges(sums, order, order + length)
    close = np.flatnonzero(h[1:] == h[:-1])
    view = np.lib.stride_tricks.sliding_window_view(raw, length)
    repeated = np.zeros(len(raw) + 1, dtype=bool)
    for k in range(0, len(close), 20_000):
        c = close[k : k + 20_000]
        c = c[(view[a[c]] == view[b[c]]).all(axis=1)]
        repeated[a[c]] = repeated[b[c]] = True
    whole = np.zeros(len(raw) + 1, dtype=np.int8)
    np.add.at(whole, begin[several], 1)
    np.add.at(whole, (begin + sizes - length + 1)[several], -1)
    repeated |= np.cumsum(whole) > 0
    edge = np.flatnonzero(repeated[1:] != repeated[:-1]) + 1
    edge = np.r_[0, edge] if repeated[0] else edge
    # a run of places stays within its stretch: at least a separator stands between two of them
    owner = np.searchsorted(begin, edge, side="right") - 1
    cut = np.searchsorted(owner, np.arange(len(parts) + 1))
    edge = edge - begin[owner]
    return [edge[i:j].tolist() for i, j in zip(cut, cut[1:], strict=False)]


def sorted_runs(distinct: DataFrame, length: int) -> DataFrame:
    """b, runs of the distinct stretches (a, b, bytes, n) with a repeated place, by difference-cover sorts of slices of whole anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, bytes, bytes, int]] = []
        size = 0

        def done(rows):
            runs = repeated_runs([r[2] for r in rows], np.array([r[3] > 1 for r in rows]), length)
            found = [(r[1], x) for r, x in zip(rows, runs, strict=True) if x]
            return pa.RecordBatch.from_arrays([pa.array([b for b, _ in found], pa.binary()), pa.array([x for _, x in found], pa.list_(pa.int32()))], names=["b", "runs"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size > SLICE_SYMBOLS - MOST_BYTES and row[0] != held[-1][0]:
                    yield done(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[2]) + 1
        if held:
            yield done(held)

    by_anchor = distinct.select("a", "b", "bytes", "n").repartition("a").sortWithinPartitions("a")
    return by_anchor.mapInArrow(run, "b binary, runs array<int>")


def grouped_runs(distinct: DataFrame, length: int) -> DataFrame:
    """The same by digests of all prefixes, for anchors with too many stretches for one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, raw, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                f = [hashlib.md5(raw[i : i + length]).digest() for i in range(len(raw) - length + 1)]
                at = pa.array(range(len(f)), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(f, pa.binary()), pa.array([b] * len(f), pa.binary()), at, pa.array([n] * len(f), pa.int64())], names=["f", "b", "at", "n"])

    places = cut_lineage(distinct.select("b", "bytes", "n").mapInArrow(run, "f binary, b binary, at int, n long"))
    repeated = places.groupBy("f").agg(F.sum("n").alias("n")).where("n > 1").select("f")
    runs = F.flatten(F.transform(F.array_sort(F.collect_set("at")), lambda i: F.array(i, i + 1)))
    return places.join(repeated, "f").groupBy("b").agg(runs.alias("runs"))


def joined_spans(found: list | None, length: int) -> list[tuple[int, int]]:
    """The union of the strings that start at the runs of the stretches (starts, runs)."""
    spans = sorted(
        (s + a, s + b - 1 + length) for x in found or [] for s in x["starts"] for a, b in zip(x["runs"][::2], x["runs"][1::2], strict=True)
    )
    out: list[tuple[int, int]] = []
    for a, b in spans:
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, most: int = MOST_BYTES):
    """(rows, copies, found): rows of docs with __tkey (digest of the text) and __slot; the __tkeys of texts that are copies; __tkey and __found, its stretches' starts and repeated runs."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.withColumn("text", text).withColumn("__tkey", F.unhex(F.md5(text))).withColumn("__slot", F.xxhash64(text))
    copies = cut_lineage(rows.groupBy("__tkey", "__slot").count().where("count > 1").select("__tkey", "__slot"))
    twins = Members(copies, "__slot", hashed=True)
    slim = rows.select("__tkey", "__slot", "text")
    several = _sieve(slim, twins).dropDuplicates(["__tkey"])
    counted = anchors(slim, length, gram, but=twins).unionByName(anchors(several, length, gram)).groupBy("a").agg(F.sum("n").alias("n"))
    several_times = cut_lineage(counted.where("n > 1").select("a"))
    bits = min(ANCHOR_BITS, max(20, (64 * several_times.count()).bit_length()))
    repeated = Members(several_times, "a", bits=bits, hashed=True)
    found = stretches(slim, repeated, length, gram, but=twins).unionByName(stretches(several, repeated, length, gram))
    found = cut_lineage(found.withColumn("b", F.unhex(F.md5("bytes"))))
    distinct = found.groupBy("a", "b").agg(F.first("bytes").alias("bytes"), F.sum(F.size("starts")).alias("n"))
    distinct = cut_lineage(distinct)
    hot = cut_lineage(distinct.groupBy("a").agg(F.sum(F.octet_length("bytes") + 1).alias("size")).where(F.col("size") > most).select("a"))
    if hot.isEmpty():
        runs = sorted_runs(distinct, length)
    else:
        cold = distinct.join(hot, "a", "left_anti")
        runs = sorted_runs(cold, length).unionByName(grouped_runs(distinct.join(hot, "a", "left_semi"), length))
    back = found.select("__tkey", "b", "starts").join(runs, "b")
    return rows, copies, cut_lineage(back.groupBy("__tkey").agg(F.collect_list(F.struct("starts", "runs")).alias("__found")))


def with_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, most: int = MOST_BYTES) -> tuple[DataFrame, DataFrame]:
    """Rows without a repeated string, and rows that may have one, with __copy (boolean) and __found."""
    rows, copies, found = repeats(docs, length, gram, most)
    marked = copies.select("__tkey", F.lit(True).alias("__copy")).join(found, "__tkey", "full_outer")
    marked = cut_lineage(marked)
    touched = Members(marked, "__tkey")
    rows = rows.withColumn("__slot", F.xxhash64("__tkey"))
    return _sieve(rows, touched, False), _sieve(rows, touched, True).join(marked, "__tkey", "left")


def removed(size: int, copy: bool, found: list | None, length: int) -> list[tuple[int, int]]:
    if copy:
        return [(0, size)] if size >= length else []
    return joined_spans(found, length)


def digests(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, most: int = MOST_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[], [], [], []]
            copy, *more = batch.columns[2:] if batch.num_columns > 2 else [None]
            for i, t in enumerate(batch.column(1)):
                raw = t.as_py().encode("utf-8")
                cut = [] if copy is None else removed(len(raw), bool(copy[i].as_py()), *(x[i].as_py() for x in more), length)
                at, left = 0, hashlib.sha256()
                for a, b in cut:
                    left.update(raw[at:a])
                    at = b
                left.update(raw[at:])
                for x, v in zip(rows, (len(raw), sum(b - a for a, b in cut), len(cut), left.hexdigest()), strict=True):
                    x.append(v)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(x, pa.int64()) for x in rows[:3]), pa.array(rows[3], pa.string())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    clean, maybe = with_spans(docs.select(F.col("doc_id").cast("long"), "text"), length, gram, most)
    return clean.select("doc_id", "text").mapInArrow(run, schema).unionByName(
        maybe.select("doc_id", "text", "__copy", "__found").mapInArrow(run, schema)
    )


def remove(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """docs with the repeated bytes cut from text; a code point that loses a byte goes whole."""

    @F.udf("string")
    def cut(text: str, copy: bool | None, found: list | None) -> str:
        raw = text.encode("utf-8")
        keep, at = [], 0
        for a, b in removed(len(raw), bool(copy), found, length):
            keep.append(raw[at:a])
            at = b
        return b"".join([*keep, raw[at:]]).decode("utf-8", errors="ignore")

    clean, maybe = with_spans(docs, length, gram)
    names = [F.col(f"`{c}`") for c in docs.columns]
    done = maybe.withColumn("text", cut("text", "__copy", "__found")).select(*names)
    return clean.select(*names).unionByName(done)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(read_table(spark, sf_dir, "documents"))


ORACLE_SQL = None
