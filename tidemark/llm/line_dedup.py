"""Operator 9, substring dedup by hashing lines, sentences or paragraphs.

Each text is cut into units; a unit is normalised (words of letters, digits and
everything beyond ASCII, A-Z lower-case, marks and white space dropped) and
digested in 128 bits. Digests are grouped over all documents; the earliest
occurrence, by doc_id and then by place, stays, and every other one is removed,
with its offsets in the original text retained. The registered query takes whole
lines of any length, and in the lines that stay sentences of at least MIN_WORDS
words: shorter ones inside a line are too common by chance.

A digest in a third of all documents is pre-aggregated by each task before the
shuffle, and removal is a join (which Spark can split where it is skewed), not
a group: no task gathers a digest's occurrences.

Defined cases: a null text is empty and has no units; a null doc_id ranks last;
rows that share a doc_id are one document, so a unit that the document keeps is
kept in each of these rows; extra columns pass through deduplicate() and are
not read elsewhere; an empty table gives an empty result.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import tokens as T
from tidemark.llm.common import read_table

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MIN_WORDS = 5
SLICE_BYTES = 8_000_000
LAST = (1 << 63) - 1

_BREAK = np.array([b in (10, 13) for b in range(256)])
_STOP = np.array([chr(b) in ".!?" for b in range(256)])
UNITS = ("line", "sentence", "paragraph")


def _unit_ends(texts: T.Texts, unit: str) -> np.ndarray:
    """True at every byte that is the last of a unit."""
    data, offsets = texts
    n = len(data)
    line = _BREAK[data]
    if unit == "paragraph":  # a line break after a line break
        ends = np.zeros(n, dtype=bool)
        ends[1:] = line[1:] & line[:-1]
    elif unit == "sentence":  # a line break, or a full stop before white space
        ends = line.copy()
        ends[:-1] |= _STOP[data[:-1]] & ~T.NOT_SPACE[data[1:]]
    else:
        ends = line
    after = offsets[1:][np.diff(offsets) > 0] - 1
    ends[after] = True
    return ends


def units_of(column: pa.Array, unit: str = "sentence", min_words: int = MIN_WORDS):
    """Per unit: text number, start and end (code points), words, two 64-bit digests, and whether it is the text's first of its kind."""
    texts = T.texts_of(column)
    words = T.words_of(texts, T.WORD_BYTES)
    h = T.hash_words(texts, words)
    ends = _unit_ends(texts, unit)
    number = np.cumsum(ends) - ends  # of the unit that each byte is in
    of_word = number[words.start] if len(words.start) else np.empty(0, np.int64)
    first = np.flatnonzero(np.r_[True, np.diff(of_word) > 0]) if len(of_word) else np.empty(0, np.int64)
    count = np.diff(np.r_[first, len(of_word)])
    place = np.arange(len(of_word)) - np.repeat(first, count)
    digests = []
    for salt in (1, 2):
        step = T.mix((place + 1).astype(np.uint64) * np.uint64(0xA24BAED4963EE407) + np.uint64(salt))
        digests.append(T.mix(np.add.reduceat(T.mix(h ^ step), first) + count.astype(np.uint64)) if len(first) else h)
    # a unit's end is just after its last byte that is no line break
    end_at = np.flatnonzero(ends)[of_word[first]] if len(first) else np.empty(0, np.int64)
    stop = np.where(_BREAK[texts.data[end_at]], end_at, end_at + 1) if len(first) else end_at
    stop = np.maximum(stop, words.end[first + count - 1]) if len(first) else stop
    begin = words.start[first]
    doc = np.searchsorted(texts.offsets, begin, side="right") - 1
    points = np.r_[0, np.cumsum((texts.data & 0xC0) != 0x80)]
    base = points[texts.offsets[doc]] if len(first) else begin
    keep = count >= min_words
    doc, start, end, count = (x[keep] for x in (doc, points[begin] - base, points[stop] - base, count))
    a, b = (x[keep] for x in digests)
    # the first occurrence within the text
    order = np.lexsort((start, b, a, doc))
    same = np.zeros(len(order), dtype=bool)
    same[1:] = (doc[order][1:] == doc[order][:-1]) & (a[order][1:] == a[order][:-1]) & (b[order][1:] == b[order][:-1])
    lead = np.empty(len(order), dtype=bool)
    lead[order] = ~same
    return doc, start, end, count, a, b, lead


def units(docs: DataFrame, unit: str = "sentence", min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, start, end, n_words, a, b, lead: one row a unit."""
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {UNITS}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch, 1, SLICE_BYTES):
                doc, start, end, n, a, b, lead = units_of(part.column(1), unit, min_words)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(doc)), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32)),
                        pa.array(n.astype(np.int32)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(lead),
                    ],
                    names=["doc_id", "start", "end", "n_words", "a", "b", "lead"],
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, start int, end int, n_words int, a long, b long, lead boolean"
    )


def removals(docs: DataFrame, unit: str = "sentence", min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, start, end, n_words and kept_doc_id of every unit that is not its digest's earliest occurrence."""
    every = units(docs, unit, min_words)
    rank = F.coalesce("doc_id", F.lit(LAST))
    groups = every.groupBy("a", "b").agg(F.min(rank).alias("kept"), F.count("*").alias("n")).where("n > 1").drop("n")
    return (
        every.join(groups, ["a", "b"])
        .where(~((rank == F.col("kept")) & F.col("lead")))
        .select("doc_id", "start", "end", "n_words", F.when(F.col("kept") != LAST, F.col("kept")).alias("kept_doc_id"))
    )


def levels_of(column: pa.Array):
    """units_of() for whole lines of any length and for sentences of MIN_WORDS words that are no whole line; and per unit its line's row."""
    line, part = units_of(column, "line", 1), units_of(column, "sentence", MIN_WORDS)
    # lines stand in order and hold every word, so a sentence's line is the last that starts at or before it
    inside = np.searchsorted((line[0] << 32) | line[1], (part[0] << 32) | part[1], side="right") - 1
    own = (part[1] != line[1][inside]) | (part[2] != line[2][inside])
    doc, start, end, count, a, b, _ = (np.r_[x, y[own]] for x, y in zip(line, part, strict=True))
    of_line = np.r_[np.arange(len(line[0])), inside[own]]
    order = np.lexsort((start, b, a, doc))
    same = np.zeros(len(order), dtype=bool)
    same[1:] = (doc[order][1:] == doc[order][:-1]) & (a[order][1:] == a[order][:-1]) & (b[order][1:] == b[order][:-1])
    lead = np.empty(len(order), dtype=bool)
    lead[order] = ~same
    return doc, start, end, count, a, b, lead, of_line


def level_removals(docs: DataFrame) -> DataFrame:
    """As removals(), for repeated whole lines of any length, and for repeated sentences of MIN_WORDS words in the lines that stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch, 1, SLICE_BYTES):
                doc, start, end, n, a, b, lead, of_line = levels_of(part.column(1))
                a, b = a.view(np.int64), b.view(np.int64)
                whole = of_line == np.arange(len(of_line))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(doc)), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32)),
                        pa.array(n.astype(np.int32)), pa.array(a), pa.array(b), pa.array(lead), pa.array(a[of_line], mask=whole),
                        pa.array(b[of_line], mask=whole), pa.array(lead[of_line]),
                    ],
                    names=["doc_id", "start", "end", "n_words", "a", "b", "lead", "line_a", "line_b", "line_lead"],
                )

    every = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run,
        "doc_id long, start int, end int, n_words int, a long, b long, lead boolean, line_a long, line_b long, line_lead boolean",
    )
    rank = F.coalesce("doc_id", F.lit(LAST))
    groups = every.groupBy("a", "b").agg(F.min(rank).alias("kept"), F.count("*").alias("n")).where("n > 1").drop("n")
    again = every.join(groups, ["a", "b"]).where(~((rank == F.col("kept")) & F.col("lead")))
    # a sentence goes with its line where that is removed
    lines = groups.select(F.col("a").alias("line_a"), F.col("b").alias("line_b"), F.col("kept").alias("line_kept"))
    stays = F.col("line_kept").isNull() | ((rank == F.col("line_kept")) & F.col("line_lead"))
    return (
        again.join(lines, ["line_a", "line_b"], "left")
        .where(stays)
        .select("doc_id", "start", "end", "n_words", F.when(F.col("kept") != LAST, F.col("kept")).alias("kept_doc_id"))
    )


def deduplicate(docs: DataFrame, unit: str = "sentence", min_words: int = MIN_WORDS) -> DataFrame:
    """docs with the removed units cut from text, and removed_spans: their (start, end) in the original text, in order."""
    spans = (
        removals(docs, unit, min_words)
        .groupBy(F.col("doc_id").alias("__id"))
        .agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("removed_spans"))
    )
    t = F.col("text")
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    kept = F.aggregate(
        "removed_spans",
        zero,
        lambda acc, x: F.struct(
            x["end"].alias("at"), F.array_append(acc["out"], F.substring(t, acc["at"] + 1, x["start"] - acc["at"])).alias("out")
        ),
        lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(t, acc["at"] + 1, F.length(t))),
    )
    both = docs.join(spans, F.col("doc_id").cast("long").eqNullSafe(F.col("__id")), "left").drop("__id")
    return both.withColumn("text", F.when(F.size("removed_spans") > 0, kept).otherwise(t))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removals(read_table(spark, sf_dir, "documents"))


def level_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return level_removals(read_table(spark, sf_dir, "documents"))
