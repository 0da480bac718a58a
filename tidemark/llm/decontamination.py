"""Operator 11, benchmark decontamination, in DataFrame functions only.

A prefix-filtered join. An item is cut into windows of WINDOW consecutive words
(an item of fewer words is one window), a window into shingles of consecutive
words. The windows' shingles are counted over all documents and put in order of
rarity. A window that occurs with a containment of c keeps at least ceil(c*m)
of its m shingles, so it must keep one of the m - ceil(c*m) + 1 rarest: only
these, its prefix, are joined with the documents' shingles. Equal shingles fix
where the window would start (positional bound) and it must lie inside the
document (length bound); then its words are compared in full. A window too few
of whose shingles occur anywhere is dropped before the join.

Hashes only find candidates; what is reported was compared word by word.

Windows and prefixes are broadcast only if their measured size is at most
BROADCAST_BYTES; beyond that documents and prefixes are shuffled by shingle
(joins that Spark can split where a shingle is hot), and only then are the texts
read again for the candidates. A document's hits meet in one group, which its
own length bounds; the other shuffles are summed up by task first.

Defined cases: a null text has no words; rows that share a doc_id are reported
one by one; items that share an item_id are one item, and a null item_id is
written as the empty string; windows that stand in several items or several
times count for each item once; extra columns are not read; an empty table of
documents gives no rows, an empty benchmark no hits; texts of any length are
taken whole (their words are an array in one row, as the text itself is).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import read_table, stored

WINDOW = 10
SHINGLE = 3
BROADCAST_BYTES = 16_000_000

_MARKS = [chr(b) for b in range(128) if not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122)]
_UPPER = [chr(b) for b in range(65, 91)]


def words_of(text: Column) -> Column:
    """The runs of [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of a text with A-Z in lower case."""
    plain = F.trim(F.translate(F.coalesce(text, F.lit("")), "".join(_UPPER + _MARKS), "".join(_UPPER).lower() + " " * len(_MARKS)))
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, " +"))


def windows_of(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """item_id, wid and words of every window of an item."""
    n = F.size("words")
    size = F.least(F.lit(window), n)
    cut = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), words_of(F.col("text")).alias("words")).where(n > 0)
    each = cut.select("item_id", F.explode(F.transform(F.sequence(F.lit(0), n - size), lambda i: F.slice("words", i + 1, size))).alias("words"))
    return each.select("item_id", F.md5(F.array_join("words", " ")).alias("wid"), "words")


def _shingle(words: Column, at: Column, width: int) -> Column:
    return F.xxhash64(F.lit(width), *[F.get(words, at + i) for i in range(width)])


def _needed(m: Column, containment: float) -> Column:
    return F.ceil(m * containment - 1e-9).cast("int")


def _small(df: DataFrame, size: Column) -> bool:
    return (df.agg(F.sum(size + 64)).first()[0] or 0) <= BROADCAST_BYTES


def _places(docs: DataFrame, widths: list[int]) -> DataFrame:
    """A row for each word's place and shingle width: q, width, h; and one of place -1 for the document itself."""
    q, n = F.col("q"), F.size("words")
    rows = docs.withColumn("q", F.explode(F.sequence(F.lit(-1), n - 1)))
    if len(widths) == 1:
        rows = rows.withColumn("width", F.lit(widths[0]))
    else:
        rows = rows.withColumn("width", F.explode(F.when(q < 0, F.array(F.lit(widths[0]))).otherwise(F.array(*map(F.lit, widths)))))
    rows = rows.where((q < 0) | (q + F.col("width") <= n))
    h = F.when(q < 0, F.lit(0).cast("long"))
    for w in widths:
        h = h.when(F.col("width") == w, _shingle(F.col("words"), q, w))
    return rows.withColumn("h", h)


def prefixes(docs: DataFrame, windows: DataFrame, containment: float, shingle: int = SHINGLE) -> tuple[DataFrame, list[int]]:
    """wid, words, p (the shingle's place in the window) and h of the rarest shingles that an occurrence must keep one of; and the widths in use.

    docs: a column words. windows: distinct, with wid and words.
    """
    size = F.size("words")
    width = F.least(F.lit(shingle), size)
    h = F.when(width == shingle, _shingle(F.col("words"), F.col("p"), shingle))
    for w in range(1, shingle):
        h = h.when(width == w, _shingle(F.col("words"), F.col("p"), w))
    m = size - width + 1
    each = windows.withColumn("p", F.explode(F.sequence(F.lit(0), m - 1))).select("wid", "words", "p", m.alias("m"), width.alias("width"), h.alias("h"))
    each = stored(each)
    widths = sorted(r.width for r in each.select("width").distinct().collect())  # at most `shingle` rows
    if not widths:
        return each.select("wid", "words", "p", "h"), [shingle]
    keys = each.select("h").distinct()
    keys = F.broadcast(keys) if _small(keys, F.lit(0)) else keys
    seen = _places(docs.select("words"), widths).where("q >= 0").select("h").join(keys, "h").groupBy("h").agg(F.count("*").alias("n"))
    by = Window.partitionBy("wid")
    ranked = (
        each.join(seen, "h")  # a shingle that no document holds can't be kept
        .withColumn("live", F.count("*").over(by))
        .withColumn("rank", F.row_number().over(by.orderBy("n", "h", "p")))
    )
    lost = F.col("m") - F.col("live")  # shingles that every occurrence lacks, which come before the rarest of the others
    chosen = ranked.where(F.col("rank") + lost <= F.col("m") - _needed(F.col("m"), containment) + 1)
    return chosen.select("wid", "words", "p", "h"), widths


def occurrences(docs: DataFrame, windows: DataFrame, containment: float = 1.0, shingle: int = SHINGLE) -> DataFrame:
    """rid, doc_id, n_words, and start, end (words from 0) and wid of every occurrence; also one row of nulls for every document.

    windows: distinct, with wid and words. containment: the share of a window's shingles that must stand at their places.
    """
    docs = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", words_of(F.col("text")).alias("words"))
    chosen, widths = prefixes(docs, windows, containment, shingle)
    chosen = stored(chosen.withColumnRenamed("words", "window"))
    size = F.size("window")
    start = F.col("q") - F.col("p")
    inside = (start >= 0) & (start + size <= F.col("n_words"))
    found = F.slice("words", F.greatest(start, F.lit(0)) + 1, size).alias("found")  # the words at the window's place
    hit = F.col("q") >= 0
    out = (
        "rid", "doc_id", "n_words", F.when(hit, start).alias("start"), F.when(hit, start + size).alias("end"), "wid",
        F.when(hit, found).alias("found"), "window",
    )
    if _small(chosen, F.octet_length(F.array_join("window", " ")) + 24 * size):
        # place -1 of each document meets the row of h = 0, so that one pass gives hits and documents; the words at a
        # place are cut out and compared in the pass that makes the places, so no row holds a document's words
        lone = docs.sparkSession.range(1).select(
            F.lit(None).cast("string").alias("wid"), F.lit(None).cast("array<string>").alias("window"), F.lit(0).alias("p"), F.lit(0).cast("long").alias("h")
        )
        every = _places(docs, widths).join(F.broadcast(chosen.select("wid", "window", "p", "h").unionByName(lone)), "h").withColumn("n_words", F.size("words"))
        same = (found == F.col("window")) if containment >= 1 else F.lit(True)
        rows = every.where(F.when(hit, inside & same).otherwise(F.col("wid").isNull())).select(*out)
    else:
        docs = stored(docs)
        rows = _places(docs, widths).where(hit).select("rid", "doc_id", F.size("words").alias("n_words"), "q", "h").join(chosen, "h").where(inside)
        rows = rows.join(docs.select("rid", "words"), "rid").select(*out)
        if containment >= 1:
            rows = rows.where("found = window")
        none = (F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in ("start", "end", "wid", "found", "window"))
        rows = rows.unionByName(docs.select("rid", "doc_id", F.size("words").alias("n_words"), *none))
    if containment >= 1:
        return rows.drop("found", "window")
    rows = rows.groupBy("rid", "doc_id", "n_words", "start", "end", "wid").agg(F.first("found").alias("found"), F.first("window").alias("window"))
    width = F.least(F.lit(shingle), size)
    stands = F.filter(F.sequence(F.lit(0), size - width), lambda j: F.slice("found", j + 1, width) == F.slice("window", j + 1, width))
    return rows.where(F.col("wid").isNull() | (F.size(stands) >= _needed(size - width + 1, containment))).drop("found", "window")


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, containment: float = 1.0, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items (their ids as strings, sorted), contaminated: one row a document."""
    if not (window >= 1 and 1 <= shingle and 0 < containment <= 1):
        raise ValueError("window and shingle are at least 1, containment is above 0 and at most 1")
    cut = stored(windows_of(items, window))
    found = stored(occurrences(docs, cut.select("wid", "words").distinct(), containment, shingle))
    spans = found.groupBy("rid", "doc_id", "n_words").agg(F.array_sort(F.collect_set(F.when(F.col("start").isNotNull(), F.struct("start", "end")))).alias("spans"))
    zero = F.struct(F.lit(0).alias("reach"), F.lit(0).alias("n"))

    def add(acc: Column, x: Column) -> Column:
        new = F.greatest(F.lit(0), x["end"] - F.greatest(x["start"], acc["reach"]))
        return F.struct(F.greatest(acc["reach"], x["end"]).alias("reach"), (acc["n"] + new).alias("n"))

    hit = F.aggregate("spans", zero, add, lambda acc: acc["n"]).cast("long")
    of_doc = (
        found.where("wid is not null").select("rid", "wid").distinct().join(cut.select("wid", "item_id").distinct(), "wid")
        .groupBy("rid").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    )
    items_or_none = F.coalesce("items", F.array().cast("array<string>"))
    return spans.join(of_doc, "rid", "left").select(
        "doc_id", F.col("n_words").cast("long"), hit.alias("n_hit"), F.size(items_or_none).cast("long").alias("n_items"),
        items_or_none.alias("items"), (hit > 0).alias("contaminated"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


_SQL_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_SQL_WORDS} AS w FROM documents),
i AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id, {_SQL_WORDS} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least({WINDOW}, len(w)) AS size, array_to_string(w[s + 1 : s + least({WINDOW}, len(w))], ' ') AS win
  FROM (SELECT *, unnest(range(0, len(w) - least({WINDOW}, len(w)) + 1)) AS s FROM i WHERE len(w) > 0)
),
sizes AS (SELECT DISTINCT size FROM windows),
places AS (
  SELECT rid, s, size, array_to_string(w[s + 1 : s + size], ' ') AS win
  FROM (SELECT d.*, size, unnest(range(0, len(w) - size + 1)) AS s FROM d, sizes WHERE len(w) >= size)
),
hits AS (SELECT rid, s, p.size, item_id FROM places p JOIN windows USING (size, win)),
words AS (SELECT rid, count(DISTINCT place) AS n_hit FROM (SELECT rid, unnest(range(s, s + size)) AS place FROM (SELECT DISTINCT rid, s, size FROM hits)) GROUP BY rid),
found AS (SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT rid, item_id FROM hits) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (rid) LEFT JOIN found USING (rid)
"""
