"""Operator 3, mixing sources to target weights.

Every document gets a hash-random key; within its source documents stand in key
order, and the prefix sum of word counts is cut at the source's budget. The key
space is divided into ranges by the leading hex digits of the key (uniform, as
the keys are hashes), so a prefix sum is the sum of the earlier ranges plus a
running sum inside one range: a source that holds a third of all rows is spread
over all its ranges, and no task sees a whole source. A budget above a source's
size takes whole epochs first and the remainder from the front of the order.

Defined cases: a null text has size 0; a null source is a source of its own,
ordered last; a source of size 0 has target 0; ties of the key stand by doc_id
and size, so rows that are equal get the same multiset of results; only doc_id,
source and text are read, so extra columns cannot clash; an empty table gives
an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import cut_lineage, read_table

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_EPOCHS = 2
SEED = "mix-1"
#: Hex digits of the key that name a range: 16**3 ranges a source.
RANGE_DIGITS = 3
#: The same where texts are put in order inside a range: a source's 65536th part.
MIXED_DIGITS = 4
#: Most sources whose table (a row a source) goes to every task; beyond it the join is left to Spark.
MOST_SOURCES = 20_000


def keyed(docs: DataFrame, seed: str = SEED, digits: int = RANGE_DIGITS, carry: Column | None = None) -> DataFrame:
    """doc_id, source, skey, size, key and range of every document; no text but what carry holds."""
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    size = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)).cast("long")
    return docs.select(
        "doc_id",
        "source",
        F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("skey"),
        size.alias("size"),
        key.alias("key"),
        F.conv(F.substring(key, 1, digits), 16, 10).cast("int").alias("range"),
        *([] if carry is None else [carry]),
    )


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST_EPOCHS) -> DataFrame:
    """sizes (skey, source, source_size: one row a source) with target.

    Water-filling: in the order of cap by weight, a source whose cap is below its
    share of what is left stops at the cap; the others share the rest by weight.
    """
    order = W.orderBy(F.col("source").isNull(), F.col("source"))
    weight = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.col("i") % len(weights) + 1).cast("int"))
    df = (
        sizes.withColumn("i", F.row_number().over(order) - 1)
        .withColumn("w", weight)
        .withColumn("cap", most * F.col("source_size"))
    )
    by_fill = W.orderBy((F.col("cap") / F.col("w")), "i")
    everything = W.partitionBy()
    df = (
        df.withColumn("budget", share * F.sum("source_size").over(everything))
        .withColumn("before", F.sum("cap").over(by_fill.rowsBetween(W.unboundedPreceding, 0)) - F.col("cap"))
        .withColumn("w_left", F.sum("w").over(by_fill.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("capped", F.col("cap") <= F.col("w") * ((F.col("budget") - F.col("before")) / F.col("w_left")))
        .withColumn("cap_sum", F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0)).over(everything))
        .withColumn("w_sum", F.sum(F.when(F.col("capped"), 0).otherwise(F.col("w"))).over(everything))
    )
    free = F.col("w") * ((F.col("budget") - F.col("cap_sum")) / F.col("w_sum"))
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(free)
    return df.select("skey", "source_size", target.alias("target"))


def _ranges(rows: DataFrame, weights, share: float, most: int) -> DataFrame:
    """skey, range, range_start (words of the source before the range), source_size and target; from keyed rows."""
    by_range = rows.groupBy("skey", "range").agg(F.sum("size").alias("range_size"), F.first("source").alias("source"))
    sizes = by_range.groupBy("skey").agg(F.sum("range_size").alias("source_size"), F.first("source").alias("source"))
    earlier = W.partitionBy("skey").orderBy("range").rowsBetween(W.unboundedPreceding, 0)
    return (
        by_range.withColumn("range_start", F.sum("range_size").over(earlier) - F.col("range_size"))
        .join(targets(sizes, weights, share, most), "skey")
        .select("skey", "range", "range_start", "source_size", "target")
    )


def _cut(rows: DataFrame, ranges: DataFrame) -> DataFrame:
    """rows with source_size, target, epochs (whole passes) and part (words of the last, partial pass)."""
    inside = W.partitionBy("skey", "range").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0)
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0))
    start = F.col("range_start") + F.sum("size").over(inside) - F.col("size")
    rest = budget - F.col("epochs") * F.col("source_size")
    return (
        rows.join(ranges, ["skey", "range"])
        .withColumn("start", start)
        .withColumn("epochs", epochs)
        .withColumn("part", F.least(F.col("size"), F.greatest(F.lit(0), rest - F.col("start"))))
    )


def mix(docs: DataFrame, seed: str = SEED, weights=WEIGHTS, share: float = SHARE, most: int = MOST_EPOCHS) -> DataFrame:
    """doc_id, source, size, source_size, target, taken (words of the document that the mix takes)."""
    rows = cut_lineage(keyed(docs, seed))
    taken = (F.col("epochs") * F.col("size") + F.col("part")).cast("long")
    return _cut(rows, _ranges(rows, weights, share, most)).select(
        "doc_id", "source", "size", "source_size", "target", taken.alias("taken")
    )


def cuts(rows: DataFrame, weights, share: float, most: int) -> DataFrame:
    """A row a source: skey, epochs (whole passes), rest (words of the last, partial pass), and the range in which that pass ends with its start.

    Ranges before it go whole into the partial pass and ranges after it not at all. The last range of a source whose rest is 0 is none.
    """
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0))
    begun = F.col("range_start") <= F.col("rest")
    return (
        _ranges(rows, weights, share, most)
        .withColumn("epochs", epochs)
        .withColumn("rest", F.when(F.col("source_size") > 0, budget - epochs * F.col("source_size")).otherwise(F.lit(0)))
        .groupBy("skey")
        .agg(
            F.first("epochs").alias("epochs"),
            F.first("rest").alias("rest"),
            F.max(F.when(begun & (F.col("rest") > 0), F.struct("range", "range_start"))).alias("last"),
        )
        .select("skey", "epochs", "rest", F.coalesce("last.range", F.lit(-1)).alias("last"), F.col("last.range_start").alias("last_start"))
    )


def mixed(docs: DataFrame, seed: str = SEED, weights=WEIGHTS, share: float = SHARE, most: int = MOST_EPOCHS) -> DataFrame:
    """The mix itself, with docs' columns: a row for each whole pass, and one with the first words for a partial pass.

    n_chars, where docs has it, counts the characters of the row's own text. Texts are not shuffled: the table of sources
    goes to the rows, and only the rows of the one range in which a source's partial pass ends are put in order.
    """
    names = docs.columns
    sources = cut_lineage(cuts(keyed(docs, seed, MIXED_DIGITS), weights, share, most))
    if sources.count() <= MOST_SOURCES:
        sources = F.broadcast(sources)
    whole = F.struct(*[F.col(f"`{c}`") for c in names]).alias("doc")
    rows = keyed(docs, seed, MIXED_DIGITS, carry=whole).join(sources, "skey")
    text = F.col("doc.text")
    passes = F.col("epochs") + F.when((F.col("range") < F.col("last")) & (F.col("size") > 0), 1).otherwise(0)
    plain = rows.where(F.col("range") != F.col("last")).select("doc", F.explode(F.array_repeat(text, passes.cast("int"))).alias("pass"))
    order = W.partitionBy("skey").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0)
    start = F.col("last_start") + F.sum("size").over(order) - F.col("size")
    pieces = F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    short = F.array_join(F.slice(pieces, 1, F.col("part").cast("int")), "")
    ends = (
        rows.where(F.col("range") == F.col("last"))
        .withColumn("part", F.least(F.col("size"), F.greatest(F.lit(0), F.col("rest") - start)))
        .select("doc", F.explode(F.concat(
            F.array_repeat(text, F.col("epochs").cast("int")),
            F.when(F.col("part") == 0, F.array().cast("array<string>"))
            .when(F.col("part") == F.col("size"), F.array(text))
            .otherwise(F.array(short)),
        )).alias("pass"))
    )
    return plain.unionByName(ends).select(
        *[
            F.col("pass").alias(c) if c == "text"
            else F.length("pass").cast("long").alias(c) if c == "n_chars"
            else F.col(f"doc.`{c}`").alias(c)
            for c in names
        ]
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = mix(read_table(spark, sf_dir, "documents"))
    return df.select("doc_id", "size", "source_size", "target", "taken")


ORACLE_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, md5(concat('{SEED}:', coalesce(CAST(doc_id AS VARCHAR), ''))) AS k,
         CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM d GROUP BY source
), w AS (
  SELECT *, 2 * source_size AS cap, CASE i % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w,
         1.5::DOUBLE * CAST(sum(source_size) OVER () AS BIGINT) AS budget FROM s
), f AS (
  SELECT *, CAST(sum(cap) OVER (ORDER BY cap / w, i) AS BIGINT) - cap AS before,
         CAST(sum(w) OVER (ORDER BY cap / w DESC, i DESC) AS BIGINT) AS w_left FROM w
), c AS (
  SELECT *, cap <= w * ((budget - before) / w_left) AS capped FROM f
), t AS (
  SELECT source, source_size, CASE WHEN capped THEN CAST(cap AS DOUBLE) ELSE w * ((budget
         - CAST(sum(CASE WHEN capped THEN cap ELSE 0 END) OVER () AS BIGINT))
         / CAST(sum(CASE WHEN capped THEN 0 ELSE w END) OVER () AS BIGINT)) END AS target FROM c
), r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CAST(floor(t.target) AS BIGINT) AS b,
         CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size
              ROWS UNBOUNDED PRECEDING) AS BIGINT) - d.size AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       CAST(CASE WHEN source_size = 0 THEN 0
            ELSE (b // source_size) * size + least(size, greatest(0, b % source_size - start)) END AS BIGINT) AS taken
FROM r
"""
