"""Ranked search over a stored index of postings, and word profiles of all owners in one job."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.stemming import stem as stem_of
from tidemark.operators.stemming import stems
from tidemark.session import settle

#: Items of owners that a task of owner_profiles weighs, about.
TASK_ITEMS = 20_000
#: Texts that a task of index counts, about.
TASK_TEXTS = 5_000
WORD = r"[\p{L}\p{N}_]+"


class Index(NamedTuple):
    """postings: key, kept columns, weight, len, term, tf; held: term, df; stats: one row with docs and mean."""

    postings: DataFrame
    held: DataFrame
    stats: DataFrame


def top_of_groups(df: DataFrame, group: list[str], order: list[Column], tie: str, k: int, slices: int = 32) -> DataFrame:
    """The first k rows of each group with their place: first the k of each slice of a group by a hash of tie, so that no group is ranked whole in one task."""
    part = F.pmod(F.xxhash64(tie), F.lit(slices))
    inner = F.row_number().over(W.partitionBy(*group, "__slice").orderBy(*order, tie))
    some = df.withColumn("__slice", part).withColumn("place", inner).where(F.col("place") <= k).drop("place", "__slice")
    return some.withColumn("place", F.row_number().over(W.partitionBy(*group).orderBy(*order, tie))).where(F.col("place") <= k)


def _words(text: Column, pattern: str = WORD) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(pattern), F.lit(0))


def index(df: DataFrame, key: str, text: Column, weight: Column | None = None, keep: list[str] | None = None, stem: bool = True) -> Index:
    """Postings of all texts, written to the shared folder.

    Words are runs of letters, digits and underscores in lower case. A null text
    is a text without words; a null weight is one. Rows that share a key are one text each if
    they differ in length or weight, else their counts add up: give unique keys.
    """
    # words are stemmed and dealt out by key as a text's array, so that neither stemming nor counting moves a word on its own
    n = df.count()
    tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // TASK_TEXTS)
    words = stems(_words(text)) if stem else _words(text)
    w = df.select(F.col(key), *(keep or []), F.coalesce(weight if weight is not None else F.lit(1.0), F.lit(1.0)).cast("double").alias("weight"), words.alias("__w"))
    by = [key, *(keep or []), "weight", "len"]
    w = w.repartition(tasks, key).withColumn("len", F.size("__w"))
    tf = w.select(*by, F.explode("__w").alias("term")).groupBy(*by, "term").agg(F.count("*").alias("tf"))
    tf = settle(tf)
    mean = F.coalesce(F.sum("tf"), F.lit(0)) / n if n else F.lit(None).cast("double")
    stats = tf.agg(F.lit(n).cast("long").alias("docs"), mean.alias("mean"))
    return Index(tf, settle(tf.groupBy("term").agg(F.count("*").alias("df"))), settle(stats))


def search(index: Index, key: str, queries: DataFrame, k: int = 5, where: Column | None = None, stem: bool = True, most: int | None = 8, least: int = 3, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """The k best texts for every query (query_id, query): query_id, key, score, place.

    A text scores its weight times BM25 over the query's first `most` words (all
    where None), any of which may stand in it; a word that the query repeats counts again. A word
    in half of the texts or more still counts, with 1e-6. Queries of fewer than
    `least` characters find nothing. where filters texts, not the statistics.
    Ties by key. stem must be as it was for the index.
    """
    q = queries.where(F.length(F.trim("query")) >= least)
    words = _words(F.col("query"))
    q = q.select("query_id", F.explode(words if most is None else F.slice(words, 1, most)).alias("term"))
    if stem:
        q = q.withColumn("term", stem_of(F.col("term")))
    q = q.groupBy("query_id", "term").agg(F.count("*").alias("times"))
    p = index.postings if where is None else index.postings.where(where)
    q = q.join(index.held, "term")
    idf = F.ln((F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    idf = F.when(idf > 0, idf).otherwise(1e-6)
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.try_divide("len", "mean")))
    found = p.join(q, "term").join(F.broadcast(index.stats)).groupBy("query_id", key, "weight").agg(F.sum(part * F.col("times")).alias("s"))
    scored = found.select("query_id", key, F.round(F.col("weight") * F.col("s"), 9).alias("score"))
    return top_of_groups(scored, ["query_id"], [F.desc("score")], key, k)


def recent_items(activity: DataFrame, actions: list[str], most: int = 100) -> DataFrame:
    """owner, item: the items of each owner's newest such actions, `most` of them; activity: owner, item, action, ts. Ties by item."""
    last = activity.where(F.col("action").isin(actions) & F.col("owner").isNotNull() & F.col("item").isNotNull()).groupBy("owner", "item").agg(F.max("ts").alias("ts"))
    return top_of_groups(last, ["owner"], [F.desc("ts")], "item", most).select("owner", "item")


def grams(text: Column, stop: list[str]) -> Column:
    """Words of two characters or more that are no stop words, and pairs of those that then stand side by side."""
    w = F.filter(_words(text, r"[\p{L}\p{N}_]{2,}"), lambda x: ~x.isin(stop))
    n = F.greatest(F.size(w) - 1, F.lit(0))
    return F.concat(w, F.zip_with(F.slice(w, F.lit(1), n), F.slice(w, F.lit(2), n), lambda a, b: F.concat_ws(" ", a, b)))


def owner_profiles(read: DataFrame, items: DataFrame, stop: list[str], features: int = 200, top: int = 60, least: int = 5) -> DataFrame:
    """Word profiles of all owners at once: owner, term, w, place.

    read: owner, item; items: item, text (item unique). An owner's features are
    the most frequent grams of the items read; each item is weighed by (1 + ln
    count) times the smooth inverse frequency among the owner's items and scaled
    to length one; a profile is the mean over items, its `top` largest weights.
    Owners with fewer than `least` known items have none. Items without words
    count as items. Weights equal in nine decimals are tied, ties by term.

    Grams are counted once an item, however many owners read it.
    """
    known = read.select("owner", "item").distinct().join(items.select("item").distinct(), "item", "left_semi")
    known = settle(known.withColumn("n", F.count("*").over(W.partitionBy("owner"))).where(F.col("n") >= least))
    tasks = max(int(known.sparkSession.conf.get("spark.sql.shuffle.partitions")), known.count() // TASK_ITEMS)
    # items are dealt out before they become grams, and an owner's grams once: all that follows is by owner
    counts = items.repartition("item").select("item", F.explode(grams(F.col("text"), stop)).alias("term")).groupBy("item", "term").agg(F.count("*").alias("tf"))
    t = known.join(counts, "item").repartition(tasks, "owner")
    own = W.partitionBy("owner", "term")
    t = t.withColumn("total", F.sum("tf").over(own)).withColumn("df", F.count("*").over(own))
    w = t.withColumn("place", F.dense_rank().over(W.partitionBy("owner").orderBy(F.desc("total"), "term"))).where(F.col("place") <= features)
    w = w.withColumn("x", (1 + F.ln("tf")) * (F.ln((1 + F.col("n")) / (1 + F.col("df"))) + 1))
    w = w.withColumn("x", F.col("x") / F.sqrt(F.sum(F.col("x") * F.col("x")).over(W.partitionBy("owner", "item"))))
    mean = w.groupBy("owner", "term", "n").agg(F.sum("x").alias("s")).select("owner", "term", (F.col("s") / F.col("n")).alias("w"))
    return top_of_groups(mean, ["owner"], [F.desc(F.round("w", 9))], "term", top)
