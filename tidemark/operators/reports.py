"""Report aggregates, rankings and set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def share(part: Column) -> Column:
    """The share of rows for which part holds; null for no rows."""
    return F.try_divide(F.sum(F.when(part, 1).otherwise(0)), F.count("*"))


def top_count(df: DataFrame, key: str, k: int) -> DataFrame:
    """The k most frequent values of a column."""
    return df.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key).limit(k)


def activity_levels(df: DataFrame, ts: str, steps: dict[int, str], least: str) -> DataFrame:
    """Per user the number of rows, the last time and a level by number (steps: from this number on)."""
    level = F.lit(least)
    for n, name in sorted(steps.items()):
        level = F.when(F.col("n") >= n, name).otherwise(level)
    return df.groupBy("user_id").agg(F.count("*").alias("n"), F.max(ts).alias("last_active")).withColumn("level", level)


def graph_stats(edges: DataFrame) -> DataFrame:
    """metric, name, value: nodes and edges in all, and nodes by the first letter of their id (their type)."""
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("tgt")).distinct()
    both = nodes.agg(F.count("*").alias("value")).select(F.lit("nodes").alias("metric"), F.lit("all").alias("name"), "value")
    links = edges.agg(F.count("*").alias("value")).select(F.lit("edges").alias("metric"), F.lit("all").alias("name"), "value")
    kinds = nodes.groupBy(F.substring("node", 1, 1).alias("name")).agg(F.count("*").alias("value"))
    return both.union(links).union(kinds.select(F.lit("type").alias("metric"), "name", "value"))


def signal_stats(df: DataFrame, keys: list[str], change: str) -> DataFrame:
    """Number of signals, wins, losses, win rate, and mean, best and worst change per key."""
    win = F.col(change) > 0
    return df.groupBy(*keys).agg(
        F.count(change).alias("total"), F.count(F.when(win, 1)).alias("wins"), F.count(F.when(F.col(change) <= 0, 1)).alias("losses"),
        F.try_divide(F.count(F.when(win, 1)), F.count(change)).alias("win_rate"), F.avg(change).alias("mean"), F.max(change).alias("best"), F.min(change).alias("worst"),
    )


def accuracy_by_week(df: DataFrame, guess: Column, actual: Column, week: Column, last: int) -> DataFrame:
    """Share of right guesses in each of the last weeks that have any."""
    scored = df.where(guess.isNotNull() & actual.isNotNull()).groupBy(week.alias("week")).agg(F.count("*").alias("n"), share(guess == actual).alias("score"))
    return scored.orderBy(F.desc("week")).limit(last)


def ranked_sides(trades: DataFrame, big: float, k: int) -> DataFrame:
    """list, symbol, n: the k symbols most bought, most sold, and most often traded beyond a value."""
    parts = [("buys", F.col("side") == "BUY"), ("sells", F.col("side") == "SELL"), ("big", F.col("qty") * F.col("price") > big)]
    out = [top_count(trades.where(w), "symbol", k).select(F.lit(name).alias("list"), "symbol", "n") for name, w in parts]
    return out[0].union(out[1]).union(out[2])


def achievements(stats: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """bot, badge: the badges whose rule holds for a row of stats."""
    earned = F.array(*[F.when(rule, name) for name, rule in rules.items()])
    return stats.select("bot", F.explode(F.array_compact(earned)).alias("badge"))


def stale_topics(df: DataFrame, topic: str, ts: str, hours: int, least: int = 5, grown: int = 10) -> DataFrame:
    """Topics of at least so many rows that were absent before the last hours or have grown by so many since."""
    cut = F.lit(df.agg(F.max(ts)).first()[0]) - F.expr(f"INTERVAL {hours} HOURS")
    n, before = F.count("*").alias("n"), F.count(F.when(F.col(ts) <= cut, 1)).alias("before")
    return df.groupBy(topic).agg(n, before).where((F.col("n") >= least) & ((F.col("before") == 0) | (F.col("n") - F.col("before") >= grown)))


def concept_terms(df: DataFrame, text: str, query: list[str], least: int, k: int) -> DataFrame:
    """The k most frequent words and pairs of words (of more than least letters) in texts that hold a word of the query."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0))
    found = df.select(words.alias("w")).where(F.arrays_overlap("w", F.lit(query)))
    long = found.select(F.filter("w", lambda x: F.length(x) > least).alias("w"))
    pairs = F.zip_with("w", F.slice("w", 2, F.greatest(F.size("w"), F.lit(1))), lambda a, b: F.concat_ws(" ", a, b))
    pairs = F.slice(pairs, 1, F.greatest(F.size("w") - 1, F.lit(0)))
    return top_count(long.select(F.explode(F.concat("w", pairs)).alias("term")), "term", k)


def heat_ranked(df: DataFrame, heat: str, k: int) -> DataFrame:
    """The k rows with the greatest severity times heat; severity stands for a missing heat."""
    return df.withColumn("score", F.col("severity") * F.coalesce(heat, "severity")).orderBy(F.desc("score"), "id").limit(k)


def first_patterns(df: DataFrame, key: str, text: Column, patterns: dict[str, list[str]], per: int, total: int) -> DataFrame:
    """Each row's first pattern that it hits; per pattern its so many strongest rows, and so many in all, in the patterns' order."""
    names = list(patterns)
    hit = [F.when(F.arrays_overlap(F.split(F.lower(text), r"\W+"), F.lit(patterns[p])), F.lit(i)) for i, p in enumerate(names)]
    df = df.withColumn("at", F.coalesce(*hit, F.lit(None).cast("int"))).where("at IS NOT NULL")
    best = W.partitionBy("at").orderBy(F.desc("severity"), key)
    few = df.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= per)
    return few.withColumn("pattern", F.element_at(F.lit(names), F.col("at") + 1)).orderBy("at", "rank").limit(total)


def best_by_date(df: DataFrame, score: Column, date: str, k: int) -> DataFrame:
    """The k rows of the highest score, numbered by date, newest first."""
    best = df.withColumn("score", score).orderBy(F.desc("score"), "id").limit(k)
    return best.withColumn("place", F.row_number().over(W.orderBy(F.desc(date), "id")))  # k rows


def strongest(df: DataFrame, value: str, order: list[str], k: int) -> DataFrame:
    """The k rows of the greatest absolute value."""
    return df.orderBy(F.desc(F.abs(value)), *order).limit(k)


def word_overlap(a: Column, b: Column) -> tuple[Column, Column]:
    """How many words two arrays share, and how many they have together."""
    return F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
