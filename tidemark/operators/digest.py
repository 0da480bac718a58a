"""Groupings in order, profiles, crisis patterns, portfolio and signal summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators import series as S
from tidemark.operators.kpis import top_per_group
from tidemark.operators.text import hits_in, words
from tidemark.session import settle


def label_hits(df: DataFrame, key: str, text: Column, patterns: dict[str, tuple[list[str], float]]) -> DataFrame:
    """key, label, hits and weighted hits of every pattern (terms, weight) that has a hit."""
    each = F.array(*[F.struct(F.lit(n).alias("label"), hits_in(F.col("__low"), t).alias("hits"), F.lit(float(w)).alias("w")) for n, (t, w) in patterns.items()])
    low = df.select(key, F.lower(text).alias("__low"))  # a step of its own, or each term lowers the text anew
    x = low.select(key, F.explode(F.filter(each, lambda p: p["hits"] > 0)).alias("x"))
    return x.select(key, "x.label", "x.hits", (F.col("x.hits") * F.col("x.w")).alias("weighted"))


def top_labels(found: DataFrame, key: str, k: int) -> DataFrame:
    return top_per_group(found, key, [F.desc("hits"), "label"], k)


def crisis_ranking(found: DataFrame, rows: DataFrame, key: str, region: str, top: int) -> DataFrame:
    """Per pattern: score = min(10, .4 sum of weighted hits), texts, and how many regions; the top patterns."""
    j = found.join(rows.select(key, region), key)
    agg = j.groupBy("label").agg(F.least(F.lit(10.0), 0.4 * F.sum("weighted")).alias("score"), F.count("*").alias("n"), F.count_distinct(region).alias("regions"))
    return agg.orderBy(F.desc("score"), F.desc("n"), "label").limit(top)


def extract_names(df: DataFrame, key: str, text: Column, names: list[tuple[str, str]], default: str = "XX") -> DataFrame:
    """key, code: the longest name (name, code) that the text holds, names being a small fixed list."""
    ordered = sorted(names, key=lambda x: (-len(x[0]), x[0]))
    low = F.lower(text)
    found = F.filter(F.array(*[F.struct(F.lit(n.lower()).alias("n"), F.lit(c).alias("c")) for n, c in ordered]), lambda x: F.contains(low, x["n"]))
    return df.select(key, F.coalesce(F.try_element_at(found, F.lit(1))["c"], F.lit(default)).alias("code"))


def title_groups(df: DataFrame, key: str, title: Column, block: str, least: float) -> DataFrame:
    """Pairs of texts of one block whose titles' word sets (four letters or more, the first ten in order) reach a Jaccard similarity.

    Texts with equal sets pair with the first of them only (a star), and only the
    first of each set pairs with others. Exact by prefixes: with the words of a
    set in order of frequency, rarest first, two sets that reach the similarity
    share one of the first n - ceil(least * n) + 1.
    """
    words = F.slice(F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(title), F.lit("[a-z]{4,}"), F.lit(0)))), 1, 10)
    rows = df.select(key, F.col(block).alias("block"), words.alias("w")).where(F.size("w") > 0)
    rows = settle(rows)
    first = settle(rows.groupBy("block", "w").agg(F.min(key).alias("a")))
    star = rows.join(first, ["block", "w"]).where(F.col("a") < F.col(key)).select("a", F.col(key).alias("b"), F.lit(1.0).alias("jaccard"))
    each = first.select("a", "block", F.explode("w").alias("term"))
    each = each.join(each.groupBy("term").agg(F.count("*").alias("df")), "term")
    # a set is at most ten words; pairs are judged where they meet, by the first word that their prefixes share, so none of them travels
    sets = each.groupBy("a", "block").agg(F.array_sort(F.collect_list(F.struct("df", "term"))).alias("s")).select("a", "block", F.transform("s", lambda x: x["term"]).alias("w"))
    n = F.size("w")
    sets = settle(sets.withColumn("p", F.slice("w", F.lit(1), (n - F.ceil(n * least - 1e-9) + 1).cast("int"))))
    one = sets.select("block", F.explode("p").alias("term"), "a", "w", "p")
    other = sets.select("block", F.explode("p").alias("term"), F.col("a").alias("b"), F.col("w").alias("wb"), F.col("p").alias("pb"))
    near = (F.col("a") < F.col("b")) & (F.least(n, F.size("wb")) >= least * F.greatest(n, F.size("wb")) - 1e-9)
    both = one.join(other, ["block", "term"]).where(near & (F.try_element_at(F.array_intersect("p", "pb"), F.lit(1)) == F.col("term")))
    j = F.size(F.array_intersect("w", "wb")) / F.size(F.array_union("w", "wb"))
    return both.select("a", "b", j.alias("jaccard")).where(F.col("jaccard") >= least).union(star)


def leader_groups(df: DataFrame, keys: list[str], hours: float) -> DataFrame:
    """Rows (id, ts, severity) of equal keys grouped in time order: a row within the hours of the group's first joins it."""
    from tidemark.operators.rules import date_clusters

    groups = date_clusters(df, keys, "ts", hours / 24).groupBy(*keys, "cluster").agg(
        F.min_by("id", F.struct("ts", "id")).alias("leader"), F.min("ts").alias("first"), F.count("*").alias("n"), F.max("severity").alias("top")
    )
    return groups.withColumn("severity", F.least(F.lit(10.0), F.col("top") + 0.5 * F.ln("n"))).drop("top", "cluster")


def _dealt(df: DataFrame, owner: str, key: str, text: Column) -> DataFrame:
    """owner, key, t: texts dealt out by key before they become words, so that counting moves no words."""
    return df.where(F.col(key).isNotNull()).select(owner, key, text.alias("t")).repartition(key)


def profiles(df: DataFrame, owner: str, key: str, text: Column, top: int) -> DataFrame:
    """Per owner the words of highest mean TF-IDF over the owner's texts: owner, term, w."""
    t = _dealt(df, owner, key, text).select(owner, key, F.explode(words("t", 3)).alias("term")).groupBy(owner, key, "term").agg(F.count("*").alias("tf"))
    n = df.groupBy(owner).agg(F.count("*").alias("docs"))
    t = t.where(F.col(owner).isNotNull()).withColumn("df", F.count("*").over(W.partitionBy(owner, "term")))
    w = t.join(n, owner).withColumn("x", (1 + F.ln("tf")) * (F.ln((1 + F.col("docs")) / (1 + F.col("df"))) + 1))
    w = w.select(owner, key, "term", "docs", "x")
    norm = F.sqrt(F.sum(F.col("x") * F.col("x")).over(W.partitionBy(key)))
    mean = w.withColumn("x", F.col("x") / norm).groupBy(owner, "term", "docs").agg(F.sum("x").alias("s"))
    scored = mean.select(owner, "term", F.round(F.col("s") / F.col("docs"), 9).alias("w"))
    return top_per_group(scored, owner, [F.desc("w"), "term"], top).drop("place")


def profile_scores(df: DataFrame, owner: str, key: str, text: Column, profile: DataFrame) -> DataFrame:
    """Each text under its owner's profile: sum of the words' weights over log(1 + words), at most one."""
    t = _dealt(df, owner, key, text).select(owner, key, F.size(words("t")).alias("n"), F.explode(F.array_distinct(words("t", 3))).alias("term"))
    hit = t.join(settle(profile), [owner, "term"]).groupBy(key, "n").agg(F.sum("w").alias("s"))
    return hit.select(key, F.least(F.lit(1.0), F.col("s") / F.log1p("n")).alias("score"))


def technical_score(bars: DataFrame) -> DataFrame:
    """Per symbol at its newest bar: mean of the votes of RSI, moving averages, bands and %K, within one."""
    df = S.stochastic(S.bollinger(S.sma(S.sma(S.rsi(bars), 12), 26)))
    votes = F.array(
        F.when(F.col("rsi") < 30, 1.0).when(F.col("rsi") > 70, -1.0).when(F.col("rsi").isNotNull(), 0.0),
        F.when(F.col("sma12") > F.col("sma26"), 1.0).when(F.col("sma12") < F.col("sma26"), -1.0),
        F.when(F.col("bb_pct") < 0.2, 1.0).when(F.col("bb_pct") > 0.8, -1.0).when(F.col("bb_pct").isNotNull(), 0.0),
        F.when(F.col("stoch_k") < 20, 1.0).when(F.col("stoch_k") > 80, -1.0).when(F.col("stoch_k").isNotNull(), 0.0),
    )
    given = F.filter(votes, lambda v: v.isNotNull())
    mean = F.aggregate(given, F.lit(0.0), lambda a, x: a + x) / F.greatest(F.size(given), F.lit(1))
    last = df.withColumn("score", mean).groupBy("symbol").agg(F.max_by(F.struct("date", "score"), "date").alias("x"))
    return last.select("symbol", "x.date", "x.score")


def stress(portfolio: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Loss of every portfolio (owner, beta, value) under every scenario (scenario, shock): value * beta * shock / 100; scenarios are few."""
    return portfolio.join(F.broadcast(scenarios)).select("owner", "scenario", (F.col("value") * F.col("beta") * F.col("shock") / 100).alias("loss"))


def undirected_neighbours(edges: DataFrame, wanted: DataFrame) -> DataFrame:
    """Neighbours in either direction by two equi-joins instead of one OR: node, other, weight."""
    a = wanted.join(edges, F.col("node") == F.col("src")).select("node", F.col("tgt").alias("other"), "weight")
    b = wanted.join(edges, F.col("node") == F.col("tgt")).select("node", F.col("src").alias("other"), "weight")
    return a.unionByName(b)


def movers(quotes: DataFrame, top: int) -> DataFrame:
    return quotes.where("price > 0").orderBy(F.desc(F.round(F.abs("change_pct"), 9)), "symbol").limit(top)


def merge_clusters(df: DataFrame, cluster: str) -> DataFrame:
    """One row a cluster: its most severe row's id, severity + .4 ln(n), rows, and distinct sources."""
    agg = df.groupBy(cluster).agg(
        F.max_by("id", F.struct("severity", "id")).alias("id"), F.max("severity").alias("top"), F.count("*").alias("n"), F.count_distinct("source").alias("sources")
    )
    return agg.withColumn("severity", F.least(F.lit(10.0), F.col("top") + 0.4 * F.ln("n"))).drop("top")


def upsert_partial(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Old rows with the new values of some columns, and new rows that old did not have."""
    n = new.select(F.col(key).alias("__k"), *[F.col(c).alias(f"__{c}") for c in columns])
    both = old.join(n, F.col(key) == F.col("__k"), "full_outer")
    return both.select(
        F.coalesce(key, "__k").alias(key), *[(F.coalesce(f"__{c}", c) if c in columns else F.col(c)).alias(c) for c in old.columns if c != key]
    )


def union_first(parts: list[DataFrame], key: str) -> DataFrame:
    """Union in which the first part that has a key wins."""
    every = None
    for i, p in enumerate(parts):
        p = p.withColumn("__o", F.lit(i))
        every = p if every is None else every.unionByName(p, allowMissingColumns=True)
    place = F.row_number().over(W.partitionBy(key).orderBy("__o"))
    return every.withColumn("__p", place).where("__p = 1").drop("__o", "__p")
