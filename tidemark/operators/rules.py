"""Rule-based text, news and signal operators; word lists are parameters (functions/lexicons.py holds the usual ones)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.scalars import clamp
from tidemark.operators import text as T
from tidemark.operators.leaders import with_leader


def tone(df: DataFrame, text: Column, positive: list[str], negative: list[str], uncertain: list[str], stress: list[str]) -> DataFrame:
    """score, tone, intensity, uncertainty and market_stress from the substrings that a text holds."""
    df = df.withColumn("__p", T.hits(text, positive)).withColumn("__n", T.hits(text, negative))
    raw = (F.col("__p") - F.col("__n")) / F.greatest(F.col("__p") + F.col("__n"), F.lit(1)) * 0.8
    df = df.withColumn("score", F.round(clamp(raw, -1.0, 1.0), 3))
    df = df.withColumn("uncertainty", F.round(F.least(F.lit(1.0), T.hits(text, uncertain) / 8), 3))
    df = df.withColumn("market_stress", F.round(F.least(F.lit(1.0), T.hits(text, stress) / 5), 3))
    size = F.abs("score")
    df = df.withColumn("intensity", F.when(size > 0.5, "High").when(size > 0.2, "Medium").otherwise("Low"))
    return df.withColumn("tone", F.when(F.col("score") < -0.15, "Negative").when(F.col("score") > 0.15, "Positive").otherwise("Neutral")).drop("__p", "__n")


def class_probabilities(df: DataFrame, score: str) -> DataFrame:
    """p_positive, p_negative and p_neutral (adding up to one) of a score within -1 and 1."""
    up, down = F.greatest(F.col(score), F.lit(0.0)), F.greatest(-F.col(score), F.lit(0.0))
    return df.withColumn("p_positive", up).withColumn("p_negative", down).withColumn("p_neutral", 1 - up - down)


def best_band(df: DataFrame, text: Column, bands: dict[str, list[str]], default: str) -> DataFrame:
    """band: the one with most substrings in the text, the first of equal ones, or the default."""
    return T.classify(df, text, bands, {}, default).withColumnRenamed("label", "band").drop("score")


def first_topic(text: Column, topics: dict[str, list[str]], default: str) -> Column:
    """The first topic of which the text holds a substring."""
    return F.coalesce(*[F.when(T.hits(text, terms) > 0, name) for name, terms in topics.items()], F.lit(default))


def crises(df: DataFrame, key: str, text: Column, severity: Column, patterns: dict[str, tuple[float, list[str]]]) -> DataFrame:
    """key, pattern, hits, confidence (hits by weight, five being full) and level by severity, for each pattern that a text hits."""
    # the text is lowered in a step of its own: inside the generator each term would lower it anew
    low = df.select(key, severity.alias("severity"), F.lower(text).alias("__low"))
    found = F.array(*[F.struct(F.lit(n).alias("pattern"), T.hits_in(F.col("__low"), terms).alias("hits"), F.lit(w).alias("w")) for n, (w, terms) in patterns.items()])
    level = F.when(F.col("severity") >= 7.5, "critical").when(F.col("severity") >= 5.5, "high").otherwise("watch")
    rows = low.select(key, "severity", F.explode(found).alias("f")).where("f.hits > 0")
    return rows.select(key, "f.pattern", "f.hits", F.least(F.lit(1.0), F.col("f.hits") * F.col("f.w") / 5).alias("confidence"), level.alias("level"))


def graph_entities(df: DataFrame, key: str, text: Column, kinds: dict[str, list[str]], early: int = 100) -> DataFrame:
    """key, kind, entity, count and salience: share of words in percent, and .3 more for one in the first characters."""
    low = F.lower(text)
    n = F.greatest(F.size(F.split(F.trim(low), r"\s+")), F.lit(1))
    rows = [
        F.struct(F.lit(kind).alias("kind"), F.lit(e).alias("entity"), F.regexp_count(low, F.lit(rf"(?<!\w){re.escape(e)}(?!\w)")).alias("count"),
                 F.contains(F.substring(low, 1, early), F.lit(e)).alias("early"))
        for kind, names in kinds.items() for e in names
    ]
    found = df.select(key, n.alias("n"), F.explode(F.array(*rows)).alias("e")).where("e.count > 0")
    salience = F.least(F.lit(1.0), F.col("e.count") / F.col("n") * 100 / 10 + F.when(F.col("e.early"), 0.3).otherwise(0.0))
    return found.select(key, "e.kind", "e.entity", "e.count", salience.alias("salience"))


def asset_relevance(category_weight: Column, severity: Column, drivers: Column, direct: Column) -> Column:
    """.5 of the category's weight, .2 of the severity's tenth, .15 a driver up to .3, .2 for a direct mention; 1 at most."""
    parts = 0.5 * category_weight + 0.2 * severity / 10 + F.least(F.lit(0.3), 0.15 * drivers) + F.when(direct, 0.2).otherwise(0.0)
    return F.least(F.lit(1.0), parts)


def date_clusters(df: DataFrame, keys: list[str], ts: str, days: float) -> DataFrame:
    """cluster: the time of the row that opened it; a row more than the days after its cluster's first opens the next."""
    out = with_leader(df, keys, ts, int(days * 86_400_000_000), "__lead")
    return out.withColumn("cluster", F.timestamp_micros("__lead")).drop("__lead")


def news_edges(df: DataFrame, cues: list[str], hours: float = 2) -> DataFrame:
    """src, tgt, kind, weight between one category's consecutive rows: causal (same country, a cue in either text) else temporal (close in time)."""
    by = W.partitionBy("category").orderBy("ts", "id")
    both = df.select("category", F.col("id").alias("tgt"), "ts", "country", "text", F.lag("id").over(by).alias("src"), F.lag("ts").over(by).alias("t0"),
                     F.lag("country").over(by).alias("c0"), F.lag("text").over(by).alias("x0")).where("src IS NOT NULL")
    causal = (F.col("country") == F.col("c0")) & ((T.hits(F.col("text"), cues) > 0) | (T.hits(F.col("x0"), cues) > 0))
    close = F.col("ts") <= F.col("t0") + F.expr(f"INTERVAL {int(hours * 60)} MINUTES")
    kind = F.when(causal, "causal").when(close, "temporal")
    out = both.select("src", "tgt", kind.alias("kind"), F.when(causal, 0.55).otherwise(0.4).alias("weight"))
    return out.where("kind IS NOT NULL")


def sentiment_signal(df: DataFrame, weights: dict[str, float], least: float = 0.2) -> DataFrame:
    """strength: weighted sum of columns within -1 and 1; action beyond least either way, held back where RSI contradicts (over 75, under 25)."""
    total = sum((w * F.coalesce(F.col(c), F.lit(0.0)) for c, w in weights.items()), F.lit(0.0))
    df = df.withColumn("strength", clamp(total, -1.0, 1.0))
    buy = (F.col("strength") > least) & (F.coalesce("rsi", F.lit(50.0)) <= 75)
    sell = (F.col("strength") < -least) & (F.coalesce("rsi", F.lit(50.0)) >= 25)
    return df.withColumn("action", F.when(buy, "BUY").when(sell, "SELL").otherwise("HOLD"))


def ensemble(votes: list[Column], strengths: list[Column], least: float = 0.5, boost: float = 1.25) -> tuple[Column, Column]:
    """The action that at least the share of votes give (else HOLD), and its mean strength, higher where all agree; 1 at most."""
    n = len(votes)
    count = lambda a: sum(((v == a).cast("int") for v in votes), F.lit(0))
    action = F.when(count("BUY") / n > least, "BUY").when(count("SELL") / n > least, "SELL").otherwise("HOLD")
    agreeing = sum((F.when(v == action, s).otherwise(0.0) for v, s in zip(votes, strengths, strict=True)), F.lit(0.0))
    number = sum(((v == action).cast("int") for v in votes), F.lit(0))
    mean = F.try_divide(agreeing, number) * F.when(number == n, boost).otherwise(1.0)
    return action, F.when(action == "HOLD", 0.0).otherwise(F.least(F.lit(1.0), mean))


def backtest_metrics(df: DataFrame, periods: int = 252) -> DataFrame:
    """Per symbol from nav and ret (no risk-free rate): total and annual return, Sharpe, Sortino, drawdown and Calmar."""
    n, ret = F.count("ret"), F.col("ret")
    peak = F.max("nav").over(W.partitionBy("symbol").orderBy("date").rowsBetween(W.unboundedPreceding, 0))
    down = F.sqrt(F.try_divide(F.sum(F.when(ret < 0, ret * ret)), F.greatest(F.count(F.when(ret < 0, 1)), F.lit(1))))
    agg = df.withColumn("dd", (peak - F.col("nav")) / peak).groupBy("symbol").agg(
        F.max_by("nav", "date").alias("last"), n.alias("n"), F.avg(ret).alias("m"), F.stddev_samp(ret).alias("s"), F.coalesce(down, F.lit(0.0)).alias("d"), F.max("dd").alias("dd")
    )
    year = periods**0.5
    annual = (F.pow(F.col("last") / 100, periods / F.col("n")) - 1) * 100
    return agg.select(
        "symbol", (F.col("last") - 100).alias("total_return"), annual.alias("annual_return"),
        (F.col("m") * periods / (F.col("s") * year + 1e-9)).alias("sharpe"), (F.col("m") * periods / (F.col("d") * year + 1e-9)).alias("sortino"),
        (F.col("dd") * 100).alias("max_drawdown"), (annual / (F.col("dd") * 100 + 1e-9)).alias("calmar"),
    )


def node_risks(links: DataFrame) -> DataFrame:
    """node, risk: the greatest severity by salience of the events that name it (links: node, severity, salience); 10 at most."""
    return links.groupBy("node").agg(F.least(F.lit(10.0), F.max(F.col("severity") * F.col("salience"))).alias("risk"))


def prune(edges: DataFrame, least: float, most_nodes: int) -> DataFrame:
    """Edges of the least weight between the nodes of the highest degree; of repeated (src, tgt) the heaviest."""
    once = edges.groupBy("src", "tgt").agg(F.max("weight").alias("weight"), F.max("n").alias("n")).where(F.col("weight") >= least)
    ends = once.select(F.col("src").alias("node"), "weight").union(once.select("tgt", "weight"))
    kept = ends.groupBy("node").agg(F.sum("weight").alias("degree")).orderBy(F.desc("degree"), "node").limit(most_nodes).select("node")
    a = once.join(kept.withColumnRenamed("node", "src"), "src", "left_semi")
    return a.join(kept.withColumnRenamed("node", "tgt"), "tgt", "left_semi").select("src", "tgt", "weight", "n")


def grid_clusters(points: DataFrame, degrees: float, least: int = 3) -> DataFrame:
    """Clusters of points (id, lat, lon, category, severity) by grid cell: size, centre, commonest category and strongest point."""
    cell = [F.floor(F.col(c) / degrees).alias(f"{c}_cell") for c in ("lat", "lon")]
    kinds = points.groupBy(*cell, "category").agg(F.count("*").alias("n"), F.sum("lat").alias("y"), F.sum("lon").alias("x"), F.max(F.struct("severity", "id")).alias("top"))
    out = kinds.groupBy("lat_cell", "lon_cell").agg(
        F.sum("n").alias("members"), (F.sum("y") / F.sum("n")).alias("lat"), (F.sum("x") / F.sum("n")).alias("lon"),
        F.max(F.struct("n", "category")).alias("c"), F.max("top").alias("t"),
    )
    return out.where(F.col("members") >= least).select("lat_cell", "lon_cell", "members", "lat", "lon", F.col("c.category").alias("category"), F.col("t.id").alias("top_id"))


def node_search(nodes: DataFrame, text: str, k: int) -> DataFrame:
    """The k nodes (node, label, n) whose label contains the text, in any case, those of most sources first."""
    return nodes.where(F.contains(F.lower("label"), F.lit(text.lower()))).orderBy(F.desc("n"), "node").limit(k)


def asset_pressure(seeds: DataFrame, effects: DataFrame) -> DataFrame:
    """asset, pressure: sum of sign by strength over the seeds (node, strength) that touch it (effects: node, asset, sign), within -1 and 1."""
    df = seeds.join(effects, "node").groupBy("asset").agg(F.sum(F.col("sign") * F.col("strength")).alias("pressure"))
    return df.withColumn("pressure", clamp(F.col("pressure"), -1.0, 1.0))


def similar_to(weights: DataFrame, key: str, seeds: DataFrame, least: float, k: int) -> DataFrame:
    """seed, key, similarity: per seed the k rows of the highest cosine of term weights (key, term, weight; unit vectors), least or more.

    The seeds are a stated set and meet all rows, block by block (`text.similar_to`). Cosines that agree in nine decimals
    are equal and stand by key, so the order in which a sum was added up decides nothing.
    """
    return T.similar_to(weights, key, "weight", seeds, least, k)


def explain(df: DataFrame, contributions: dict[str, Column], strength: Column) -> DataFrame:
    """rule, contribution of every rule that holds, and the row's confidence and label (needs a column id)."""
    parts = F.array_compact(F.array(*[F.when(c > 0, F.struct(F.lit(n).alias("rule"), c.cast("double").alias("contribution"))) for n, c in contributions.items()]))
    total = F.aggregate("parts", F.lit(0.0), lambda a, x: a + x["contribution"])
    confidence = F.least(F.lit(100.0), 0.6 * total + 40 * strength)
    label = F.when(F.col("confidence") >= 70, "strong").when(F.col("confidence") >= 40, "moderate").otherwise("weak")
    rows = df.withColumn("parts", parts).withColumn("confidence", confidence).withColumn("label", label)
    return rows.select("id", "confidence", "label", F.explode("parts").alias("p")).select("id", "confidence", "label", "p.rule", "p.contribution")


def autopsy(trades: DataFrame) -> DataFrame:
    """outcome (pnl beyond half a percent either way), grade A to D of the set-up (planned reward by risk) and a lesson."""
    outcome = F.when(F.col("pnl") > 0.5, "win").when(F.col("pnl") < -0.5, "loss").otherwise("flat")
    ratio = F.col("reward_risk")
    grade = F.when(ratio >= 3, "A").when(ratio >= 2, "B").when(ratio >= 1, "C").otherwise("D")
    df = trades.withColumn("outcome", outcome).withColumn("grade", grade)
    lesson = F.when((F.col("outcome") == "win") & F.col("grade").isin("A", "B"), "good plan paid").when(F.col("outcome") == "win", "lucky")
    return df.withColumn("lesson", lesson.when((F.col("outcome") == "loss") & F.col("grade").isin("C", "D"), "poor plan").when(F.col("outcome") == "loss", "good plan failed").otherwise("no edge"))
