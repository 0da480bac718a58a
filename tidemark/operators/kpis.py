"""Filters, aggregates and rankings over events and activity; all take an explicit as_of (default: the newest row)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def now_of(df: DataFrame, ts: str = "ts", as_of: dt.datetime | None = None) -> Column:
    """as_of as a column: the given time, or the newest of the table by a scalar subquery."""
    return F.lit(as_of) if as_of is not None else df.select(F.max(ts)).scalar()


def look_back(df: DataFrame, hours: float, ts: str = "ts", as_of: dt.datetime | None = None) -> DataFrame:
    """Rows newer than hours before as_of."""
    return df.where(F.col(ts) > now_of(df, ts, as_of) - F.expr(f"INTERVAL {int(hours * 3600)} SECOND"))


def impact(severity: Column) -> Column:
    """Low below 4, Medium below 7, else High."""
    return F.when(severity < 4, "Low").when(severity < 7, "Medium").otherwise("High")


def filter_events(
    df: DataFrame,
    category: str | None = None,
    band: str | None = None,
    country: str | None = None,
    min_severity: float | None = None,
    countries: list[str] | None = None,
    text: str | None = None,
    text_columns: tuple[str, ...] = (),
) -> DataFrame:
    """Conjunctive filter of whatever conditions are given; text matches any text column, in either case."""
    tests = []
    if category:
        tests.append(F.col("category") == category)
    if band:
        tests.append(impact(F.col("severity")) == band)
    if country:
        tests.append(F.col("country") == country)
    if min_severity is not None:
        tests.append(F.col("severity") >= min_severity)
    if countries:
        tests.append(F.col("country").isin(countries))
    if text and text_columns:
        found = F.lit(False)
        for c in text_columns:
            found = found | F.col(c).ilike(f"%{text}%")
        tests.append(found)
    for t in tests:
        df = df.where(t)
    return df


def alert_level(severity: Column, level: Column) -> Column:
    """Whether an event passes a bot's level: All, High+Medium, or High with severity of 7 or more."""
    return (
        F.when(level == "All", True)
        .when(level == "High+Medium", severity >= 4)
        .otherwise(severity >= 7)
    )


def global_kpis(df: DataFrame, as_of=None) -> DataFrame:
    """One row in one pass: totals, last 24 hours, mean severity and risk index."""
    recent = F.col("ts") > now_of(df, "ts", as_of) - F.expr("INTERVAL 24 HOURS")
    high = F.col("severity") >= 7
    return df.agg(
        F.count("*").alias("total"),
        F.count_if(recent).alias("last_24h"),
        F.count_if(recent & high).alias("high_24h"),
        F.avg("severity").alias("avg_severity"),
        F.least(F.lit(100.0), F.avg("severity") * 10).alias("risk_index"),
    )


def by_category(df: DataFrame) -> DataFrame:
    return df.groupBy("category").agg(F.count("*").alias("n"))


def hotspots(df: DataFrame, top: int = 10, by: str = "n") -> DataFrame:
    agg = df.where("country <> 'XX'").groupBy("country").agg(F.count("*").alias("n"), F.avg("severity").alias("avg_severity"))
    return agg.orderBy(F.desc(by), "country").limit(top)


def heatmap(df: DataFrame, hours: float = 72, as_of=None) -> DataFrame:
    """Per country: events, mean and highest severity and high events in the window."""
    return look_back(df, hours, as_of=as_of).groupBy("country").agg(
        F.count("*").alias("n"),
        F.avg("severity").alias("avg_severity"),
        F.max("severity").alias("max_severity"),
        F.count_if(F.col("severity") >= 7).alias("high_count"),
    )


def country_risk(df: DataFrame, stress: float = 0.0) -> DataFrame:
    risk = F.avg(F.col("severity") * 0.7 + F.lit(stress * 30))
    band = F.when(F.col("risk") >= 5, "red").when(F.col("risk") >= 3, "amber").otherwise("green")
    return df.groupBy("country").agg(risk.alias("risk")).withColumn("band", band)


def region_rollup(df: DataFrame) -> DataFrame:
    agg = df.groupBy("region").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("severity") >= 7).alias("high"),
        F.avg("severity").alias("avg_severity"),
        F.count_distinct("country").alias("countries"),
    )
    mean = F.col("avg_severity")
    return agg.withColumn("trend", F.when(mean > 6.5, "up").when(mean < 4, "down").otherwise("flat"))


def duplicate_candidates(df: DataFrame, top: int = 30) -> DataFrame:
    """Groups of category and country with more than one event, with their ids."""
    return (
        df.groupBy("category", "country")
        .agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))
        .where("n > 1")
        .orderBy(F.desc("n"), "category", "country")
        .limit(top)
    )


def satisfaction(df: DataFrame, positive: Column, negative: Column) -> DataFrame:
    pos, neg = F.count_if(positive), F.count_if(negative)
    return df.agg(pos.alias("pos"), neg.alias("neg"), (100 * pos / F.greatest(F.lit(1), pos + neg)).alias("pct"))


def affinity(activity: DataFrame, items: DataFrame, actions: tuple[str, ...], item: str, group: str) -> DataFrame:
    """Per user the share of each item group among the user's actions of the given kinds."""
    n = (
        activity.where(F.col("action").isin(*actions))
        .join(items, F.col("detail") == F.col(item))
        .groupBy("user_id", group)
        .agg(F.count("*").alias("n"))
    )
    return n.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy("user_id")))


def behaviour(activity: DataFrame, days: int = 7, as_of=None) -> DataFrame:
    """Per action: rows, distinct users, and users active in the last days; with the grand total as a null action."""
    recent = F.col("created_at") > now_of(activity, "created_at", as_of) - F.expr(f"INTERVAL {days} DAYS")
    return activity.withColumn("recent_user", F.when(recent, F.col("user_id"))).rollup("action").agg(
        F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.count_distinct("recent_user").alias("active")
    )


def per_day(df: DataFrame, ts: str, *keys: str) -> DataFrame:
    return df.groupBy(*keys, F.to_date(ts).alias("day")).agg(F.count("*").alias("n"))


def velocity(df: DataFrame, as_of=None) -> DataFrame:
    """Per category: events in the last 24 hours and the 24 before, their ratio (at most 3) and the move of mean severity."""
    now = now_of(df, "ts", as_of)
    day, before = now - F.expr("INTERVAL 24 HOURS"), now - F.expr("INTERVAL 48 HOURS")
    last = F.col("ts") > day
    prior = (F.col("ts") > before) & (F.col("ts") <= day)
    agg = df.groupBy("category").agg(
        F.count_if(last).alias("n_24h"),
        F.count_if(prior).alias("n_prior"),
        (F.avg(F.when(last, F.col("severity"))) - F.avg(F.when(prior, F.col("severity")))).alias("momentum"),
    )
    ratio = F.least(F.lit(3.0), F.col("n_24h") / F.greatest(F.lit(1), F.col("n_prior")))
    return agg.withColumn("velocity", ratio)


def early_warning(df: DataFrame, weights: dict[str, float], macro_stress: float = 0.0, as_of=None) -> DataFrame:
    """One row: event velocity, mean severity of the 40 most severe, weighted severity, and their blend with market stress."""
    recent = look_back(df, 72, as_of=as_of)
    w = F.coalesce(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])[F.col("category")], F.lit(1.0))
    top = recent.orderBy(F.desc("severity"), "id").limit(40).agg(F.avg("severity").alias("top_severity"))
    now = now_of(df, "ts", as_of)
    day, before = now - F.expr("INTERVAL 24 HOURS"), now - F.expr("INTERVAL 48 HOURS")
    rest = recent.agg(
        F.least(
            F.lit(3.0),
            F.count_if(F.col("ts") > day) / F.greatest(F.lit(1), F.count_if((F.col("ts") > before) & (F.col("ts") <= day))),
        ).alias("velocity"),
        (F.sum(F.col("severity") * w) / F.sum(w)).alias("weighted_severity"),
    )
    blend = (
        0.30 * F.col("top_severity") + 0.25 * F.col("weighted_severity") + 0.25 * F.col("velocity") * 10 / 3 + F.lit(0.20 * macro_stress)
    )
    return rest.join(top).withColumn("score", blend)


def worst_per(df: DataFrame, key: str, top: int) -> DataFrame:
    """The most severe event of each group, the top groups by it."""
    worst = df.groupBy(key).agg(F.max(F.struct("severity", "ts", "id")).alias("w"))
    return worst.select(key, "w.id", "w.severity").orderBy(F.desc("severity"), key).limit(top)


def top_per_group(df: DataFrame, key: str | list[str], order: list, k: int) -> DataFrame:
    keys = [key] if isinstance(key, str) else key
    ranked = df.withColumn("place", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("place") <= k)


def retention(df: DataFrame, slots: DataFrame, total: int) -> DataFrame:
    """The most severe events of each category up to its slots, then the newest total; a category without slots meets only the second cut."""
    place = F.row_number().over(W.partitionBy("category").orderBy(F.desc("severity"), F.desc("ts"), "id"))
    kept = df.withColumn("place", place).join(F.broadcast(slots), "category", "left").where("slots IS NULL OR place <= slots")
    return kept.drop("place", "slots").orderBy(F.desc("ts"), "id").limit(total)


def streaks(activity: DataFrame) -> DataFrame:
    """Per user the longest run of consecutive days with activity, and the number of active days."""
    days = activity.select("user_id", F.to_date("created_at").alias("day")).distinct()
    place = F.row_number().over(W.partitionBy("user_id").orderBy("day"))
    runs = days.withColumn("island", F.date_sub("day", place)).groupBy("user_id", "island").agg(F.count("*").alias("n"))
    return runs.groupBy("user_id").agg(F.max("n").alias("longest"), F.sum("n").alias("days"))


def personalised(df: DataFrame, affinities: DataFrame, users: DataFrame, k: int, as_of=None, hours: float = 72) -> DataFrame:
    """For every user the k best recent events: half severity, a fifth recency-weighted heat, the rest relevance.

    A user's relevance is one number for each (category, region), so only the k best events of each can be among a user's k:
    users meet that table (k rows a pair of category and region), not the events.
    """
    recent = look_back(df, hours, as_of=as_of)
    age = (F.unix_timestamp(now_of(df, "ts", as_of).cast("timestamp")) - F.unix_timestamp(F.col("ts").cast("timestamp"))) / 3600
    heat = F.col("severity") * F.greatest(F.lit(0.4), F.exp(-age / 72))
    relevance = F.coalesce("share", F.lit(0.05)) + F.when(F.col("home") == F.col("region"), 0.3).otherwise(0.1)
    base = 0.5 * F.col("severity") / 10 + 0.2 * F.col("heat") / 10
    events = recent.withColumnRenamed("user_id", "event_user").withColumn("heat", heat).withColumn("base", base)
    best = top_per_group(events, ["category", "region"], [F.desc(F.round("base", 9)), "id"], k).drop("place")
    scored = (
        users.join(F.broadcast(best), F.lit(True))
        .join(affinities.select("user_id", "category", "share"), ["user_id", "category"], "left")
        .withColumn("score", 0.5 * F.col("severity") / 10 + 0.2 * F.col("heat") / 10 + 0.3 * relevance)
    )
    return top_per_group(scored, "user_id", [F.desc(F.round("score", 9)), "id"], k)
