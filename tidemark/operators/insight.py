"""Joins, roll-ups and rankings of the second kind: rules, intervals, nodes, cohorts, ledgers of points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators import scan
from tidemark.operators.kpis import now_of, top_per_group
from tidemark.operators.leaders import with_leader

MOST_RULES = 10_000


def match_rules(events: DataFrame, rules: DataFrame) -> DataFrame:
    """Events that meet a rule (rule_id, threshold, rule_category, rule_country; null for any).

    Rules are a small dimension: they are counted, and sent to every task up to
    MOST_RULES; above that the rules with a category meet by an equi-join on it,
    and only those without one are sent.
    """
    meets = F.col("severity") >= F.col("threshold")
    meets &= F.col("rule_country").isNull() | (F.col("rule_country") == F.col("country"))
    any_category = rules.where("rule_category IS NULL")
    with_category = rules.where("rule_category IS NOT NULL")
    if rules.limit(MOST_RULES + 1).count() <= MOST_RULES:
        return events.join(F.broadcast(rules), meets & (F.col("rule_category").isNull() | (F.col("rule_category") == F.col("category"))))
    return events.join(with_category, meets & (F.col("rule_category") == F.col("category"))).unionByName(
        events.join(any_category, meets)
    )


def not_recent(rows: DataFrame, sent: DataFrame, keys: list[str], hours: int, as_of: Column) -> DataFrame:
    """Rows whose key was not sent within the hours before as_of."""
    recent = sent.where(F.col("sent_at") > as_of - F.expr(f"INTERVAL {hours} HOURS"))
    return rows.join(recent.select(*keys), keys, "left_anti")


def within(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, minutes: int) -> DataFrame:
    """left with the number and first time of right rows of the same key up to some minutes later."""
    r = right.select(F.col(key).alias("__k"), F.col(right_ts).alias("__t"))
    late = F.expr(f"INTERVAL {minutes} MINUTES")
    near = (F.col(key) == F.col("__k")) & (F.col("__t") >= F.col(left_ts)) & (F.col("__t") <= F.col(left_ts) + late)
    rows = left.withColumn("__row", F.monotonically_increasing_id())  # equal rows stay two
    agg = rows.join(r, near, "left").groupBy("__row", *left.columns)
    return agg.agg(F.count("__t").alias("n_within"), F.min("__t").alias("first_within")).drop("__row")


def forward_as_of(left: DataFrame, right: DataFrame, keys: list[str], left_ts: str, right_ts: str, value: str) -> DataFrame:
    """left with the value of the first right row at or after its time."""
    a = left.withColumn("__t", F.col(left_ts)).withColumn("__v", F.lit(None).cast(right.schema[value].dataType)).withColumn("__o", F.lit(0))
    b = right.select(*keys, F.col(right_ts).alias("__t"), F.col(value).alias("__v"), F.lit(1).alias("__o"))
    by = W.partitionBy(*keys).orderBy(F.desc("__t"), F.desc("__o")).rowsBetween(W.unboundedPreceding, 0)  # backwards, so that the frame only grows
    both = a.unionByName(b, allowMissingColumns=True).withColumn(value, F.last("__v", ignorenulls=True).over(by))
    return both.where("__o = 0").select(*left.columns, value)


def near_nodes(points: DataFrame, nodes: DataFrame, radius: Column, cell: float) -> DataFrame:
    """Points (id, x, y) within the radius of a node (node, nx, ny), by plane distance.

    Both sides meet by grid cell: a node is put into every cell that its radius
    (at most cell) can reach, so the join is an equi-join however many nodes.
    """
    shift = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    n = nodes.withColumn("s", shift).select(
        "*", (F.floor(F.col("nx") / cell) + F.col("s.i")).alias("cx"), (F.floor(F.col("ny") / cell) + F.col("s.j")).alias("cy")
    ).drop("s")
    p = points.withColumn("cx", F.floor(F.col("x") / cell)).withColumn("cy", F.floor(F.col("y") / cell))
    close = F.sqrt(F.pow(F.col("x") - F.col("nx"), 2) + F.pow(F.col("y") - F.col("ny"), 2)) < radius
    return p.join(n, ["cx", "cy"]).where(close).drop("cx", "cy")


def node_risk(nodes: DataFrame, hits: DataFrame) -> DataFrame:
    """Risk of each node (node, base): its base without events, else at most 10 of .4 base + .4 mean severity + .8 high events."""
    agg = hits.groupBy("node").agg(F.count("*").alias("n"), F.avg("severity").alias("mean"), F.count_if(F.col("severity") >= 7).alias("high"))
    risk = F.least(F.lit(10.0), 0.4 * F.col("base") + 0.4 * F.col("mean") + 0.8 * F.col("high"))
    df = nodes.join(agg, "node", "left").withColumn("risk", F.when(F.col("n").isNull(), F.col("base")).otherwise(risk))
    level = F.when(F.col("risk") >= 8, "critical").when(F.col("risk") >= 6, "high").when(F.col("risk") >= 4, "elevated").otherwise("normal")
    return df.select("node", F.coalesce("n", F.lit(0)).alias("n"), "risk", level.alias("level"))


def exposure(members: DataFrame) -> DataFrame:
    """Per sector (sector, node, base, risk): mean of half base and half risk, and its most exposed node."""
    v = 0.5 * F.col("base") + 0.5 * F.col("risk")
    return members.withColumn("v", v).groupBy("sector").agg(F.avg("v").alias("exposure"), F.max(F.struct("v", "node"))["node"].alias("highest"))


def leaderboard(trades: DataFrame, big: float, top: int) -> DataFrame:
    """Per member: trades, buys, sells, distinct tickers, big trades; score = trades + 3 big + .5 distinct."""
    agg = trades.groupBy("bot").agg(
        F.count("*").alias("trades"),
        F.count_if(F.col("side") == "BUY").alias("buys"),
        F.count_if(F.col("side") != "BUY").alias("sells"),
        F.count_distinct("symbol").alias("symbols"),
        F.count_if(F.col("qty") * F.col("price") >= big).alias("big"),
    )
    score = F.col("trades") + 3 * F.col("big") + 0.5 * F.col("symbols")
    return agg.withColumn("score", score).orderBy(F.desc("score"), "bot").limit(top)


def consensus(holdings: DataFrame, least: int) -> DataFrame:
    """Symbols with at least so many holders, and the smallest and largest holder."""
    agg = holdings.select("bot", "symbol").distinct().groupBy("symbol").agg(
        F.count("*").alias("holders"), F.min("bot").alias("first"), F.max("bot").alias("last")
    )
    return agg.where(F.col("holders") >= least)


def closed_patterns(positions: DataFrame, newest: int, order: list) -> DataFrame:
    """Per bot over its newest SELLs: win rate, mean win, mean loss, and the rule that they suggest."""
    sells = top_per_group(positions.where("side = 'SELL'"), "bot", order, newest)
    agg = sells.groupBy("bot").agg(
        F.count("*").alias("n"),
        (F.count_if(F.col("pnl") > 0) / F.count("*")).alias("win_rate"),
        F.avg(F.when(F.col("pnl") > 0, F.col("pnl"))).alias("avg_win"),
        F.avg(F.when(F.col("pnl") < 0, F.col("pnl"))).alias("avg_loss"),
    )
    rule = (
        F.when(F.col("win_rate") > 0.55, "keep")
        .when(F.col("win_rate") < 0.40, "review")
        .when(F.col("avg_win") > 1.5 * -F.col("avg_loss"), "let run")
        .otherwise("none")
    )
    return agg.withColumn("rule", rule)


def points(activity: DataFrame, worth: dict[str, int], levels: DataFrame) -> DataFrame:
    """Per user: points of all actions, and the level (level, floor) they reach."""
    m = F.create_map(*[F.lit(x) for kv in worth.items() for x in kv])
    xp = activity.groupBy("user_id").agg(F.sum(F.coalesce(m[F.col("action")], F.lit(0))).alias("xp"))
    reached = xp.join(F.broadcast(levels), F.col("xp") >= F.col("floor")).groupBy("user_id", "xp").agg(F.max("level").alias("level"))
    return reached


def per_user_counters(users: DataFrame, activity: DataFrame, days: int, as_of=None) -> DataFrame:
    """Every user with counts of all and of recent actions; zero where there are none."""
    recent = F.col("created_at") > now_of(activity, "created_at", as_of) - F.expr(f"INTERVAL {days} DAYS")
    agg = activity.groupBy("user_id").agg(F.count("*").alias("actions"), F.count_if(recent).alias("recent"))
    zero = F.lit(0)
    return users.join(agg, "user_id", "left").select("user_id", F.coalesce("actions", zero).alias("actions"), F.coalesce("recent", zero).alias("recent"))


def progressive(events: DataFrame, focus: list[str], floor: float, limit: int, share: float = 0.15, as_of=None) -> DataFrame:
    """The best events by severity, focus and recency; each focus category has a guaranteed share of the places."""
    age = (F.unix_timestamp(now_of(events, "ts", as_of).cast("timestamp")) - F.unix_timestamp(F.col("ts").cast("timestamp"))) / 3600
    boost = F.col("category").isin(focus)
    score = F.col("severity") + F.when(boost, 0.6).otherwise(0.0) + 0.8 * F.exp(-age / 96)
    df = events.where(F.col("severity") >= F.lit(floor) - F.when(boost, 1.0).otherwise(0.0)).withColumn("score", F.round(score, 9))
    own = F.row_number().over(W.partitionBy("category").orderBy(F.desc("score"), "id"))
    df = df.withColumn("sure", boost & (own <= int(limit * share)))
    return df.orderBy(F.desc("sure"), F.desc("score"), "id").limit(limit)


def handles(stats: DataFrame, prefixes: list[str]) -> DataFrame:
    """bot with a public handle: prefix[id % 8]_((id * 7 + 13) % 9000 + 1000)."""
    words = F.array(*[F.lit(p) for p in prefixes])
    name = F.element_at(words, (F.col("bot") % len(prefixes) + 1).cast("int"))
    number = (F.col("bot") * 7 + 13) % 9000 + 1000
    return stats.withColumn("handle", F.concat_ws("_", name, number.cast("string")))


def week_key(ts: str) -> Column:
    """Year and week with weeks that start on Monday and days before the first Monday in week 00."""
    monday = (F.dayofweek(ts) + 5) % 7
    week = F.floor((F.dayofyear(ts) + 6 - monday) / 7)
    return F.concat(F.year(ts).cast("string"), F.lit("-W"), F.lpad(week.cast("string"), 2, "0"))


def resolve(names: DataFrame, targets: DataFrame) -> DataFrame:
    """Each name's target: equal first, then equal without case, then the start of a label; within a kind the smallest."""
    low = F.lower("label")
    exact = names.join(targets, F.col("name") == F.col("label")).withColumn("kind", F.lit(0))
    cased = names.join(targets, F.lower("name") == low).withColumn("kind", F.lit(1))
    starts = names.withColumn("p", F.substring(F.lower("name"), 1, 3)).join(
        targets.withColumn("p", F.substring(low, 1, 3)), "p"
    ).where(F.startswith(low, F.lower("name"))).drop("p").withColumn("kind", F.lit(2))
    every = exact.unionByName(cased).unionByName(starts)
    best = every.groupBy("name").agg(F.min(F.struct("kind", "label")).alias("b"))
    return best.select("name", "b.kind", "b.label")


def anti_prefix(df: DataFrame, text: str, chars: int, order: list) -> DataFrame:
    """One row for each first characters of the lower-cased text: the first in order."""
    key = F.substring(F.lower(text), 1, chars)
    return top_per_group(df.withColumn("__k", key), "__k", order, 1).drop("__k", "place")


def pivot_mean(df: DataFrame, key: str, column: str, values: list[str], value: str) -> DataFrame:
    """Mean of value by key, a column for each of the given values of column."""
    return df.groupBy(key).pivot(column, values).agg(F.avg(value))


def chain_edges(df: DataFrame, group: str, hours: float) -> DataFrame:
    """Consecutive rows of a group as edges, where at most some hours lie between."""
    by = W.partitionBy(group).orderBy("ts", "id")
    df = df.withColumn("next_id", F.lead("id").over(by)).withColumn("next_ts", F.lead("ts").over(by))
    return df.where(F.col("next_ts") <= F.col("ts") + F.expr(f"INTERVAL {int(hours * 3600)} SECONDS")).select(group, "id", "next_id")


def memory_dedup(entries: DataFrame, hours: float = 24, chars: int = 120, least: int = 15) -> DataFrame:
    """Entries (user_id, ts, text) without those that repeat a kept entry's first characters within the hours.

    What counts is the last kept entry, so the kept ones are the leaders of their groups. Of entries of one time the
    least text stays; one without a time is left out.
    """
    df = entries.where(F.length("text") >= least).withColumn("__p", F.substring("text", 1, chars))
    led = with_leader(df, ["user_id", "__p"], "ts", int(hours * 3_600_000_000), "__lead").where(F.unix_micros(F.col("ts").cast("timestamp")) == F.col("__lead"))
    return led.groupBy("user_id", "__p", "ts").agg(F.min("text").alias("text")).select("user_id", "ts", "text")


def reweight(feedback: DataFrame, gain: float = 0.3, loss: float = -0.2) -> DataFrame:
    """Per entry the weight after its feedback (entry, seq, rating) in order, held within .05 and 5 after each step."""
    shift = F.when(F.col("rating") > 0, gain).otherwise(loss).cast("double")
    m = F.struct(shift.alias("shift"), F.lit(0.05).alias("low"), F.lit(5.0).alias("high"))
    rank = F.row_number().over(W.partitionBy("entry").orderBy("seq", "rating")) - 1
    out = scan.whole(feedback.select("entry", rank.cast("long").alias("r"), m.alias("m")), ["entry"], scan.held_within)
    return out.select("entry", "n", F.greatest(F.col("m.low"), F.least(F.col("m.high"), 1.0 + F.col("m.shift"))).alias("weight"))
