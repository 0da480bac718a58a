"""Groups by leader: the first row opens a group, and the first row more than a span after its leader opens the next."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.session import settle


def _bucket(s: str, span: int):
    return F.expr(f"({s} - pmod({s}, {span}L)) div {span}L")


def _following(times: DataFrame, span: int) -> DataFrame:
    """k, s and nxt, the first time of k more than span after s (null: none). times: distinct (k, s).

    That time is in the next bucket of one span's width or later, so each bucket's rows meet the probes of the bucket
    before them only, and a key's buckets meet one another by their first times.
    """
    held = times.select("k", "s", _bucket("s", span).alias("b"))
    data = held.select("k", "b", F.col("s").alias("v"), F.lit(None).cast("long").alias("probe"), F.lit(1).alias("data"))
    probes = held.select("k", (F.col("b") + 1).alias("b"), (F.col("s") + span).alias("v"), F.col("s").alias("probe"), F.lit(0).alias("data"))
    down = W.partitionBy("k", "b").orderBy(F.desc("v"), "data").rowsBetween(W.unboundedPreceding, 0)
    inside = data.unionByName(probes).withColumn("nxt", F.min(F.when(F.col("data") == 1, F.col("v"))).over(down)).where("data = 0")
    firsts = held.groupBy("k", "b").agg(F.min("s").alias("first"))
    marks = firsts.withColumn("data", F.lit(1)).unionByName(firsts.select("k", (F.col("b") + 1).alias("b"), F.lit(None).cast("long").alias("first"), F.lit(0).alias("data")))
    back = W.partitionBy("k").orderBy(F.desc("b"), "data").rowsBetween(W.unboundedPreceding, 0)
    later = marks.withColumn("later", F.min("first").over(back)).where("data = 0").select("k", "b", "later")
    return inside.join(later, ["k", "b"]).select("k", F.col("probe").alias("s"), F.coalesce("nxt", "later").alias("nxt"))


def leaders(times: DataFrame, span: int) -> DataFrame:
    """k and lead of every group. times: k, s (long).

    Pointers double: with the leaders that the first 2^i steps reach and the jump of 2^i steps, one join gives those of
    2^(i+1) steps and another the next jump; the rounds are the logarithm of a key's groups, and no key is gathered.
    """
    if span <= 0:
        raise ValueError("span must be above 0")
    times = settle(times.distinct())
    jump = settle(_following(times, span).where("nxt IS NOT NULL"))
    reached = times.groupBy("k").agg(F.min("s").alias("s"))
    while True:
        new = reached.join(jump, ["k", "s"]).select("k", F.col("nxt").alias("s"))
        reached = settle(reached.unionByName(new))
        twice = jump.join(jump.select("k", F.col("s").alias("nxt"), F.col("nxt").alias("far")), ["k", "nxt"]).select("k", "s", F.col("far").alias("nxt"))
        jump = settle(twice)
        if jump.isEmpty():
            return reached.withColumnRenamed("s", "lead")


def with_leader(df: DataFrame, keys: list[str], ts: str, span: int, name: str = "lead") -> DataFrame:
    """df with its group's leader (microseconds; null where ts is null). Null keys are a key of their own; equal times share a group.

    span is in microseconds. A row's leader is at most a span before it, so it is in the row's bucket or the one before: an equi-join.
    """
    df = df.withColumns({"__k": F.struct(*keys), "__s": F.unix_micros(F.col(ts).cast("timestamp"))})
    found = settle(leaders(df.where("__s IS NOT NULL").select(F.col("__k").alias("k"), F.col("__s").alias("s")), span))
    b = _bucket("lead", span)
    near = found.select(F.col("k").alias("__k"), "lead", F.explode(F.array(b, b + 1)).alias("__b")).groupBy("__k", "__b").agg(F.collect_list("lead").alias("__leads"))  # two at most
    out = df.withColumn("__b", _bucket("__s", span)).join(near, ["__k", "__b"], "left")
    return out.withColumn(name, F.array_max(F.filter("__leads", lambda x: x <= F.col("__s")))).drop("__k", "__s", "__b", "__leads")
