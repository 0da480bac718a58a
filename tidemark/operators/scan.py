"""Running compositions of maps: what a fold over a key's rows gives, without the key's rows in one place.

A step of a recurrence is a map of the state (a mean's step is v -> a v + b), and
maps compose into maps of the same form. So a key's rows are cut into blocks of
BLOCK by rank, each block is composed by itself, the blocks' maps are composed
the same way one level up, and each block takes what stands before it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import settle

BLOCK = 256

Compose = Callable[[Column, Column], Column]


def _after(first: Column, then: Column) -> Column:
    """v -> a v + b, one after the other; a struct of fields a and b."""
    return F.struct((first["a"] * then["a"]).alias("a"), (then["a"] * first["b"] + then["b"]).alias("b"))


def affine(names: list[str]) -> Compose:
    """Composition of structs that hold a map v -> a v + b under each name."""
    return lambda first, then: F.struct(*[_after(first[n], then[n]).alias(n) for n in names])


def held_within(first: Column, then: Column) -> Column:
    """Composition of w -> max(low, min(high, w + shift)); structs of shift, low and high."""
    inside = lambda x: F.greatest(then["low"], F.least(then["high"], x + then["shift"]))
    return F.struct((first["shift"] + then["shift"]).alias("shift"), inside(first["low"]).alias("low"), inside(first["high"]).alias("high"))


def _blocks(rows: DataFrame, keys: list[str], compose: Compose) -> DataFrame:
    """keys, b, xs (the block's r and x in order) and states (the composition up to each of them). rows: keys, r (rank from 0), m, x."""
    last = lambda acc: F.element_at(acc, -1)
    g = rows.groupBy(*keys, F.floor(F.col("r") / BLOCK).alias("b")).agg(F.array_sort(F.collect_list(F.struct("r", "m", "x"))).alias("xs"))
    first = F.transform(F.slice("xs", 1, 1), lambda x: x["m"])
    states = F.aggregate(F.slice("xs", F.lit(2), F.size("xs")), first, lambda acc, x: F.array_append(acc, compose(last(acc), x["m"])))
    return g.withColumn("states", states)


def _same(keys: list[str], a: DataFrame, b: DataFrame) -> Column:
    out = a["b"] == b["b"]
    for k in keys:
        out = out & a[k].eqNullSafe(b[k])
    return out


def running(rows: DataFrame, keys: list[str], compose: Compose) -> DataFrame:
    """keys, r, x and m, the composition of all maps of the key up to and with rank r. rows: keys, r (rank from 0), m (struct), x."""
    g = settle(_blocks(rows, keys, compose))
    if g.where("b > 0").isEmpty():
        out = g.withColumn("carry", F.lit(None))
    else:
        totals = g.select(*keys, F.col("b").alias("r"), F.element_at("states", -1).alias("m"), F.lit(0).alias("x"))
        up = running(totals, keys, compose).select(*keys, (F.col("r") + 1).alias("b"), F.col("m").alias("carry"))
        out = g.join(up, _same(keys, g, up), "left").select(*[g[c] for c in g.columns], up["carry"])
    each = out.select(*keys, "carry", F.explode(F.arrays_zip("xs", "states")).alias("z"))
    m = F.col("z.states")
    if dict(out.dtypes)["carry"] != "void":
        m = F.when(F.col("carry").isNull(), m).otherwise(compose(F.col("carry"), m))
    return each.select(*keys, F.col("z.xs.r").alias("r"), F.col("z.xs.x").alias("x"), m.alias("m"))


def whole(rows: DataFrame, keys: list[str], compose: Compose) -> DataFrame:
    """keys, n (rows) and m, the composition of all maps of a key. rows: keys, r (rank from 0) and m."""
    level = rows.select(*keys, "r", "m", F.lit(1).cast("long").alias("x"))
    while True:
        g = _blocks(level, keys, compose)
        count = F.aggregate("xs", F.lit(0).cast("long"), lambda t, x: t + x["x"])
        level = settle(g.select(*keys, F.col("b").alias("r"), F.element_at("states", -1).alias("m"), count.alias("x")))
        if level.where("r > 0").isEmpty():
            return level.select(*keys, F.col("x").alias("n"), "m")
