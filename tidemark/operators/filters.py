"""Filters and keyed reads: membership, thresholds, boxes, search, newest rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def among(df: DataFrame, column: str, values: DataFrame) -> DataFrame:
    """Rows whose column is one of the values (one column, of any number of rows)."""
    return df.join(values.select(F.col(values.columns[0]).alias(column)), column, "left_semi")


def threshold_alerts(df: DataFrame, rules: DataFrame, key: str, k: int = 5) -> DataFrame:
    """Per owner (rules: key, owner, threshold) the k strongest rows at or above its threshold."""
    order = W.partitionBy("owner").orderBy(F.desc("severity"), "id")
    return df.join(rules, key).where("severity >= threshold").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def relative_change(df: DataFrame, keys: list[str], order: str, value: str, least: float = 0.01) -> DataFrame:
    """Rows whose value moved against the row before by more than the least share."""
    before = F.lag(value).over(W.partitionBy(*keys).orderBy(order))
    change = F.abs(F.col(value) - F.col("previous")) / (F.abs("previous") + 0.001)
    return df.withColumn("previous", before).withColumn("change", change).where(F.col("change") > least)


def in_box(df: DataFrame, south: float, west: float, north: float, east: float, pad: float = 0.25) -> DataFrame:
    """Points (lat, lon) in a box that is widened by a share of its sides."""
    dy, dx = (north - south) * pad, (east - west) * pad
    return df.where(F.col("lat").between(south - dy, north + dy) & F.col("lon").between(west - dx, east + dx))


def mentions(markets: Column, symbol: str, aliases: list[str]) -> Column:
    """Whether an array of market names holds the symbol, its first three letters or an alias as a part of a name, in any case."""
    parts = {symbol.lower(), symbol[:3].lower(), *(a.lower() for a in aliases)}
    has = lambda m: reduce(Column.__or__, [F.contains(F.lower(m), F.lit(p)) for p in sorted(parts)])
    return F.exists(markets, has)


def search(df: DataFrame, exact: str, columns: list[str], text: str, order: list, k: int = 20) -> DataFrame:
    """The first k rows whose exact column equals the text or whose columns contain it, in any case."""
    found = reduce(Column.__or__, [F.contains(F.lower(c), F.lit(text.lower())) for c in columns])
    return df.where((F.col(exact) == text) | found).orderBy(*order).limit(k)


def trade_filter(trades: DataFrame, since: Column, bot: int | None = None, part: str = "") -> DataFrame:
    """Trades since a date (a missing one passes), of one bot, whose symbol contains a part."""
    df = trades.where(F.coalesce(F.col("executed_at"), F.lit("9999-12-31").cast("timestamp")) >= since)
    df = df if bot is None else df.where(F.col("bot") == bot)
    return df.where(F.contains(F.col("symbol").cast("string"), F.lit(part)))


def newest_per(df: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    """The first k rows of each key, with their rank."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def unenriched(df: DataFrame, column: str, order: list, k: int) -> DataFrame:
    """The first k rows whose column is null or empty."""
    return df.where(F.coalesce(F.col(column).cast("string"), F.lit("")) == "").orderBy(*order).limit(k)
