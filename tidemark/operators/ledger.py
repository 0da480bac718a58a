"""Trade ledgers: positions, realised profit, bot statistics, all from the ordered trades without a Python fold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ORDER = ("executed_at", "l_orderkey", "l_linenumber", "l_partkey", "qty", "l_extendedprice")


def positions(trades: DataFrame, order: tuple[str, ...] = ORDER) -> DataFrame:
    """Trades with the quantity held, the average price and, on a SELL, the realised pnl.

    BUY averages in; SELL closes all that is held at its price. A run of BUYs up
    to and with its SELL is one island, so sums inside the island are the state.
    """
    by = W.partitionBy("bot", "symbol").orderBy(*order)
    sells = F.sum(F.when(F.col("side") == "SELL", 1).otherwise(0)).over(by.rowsBetween(W.unboundedPreceding, -1))
    df = trades.withColumn("island", F.coalesce(sells, F.lit(0)))
    own = W.partitionBy("bot", "symbol", "island").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    bought = F.when(F.col("side") == "BUY", F.col("qty")).otherwise(0.0)
    df = df.withColumn("held", F.sum(bought).over(own)).withColumn("cost", F.sum(bought * F.col("price")).over(own))
    df = df.withColumn("avg_price", F.when(F.col("held") > 0, F.col("cost") / F.col("held")))
    pnl = F.when((F.col("side") == "SELL") & (F.col("held") > 0), (F.col("price") - F.col("avg_price")) * F.col("held"))
    return df.withColumn("pnl", F.coalesce(pnl, F.lit(0.0))).drop("cost", "island")


def bot_stats(trades: DataFrame) -> DataFrame:
    """Per bot: trades, realised pnl, wins, and wins over all trades."""
    return positions(trades).groupBy("bot").agg(
        F.count("*").alias("trades"),
        F.sum("pnl").alias("realised"),
        F.count_if(F.col("pnl") > 0).alias("wins"),
        (F.count_if(F.col("pnl") > 0) / F.count("*")).alias("win_rate"),
    )


def open_positions(trades: DataFrame, quotes: DataFrame, order: tuple[str, ...] = ORDER) -> DataFrame:
    """What each bot holds after its last trade, valued at quotes (symbol, quote), else at the average price."""
    seq = F.struct(*order)
    last = positions(trades, order).groupBy("bot", "symbol").agg(
        F.max_by("side", seq).alias("side"), F.max_by("held", seq).alias("qty"), F.max_by("avg_price", seq).alias("avg_price")
    )
    held = last.where("side = 'BUY' AND qty > 0").join(quotes, "symbol", "left")
    price = F.coalesce("quote", "avg_price")
    return held.select(
        "bot", "symbol", "qty", "avg_price", (F.col("qty") * price).alias("value"),
        (F.col("qty") * (price - F.col("avg_price"))).alias("unrealised"),
    )


def outcome(change: Column, action: Column) -> Column:
    """win, loss or flat of a signal by a half-percent band; a SELL gains when the price falls."""
    gain = F.when(action == "SELL", -change).otherwise(change)
    return F.when(gain > 0.005, "win").when(gain < -0.005, "loss").otherwise("flat")


def resolve(signals: DataFrame, n: int = 5) -> DataFrame:
    """Signals (symbol, date, close, action) with the outcome n bars later; null where the bars end."""
    by = W.partitionBy("symbol").orderBy("date")
    change = F.lead("close", n).over(by) / F.col("close") - 1
    df = signals.withColumn("change", change)
    label = F.when(F.col("change").isNull(), F.lit(None)).otherwise(outcome(F.col("change"), F.col("action")))
    return df.withColumn("outcome", label).where(F.col("action") != "HOLD")


def upsert_latest(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Old and new rows with the newest of each key kept."""
    both = old.unionByName(new, allowMissingColumns=True)
    place = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc_nulls_last(order)))
    return both.withColumn("__p", place).where("__p = 1").drop("__p")


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The new rows whose key is not in old; of equal keys among them one."""
    return new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti")


def as_of_backward(left: DataFrame, right: DataFrame, keys: list[str], left_ts: str, right_ts: str, value: str) -> DataFrame:
    """left with the value of the newest right row at or before its time, by one union and one window."""
    names = left.columns
    a = left.withColumn("__t", F.col(left_ts)).withColumn("__v", F.lit(None).cast(right.schema[value].dataType)).withColumn("__o", F.lit(1))
    b = right.select(*keys, F.col(right_ts).alias("__t"), F.col(value).alias("__v"), F.lit(0).alias("__o"))
    by = W.partitionBy(*keys).orderBy("__t", "__o").rowsBetween(W.unboundedPreceding, 0)
    both = a.unionByName(b, allowMissingColumns=True).withColumn(value, F.last("__v", ignorenulls=True).over(by))
    return both.where("__o = 1").select(*names, value)
