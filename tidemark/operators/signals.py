"""Rule signals for every bar of every symbol, and long/flat evaluation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators import series as S


def _crossing(a: Column, b: Column) -> Column:
    """BUY where a rises over b, SELL where it falls under it."""
    pa, pb = F.lag(a).over(S.by()), F.lag(b).over(S.by())
    return F.when((pa <= pb) & (a > b), "BUY").when((pa >= pb) & (a < b), "SELL").otherwise("HOLD")


def ma_cross(df: DataFrame, fast: int = 10, slow: int = 30) -> DataFrame:
    df = S.sma(S.sma(df, fast, "__a"), slow, "__b")
    return df.withColumn("action", _crossing(F.col("__a"), F.col("__b"))).drop("__a", "__b")


def rsi_reversion(df: DataFrame, low: float = 30, high: float = 70) -> DataFrame:
    df = S.rsi(df, 14, "__r")
    return df.withColumn("action", F.when(F.col("__r") < low, "BUY").when(F.col("__r") > high, "SELL").otherwise("HOLD")).drop("__r")


def bollinger_reversion(df: DataFrame) -> DataFrame:
    df = S.bollinger(df)
    act = F.when(F.col("close") < F.col("bb_low"), "BUY").when(F.col("close") > F.col("bb_up"), "SELL").otherwise("HOLD")
    return df.withColumn("action", act).drop("bb_mid", "bb_up", "bb_low", "bb_pct")


def momentum_sign(df: DataFrame, n: int = 20) -> DataFrame:
    roc = F.try_divide("close", F.lag("close", n).over(S.by())) - 1
    return df.withColumn("action", F.when(roc > 0, "BUY").when(roc < 0, "SELL").otherwise("HOLD"))


#: Rules by name; each takes bars and adds action. Callers may add their own.
STRATEGIES: dict[str, Callable[[DataFrame], DataFrame]] = {
    "ma_cross": ma_cross,
    "rsi_reversion": rsi_reversion,
    "bollinger_reversion": bollinger_reversion,
    "momentum_sign": momentum_sign,
}


def evaluate(df: DataFrame, lagged: bool = True) -> DataFrame:
    """Value of being long after a BUY and flat after a SELL, by bar; lagged: a signal acts on the next bar's return."""
    held = F.last(F.when(F.col("action") == "BUY", 1).when(F.col("action") == "SELL", 0), ignorenulls=True).over(
        S.by().rowsBetween(W.unboundedPreceding, 0)
    )
    df = S.returns(df).withColumn("position", F.coalesce(held, F.lit(0)))
    pos = F.coalesce(F.lag("position").over(S.by()), F.lit(0)) if lagged else F.col("position")
    df = df.withColumn("gain", F.log1p(pos * F.coalesce("ret", F.lit(0.0))))
    return df.withColumn("nav", 100 * F.exp(F.sum("gain").over(S.by().rowsBetween(W.unboundedPreceding, 0)))).drop("gain")


def sweep(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Every strategy over every symbol in one job: signals, final value and worst drawdown."""
    out = None
    for name in names or list(STRATEGIES):
        nav = S.drawdown(evaluate(STRATEGIES[name](df)), "nav")
        agg = nav.groupBy("symbol").agg(
            F.count_if(F.col("action") == "BUY").alias("buys"),
            F.count_if(F.col("action") == "SELL").alias("sells"),
            F.max_by("nav", "date").alias("final_nav"),
            F.min("drawdown").alias("max_drawdown"),
        )
        agg = agg.withColumn("strategy", F.lit(name))
        out = agg if out is None else out.unionByName(agg)
    return out


def vote(df: DataFrame, weights: dict[str, float], least: float = 0.15) -> DataFrame:
    """Net weighted vote of strategies for every bar, and the action beyond least either way."""
    out = df
    net = F.lit(0.0)
    for i, (name, w) in enumerate(weights.items()):
        out = STRATEGIES[name](out).withColumnRenamed("action", f"__v{i}")
        net = net + F.when(F.col(f"__v{i}") == "BUY", w).when(F.col(f"__v{i}") == "SELL", -w).otherwise(0.0)
    out = out.withColumn("net", net)
    act = F.when(F.col("net") > least, "BUY").when(F.col("net") < -least, "SELL").otherwise("HOLD")
    return out.withColumn("action", act).drop(*[f"__v{i}" for i in range(len(weights))])


def walk_forward(df: DataFrame, name: str, windows: int, inside: float = 0.7) -> DataFrame:
    """Log gains of a strategy in the first part and the rest of each of a symbol's windows of bars."""
    df = evaluate(STRATEGIES[name](df))
    nav = F.col("nav")
    gain = F.coalesce(F.ln(nav / F.lag("nav").over(S.by())), F.ln(nav / 100))
    n = F.count("*").over(W.partitionBy("symbol"))
    place = F.row_number().over(S.by()) - 1
    df = df.withColumn("gain", gain).withColumn("window", F.least(F.lit(windows - 1), F.floor(place * windows / n)).cast("int"))
    own = W.partitionBy("symbol", "window")
    df = df.withColumn("j", F.row_number().over(own.orderBy("date")) - 1).withColumn("m", F.count("*").over(own))
    first = F.col("j") < inside * F.col("m")
    return df.groupBy("symbol", "window").agg(
        F.sum(F.when(first, F.col("gain")).otherwise(0.0)).alias("inside"), F.sum(F.when(first, 0.0).otherwise(F.col("gain"))).alias("outside")
    )
