"""Market-series indicators: columns added to bars (symbol, date, open, high, low, close, volume).

Every function takes and returns a DataFrame; n bars of warm-up give null unless
stated. All windows are by symbol in date order, so one shuffle and one sort
serve a whole chain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators import scan
from tidemark.operators.insight import forward_as_of


def by() -> WindowSpec:
    """A symbol's bars in date order."""
    return W.partitionBy("symbol").orderBy("date")


def last(n: int) -> WindowSpec:
    """The n bars up to the current one."""
    return by().rowsBetween(-(n - 1), 0)


def before(n: int) -> WindowSpec:
    """The n bars before the current one."""
    return by().rowsBetween(-n, -1)


def warm(n: int, value: Column) -> Column:
    """value from the n-th bar on."""
    return F.when(F.row_number().over(by()) >= n, value)


def returns(df: DataFrame) -> DataFrame:
    prior = F.lag("close").over(by())
    return df.withColumn("ret", F.try_divide("close", prior) - 1).withColumn("log_ret", F.ln(F.try_divide("close", prior)))


def sma(df: DataFrame, n: int, name: str | None = None) -> DataFrame:
    return df.withColumn(name or f"sma{n}", warm(n, F.avg("close").over(last(n))))


def rsi(df: DataFrame, n: int = 14, name: str = "rsi", neutral: float | None = None) -> DataFrame:
    """Simple (not smoothed) means of gains and losses over n moves; 100 where nothing was lost."""
    move = F.col("close") - F.lag("close").over(by())
    df = df.withColumn("__g", F.greatest(move, F.lit(0.0))).withColumn("__l", F.greatest(-move, F.lit(0.0)))
    gain, loss = F.avg("__g").over(last(n)), F.avg("__l").over(last(n))
    value = F.when(loss == 0, F.lit(100.0)).otherwise(100 - 100 / (1 + gain / loss))
    out = warm(n + 1, value)
    if neutral is not None:
        out = F.coalesce(out, F.lit(neutral))
    return df.withColumn(name, out).drop("__g", "__l")


def bollinger(df: DataFrame, n: int = 20, k: float = 2.0) -> DataFrame:
    """Middle, upper and lower band with the population deviation, and the place of the close between them."""
    mid, dev = F.avg("close").over(last(n)), F.stddev_pop("close").over(last(n))
    df = df.withColumn("bb_mid", warm(n, mid)).withColumn("bb_up", warm(n, mid + k * dev)).withColumn("bb_low", warm(n, mid - k * dev))
    width = F.col("bb_up") - F.col("bb_low")
    return df.withColumn("bb_pct", F.when(width > 0, (F.col("close") - F.col("bb_low")) / width))


def percent_b_before(df: DataFrame, n: int = 20) -> DataFrame:
    """Place of the close in the band of the n bars before it."""
    mid, dev = F.avg("close").over(before(n)), F.stddev_pop("close").over(before(n))
    return df.withColumn("pct_b", warm(n + 1, F.when(dev > 0, (F.col("close") - (mid - 2 * dev)) / (4 * dev))))


def obv(df: DataFrame) -> DataFrame:
    move = F.col("close") - F.lag("close").over(by())
    df = df.withColumn("__v", F.when(move > 0, F.col("volume")).when(move < 0, -F.col("volume")).otherwise(0.0))
    return df.withColumn("obv", F.sum("__v").over(by().rowsBetween(W.unboundedPreceding, 0))).drop("__v")


def stochastic(df: DataFrame, n: int = 14, d: int = 3) -> DataFrame:
    """%K (50 where the range is empty), %D as its mean, Williams %R (-50 where the range is empty)."""
    high, low = F.max("high").over(last(n)), F.min("low").over(last(n))
    span = high - low
    df = df.withColumn("stoch_k", warm(n, F.when(span == 0, 50.0).otherwise(100 * (F.col("close") - low) / span)))
    df = df.withColumn("williams", warm(n, F.when(span == 0, -50.0).otherwise(-100 * (high - F.col("close")) / span)))
    return df.withColumn("stoch_d", warm(n + d - 1, F.avg("stoch_k").over(last(d))))


def vwap(df: DataFrame) -> DataFrame:
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    run = by().rowsBetween(W.unboundedPreceding, 0)
    volume = F.sum("volume").over(run)
    df = df.withColumn("__t", typical * F.col("volume"))
    return df.withColumn("vwap", F.when(volume > 0, F.sum("__t").over(run) / volume).otherwise(F.col("close"))).drop("__t")


def volatility(df: DataFrame, n: int = 20, periods: int = 252) -> DataFrame:
    """Annualised sample deviation of returns in percent, and the same of the n returns before the bar (0 in warm-up)."""
    df = df if "ret" in df.columns else returns(df)
    scale = periods**0.5
    df = df.withColumn("vol", warm(n + 1, F.stddev_samp("ret").over(last(n)) * scale * 100))
    return df.withColumn("vol_before", F.coalesce(warm(n + 2, F.stddev_samp("ret").over(before(n)) * scale), F.lit(0.0)))


def drawdown(df: DataFrame, column: str = "close") -> DataFrame:
    peak = F.max(column).over(by().rowsBetween(W.unboundedPreceding, 0))
    df = df.withColumn("drawdown", F.try_divide(column, peak) - 1)
    return df.withColumn("max_drawdown", F.min("drawdown").over(by().rowsBetween(W.unboundedPreceding, 0)))


def momentum(df: DataFrame) -> DataFrame:
    """Rates of change over 5, 10, 20 and 60 bars in percent (0 where history is short), and their weighted score."""
    score = F.lit(0.0)
    for n, w in ((5, 0.4), (10, 0.3), (20, 0.2), (60, 0.1)):
        roc = F.coalesce((F.try_divide("close", F.lag("close", n).over(by())) - 1) * 100, F.lit(0.0))
        df = df.withColumn(f"roc{n}", roc)
        score = score + w * F.col(f"roc{n}")
    return df.withColumn("momentum", score)


def levels(df: DataFrame, n: int = 252) -> DataFrame:
    """Highest and lowest of n bars (as many as there are), and the levels at 0.236 and 0.764 of their range."""
    high, low = F.max("high").over(last(n)), F.min("low").over(last(n))
    df = df.withColumn("high_n", high).withColumn("low_n", low)
    span = F.col("high_n") - F.col("low_n")
    return df.withColumn("support", F.col("low_n") + 0.236 * span).withColumn("resistance", F.col("low_n") + 0.764 * span)


def trend(df: DataFrame) -> DataFrame:
    """bullish or bearish where the short mean leaves the long one by half a percent and RSI agrees."""
    df = rsi(sma(sma(df, 5), 20))
    up = (F.col("sma5") > F.col("sma20") * 1.005) & (F.col("rsi") > 55)
    down = (F.col("sma5") < F.col("sma20") * 0.995) & (F.col("rsi") < 45)
    return df.withColumn("trend", F.when(up, "bullish").when(down, "bearish").otherwise("neutral"))


def ichimoku(df: DataFrame) -> DataFrame:
    def middle(n: int) -> Column:
        return warm(n + 1, (F.max("high").over(last(n)) + F.min("low").over(last(n))) / 2)

    df = df.withColumn("tenkan", middle(9)).withColumn("kijun", middle(26)).withColumn("span_b", middle(52))
    return df.withColumn("span_a", (F.col("tenkan") + F.col("kijun")) / 2).withColumn("chikou", F.lag("close", 26).over(by()))


def label_ahead(df: DataFrame, n: int = 5, gain: float = 0.005) -> DataFrame:
    return df.withColumn("label", (F.try_divide(F.lead("close", n).over(by()), F.col("close")) > 1 + gain).cast("int"))


def volume_ratio(df: DataFrame, n: int = 20, cap: float = 5.0) -> DataFrame:
    base = F.sum("volume").over(before(n)) / n
    return df.withColumn("volume_ratio", warm(n + 1, F.least(F.lit(cap), F.try_divide(F.col("volume"), base))))


def _recurrence(df: DataFrame, maps: dict[str, tuple[Column, Column]]) -> DataFrame:
    """df with a column for each name: v = a v + b over a symbol's bars in date order from v = 0; composed block by block (scan)."""
    kept = df.columns
    m = F.struct(*[F.struct(a.cast("double").alias("a"), b.cast("double").alias("b")).alias(n) for n, (a, b) in maps.items()])
    rows = df.withColumn("__m", m).select("symbol", (F.row_number().over(by()) - 1).cast("long").alias("r"), F.col("__m").alias("m"), F.struct(*kept).alias("x"))
    out = scan.running(rows, ["symbol"], scan.affine(list(maps)))
    return out.select(*[F.col(f"x.`{c}`").alias(c) for c in kept], *[F.col(f"m.{n}.b").alias(n) for n in maps])


def _smoothed(df: DataFrame, column: str, name: str, n: int, k: float, seed: str) -> DataFrame:
    """v + k (x - v) over the non-null values of a column from the n-th on, null before; seed close or sma gives the n-th."""
    x = F.col(column)
    upto = by().rowsBetween(W.unboundedPreceding, 0)
    df = df.withColumns({"__i": F.count(column).over(upto), "__sum": F.sum(column).over(upto)})
    i = F.col("__i")
    first = x if seed == "close" else F.col("__sum") / n
    # nothing moves at a null, and the n-th value forgets what was before it
    a = F.when(x.isNull(), 1.0).when(i <= n, 0.0).otherwise(1.0 - k)
    b = F.when(x.isNull() | (i < n), 0.0).when(i == n, first).otherwise(k * x)
    out = _recurrence(df, {"__v": (a, b)})
    return out.withColumn(name, F.when(i >= n, F.col("__v"))).drop("__i", "__sum", "__v")


def ema(df: DataFrame, n: int, name: str | None = None, seed: str = "close", column: str = "close") -> DataFrame:
    """Exponential mean with k = 2/(n+1) over the non-null values of a column.

    seed close: starts with the n-th value; seed sma: starts with the mean of the first n.
    """
    name = name or f"ema{n}"
    out = _smoothed(df, column, "__ema", n, 2.0 / (n + 1), seed)
    return out.withColumn(name, F.when(F.col(column).isNotNull(), F.col("__ema"))).drop("__ema")


def macd(df: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    df = ema(ema(df, fast, "__f"), slow, "__w").withColumn("macd", F.col("__f") - F.col("__w")).drop("__f", "__w")
    return ema(df, signal, "macd_signal", column="macd").withColumn("macd_hist", F.col("macd") - F.col("macd_signal"))


def macd_live(df: DataFrame) -> DataFrame:
    """The form that restarts each mean on the newest n closes and compares with the mean of the nine values before."""

    def window_ema(n: int) -> Column:
        k = 2.0 / (n + 1)
        closes = F.collect_list("close").over(last(n))
        return F.aggregate(F.slice(closes, 2, n), F.try_element_at(closes, F.lit(1)), lambda a, x: a + k * (x - a))

    df = df.withColumn("macd_live", warm(26, window_ema(12) - window_ema(26)))
    return df.withColumn("macd_live_signal", F.avg("macd_live").over(before(9)))


def atr(df: DataFrame, n: int = 14) -> DataFrame:
    """Wilder's mean of true ranges, seeded with the mean of the first n."""
    prior = F.lag("close").over(by())
    tr = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prior), F.abs(F.col("low") - prior))
    df = df.withColumn("tr", F.when(prior.isNotNull(), tr))
    return _smoothed(df, "tr", "atr", n, 1.0 / n, "sma")


def adx(df: DataFrame, n: int = 14) -> DataFrame:
    """Directional indicators and ADX: moves smoothed as Wilder's running sum over Wilder's mean range, ADX the mean of the newest n DX."""
    p = {c: F.lag(c).over(by()) for c in ("high", "low", "close")}
    up, down = F.col("high") - p["high"], p["low"] - F.col("low")
    df = (
        df.withColumn("pdm", F.when((up > down) & (up > 0), up).otherwise(0.0))
        .withColumn("mdm", F.when((down > up) & (down > 0), down).otherwise(0.0))
        .withColumn("tr", F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - p["close"]), F.abs(F.col("low") - p["close"])))
        .withColumn("__i", F.row_number().over(by()) - 1)
    )
    i = F.col("__i")
    x = {c: F.coalesce(F.when(i > 0, F.col(c)), F.lit(0.0)) for c in ("pdm", "mdm", "tr")}
    fade = F.when(i <= n, 1.0).otherwise(1.0 - 1.0 / n)  # plain sums until there are n moves
    mean = F.when(i < n, 1.0).when(i == n, 1.0 / n).otherwise(1.0 - 1.0 / n), F.when(i < n, x["tr"]).otherwise(x["tr"] / n)
    df = _recurrence(df, {"__p": (fade, x["pdm"]), "__m": (fade, x["mdm"]), "__t": mean})
    ready = (F.col("__i") >= n) & (F.col("__t") > 0)
    df = df.withColumn("di_plus", F.when(ready, 100 * F.col("__p") / F.col("__t")))
    df = df.withColumn("di_minus", F.when(ready, 100 * F.col("__m") / F.col("__t")))
    total = F.col("di_plus") + F.col("di_minus")
    df = df.withColumn("dx", F.when(total > 0, 100 * F.abs(F.col("di_plus") - F.col("di_minus")) / total))
    out = df.withColumn("adx", F.when(F.col("__i") >= 2 * n, F.avg("dx").over(last(n))))
    return out.drop("__p", "__m", "__t", "__i", "pdm", "mdm", "tr", "dx")


def regime(df: DataFrame) -> DataFrame:
    """volatile where recent volatility is half above its mean, else by the 20- and 50-bar means 1.5 % apart; unknown before 50 bars."""
    df = sma(sma(returns(df), 20), 50).withColumn("__v", F.stddev_samp("ret").over(last(20)))
    mean = F.avg("__v").over(by().rowsBetween(W.unboundedPreceding, 0))
    label = (
        F.when(F.col("sma50").isNull(), "unknown")
        .when(F.col("__v") > 1.5 * mean, "volatile")
        .when(F.col("sma20") > 1.015 * F.col("sma50"), "up")
        .when(F.col("sma20") < 0.985 * F.col("sma50"), "down")
        .otherwise("ranging")
    )
    return df.withColumn("regime", label).drop("__v")


def performance_at_end(df: DataFrame) -> DataFrame:
    """Per symbol the newest close and its change over one, four and nineteen bars, in percent."""
    change = {n: (F.try_divide("close", F.lag("close", n).over(by())) - 1) * 100 for n in (1, 4, 19)}
    df = df.select("symbol", "date", "close", *[c.alias(f"d{n}") for n, c in change.items()])
    newest = df.groupBy("symbol").agg(F.max_by(F.struct("close", "d1", "d4", "d19"), "date").alias("x"))
    return newest.select("symbol", "x.*")


def thin(df: DataFrame, most: int = 300) -> DataFrame:
    """Every k-th bar of a symbol, so that about most of them stay."""
    n = F.count("*").over(W.partitionBy("symbol"))
    place = F.row_number().over(by()) - 1
    step = F.greatest(F.lit(1), F.floor(F.col("__n") / most))
    return df.withColumn("__n", n).withColumn("__p", place).where(F.col("__p") % step == 0).drop("__n", "__p")


def reaction(df: DataFrame, events: DataFrame, key: str) -> DataFrame:
    """For events (key, symbol, on): the first bar on or after the day, the returns after 1, 2 and 5 bars (the last bar where they end), and volatility after over before."""
    df = returns(df).withColumn("i", F.row_number().over(by()))
    ahead = [F.coalesce(F.lead("close", n).over(by()), F.last("close").over(by().rowsBetween(0, W.unboundedFollowing))) for n in (1, 2, 5)]
    df = df.select(
        "symbol", "date", "close", *[(F.try_divide(a, F.col("close")) - 1).alias(f"r{n}") for a, n in zip(ahead, (1, 2, 5), strict=True)],
        F.try_divide(F.avg(F.abs("ret")).over(by().rowsBetween(1, 5)), F.avg(F.abs("ret")).over(before(10))).alias("spike"),
    )
    days = df.select("symbol", F.col("date").alias("day"), "date")
    # days meet bars, not events: a symbol's window holds each day once, however many events it has
    asked = events.select("symbol", "on").distinct()
    first = forward_as_of(asked, days, ["symbol"], "on", "day", "date").where("date IS NOT NULL")
    at = first.join(df, ["symbol", "date"])
    return events.select(key, "symbol", "on").join(at, ["symbol", "on"]).select("symbol", "date", key, "on", *df.columns[2:])
