"""Statistics per symbol over bars with returns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators import series as S
from tidemark.session import settle


def performance(df: DataFrame, periods: int = 252, rf: float = 0.05) -> DataFrame:
    """Annualised return and volatility, Sharpe, Sortino (999 without losses), Calmar (999 without drawdown)."""
    df = S.drawdown(S.returns(df))
    agg = df.groupBy("symbol").agg(
        F.count("ret").alias("n"),
        (F.avg("ret") * periods).alias("ann_return"),
        (F.stddev_samp("ret") * periods**0.5).alias("ann_vol"),
        (F.stddev_samp(F.when(F.col("ret") < 0, F.col("ret"))) * periods**0.5).alias("down"),
        F.min("drawdown").alias("max_drawdown"),
    )
    excess = F.col("ann_return") - rf
    return (
        agg.withColumn("sharpe", F.when(F.col("ann_vol") > 0, excess / F.col("ann_vol")).otherwise(0.0))
        .withColumn("sortino", F.when(F.col("down") > 0, excess / F.col("down")).otherwise(999.0))
        .withColumn("calmar", F.when(F.col("max_drawdown") < 0, F.col("ann_return") / -F.col("max_drawdown")).otherwise(999.0))
        .drop("down")
    )


def against(df: DataFrame, benchmark: str) -> DataFrame:
    """Beta, alpha, correlation and R2 of every symbol's returns on the benchmark's, by date."""
    r = S.returns(df).where("ret IS NOT NULL").select("symbol", "date", "ret")
    base = r.where(F.col("symbol") == benchmark).select("date", F.col("ret").alias("base"))
    return (
        r.where(F.col("symbol") != benchmark)
        .join(base, "date")
        .groupBy("symbol")
        .agg(
            F.regr_slope("ret", "base").alias("beta"),
            F.regr_intercept("ret", "base").alias("alpha"),
            F.corr("ret", "base").alias("corr"),
            F.regr_r2("ret", "base").alias("r2"),
        )
    )


def correlations(df: DataFrame) -> DataFrame:
    """Correlation of every pair of symbols (a < b) and its label."""
    r = S.returns(df).where("ret IS NOT NULL").select("symbol", "date", "ret")
    other = r.select(F.col("symbol").alias("b"), "date", F.col("ret").alias("rb"))
    c = r.join(other, "date").where("symbol < b").groupBy(F.col("symbol").alias("a"), "b").agg(F.corr("ret", "rb").alias("corr"))
    size = F.abs("corr")
    return c.withColumn("label", F.when(size >= 0.7, "strong").when(size >= 0.3, "moderate").otherwise("weak"))


def value_at_risk(df: DataFrame, level: float = 0.05) -> DataFrame:
    """The return at place floor(level * n) of the sorted returns (from 0; not interpolated)."""
    r = S.returns(df).where("ret IS NOT NULL")
    by = W.partitionBy("symbol")
    r = r.withColumn("place", F.row_number().over(by.orderBy("ret", "date"))).withColumn("n", F.count("*").over(by))
    return r.where(F.col("place") == F.floor(F.col("n") * level) + 1).select("symbol", F.col("ret").alias("var"))


def shape(df: DataFrame) -> DataFrame:
    """Skewness and excess kurtosis with the sample deviation in the denominator."""
    agg = S.returns(df).groupBy("symbol").agg(
        F.count("ret").alias("n"), F.skewness("ret").alias("s"), F.kurtosis("ret").alias("k")
    )
    ratio = (F.col("n") - 1) / F.col("n")
    return agg.select("symbol", (F.col("s") * F.pow(ratio, 1.5)).alias("skew"), ((F.col("k") + 3) * ratio * ratio - 3).alias("kurt"))


def portfolio(df: DataFrame, weights: DataFrame) -> DataFrame:
    """Value by date of a portfolio (symbol, weight; normalised) whose parts start at 100, over dates that all parts have.

    A part that starts at 0 has no value; neither has a portfolio with such a part, or with weights that add up to 0.
    """
    total, n = weights.agg(F.sum("weight"), F.count("*")).first()
    first = F.first("close").over(S.by().rowsBetween(W.unboundedPreceding, 0))
    parts = df.withColumn("norm", F.try_divide(100 * F.col("close"), first)).join(weights, "symbol")
    nav = parts.groupBy("date").agg(F.sum(F.col("norm") * F.col("weight")).alias("v"), F.count("norm").alias("parts"))
    return nav.where(F.col("parts") == n).select("date", F.try_divide("v", F.lit(total).cast("double")).alias("nav"))


def factor_regression(df: DataFrame, factors: list[str]) -> DataFrame:
    """Beta and R2 of every symbol's returns on each factor symbol's."""
    r = S.returns(df).where("ret IS NOT NULL").select("symbol", "date", "ret")
    f = r.where(F.col("symbol").isin(factors)).select(F.col("symbol").alias("factor"), "date", F.col("ret").alias("x"))
    both = r.join(f, "date").where(F.col("symbol") != F.col("factor"))
    return both.groupBy("symbol", "factor").agg(F.regr_slope("ret", "x").alias("beta"), F.regr_r2("ret", "x").alias("r2"))


def principal_components(df: DataFrame, k: int) -> DataFrame:
    """Each date's returns of all symbols (a column each; dates with all of them) standardised and projected on k components."""
    from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    r = settle(S.returns(df).where("ret IS NOT NULL").select("symbol", "date", "ret"))  # read again by every pass of the scaler and the components
    names = sorted(x.symbol for x in r.select("symbol").distinct().collect())  # the columns of the matrix
    wide = r.groupBy("date").pivot("symbol", names).agg(F.first("ret")).na.drop()
    for i, n in enumerate(names):
        wide = wide.withColumnRenamed(n, f"c{i}")
    rows = VectorAssembler(inputCols=[f"c{i}" for i in range(len(names))], outputCol="raw").transform(wide)
    rows = StandardScaler(inputCol="raw", outputCol="scaled", withMean=True).fit(rows).transform(rows)
    model = PCA(k=k, inputCol="scaled", outputCol="pc").fit(rows)
    share = model.explainedVariance.toArray()
    out = model.transform(rows).withColumn("p", vector_to_array("pc"))
    return out.select(
        "date", *[F.abs(F.col("p")[i]).alias(f"pc{i + 1}") for i in range(k)], *[F.lit(float(share[i] / share.sum())).alias(f"share{i + 1}") for i in range(k)]
    )
