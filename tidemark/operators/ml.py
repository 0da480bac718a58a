"""Feature matrix over bars and MLlib models on it."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import series as S
from tidemark.session import settle

FEATURES = ("ret", "rsi", "bb_pct", "roc5", "roc20", "vol", "volume_ratio", "stoch_k", "drawdown")


def features(bars: DataFrame, warm_up: int = 60) -> DataFrame:
    """Features of every bar from the warm-up on (nulls are 0) and the label five bars ahead; nothing looks ahead but the label."""
    df = S.drawdown(S.stochastic(S.volume_ratio(S.volatility(S.momentum(S.bollinger(S.rsi(S.returns(bars))))))))
    df = S.label_ahead(df).withColumn("bar", F.row_number().over(S.by()))
    filled = [F.coalesce(F.nanvl(F.col(c), F.lit(0.0)), F.lit(0.0)).alias(c) for c in FEATURES]
    return df.where(F.col("bar") > warm_up).select("symbol", "date", "bar", *filled, "label")


def train_direction(matrix: DataFrame, trees: int = 80, depth: int = 4, seed: int = 7) -> PipelineModel:
    """Scaler and gradient-boosted trees on the first four fifths of each symbol's bars."""
    cut = matrix.groupBy("symbol").agg((F.max("bar") * 0.8).alias("cut"))
    train = settle(matrix.join(cut, "symbol").where("bar <= cut AND label IS NOT NULL"))  # each tree reads it more than once
    stages = [
        VectorAssembler(inputCols=list(FEATURES), outputCol="raw"),
        StandardScaler(inputCol="raw", outputCol="features", withMean=True),
        GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.08, subsamplingRate=0.8, minInstancesPerNode=10, seed=seed),
    ]
    return Pipeline(stages=stages).fit(train)


def direction_signals(model: PipelineModel, matrix: DataFrame, buy: float = 0.62, sell: float = 0.38) -> DataFrame:
    p = vector_to_array("probability")[1]
    out = model.transform(matrix).withColumn("p", p)
    act = F.when(F.col("p") >= buy, "BUY").when(F.col("p") <= sell, "SELL").otherwise("HOLD")
    return out.select("symbol", "date", F.round("p", 6).alias("p"), act.alias("action"))


def alert_relevance(rows: DataFrame, inputs: list[str], label: str = "label", seed: int = 7) -> PipelineModel:
    """A shallow tree with classes weighted to balance."""
    n = rows.groupBy(label).agg(F.count("*").alias("__n"))
    weighted = rows.join(F.broadcast(n), label).withColumn("weight", 1.0 / F.col("__n"))
    tree = DecisionTreeClassifier(labelCol=label, weightCol="weight", maxDepth=4, minInstancesPerNode=2, seed=seed)
    return Pipeline(stages=[VectorAssembler(inputCols=inputs, outputCol="features"), tree]).fit(weighted)


def relevance(samples: DataFrame, rows: DataFrame, owner: str, inputs: list[str], path: str, least: int = 15, neutral: float = 0.5) -> DataFrame:
    """rows with p, the probability that their owner opens them; neutral for owners without a history to learn from.

    samples: owner, inputs and label (1 opened, 0 not). An owner has a history
    with at least `least` samples, some opened and some not. All such owners
    share one tree, which also sees the share that each has opened; it is saved
    at path and read back. Null inputs count as 0.
    """
    mine = samples.where(F.col(owner).isNotNull() & F.col("label").isNotNull()).groupBy(owner).agg(F.count("*").alias("__n"), F.avg(F.col("label").cast("double")).alias("__rate"))
    mine = settle(mine.where((F.col("__n") >= least) & (F.col("__rate") > 0) & (F.col("__rate") < 1)).select(owner, "__rate"))
    if mine.isEmpty():
        return rows.withColumn("p", F.lit(neutral))
    filled = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in inputs}
    train = samples.join(mine, owner).select(*[x.alias(c) for c, x in filled.items()], "__rate", F.col("label").cast("int").alias("label"))
    alert_relevance(settle(train), [*inputs, "__rate"]).write().overwrite().save(path)
    known = rows.join(mine, owner, "left")
    ready = known.select(*rows.columns, "__rate", F.struct(*[F.col(c) for c in inputs]).alias("__given")).withColumns({**filled, "__known": F.col("__rate").isNotNull(), "__rate": F.coalesce("__rate", F.lit(0.0))})
    out = PipelineModel.load(path).transform(ready).withColumn("p", F.when(F.col("__known"), vector_to_array("probability")[1]).otherwise(neutral))
    return out.select(*[F.col("__given")[c].alias(c) if c in inputs else F.col(c) for c in rows.columns], "p")
