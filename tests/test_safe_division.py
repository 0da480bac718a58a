"""Zero prices, nulls and names with signs in them give nulls or nothing, never an error."""

import datetime as dt

from pyspark.sql import functions as F

from tidemark.operators import insight as I
from tidemark.operators import quant as Q
from tidemark.operators import rules as O
from tidemark.operators import series as S
from tidemark.operators import signals as X


def bars(spark, closes):
    rows = [(s, dt.date(2024, 1, 1) + dt.timedelta(days=i), x) for s, xs in closes.items() for i, x in enumerate(xs)]
    return spark.createDataFrame(rows, "symbol string, date date, close double")


def test_zero_prices(spark):
    df = bars(spark, {"A": [0.0, 2.0, 0.0, 4.0, 5.0], "B": [10.0, 20.0, None, 40.0, 30.0]})
    assert [r.action for r in X.momentum_sign(df.where("symbol = 'A'"), 1).orderBy("date").collect()] == ["HOLD", "HOLD", "SELL", "HOLD", "BUY"]
    got = {r.symbol: (r.close, r.d1, r.d4) for r in S.performance_at_end(df).collect()}
    assert got == {"A": (5.0, 25.0, None), "B": (30.0, -25.0, 200.0)}
    one = spark.createDataFrame([("B", 3.0)], "symbol string, weight double")
    assert [r.nav for r in Q.portfolio(df, one).orderBy("date").collect()] == [100.0, 200.0, 400.0, 300.0]
    assert Q.portfolio(df, spark.createDataFrame([("A", 1.0), ("B", 1.0)], one.schema)).count() == 0
    assert Q.portfolio(df, one.limit(0)).count() == 0


def test_names_with_signs(spark):
    df = spark.createDataFrame([(1, "A C++ (beta) job, c++x"), (2, None)], "id int, t string")
    got = {(r.entity, r["count"]) for r in O.graph_entities(df, "id", F.col("t"), {"skill": ["c++", "(beta)", "b.ta"]}).collect()}
    assert got == {("c++", 1), ("(beta)", 1)}


def test_forward_as_of(spark):
    left = spark.createDataFrame([("a", 1), ("a", 5), ("a", 9), ("b", 1)], "k string, t int")
    right = spark.createDataFrame([("a", 5, "five"), ("a", 7, "seven"), ("c", 1, "no")], "k string, u int, v string")
    got = {(r.k, r.t): r.v for r in I.forward_as_of(left, right, ["k"], "t", "u", "v").collect()}
    assert got == {("a", 1): "five", ("a", 5): "five", ("a", 9): None, ("b", 1): None}
