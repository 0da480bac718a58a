"""Operators against DuckDB SQL on the smallest tables, and formulas by hand."""

import os

import duckdb
import pandas as pd
import pytest

from tidemark.plans import catalog

catalog.load()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SOME = ["a4_country_heatmap", "a11_behaviour", "a23_early_warning", "s22_retention", "w3_ema_close", "w9_atr", "w4_rsi", "q1_performance", "w31_positions", "t7_keywords", "g15_propagate", "g11_components"]


def plain(df: pd.DataFrame) -> list[tuple]:
    def one(v):
        if v is None or v != v or v is pd.NaT:
            return None
        if isinstance(v, float):
            return round(v, 5)
        return str(v)[:19].removesuffix(" 00:00:00") if hasattr(v, "year") else v

    return sorted((tuple(map(one, r)) for r in df[sorted(df.columns)].astype(object).values.tolist()), key=str)


@pytest.mark.parametrize("name", SOME)
def test_against_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    got, want = catalog.QUERIES[name](spark, sf_dir).toPandas(), con.sql(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


def bars(spark, closes):
    rows = [("A", pd.Timestamp("2024-01-01").date() + pd.Timedelta(days=i), c, c + 1, c - 1, c, 10.0) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, "symbol string, date date, open double, high double, low double, close double, volume double")


def test_series_by_hand(spark):
    from tidemark.operators import series as S

    df = bars(spark, [1.0, 2.0, 4.0, 3.0])
    assert [r.sma2 for r in S.sma(df, 2).orderBy("date").collect()] == [None, 1.5, 3.0, 3.5]
    e = [r.ema2 for r in S.ema(df, 2).orderBy("date").collect()]
    assert e[:2] == [None, 2.0] and abs(e[2] - (2 + 2 / 3 * 2)) < 1e-12
    s = [r.ema2 for r in S.ema(df, 2, seed="sma").orderBy("date").collect()]
    assert s[1] == 1.5
    up = S.rsi(bars(spark, [float(i) for i in range(20)])).orderBy("date").collect()
    assert up[13].rsi is None and up[14].rsi == 100.0
    flat = S.stochastic(spark.createDataFrame([("A", r.date, 1.0, 1.0, 1.0, 1.0, 1.0) for r in bars(spark, [1.0] * 16).collect()], df.schema))
    assert [(r.stoch_k, r.williams) for r in flat.orderBy("date").collect()][-1] == (50.0, -50.0)


def test_positions_by_hand(spark):
    from tidemark.operators import ledger as L

    rows = [(1, 1, "BUY", 2.0, 10.0, 1), (1, 1, "BUY", 2.0, 20.0, 2), (1, 1, "SELL", 1.0, 18.0, 3), (1, 1, "BUY", 1.0, 5.0, 4), (2, 1, "SELL", 1.0, 5.0, 1)]
    t = spark.createDataFrame(rows, "bot int, symbol int, side string, qty double, price double, seq int")
    out = L.positions(t, ("seq",)).orderBy("bot", "seq").collect()
    assert [r.pnl for r in out] == [0.0, 0.0, 12.0, 0.0, 0.0] and out[3].avg_price == 5.0


def test_merge_and_components(spark):
    from tidemark.operators import graph as G

    e = spark.createDataFrame([("a", "b", "r", 1.0, 1), ("a", "b", "r", 9.0, 2), ("a", "a", "r", 1.0, 3)], "src string, tgt string, relation string, weight double, seq int")
    (m,) = G.merge_edges(e).collect()
    assert (m.evidence, round(m.weight, 6)) == (2, 1.1)
    g = spark.createDataFrame([("c", "b"), ("b", "a"), ("x", "y")], "src string, tgt string").selectExpr("*", "1.0D AS weight")
    assert {r.node: r.component for r in G.components(g).collect()} == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"}
    p = G.pagerank(g, 12).collect()
    assert abs(sum(r["rank"] for r in p) - 1) < 1e-9


def test_streams_equal_batch(spark, sf_dir, tmp_path):
    from pyspark.sql import functions as F

    from tidemark.sources import views as V
    from tidemark.streaming import jobs as J

    V.events(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp")).repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/in").schema).parquet(f"{tmp_path}/in")
    got = J.run_to_table(J.hourly(stream), "hourly_out", f"{tmp_path}/c1", "complete")
    want = J.hourly(spark.read.parquet(f"{tmp_path}/in"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    twice = stream.union(stream)
    assert J.run_to_table(J.new_only(twice), "new_out", f"{tmp_path}/c2").count() == spark.read.parquet(f"{tmp_path}/in").count()


def test_chunks(spark):
    from pyspark.sql import functions as F

    from tidemark.operators import text as T

    df = spark.createDataFrame([(1, "aaa\n\nbbb\n\n" + "c" * 10 + "\n\nd"), (2, "")], "id int, text string")
    out = [(r.id, r.chunk) for r in T.chunks(df, "id", F.col("text"), most=9).orderBy("id", "place").collect()]
    assert out == [(1, "aaa\n\nbbb"), (1, "c" * 10), (1, "d")]
