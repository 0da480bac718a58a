"""Records, exports and digests by hand-computed rows; nulls, empties and malformed input."""

import json
from datetime import datetime

from pyspark.sql import functions as F

from tidemark.operators import records as R


def test_codes_and_scales(spark):
    rows = [("193", -9.6), ("05", None), ("2", 10.0), ("", 0.0), (None, -10.0)]
    df = spark.createDataFrame(rows, "code string, scale double")
    got = [(r[0], r[1]) for r in df.select(R.action_category(F.col("code")), R.scale_severity(F.col("scale"))).collect()]
    assert got == [("CONFLICT", 9.8), ("ECONOMICS", 5.0), ("GEOPOLITICS", 1.0), ("GEOPOLITICS", 5.0), ("GEOPOLITICS", 10.0)]


def test_coin_quotes(spark):
    files = ['{"a": {"usd": 110.0, "usd_24h_change": 10.0}, "b": {"usd": 3.0, "usd_24h_change": -100.0}, "c": null}', "broken", None]
    df = spark.createDataFrame([(f,) for f in files], "value string")
    got = sorted((r.coin, r.value, r.previous, r.change_pct) for r in R.coin_quotes(df).collect())
    assert got == [("a", 110.0, 100.0, 10.0), ("b", 3.0, 3.0, -100.0)]


def test_earnings(spark):
    lines = ["X,2024-01-01,1.5", "Y,2024-01-02,n/a", "Z", "W, 2024-01-03 , 2", None, ""]
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "file int, at int, value string")
    got = [(r.symbol, r.date, r.eps, r.place) for r in R.earnings(df, "file", "at").orderBy("place").collect()]
    assert got == [("X", "2024-01-01", 1.5, 1), ("W", "2024-01-03", 2.0, 2)]


def test_latest_quotes(spark):
    rows = [("a", i, float(i)) for i in range(1, 13)] + [("b", 1, 5.0), ("b", 2, None), ("z", 1, 0.0), ("z", 2, 4.0)]
    got = {r.symbol: r for r in R.latest_quotes(spark.createDataFrame(rows, "symbol string, date int, close double")).collect()}
    assert got["a"].history == [float(i) for i in range(3, 13)] and got["a"].change_pct == 9.091 and got["a"].change_abs == 1.0
    assert (got["b"].price, got["b"].change_pct, got["b"].history) == (5.0, 0.0, [5.0])
    assert (got["z"].change_pct, got["z"].change_abs) == (0.0, 4.0)


def test_disclosures(spark):
    flat = [{"representative": "P", "ticker": " ab ", "type": "Sale", "transaction_date": "2024-01-01", "disclosure_date": "2024-01-31"},
            {"ticker": "--"}, {"ticker": "cd", "transaction_date": "?", "disclosure_date": "2024-01-31"}]
    nested = [{"senator": "Q", "transactions": [{"ticker": "x"}, {"ticker": "N/A"}, {}]}, {"senator": "R"}]
    make = lambda x: spark.createDataFrame([(json.dumps(r),) for r in x], "value string")
    got = sorted((r.chamber, r.name, r.ticker, r.transaction_type, r.disclosure_lag) for r in R.disclosures(make(flat), make(nested)).collect())
    assert got == [("house", "P", "AB", "sale", 30), ("house", "Unknown", "CD", "purchase", 0), ("senate", "Q", "X", "purchase", 0)]


def test_node_link(spark, tmp_path):
    nodes = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "x")], "id string, node_type string")
    edges = spark.createDataFrame([("a", "c", 0.5), ("c", "a", 0.05), ("b", "c", 1.0)], "src string, tgt string, weight double")
    n, e = R.node_link(nodes, edges, 0.1, ["x"])
    assert sorted((r.id, r.in_degree) for r in n.collect()) == [("a", 0), ("c", 1)]
    assert [(r.src, r.tgt) for r in e.collect()] == [("a", "c")]
    R.write_graph(n, e, str(tmp_path))
    assert spark.read.json(str(tmp_path / "nodes")).count() == 2


def test_digest_topics_and_portfolios(spark):
    rows = [(i, "ABCDE"[i % 5], 10.0 - i / 10) for i in range(30)]
    df = spark.createDataFrame(rows, "id int, category string, severity double").select("*", F.lit("t").alias("title"), F.lit("c").alias("country"))
    got = [(r.nth, r.category, r.place) for r in R.digest_lines(df).orderBy("nth", "place").collect()]
    assert got == [(n, c, p) for n, c in enumerate("ABCD", 1) for p in range(1, 4) if (c in "AB" or p < 3)]
    q = spark.createDataFrame([("Energy and oil",), ("zzz",), ("",), (None,)], "q string")
    topic, score = R.best_topic(F.col("q"), ["trade", "energy"])
    assert [tuple(r) for r in q.select(topic, F.coalesce(score, F.lit(0))).collect()] == [("energy", 1), (None, 0), (None, 0), (None, 0)]
    clients = spark.createDataFrame([("Moderate", 200.0), (None, 100.0)], "risk string, amount double")
    parts = R.model_portfolio(clients).groupBy("ticker").agg(F.sum("part").alias("p")).collect()
    assert {r.ticker: r.p for r in parts} == {"SPY": 90.0, "EFA": 45.0, "AGG": 75.0, "VNQ": 30.0, "GLD": 30.0, "SHV": 30.0}


def test_running_pairs_as_stream(spark, tmp_path):
    rows = [(["b", "a", "a"],), (["a", "b", "c"],), ([],), (None,)]
    table = spark.createDataFrame(rows, "nodes array<string>")
    want = {("a", "b"): 2, ("a", "c"): 1, ("b", "c"): 1}
    assert {(r.a, r.b): r.n for r in R.running_pairs(table, "nodes").collect()} == want
    table.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
    job = R.running_pairs(stream, "nodes").writeStream.outputMode("complete").format("memory").queryName("pairs_seen").trigger(availableNow=True).start()
    assert job.awaitTermination(60)
    assert {(r.a, r.b): r.n for r in spark.table("pairs_seen").collect()} == want


def test_labelled_signals(spark):
    rows = [("a", i, "BUY", "WIN", json.dumps({"x": i})) for i in range(4)] + [("a", 9, "HOLD", "WIN", "{}"), ("a", 8, "BUY", None, "{}")]
    rows += [("b", 1, "SELL", "LOSS", None), ("c", 1, "SELL", "LOSS", "broken"), ("c", 2, "SELL", "WIN", None)]
    df = spark.createDataFrame(rows, "symbol string, ts int, action string, outcome string, features string")
    got = R.labelled_signals(df, ["symbol"], [F.desc("ts")], 2, 3).orderBy("symbol", "ts").collect()
    assert [(r.symbol, r.ts, r.features) for r in got] == [("a", i, {"x": float(i)}) for i in (1, 2, 3)] + [("c", 1, {}), ("c", 2, {})]


def test_later_outcomes(spark):
    day = lambda d, h=0: datetime(2024, 1, d, h)
    signals = [(1, "a", "BUY", 100.0, day(1)), (2, "a", "SELL", 100.0, day(1, 1)), (3, "a", "BUY", 100.0, day(9)), (4, "b", "BUY", 0.0, day(1)), (5, "a", "HOLD", 1.0, day(1))]
    prices = [("a", 90.0, day(1, 5)), ("a", 101.0, day(2)), ("a", 99.8, day(2, 1)), ("a", 120.0, day(2, 2)), ("a", None, day(2, 1)), ("b", 5.0, day(5))]
    s = spark.createDataFrame(signals, "id int, symbol string, action string, price double, ts timestamp")
    p = spark.createDataFrame(prices, "symbol string, price double, ts timestamp")
    got = [(r.id, r.later, r.outcome) for r in R.later_outcomes(s, p).orderBy("id").collect()]
    assert got == [(1, 99.8, "NEUTRAL"), (2, 120.0, "LOSS"), (3, None, None), (4, 5.0, None)]


def test_later_outcomes_reads_a_symbol_once(spark):
    # a frame to a key's end is gone through again for every row
    n = 3000
    day = F.timestamp_seconds(F.col("id") * 60)
    s = spark.range(n).select("id", F.lit("a").alias("symbol"), F.lit("BUY").alias("action"), F.lit(1.0).alias("price"), day.alias("ts"))
    p = spark.range(n).select(F.lit("a").alias("symbol"), F.col("id").cast("double").alias("price"), day.alias("ts"))
    df = R.later_outcomes(s, p)
    assert "unboundedfollowing" not in df._jdf.queryExecution().toString().lower()
    assert {r.id: r.later for r in df.collect()} == {i: i + 1441.0 if i + 1441 < n else None for i in range(n)}
