"""Impacts, places, dependency edges, stated measures and pairs, composite scores, and streams of late rows and changes."""

import datetime as dt

from pyspark.sql import functions as F

from tidemark.operators import impacts as I
from tidemark.streaming import jobs as J

TEXT = "Oil prices reached 1,250 bps today. Growth of 3.5% held.\nHigh rates Caused weak demand, and Rain led to floods; 7 Cold winds lowered 5 yields. x of 9"


def test_measures_and_pairs_by_clause(spark):
    docs = spark.createDataFrame([(1, TEXT), (2, None), (3, ""), (4, TEXT), (5, "word led of 1 " * 10000), (6, "Trade deficit hit 12B, was 3")], "id int, t string")
    got = {(r.id, r.clause, r.at, r.name, r.value, r.unit) for r in I.measures(docs, "id", F.col("t")).where("id <> 5").collect()}
    assert I.measures(docs.where("id = 5"), "id", F.col("t")).count() == 10000
    assert got == {(i, *x) for i in (1, 4) for x in ((0, 3, "Oil prices", "1250", "bps"), (1, 2, "Growth", "3.5", "%"))} | {(6, 0, 3, "Trade deficit", "12", "B")}
    got = {(r.id, r.clause, r.src, r.tgt) for r in I.stated_pairs(docs, "id", F.col("t"), I.CAUSES, "causes", 1.2).collect()}
    want = {(2, "High rates", "weak demand"), (3, "and Rain", "floods")}  # "lowered 5" has no words behind it
    assert got == {(i, *x) for i in (1, 4) for x in want}
    assert I.measures(docs.limit(0), "id", F.col("t")).count() == 0 and I.stated_pairs(docs.limit(0), "id", F.col("t"), I.CAUSES, "c", 1.0).count() == 0


def test_the_longer_verb_and_the_first_one(spark):
    docs = spark.createDataFrame([(1, "cold rain led to floods that led to panic"), (2, "led to floods caused panic selling")], "id int, t string")
    got = {(r.id, r.src, r.tgt) for r in I.stated_pairs(docs, "id", F.col("t"), ["led", "led to", "caused"], "causes", 1.0).collect()}
    assert got == {(1, "cold rain", "floods that led to panic"), (2, "led to floods", "panic selling")}


def test_factor_impacts_and_places(spark):
    e = spark.createDataFrame([(1, "A", 10.0), (2, "A", 1.0), (3, "A", None), (4, "B", 5.0), (5, None, 5.0)], "id int, category string, severity double")
    f = spark.createDataFrame([("A", "Gold", "c", 1, 0.35), ("A", "Air", "e", -1, 0.45)], "category string, instrument string, type string, sign int, base double")
    out = {(r.id, r.instrument): r for r in I.factor_impacts(e, f).collect()}
    assert len(out) == 6
    x = out[1, "Gold"]
    assert (x.short_magnitude, x.long_magnitude, x.direction, x.short_move, x.long_move) == (10, 8, "positive", 5.2, 2.8)
    assert (out[2, "Air"].short_magnitude, out[2, "Air"].long_magnitude) == (4, 2)  # 4.5 goes to the even 4
    c = spark.createDataFrame([(1, "fr"), (2, "zz"), (3, None)], "id int, code string")
    known = spark.createDataFrame([("FR", "France", 46.2, 2.2)], "code string, name string, lat double, lon double")
    assert {r.id: (r["name"], r.lat) for r in I.places(c, "code", known).collect()} == {1: ("France", 46.2), 2: ("zz", 0.0), 3: (None, 0.0)}


def test_pairs_count_as_they_come(spark):
    ents = spark.createDataFrame([(e, k, n, a) for e in (1, 2) for k, n, a in (("country", "country:x", 0), ("asset", "asset:y", 1), ("asset", "asset:y", 1))], "event int, kind string, node string, at int")
    ev = spark.createDataFrame([(1, "CLICK", 9.0), (2, "CLICK", 2.0)], "event int, category string, severity double")
    pairs = I.entity_pairs(ents, ev, "event")
    assert [(r.event, r.src, r.tgt, r.seen) for r in pairs.orderBy("event").collect()] == [(1, "country:x", "asset:y", 1), (2, "country:x", "asset:y", 2)]
    rules = spark.createDataFrame([("CLICK", "country", "asset", "macro", 0.5)], "category string, src_kind string, tgt_kind string, relation string, factor double")
    edges = I.dependency_edges(pairs, rules, F.lit(0.0), F.lit(0.0)).collect()
    assert sorted(r.event for r in edges) == [1, 1, 2] and {r.relation for r in edges} == {"macro"}  # the weak event gives no second edge


def test_composite_of_missing_groups(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0, 400), ("b", None, -1.0, 100), ("c", None, None, 0)], "symbol string, technical double, momentum double, n int")
    out = {r.symbol: (r.composite, r.confidence, r.action) for r in I.composite(df, F.col("n")).collect()}
    assert out == {"a": (0.5, 1.0, "BUY"), "b": (-0.2, 0.5, "SELL"), "c": (0.0, 0.0, "HOLD")}


def test_late_rows_and_changes(spark, tmp_path):
    day = dt.datetime(2024, 1, 10)
    files = [[(1, day), (2, day - dt.timedelta(days=9))], [(3, day - dt.timedelta(days=3)), (4, day - dt.timedelta(hours=5)), (5, None)]]
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, "id int, ts timestamp").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("id int, ts timestamp").parquet(f"{tmp_path}/in")
        J.split_late(stream, f"{tmp_path}/ok", f"{tmp_path}/late", f"{tmp_path}/c1")
        counts = stream.groupBy(F.col("id") > 2).agg(F.count("*").alias("n"))
        J.push_changes(counts, f"{tmp_path}/push", f"{tmp_path}/c2")
    assert {r.id for r in spark.read.parquet(f"{tmp_path}/ok").collect()} == {1, 2, 4, 5}
    assert {r.id for r in spark.read.parquet(f"{tmp_path}/late").collect()} == {3}
    pushed = [(r.batch, r.n) for r in spark.read.parquet(f"{tmp_path}/push").collect()]
    assert sorted(pushed) == [(0, 2), (1, 3)]  # the second batch changes only its own group
