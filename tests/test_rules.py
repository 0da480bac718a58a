"""Lookups, rules and grouping by hand-computed rows; nulls, empties, ties and zeros."""

import re
from datetime import datetime

from pyspark.sql import functions as F

from tidemark.operators import digest as D
from tidemark.operators import filters, insight, lookups, reports, rules, series
from tidemark.operators import text as T


def test_contains_join(spark):
    texts = spark.createDataFrame([(1, "North Asia"), (2, None), (3, ""), (4, "asia asia")], "id int, text string")
    terms = spark.createDataFrame([("asia",), ("NORTH",), ("x",)], "term string")
    got = sorted((r.id, r.term) for r in lookups.contains_join(texts, "text", terms, "term").collect())
    assert got == [(1, "NORTH"), (1, "asia"), (4, "asia")]
    assert lookups.contains_join(texts, "text", terms.limit(0), "term").count() == 0


def test_date_clusters(spark):
    hour = lambda h: datetime(2024, 1, 1 + h // 24, h % 24)
    rows = [(i, "a", hour(h), 1.0) for i, h in enumerate([0, 5, 11, 13, 20, 26, 60])] + [(9, "b", hour(3), 2.0)]
    df = spark.createDataFrame(rows, "id int, k string, ts timestamp_ntz, severity double")
    got = sorted((r.k, r.leader, r.n) for r in D.leader_groups(df, ["k"], 12).collect())
    assert got == [("a", 0, 3), ("a", 3, 2), ("a", 5, 1), ("a", 6, 1), ("b", 9, 1)]
    assert D.leader_groups(df.limit(0), ["k"], 12).count() == 0


def test_pairs_lose_none(spark):
    texts = ["alpha beta gamma", "alpha beta gamma delta", "beta beta", "", "omega psi chi"] + ["common words here"] * 6
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, body string")
    w = T.tfidf(df, "doc_id", F.col("body")).collect()
    of = {}
    for r in w:
        of.setdefault(r.doc_id, {})[r.term] = r.w
    want = {(a, b) for a in of for b in of if a < b and sum(x * of[b].get(t, 0) for t, x in of[a].items()) >= 0.25}
    got = {(r.a, r.b) for r in T.similar_pairs(T.tfidf(df, "doc_id", F.col("body")), "doc_id", 0.25).collect()}
    assert got == want and len(got) >= 16
    titles = df.withColumn("lang", F.lit("en"))
    pairs = {(r.a, r.b) for r in D.title_groups(titles, "doc_id", F.col("body"), "lang", 0.6).collect()}
    assert pairs == {(0, 1), *((5, i) for i in range(6, 11))}


def test_pairs_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(T, "BLOCK", 4)
    monkeypatch.setattr(T, "STEP", 50)
    texts = [" ".join(f"{'abcdefg'[(i * 3 + j) % 7]}ord" for j in range(i % 5)) + " same text" for i in range(40)] + ["alone", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, body string")
    w = T.tfidf(df, "doc_id", F.col("body"))
    of = {}
    for r in w.collect():
        of.setdefault(r.doc_id, {})[r.term] = r.w
    want = {(a, b): x for a in of for b in of if a < b and (x := sum(v * of[b].get(t, 0) for t, v in of[a].items())) >= 0.4}
    pairs = T.similar_pairs(w, "doc_id", 0.4)
    assert "unboundedfollowing" not in pairs._jdf.queryExecution().toString().lower()
    got = {(r.a, r.b): r.cosine for r in pairs.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want) and len(got) > 100
    assert T.similar_pairs(w.limit(0), "doc_id", 0.4).count() == 0


def test_twins_and_zeros(spark):
    at = datetime(2024, 1, 1)
    left = spark.createDataFrame([(1, at), (1, at)], "k int, ts timestamp_ntz")
    assert [r.n_within for r in insight.within(left, left, "k", "ts", "ts", 5).collect()] == [2, 2]
    bars = spark.createDataFrame([("s", i, 0.0, 0.0) for i in range(30)], "symbol string, date int, close double, volume double")
    assert series.returns(bars).where("ret IS NOT NULL").count() == 0
    assert series.volume_ratio(series.momentum(bars)).count() == 30
    zero = spark.createDataFrame([([0.0], [1.0])], "a array<double>, b array<double>")
    assert zero.select(T.cosine(F.col("a"), F.col("b"))).first()[0] is None
    assert reports.signal_stats(bars.withColumn("c", F.lit(None).cast("double")), ["symbol"], "c").first().win_rate is None


def test_tone_and_filters(spark):
    df = spark.createDataFrame([(1, "war and crash"), (2, "peace deal"), (3, None), (4, "nothing")], "id int, body string")
    rows = {r.id: r for r in rules.tone(df, F.coalesce("body", F.lit("")), ["peace", "deal"], ["war", "crash"], ["may"], ["crash"]).collect()}
    assert rows[1].score == -0.8 and rows[1].intensity == "High" and rows[1].market_stress == 0.2
    assert rows[2].tone == "Positive" and rows[3].tone == rows[4].tone == "Neutral"
    assert sorted(r.id for r in filters.unenriched(df, "body", ["id"], 5).collect()) == [3]


def test_similar_to_breaks_near_ties_by_key(spark):
    # equal but for the last bits of a sum: the smaller key comes first
    rows = [(0, "x", 1.0), (7, "x", 0.5 + 1e-14), (3, "x", 0.5), (5, "x", 0.6), (9, "y", 1.0)]
    w = spark.createDataFrame(rows, "doc_id int, term string, weight double")
    seeds = spark.createDataFrame([(0,)], "doc_id int")
    got = rules.similar_to(w, "doc_id", seeds, 0.25, 2).collect()
    assert sorted((r["rank"], r.doc_id) for r in got) == [(1, 5), (2, 3)]


def test_topic_vector_reads_words_once(spark):
    df = spark.createDataFrame([(1, "a a b"), (2, "x"), (3, None), (4, "")], "id int, body string")
    out = df.select("id", T.topic_vector(F.col("body"), [["a"], ["b", "c"]]).alias("v"))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
    got = {r.id: r.v for r in out.collect()}
    assert got[1] == [0.8944, 0.4472] and got[2] == got[3] == got[4] == [0.0, 0.0]


def test_keywords_move_texts_only(spark):
    df = spark.createDataFrame([(1, "Alpha", "beta beta alpha"), (1, "beta", ""), (2, "gamma", None), (3, "x", "y")], "id int, title string, body string")
    out = T.keywords(df.repartition(3), "id", F.col("title"), F.coalesce("body", F.lit("")), 2)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert sorted(tuple(r) for r in out.collect()) == [(1, "alpha", 3, 2), (1, "beta", 4, 1), (2, "gamma", 2, 1)]


def test_tfidf_counts_where_texts_are(spark):
    df = spark.createDataFrame([(1, "alpha beta beta"), (2, "beta"), (3, None)], "doc_id int, body string")
    w = T.tfidf(df, "doc_id", F.col("body"))
    plan = w._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(doc_id#\d+, term#\d+", plan)
    assert {(r.doc_id, r.term, r.df) for r in w.collect()} == {(1, "alpha", 1), (1, "beta", 2), (2, "beta", 2)}
