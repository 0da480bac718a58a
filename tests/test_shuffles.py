"""How often rows travel, by the plans of the queries' operators."""

import re

from pyspark.sql import functions as F

from tidemark.operators import digest as D
from tidemark.operators import ranking as R
from tidemark.operators import relations as N
from tidemark.operators import rules as O


def titles(spark, n=40):
    words = ["alpha", "betas", "gamma", "delta", "omega", "sigma", "kappa"]
    rows = [(i, " ".join(w for j, w in enumerate(words) if (i * 7 + j * j) % 5 != 0), "en" if i % 3 else None) for i in range(n)]
    return spark.createDataFrame(rows, "id int, title string, lang string")


def test_pairs_of_titles_do_not_travel(spark):
    df = titles(spark)
    out = D.title_groups(df, "id", F.col("title"), "lang", 0.6)
    assert "Aggregate" not in out._jdf.queryExecution().optimizedPlan().toString()  # no pair is made twice
    sets = {r.id: (r.lang, frozenset(r.title.split())) for r in df.collect()}
    first = {}
    for i in sorted(sets):
        first.setdefault(sets[i], i)
    want = {}
    for a, (la, x) in sets.items():
        for b, (lb, y) in sets.items():
            if a < b and la == lb and la:
                lone = first[la, x] == a and first[lb, y] == b
                if (x == y and first[la, x] == a) or (x != y and lone and len(x & y) / len(x | y) >= 0.6):
                    want[a, b] = len(x & y) / len(x | y)
    got = out.collect()
    assert {(r.a, r.b): r.jaccard for r in got} == want and len(got) == len(want)


def test_grams_travel_once_by_owner(spark):
    items = spark.createDataFrame([(i, f"big market word{i % 4}") for i in range(12)], "item int, text string")
    read = spark.createDataFrame([(o, i) for o in range(3) for i in range(12)], "owner int, item int")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = R.owner_profiles(read, items, [], least=1)
        assert len(re.findall(r"Exchange hashpartitioning\(owner#\d+, term#\d+", out._jdf.queryExecution().executedPlan().toString())) == 0
        assert out.count() > 0
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_words_of_profiles_are_counted_where_their_texts_are(spark):
    df = titles(spark).withColumnRenamed("lang", "source")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = D.profiles(df, "source", "id", F.col("title"), 3)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert not re.search(r"Exchange hashpartitioning\((source#\d+, )?id#\d+[^,]*, term#", plan)
    assert len(re.findall(r"Exchange hashpartitioning\(id#\d+", plan)) == 2  # texts, then weights


def test_words_of_an_index_travel_as_texts(spark, monkeypatch):
    plans, plain = [], R.settle
    monkeypatch.setattr(R, "settle", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or plain(df))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        ix = R.index(titles(spark), "id", F.col("title"), keep=["lang"])
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plans[0].count("Exchange") == 1 and "tf" in ix.postings.columns
    row = ix.stats.first()
    assert (row.docs, row.mean) == (40, sum(len(r.title.split()) for r in titles(spark).collect()) / 40)


def test_texts_travel_once_for_their_entities(spark):
    names = spark.createDataFrame([("alpha betas", "sector", "A"), ("gamma", "country", "G")], "term string, kind string, label string")
    firms = spark.createDataFrame([("NV", "Nv", None)], "symbol string, name string, sector string")
    df = titles(spark).withColumn("s", F.lit(4.0))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = N.normalised(df, "id", F.col("title"), F.col("lang"), F.col("s"), names, firms, ["Minister"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(re.findall(r"Exchange \w+partitioning", plan)) == 1


def test_texts_are_lowered_once_for_all_terms(spark):
    df = titles(spark)
    crises = O.crises(df, "id", F.col("title"), F.lit(8.0), {"A": (0.5, ["alpha", "gam"]), "B": (1.0, ["zz", "kappa"])})
    labels = D.label_hits(df, "id", F.col("title"), {"A": (["alpha", "gam"], 0.5), "B": (["zz", "kappa"], 1.0)})
    for out in (crises, labels):
        assert out._jdf.queryExecution().optimizedPlan().toString().count("lower(") == 1
    want = {(r.id, "A"): ("alpha" in r.title) + ("gam" in r.title) for r in df.collect()} | {(r.id, "B"): int("kappa" in r.title) for r in df.collect()}
    assert {(r.id, r.pattern): r.hits for r in crises.collect()} == {k: v for k, v in want.items() if v}
    assert {(r.id, r.label): r.hits for r in labels.collect()} == {k: v for k, v in want.items() if v}
