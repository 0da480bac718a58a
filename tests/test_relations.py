"""Relationships, canonical entities, terms of several words and leader groups against plain Python."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import knowledge as N
from tidemark.operators import leaders as L
from tidemark.operators import relations as R

DAY = dt.datetime(2024, 1, 1)


def groups(times, span):
    out, lead = {}, None
    for s in sorted(times):
        if lead is None or s - lead > span:
            lead = s
        out[s] = lead
    return out


@pytest.mark.parametrize("span", [1, 7, 1000])
def test_leaders_against_a_fold(spark, span):
    rng = random.Random(span)
    rows = [(k, c, rng.randint(-300, 300)) for k, c in (("a", "x"), ("a", None), (None, "x")) for _ in range(80)]
    rows += [("dense", "x", i) for i in range(400)] + [("far", "x", i * 10**12) for i in range(5)] + [("one", "x", 5)] * 3 + [("none", "x", None)]
    df = spark.createDataFrame(rows, "k string, c string, s long").withColumn("ts", F.timestamp_micros("s"))
    got = {(r.k, r.c, r.s): r.lead for r in L.with_leader(df, ["k", "c"], "ts", span).collect()}
    keys = {}
    for k, c, s in rows:
        keys.setdefault((k, c), set()).add(s)
    for (k, c), times in keys.items():
        want = groups(times - {None}, span)
        assert {s: got[k, c, s] for s in times} == want | ({None: None} if None in times else {})


def test_leaders_of_nothing(spark):
    df = spark.createDataFrame([], "k string, ts timestamp")
    assert L.with_leader(df, ["k"], "ts", 5).count() == 0


def test_one_key_with_many_rows(spark):
    df = spark.range(100_000).select(F.lit("k").alias("k"), F.timestamp_micros(F.col("id") * 60_000_000).alias("ts"))
    out = L.with_leader(df, ["k"], "ts", 12 * 3_600_000_000)
    assert out.select("lead").distinct().count() == math.ceil(100_000 / 721)


def brute_relations(events, hours=120, most=50, top=5, least=0.25):
    width, out = hours * 3_600_000_000, {}
    e = [(i, int((ts - dt.datetime(1970, 1, 1)).total_seconds() * 10**6), c, k, s, v) for i, ts, c, k, s, v in events if ts and v and any(v)]
    by = {}
    for x in e:
        by.setdefault(x[1] // width, []).append(x)
    best = {b: sorted(xs, key=lambda x: (-(x[4] or 0), x[0]))[:most] for b, xs in by.items()}
    for x in e:
        b = x[1] // width
        found = []
        for y in (y for d in (-1, 0, 1) for y in best.get(b + d, [])):
            if y[0] != x[0] and abs(y[1] - x[1]) <= width:
                sim = round(sum(p * q for p, q in zip(x[5], y[5])) / math.hypot(*x[5]) / math.hypot(*y[5]), 9)
                if sim > least:
                    found.append((-sim, y[0], y))
        for place, (sim, t, y) in enumerate(sorted(found, key=lambda f: f[:2])[:top], 1):
            h = abs(y[1] - x[1]) / 3_600_000_000
            near, same = x[2] is not None and x[2] == y[2] != "XX", x[3] is not None and x[3] == y[3]
            kind, share = (
                ("hierarchical", 0.9) if near and same and h < 48 else ("causal", 0.75) if near and h < 72 and y[4] >= 6.5
                else ("correlated", 0.8) if -sim > 0.6 and h < 120 else ("temporal", 0.65) if h < 12 and same else ("correlated", 0.5)
            )
            out[x[0], t] = (place, kind, -sim * share)
    return out


def test_relationships(spark):
    rng = random.Random(1)
    events = [
        (i, DAY + dt.timedelta(minutes=rng.randint(0, 20_000)), rng.choice(["A", "B", "XX", None]), rng.choice("xy"), rng.randint(1, 10) * 1.0, [rng.gauss(0.3, 1) for _ in range(4)])
        for i in range(150)
    ]
    events += [(900, None, "A", "x", 9.0, [1.0] * 4), (901, DAY, "A", "x", 9.0, None), (902, DAY, "A", None, 9.0, [0.0] * 4), (903, DAY, "A", None, 9.0, [1.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame([(*e, 1) for e in events], "id int, ts timestamp, country string, category string, severity double, v array<double>, b int")
    got = R.relationships(df, "id", "v", hours=60, most=20)
    rows = {(r.id, r.target): (r.place, r.rel_type, r.weight) for r in got.collect()}
    want = brute_relations(events, 60, 20)
    assert rows.keys() == want.keys() and all(rows[k][:2] == want[k][:2] and abs(rows[k][2] - want[k][2]) < 6e-4 for k in want)
    assert {x[1] for x in rows.values()} == {"hierarchical", "causal", "correlated", "temporal"}
    edges = {(r.a, r.b): r.rel_type for r in R.undirected(got, "id").collect()}
    assert edges.keys() == {tuple(sorted(k)) for k in rows}
    assert R.relationships(df.limit(0), "id", "v").count() == 0


def test_relationships_of_one_hot_bucket(spark, monkeypatch):
    # slices of a bucket, vectors of several lengths, and equal cosines, which stand by key
    monkeypatch.setattr(R, "SLICE", 9)
    rng = random.Random(2)
    events = [(i, DAY + dt.timedelta(minutes=i), "A", "x", rng.randint(1, 3) * 1.0, rng.choice([[1.0, 0.0], [1.0, 1.0], [2.0, 2.0], [0.5, 0.1, 3.0]])) for i in range(100)]
    df = spark.createDataFrame([*events, (200, DAY, "A", "x", 9.0, [None, 1.0])], "id int, ts timestamp, country string, category string, severity double, v array<double>")
    got = R.relationships(df, "id", "v", most=30)
    assert "FlatMapCoGroupsInArrow" in got._jdf.queryExecution().toString()
    want = brute_relations([e for e in events if len(e[5]) == 2], most=30)
    few = {(r.id, r.target): r.place for r in R.relationships(df.where("size(v) = 2"), "id", "v", most=30).collect()}
    assert few == {k: v[0] for k, v in want.items()} and len(few) > 300
    size = {e[0]: len(e[5]) for e in events}
    assert all(size[r.id] == size[r.target] for r in got.collect())


def test_terms_of_several_words(spark):
    names = spark.createDataFrame(
        [("United Arab Emirates", "country"), ("emirates", "firm"), ("arab", "people"), ("new york", "place"), ("york times", "paper"), ("a", "x"), ("a", "y"), ("...", "none")],
        "term string, kind string",
    )
    docs = spark.createDataFrame([(1, "The UNITED  Arab-Emirates, new York Times"), (2, None), (3, ""), (4, "a arab a"), (5, "emirates " * 3000)], "id int, t string")
    got = sorted((r.id, r.at, r.size, r.term, r.kind) for r in N.spans(docs.where("id < 5"), "id", F.col("t"), names).collect())
    assert got == [
        (1, 1, 3, "United Arab Emirates", "country"), (1, 4, 2, "new york", "place"), (1, 5, 2, "york times", "paper"),
        (4, 0, 1, "a", "x"), (4, 0, 1, "a", "y"), (4, 1, 1, "arab", "people"), (4, 2, 1, "a", "x"), (4, 2, 1, "a", "y"),
    ]
    assert N.spans(docs, "id", F.col("t"), names).where("id = 5").count() == 3000
    assert N.spans(docs, "id", F.col("t"), names.limit(0)).count() == 0 and N.spans(docs.limit(0), "id", F.col("t"), names).count() == 0


def test_entities_by_precedence(spark):
    names = spark.createDataFrame(
        [("france", "country", "FR"), ("semi conductors", "sector", "Chips"), ("crude oil", "commodity", "Oil"), ("oil", "sector", "Energy"), ("ada king", "person", "Ada King")],
        "term string, kind string, label string",
    )
    firms = spark.createDataFrame([("NV", "Nv Corp", "Chips"), ("ZZ", "Zz", None)], "symbol string, name string, sector string")
    text = "France: crude oil and $NV, ZZ and nv; semi conductors. Minister Ada King met Governor Bo Low"
    docs = spark.createDataFrame([(1, text, "FR", 4.0), (2, text, "XX", 20.0), (3, None, None, None)], "id int, t string, c string, s double")
    out = R.normalised(docs, "id", F.col("t"), F.col("c"), F.col("s"), names, firms, ["Minister", "Governor"])
    got = {(r.id, r.node): (r.node_type, r.label, r.confidence, r.salience) for r in out.collect()}
    both = {
        "company:NV": ("company", "NV (Nv Corp)", 0.95), "company:ZZ": ("company", "ZZ (Zz)", 0.95), "sector:Chips": ("sector", "Chips", 0.95),
        "commodity:Oil": ("commodity", "Oil", 0.88), "person:Ada_King": ("person", "Ada King", 0.9), "person:Bo_Low": ("person", "Bo Low", 0.78),
    }
    assert {k: v[:3] for k, v in got.items()} == {(i, n): v for i in (1, 2) for n, v in both.items()} | {
        (1, "country:FR"): ("country", "FR", 1.0), (2, "country:FR"): ("country", "FR", 0.85)
    }
    assert got[1, "company:NV"][3] == 0.5 and got[2, "company:NV"][3] == 1.0 and got[1, "country:FR"][3] == 0.4
