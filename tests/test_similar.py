"""Cosines by blocks of packed texts: against all pairs, and what travels."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import rules
from tidemark.operators import text as T


@pytest.fixture
def weights(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choices(["thing", "said", "été", "many words", *[f"w{'abcdefghij'[i % 10]}{'klmnop'[i % 6]}" for i in range(60)]], k=rng.randrange(12))) for _ in range(70)]
    df = spark.createDataFrame(list(enumerate([*texts, texts[3], texts[3]])), "doc_id long, body string")
    w = T.tfidf(df, "doc_id", F.col("body")).localCheckpoint()
    of = {}
    for r in w.collect():
        of.setdefault(r.doc_id, {})[r.term] = r.w
    return w, {(a, b): sum(v * of[b].get(t, 0) for t, v in of[a].items()) for a in of for b in of if a != b}


def settled(monkeypatch):
    seen, plain = [], T.settle

    def settle(df):
        out = plain(df)
        seen.append(out.count())
        return out

    monkeypatch.setattr(T, "settle", settle)
    return seen


@pytest.mark.parametrize("block, step, columns", [(10_000, 4_000_000, 1024), (9, 40, 2), (9, 40, 0)])
def test_likest_of_seeds(weights, monkeypatch, block, step, columns):
    w, cosine = weights
    monkeypatch.setattr(T, "BLOCK", block), monkeypatch.setattr(T, "STEP", step), monkeypatch.setattr(T, "COLUMNS", columns)
    seen = settled(monkeypatch)
    seeds = w.select("doc_id").distinct().where("doc_id % 3 = 0")
    out = rules.similar_to(w.select("doc_id", "term", F.col("w").alias("weight")), "doc_id", seeds, 0.25, 4)
    got = {(r.seed, r["rank"]): (r.doc_id, pytest.approx(r.similarity, abs=1e-12)) for r in out.collect()}
    want = {}
    for s in {a for a, _ in cosine if a % 3 == 0}:
        best = sorted((-round(c, 9), b, c) for (a, b), c in cosine.items() if a == s and c >= 0.25)[:4]
        want |= {(s, i + 1): (b, c) for i, (_, b, c) in enumerate(best)}
    assert got == want and len(want) > 40
    assert seen and max(seen) <= 72  # a row a text travels, not one a word or a pair
    assert "term" not in out._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("block, step, columns", [(10_000, 4_000_000, 1024), (9, 40, 2)])
def test_pairs_travel_as_texts(weights, monkeypatch, block, step, columns):
    w, cosine = weights
    monkeypatch.setattr(T, "BLOCK", block), monkeypatch.setattr(T, "STEP", step), monkeypatch.setattr(T, "COLUMNS", columns)
    seen = settled(monkeypatch)
    got = {(r.a, r.b): r.cosine for r in T.similar_pairs(w, "doc_id", 0.3).collect()}
    assert got == pytest.approx({k: c for k, c in cosine.items() if k[0] < k[1] and c >= 0.3}, abs=1e-12) and len(got) > 50
    assert seen and max(seen) <= 72
