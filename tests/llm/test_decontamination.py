"""Decontamination against every window held to every place."""

import hashlib
import math
import re

import pytest

from tidemark.llm import decontamination as s

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(docs, items, size=s.WINDOW, containment=1.0, shingle=s.SHINGLE):
    windows = set()
    for i, t in items:
        w = words(t)
        n = min(size, len(w))
        windows |= {(tuple(w[a : a + n]), "" if i is None else str(i)) for a in range(len(w) - n + 1) if n}
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for win, item in windows:
            k = min(shingle, len(win))
            need = math.ceil(containment * (len(win) - k + 1) - 1e-9)
            for a in range(len(w) - len(win) + 1):
                if containment == 1 and w[a] != win[0]:
                    continue
                if sum(tuple(w[a + j : a + j + k]) == win[j : j + k] for j in range(len(win) - k + 1)) >= need:
                    hit |= set(range(a, a + len(win)))
                    found.add(item)
        out.append((i, len(w), len(hit), sorted(found), bool(hit)))
    return sorted(out, key=str)


def rows(df):
    return sorted(((r.doc_id, r.n_words, r.n_hit, r["items"], r.contaminated) for r in df.collect()), key=str)


LONG = " ".join(f"w{i}" for i in range(14))
ITEMS = [(1, LONG), (2, "Yes! NO"), (3, None), (4, "..."), (None, "w3 " * 12), (10, "b c d " + LONG), (2, "w5 w6 w7 é"), (5, "solo")]
DOCS = [
    (1, "x " + LONG.upper() + " y"), (1, "x " + LONG.upper() + " y"), (2, None), (3, ""), (None, "yes-no; no yes no"), (4, "w3 " * 30),
    (5, "w0 w1 w2 w3 w4 w5 w6 w7 w8 " * 3), (6, "solo"), (7, "yes"), (8, ("the " * 20000) + LONG), (9, "w0 w1 w2 w3 zz w5 w6 w7 w8 w9 w10"),
]


@pytest.mark.parametrize("containment", [1.0, 0.6])
@pytest.mark.parametrize("broadcast", [True, False])
def test_against_all_windows(spark, monkeypatch, containment, broadcast):
    if not broadcast:
        monkeypatch.setattr(s, "BROADCAST_BYTES", -1)
    docs = spark.createDataFrame([(*d, 0, "k") for d in DOCS], "doc_id long, text string, words int, wid string")
    items = spark.createDataFrame([(*i, 1) for i in ITEMS], "item_id long, text string, h int")
    got = rows(s.contamination(docs, items, containment=containment))
    assert got == brute(DOCS, ITEMS, containment=containment)
    assert (1, 16, 14 if containment == 1 else 15, ["1", "10"], True) in got
    assert rows(s.contamination(docs.limit(0), items)) == []
    assert rows(s.contamination(docs, items.limit(0))) == brute(DOCS, [])


@pytest.mark.parametrize("size,shingle", [(4, 2), (2, 3)])
def test_other_sizes(spark, size, shingle):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert rows(s.contamination(docs, items, size, 1.0, shingle)) == brute(DOCS, ITEMS, size, 1.0, shingle)


def test_a_hot_passage_in_many_items(spark):
    items = [(i, LONG + f" own{i} {i}") for i in range(60)]
    docs = [(i, f"a{i} " + LONG) for i in range(80)] + [(1000 + i, "w1 w2 w3 " * 20) for i in range(20)]
    got = s.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert rows(got) == brute(docs, items)


def test_query(spark, sf_dir):
    read = lambda t, key: [(r[key], r.text) for r in spark.read.parquet(f"{sf_dir}/{t}.parquet").collect()]
    want = brute(read("documents", "doc_id"), read("benchmark", "item_id"))
    got = sorted(tuple(r) for r in s.query(spark, sf_dir).collect())
    assert got == sorted((i, n, hit, len(x), hashlib.sha256(",".join(x).encode()).hexdigest(), bad) for i, n, hit, x, bad in want)
    assert any(r[-1] for r in got)


def test_no_python_in_the_plan(spark, sf_dir):
    plan = s.query(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
