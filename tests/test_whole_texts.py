"""Queries without SQL over whole texts, on a small table whose texts say their piece late."""

import math
import re
from collections import Counter

import pytest

from tidemark.plans import catalog

catalog.load()
PAD = "Lorem ipsum dolor sit amet. " * 40


@pytest.fixture
def folder(spark, tmp_path):
    rows = [
        (1, PAD + "zebra zebra lion", "en", "a"),
        (2, PAD + "lion otter", "en", "a"),
        (3, PAD + "zebra otter otter", "en", "b"),
        (4, "short", "en", "b"),
    ]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path), rows


def test_profile_scores_use_words_behind_character_500(spark, folder):
    path, rows = folder
    got = {r.doc_id: r.score for r in catalog.QUERIES["t21_profile_scores"](spark, path).collect()}
    bags = {i: Counter(re.findall("[a-z]{3,}", t.lower())) for i, t, _, _ in rows}
    want = {}
    for source in "ab":
        own = [i for i, _, _, s in rows if s == source]
        df = Counter(w for i in own for w in bags[i])
        mean = Counter()
        for i in own:
            x = {w: (1 + math.log(n)) * (math.log((1 + len(own)) / (1 + df[w])) + 1) for w, n in bags[i].items()}
            norm = math.sqrt(sum(v * v for v in x.values()))
            for w, v in x.items():
                mean[w] += v / norm / len(own)
        profile = {w: round(v, 9) for w, v in mean.items()}  # fewer than 20 words
        for i in own:
            n = len(re.findall("[a-z]+", rows[i - 1][1].lower()))
            want[i] = min(1.0, sum(profile[w] for w in bags[i]) / math.log1p(n))
    assert set(got) == set(want) and all(abs(got[i] - want[i]) < 1e-6 for i in want)


def test_text_graph_links_behind_character_500(spark, tmp_path):
    rows = [(1, "pad it. " * 90 + "Zebra and Otter met.", "en", "a")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [(r.src, r.tgt, r.evidence) for r in catalog.QUERIES["g28_text_graph"](spark, str(tmp_path)).collect()]
    assert got == [("Zebra", "Otter", 1)]


def test_tfidf_gives_words_of_many_texts(spark, folder):
    path, rows = folder
    got = {(r.doc_id, r.term): r.w for r in catalog.QUERIES["t22_tfidf"](spark, path).collect()}
    more = spark.createDataFrame([(9, "dolor", "en", "a")], "doc_id long, text string, lang string, source string")
    more.write.mode("append").parquet(f"{path}/documents.parquet")
    again = {(r.doc_id, r.term): r.w for r in catalog.QUERIES["t22_tfidf"](spark, path).collect()}
    assert set(got) == {(i, w) for i, t, _, _ in rows for w in re.findall("[a-z]{3,}", t.lower())}
    assert set(again) == set(got) | {(9, "dolor")} and again[9, "dolor"] == 1.0  # dolor now stands in four texts
    for i, _, _, _ in rows:
        assert sum(w * w for (k, _), w in again.items() if k == i) == pytest.approx(1, abs=1e-4)


@pytest.mark.parametrize("name", ["t14_ranked", "t14_stemmed"])
def test_ranked_search_uses_words_behind_the_eighth(spark, folder, name):
    path, _ = folder
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    items = [("q1", "one two three four five six seven eight otter"), ("q2", "a b c d e f g h i j k")]
    spark.createDataFrame(items, "item_id string, text string").write.parquet(f"{path}/benchmark.parquet")
    got = {(r.query_id, r.place): r.doc_id for r in catalog.QUERIES[name](spark, path).collect()}
    assert got == {("q1", 1): 3, ("q1", 2): 2}
