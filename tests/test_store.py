"""Merges into a stored graph against a plain dictionary; replays, ends that only the store knows, versions."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import store as S

RUNS = {
    "one": (
        [("Oil", "thing", 0.5, "", 2), ("Oil", "thing", 0.7, "second", 3), ("Oil", "thing", 0.6, "first", 1), (" Gold ", "thing", None, None, 1), ("", "thing", 1.0, "x", 1), (None, "thing", 1.0, "x", 1), ("Gold", None, 1.0, "x", 1)],
        [("Oil", "gold", "moves", 0.4, 2), ("oil", "Gold", "moves", 0.9, 1), ("Oil", "Oil", "moves", 1.0, 3), ("Oil", "Tin", "moves", 1.0, 4), ("Oil", None, "moves", 1.0, 5)],
    ),
    "two": (
        [("Tin", "thing", 0.2, "tin", 1), ("OIL", "firm", 0.9, "a firm", 1), ("Oil", "thing", 0.1, "later", 1)],
        [("oil", "tin", "moves", None, 1), ("OIL", "GOLD", "owns", 4.95, 1), ("OIL", "GOLD", "owns", 9.0, 2), ("Oil", "Gold", "moves", 3.0, 1)],
    ),
}


def rows(graph):
    nodes = {(r.label, r.type): (r.n, r.confidence, r.description) for r in graph.nodes.collect()}
    edges = {(r.src, r.src_type, r.tgt, r.tgt_type, r.relation): (r.evidence, pytest.approx(r.weight)) for r in graph.edges.collect()}
    return nodes, edges


def add(spark, graph, run):
    nodes, edges = RUNS[run]
    return S.merge(graph, run, spark.createDataFrame(nodes, S.NODE), spark.createDataFrame(edges, S.EDGE))


def test_runs_replays_and_versions(spark, tmp_path):
    one = add(spark, S.new(spark), "one")
    nodes = {("Oil", "thing"): (3, 0.7, "first"), ("Gold", "thing"): (1, None, None)}
    edges = {("Oil", "thing", "Gold", "thing", "moves"): (2, pytest.approx(1.0))}
    assert rows(one) == (nodes, edges)
    S.save(one, str(tmp_path / "v1"))
    two = add(spark, S.load(spark, str(tmp_path / "v1")), "two")
    nodes |= {("Oil", "thing"): (4, 0.7, "first"), ("Tin", "thing"): (1, 0.2, "tin"), ("OIL", "firm"): (1, 0.9, "a firm")}
    # "oil" is neither spelling: the smaller label of the run; "GOLD" is known to the store only
    edges = {
        ("Oil", "thing", "Gold", "thing", "moves"): (3, pytest.approx(1.1)),
        ("OIL", "firm", "Tin", "thing", "moves"): (1, pytest.approx(1.0)),
        ("OIL", "firm", "Gold", "thing", "owns"): (2, pytest.approx(5.0)),
    }
    assert rows(two) == (nodes, edges)
    S.save(two, str(tmp_path / "v2"))
    again = add(spark, add(spark, S.load(spark, str(tmp_path / "v2")), "two"), "one")
    assert rows(again) == (nodes, edges) and sorted(r.run for r in again.runs.collect()) == ["one", "two"]


def test_feeds(spark):
    events = spark.createDataFrame([(1, "PERU", "WAR", 6.0), (2, "PERU", "XX", 9.0), (3, "CHAD", "WAR", 4.9), (4, None, None, 7.0)], "id long, country string, category string, severity double")
    got = {(r.label, r.type): (r.confidence, r.description, r.seq) for r in S.event_nodes(events).where("seq < 2").collect()}
    assert got == {("PERU", "entity"): (0.95, "Country: PERU", 1), ("War", "concept"): (0.8, "Event category: WAR", 1)}
    assert S.event_nodes(events).count() == 3
    ind = [("CPI", 3.125, 3.0, "%", "US", "economy", 1), ("Mood", 1.0, None, None, None, "press", 2), ("CPI", None, 1.0, "", "", "economy", 3), (None, 1.0, 1.0, "", "", "economy", 4)]
    df = spark.createDataFrame(ind, "name string, value double, previous double, unit string, country string, category string, seq long")
    assert [tuple(r)[:4] for r in S.indicator_nodes(df).collect()] == [("CPI", "indicator", 0.95, "CPI: 3.13 % up (US)"), ("Mood", "concept", 0.95, "Mood: 1.0   (Global)")]


def test_texts(spark):
    df = spark.createDataFrame([(1, "Alpha and Betas run. Alpha, Gamma."), (2, "Alpha"), (3, None), (4, "Gamma met the Alpha here.")], "doc long, text string")
    nodes, edges = S.text_rows(df, "doc", F.col("text"), {"name": "[A-Z][a-z]{4,}"}, {"joins": "\\band\\b"}, "[A-Z][a-z]{4,}")
    graph = S.merge(S.new(spark), "texts", nodes, edges)
    assert rows(graph)[0] == {("Alpha", "name"): (2, 0.7, None), ("Betas", "name"): (1, 0.55, None), ("Gamma", "name"): (2, 0.55, None)}
    assert {(k[0], k[2], k[4]): v[0] for k, v in rows(graph)[1].items()} == {("Alpha", "Betas", "joins"): 1, ("Alpha", "Gamma", "related"): 1, ("Gamma", "Alpha", "related"): 1}
