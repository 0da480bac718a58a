"""Queries that start from the edge view make its rows once, not once for each side of a union or join."""

import pytest

from tidemark.plans import catalog

catalog.load()
from tidemark.plans import graph_q, paths_q  # noqa: E402


@pytest.mark.parametrize("name", ["g15_propagate", "g20_k_hop", "g13_sampled"])
def test_edges_are_made_once(spark, monkeypatch, name):
    n = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            n.add(b.num_rows)
            yield b

    rows = [(f"s{i}", f"n{j}", 60, 1.0 - 0.1 * ((i + j) % 3)) for i in range(5) for j in range(3)]
    df = spark.createDataFrame(rows, "src string, tgt string, n int, weight double")
    for module in (graph_q, paths_q):
        monkeypatch.setattr(module.V, "edges", lambda *_: df.mapInArrow(count, df.schema))
    assert catalog.QUERIES[name](spark, "").count() > 0
    assert n.value == 15
