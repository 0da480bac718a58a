"""Connected components of a long chain."""

from tidemark.operators import graph as G


def test_a_chain_of_many_edges_is_one_component(spark):
    rows = [(f"n{i:03}", f"n{i + 1:03}") for i in range(120)] + [("x", "y"), ("z", "z")]
    got = {r.node: r.component for r in G.components(spark.createDataFrame(rows, "src string, tgt string")).collect()}
    assert got == {**{f"n{i:03}": "n000" for i in range(121)}, "x": "x", "y": "x", "z": "z"}
