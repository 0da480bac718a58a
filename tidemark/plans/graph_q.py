"""Queries over the supplier-nation graph and co-purchase pairs. Loops become one SQL step a round in the oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import graph as G
from tidemark.plans.catalog import query
from tidemark.session import settle
from tidemark.sources import views as V

E = f"WITH {V.EDGE_SQL}"
NODE = "node AS (SELECT src AS node FROM v_edge UNION SELECT tgt FROM v_edge)"
UND = "und AS (SELECT src, tgt, weight FROM v_edge UNION ALL SELECT tgt, src, weight FROM v_edge)"


def edges(spark, d):
    """A directed graph with edges both ways: suppliers to nations they serve, nations back to the suppliers of weight one."""
    e = settle(V.edges(spark, d).select("src", "tgt", "weight"))
    back = e.where("weight >= 0.9").select(F.col("tgt").alias("src"), F.col("src").alias("tgt"), (F.col("weight") / 2).alias("weight"))
    return e.union(back)


BOTH = f"""WITH {V.EDGE_SQL.replace('v_edge AS', 'base_edge AS')}, v_edge AS (SELECT src, tgt, weight FROM base_edge
  UNION ALL SELECT tgt, src, weight / 2 FROM base_edge WHERE weight >= 0.9)"""


@query("g0_edges", f"{E} SELECT src, tgt, n, round(weight, 6) AS weight FROM v_edge")
def edge_table(spark, d):
    return V.edges(spark, d).select("src", "tgt", "n", F.round("weight", 6).alias("weight"))


@query("g8_degrees", f"""{BOTH}, x AS (SELECT src AS node, 1 AS o, 0 AS i FROM v_edge UNION ALL SELECT tgt, 0, 1 FROM v_edge),
  g AS (SELECT node, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree FROM x GROUP BY node)
  SELECT node, out_degree, in_degree, out_degree + in_degree AS degree, round((out_degree + in_degree) / ((SELECT count(*) FROM g) - 1), 6) AS centrality FROM g""")
def degrees(spark, d):
    return G.degrees(edges(spark, d)).select("node", "out_degree", "in_degree", "degree", F.round("centrality", 6).alias("centrality"))


def _pagerank(rounds: int) -> str:
    steps = [f"""{BOTH}, {NODE}, tot AS (SELECT src, sum(abs(weight)) AS total FROM v_edge GROUP BY src),
      st AS (SELECT e.src, e.tgt, abs(e.weight) / total AS p FROM v_edge e JOIN tot USING (src)),
      ev AS (SELECT node, total IS NULL AS dang FROM node LEFT JOIN tot ON node = src), nn AS (SELECT count(*) AS n FROM ev),
      r0 AS (SELECT node, dang, 1.0::DOUBLE / n AS rank FROM ev, nn)"""]
    for i in range(rounds):
        steps.append(f"""g{i} AS (SELECT tgt, sum(rank * p) AS got FROM st JOIN r{i} ON src = node GROUP BY tgt),
          l{i} AS (SELECT coalesce(sum(rank), 0) AS lost FROM r{i} WHERE dang),
          r{i + 1} AS (SELECT node, dang, 0.15 / n + 0.85 * (coalesce(got, 0) + lost / n) AS rank FROM ev LEFT JOIN g{i} ON node = tgt, l{i}, nn)""")
    return ", ".join(steps) + f" SELECT node, round(rank, 9) AS rank FROM r{rounds}"


@query("g9_pagerank", _pagerank(8))
def pagerank(spark, d):
    return G.pagerank(edges(spark, d), 8).select("node", F.round("rank", 9).alias("rank"))


def _hits(rounds: int) -> str:
    steps = [f"{BOTH}, {NODE}, h0 AS (SELECT node, 1.0::DOUBLE AS hub FROM node)"]
    for i in range(rounds):
        steps.append(f"""a{i} AS (SELECT tgt AS node, sum(hub * weight) AS a FROM v_edge JOIN h{i} ON src = node GROUP BY 1),
          n{i} AS (SELECT node, a / sum(a) OVER () AS auth FROM a{i}), b{i} AS (SELECT src AS node, sum(auth * weight) AS b FROM v_edge JOIN n{i} ON tgt = node GROUP BY 1),
          h{i + 1} AS (SELECT node, b / sum(b) OVER () AS hub FROM b{i})""")
    return ", ".join(steps) + f""" SELECT coalesce(h.node, n.node) AS node, round(coalesce(hub, 0), 9) AS hub, round(coalesce(auth, 0), 9) AS auth
      FROM h{rounds} h FULL JOIN n{rounds - 1} n ON h.node = n.node"""


@query("g10_hits", _hits(3))
def hits(spark, d):
    return G.hits(edges(spark, d), 3).select("node", F.round("hub", 9).alias("hub"), F.round("auth", 9).alias("auth"))


UND_NEAR = f"{UND}, nb AS (SELECT src, tgt, weight, row_number() OVER (PARTITION BY src ORDER BY weight DESC, tgt) AS place FROM und)"


@query("g11_components", f"""WITH RECURSIVE {V.EDGE_SQL}, {UND_NEAR}, s AS (SELECT src, tgt FROM nb WHERE place = 1), u AS (SELECT src, tgt FROM s UNION SELECT tgt, src FROM s),
  reach(node, root) AS (SELECT src, src FROM u UNION SELECT u.tgt, reach.root FROM reach JOIN u ON reach.node = u.src)
  SELECT node, min(root) AS component FROM reach GROUP BY node""")
def components(spark, d):
    """Components of the graph in which every node keeps its strongest edge."""
    return G.components(G.neighbours(V.edges(spark, d), 1))


def _labels(rounds: int) -> str:
    steps = [f"{E}, {NODE}, {UND}, s0 AS (SELECT node, node AS label FROM node)"]
    for i in range(rounds):
        steps.append(f"""v{i} AS (SELECT src, label, round(sum(weight), 9) AS w FROM und JOIN s{i} ON tgt = node GROUP BY 1, 2),
          s{i + 1} AS (SELECT src AS node, label FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY w DESC, label) AS p FROM v{i}) WHERE p = 1)""")
    return ", ".join(steps) + f" SELECT node, label FROM s{rounds}"


@query("g12_label_propagation", _labels(3))
def labels(spark, d):
    return G.label_propagation(V.edges(spark, d), 3)


def _propagate(hops: int) -> str:
    steps = [f"{BOTH}, f0 AS (SELECT node AS seed, node, 9.0::DOUBLE AS impact, 0 AS hop FROM (SELECT DISTINCT src AS node FROM v_edge))"]
    for h in range(1, hops + 1):
        steps.append(f"""f{h} AS (SELECT seed, tgt AS node, max(impact * weight * 0.65) AS impact, {h} AS hop FROM f{h - 1} JOIN v_edge ON node = src
          WHERE impact * weight * 0.65 >= 0.1 GROUP BY 1, 2)""")
    every = " UNION ALL ".join(f"SELECT * FROM f{h}" for h in range(hops + 1))
    return ", ".join(steps) + f""", a AS ({every}) SELECT seed, node, round(max(impact), 6) AS impact, arg_max(hop, row(impact, -hop)) AS hop
      FROM a GROUP BY 1, 2 HAVING arg_max(hop, row(impact, -hop)) > 0"""


@query("g15_propagate", _propagate(4))
def propagate(spark, d):
    e = edges(spark, d)
    seeds = e.select(F.col("src").alias("seed"), F.col("src").alias("node"), F.lit(9.0).alias("impact")).distinct()
    return G.propagate(e, seeds).select("seed", "node", F.round("impact", 6).alias("impact"), "hop")


@query("g19_neighbours", f"{E}, {UND_NEAR} SELECT src, tgt, place FROM nb WHERE place <= 5")
def neighbours(spark, d):
    return G.neighbours(V.edges(spark, d), 5).select("src", "tgt", "place")


@query("g20_k_hop", f"""{E}, {UND_NEAR}, st AS (SELECT src, tgt FROM nb WHERE place <= 6), h0 AS (SELECT DISTINCT src AS seed, src AS node FROM v_edge),
  h1 AS (SELECT DISTINCT seed, tgt AS node FROM h0 JOIN st ON node = src), h2 AS (SELECT DISTINCT seed, tgt AS node FROM h1 JOIN st ON node = src),
  a AS (SELECT *, 0 AS hop FROM h0 UNION ALL SELECT *, 1 FROM h1 UNION ALL SELECT *, 2 FROM h2) SELECT seed, node, min(hop) AS hop FROM a GROUP BY 1, 2""")
def k_hop(spark, d):
    e = settle(V.edges(spark, d).select("src", "tgt", "weight"))
    seeds = e.select(F.col("src").alias("seed"), F.col("src").alias("node")).distinct()
    return G.k_hop(e, seeds, 2, 6)


@query("g21_induced", f"""{E}, {UND}, t AS (SELECT src AS node, sum(weight) AS w FROM und GROUP BY 1 ORDER BY round(w, 6) DESC, node LIMIT 40)
  SELECT src, tgt, round(weight, 6) AS weight FROM v_edge WHERE src IN (SELECT node FROM t) AND tgt IN (SELECT node FROM t)""")
def induced(spark, d):
    e = V.edges(spark, d)
    top = G.undirected(e).groupBy(F.col("src").alias("node")).agg(F.sum("weight").alias("w")).orderBy(F.desc(F.round("w", 6)), "node").limit(40)
    return G.induced(e, top).select("src", "tgt", F.round("weight", 6).alias("weight"))


@query("g3_merge_edges", """SELECT l_suppkey AS src, l_partkey AS tgt, l_returnflag AS relation, count(*) AS evidence,
  round(least(5.0, arg_min(l_discount, row(l_orderkey, l_linenumber, l_discount)) + 0.1 * (count(*) - 1)), 6) AS weight FROM lineitem
  WHERE l_suppkey <> l_partkey GROUP BY 1, 2, 3""")
def merge_edges(spark, d):
    li = V.table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("tgt"), F.col("l_returnflag").alias("relation"),
        F.col("l_discount").alias("weight"), F.struct("l_orderkey", "l_linenumber", "l_discount").alias("seq"),
    )
    return G.merge_edges(li).select("src", "tgt", "relation", "evidence", F.round("weight", 6).alias("weight"))


@query("g7_co_occurrence", """WITH m AS (SELECT DISTINCT l_orderkey, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey)
  SELECT x.p_brand AS a, y.p_brand AS b, count(*) AS n, round(least(1.0, count(*) / 1000), 6) AS weight FROM m x JOIN m y
  ON x.l_orderkey = y.l_orderkey AND x.p_brand < y.p_brand GROUP BY 1, 2""")
def co_occurrence(spark, d):
    m = V.table(spark, d, "lineitem").select("l_orderkey", "l_partkey").join(
        V.table(spark, d, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey")
    )
    return G.co_occurrence(m, "l_orderkey", "p_brand", 1000).select("a", "b", "n", F.round("weight", 6).alias("weight"))
