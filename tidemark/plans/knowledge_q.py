"""Queries over extracted entities and the graph questions that need rounds."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import graph as G
from tidemark.operators import knowledge as N
from tidemark.plans.catalog import query
from tidemark.plans.graph_q import BOTH, edges
from tidemark.sources import views as V

TERMS = [("license", "legal"), ("password", "risk"), ("thing", "noun"), ("leau", "noun"), ("token", "risk"), ("rights", "legal")]
D = f"WITH {V.DOC_SQL}"
NAME = "[A-Z][a-z]{4,}"
GAZ = f"""gz(term, kind) AS (VALUES {', '.join(str(t) for t in TERMS)}), w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9$]+')) AS term,
  generate_subscripts(regexp_extract_all(lower(text), '[a-z0-9$]+'), 1) - 1 AS pos FROM documents),
  f AS (SELECT doc_id, term, kind, count(*) AS n, min(pos) AS pos FROM w JOIN gz USING (term) GROUP BY 1, 2, 3)"""


def _gazetteer(spark, d):
    names = spark.createDataFrame(TERMS, "term string, kind string")
    return N.gazetteer(V.table(spark, d, "documents"), "doc_id", F.col("text"), names)


@query("j21_gazetteer", f"""WITH {GAZ} SELECT doc_id, term, kind, n, CAST(pos AS INTEGER) AS "at" FROM f""")
def gazetteer(spark, d):
    return _gazetteer(spark, d)


@query("t12_salience", f"""WITH {GAZ}, s AS (SELECT doc_id, term, pos, least(1.0, 0.6 * least(1.0, n / 5) + CASE WHEN pos < 20 THEN 0.2 ELSE 0 END) AS s FROM f),
  p AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, pos) AS place FROM s) SELECT doc_id, term, round(s, 6) AS salience, place FROM p WHERE place <= 8""")
def salience(spark, d):
    return N.salience(_gazetteer(spark, d), "doc_id").select("doc_id", "term", F.round("salience", 6).alias("salience"), "place")


@query("t28_extract", f"""{D}, x AS (SELECT doc_id, 'name' AS kind, unnest(regexp_extract_all(body, '{NAME}')) AS entity FROM v_doc UNION ALL
  SELECT doc_id, 'number', unnest(regexp_extract_all(body, '[0-9]{{2,}}')) FROM v_doc), g AS (SELECT doc_id, kind, entity, count(*) AS mentions FROM x GROUP BY 1, 2, 3)
  SELECT doc_id, kind, entity, mentions, round(least(1.0, 0.4 + 0.15 * mentions), 6) AS confidence FROM g""")
def extract(spark, d):
    df = N.extract(V.documents(spark, d), "doc_id", F.col("body"), {"name": NAME, "number": "[0-9]{2,}"})
    return df.select("doc_id", "kind", "entity", "mentions", F.round("confidence", 6).alias("confidence"))


@query("g28_text_graph")
def text_graph(spark, d):
    cues = {"causes": "\\bthe\\b", "joins": "\\band\\b|\\bet\\b|\\bund\\b"}
    return N.text_graph(V.documents(spark, d), "doc_id", F.col("body"), NAME, cues)


@query("g14_criticality", f"""{BOTH}, x AS (SELECT src AS node, 1 AS o, 0 AS i, weight AS w FROM v_edge UNION ALL SELECT tgt, 0, 1, weight FROM v_edge),
  g AS (SELECT node, sum(o) AS o, sum(i) AS i, sum(w) AS w FROM x GROUP BY node) SELECT node, round(0.4 * o / (SELECT max(o) FROM g) + 0.3 * i / (SELECT max(i) FROM g)
  + 0.3 * w / (SELECT max(w) FROM g), 6) AS score FROM g ORDER BY round(0.4 * o / (SELECT max(o) FROM g) + 0.3 * i / (SELECT max(i) FROM g) + 0.3 * w / (SELECT max(w) FROM g), 9) DESC, node LIMIT 20""")
def criticality(spark, d):
    e = edges(spark, d)
    both = e.select(F.col("src").alias("node"), "weight").union(e.select("tgt", "weight"))
    n = G.degrees(e).join(both.groupBy("node").agg(F.sum("weight").alias("total")), "node")
    return N.criticality(n, {"out_degree": 0.4, "in_degree": 0.3, "total": 0.3}, 20).select("node", F.round("score", 6).alias("score"))


@query("g5_conflicts", """WITH p AS (SELECT l_suppkey AS src, l_partkey % 100 AS tgt, l_returnflag AS relation, max(l_discount) AS weight, max(l_tax) AS confidence, count(*) AS sources,
  min(l_orderkey) AS seq FROM lineitem GROUP BY 1, 2, 3) SELECT src, tgt, relation, round(weight, 6) AS weight, round(confidence, 6) AS confidence, sources FROM (SELECT *,
  row_number() OVER (PARTITION BY src, tgt ORDER BY weight DESC, seq, relation) AS p FROM p) WHERE p = 1""")
def conflicts(spark, d):
    li = V.table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("src"), (F.col("l_partkey") % 100).alias("tgt"), F.col("l_returnflag").alias("relation"),
        F.col("l_discount").alias("weight"), F.col("l_tax").alias("confidence"), F.lit(1).alias("n"), F.col("l_orderkey").alias("seq"),
    )
    df = N.resolve_conflicts(li)
    return df.select("src", "tgt", "relation", F.round("weight", 6).alias("weight"), F.round("confidence", 6).alias("confidence"), "sources")


@query("g16_cascade", f"""{BOTH}, s AS (SELECT 's1' AS node, 2.0 AS strength UNION ALL SELECT 's2', 1.5), c1 AS (SELECT tgt AS node, max(strength * weight) AS strength FROM s JOIN v_edge ON node = src
  WHERE strength * weight >= 0.4 AND tgt NOT IN ('s1', 's2') GROUP BY 1), c2 AS (SELECT tgt AS node, max(strength * weight * 0.7) AS strength FROM c1 JOIN v_edge ON node = src
  WHERE strength * weight * 0.7 >= 0.4 AND tgt NOT IN ('s1', 's2') GROUP BY 1), a AS (SELECT *, 1 AS hop FROM c1 UNION ALL SELECT *, 2 FROM c2)
  SELECT node, round(max(strength), 6) AS strength, min(hop) AS hop FROM a GROUP BY node""")
def cascade(spark, d):
    seeds = spark.createDataFrame([("s1", 2.0), ("s2", 1.5)], "node string, strength double")
    return N.cascade(edges(spark, d), seeds).select("node", F.round("strength", 6).alias("strength"), "hop")


@query("g18_paths", f"""{BOTH}, p3 AS (SELECT 's1>' || a.tgt || '>' || b.tgt || '>' || c.tgt AS path, a.weight + b.weight + c.weight AS weight, 4 AS n FROM v_edge a JOIN v_edge b ON a.tgt = b.src
  JOIN v_edge c ON b.tgt = c.src WHERE a.src = 's1' AND c.tgt = 'n3' AND b.tgt <> 's1' AND a.tgt <> 'n3' AND b.tgt <> 'n3'), p1 AS (SELECT 's1>n3' AS path, weight, 2 AS n FROM v_edge WHERE src = 's1' AND tgt = 'n3'),
  al AS (SELECT * FROM p3 UNION ALL SELECT * FROM p1) SELECT 's1' AS a, 'n3' AS b, place, path, round(weight, 6) AS weight FROM (SELECT *, row_number() OVER (ORDER BY round(weight, 9) DESC, n, path) AS place FROM al) WHERE place <= 5""")
def paths(spark, d):
    pairs = spark.createDataFrame([("s1", "n3")], "a string, b string")
    return N.paths(edges(spark, d), pairs, 3, 5).select("a", "b", "place", "path", F.round("weight", 6).alias("weight"))
