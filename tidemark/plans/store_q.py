"""Queries on the stored graph: reference data, feeds of events and indicators, texts. Runs are replayed, and versions written and read."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators import store as S
from tidemark.plans.catalog import query
from tidemark.plans.knowledge_q import NAME
from tidemark.session import shared_path
from tidemark.sources import views as V

CUES = {"causes": "\\bthe\\b", "joins": "\\band\\b|\\bet\\b|\\bund\\b"}


def _kept(spark, graph):
    """The graph written as a version and read back."""
    path = shared_path(spark, "graph")
    S.save(graph, path)
    return S.load(spark, path)


def _seed(spark, d):
    """Regions, nations and suppliers with their memberships."""
    names = {n: V.table(spark, d, n) for n in ("region", "nation", "supplier")}
    row = lambda label, kind, text, key: (F.col(label).alias("label"), F.lit(kind).alias("type"), F.lit(0.98).alias("confidence"), text.alias("description"), F.col(key).cast("long").alias("seq"))
    nodes = names["region"].select(*row("r_name", "region", F.lit(""), "r_regionkey"))
    nodes = nodes.union(names["nation"].select(*row("n_name", "entity", F.lit(""), "n_nationkey")))
    nodes = nodes.union(names["supplier"].select(*row("s_name", "company", F.concat(F.lit("Balance "), F.floor("s_acctbal").cast("string")), "s_suppkey")))
    member = names["nation"].join(names["region"], F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("src"), F.lower("r_name").alias("tgt"), F.lit("part_of").alias("relation"), F.lit(1.0).alias("weight"), F.col("n_nationkey").cast("long").alias("seq"))
    based = names["supplier"].join(names["nation"], F.col("s_nationkey") == F.col("n_nationkey")).select("s_name", "n_name", F.lit("based_in"), F.lit(0.9), F.col("s_suppkey").cast("long"))
    return nodes, member.union(based)


@query("s27_seed", """SELECT s_name AS src, 'company' AS src_type, n_name AS tgt, 'entity' AS tgt_type, 'based_in' AS relation, 1::BIGINT AS evidence, 0.9::DOUBLE AS weight FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT n_name, 'entity', r_name, 'region', 'part_of', 1, 1.0::DOUBLE FROM nation JOIN region ON n_regionkey = r_regionkey""")
def seed(spark, d):
    """Seeded, written, read and seeded again: the second time changes nothing."""
    graph = _kept(spark, S.merge(S.new(spark), "seed", *_seed(spark, d)))
    return S.merge(graph, "seed", *_seed(spark, d)).edges.select("src", "src_type", "tgt", "tgt_type", "relation", "evidence", F.round("weight", 6).alias("weight"))


LAST = f"""{V.BAR_SQL}, lb AS (SELECT symbol, date, close, lag(close) OVER (PARTITION BY symbol ORDER BY date) AS previous, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS p FROM v_bar)"""


@query("g24_feeds", f"""WITH {V.EVENT_SQL}, {LAST}, a AS (SELECT r_name AS label, 'region' AS type, 0.98 AS confidence, NULL AS description, 0 AS turn FROM region UNION ALL SELECT n_name, 'entity', 0.98, NULL, 0 FROM nation
  UNION ALL SELECT s_name, 'company', 0.98, 'Balance ' || CAST(CAST(floor(s_acctbal) AS BIGINT) AS VARCHAR), 0 FROM supplier UNION ALL SELECT country, 'entity', 0.95, 'Country: ' || country, 1 FROM v_event WHERE severity >= 5
  UNION ALL SELECT upper(category[1]) || lower(category[2:]), 'concept', 0.8, 'Event category: ' || category, 1 FROM v_event WHERE severity >= 5
  UNION ALL SELECT symbol, 'indicator', 0.95, symbol || ': ' || CASE WHEN previous IS NULL THEN '' WHEN close > previous THEN 'up' ELSE 'down' END, 2 FROM lb WHERE p = 1)
  SELECT label, type, count(*) AS n, max(confidence)::DOUBLE AS confidence, arg_min(description, turn) FILTER (description <> '') AS description FROM a GROUP BY 1, 2""")
def feeds(spark, d):
    """Seed, then all events of severity 5 or more, then every symbol's newest close as an indicator; the feed of events comes twice."""
    graph = S.merge(S.new(spark), "seed", *_seed(spark, d))
    none = spark.createDataFrame([], S.EDGE)
    for _ in range(2):
        graph = S.merge(graph, "events", S.event_nodes(V.events(spark, d)), none)
    bars = V.bars(spark, d)
    bars = bars.withColumn("previous", F.lag("close").over(W.partitionBy("symbol").orderBy("date")))
    last = bars.groupBy("symbol").agg(F.max_by(F.struct("close", "previous"), "date").alias("x"))
    rows = last.select(F.col("symbol").alias("name"), F.col("x.close").alias("value"), F.col("x.previous").alias("previous"), F.lit("").alias("unit"), F.lit(None).cast("string").alias("country"), F.lit("finance").alias("category"), F.lit(0).cast("long").alias("seq"))
    graph = _kept(spark, S.merge(graph, "indicators", S.indicator_nodes(rows), none))
    # the reading itself is left out: engines print doubles differently
    plain = F.regexp_replace("description", r"^(.*: )[0-9.E]+ +(up|down|) \(Global\)$", "$1$2")
    return graph.nodes.select("label", "type", "n", "confidence", F.when(F.col("type") == "indicator", plain).otherwise(F.col("description")).alias("description"))


@query("g28_stored_graph")
def stored_graph(spark, d):
    """Links of all texts, merged in one run for each language; tests hold the merge against plain Python."""
    docs = V.documents(spark, d).withColumn("lang", F.coalesce("lang", F.lit("und")))
    graph = S.new(spark)
    for lang in [r.lang for r in docs.select("lang").distinct().orderBy("lang").collect()]:  # a run a language: a handful
        some = docs.where(F.col("lang") == lang)
        graph = S.merge(graph, lang, *S.text_rows(some, "doc_id", F.col("body"), {"name": NAME}, CUES, NAME))
    return graph.edges.select("src", "tgt", "relation", "evidence", F.round("weight", 6).alias("weight"))
