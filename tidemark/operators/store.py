"""A stored graph that runs are merged into: nodes by (label, type), edges by (src, tgt, relation), and the runs that it holds."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.graph import merge_edges, merge_nodes
from tidemark.operators.knowledge import extract, sentence_links
from tidemark.session import settle

NODE = "label string, type string, confidence double, description string, seq long"
EDGE = "src string, tgt string, relation string, weight double, seq long"


class Graph(NamedTuple):
    """nodes: label, type, n, confidence, description; edges: src, src_type, tgt, tgt_type, relation, evidence, weight; runs: run."""

    nodes: DataFrame
    edges: DataFrame
    runs: DataFrame


def new(spark: SparkSession) -> Graph:
    return Graph(
        spark.createDataFrame([], "label string, type string, n long, confidence double, description string"),
        spark.createDataFrame([], "src string, src_type string, tgt string, tgt_type string, relation string, evidence long, weight double"),
        spark.createDataFrame([], "run string"),
    )


def save(graph: Graph, path: str) -> None:
    """Writes a version. The list of runs comes last: a folder without it is a version that was not finished, to be written again."""
    graph.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    graph.edges.write.mode("overwrite").parquet(f"{path}/edges")
    graph.runs.write.mode("overwrite").parquet(f"{path}/runs")


def load(spark: SparkSession, path: str) -> Graph:
    return Graph(*[spark.read.parquet(f"{path}/{name}") for name in Graph._fields])


def _ends(names: DataFrame, here: DataFrame, stored: DataFrame) -> DataFrame:
    """name -> label, type: as spelled among the run's nodes, then in any case there, then in any case among those stored; of equal ones the smallest."""
    ours = here.select("label", "type", F.lit(1).alias("place")).unionByName(stored.select("label", "type", F.lit(2).alias("place")))
    found = names.select("name", F.lower("name").alias("low")).join(ours.withColumn("low", F.lower("label")), "low")
    place = F.when((F.col("place") == 1) & (F.col("name") == F.col("label")), 0).otherwise(F.col("place"))
    best = found.groupBy("name").agg(F.min(F.struct(place.alias("place"), "label", "type")).alias("b"))
    return best.select("name", "b.label", "b.type")


def merge(graph: Graph, run: str, nodes: DataFrame, edges: DataFrame, most: float = 5.0, step: float = 0.1) -> Graph:
    """The graph with a run's nodes (NODE) and edges (EDGE) merged in; the same graph if it holds the run already.

    A node's row counts one up, keeps the highest confidence and the first
    description that is not empty (the stored one before the run's, within the run by seq).
    Labels are trimmed and cut to 200 characters; empty ones are dropped. An
    edge's ends are found among the run's nodes, then among those stored; edges
    with an end that neither holds, or from a node to itself, are dropped. An
    edge's first weight grows by step for each further row, up to most; a null weight is one.
    Nothing is changed in place: the caller saves the result as a new version.
    """
    if not graph.runs.where(F.col("run") == run).isEmpty():
        return graph
    label = F.substring(F.trim("label"), 1, 200)
    rows = nodes.select(label.alias("label"), "type", "confidence", "description", "seq").where("label <> '' AND type IS NOT NULL")
    here = settle(merge_nodes(rows))
    first = F.struct("turn", "description")
    both = graph.nodes.withColumn("turn", F.lit(0)).unionByName(here.withColumn("turn", F.lit(1)))
    merged = both.groupBy("label", "type").agg(
        F.sum("n").alias("n"), F.max("confidence").alias("confidence"), F.min(F.when(F.col("description") != "", first))["description"].alias("description")
    )
    e = edges.select(F.trim("src").alias("s"), F.trim("tgt").alias("t"), "relation", F.coalesce("weight", F.lit(1.0)).alias("weight"), "seq")
    e = settle(e)
    at = settle(_ends(e.select(F.col("s").alias("name")).union(e.select("t")).distinct(), here, graph.nodes))
    for name, end in (("s", "src"), ("t", "tgt")):
        e = e.join(at.select(F.col("name").alias(name), F.struct("label", "type").alias(end)), name)
    fresh = merge_edges(e, most, step).select("src.label", "src.type", "tgt.label", "tgt.type", "relation", "evidence", "weight").toDF(*graph.edges.columns)
    key = graph.edges.columns[:5]
    old = graph.edges.withColumnsRenamed({"evidence": "had", "weight": "was"})
    grown = F.least(F.lit(most), F.col("was") + step * F.coalesce("evidence", F.lit(0)))
    links = fresh.join(old, key, "full_outer").select(
        *key, (F.coalesce("had", F.lit(0)) + F.coalesce("evidence", F.lit(0))).alias("evidence"), F.when(F.col("had").isNull(), F.col("weight")).otherwise(grown).alias("weight")
    )
    runs = graph.runs.union(graph.runs.sparkSession.range(1).select(F.lit(run)))
    return Graph(settle(merged), settle(links), settle(runs))


def event_nodes(events: DataFrame, least: float = 5.0) -> DataFrame:
    """Nodes of events (id, country, category, severity) of at least that severity: the country, and the category in title case."""
    e = events.where(F.col("severity") >= least)
    country = e.where(F.length("country") > 1).select(
        F.col("country").alias("label"), F.lit("entity").alias("type"), F.lit(0.95).alias("confidence"), F.concat(F.lit("Country: "), "country").alias("description"), F.col("id").alias("seq")
    )
    category = e.where(F.length("category") > 2).select(
        F.initcap("category").alias("label"), F.lit("concept").alias("type"), F.lit(0.8).alias("confidence"), F.concat(F.lit("Event category: "), "category").alias("description"), F.col("id").alias("seq")
    )
    return country.unionByName(category)


def indicator_nodes(rows: DataFrame) -> DataFrame:
    """Nodes of indicators (name, value, previous, unit, country, category, seq): the newest reading as description; rows without name or value have none."""
    arrow = F.when(F.col("value") > F.col("previous"), "up").when(F.col("previous").isNotNull(), "down").otherwise("")
    text = F.concat("name", F.lit(": "), F.round("value", 2).cast("string"), F.lit(" "), F.coalesce("unit", F.lit("")), F.lit(" "), arrow, F.lit(" ("), F.coalesce("country", F.lit("Global")), F.lit(")"))
    kind = F.when(F.col("category").isin("economy", "finance"), "indicator").otherwise("concept")
    return rows.where("name <> '' AND value IS NOT NULL").select(F.substring("name", 1, 80).alias("label"), kind.alias("type"), F.lit(0.95).alias("confidence"), text.alias("description"), "seq")


def text_rows(df: DataFrame, key: str, text: Column, patterns: dict[str, str], cues: dict[str, str], link: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of texts for `merge`: a node a text and entity, an edge a link of a sentence (`knowledge.sentence_links`). Texts under 20 characters have none."""
    long_texts = df.where(F.length(F.trim(text)) >= 20)
    nodes = extract(long_texts, key, text, patterns).select(F.col("entity").alias("label"), F.col("kind").alias("type"), "confidence", F.lit("").alias("description"), F.col(key).cast("long").alias("seq"))
    edges = sentence_links(long_texts, key, text, link, cues).select("src", "tgt", "relation", F.lit(1.0).alias("weight"), F.struct(key, "sentence", "at").alias("seq"))
    return nodes, edges
