"""Joins that enrich rows: containment, labels at both ends, latest values, tails of series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def contains_join(texts: DataFrame, text: str, terms: DataFrame, term: str) -> DataFrame:
    """Each row of texts with each row of terms whose term is a part of its text, in any case.

    An equi-join: a text's parts of the terms' lengths meet the terms, so the work grows with the texts and not with
    texts times terms. The lengths are as many as the longest term has characters at most.
    """
    lengths = sorted(r[0] for r in terms.select(F.length(term)).distinct().collect() if r[0])
    low = F.lower(text)

    def of_length(n: int) -> Column:
        all_parts = F.transform(F.sequence(F.lit(1), F.length(low) - (n - 1)), lambda i: F.substring(low, i, F.lit(n)))
        return F.when(F.length(low) >= n, all_parts).otherwise(F.array().cast("array<string>"))

    parts = F.array_distinct(F.flatten(F.array(*[of_length(n) for n in lengths])))
    found = texts.withColumn("__part", F.explode(parts if lengths else F.array().cast("array<string>")))
    return found.join(terms.withColumn("__part", F.lower(term)), "__part").drop("__part")


def with_labels(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Edges with the label of either end (labels: node, label)."""
    a = labels.select(F.col("node").alias("src"), F.col("label").alias("src_label"))
    b = labels.select(F.col("node").alias("tgt"), F.col("label").alias("tgt_label"))
    return edges.join(a, "src").join(b, "tgt")


def overlay(nodes: DataFrame, own: DataFrame, user: int, column: str = "note") -> DataFrame:
    """All nodes with what one user has put on them; null where nothing."""
    return nodes.join(own.where(F.col("user_id") == user).select("node", column), "node", "left")


def latest(df: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """The value of each key's last row."""
    return df.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias(name))


def resolve_latest(signals: DataFrame, prices: DataFrame, win: float = 0.0) -> DataFrame:
    """Signals (symbol, price) with the symbol's latest price (last_price), the change and whether it is a win; open without one."""
    change = F.try_divide(F.col("last_price") - F.col("price"), F.col("price"))
    state = F.when(F.col("change").isNull(), "open").when(F.col("change") > win, "win").otherwise("loss")
    return signals.join(prices, "symbol", "left").withColumn("change", change).withColumn("state", state)


def value_positions(positions: DataFrame, quotes: DataFrame) -> DataFrame:
    """Positions (symbol, qty, avg_price) valued at the quote (last_price), or at the average price where there is none."""
    price = F.coalesce("last_price", "avg_price")
    return positions.join(quotes, "symbol", "left").withColumn("value", F.col("qty") * price)


def align_tails(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last n rows of each key, n being the shortest key's number of rows."""
    shortest = df.groupBy(key).count().agg(F.min("count").alias("n"))
    rank = F.row_number().over(W.partitionBy(key).orderBy(F.desc(order)))
    return df.withColumn("rank", rank).join(F.broadcast(shortest), F.col("rank") <= F.col("n")).drop("rank", "n")  # one row


def index_hits(docs: DataFrame, key: str, text: str, query: list[str], least: int) -> DataFrame:
    """Documents that hold at least so many of the query's words, and how many: the index of words joined to its entries."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0)))
    index = docs.select(key, F.explode(words).alias("word"))
    hits = index.where(F.col("word").isin(query)).groupBy(key).agg(F.count("*").alias("hits")).where(F.col("hits") >= least)
    return docs.join(hits, key)


def top_matches(found: DataFrame, key: str, keyword: str, label: str, per: int = 2, total: int = 4) -> DataFrame:
    """Per key at most so many labels a keyword and in all, in order of keyword and label."""
    each = W.partitionBy(key, keyword).orderBy(label)
    of_all = W.partitionBy(key).orderBy(keyword, label)
    df = found.withColumn("__r", F.row_number().over(each)).where(F.col("__r") <= per)
    return df.withColumn("__t", F.row_number().over(of_all)).where(F.col("__t") <= total).drop("__r", "__t")
