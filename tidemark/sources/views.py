"""Domain views (events, activity, bars, trades, documents, edges) over the plain tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, ts, user_id, category, severity (1..10), country, region, k of every event."""
    e = table(spark, sf_dir, "events")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, sf_dir, "nation").join(
        table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    return (
        e.join(customer, F.col("user_id") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("event_id").alias("id"),
            "ts",
            "user_id",
            F.upper("event_type").alias("category"),
            F.least(F.lit(10.0), F.greatest(F.lit(1.0), F.col("value") / 25)).alias("severity"),
            F.col("n_name").alias("country"),
            F.col("r_name").alias("region"),
            F.get_json_object("props", "$.k").cast("long").alias("k"),
        )
    )


EVENT_SQL = """v_event AS (
  SELECT e.event_id AS id, e.ts, e.user_id, upper(e.event_type) AS category,
         least(10.0::DOUBLE, greatest(1.0::DOUBLE, e.value / 25)) AS severity, n.n_name AS country, r.r_name AS region,
         CAST(json_extract_string(e.props, '$.k') AS BIGINT) AS k
  FROM events e JOIN customer c ON e.user_id = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey
)"""


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, action, detail (item number) and created_at of every event."""
    return table(spark, sf_dir, "events").select(
        "user_id",
        F.col("event_type").alias("action"),
        F.get_json_object("props", "$.k").cast("long").alias("detail"),
        F.col("ts").alias("created_at"),
    )


ACTIVITY_SQL = """v_activity AS (
  SELECT user_id, event_type AS action, CAST(json_extract_string(props, '$.k') AS BIGINT) AS detail, ts AS created_at
  FROM events
)"""


#: Lines of a task that joins lines with orders, about.
TASK_LINES = 500_000


def tasks(line: DataFrame, rows: int = TASK_LINES) -> int | None:
    """Tasks of so many lines, where they are more than the session's number of partitions."""
    n = line.count() // rows
    return n if n > int(line.sparkSession.conf.get("spark.sql.shuffle.partitions")) else None


def with_orders(line: DataFrame, orders: DataFrame, rows: int = TASK_LINES) -> DataFrame:
    """Lines with their order. Tables too large for the session's number of partitions are dealt into more, so a task's memory does not grow with them."""
    n = tasks(line, rows)
    if n is not None:
        line, orders = line.repartition(n, "l_orderkey"), orders.repartition(n, "o_orderkey")
    return line.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))


def bars(spark: SparkSession, sf_dir: str, bucket: str = "week") -> DataFrame:
    """Open, high, low, close and volume by symbol (part brand) and time bucket."""
    line = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"
    )
    ticks = (
        with_orders(line, table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"))
        .join(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
        .select(
            F.col("p_brand").alias("symbol"),
            F.date_trunc(bucket, "o_orderdate").cast("date").alias("date"),
            (F.col("l_extendedprice") / F.col("l_quantity")).alias("px"),
            F.col("l_quantity").alias("qty"),
            F.struct("o_orderdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("seq"),
        )
    )
    return bars_of(ticks)


def bars_of(ticks: DataFrame) -> DataFrame:
    """Bars from ticks (symbol, date, px, qty, seq: the order within a bar)."""
    return ticks.groupBy("symbol", "date").agg(
        F.min_by("px", "seq").alias("open"),
        F.max("px").alias("high"),
        F.min("px").alias("low"),
        F.max_by("px", "seq").alias("close"),
        F.sum("qty").alias("volume"),
    )


BAR_SQL = """tick AS (
  SELECT p_brand AS symbol, CAST(date_trunc('week', o_orderdate) AS DATE) AS date, l_extendedprice / l_quantity AS px,
         l_quantity AS qty, row(o_orderdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS seq
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
), v_bar AS (
  SELECT symbol, date, arg_min(px, seq) AS open, max(px) AS high, min(px) AS low, arg_max(px, seq) AS close,
         sum(qty) AS volume FROM tick GROUP BY symbol, date
)"""


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bot, symbol, side, qty, price and the order key of every trade."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("bot"),
        (F.col("l_partkey") % 50).alias("symbol"),
        F.when(F.col("l_returnflag") == "R", "SELL").otherwise("BUY").alias("side"),
        F.col("l_quantity").alias("qty"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_shipdate").alias("executed_at"),
        "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice",
    )


TRADE_SQL = """v_trade AS (
  SELECT l_suppkey AS bot, l_partkey % 50 AS symbol, CASE WHEN l_returnflag = 'R' THEN 'SELL' ELSE 'BUY' END AS side,
         l_quantity AS qty, l_extendedprice / l_quantity AS price, l_shipdate AS executed_at, l_orderkey, l_linenumber,
         l_partkey, l_extendedprice
  FROM lineitem
)"""


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, title (first line), body (the whole text), lang, source."""
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("body"), "lang", "source"
    )


DOC_SQL = """v_doc AS (
  SELECT doc_id, string_split(text, chr(10))[1] AS title, text AS body, lang, source FROM documents
)"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, tgt (supplier and nation of the order's customer), n, weight: co-occurrence in orders."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return (
        table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy(
            F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("src"),
            F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("tgt"),
        )
        .agg(F.count("*").alias("n"))
        .withColumn("weight", F.least(F.lit(1.0), F.col("n") / 50))
    )


EDGE_SQL = """v_edge AS (
  SELECT 's' || CAST(l_suppkey AS VARCHAR) AS src, 'n' || CAST(c_nationkey AS VARCHAR) AS tgt, count(*) AS n,
         least(1.0::DOUBLE, count(*) / 50) AS weight
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2
)"""
