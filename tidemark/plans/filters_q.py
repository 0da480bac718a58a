"""Queries of filters and keyed reads."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import filters as O
from tidemark.operators import kpis as K
from tidemark.plans.catalog import query
from tidemark.sources import views as V

E, B, T, D, A = (f"WITH {x}" for x in (V.EVENT_SQL, V.BAR_SQL, V.TRADE_SQL, V.DOC_SQL, V.ACTIVITY_SQL))
r6 = lambda c: F.round(c, 6).alias(c)


@query("f1_look_back", f"{E} SELECT id, category FROM v_event WHERE ts > (SELECT max(ts) FROM v_event) - INTERVAL 24 HOUR")
def look_back(spark, d):
    return K.look_back(V.events(spark, d), 24).select("id", "category")


@query("f3_countries_of_region", f"""{E} SELECT id, country FROM v_event WHERE country IN
  (SELECT n_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA')""")
def in_region(spark, d):
    region = V.table(spark, d, "region").where("r_name = 'ASIA'")
    names = V.table(spark, d, "nation").join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_name")
    return O.among(V.events(spark, d), "country", names).select("id", "country")


@query("f5_threshold_alerts", f"""{E} SELECT owner, id, rank FROM (
  SELECT n_nationkey AS owner, id, row_number() OVER (PARTITION BY n_nationkey ORDER BY severity DESC, id) AS rank
  FROM v_event JOIN nation ON country = n_name WHERE severity >= 3 + n_nationkey / 5) WHERE rank <= 5""")
def thresholds(spark, d):
    rules = V.table(spark, d, "nation").select(
        F.col("n_name").alias("country"), F.col("n_nationkey").alias("owner"), (3 + F.col("n_nationkey") / 5).alias("threshold")
    )
    return O.threshold_alerts(V.events(spark, d), rules, "country").select("owner", "id", "rank")


@query("f6_relative_change", f"""{B} SELECT symbol, date, round(change, 6) AS change FROM (
  SELECT symbol, date, abs(close - p) / (abs(p) + 0.001) AS change FROM (
    SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY date) AS p FROM v_bar)) WHERE change > 0.25""")
def relative_change(spark, d):
    return O.relative_change(V.bars(spark, d), ["symbol"], "date", "close", 0.25).select("symbol", "date", r6("change"))


WEIGHTS = {"ERROR": 1.3, "PURCHASE": 1.2, "SIGNUP": 1.1}


@query("f7_weighted_projection", f"""{E} SELECT id, round(coalesce(severity, 5.0)
  * CASE category WHEN 'ERROR' THEN 1.3 WHEN 'PURCHASE' THEN 1.2 WHEN 'SIGNUP' THEN 1.1 ELSE 1.0 END, 6) AS weighted FROM v_event""")
def weighted(spark, d):
    weight = F.coalesce(F.create_map(*[F.lit(x) for kv in WEIGHTS.items() for x in kv])[F.col("category")], F.lit(1.0))
    df = V.events(spark, d).select("id", (F.coalesce("severity", F.lit(5.0)) * weight).alias("weighted"))
    return df.select("id", r6("weighted"))


def points(spark, d):
    return V.events(spark, d).select("id", (F.col("user_id") * 37 % 180 - 90).alias("lat"), (F.col("k") * 53 % 360 - 180).alias("lon"))


@query("f8_bounding_box", f"""{E}, p AS (SELECT id, user_id * 37 % 180 - 90 AS lat, k * 53 % 360 - 180 AS lon FROM v_event)
  SELECT id, lat, lon FROM p WHERE lat BETWEEN -25 AND 65 AND lon BETWEEN -70 AND 110""")
def box(spark, d):
    return O.in_box(points(spark, d), -10, -40, 50, 80)


@query("f10_market_mentions", f"""{E} SELECT id, country FROM v_event WHERE contains(lower(country), 'nation_1')
  OR contains(lower(category), 'nation_1') OR contains(lower(country), 'pur') OR contains(lower(category), 'pur')""")
def market_mentions(spark, d):
    df = V.events(spark, d).where(O.mentions(F.array("country", "category"), "PURCHASE", ["nation_1"]))
    return df.select("id", "country")


@query("f11_symbol_search", """SELECT p_partkey, p_brand, p_name FROM part WHERE p_brand = 'ring' OR contains(lower(p_name), 'ring')
  OR contains(lower(p_type), 'ring') ORDER BY p_partkey LIMIT 20""")
def symbol_search(spark, d):
    df = O.search(V.table(spark, d, "part"), "p_brand", ["p_name", "p_type"], "ring", ["p_partkey"])
    return df.select("p_partkey", "p_brand", "p_name")


@query("f12_unenriched", """SELECT d.doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality IS NULL
  ORDER BY d.doc_id DESC LIMIT 50""")
def unenriched(spark, d):
    df = V.table(spark, d, "documents").select("doc_id").join(V.table(spark, d, "labels"), "doc_id", "left")
    return O.unenriched(df, "quality", [F.desc("doc_id")], 50).select("doc_id")


@query("f13_trade_filter", f"""{T} SELECT bot, symbol, l_orderkey, l_linenumber FROM v_trade
  WHERE coalesce(executed_at, TIMESTAMP '9999-12-31') >= TIMESTAMP '1998-01-01' AND bot = 7 AND contains(CAST(symbol AS VARCHAR), '2')""")
def trade_filter(spark, d):
    since = F.lit("1998-01-01").cast("timestamp")
    return O.trade_filter(V.trades(spark, d), since, 7, "2").select("bot", "symbol", "l_orderkey", "l_linenumber")


@query("f14_newest_per_user", f"""{A} SELECT user_id, action, created_at, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, action, detail) AS rank FROM v_activity) WHERE rank <= 3""")
def newest(spark, d):
    df = O.newest_per(V.activity(spark, d), ["user_id"], [F.desc("created_at"), "action", "detail"], 3)
    return df.select("user_id", "action", "created_at", "rank")


@query("f15_graph_ready", f"""{E} SELECT id, string_split(country, '_')[2] AS code, round(severity, 6) AS severity FROM v_event
  WHERE ts > (SELECT max(ts) FROM v_event) - INTERVAL 72 HOUR AND severity >= 5 ORDER BY severity DESC, id LIMIT 100""")
def graph_ready(spark, d):
    df = K.look_back(V.events(spark, d), 72).where("severity >= 5").orderBy(F.desc("severity"), "id").limit(100)
    return df.select("id", F.split("country", "_")[1].alias("code"), r6("severity"))
