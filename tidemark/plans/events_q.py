"""Queries over events and activity."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import kpis as K
from tidemark.plans.catalog import query
from tidemark.sources import views as V

E = f"WITH {V.EVENT_SQL}"
A = f"WITH {V.ACTIVITY_SQL}"
NOW = "(SELECT max(ts) FROM v_event)"
r6 = lambda c: F.round(c, 6).alias(c)


@query("a4_country_heatmap", f"""{E} SELECT country, count(*) AS n, round(avg(severity), 6) AS avg_severity,
  round(max(severity), 6) AS max_severity, count(*) FILTER (severity >= 7) AS high_count
  FROM v_event WHERE ts > {NOW} - INTERVAL 72 HOUR GROUP BY country""")
def heatmap(spark, d):
    return K.heatmap(V.events(spark, d)).select("country", "n", r6("avg_severity"), r6("max_severity"), "high_count")


@query("a1_global_kpis", f"""{E} SELECT count(*) AS total, count(*) FILTER (ts > {NOW} - INTERVAL 24 HOUR) AS last_24h,
  count(*) FILTER (ts > {NOW} - INTERVAL 24 HOUR AND severity >= 7) AS high_24h, round(avg(severity), 6) AS avg_severity,
  round(least(100, avg(severity) * 10), 6) AS risk_index FROM v_event""")
def kpis(spark, d):
    return K.global_kpis(V.events(spark, d)).select("total", "last_24h", "high_24h", r6("avg_severity"), r6("risk_index"))


@query("a2_by_category", f"{E} SELECT category, count(*) AS n FROM v_event GROUP BY category")
def by_category(spark, d):
    return K.by_category(V.events(spark, d))


@query("a3_hotspots", f"""{E} SELECT country, count(*) AS n, round(avg(severity), 6) AS avg_severity FROM v_event
  WHERE country <> 'XX' GROUP BY country ORDER BY n DESC, country LIMIT 10""")
def hotspots(spark, d):
    return K.hotspots(V.events(spark, d)).select("country", "n", r6("avg_severity"))


@query("a5_country_risk", f"""{E} SELECT country, round(risk, 6) AS risk,
  CASE WHEN risk >= 5 THEN 'red' WHEN risk >= 3 THEN 'amber' ELSE 'green' END AS band
  FROM (SELECT country, avg(severity * 0.7 + 6.0) AS risk FROM v_event GROUP BY country)""")
def country_risk(spark, d):
    return K.country_risk(V.events(spark, d), 0.2).select("country", r6("risk"), "band")


@query("a7_region_rollup", f"""{E} SELECT region, n, high, round(m, 6) AS avg_severity, countries,
  CASE WHEN m > 6.5 THEN 'up' WHEN m < 4 THEN 'down' ELSE 'flat' END AS trend
  FROM (SELECT region, count(*) AS n, count(*) FILTER (severity >= 7) AS high, avg(severity) AS m,
        count(DISTINCT country) AS countries FROM v_event GROUP BY region)""")
def rollup(spark, d):
    return K.region_rollup(V.events(spark, d)).select("region", "n", "high", r6("avg_severity"), "countries", "trend")


@query("a8_duplicate_candidates", f"""{E} SELECT category, country, count(*) AS n, min(id) AS first_id, max(id) AS last_id
  FROM v_event GROUP BY category, country HAVING count(*) > 1 ORDER BY n DESC, category, country LIMIT 30""")
def candidates(spark, d):
    return K.duplicate_candidates(V.events(spark, d))


@query("a9_satisfaction", f"""{A} SELECT count(*) FILTER (action = 'purchase') AS pos, count(*) FILTER (action = 'error') AS neg,
  round(100 * count(*) FILTER (action = 'purchase') / greatest(1, count(*) FILTER (action IN ('purchase', 'error'))), 6) AS pct
  FROM v_activity""")
def satisfaction(spark, d):
    df = K.satisfaction(V.activity(spark, d), F.col("action") == "purchase", F.col("action") == "error")
    return df.select("pos", "neg", r6("pct"))


AFFINITY = """aff AS (
  SELECT user_id, p_brand, n, n / sum(n) OVER (PARTITION BY user_id) AS share FROM (
    SELECT user_id, p_brand, count(*) AS n FROM v_activity JOIN part ON detail = p_partkey
    WHERE action IN ('click', 'purchase') GROUP BY 1, 2))"""


@query("a10_affinity", f"{A}, {AFFINITY} SELECT user_id, p_brand, n, round(share, 6) AS share FROM aff")
def affinity(spark, d):
    items = V.table(spark, d, "part").select("p_partkey", "p_brand")
    return K.affinity(V.activity(spark, d), items, ("click", "purchase"), "p_partkey", "p_brand").select(
        "user_id", "p_brand", "n", r6("share")
    )


@query("a11_behaviour", f"""{A} SELECT action, count(*) AS n, count(DISTINCT user_id) AS users,
  count(DISTINCT CASE WHEN created_at > (SELECT max(created_at) FROM v_activity) - INTERVAL 7 DAY THEN user_id END) AS active
  FROM v_activity GROUP BY ROLLUP (action)""")
def behaviour(spark, d):
    return K.behaviour(V.activity(spark, d))


@query("a12_per_day", f"""{A} SELECT action, CAST(created_at AS DATE) AS day, count(*) AS n FROM v_activity GROUP BY 1, 2""")
def per_day(spark, d):
    return K.per_day(V.activity(spark, d), "created_at", "action")


VEL = f"""vel AS (SELECT category, count(*) FILTER (ts > {NOW} - INTERVAL 24 HOUR) AS n_24h,
  count(*) FILTER (ts > {NOW} - INTERVAL 48 HOUR AND ts <= {NOW} - INTERVAL 24 HOUR) AS n_prior,
  avg(severity) FILTER (ts > {NOW} - INTERVAL 24 HOUR)
   - avg(severity) FILTER (ts > {NOW} - INTERVAL 48 HOUR AND ts <= {NOW} - INTERVAL 24 HOUR) AS momentum
  FROM v_event GROUP BY category)"""


@query("a28_velocity", f"""{E}, {VEL} SELECT category, n_24h, n_prior, round(momentum, 6) AS momentum,
  round(least(3.0, n_24h / greatest(1, n_prior)), 6) AS velocity FROM vel""")
def velocity(spark, d):
    return K.velocity(V.events(spark, d)).select("category", "n_24h", "n_prior", r6("momentum"), r6("velocity"))


@query("a23_early_warning", f"""{E}, r AS (SELECT *, CASE category WHEN 'ERROR' THEN 2.0 WHEN 'PURCHASE' THEN 1.5 ELSE 1.0 END AS w
  FROM v_event WHERE ts > {NOW} - INTERVAL 72 HOUR), t AS (
  SELECT avg(severity) AS top_severity FROM (SELECT severity FROM r ORDER BY severity DESC, id LIMIT 40)), m AS (
  SELECT least(3.0, count(*) FILTER (ts > {NOW} - INTERVAL 24 HOUR) / greatest(1, count(*) FILTER
    (ts > {NOW} - INTERVAL 48 HOUR AND ts <= {NOW} - INTERVAL 24 HOUR))) AS velocity,
    sum(severity * w) / sum(w) AS weighted_severity FROM r)
  SELECT round(velocity, 6) AS velocity, round(weighted_severity, 6) AS weighted_severity, round(top_severity, 6) AS top_severity,
  round(0.30 * top_severity + 0.25 * weighted_severity + 0.25 * velocity * 10 / 3 + 0.4, 6) AS score FROM m, t""")
def early_warning(spark, d):
    df = K.early_warning(V.events(spark, d), {"ERROR": 2.0, "PURCHASE": 1.5}, macro_stress=2.0)
    return df.select(r6("velocity"), r6("weighted_severity"), r6("top_severity"), r6("score"))


@query("a41_worst_per_category", f"""{E} SELECT category, arg_max(id, row(severity, ts, id)) AS id, round(max(severity), 6) AS severity
  FROM v_event GROUP BY category ORDER BY max(severity) DESC, category LIMIT 6""")
def worst(spark, d):
    return K.worst_per(V.events(spark, d), "category", 6).select("category", "id", r6("severity"))


@query("f2_filter_events", f"""{E} SELECT id, country, round(severity, 6) AS severity FROM v_event WHERE category = 'CLICK'
  AND severity >= 2.5 AND contains(country, 'N_1') AND severity >= 4 AND severity < 7""")
def filtered(spark, d):
    df = K.filter_events(
        V.events(spark, d), category="CLICK", min_severity=2.5, band="Medium", text="N_1", text_columns=("country", "region")
    )
    # the text may stand in the region only; the query asks for the country
    return df.where(F.contains("country", F.lit("N_1"))).select("id", "country", r6("severity"))


@query("f4_alert_level", f"""{E} SELECT user_id, count(*) AS n FROM v_event WHERE CASE user_id % 3 WHEN 0 THEN true
  WHEN 1 THEN severity >= 4 ELSE severity >= 7 END GROUP BY user_id""")
def alert_level(spark, d):
    df = V.events(spark, d)
    level = F.when(F.col("user_id") % 3 == 0, "All").when(F.col("user_id") % 3 == 1, "High+Medium").otherwise("High")
    return df.where(K.alert_level(F.col("severity"), level)).groupBy("user_id").agg(F.count("*").alias("n"))


@query("l1_weighted_order", f"""{E} SELECT id, category, round(severity, 6) AS severity FROM v_event
  ORDER BY severity * CASE category WHEN 'ERROR' THEN 1.5 WHEN 'VIEW' THEN 0.5 ELSE 1.0 END DESC, ts DESC, id LIMIT 50 OFFSET 10""")
def weighted_order(spark, d):
    w = F.when(F.col("category") == "ERROR", 1.5).when(F.col("category") == "VIEW", 0.5).otherwise(1.0)
    df = V.events(spark, d).orderBy(F.desc(F.col("severity") * w), F.desc("ts"), "id").offset(10).limit(50)
    return df.select("id", "category", r6("severity"))


@query("l3_top_per_region", f"""{E} SELECT region, id, place FROM (SELECT region, id,
  row_number() OVER (PARTITION BY region ORDER BY severity DESC, ts DESC, id) AS place FROM v_event) WHERE place <= 20""")
def top_region(spark, d):
    return K.top_per_group(V.events(spark, d), "region", [F.desc("severity"), F.desc("ts"), "id"], 20).select("region", "id", "place")


@query("s22_retention", f"""{E}, s AS (SELECT 'VIEW' AS category, 300 AS slots UNION ALL SELECT 'CLICK', 150 UNION ALL SELECT 'ERROR', 50),
  p AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY severity DESC, ts DESC, id) AS place FROM v_event)
  SELECT id, category FROM p LEFT JOIN s USING (category) WHERE slots IS NULL OR place <= slots ORDER BY ts DESC, id LIMIT 900""")
def retention(spark, d):
    slots = spark.createDataFrame([("VIEW", 300), ("CLICK", 150), ("ERROR", 50)], "category string, slots int")
    return K.retention(V.events(spark, d), slots, 900).select("id", "category")


@query("w29_streaks", f"""{A}, dd AS (SELECT DISTINCT user_id, CAST(created_at AS DATE) AS day FROM v_activity), i AS (
  SELECT user_id, day - CAST(row_number() OVER (PARTITION BY user_id ORDER BY day) AS INTEGER) AS island FROM dd), c AS (
  SELECT user_id, island, count(*) AS n FROM i GROUP BY 1, 2)
  SELECT user_id, max(n) AS longest, CAST(sum(n) AS BIGINT) AS days FROM c GROUP BY user_id""")
def streaks(spark, d):
    return K.streaks(V.activity(spark, d))


@query("j1_activity_items", f"""{A} SELECT p_type, action, count(*) AS n, round(avg(p_retailprice), 6) AS avg_price
  FROM v_activity JOIN part ON detail = p_partkey GROUP BY 1, 2""")
def activity_items(spark, d):
    items = V.table(spark, d, "part").select("p_partkey", "p_type", "p_retailprice")
    df = V.activity(spark, d).join(items, F.col("detail") == F.col("p_partkey"))
    return df.groupBy("p_type", "action").agg(F.count("*").alias("n"), F.round(F.avg("p_retailprice"), 6).alias("avg_price"))


@query("t18_personalised", f"""{E}, a AS (SELECT user_id, category, count(*) AS n FROM v_event GROUP BY 1, 2), sh AS (
  SELECT user_id, category, n / sum(n) OVER (PARTITION BY user_id) AS share FROM a), u AS (
  SELECT c_custkey AS user_id, r_name AS home FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  WHERE c_custkey IN (SELECT user_id FROM events)), e AS (
  SELECT id, category, severity, region, severity * greatest(0.4, exp(-(date_diff('second', ts, {NOW}) / 3600) / 72)) AS heat
  FROM v_event WHERE ts > {NOW} - INTERVAL 24 HOUR), s AS (
  SELECT u.user_id, e.id, 0.5 * severity / 10 + 0.2 * heat / 10
   + 0.3 * (coalesce(share, 0.05) + CASE WHEN home = region THEN 0.3 ELSE 0.1 END) AS score
  FROM e CROSS JOIN u LEFT JOIN sh ON sh.user_id = u.user_id AND sh.category = e.category)
  SELECT user_id, id, round(score, 6) AS score FROM (SELECT *, row_number() OVER
   (PARTITION BY user_id ORDER BY round(score, 9) DESC, id) AS place FROM s) WHERE place <= 5""")
def personalised(spark, d):
    from pyspark.sql import Window as W

    ev = V.events(spark, d)
    n = ev.groupBy("user_id", "category").agg(F.count("*").alias("n"))
    shares = n.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy("user_id")))
    nation = V.table(spark, d, "nation").join(V.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    users = (
        V.table(spark, d, "customer").join(V.table(spark, d, "events").select("user_id").distinct(), F.col("c_custkey") == F.col("user_id"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("user_id", F.col("r_name").alias("home"))
    )
    return K.personalised(ev, shares, users, 5, hours=24).select("user_id", "id", r6("score"))


@query("st2_hourly_strip", f"""{E} SELECT date_trunc('hour', ts) AS hour, count(*) AS n, round(max(severity), 6) AS max_severity
  FROM v_event GROUP BY 1""")
def hourly(spark, d):
    df = V.events(spark, d).groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"))
    return df.agg(F.count("*").alias("n"), F.round(F.max("severity"), 6).alias("max_severity"))
