"""Queries of report aggregates, rankings and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import digest as DG
from tidemark.operators import kpis as K
from tidemark.operators import reports as O
from tidemark.operators import series as S
from tidemark.plans.catalog import query
from tidemark.sources import views as V

E, B, T, D, A, G = (f"WITH {x}" for x in (V.EVENT_SQL, V.BAR_SQL, V.TRADE_SQL, V.DOC_SQL, V.ACTIVITY_SQL, V.EDGE_SQL))
NOW = "(SELECT max(ts) FROM v_event)"
r6 = lambda c: F.round(c, 6).alias(c)


@query("a13_trending_items", f"{A} SELECT detail, count(*) AS n FROM v_activity GROUP BY detail ORDER BY n DESC, detail LIMIT 10")
def trending(spark, d):
    return O.top_count(V.activity(spark, d), "detail", 10)


@query("a14_memory_levels", f"""{A} SELECT user_id, n, last_active, CASE WHEN n >= 75 THEN 'mature' WHEN n >= 60 THEN 'growing' ELSE 'new' END AS level
  FROM (SELECT user_id, count(*) AS n, max(created_at) AS last_active FROM v_activity GROUP BY user_id)""")
def levels(spark, d):
    return O.activity_levels(V.activity(spark, d), "created_at", {60: "growing", 75: "mature"}, "new")


@query("a15_graph_stats", f"""{G}, v AS (SELECT src AS node FROM v_edge UNION SELECT tgt FROM v_edge)
  SELECT 'nodes' AS metric, 'all' AS name, count(*) AS value FROM v UNION ALL SELECT 'edges', 'all', count(*) FROM v_edge
  UNION ALL SELECT 'type', substr(node, 1, 1), count(*) FROM v GROUP BY 2""")
def graph_stats(spark, d):
    return O.graph_stats(V.edges(spark, d))


@query("a16_signal_stats", f"""{B} SELECT symbol, count(c) AS total, count(*) FILTER (c > 0) AS wins, count(*) FILTER (c <= 0) AS losses,
  round(count(*) FILTER (c > 0) / count(c), 6) AS win_rate, round(avg(c), 6) AS mean, round(max(c), 6) AS best, round(min(c), 6) AS worst FROM (
    SELECT symbol, lead(close, 5) OVER (PARTITION BY symbol ORDER BY date) / close - 1 AS c FROM v_bar) GROUP BY symbol""")
def signal_stats(spark, d):
    df = V.bars(spark, d).withColumn("c", F.try_divide(F.lead("close", 5).over(S.by()), F.col("close")) - 1)
    return O.signal_stats(df, ["symbol"], "c").select("symbol", "total", "wins", "losses", *map(r6, ("win_rate", "mean", "best", "worst")))


@query("a19_weekly_accuracy", f"""{B}, r AS (SELECT symbol, date, sign(close - lag(close) OVER w) AS now FROM v_bar WINDOW w AS (PARTITION BY symbol ORDER BY date)),
  g AS (SELECT date, now, lag(now) OVER (PARTITION BY symbol ORDER BY date) AS guess FROM r)
  SELECT date AS week, count(*) AS n, round(count(*) FILTER (guess = now) / count(*), 6) AS score FROM g WHERE now IS NOT NULL AND guess IS NOT NULL
  GROUP BY date ORDER BY date DESC LIMIT 8""")
def accuracy(spark, d):
    now = F.signum(F.col("close") - F.lag("close").over(S.by()))
    df = V.bars(spark, d).withColumn("now", now).withColumn("guess", F.lag("now").over(S.by()))
    return O.accuracy_by_week(df, F.col("guess"), F.col("now"), F.col("date"), 8).select("week", "n", r6("score"))


@query("a20_ranked_sides", f"""{T}, r AS (SELECT * FROM v_trade WHERE executed_at > (SELECT max(executed_at) FROM v_trade) - INTERVAL 900 DAY)
  SELECT 'buys' AS list, * FROM (SELECT symbol, count(*) AS n FROM r WHERE side = 'BUY' GROUP BY symbol ORDER BY n DESC, symbol LIMIT 10)
  UNION ALL SELECT 'sells', * FROM (SELECT symbol, count(*) AS n FROM r WHERE side = 'SELL' GROUP BY symbol ORDER BY n DESC, symbol LIMIT 10)
  UNION ALL SELECT 'big', * FROM (SELECT symbol, count(*) AS n FROM r WHERE qty * price > 60000 GROUP BY symbol ORDER BY n DESC, symbol LIMIT 10)""")
def ranked_sides(spark, d):
    return O.ranked_sides(K.look_back(V.trades(spark, d), 900 * 24, "executed_at"), 60000, 10)


@query("a30_portfolio_value", f"""{T}, q AS (SELECT symbol, arg_max(price, row(executed_at, l_orderkey, l_linenumber)) AS last_price FROM v_trade GROUP BY symbol)
  SELECT bot, round(sum(qty * last_price), 4) AS value, round(sum(qty * price), 4) AS invested, round(sum(qty * last_price) - sum(qty * price), 3) AS profit
  FROM v_trade JOIN q USING (symbol) WHERE side = 'BUY' GROUP BY bot""")
def portfolio_value(spark, d):
    from tidemark.operators import lookups

    t = V.trades(spark, d)
    held = t.where("side = 'BUY'").groupBy("bot", "symbol").agg(F.sum("qty").alias("qty"), F.sum(F.col("qty") * F.col("price")).alias("paid"))
    held = held.withColumn("avg_price", F.try_divide("paid", "qty"))
    quotes = lookups.latest(t, ["symbol"], ["executed_at", "l_orderkey", "l_linenumber"], "price", "last_price")
    df = lookups.value_positions(held, quotes).groupBy("bot").agg(F.sum("value").alias("v"), F.sum("paid").alias("i"))
    return df.select("bot", F.round("v", 4).alias("value"), F.round("i", 4).alias("invested"), F.round(F.col("v") - F.col("i"), 3).alias("profit"))


@query("a32_label_coverage", """SELECT d.lang, count(*) AS n, round(count(l.quality) / count(*), 6) AS covered, round(avg(l.quality), 6) AS mean_quality
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY d.lang""")
def coverage(spark, d):
    df = V.table(spark, d, "documents").select("doc_id", "lang").join(V.table(spark, d, "labels"), "doc_id", "left")
    cov = O.share(F.col("quality").isNotNull()).alias("covered")
    return df.groupBy("lang").agg(F.count("*").alias("n"), cov, F.avg("quality").alias("mean_quality")).select("lang", "n", r6("covered"), r6("mean_quality"))


@query("a33_distribution", f"""{E} SELECT category, CASE WHEN severity >= 7 THEN 'High' WHEN severity >= 4 THEN 'Medium' ELSE 'Low' END AS band, count(*) AS n,
  round(count(*) FILTER (region <> 'ASIA') / count(*), 6) AS outside FROM v_event GROUP BY 1, 2""")
def distribution(spark, d):
    df = V.events(spark, d).groupBy("category", K.impact(F.col("severity")).alias("band"))
    return df.agg(F.count("*").alias("n"), F.round(O.share(F.col("region") != "ASIA"), 6).alias("outside"))


@query("a35_achievements", f"""{T}, s AS (SELECT bot, count(*) AS n, count(DISTINCT symbol) AS k, sum(CASE WHEN side = 'SELL' THEN 1 ELSE 0 END) AS sells FROM v_trade GROUP BY bot),
  u AS (SELECT bot, unnest([CASE WHEN n >= 1 THEN 'first' END, CASE WHEN n >= 600 THEN 'busy' END, CASE WHEN k >= 50 THEN 'broad' END, CASE WHEN sells >= 150 THEN 'seller' END]) AS badge FROM s)
  SELECT bot, badge FROM u WHERE badge IS NOT NULL""")
def achievements(spark, d):
    s = V.trades(spark, d).groupBy("bot").agg(F.count("*").alias("n"), F.countDistinct("symbol").alias("k"), F.count(F.when(F.col("side") == "SELL", 1)).alias("sells"))
    c = F.col
    return O.achievements(s, {"first": c("n") >= 1, "busy": c("n") >= 600, "broad": c("k") >= 50, "seller": c("sells") >= 150})


@query("a36_template_usage", f"""{A} SELECT detail, count(*) AS uses, count(*) FILTER (action = 'purchase') AS positive,
  count(*) FILTER (action = 'error') AS negative FROM v_activity GROUP BY detail""")
def template_usage(spark, d):
    n = lambda a: F.count(F.when(F.col("action") == a, 1))
    return V.activity(spark, d).groupBy("detail").agg(F.count("*").alias("uses"), n("purchase").alias("positive"), n("error").alias("negative"))


@query("a37_daily_interactions", f"{A} SELECT user_id, CAST(created_at AS DATE) AS day, count(*) AS n FROM v_activity GROUP BY 1, 2")
def interactions(spark, d):
    return K.per_day(V.activity(spark, d), "created_at", "user_id").select("user_id", "day", "n")


@query("a38_stale_topics", f"""{A} SELECT detail, n, before FROM (SELECT detail, count(*) AS n,
  count(*) FILTER (created_at <= (SELECT max(created_at) FROM v_activity) - INTERVAL 72 HOUR) AS before FROM v_activity GROUP BY detail)
  WHERE n >= 5 AND (before = 0 OR n - before >= 10)""")
def stale_topics(spark, d):
    return O.stale_topics(V.activity(spark, d), "detail", "created_at", 72).select("detail", "n", "before")


@query("a40_report_context", f"""WITH {V.EVENT_SQL}, {V.EDGE_SQL} SELECT 'node' AS section, tgt AS name, CAST(sum(n) AS DOUBLE) AS value FROM v_edge GROUP BY tgt
  QUALIFY row_number() OVER (ORDER BY sum(n) DESC, tgt) <= 5
  UNION ALL SELECT 'event', CAST(id AS VARCHAR), round(severity, 6) FROM v_event WHERE ts > {NOW} - INTERVAL 72 HOUR AND severity >= 8""")
def report_context(spark, d):
    nodes = V.edges(spark, d).groupBy(F.col("tgt").alias("name")).agg(F.sum("n").cast("double").alias("value")).orderBy(F.desc("value"), "name").limit(5)
    found = K.look_back(V.events(spark, d), 72).where("severity >= 8").select(F.col("id").cast("string").alias("name"), F.round("severity", 6).alias("value"))
    return nodes.select(F.lit("node").alias("section"), "name", "value").union(found.select(F.lit("event"), "name", "value"))


@query("a42_continents", f"""{E} SELECT region, id, rank, fresh FROM (SELECT region, id, ts > {NOW} - INTERVAL 30 MINUTE AS fresh,
  row_number() OVER (PARTITION BY region ORDER BY ts DESC, id) AS rank FROM v_event) WHERE rank <= 15""")
def continents(spark, d):
    e = V.events(spark, d)
    fresh = F.col("ts") > K.now_of(e) - F.expr("INTERVAL 30 MINUTES")
    return K.top_per_group(e.withColumn("fresh", fresh), "region", [F.desc("ts"), "id"], 15).select("region", "id", F.col("place").alias("rank"), "fresh")


@query("a44_overlay_stats", f"""{E} SELECT category, sum(n)::BIGINT AS clustered, round(avg(m), 6) AS mean_severity, round(max(x), 6) AS worst FROM (
  SELECT category, country, count(*) AS n, avg(severity) AS m, max(severity) AS x FROM v_event GROUP BY 1, 2) GROUP BY category""")
def overlay_stats(spark, d):
    c = V.events(spark, d).groupBy("category", "country").agg(F.count("*").alias("n"), F.avg("severity").alias("m"), F.max("severity").alias("x"))
    return c.groupBy("category").agg(F.sum("n").alias("clustered"), F.round(F.avg("m"), 6).alias("mean_severity"), F.round(F.max("x"), 6).alias("worst"))


@query("a45_concept_terms", f"""{D}, w AS (SELECT regexp_extract_all(lower(body), '[a-z]+') AS w FROM v_doc),
  f AS (SELECT list_filter(w, lambda x: length(x) > 4) AS w FROM w WHERE list_has_any(w, ['ring', 'ering', 'anal'])),
  t AS (SELECT unnest(w) AS term FROM f UNION ALL SELECT unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM f)
  SELECT term, count(*) AS n FROM t GROUP BY term ORDER BY n DESC, term LIMIT 25""")
def concept_terms(spark, d):
    return O.concept_terms(V.documents(spark, d), "body", ["ring", "ering", "anal"], 4, 25)


HEAT = f"severity * greatest(0.4::DOUBLE, exp(-(epoch({NOW}) - epoch(ts)) / 3600 / 72))"


@query("l2_heat_ranked", f"""{E} SELECT id, round(severity * coalesce(heat, severity), 6) AS score FROM (
  SELECT id, severity, CASE WHEN category <> 'VIEW' THEN {HEAT} END AS heat FROM v_event) ORDER BY severity * coalesce(heat, severity) DESC, id LIMIT 300""")
def heat_ranked(spark, d):
    from tidemark.functions import scalars

    e = V.events(spark, d)
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    age = (micros(K.now_of(e)) - micros(F.col("ts"))) / 3.6e9
    heat = F.when(F.col("category") != "VIEW", F.col("severity") * scalars.recency(age))
    return O.heat_ranked(e.withColumn("heat", heat), "heat", 300).select("id", r6("score"))


PATTERNS = {"failure": ["error"], "sale": ["purchase", "signup"], "traffic": ["click", "view"]}


@query("l4_first_patterns", f"""{E}, p AS (SELECT id, severity, CASE WHEN category = 'ERROR' THEN 0 WHEN category IN ('PURCHASE', 'SIGNUP') THEN 1 ELSE 2 END AS p_no FROM v_event)
  SELECT id, (['failure', 'sale', 'traffic'])[p_no + 1] AS pattern, rank FROM (SELECT *, row_number() OVER (PARTITION BY p_no ORDER BY severity DESC, id) AS rank FROM p)
  WHERE rank <= 3""")
def first_patterns(spark, d):
    return O.first_patterns(V.events(spark, d), "id", F.col("category"), PATTERNS, 3, 24).select("id", "pattern", "rank")


@query("l8_best_by_date", f"""{E}, b AS (SELECT id, ts, severity * k AS score FROM v_event ORDER BY severity * k DESC, id LIMIT 40)
  SELECT id, row_number() OVER (ORDER BY ts DESC, id) AS place FROM b""")
def best_by_date(spark, d):
    return O.best_by_date(V.events(spark, d), F.col("severity") * F.col("k"), "ts", 40).select("id", "place")


@query("l10_asset_trending", f"""{E}, t AS (SELECT country || ' ' || region || ' ' || category AS text FROM v_event ORDER BY severity DESC, id LIMIT 30),
  a AS (SELECT * FROM (VALUES ('EUR', 'europe'), ('ASIA', 'asia'), ('ASIA', 'middle'), ('RISK', 'error'), ('SHOP', 'purchase'), ('SHOP', 'click')) v(asset, driver))
  SELECT asset, count(*) AS hits FROM a JOIN t ON contains(lower(text), driver) GROUP BY asset ORDER BY hits DESC, asset LIMIT 8""")
def asset_trending(spark, d):
    from tidemark.operators import lookups

    drivers = [("EUR", "europe"), ("ASIA", "asia"), ("ASIA", "middle"), ("RISK", "error"), ("SHOP", "purchase"), ("SHOP", "click")]
    top = V.events(spark, d).orderBy(F.desc("severity"), "id").limit(30).select(F.concat_ws(" ", "country", "region", "category").alias("text"))
    hits = lookups.contains_join(top, "text", spark.createDataFrame(drivers, "asset string, driver string"), "driver")
    return hits.groupBy("asset").agg(F.count("*").alias("hits")).orderBy(F.desc("hits"), "asset").limit(8)


@query("u1_union_sources", """SELECT 'order' AS kind, o_orderkey AS key, o_totalprice AS amount, CAST(NULL AS VARCHAR) AS name FROM orders
  UNION ALL SELECT 'supplier', s_suppkey, s_acctbal, s_name FROM supplier""")
def union_sources(spark, d):
    o = V.table(spark, d, "orders").select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("amount"))
    s = V.table(spark, d, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("amount"), F.col("s_name").alias("name"))
    return o.unionByName(s, allowMissingColumns=True)


@query("u2_distinct", f"{E} SELECT DISTINCT category, country, region FROM v_event")
def distinct(spark, d):
    return V.events(spark, d).select("category", "country", "region").distinct()


@query("u3_union_priority", """SELECT c_nationkey AS node, 'customer' AS origin FROM customer GROUP BY 1
  UNION ALL SELECT DISTINCT n_nationkey, 'nation' FROM nation WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer)""")
def union_priority(spark, d):
    first = V.table(spark, d, "customer").select(F.col("c_nationkey").alias("node"), F.lit("customer").alias("origin")).distinct()
    rules = V.table(spark, d, "nation").select(F.col("n_nationkey").alias("node"), F.lit("nation").alias("origin"))
    return DG.union_first([first, rules], "node").select("node", "origin")


@query("u4_word_overlap", f"""{D}, w AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(title), '[a-z]+')) AS t, list_distinct(regexp_extract_all(lower(body), '[a-z]+')) AS b FROM v_doc)
  SELECT doc_id, len(list_intersect(t, b)) AS shared, len(list_distinct(list_concat(t, b))) AS together FROM w""")
def overlap(spark, d):
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit("[a-z]+"), F.lit(0))
    shared, together = O.word_overlap(words("title"), words("body"))
    return V.documents(spark, d).select("doc_id", shared.cast("long").alias("shared"), together.cast("long").alias("together"))


@query("u5_region_codes", f"""{E} SELECT category, list_sort(list(DISTINCT country)) AS codes FROM v_event WHERE severity >= 8 GROUP BY category""")
def region_codes(spark, d):
    return V.events(spark, d).where("severity >= 8").groupBy("category").agg(F.array_sort(F.collect_set("country")).alias("codes"))


@query("u6_not_yet", f"""{A} SELECT DISTINCT user_id FROM v_activity WHERE user_id NOT IN (
  SELECT user_id FROM v_activity WHERE action = 'purchase' AND created_at > (SELECT max(created_at) FROM v_activity) - INTERVAL 96 HOUR)""")
def not_yet(spark, d):
    a = V.activity(spark, d)
    done = K.look_back(a.where("action = 'purchase'"), 96, "created_at", as_of=a.agg(F.max("created_at")).first()[0])
    return a.select("user_id").distinct().join(done, "user_id", "left_anti")


@query("l11_strongest", f"""{B}, m AS (SELECT symbol, date, close / lag(close) OVER (PARTITION BY symbol ORDER BY date) - 1 AS r FROM v_bar)
  SELECT symbol, date, round(r, 6) AS r FROM m WHERE r IS NOT NULL ORDER BY abs(r) DESC, symbol, date LIMIT 20""")
def strongest(spark, d):
    df = V.bars(spark, d).withColumn("r", F.try_divide("close", F.lag("close").over(S.by())) - 1).where("r IS NOT NULL")
    return O.strongest(df, "r", ["symbol", "date"], 20).select("symbol", "date", r6("r"))
