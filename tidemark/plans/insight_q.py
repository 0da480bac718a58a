"""Queries over rules, intervals, nodes, cohorts and points."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import insight as I
from tidemark.operators import kpis as K
from tidemark.operators import ledger as L
from tidemark.plans.catalog import query
from tidemark.plans.ledger_q import ORDER, POS
from tidemark.sources import views as V

E = f"WITH {V.EVENT_SQL}"
A = f"WITH {V.ACTIVITY_SQL}"
T = f"WITH {V.TRADE_SQL}"
NOW = "(SELECT max(ts) FROM v_event)"
RULES = [(1, 6.0, "CLICK", None), (2, 9.0, None, None), (3, 2.0, "ERROR", "CHINA"), (4, 3.0, None, "FRANCE")]
RULE_SQL = "(VALUES (1, 6.0, 'CLICK', NULL), (2, 9.0, NULL, NULL), (3, 2.0, 'ERROR', 'CHINA'), (4, 3.0, NULL, 'FRANCE')) r(rule_id, t, c, n)"


def r6(name: str):
    return F.round(name, 6).alias(name)


@query("j5_match_rules", f"""{E} SELECT rule_id, id FROM v_event, {RULE_SQL} WHERE severity >= t AND (c IS NULL OR c = category) AND (n IS NULL OR n = country)""")
def rules(spark, d):
    r = spark.createDataFrame(RULES, "rule_id int, threshold double, rule_category string, rule_country string")
    return I.match_rules(V.events(spark, d), r).select("rule_id", "id")


@query("j6_not_recent", f"""{E} SELECT id, user_id FROM v_event WHERE category = 'PURCHASE' AND user_id NOT IN
  (SELECT user_id FROM v_event WHERE category = 'ERROR' AND ts > {NOW} - INTERVAL 24 HOUR)""")
def not_recent(spark, d):
    e = V.events(spark, d)
    sent = e.where("category = 'ERROR'").select("user_id", F.col("ts").alias("sent_at"))
    return I.not_recent(e.where("category = 'PURCHASE'").select("id", "user_id"), sent, ["user_id"], 24, e.select(F.max("ts")).scalar())


@query("j8_within", f"""{E} SELECT a.id, a.user_id, a.ts, count(b.ts) AS n_within, min(b.ts) AS first_within FROM (SELECT id, user_id, ts FROM v_event WHERE category = 'CLICK') a
  LEFT JOIN (SELECT user_id, ts FROM v_event WHERE category = 'PURCHASE') b ON a.user_id = b.user_id AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 120 MINUTE
  GROUP BY 1, 2, 3""")
def within(spark, d):
    e = V.events(spark, d)
    return I.within(e.where("category = 'CLICK'").select("id", "user_id", "ts"), e.where("category = 'PURCHASE'"), "user_id", "ts", "ts", 120)


@query("j17_forward_as_of", f"""{E}, p AS (SELECT id, user_id, ts FROM v_event WHERE category = 'VIEW'), v AS (SELECT user_id, ts, max(id) AS next_click FROM v_event
  WHERE category = 'CLICK' GROUP BY 1, 2) SELECT p.id, p.user_id, p.ts, v.next_click FROM p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.ts <= v.ts""")
def forward(spark, d):
    e = V.events(spark, d)
    right = e.where("category = 'CLICK'").groupBy("user_id", F.col("ts").alias("t2")).agg(F.max("id").alias("next_click"))
    return I.forward_as_of(e.where("category = 'VIEW'").select("id", "user_id", "ts"), right, ["user_id"], "ts", "t2", "next_click")


POINT = "(id * 37 % 360) / 1.0 AS x, (id * 91 % 180) / 1.0 AS y"
NODES = "nodes AS (SELECT n_name AS node, n_nationkey * 14.0 AS nx, (n_nationkey * 53 % 180) / 1.0 AS ny, 2.0 + n_nationkey % 5 AS base, n_regionkey AS sector FROM nation)"


def _near(spark, d):
    e = V.events(spark, d).select("id", "severity", (F.col("id") * 37 % 360).cast("double").alias("x"), (F.col("id") * 91 % 180).cast("double").alias("y"))
    k = F.col("n_nationkey")
    n = V.table(spark, d, "nation").select(
        F.col("n_name").alias("node"), (k * 14.0).alias("nx"), (k * 53 % 180).cast("double").alias("ny"), (2.0 + k % 5).alias("base"), F.col("n_regionkey").alias("sector")
    )
    return e, n


HIT = f"hit AS (SELECT node, id, severity FROM (SELECT id, severity, {POINT} FROM v_event), nodes WHERE sqrt(power(x - nx, 2) + power(y - ny, 2)) < 8)"
RISK = """risk AS (SELECT node, n.base, sector, coalesce(c, 0) AS n, CASE WHEN c IS NULL THEN n.base ELSE least(10.0, 0.4 * n.base + 0.4 * m + 0.8 * h) END AS risk
  FROM nodes n LEFT JOIN (SELECT node, count(*) AS c, avg(severity) AS m, count(*) FILTER (severity >= 7) AS h FROM hit GROUP BY node) USING (node))"""


@query("j9_near_nodes", f"{E}, {NODES}, {HIT} SELECT node, id FROM hit")
def near(spark, d):
    e, n = _near(spark, d)
    return I.near_nodes(e, n, F.lit(8.0), 8.0).select("node", "id")


@query("a25_node_risk", f"""{E}, {NODES}, {HIT}, {RISK} SELECT node, n, round(risk, 6) AS risk,
  CASE WHEN risk >= 8 THEN 'critical' WHEN risk >= 6 THEN 'high' WHEN risk >= 4 THEN 'elevated' ELSE 'normal' END AS level FROM risk""")
def node_risk(spark, d):
    e, n = _near(spark, d)
    return I.node_risk(n, I.near_nodes(e, n, F.lit(8.0), 8.0)).select("node", "n", r6("risk"), "level")


@query("a26_exposure", f"""{E}, {NODES}, {HIT}, {RISK} SELECT sector, round(avg(0.5 * base + 0.5 * risk), 6) AS exposure,
  arg_max(node, row(0.5 * base + 0.5 * risk, node)) AS highest FROM risk GROUP BY sector""")
def exposure(spark, d):
    e, n = _near(spark, d)
    risk = I.node_risk(n, I.near_nodes(e, n, F.lit(8.0), 8.0))
    return I.exposure(n.join(risk, "node").select("sector", "node", "base", "risk")).select("sector", r6("exposure"), "highest")


@query("a21_leaderboard", f"""{T}, g AS (SELECT bot, count(*) AS trades, count(*) FILTER (side = 'BUY') AS buys, count(*) FILTER (side <> 'BUY') AS sells,
  count(DISTINCT symbol) AS symbols, count(*) FILTER (qty * price >= 40000) AS big FROM v_trade GROUP BY bot)
  SELECT *, round(trades + 3 * big + 0.5 * symbols, 6) AS score FROM g ORDER BY trades + 3 * big + 0.5 * symbols DESC, bot LIMIT 25""")
def leaderboard(spark, d):
    df = I.leaderboard(V.trades(spark, d), 40000, 25)
    return df.select("bot", "trades", "buys", "sells", "symbols", "big", r6("score"))


@query("a22_consensus", f"""{T} SELECT symbol, count(DISTINCT bot) AS holders, min(bot) AS first, max(bot) AS last FROM v_trade WHERE qty >= 49 GROUP BY symbol HAVING count(DISTINCT bot) >= 2""")
def consensus(spark, d):
    return I.consensus(V.trades(spark, d).where("qty >= 49"), 2)


@query("a18_closed_patterns", f"""{T}, {POS}, s AS (SELECT *, row_number() OVER (PARTITION BY bot ORDER BY executed_at DESC, l_orderkey, l_linenumber, l_partkey, qty, l_extendedprice) AS p FROM pos WHERE side = 'SELL'),
  g AS (SELECT bot, count(*) AS n, count(*) FILTER (pnl > 0) / count(*) AS win_rate, avg(pnl) FILTER (pnl > 0) AS aw, avg(pnl) FILTER (pnl < 0) AS al FROM s WHERE p <= 50 GROUP BY bot)
  SELECT bot, n, round(win_rate, 6) AS win_rate, round(aw, 3) AS avg_win, round(al, 3) AS avg_loss, CASE WHEN win_rate > 0.55 THEN 'keep' WHEN win_rate < 0.40 THEN 'review'
  WHEN aw > 1.5 * -al THEN 'let run' ELSE 'none' END AS rule FROM g""")
def closed(spark, d):
    order = [F.desc("executed_at"), "l_orderkey", "l_linenumber", "l_partkey", "qty", "l_extendedprice"]
    df = I.closed_patterns(L.positions(V.trades(spark, d)), 50, order)
    return df.select("bot", "n", r6("win_rate"), F.round("avg_win", 3).alias("avg_win"), F.round("avg_loss", 3).alias("avg_loss"), "rule")


@query("a34_points", f"""{A}, x AS (SELECT user_id, sum(CASE action WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 10 ELSE 0 END) AS xp FROM v_activity GROUP BY 1)
  SELECT user_id, CAST(xp AS BIGINT) AS xp, max(level) AS level FROM x, (VALUES (1, 0), (2, 100), (3, 180), (4, 260)) l(level, fl) WHERE xp >= fl GROUP BY 1, 2""")
def points(spark, d):
    levels = spark.createDataFrame([(1, 0), (2, 100), (3, 180), (4, 260)], "level int, floor int")
    return I.points(V.activity(spark, d), {"view": 1, "click": 2, "purchase": 10}, levels)


@query("a39_counters", f"""{A}, g AS (SELECT user_id, count(*) AS actions, count(*) FILTER (created_at > (SELECT max(created_at) FROM v_activity) - INTERVAL 7 DAY) AS recent
  FROM v_activity GROUP BY 1) SELECT c_custkey AS user_id, coalesce(actions, 0) AS actions, coalesce(recent, 0) AS recent FROM customer LEFT JOIN g ON c_custkey = user_id""")
def counters(spark, d):
    users = V.table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"))
    return I.per_user_counters(users, V.activity(spark, d), 7)


@query("l5_progressive", f"""{E}, s AS (SELECT id, category, round(severity + CASE WHEN category IN ('CLICK', 'ERROR') THEN 0.6 ELSE 0 END + 0.8 * exp(-(date_diff('second', ts, {NOW}) / 3600) / 96), 9) AS score
  FROM v_event WHERE severity >= 4 - CASE WHEN category IN ('CLICK', 'ERROR') THEN 1 ELSE 0 END), o AS (SELECT *, category IN ('CLICK', 'ERROR')
  AND row_number() OVER (PARTITION BY category ORDER BY score DESC, id) <= 15 AS sure FROM s) SELECT id, category, round(score, 6) AS score FROM o ORDER BY sure DESC, o.score DESC, id LIMIT 100""")
def progressive(spark, d):
    return I.progressive(V.events(spark, d), ["CLICK", "ERROR"], 4.0, 100).select("id", "category", r6("score"))


@query("l9_handles", f"""{T}, g AS (SELECT bot, count(*) AS n FROM v_trade GROUP BY bot) SELECT bot, n,
  ['ash','bay','cliff','dune','elm','fern','glen','hill'][bot % 8 + 1] || '_' || CAST((bot * 7 + 13) % 9000 + 1000 AS VARCHAR) AS handle FROM g""")
def handles(spark, d):
    g = V.trades(spark, d).groupBy("bot").agg(F.count("*").alias("n"))
    return I.handles(g, ["ash", "bay", "cliff", "dune", "elm", "fern", "glen", "hill"])


@query("sf10_week_key", """SELECT strftime(o_orderdate, '%Y-W%W') AS week, count(*) AS n FROM orders GROUP BY 1""")
def week(spark, d):
    return V.table(spark, d, "orders").groupBy(I.week_key("o_orderdate").alias("week")).agg(F.count("*").alias("n"))


@query("j22_resolve", """WITH nm AS (SELECT n_name AS name FROM nation UNION SELECT lower(n_name) FROM nation UNION SELECT substr(n_name, 1, 4) FROM nation),
  c AS (SELECT name, 0 AS kind, n_name AS label FROM nm JOIN nation ON name = n_name UNION ALL SELECT name, 1, n_name FROM nm JOIN nation ON lower(name) = lower(n_name)
  UNION ALL SELECT name, 2, n_name FROM nm JOIN nation ON starts_with(lower(n_name), lower(name))) SELECT name, min(kind) AS kind, arg_min(label, row(kind, label)) AS label FROM c GROUP BY name""")
def resolve(spark, d):
    n = V.table(spark, d, "nation")
    names = n.select(F.col("n_name").alias("name")).union(n.select(F.lower("n_name"))).union(n.select(F.substring("n_name", 1, 4))).distinct()
    return I.resolve(names, n.select(F.col("n_name").alias("label")))


@query("l6_first_by_prefix", f"""WITH {V.DOC_SQL} SELECT min(doc_id) AS doc_id, source FROM (SELECT doc_id, source, substr(lower(title), 1, 40) AS k,
  row_number() OVER (PARTITION BY substr(lower(title), 1, 40) ORDER BY doc_id) AS p FROM v_doc) WHERE p = 1 GROUP BY source""")
def first_by_prefix(spark, d):
    return I.anti_prefix(V.documents(spark, d), "title", 40, ["doc_id"]).groupBy("source").agg(F.min("doc_id").alias("doc_id"))


@query("a29_pivot", f"""{E} SELECT region, round(avg(severity) FILTER (category = 'CLICK'), 6) AS CLICK, round(avg(severity) FILTER (category = 'VIEW'), 6) AS VIEW FROM v_event GROUP BY region""")
def pivot(spark, d):
    return I.pivot_mean(V.events(spark, d), "region", "category", ["CLICK", "VIEW"], "severity").select("region", r6("CLICK"), r6("VIEW"))


@query("w30_chain", f"""{E}, l AS (SELECT country, id, ts, lead(id) OVER w AS next_id, lead(ts) OVER w AS next_ts FROM v_event WINDOW w AS (PARTITION BY country ORDER BY ts, id))
  SELECT country, id, next_id FROM l WHERE next_ts <= ts + INTERVAL 2 HOUR""")
def chain(spark, d):
    return I.chain_edges(V.events(spark, d), "country", 2)


@query("t30_memory_dedup", f"""WITH RECURSIVE {V.EVENT_SQL}, s AS (SELECT DISTINCT user_id, 'a remembered note on ' || category AS text, epoch_us(ts) AS s FROM v_event),
  c AS (SELECT user_id, text, min(s) AS lead FROM s GROUP BY 1, 2 UNION ALL
    SELECT c.user_id, c.text, (SELECT min(s.s) FROM s WHERE s.user_id = c.user_id AND s.text = c.text AND s.s - c.lead > 86400000000) FROM c WHERE c.lead IS NOT NULL)
  SELECT user_id, lead AS at_us, text FROM c WHERE lead IS NOT NULL""")
def memory(spark, d):
    e = V.events(spark, d)
    kept = I.memory_dedup(e.select("user_id", "ts", F.concat(F.lit("a remembered note on "), "category").alias("text")))
    return kept.select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at_us"), "text")


@query("t31_reweight", """WITH s AS (SELECT user_id AS entry, list(CASE WHEN event_type IN ('click', 'purchase') THEN 0.3 ELSE -0.2 END ORDER BY event_id) AS v FROM events GROUP BY 1)
  SELECT entry, len(v) AS n, round(list_reduce(list_prepend(1.0::DOUBLE, v::DOUBLE[]), lambda w, x: greatest(0.05, least(5.0, w + x))), 6) AS weight FROM s""")
def reweight(spark, d):
    e = V.table(spark, d, "events").select(
        F.col("user_id").alias("entry"), F.col("event_id").alias("seq"), F.when(F.col("event_type").isin("click", "purchase"), 1).otherwise(-1).alias("rating")
    )
    return I.reweight(e).select("entry", "n", r6("weight"))


@query("u7_events_by_asset", f"""{E} SELECT country, count(DISTINCT category) AS categories, string_agg(DISTINCT category, ',' ORDER BY category) AS names FROM v_event WHERE severity >= 6 GROUP BY country""")
def merged(spark, d):
    g = V.events(spark, d).where("severity >= 6").groupBy("country").agg(F.array_sort(F.collect_set("category")).alias("c"))
    return g.select("country", F.size("c").cast("long").alias("categories"), F.array_join("c", ",").alias("names"))


@query("a31_weekly", f"""{E} SELECT CAST(date_trunc('week', ts) AS DATE) AS week, category, count(*) AS n, round(avg(severity), 6) AS avg_severity FROM v_event GROUP BY 1, 2""")
def weekly(spark, d):
    g = V.events(spark, d).groupBy(F.date_trunc("week", "ts").cast("date").alias("week"), "category")
    return g.agg(F.count("*").alias("n"), F.round(F.avg("severity"), 6).alias("avg_severity"))


@query("a6_globe", f"""{E} SELECT count(DISTINCT country) AS countries, count(DISTINCT user_id) AS users, count(*) FILTER (severity >= 7) AS high FROM v_event WHERE ts > {NOW} - INTERVAL 48 HOUR""")
def globe(spark, d):
    return K.look_back(V.events(spark, d), 48).agg(
        F.count_distinct("country").alias("countries"), F.count_distinct("user_id").alias("users"), F.count_if(F.col("severity") >= 7).alias("high")
    )
