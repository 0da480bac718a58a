"""Queries of rule-based text, news and signal operators, and of scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import lexicons as LX
from tidemark.functions import scalars as SC
from tidemark.operators import kpis as K
from tidemark.operators import rules as O
from tidemark.operators import series as S
from tidemark.operators import signals as SG
from tidemark.operators import text as TX
from tidemark.plans.catalog import query
from tidemark.sources import views as V

E, B, T, D, A, G = (f"WITH {x}" for x in (V.EVENT_SQL, V.BAR_SQL, V.TRADE_SQL, V.DOC_SQL, V.ACTIVITY_SQL, V.EDGE_SQL))
r6 = lambda c: F.round(c, 6).alias(c)


def lit_hits(terms, text="low") -> str:
    return "(" + " + ".join(f"CAST(contains({text}, '{t}') AS INT)" for t in terms) + ")"


LOW = f"{D}, l AS (SELECT doc_id, lower(body) AS low, title, length(body) AS size FROM v_doc)"


@query("t3_tone", f"""{LOW}, h AS (SELECT doc_id, {lit_hits(LX.POSITIVE)} AS p, {lit_hits(LX.NEGATIVE)} AS n, {lit_hits(LX.UNCERTAIN)} AS u, {lit_hits(LX.STRESS)} AS s FROM l),
  r AS (SELECT *, round(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, (p - n) / greatest(p + n, 1) * 0.8::DOUBLE)), 3) AS score FROM h)
  SELECT doc_id, score, round(least(1.0::DOUBLE, u / 8), 3) AS uncertainty, round(least(1.0::DOUBLE, s / 5), 3) AS market_stress,
  CASE WHEN abs(score) > 0.5 THEN 'High' WHEN abs(score) > 0.2 THEN 'Medium' ELSE 'Low' END AS intensity,
  CASE WHEN score < -0.15 THEN 'Negative' WHEN score > 0.15 THEN 'Positive' ELSE 'Neutral' END AS tone FROM r""")
def tone(spark, d):
    df = O.tone(V.documents(spark, d), F.col("body"), LX.POSITIVE, LX.NEGATIVE, LX.UNCERTAIN, LX.STRESS)
    return df.select("doc_id", "score", "uncertainty", "market_stress", "intensity", "tone")


@query("t4_class_probabilities", f"""{LOW}, h AS (SELECT doc_id, {lit_hits(LX.POSITIVE)} AS p, {lit_hits(LX.NEGATIVE)} AS n FROM l),
  r AS (SELECT doc_id, round(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, (p - n) / greatest(p + n, 1) * 0.8::DOUBLE)), 3) AS s FROM h)
  SELECT doc_id, greatest(s, 0) AS p_positive, greatest(-s, 0) AS p_negative, round(1 - abs(s), 6) AS p_neutral FROM r""")
def class_probabilities(spark, d):
    df = O.class_probabilities(O.tone(V.documents(spark, d), F.col("body"), LX.POSITIVE, LX.NEGATIVE, [], []), "score")
    return df.select("doc_id", "p_positive", "p_negative", r6("p_neutral"))


def most_hits(rules, default) -> str:
    cases = [f"({lit_hits(terms)}, -{i}, '{name}')" for i, (name, terms) in enumerate(rules.items())]
    rows = ", ".join(f"{{'s': {c.split(', -')[0][1:]}, 'o': -{i}, 'n': '{n}'}}" for i, (c, n) in enumerate(zip(cases, rules)))
    return f"(SELECT CASE WHEN b.s > 0 THEN b.n ELSE '{default}' END FROM (SELECT list_max([{rows}]) AS b))"


@query("t9_timeline_band", f"{LOW} SELECT doc_id, {most_hits(LX.BANDS, 'geopolitical')} AS band FROM l")
def band(spark, d):
    return O.best_band(V.documents(spark, d), F.col("body"), LX.BANDS, "geopolitical").select("doc_id", "band")


KINDS = {"commodity": ["and", "oil", "ring"], "org": ["the", "of"]}
ENTS = ", ".join(f"('{k}', '{e}')" for k, es in KINDS.items() for e in es)


@query("t13_graph_entities", f"""{LOW}, e AS (SELECT * FROM (VALUES {ENTS}) v(kind, entity)),
  c AS (SELECT doc_id, kind, entity, low, len(regexp_extract_all(low, '\\b' || entity || '\\b')) AS count FROM l, e)
  SELECT doc_id, kind, entity, count, round(least(1.0::DOUBLE, count / greatest(len(regexp_split_to_array(trim(low, ' \n\t\r'), '\\s+')), 1) * 10
    + CASE WHEN contains(substr(low, 1, 100), entity) THEN 0.3::DOUBLE ELSE 0 END), 6) AS salience FROM c WHERE count > 0""")
def graph_entities(spark, d):
    df = O.graph_entities(V.documents(spark, d), "doc_id", F.trim("body"), KINDS)
    return df.select("doc_id", "kind", "entity", F.col("count").cast("long").alias("count"), r6("salience"))


@query("t15_crisis_patterns", f"""{LOW} SELECT doc_id, pattern, hits, confidence, level FROM (""" + " UNION ALL ".join(
    f"SELECT doc_id, '{n}' AS pattern, {lit_hits(terms)} AS hits, round(least(1.0::DOUBLE, {lit_hits(terms)} * {w}::DOUBLE / 5), 6) AS confidence, "
    "CASE WHEN size % 10 >= 7.5 THEN 'critical' WHEN size % 10 >= 5.5 THEN 'high' ELSE 'watch' END AS level FROM l" for n, (w, terms) in LX.CRISES.items()
) + ") WHERE hits > 0")
def crisis_patterns(spark, d):
    docs = V.documents(spark, d)
    df = O.crises(docs, "doc_id", F.col("body"), F.length("body") % 10, LX.CRISES)
    return df.select("doc_id", "pattern", "hits", r6("confidence"), "level")


SECTORS = {"ports": ["port", "ship", "ering"], "chips": ["chip", "tech"], "energy": ["oil", "gas"]}


@query("t16_supply_relevance", f"""{LOW} SELECT doc_id, node, hits FROM (""" + " UNION ALL ".join(
    f"SELECT doc_id, '{n}' AS node, {lit_hits(t)} AS hits FROM l" for n, t in SECTORS.items()) + ") WHERE hits > 0")
def supply_relevance(spark, d):
    df = O.crises(V.documents(spark, d), "doc_id", F.col("body"), F.lit(0.0), {n: (1.0, t) for n, t in SECTORS.items()})
    return df.select("doc_id", F.col("pattern").alias("node"), "hits")


@query("t17_topic", f"""{LOW} SELECT doc_id, CASE {' '.join(f"WHEN {lit_hits(t)} > 0 THEN '{n}'" for n, t in LX.TOPICS.items())} ELSE 'geopolitics' END AS topic FROM l""")
def topic(spark, d):
    return V.documents(spark, d).select("doc_id", O.first_topic(F.col("body"), LX.TOPICS, "geopolitics").alias("topic"))


@query("t19_asset_relevance", f"""{E} SELECT id, round(least(1.0::DOUBLE, 0.5::DOUBLE * CASE category WHEN 'ERROR' THEN 0.9::DOUBLE WHEN 'PURCHASE' THEN 0.8::DOUBLE ELSE 0.4::DOUBLE END
  + 0.2::DOUBLE * severity / 10 + least(0.3::DOUBLE, 0.15::DOUBLE * (CAST(contains(lower(country), '1') AS INT) + CAST(contains(lower(country), '2') AS INT) + CAST(contains(lower(country), '0') AS INT)))
  + CASE WHEN region = 'ASIA' THEN 0.2::DOUBLE ELSE 0 END), 6) AS relevance FROM v_event""")
def asset_relevance(spark, d):
    weight = F.when(F.col("category") == "ERROR", 0.9).when(F.col("category") == "PURCHASE", 0.8).otherwise(0.4)
    rel = O.asset_relevance(weight, F.col("severity"), TX.hits(F.col("country"), ["1", "2", "0"]), F.col("region") == "ASIA")
    return V.events(spark, d).select("id", F.round(rel, 6).alias("relevance"))


@query("t26_date_clusters", f"""WITH RECURSIVE {V.EVENT_SQL}, s AS (SELECT DISTINCT country, category, epoch_us(ts) AS s FROM v_event),
  c AS (SELECT country, category, min(s) AS lead FROM s GROUP BY 1, 2 UNION ALL
    SELECT c.country, c.category, (SELECT min(s.s) FROM s WHERE s.country = c.country AND s.category = c.category AND s.s - c.lead > 86400000000) FROM c WHERE c.lead IS NOT NULL)
  SELECT id, (SELECT max(lead) FROM c WHERE c.country = e.country AND c.category = e.category AND c.lead <= epoch_us(e.ts)) AS cluster FROM v_event e""")
def date_clusters(spark, d):
    df = O.date_clusters(V.events(spark, d), ["country", "category"], "ts", 1)
    return df.select("id", F.unix_micros("cluster").alias("cluster"))


@query("t22_similar_items", f"""{D}, t AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(body), '[a-z]{{4,}}')) AS term FROM v_doc) GROUP BY 1, 2),
  n AS (SELECT count(*) AS n FROM v_doc), f AS (SELECT term, count(*) AS df FROM t GROUP BY term),
  w AS (SELECT doc_id, term, tf * (ln((1 + n) / (1 + df)) + 1) AS w FROM t JOIN f USING (term), n),
  u AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS w FROM w),
  p AS (SELECT a.doc_id AS seed, b.doc_id, sum(a.w * b.w) AS s FROM u a JOIN u b ON a.term = b.term AND a.doc_id <> b.doc_id WHERE a.doc_id % 20 = 0 GROUP BY 1, 2)
  SELECT seed, doc_id, round(s, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY round(s, 9) DESC, doc_id) AS r FROM p WHERE s >= 0.25) WHERE r <= 5""")
def similar_items(spark, d):
    w = TX.tfidf(V.documents(spark, d), "doc_id", F.col("body"), 4)
    name = [c for c in w.columns if c not in ("doc_id", "term", "tf", "df")][0]
    w = w.select("doc_id", "term", F.col(name).alias("weight"), "df")
    seeds = w.select("doc_id").distinct().where("doc_id % 20 = 0")  # a stated query set against all rows
    df = O.similar_to(w.where("df > 1"), "doc_id", seeds, 0.25, 5)  # words of one text meet no other
    return df.select("seed", "doc_id", r6("similarity"))


CUES = ["error", "purchase"]


@query("g27_news_edges", f"""{E}, p AS (SELECT id AS tgt, ts, country, category, lag(id) OVER w AS src, lag(ts) OVER w AS t0, lag(country) OVER w AS c0
    FROM v_event WINDOW w AS (PARTITION BY region ORDER BY ts, id)), q AS (SELECT *, lag(category) OVER (PARTITION BY 1 ORDER BY tgt) AS z FROM p)
  SELECT src, tgt, kind, CASE kind WHEN 'causal' THEN 0.55 ELSE 0.4 END::DOUBLE AS weight FROM (
    SELECT src, tgt, CASE WHEN p.country = c0 AND (p.category IN ('ERROR', 'PURCHASE') OR e.category IN ('ERROR', 'PURCHASE')) THEN 'causal'
      WHEN p.ts <= t0 + INTERVAL 2 HOUR THEN 'temporal' END AS kind FROM p JOIN v_event e ON e.id = p.src) WHERE kind IS NOT NULL""")
def news_edges(spark, d):
    e = V.events(spark, d).select("id", "ts", "country", F.col("category").alias("text"), F.col("region").alias("category"))
    return O.news_edges(e, CUES)


@query("g6_node_risk", f"""{E} SELECT country AS node, round(least(10.0::DOUBLE, max(severity * (k + 1) / 100)), 6) AS risk FROM v_event GROUP BY country""")
def node_risk(spark, d):
    links = V.events(spark, d).select(F.col("country").alias("node"), "severity", ((F.col("k") + 1) / 100).alias("salience"))
    return O.node_risks(links).select("node", r6("risk"))


@query("g17_asset_pressure", f"""{E}, s AS (SELECT country AS node, avg(severity) / 1000 AS strength FROM v_event GROUP BY country),
  f AS (SELECT n_name AS node, r_name AS asset, CASE WHEN n_nationkey < 12 THEN 1 ELSE -1 END AS sign FROM nation JOIN region ON n_regionkey = r_regionkey)
  SELECT asset, round(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, sum(sign * strength))), 6) AS pressure FROM s JOIN f USING (node) GROUP BY asset""")
def asset_pressure(spark, d):
    seeds = V.events(spark, d).groupBy(F.col("country").alias("node")).agg((F.avg("severity") / 1000).alias("strength"))
    n = V.table(spark, d, "nation").join(V.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    effects = n.select(F.col("n_name").alias("node"), F.col("r_name").alias("asset"), F.when(F.col("n_nationkey") < 12, 1).otherwise(-1).alias("sign"))
    return O.asset_pressure(seeds, effects).select("asset", r6("pressure"))


@query("g22_node_search", """SELECT p_partkey AS node, p_name AS label, n FROM part JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_partkey = p_partkey
  WHERE contains(lower(p_name), 'ring') ORDER BY n DESC, node LIMIT 20""")
def node_search(spark, d):
    n = V.table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("node")).agg(F.count("*").alias("n"))
    nodes = V.table(spark, d, "part").select(F.col("p_partkey").alias("node"), F.col("p_name").alias("label"))
    return O.node_search(nodes.join(n, "node"), "ring", 20).select("node", "label", "n")


@query("g23_pruned", f"""{G}, e AS (SELECT src, tgt, n, n / 50.0::DOUBLE AS weight FROM v_edge WHERE n / 50.0::DOUBLE >= 0.4),
  k AS (SELECT node FROM (SELECT src AS node, weight FROM e UNION ALL SELECT tgt, weight FROM e) GROUP BY node ORDER BY round(sum(weight), 9) DESC, node LIMIT 60)
  SELECT src, tgt, n FROM e WHERE src IN (SELECT node FROM k) AND tgt IN (SELECT node FROM k)""")
def pruned(spark, d):
    return O.prune(V.edges(spark, d).withColumn("weight", F.round(F.col("n") / 50, 9)), 0.4, 60).select("src", "tgt", "n")


@query("g25_new_edges", f"""{E}, o AS (SELECT region AS src, category AS tgt, count(*) FILTER (ts > (SELECT max(ts) FROM v_event) - INTERVAL 24 HOUR) AS fresh FROM v_event GROUP BY 1, 2)
  SELECT src, tgt, fresh FROM o WHERE fresh >= 1 ORDER BY fresh DESC, src, tgt LIMIT 10""")
def new_edges(spark, d):
    e = K.look_back(V.events(spark, d), 24).groupBy(F.col("region").alias("src"), F.col("category").alias("tgt")).agg(F.count("*").alias("fresh"))
    return e.orderBy(F.desc("fresh"), "src", "tgt").limit(10)


@query("g26_grid_clusters", f"""{E}, p AS (SELECT id, category, severity, user_id * 37 % 180 - 90 AS lat, k * 53 % 360 - 180 AS lon FROM v_event),
  c AS (SELECT *, CAST(floor(lat / 12) AS BIGINT) AS lat_cell, CAST(floor(lon / 12) AS BIGINT) AS lon_cell FROM p),
  k AS (SELECT lat_cell, lon_cell, category, count(*) AS n, sum(lat) AS y, sum(lon) AS x, max({{'s': severity, 'id': id}}) AS t FROM c GROUP BY 1, 2, 3)
  SELECT lat_cell, lon_cell, sum(n)::BIGINT AS members, round(sum(y) / sum(n), 6) AS lat, round(sum(x) / sum(n), 6) AS lon, max({{'n': n, 'c': category}}).c AS category,
  max(t).id AS top_id FROM k GROUP BY 1, 2 HAVING sum(n) >= 3""")
def grid(spark, d):
    pts = V.events(spark, d).select("id", "category", "severity", (F.col("user_id") * 37 % 180 - 90).alias("lat"), (F.col("k") * 53 % 360 - 180).alias("lon"))
    return O.grid_clusters(pts, 12).select("lat_cell", "lon_cell", "members", r6("lat"), r6("lon"), "category", "top_id")


NAV = f"""{B}, r AS (SELECT symbol, date, close / lag(close) OVER w - 1 AS ret, 100 * close / first_value(close) OVER w AS nav FROM v_bar WINDOW w AS (PARTITION BY symbol ORDER BY date)),
  g AS (SELECT *, (max(nav) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING) - nav) / max(nav) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING) AS dd FROM r),
  a AS (SELECT symbol, arg_max(nav, date) AS last, count(ret) AS n, avg(ret) AS m, stddev_samp(ret) AS s, sqrt(sum(ret * ret) FILTER (ret < 0) / greatest(count(*) FILTER (ret < 0), 1)) AS d, max(dd) AS dd FROM g GROUP BY symbol)"""


@query("q2_backtest_metrics", f"""{NAV} SELECT symbol, round(last - 100, 5) AS total_return, round((pow(last / 100, 252 / n) - 1) * 100, 5) AS annual_return,
  round(m * 252 / (s * sqrt(252) + 1e-9), 6) AS sharpe, round(m * 252 / (d * sqrt(252) + 1e-9), 6) AS sortino, round(dd * 100, 6) AS max_drawdown,
  round((pow(last / 100, 252 / n) - 1) * 100 / (dd * 100 + 1e-9), 6) AS calmar FROM a""")
def backtest_metrics(spark, d):
    nav = S.returns(V.bars(spark, d)).withColumn("nav", F.try_divide(100 * F.col("close"), F.first("close").over(S.by())))
    df = O.backtest_metrics(nav)
    return df.select("symbol", F.round("total_return", 5).alias("total_return"), F.round("annual_return", 5).alias("annual_return"), *map(r6, ("sharpe", "sortino", "max_drawdown", "calmar")))


@query("q10_technical_summary", f"""{B}, m AS (SELECT symbol, date, close, avg(close) OVER (w ROWS 19 PRECEDING) AS s20, avg(close) OVER (w ROWS 49 PRECEDING) AS s50, avg(close) OVER (w ROWS 199 PRECEDING) AS s200,
    max(high) OVER (w ROWS 19 PRECEDING) AS resistance, min(low) OVER (w ROWS 19 PRECEDING) AS support FROM v_bar WINDOW w AS (PARTITION BY symbol ORDER BY date))
  SELECT symbol, round(close, 6) AS close, round(s20, 6) AS sma20, round(s50, 6) AS sma50, round(s200, 6) AS sma200, round(resistance, 6) AS resistance, round(support, 6) AS support,
  CASE WHEN close > s20 AND s20 > s50 THEN 'up' WHEN close < s20 AND s20 < s50 THEN 'down' ELSE 'flat' END AS trend
  FROM m QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) = 1""")
def technical_summary(spark, d):
    df = S.sma(S.sma(S.sma(V.bars(spark, d), 20), 50), 200)
    df = df.withColumn("resistance", F.max("high").over(S.last(20))).withColumn("support", F.min("low").over(S.last(20)))
    up, down = (F.col("close") > F.col("sma20")) & (F.col("sma20") > F.col("sma50")), (F.col("close") < F.col("sma20")) & (F.col("sma20") < F.col("sma50"))
    df = K.top_per_group(df.withColumn("trend", F.when(up, "up").when(down, "down").otherwise("flat")), "symbol", [F.desc("date")], 1)
    return df.select("symbol", *map(r6, ("close", "sma20", "sma50", "sma200", "resistance", "support")), "trend")


@query("x5_ensemble", f"""{B}, r AS (SELECT symbol, date, sign(close / lag(close, 20) OVER w - 1) AS a, sign(close / lag(close, 5) OVER w - 1) AS b, sign(close / lag(close, 60) OVER w - 1) AS c FROM v_bar WINDOW w AS (PARTITION BY symbol ORDER BY date)),
  n AS (SELECT *, CAST(coalesce(a > 0, false) AS INT) + CAST(coalesce(b > 0, false) AS INT) + CAST(coalesce(c > 0, false) AS INT) AS up,
    CAST(coalesce(a < 0, false) AS INT) + CAST(coalesce(b < 0, false) AS INT) + CAST(coalesce(c < 0, false) AS INT) AS down FROM r)
  SELECT symbol, date, CASE WHEN up >= 2 THEN 'BUY' WHEN down >= 2 THEN 'SELL' ELSE 'HOLD' END AS action,
  CASE WHEN greatest(up, down) = 3 THEN 0.75 WHEN greatest(up, down) = 2 THEN 0.6 ELSE 0 END::DOUBLE AS strength FROM n""")
def ensemble(spark, d):
    df = V.bars(spark, d)
    for i, n in enumerate((20, 5, 60)):
        df = SG.momentum_sign(df, n).withColumnRenamed("action", f"v{i}")
    action, strength = O.ensemble([F.col(f"v{i}") for i in range(3)], [F.lit(0.6)] * 3)
    return df.select("symbol", "date", action.alias("action"), F.round(strength, 6).alias("strength"))


@query("x6_sentiment_signal", f"""{E}, s AS (SELECT country, (avg(severity) FILTER (ts > (SELECT max(ts) FROM v_event) - INTERVAL 120 HOUR) - avg(severity)) AS news,
    count(*) FILTER (severity >= 7) / count(*) AS critical FROM v_event GROUP BY country),
  t AS (SELECT country, greatest(-1.0::DOUBLE, least(1.0::DOUBLE, 0.6::DOUBLE * coalesce(news, 0) - 0.4::DOUBLE * critical)) AS strength FROM s)
  SELECT country, round(strength, 6) AS strength, CASE WHEN strength > 0.1 THEN 'BUY' WHEN strength < -0.1 THEN 'SELL' ELSE 'HOLD' END AS action FROM t""")
def sentiment_signal(spark, d):
    e = V.events(spark, d)
    late = F.col("ts") > K.now_of(e) - F.expr("INTERVAL 120 HOURS")
    s = e.withColumn("late", late).groupBy("country").agg(
        (F.avg(F.when(F.col("late"), F.col("severity"))) - F.avg("severity")).alias("news"), (F.count(F.when(F.col("severity") >= 7, 1)) / F.count("*")).alias("critical"), F.lit(50.0).alias("rsi")
    )
    return O.sentiment_signal(s, {"news": 0.6, "critical": -0.4}, 0.1).select("country", r6("strength"), "action")


@query("t34_signal_explanation", f"""{E}, c AS (SELECT id, CASE WHEN severity >= 5 THEN 40.0 ELSE 0 END::DOUBLE AS sev, CASE WHEN category = 'ERROR' THEN 30.0 ELSE 0 END::DOUBLE AS kind,
    CASE WHEN region = 'ASIA' THEN 20.0 ELSE 0 END::DOUBLE AS place, severity / 10 AS strength FROM v_event),
  f AS (SELECT *, round(least(100.0::DOUBLE, 0.6::DOUBLE * (sev + kind + place) + 40 * strength), 6) AS confidence FROM c),
  u AS (SELECT id, confidence, unnest([{{'r': 'severity', 'c': sev}}, {{'r': 'kind', 'c': kind}}, {{'r': 'place', 'c': place}}]) AS p FROM f)
  SELECT id, confidence, CASE WHEN confidence >= 70 THEN 'strong' WHEN confidence >= 40 THEN 'moderate' ELSE 'weak' END AS label, p.r AS rule, p.c AS contribution FROM u WHERE p.c > 0""")
def explanation(spark, d):
    when = lambda c, v: F.when(c, v).otherwise(0.0)
    rules = {"severity": when(F.col("severity") >= 5, 40.0), "kind": when(F.col("category") == "ERROR", 30.0), "place": when(F.col("region") == "ASIA", 20.0)}
    return O.explain(V.events(spark, d), rules, F.col("severity") / 10).select("id", r6("confidence"), "label", "rule", "contribution")


@query("t35_trade_autopsy", f"""{T}, p AS (SELECT l_orderkey, l_linenumber, (price / avg(price) OVER (PARTITION BY symbol) - 1) * 10 AS pnl, qty / 12 AS ratio FROM v_trade WHERE side = 'SELL'),
  o AS (SELECT *, CASE WHEN pnl > 0.5 THEN 'win' WHEN pnl < -0.5 THEN 'loss' ELSE 'flat' END AS outcome,
    CASE WHEN ratio >= 3 THEN 'A' WHEN ratio >= 2 THEN 'B' WHEN ratio >= 1 THEN 'C' ELSE 'D' END AS grade FROM p)
  SELECT l_orderkey, l_linenumber, outcome, grade, CASE WHEN outcome = 'win' AND grade <= 'B' THEN 'good plan paid' WHEN outcome = 'win' THEN 'lucky'
    WHEN outcome = 'loss' AND grade >= 'C' THEN 'poor plan' WHEN outcome = 'loss' THEN 'good plan failed' ELSE 'no edge' END AS lesson FROM o""")
def trade_autopsy(spark, d):
    from pyspark.sql import Window as W

    t = V.trades(spark, d).where("side = 'SELL'")
    mean = F.avg("price").over(W.partitionBy("symbol"))
    t = t.withColumn("pnl", (F.col("price") / mean - 1) * 10).withColumn("reward_risk", F.col("qty") / 12)
    return O.autopsy(t).select("l_orderkey", "l_linenumber", "outcome", "grade", "lesson")


@query("st3_velocity", f"""{E}, n AS (SELECT max(ts) AS t FROM v_event) SELECT country, count(*) FILTER (ts > t - INTERVAL 24 HOUR) AS now,
  count(*) FILTER (ts <= t - INTERVAL 24 HOUR AND ts > t - INTERVAL 48 HOUR) AS before,
  round(avg(severity) FILTER (ts > t - INTERVAL 24 HOUR) - avg(severity) FILTER (ts <= t - INTERVAL 24 HOUR AND ts > t - INTERVAL 48 HOUR), 6) AS momentum FROM v_event, n GROUP BY country""")
def velocity(spark, d):
    e = V.events(spark, d)
    t = K.now_of(e)
    day = F.expr("INTERVAL 24 HOURS")
    e = e.withColumn("w", F.when(F.col("ts") > t - day, "now").when(F.col("ts") > t - F.expr("INTERVAL 48 HOURS"), "before"))
    n = lambda w: F.count(F.when(F.col("w") == w, 1)).alias(w)
    m = lambda w: F.avg(F.when(F.col("w") == w, F.col("severity")))
    return e.groupBy("country").agg(n("now"), n("before"), F.round(m("now") - m("before"), 6).alias("momentum"))


@query("sf1_short_ids", f"{D} SELECT doc_id, substr(md5(source || ':' || title), 1, 12) AS short_id FROM v_doc")
def short_ids(spark, d):
    return V.documents(spark, d).select("doc_id", F.substring(F.md5(F.concat_ws(":", "source", "title")), 1, 12).alias("short_id"))


@query("sf4_truncate", f"{D} SELECT doc_id, substr(title, 1, 80) AS short_title, substr(body, 1, 300) AS summary FROM v_doc")
def truncate(spark, d):
    return V.documents(spark, d).select("doc_id", F.substring("title", 1, 80).alias("short_title"), F.substring("body", 1, 300).alias("summary"))


@query("sf2_clean_html", r"""SELECT page_id, md5(trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]*>', ' ', 'g'),
  '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&apos;', ''''), '&nbsp;', ' '), '&amp;', '&'), '\s+', ' ', 'g'))) AS digest FROM pages""")
def clean_html(spark, d):
    return V.table(spark, d, "pages").select("page_id", F.md5(SC.clean_html(F.col("html"))).alias("digest"))


@query("sf7_market_impact", f"""{E} SELECT id, round(least(1.0::DOUBLE, severity / 10 * (abs((k - 50) / 50) + 0.1::DOUBLE)), 6) AS impact,
  CASE WHEN severity >= 7 THEN 'High' WHEN severity >= 4 THEN 'Medium' ELSE 'Low' END AS band FROM v_event""")
def impact(spark, d):
    value = SC.market_impact(F.col("severity"), (F.col("k") - 50) / 50)
    return V.events(spark, d).select("id", F.round(value, 6).alias("impact"), K.impact(F.col("severity")).alias("band"))


@query("sf9_disclosure_lag", "SELECT l_orderkey, l_linenumber, date_diff('day', o_orderdate, l_shipdate) AS lag_days FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def lag_days(spark, d):
    o = V.table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    days = F.datediff("l_shipdate", "o_orderdate").cast("long").alias("lag_days")
    return V.table(spark, d, "lineitem").join(o, "l_orderkey").select("l_orderkey", "l_linenumber", days)


@query("sf12_risk_reward", f"""{B} SELECT symbol, date, round(close - 2 * (high - low), 6) AS stop, round(close + 3 * (high - low), 6) AS target,
  round(CASE WHEN close > 0 THEN 200 * (high - low) / close END, 6) AS risk_pct, round(CASE WHEN close > 0 THEN 300 * (high - low) / close END, 6) AS reward_pct FROM v_bar""")
def risk_reward(spark, d):
    stop, target, risk, reward = SC.trade_plan(F.col("close"), F.col("high") - F.col("low"), 2, 3)
    cols = {"stop": stop, "target": target, "risk_pct": risk, "reward_pct": reward}
    return V.bars(spark, d).select("symbol", "date", *[F.round(c, 6).alias(n) for n, c in cols.items()])


@query("sf13_grades", f"""{E} SELECT id, CASE WHEN s >= 900 THEN 'S' WHEN s >= 800 THEN 'A' WHEN s >= 650 THEN 'B' WHEN s >= 500 THEN 'C' WHEN s >= 350 THEN 'D' ELSE 'F' END AS grade
  FROM (SELECT id, severity * 100 AS s FROM v_event)""")
def grades(spark, d):
    return V.events(spark, d).select("id", SC.grade(F.col("severity") * 100).alias("grade"))


@query("sf14_resolution", f"""{B}, r AS (SELECT symbol, date, (close / lag(close) OVER (PARTITION BY symbol ORDER BY date) - 1) * 100 AS c FROM v_bar)
  SELECT symbol, date, CASE WHEN c > 0.5 THEN 'up' WHEN c < -0.5 THEN 'down' WHEN c IS NOT NULL THEN 'stable' END AS moved FROM r""")
def resolution(spark, d):
    change = (F.try_divide("close", F.lag("close").over(S.by())) - 1) * 100
    return V.bars(spark, d).select("symbol", "date", SC.moved(change).alias("moved"))


@query("sf17_json", """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, '{"k":' || json_extract_string(props, '$.k') || ',"type":"' || event_type || '"}' AS encoded FROM events""")
def json_codec(spark, d):
    k = F.from_json("props", "k long")["k"]
    return V.table(spark, d, "events").select("event_id", k.alias("k"), F.to_json(F.struct(k.alias("k"), F.col("event_type").alias("type"))).alias("encoded"))


@query("sf19_regimes", f"""{E} SELECT id, CASE WHEN v >= 30 THEN 'panic' WHEN v >= 20 THEN 'stressed' WHEN v >= 15 THEN 'normal' ELSE 'calm' END AS regime,
  round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1 - (v - 10) / 40)), 6) AS fear_greed FROM (SELECT id, severity * 5 AS v FROM v_event)""")
def regimes(spark, d):
    v = F.col("severity") * 5
    return V.events(spark, d).select("id", SC.volatility_regime(v).alias("regime"), F.round(SC.fear_greed(v), 6).alias("fear_greed"))


@query("sf15_probability_label", f"""{E} SELECT id, CASE WHEN p >= 0.8 THEN 'very likely' WHEN p >= 0.6 THEN 'likely' WHEN p >= 0.4 THEN 'even' WHEN p >= 0.2 THEN 'unlikely' ELSE 'very unlikely' END AS label
  FROM (SELECT id, k / 100 AS p FROM v_event)""")
def probability(spark, d):
    return V.events(spark, d).select("id", SC.probability_label(F.col("k") / 100).alias("label"))


@query("w12_williams", f"""{B} SELECT symbol, date, round(CASE WHEN row_number() OVER w >= 14 THEN CASE WHEN h = l THEN -50 ELSE -100 * (h - close) / (h - l) END END, 6) + 0.0 AS williams FROM (
  SELECT *, max(high) OVER (PARTITION BY symbol ORDER BY date ROWS 13 PRECEDING) AS h, min(low) OVER (PARTITION BY symbol ORDER BY date ROWS 13 PRECEDING) AS l FROM v_bar) WINDOW w AS (PARTITION BY symbol ORDER BY date)""")
def williams(spark, d):
    return S.stochastic(V.bars(spark, d)).select("symbol", "date", (F.round("williams", 6) + 0.0).alias("williams"))


@query("w27_normalised_nav", f"{B} SELECT symbol, date, round(100 * close / first_value(close) OVER (PARTITION BY symbol ORDER BY date), 6) AS nav FROM v_bar")
def normalised(spark, d):
    return V.bars(spark, d).select("symbol", "date", F.round(F.try_divide(100 * F.col("close"), F.first("close").over(S.by())), 6).alias("nav"))


@query("sf5_recency", f"""{E}, a AS (SELECT id, CASE WHEN id % 7 > 0 THEN (epoch_us((SELECT max(ts) FROM v_event)) - epoch_us(ts)) / 3600000000 END AS age FROM v_event)
  SELECT id, round(coalesce(greatest(0.4, exp(-age / 72)), 0.7)::DOUBLE, 9) AS recency FROM a""")
def recency(spark, d):
    e = V.events(spark, d)
    # every seventh event has no readable time
    now = F.unix_micros(K.now_of(e).cast("timestamp"))
    age = F.when(F.col("id") % 7 > 0, (now - F.unix_micros(F.col("ts").cast("timestamp"))) / 3_600_000_000)
    return e.select("id", F.round(SC.recency(age), 9).alias("recency"))
