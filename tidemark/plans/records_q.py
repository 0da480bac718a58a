"""Queries of raw records, exports, digests and model portfolios."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.lexicons import ACTION_CATEGORY, PORTFOLIOS, TOPICS
from tidemark.operators import records as R
from tidemark.plans.catalog import query
from tidemark.sources import views as V

E, B, D, G = (f"WITH {x}" for x in (V.EVENT_SQL, V.BAR_SQL, V.DOC_SQL, V.EDGE_SQL))
TOPIC_NAMES = list(TOPICS)


@query("s6_action_codes", f"""WITH c(code, category) AS (VALUES {", ".join(f"('{k}', '{v}')" for k, v in ACTION_CATEGORY.items())}),
  r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, lpad(CAST(l_partkey % 24 AS VARCHAR), 2, '0') || CAST(l_linenumber AS VARCHAR) AS code,
  CASE WHEN l_linenumber <> 6 THEN l_quantity / 2.5 - 10 END AS scale FROM lineitem)
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, r.code, coalesce(c.category, 'GEOPOLITICS') AS category,
  (CASE WHEN scale IS NULL THEN 5 ELSE round(least(10, greatest(1, 5 - scale / 2)), 1) END)::DOUBLE AS severity FROM r LEFT JOIN c ON c.code = r.code[1:2]""")
def action_codes(spark, d):
    code = F.concat(F.lpad((F.col("l_partkey") % 24).cast("string"), 2, "0"), F.col("l_linenumber").cast("string"))
    scale = F.when(F.col("l_linenumber") != 6, F.col("l_quantity") / 2.5 - 10)
    df = V.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", code.alias("code"), scale.alias("scale"))
    return df.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "code", R.action_category(F.col("code")).alias("category"), R.scale_severity(F.col("scale")).alias("severity"))


@query("s9_coin_quotes", """SELECT 'c' || CAST(o_orderkey AS VARCHAR) AS coin, round(o_totalprice, 6)::DOUBLE AS value, (o_custkey % 40 * 5 - 100)::DOUBLE AS change_pct,
  round(CASE WHEN o_custkey % 40 = 0 THEN o_totalprice ELSE o_totalprice / (1 + (o_custkey % 40 * 5 - 100) / 100) END, 6)::DOUBLE AS previous FROM orders""")
def coin_quotes(spark, d):
    change = (F.col("o_custkey") % 40 * 5 - 100).cast("double")
    quote = F.struct(F.col("o_totalprice").cast("double").alias("usd"), change.alias("usd_24h_change"))
    raw = V.table(spark, d, "orders").select(F.to_json(F.create_map(F.concat(F.lit("c"), F.col("o_orderkey").cast("string")), quote)).alias("value"))
    return R.coin_quotes(raw).select("coin", "value", "previous", "change_pct")


@query("s10_earnings", """SELECT o_custkey, symbol, date, eps, place::INTEGER AS place FROM (SELECT o_custkey, 'o' || CAST(o_orderkey AS VARCHAR) AS symbol,
  CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS date, (o_orderkey % 90)::DOUBLE AS eps, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS place
  FROM orders WHERE o_orderkey % 3 <> 0) WHERE place <= 10""")
def earnings(spark, d):
    eps = F.when(F.col("o_orderkey") % 3 == 0, F.lit("n/a")).otherwise((F.col("o_orderkey") % 90).cast("string"))
    line = F.concat_ws(",", F.concat(F.lit("o"), F.col("o_orderkey").cast("string")), F.col("o_orderdate").cast("date").cast("string"), eps)
    lines = V.table(spark, d, "orders").select("o_custkey", "o_orderkey", line.alias("value"))
    return R.earnings(lines, "o_custkey", "o_orderkey").select("o_custkey", "symbol", "date", "eps", "place")


@query("s11_latest_quotes", f"""{B}, p AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS p FROM v_bar WHERE close IS NOT NULL),
  q AS (SELECT symbol, max(close) FILTER (p = 1) AS c, max(close) FILTER (p = 2) AS b, count(*) AS n, max(close) FILTER (p = 10) AS oldest FROM p WHERE p <= 10 GROUP BY symbol)
  SELECT symbol, round(c, 4) AS price, round((c / coalesce(b, c) - 1) * 100, 3) AS change_pct, round(c - coalesce(b, c), 4) AS change_abs, n, round(oldest, 4) AS oldest FROM q""")
def latest_quotes(spark, d):
    q = R.latest_quotes(V.bars(spark, d))
    oldest = F.when(F.size("history") == 10, F.col("history")[0])
    return q.select("symbol", "price", "change_pct", "change_abs", F.size("history").cast("long").alias("n"), oldest.alias("oldest"))


@query("s13_disclosures", """WITH t AS (SELECT o_orderkey, o_custkey, o_orderstatus, CAST(o_orderdate AS DATE) AS day,
  CASE o_orderkey % 5 WHEN 0 THEN '--' WHEN 1 THEN '' ELSE 'AB' || CAST(o_custkey % 30 AS VARCHAR) END AS ticker FROM orders)
  SELECT CASE o_orderstatus WHEN 'F' THEN 'house' ELSE 'senate' END AS chamber, CAST(o_custkey AS VARCHAR) AS name, ticker,
  CASE WHEN o_orderkey % 2 = 0 THEN 'purchase' ELSE 'sale' END AS transaction_type, CAST(day AS VARCHAR) AS transaction_date,
  (CASE WHEN o_orderstatus = 'F' THEN o_orderkey % 45 ELSE 0 END)::INTEGER AS disclosure_lag FROM t WHERE ticker LIKE 'AB%'""")
def disclosures(spark, d):
    key = F.col("o_orderkey")
    day = F.col("o_orderdate").cast("date")
    ticker = F.when(key % 5 == 0, "--").when(key % 5 == 1, " ").otherwise(F.concat(F.lit(" ab"), (F.col("o_custkey") % 30).cast("string")))
    o = V.table(spark, d, "orders").select(
        "o_orderstatus", F.col("o_custkey").cast("string").alias("name"), ticker.alias("ticker"), F.when(key % 2 == 1, "Sale").alias("type"),
        day.cast("string").alias("transaction_date"), F.date_add(day, (key % 45).cast("int")).cast("string").alias("disclosure_date"),
    )
    record = F.struct(F.col("name").alias("representative"), "ticker", "type", "transaction_date", "disclosure_date")
    flat = o.where("o_orderstatus = 'F'").select(F.to_json(record).alias("value"))
    own = o.where("o_orderstatus <> 'F'").groupBy("name").agg(F.collect_list(F.struct("ticker", "type", "transaction_date")).alias("transactions"))
    nested = own.select(F.to_json(F.struct(F.col("name").alias("senator"), "transactions")).alias("value"))
    return R.disclosures(flat, nested).select("chamber", "name", "ticker", "transaction_type", "transaction_date", "disclosure_lag")


@query("s26_node_link", f"""{G}, e AS (SELECT * FROM v_edge WHERE weight >= 0.1 AND tgt <> 'n3'), n AS (SELECT 's' || CAST(s_suppkey AS VARCHAR) AS id, 'supplier' AS node_type FROM supplier
  UNION ALL SELECT 'n' || CAST(n_nationkey AS VARCHAR), 'nation' FROM nation WHERE n_nationkey <> 3)
  SELECT id, node_type, (SELECT count(*) FROM e WHERE e.tgt = n.id) AS in_degree FROM n""")
def node_link(spark, d):
    s = V.table(spark, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"), F.lit("supplier").alias("node_type"))
    kind = F.when(F.col("n_nationkey") == 3, "other").otherwise("nation")
    n = V.table(spark, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"), kind.alias("node_type"))
    return R.node_link(s.unionByName(n), V.edges(spark, d), 0.1, ["supplier", "nation"])[0]


@query("t32_digest_lines", f"""{E}, t AS (SELECT *, category || ' in ' || country AS title FROM v_event WHERE ts > (SELECT max(ts) FROM v_event) - INTERVAL 24 HOUR AND severity >= 6 ORDER BY severity DESC, id LIMIT 12),
  p AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY severity DESC, id) AS place FROM t),
  f AS (SELECT category, row_number() OVER (ORDER BY severity DESC, id) AS nth FROM p WHERE place = 1)
  SELECT nth::INTEGER AS nth, category, place::INTEGER AS place, '[' || CAST(CAST(round(severity) AS INTEGER) AS VARCHAR) || '/10] ' || title || ' - ' || country AS line
  FROM p JOIN f USING (category) WHERE nth <= 4 AND place <= 3""")
def digest_lines(spark, d):
    e = V.events(spark, d).withColumn("title", F.concat_ws(" in ", "category", "country"))
    newest = e.agg(F.max("ts").alias("newest"))  # one row
    near = e.join(F.broadcast(newest)).where("ts > newest - INTERVAL 24 HOURS AND severity >= 6")
    return R.digest_lines(near)


@query("t33_best_topic", f"""{D}, w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(body, '')), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS w FROM v_doc),
  s AS (SELECT doc_id, t.i, t.topic, len(list_filter(w, lambda x: contains(t.topic, x) OR contains(x, t.topic))) AS score
    FROM w, (VALUES {", ".join(f"({i}, '{t}')" for i, t in enumerate(TOPIC_NAMES))}) t(i, topic))
  SELECT doc_id, CASE WHEN max(score) > 0 THEN arg_max(topic, score * 100 - i) END AS topic, max(score)::INTEGER AS score FROM s GROUP BY doc_id""")
def best_topic(spark, d):
    topic, score = R.best_topic(F.coalesce("body", F.lit("")), TOPIC_NAMES)
    return V.documents(spark, d).select("doc_id", topic.alias("topic"), score.alias("score"))


@query("st9_running_pairs", """WITH m AS (SELECT DISTINCT l_orderkey, l_suppkey % 40 AS s FROM lineitem)
  SELECT x.s AS a, y.s AS b, count(*) AS n FROM m x JOIN m y ON x.l_orderkey = y.l_orderkey AND x.s < y.s GROUP BY 1, 2""")
def running_pairs(spark, d):
    own = V.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.col("l_suppkey") % 40).alias("nodes"))
    return R.running_pairs(own, "nodes")


@query("x11_model_portfolio", f"""WITH p(risk, ticker, pct) AS (VALUES {", ".join(f"('{r}', '{t}', {p})" for r, x in PORTFOLIOS.items() for t, p in x.items())}),
  c AS (SELECT CASE WHEN c_acctbal < 2000 THEN 'Conservative' WHEN c_acctbal < 6000 THEN 'Moderate' ELSE 'Aggressive' END AS risk, c_acctbal AS amount FROM customer WHERE c_acctbal > 0)
  SELECT risk, ticker, count(*) AS n, round(sum(amount * pct / 100), 2)::DOUBLE AS amount FROM c JOIN p USING (risk) GROUP BY 1, 2""")
def model_portfolio(spark, d):
    balance = F.col("c_acctbal")
    risk = F.when(balance < 2000, "Conservative").when(balance < 6000, "unknown").otherwise("Aggressive")
    clients = V.table(spark, d, "customer").where("c_acctbal > 0").select(risk.alias("risk"), balance.cast("double").alias("amount"))
    df = R.model_portfolio(clients).groupBy("risk", "ticker")
    return df.agg(F.count("*").alias("n"), F.round(F.sum("part"), 2).alias("amount"))


@query("s25_labelled_signals", """WITH s AS (SELECT *, l_partkey % 50 AS symbol, CASE l_returnflag WHEN 'R' THEN 'SELL' WHEN 'A' THEN 'BUY' ELSE 'HOLD' END AS action FROM lineitem WHERE l_linenumber <> 1),
  p AS (SELECT *, row_number() OVER (PARTITION BY symbol, action ORDER BY l_shipdate DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS p FROM s WHERE action <> 'HOLD'),
  n AS (SELECT *, max(p) OVER (PARTITION BY symbol, action) AS n FROM p WHERE p <= 200)
  SELECT symbol, action, l_orderkey, l_linenumber, CASE WHEN l_linenumber <> 7 THEN l_quantity END::DOUBLE AS qty, outcome FROM
  (SELECT *, CASE WHEN l_quantity > 25 THEN 'WIN' ELSE 'LOSS' END AS outcome FROM n WHERE n >= 50)""")
def labelled_signals(spark, d):
    action = F.when(F.col("l_returnflag") == "R", "SELL").when(F.col("l_returnflag") == "A", "BUY").otherwise("HOLD")
    features = F.when(F.col("l_linenumber") == 7, F.lit("{broken")).otherwise(F.to_json(F.struct(F.col("l_quantity").cast("double").alias("qty"))))
    outcome = F.when(F.col("l_linenumber") != 1, F.when(F.col("l_quantity") > 25, "WIN").otherwise("LOSS"))
    s = V.table(spark, d, "lineitem").withColumns({"symbol": F.col("l_partkey") % 50, "action": action, "features": features, "outcome": outcome})
    order = [F.desc("l_shipdate"), *map(F.col, ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"))]
    df = R.labelled_signals(s, ["symbol", "action"], order, 50, 200)
    return df.select("symbol", "action", "l_orderkey", "l_linenumber", F.col("features")["qty"].alias("qty"), "outcome")


@query("st10_later_outcomes", f"""{E}, s AS (SELECT id, country, region, CASE WHEN category = 'CLICK' THEN 'SELL' ELSE 'BUY' END AS action, severity AS price, ts FROM v_event WHERE category <> 'VIEW'),
  p AS (SELECT country, ts, max(severity) AS later FROM v_event WHERE category = 'VIEW' GROUP BY 1, 2),
  o AS (SELECT s.id, s.action, CASE WHEN s.action = 'SELL' THEN 0 - (p.later / s.price - 1) * 100 ELSE (p.later / s.price - 1) * 100 END AS change FROM s ASOF LEFT JOIN p ON s.country = p.country AND s.ts + INTERVAL 1 DAY < p.ts)
  SELECT id, action, round(change, 6) AS change, CASE WHEN change > 0.5 THEN 'WIN' WHEN change < -0.5 THEN 'LOSS' WHEN change IS NOT NULL THEN 'NEUTRAL' END AS outcome FROM o""")
def later_outcomes(spark, d):
    e = V.events(spark, d).withColumnsRenamed({"country": "symbol", "severity": "price"})
    action = F.when(F.col("category") == "CLICK", "SELL").otherwise("BUY")
    df = R.later_outcomes(e.where("category <> 'VIEW'").withColumn("action", action), e.where("category = 'VIEW'"))
    return df.select("id", "action", F.round("change", 6).alias("change"), "outcome")
