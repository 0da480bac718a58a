"""Queries of joins that enrich rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import graph as G
from tidemark.operators import lookups as O
from tidemark.plans.catalog import query
from tidemark.sources import views as V

E, B, T, D, A, G_ = (f"WITH {x}" for x in (V.EVENT_SQL, V.BAR_SQL, V.TRADE_SQL, V.DOC_SQL, V.ACTIVITY_SQL, V.EDGE_SQL))
r6 = lambda c: F.round(c, 6).alias(c)


@query("j2_saved_events", f"""WITH {V.ACTIVITY_SQL}, {V.EVENT_SQL} SELECT a.user_id, a.created_at, a.detail, e.category, round(e.severity, 6) AS severity
  FROM v_activity a LEFT JOIN v_event e ON a.detail = e.id WHERE a.action = 'click'""")
def saved(spark, d):
    e = V.events(spark, d).select(F.col("id").alias("detail"), "category", r6("severity"))
    return V.activity(spark, d).where("action = 'click'").join(e, "detail", "left").select("user_id", "created_at", "detail", "category", "severity")


@query("j3_activity_users", f"""{A} SELECT a.user_id, a.action, a.created_at, c.c_name FROM v_activity a
  LEFT JOIN customer c ON a.user_id = c.c_custkey ORDER BY a.created_at DESC, a.user_id LIMIT 100""")
def activity_users(spark, d):
    users = V.table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), "c_name")
    df = V.activity(spark, d).join(users, "user_id", "left").orderBy(F.desc("created_at"), "user_id").limit(100)
    return df.select("user_id", "action", "created_at", "c_name")


@query("j4_alerts_users", """SELECT o_custkey AS user_id, o_orderkey AS alert, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey
  WHERE c_acctbal > 0 AND c_mktsegment <> 'HOUSEHOLD' AND o_orderstatus = 'O'""")
def alert_users(spark, d):
    rules = V.table(spark, d, "orders").where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("alert"))
    users = V.table(spark, d, "customer").where("c_acctbal > 0 AND c_mktsegment <> 'HOUSEHOLD'")
    return rules.join(users.select(F.col("c_custkey").alias("user_id"), "c_mktsegment"), "user_id")


@query("j7_sends_by_substring", f"""{A} SELECT s.created_at, e.event_id FROM v_activity s JOIN events e
  ON contains('evt:' || CAST(s.detail AS VARCHAR), CAST(e.event_id AS VARCHAR)) WHERE s.action = 'error'""")
def sends(spark, d):
    sent = V.activity(spark, d).where("action = 'error'").select("created_at", F.concat(F.lit("evt:"), F.col("detail").cast("string")).alias("text"))
    ids = V.table(spark, d, "events").select("event_id", F.col("event_id").cast("string").alias("term"))
    return O.contains_join(sent, "text", ids, "term").select("created_at", "event_id")


@query("j10_trades_events", f"""WITH {V.TRADE_SQL}, {V.EVENT_SQL}, t AS (SELECT DISTINCT bot, 'nation_' || CAST(symbol AS VARCHAR) AS ticker FROM v_trade),
  e AS (SELECT country, category || ' in ' || country AS title, count(*) AS n FROM v_event GROUP BY ALL)
  SELECT bot, ticker, sum(n)::BIGINT AS n FROM t JOIN e ON contains(lower(country), ticker) OR contains(lower(title), ticker) GROUP BY ALL""")
def trade_events(spark, d):
    t = V.trades(spark, d).select("bot", F.concat(F.lit("nation_"), F.col("symbol").cast("string")).alias("ticker")).distinct()
    title = F.concat_ws(" in ", "category", "country")
    e = V.events(spark, d).groupBy("country", title.alias("title")).agg(F.count("*").alias("n"))
    e = e.withColumn("both", F.concat_ws("\n", "country", "title"))
    hits = O.contains_join(e, "both", t.select("ticker").distinct(), "ticker")
    return hits.groupBy("ticker").agg(F.sum("n").alias("n")).join(t, "ticker").select("bot", "ticker", "n")


@query("j11_edge_labels", f"""{G_} SELECT src, tgt, s_name AS src_label, n_name AS tgt_label, n FROM v_edge
  JOIN supplier ON src = 's' || CAST(s_suppkey AS VARCHAR) JOIN nation ON tgt = 'n' || CAST(n_nationkey AS VARCHAR)""")
def edge_labels(spark, d):
    s = V.table(spark, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("node"), F.col("s_name").alias("label"))
    n = V.table(spark, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("node"), F.col("n_name").alias("label"))
    return O.with_labels(V.edges(spark, d), s.union(n)).select("src", "tgt", "src_label", "tgt_label", "n")


@query("j13_user_overlay", f"""{A} SELECT DISTINCT n.detail AS node, o.note FROM v_activity n LEFT JOIN (
  SELECT detail, max(action) AS note FROM v_activity WHERE user_id = 5 GROUP BY detail) o ON n.detail = o.detail""")
def user_overlay(spark, d):
    a = V.activity(spark, d)
    own = a.groupBy("user_id", F.col("detail").alias("node")).agg(F.max("action").alias("note"))
    return O.overlay(a.select(F.col("detail").alias("node")).distinct(), own, 5)


@query("j14_induced", f"""{G_}, kept AS (SELECT node FROM (SELECT src AS node, n FROM v_edge UNION ALL SELECT tgt, n FROM v_edge)
  GROUP BY node HAVING sum(n) >= 600) SELECT src, tgt, n FROM v_edge WHERE src IN (SELECT node FROM kept) AND tgt IN (SELECT node FROM kept)""")
def induced(spark, d):
    e = V.edges(spark, d)
    ends = e.select(F.col("src").alias("node"), "n").union(e.select("tgt", "n"))
    return G.induced(e, ends.groupBy("node").agg(F.sum("n").alias("t")).where("t >= 600").select("node")).select("src", "tgt", "n")


@query("j15_index_entries", f"""{D} SELECT doc_id, title, hits FROM v_doc JOIN (SELECT doc_id AS i, count(*) AS hits FROM (
    SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(body), '[a-z]+')) AS word FROM v_doc)
  WHERE word IN ('the', 'in', 'of', 'ring', 'were') GROUP BY 1 HAVING count(*) >= 3) ON doc_id = i""")
def index_entries(spark, d):
    return O.index_hits(V.documents(spark, d), "doc_id", "body", ["the", "in", "of", "ring", "were"], 3).select("doc_id", "title", "hits")


@query("j18_align_tails", f"""{B}, n AS (SELECT min(c) AS m FROM (SELECT count(*) AS c FROM v_bar GROUP BY symbol))
  SELECT symbol, count(*) AS n, min(date) AS first_date, round(avg(close), 6) AS mean_close FROM (
    SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS r FROM v_bar) WHERE r <= (SELECT m FROM n) GROUP BY symbol""")
def tails(spark, d):
    df = O.align_tails(V.bars(spark, d), "symbol", "date")
    return df.groupBy("symbol").agg(F.count("*").alias("n"), F.min("date").alias("first_date"), F.round(F.avg("close"), 6).alias("mean_close"))


LAST = "arg_max(price, row(executed_at, l_orderkey, l_linenumber))"


@query("j19_latest_outcomes", f"""{T}, q AS (SELECT symbol, {LAST} AS last_price FROM v_trade WHERE side = 'SELL' GROUP BY symbol)
  SELECT s.symbol, count(*) AS signals, count(*) FILTER (last_price IS NULL) AS open, count(*) FILTER (last_price > price) AS wins,
  round(avg((last_price - price) / price), 6) AS mean_change FROM v_trade s LEFT JOIN q USING (symbol) WHERE side = 'BUY' GROUP BY s.symbol""")
def outcomes(spark, d):
    t = V.trades(spark, d)
    prices = O.latest(t.where("side = 'SELL'"), ["symbol"], ["executed_at", "l_orderkey", "l_linenumber"], "price", "last_price")
    df = O.resolve_latest(t.where("side = 'BUY'"), prices)
    count = lambda s: F.count(F.when(F.col("state") == s, 1))
    return df.groupBy("symbol").agg(
        F.count("*").alias("signals"), count("open").alias("open"), count("win").alias("wins"), F.round(F.avg("change"), 6).alias("mean_change")
    )


@query("j20_position_values", f"""{T}, q AS (SELECT symbol, {LAST} AS last_price FROM v_trade WHERE side = 'SELL' AND price > 1500 GROUP BY symbol),
  p AS (SELECT bot, symbol, sum(qty) AS qty, sum(qty * price) / sum(qty) AS avg_price FROM v_trade WHERE side = 'BUY' GROUP BY bot, symbol)
  SELECT bot, round(sum(qty * coalesce(last_price, avg_price)), 4) AS value FROM p LEFT JOIN q USING (symbol) GROUP BY bot""")
def position_values(spark, d):
    t = V.trades(spark, d)
    quotes = O.latest(t.where("side = 'SELL' AND price > 1500"), ["symbol"], ["executed_at", "l_orderkey", "l_linenumber"], "price", "last_price")
    held = t.where("side = 'BUY'").groupBy("bot", "symbol").agg(F.sum("qty").alias("qty"), (F.sum(F.col("qty") * F.col("price")) / F.sum("qty")).alias("avg_price"))
    return O.value_positions(held, quotes).groupBy("bot").agg(F.round(F.sum("value"), 4).alias("value"))


@query("j23_user_names", """SELECT c_name, count(*) AS n FROM events JOIN customer ON user_id = c_custkey GROUP BY c_name ORDER BY n DESC, c_name LIMIT 20""")
def user_names(spark, d):
    n = V.table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    names = V.table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), "c_name")
    return n.join(names, "user_id").select("c_name", "n").orderBy(F.desc("n"), "c_name").limit(20)


LABELS = "label AS (SELECT n_name AS label FROM nation UNION ALL SELECT r_name FROM region)"


def labels(spark, d):
    return V.table(spark, d, "nation").select(F.col("n_name").alias("label")).union(V.table(spark, d, "region").select("r_name"))


@query("j24_graph_context", f"""{E}, {LABELS}, k AS (SELECT id, unnest([country, region]) AS keyword FROM v_event),
  m AS (SELECT id, keyword, label, row_number() OVER (PARTITION BY id, keyword ORDER BY label) AS r FROM k JOIN label ON contains(lower(label), lower(keyword)))
  SELECT id, keyword, label FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY keyword, label) AS t FROM m WHERE r <= 2) WHERE t <= 4""")
def graph_context(spark, d):
    words = V.events(spark, d).select("id", F.explode(F.array("country", "region")).alias("keyword"))
    hits = O.contains_join(labels(spark, d), "label", words.select("keyword").distinct(), "keyword")
    return O.top_matches(words.join(hits, "keyword"), "id", "keyword", "label").select("id", "keyword", "label")


@query("j25_fund_rules", f"""WITH {LABELS}, rule AS (SELECT 'nation_1' AS key, 'F1' AS fund UNION ALL SELECT 'asia', 'F2' UNION ALL SELECT 'nation_2', 'F1')
  SELECT label, fund FROM label JOIN rule ON contains(lower(label), key)""")
def fund_rules(spark, d):
    rules = spark.createDataFrame([("nation_1", "F1"), ("asia", "F2"), ("nation_2", "F1")], "key string, fund string")
    return O.contains_join(labels(spark, d), "label", rules, "key").select("label", "fund")
