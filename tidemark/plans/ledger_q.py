"""Queries over the trade ledger."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import ledger as L
from tidemark.operators import signals as X
from tidemark.plans.catalog import query
from tidemark.plans.series_q import B, N, last
from tidemark.sources import views as V

ORDER = "executed_at, l_orderkey, l_linenumber, l_partkey, qty, l_extendedprice"
POS = f"""isl AS (SELECT *, coalesce(sum(CASE WHEN side = 'SELL' THEN 1 ELSE 0 END) OVER (PARTITION BY bot, symbol ORDER BY {ORDER}
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS island FROM v_trade),
  cum AS (SELECT *, sum(CASE WHEN side = 'BUY' THEN qty ELSE 0 END) OVER w AS held,
    sum(CASE WHEN side = 'BUY' THEN qty * price ELSE 0 END) OVER w AS cost FROM isl
    WINDOW w AS (PARTITION BY bot, symbol, island ORDER BY {ORDER} ROWS UNBOUNDED PRECEDING)),
  pos AS (SELECT *, CASE WHEN held > 0 THEN cost / held END AS avg_price,
    CASE WHEN side = 'SELL' AND held > 0 THEN (price - cost / held) * held ELSE 0 END AS pnl FROM cum)"""
T = f"WITH {V.TRADE_SQL}, {POS}"


@query("w31_positions", f"""{T} SELECT bot, symbol, count(*) AS n, round(sum(pnl), 5) AS pnl, round(max(held), 3) AS most_held FROM pos GROUP BY 1, 2""")
def positions(spark, d):
    df = L.positions(V.trades(spark, d)).groupBy("bot", "symbol")
    return df.agg(F.count("*").alias("n"), F.round(F.sum("pnl"), 5).alias("pnl"), F.round(F.max("held"), 3).alias("most_held"))


@query("a17_bot_stats", f"""{T} SELECT bot, count(*) AS trades, round(sum(pnl), 5) AS realised, count(*) FILTER (pnl > 0) AS wins,
  round(count(*) FILTER (pnl > 0) / count(*), 6) AS win_rate FROM pos GROUP BY bot""")
def bot_stats(spark, d):
    df = L.bot_stats(V.trades(spark, d))
    return df.select("bot", "trades", F.round("realised", 5).alias("realised"), "wins", F.round("win_rate", 6).alias("win_rate"))


@query("x10_open_positions", f"""{T}, l AS (SELECT bot, symbol, arg_max(side, row({ORDER})) AS side, arg_max(held, row({ORDER})) AS qty,
  arg_max(avg_price, row({ORDER})) AS ap FROM pos GROUP BY 1, 2), q AS (SELECT symbol, max(price) AS quote FROM v_trade WHERE symbol < 40 GROUP BY 1)
  SELECT bot, l.symbol, round(qty, 3) AS qty, round(ap, 6) AS avg_price, round(qty * coalesce(quote, ap), 5) AS value,
  round(qty * (coalesce(quote, ap) - ap), 5) AS unrealised FROM l LEFT JOIN q ON l.symbol = q.symbol WHERE side = 'BUY' AND qty > 0""")
def open_positions(spark, d):
    t = V.trades(spark, d)
    quotes = t.where("symbol < 40").groupBy("symbol").agg(F.max("price").alias("quote"))
    df = L.open_positions(t, quotes)
    return df.select("bot", "symbol", F.round("qty", 3).alias("qty"), F.round("avg_price", 6).alias("avg_price"), F.round("value", 5).alias("value"), F.round("unrealised", 5).alias("unrealised"))


@query("x9_outcomes", f"""{B}, m AS (SELECT *, CASE WHEN {N} >= 10 THEN avg(close) {last(10)} END AS a, CASE WHEN {N} >= 30 THEN avg(close) {last(30)} END AS b FROM v_bar),
  p AS (SELECT *, lag(a) OVER w AS pa, lag(b) OVER w AS pb, lead(close, 5) OVER w / close - 1 AS ch FROM m WINDOW w AS (PARTITION BY symbol ORDER BY date)),
  s AS (SELECT *, CASE WHEN pa <= pb AND a > b THEN 'BUY' WHEN pa >= pb AND a < b THEN 'SELL' ELSE 'HOLD' END AS action FROM p),
  o AS (SELECT *, CASE WHEN action = 'SELL' THEN -ch ELSE ch END AS gain FROM s WHERE action <> 'HOLD')
  SELECT symbol, date, action, CASE WHEN gain IS NULL THEN NULL WHEN gain > 0.005 THEN 'win' WHEN gain < -0.005 THEN 'loss' ELSE 'flat' END AS outcome FROM o""")
def outcomes(spark, d):
    return L.resolve(X.ma_cross(V.bars(spark, d))).select("symbol", "date", "action", "outcome")


@query("j16_as_of", f"""WITH {V.EVENT_SQL}, p AS (SELECT user_id, ts, severity FROM v_event WHERE category = 'PURCHASE'),
  v AS (SELECT user_id, ts, max(severity) AS s FROM v_event WHERE category = 'VIEW' GROUP BY 1, 2)
  SELECT p.user_id, p.ts, round(p.severity, 6) AS severity, round(v.s, 6) AS view_severity FROM p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.ts >= v.ts""")
def as_of(spark, d):
    e = V.events(spark, d)
    left = e.where("category = 'PURCHASE'").select("user_id", "ts", "severity")
    right = e.where("category = 'VIEW'").groupBy("user_id", F.col("ts").alias("vt")).agg(F.max("severity").alias("view_severity"))
    df = L.as_of_backward(left, right, ["user_id"], "ts", "vt", "view_severity")
    return df.select("user_id", "ts", F.round("severity", 6).alias("severity"), F.round("view_severity", 6).alias("view_severity"))


@query("s19_insert_absent", """SELECT event_type, count(*) AS n FROM (SELECT DISTINCT event_id, event_type FROM events e WHERE event_id NOT IN
  (SELECT event_id FROM events WHERE user_id % 4 = 0)) GROUP BY event_type""")
def insert_absent(spark, d):
    e = V.table(spark, d, "events")
    new = L.insert_absent(e.where("user_id % 4 = 0"), e.unionByName(e), ["event_id"])
    return new.groupBy("event_type").agg(F.count("*").alias("n"))


@query("s20_upsert_latest", """SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY user_id""")
def upsert(spark, d):
    e = V.table(spark, d, "events").select("user_id", "event_type", "event_id")
    return L.upsert_latest(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), ["user_id"], "event_id")
