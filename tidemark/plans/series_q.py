"""Queries over bars: indicators, statistics, signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import quant as Q
from tidemark.operators import series as S
from tidemark.operators import signals as X
from tidemark.plans.catalog import query
from tidemark.sources import views as V

B = f"WITH {V.BAR_SQL}"
O = "OVER (PARTITION BY symbol ORDER BY date"
KEY = ("symbol", "date")


def last(n: int) -> str:
    return f"{O} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def before(n: int) -> str:
    return f"{O} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"


RUN = f"{O} ROWS UNBOUNDED PRECEDING)"
N = f"row_number() {O})"


def pick(df, *names, digits: int = 6):
    return df.select(*KEY, *[(F.round(c, digits) + 0.0).alias(c) for c in names])


def out(*names, digits: int = 6) -> str:
    return ", ".join(["symbol", "date", *[f"round({c}, {digits}) + 0.0 AS {c}" for c in names]])


@query("s12_bars", f"{B} SELECT {out('open', 'high', 'low', 'close', 'volume')} FROM v_bar")
def bars(spark, d):
    return pick(V.bars(spark, d), "open", "high", "low", "close", "volume")


RET = f"r AS (SELECT *, close / lag(close) {O}) - 1 AS ret, ln(close / lag(close) {O})) AS log_ret FROM v_bar)"


@query("w1_returns", f"{B}, {RET} SELECT {out('ret', 'log_ret')} FROM r")
def returns(spark, d):
    return pick(S.returns(V.bars(spark, d)), "ret", "log_ret")


@query("w2_sma", f"{B} SELECT symbol, date, CASE WHEN {N} >= 20 THEN round(avg(close) {last(20)}, 6) END AS sma20 FROM v_bar")
def sma(spark, d):
    return pick(S.sma(V.bars(spark, d), 20), "sma20")


def ema_sql(n: int, column: str, name: str, source: str, seed: str = "close") -> str:
    """A CTE with the exponential mean of a non-null column, by reducing each bar's list of values so far."""
    first = f"list_slice(v, {n}, i)" if seed == "close" else f"list_prepend(list_avg(list_slice(v, 1, {n})), list_slice(v, {n + 1}, i))"
    return f"""{name}_c AS (SELECT *, list({column}) FILTER ({column} IS NOT NULL) {RUN} AS v, count({column}) {RUN} AS i FROM {source}),
    {name}_t AS (SELECT * EXCLUDE (v, i), CASE WHEN i >= {n} AND {column} IS NOT NULL THEN
      list_reduce({first}, lambda a, x: a + {2.0 / (n + 1)!r}::DOUBLE * (x - a)) END AS {name} FROM {name}_c)"""


@query("w3_ema_close", f"{B}, {ema_sql(12, 'close', 'ema12', 'v_bar')} SELECT {out('ema12')} FROM ema12_t")
def ema(spark, d):
    return pick(S.ema(V.bars(spark, d), 12), "ema12")


@query("w3_ema_sma", f"{B}, {ema_sql(12, 'close', 'ema12', 'v_bar', 'sma')} SELECT {out('ema12')} FROM ema12_t")
def ema_sma(spark, d):
    return pick(S.ema(V.bars(spark, d), 12, seed="sma"), "ema12")


MOVE = f"""mv AS (SELECT *, greatest(close - lag(close) {O}), 0) AS g, greatest(lag(close) {O}) - close, 0) AS l FROM v_bar),
  rs AS (SELECT *, CASE WHEN {N} >= 15 THEN CASE WHEN avg(l) {last(14)} = 0 THEN 100.0
    ELSE 100 - 100 / (1 + avg(g) {last(14)} / avg(l) {last(14)}) END END AS rsi FROM mv)"""


@query("w4_rsi", f"{B}, {MOVE} SELECT {out('rsi')} FROM rs")
def rsi(spark, d):
    return pick(S.rsi(V.bars(spark, d)), "rsi")


BB = f"""bb AS (SELECT *, CASE WHEN {N} >= 20 THEN avg(close) {last(20)} END AS bb_mid,
  CASE WHEN {N} >= 20 THEN stddev_pop(close) {last(20)} END AS sd FROM v_bar),
  b2 AS (SELECT *, bb_mid + 2 * sd AS bb_up, bb_mid - 2 * sd AS bb_low FROM bb)"""


@query("w5_bollinger", f"{B}, {BB} SELECT {out('bb_mid', 'bb_up', 'bb_low')}, round((close - bb_low) / (bb_up - bb_low), 6) AS bb_pct FROM b2")
def bollinger(spark, d):
    return pick(S.bollinger(V.bars(spark, d)), "bb_mid", "bb_up", "bb_low", "bb_pct")


@query("w6_percent_b", f"""{B}, m AS (SELECT *, {N} AS i, avg(close) {before(20)} AS mid, stddev_pop(close) {before(20)} AS sd FROM v_bar)
  SELECT symbol, date, CASE WHEN i >= 21 AND sd > 0 THEN round((close - (mid - 2 * sd)) / (4 * sd), 6) END AS pct_b FROM m""")
def percent_b(spark, d):
    return pick(S.percent_b_before(V.bars(spark, d)), "pct_b")


MACD = f"""{ema_sql(12, 'close', 'f', 'v_bar')}, {ema_sql(26, 'close', 'w', 'f_t')},
  md AS (SELECT *, f - w AS macd FROM w_t), {ema_sql(9, 'macd', 'macd_signal', 'md')}"""


@query("w7_macd", f"{B}, {MACD} SELECT {out('macd', 'macd_signal')}, round(macd - macd_signal, 6) AS macd_hist FROM macd_signal_t")
def macd(spark, d):
    return pick(S.macd(V.bars(spark, d)), "macd", "macd_signal", "macd_hist")


def win_ema(n: int) -> str:
    return f"list_reduce(list(close) {last(n)}, lambda a, x: a + {2.0 / (n + 1)!r}::DOUBLE * (x - a))"


@query("w8_macd_live", f"""{B}, m AS (SELECT *, CASE WHEN {N} >= 26 THEN {win_ema(12)} - {win_ema(26)} END AS macd_live FROM v_bar)
  SELECT {out('macd_live')}, round(avg(macd_live) {before(9)}, 6) AS macd_live_signal FROM m""")
def macd_live(spark, d):
    return pick(S.macd_live(V.bars(spark, d)), "macd_live", "macd_live_signal")


@query("w9_atr", f"""{B}, t AS (SELECT *, lag(close) {O}) AS p FROM v_bar), u AS (SELECT *, CASE WHEN p IS NOT NULL THEN
  greatest(high - low, abs(high - p), abs(low - p)) END AS tr FROM t), c AS (SELECT *, list(tr) FILTER (tr IS NOT NULL) {RUN} AS v,
  count(tr) {RUN} AS i FROM u) SELECT symbol, date, CASE WHEN i >= 14 THEN round(list_reduce(list_prepend(list_avg(list_slice(v, 1, 14)),
  list_slice(v, 15, i)), lambda a, x: (a * 13 + x) / 14), 6) END AS atr FROM c""")
def atr(spark, d):
    return pick(S.atr(V.bars(spark, d)), "atr")


@query("w10_obv", f"""{B}, m AS (SELECT *, close - lag(close) {O}) AS mv FROM v_bar), s AS (SELECT *,
  CASE WHEN mv > 0 THEN volume WHEN mv < 0 THEN -volume ELSE 0 END AS sv FROM m) SELECT symbol, date, round(sum(sv) {RUN}, 6) AS obv FROM s""")
def obv(spark, d):
    return pick(S.obv(V.bars(spark, d)), "obv")


STOCH = f"""h AS (SELECT *, {N} AS i, max(high) {last(14)} AS hh, min(low) {last(14)} AS ll FROM v_bar), k AS (SELECT *,
  CASE WHEN i >= 14 THEN CASE WHEN hh = ll THEN 50.0 ELSE 100 * (close - ll) / (hh - ll) END END AS stoch_k,
  CASE WHEN i >= 14 THEN CASE WHEN hh = ll THEN -50.0 ELSE -100 * (hh - close) / (hh - ll) END END AS williams FROM h)"""


@query("w11_stochastic", f"""{B}, {STOCH} SELECT {out('stoch_k', 'williams')},
  CASE WHEN i >= 16 THEN round(avg(stoch_k) {last(3)}, 6) END AS stoch_d FROM k""")
def stochastic(spark, d):
    return pick(S.stochastic(V.bars(spark, d)), "stoch_k", "williams", "stoch_d")


@query("w14_ichimoku", f"""{B}, m AS (SELECT *, {N} AS i, (max(high) {last(9)} + min(low) {last(9)}) / 2 AS a,
  (max(high) {last(26)} + min(low) {last(26)}) / 2 AS b, (max(high) {last(52)} + min(low) {last(52)}) / 2 AS c, lag(close, 26) {O}) AS chikou FROM v_bar)
  SELECT symbol, date, CASE WHEN i >= 10 THEN round(a, 6) END AS tenkan, CASE WHEN i >= 27 THEN round(b, 6) END AS kijun,
  CASE WHEN i >= 53 THEN round(c, 6) END AS span_b, CASE WHEN i >= 27 THEN round((a + b) / 2, 6) END AS span_a, round(chikou, 6) AS chikou FROM m""")
def ichimoku(spark, d):
    return pick(S.ichimoku(V.bars(spark, d)), "tenkan", "kijun", "span_b", "span_a", "chikou")


@query("w15_vwap", f"""{B} SELECT symbol, date, round(sum((high + low + close) / 3 * volume) {RUN} / sum(volume) {RUN}, 6) AS vwap FROM v_bar""")
def vwap(spark, d):
    return pick(S.vwap(V.bars(spark, d)), "vwap")


@query("w16_volatility", f"""{B}, {RET}, i AS (SELECT *, {N} AS i FROM r) SELECT symbol, date,
  CASE WHEN i >= 21 THEN round(stddev_samp(ret) {last(20)} * sqrt(252) * 100, 6) END AS vol,
  CASE WHEN i >= 22 THEN round(stddev_samp(ret) {before(20)} * sqrt(252), 6) ELSE 0 END AS vol_before FROM i""")
def volatility(spark, d):
    return pick(S.volatility(V.bars(spark, d)), "vol", "vol_before")


@query("w18_drawdown", f"""{B}, p AS (SELECT *, close / max(close) {RUN} - 1 AS drawdown FROM v_bar)
  SELECT {out('drawdown')}, round(min(drawdown) {RUN}, 6) AS max_drawdown FROM p""")
def drawdown(spark, d):
    return pick(S.drawdown(V.bars(spark, d)), "drawdown", "max_drawdown")


ROC = ", ".join(f"coalesce((close / lag(close, {n}) {O}) - 1) * 100, 0) AS roc{n}" for n in (5, 10, 20, 60))


@query("w19_momentum", f"""{B}, m AS (SELECT *, {ROC} FROM v_bar) SELECT {out('roc5', 'roc10', 'roc20', 'roc60')},
  round(0.4 * roc5 + 0.3 * roc10 + 0.2 * roc20 + 0.1 * roc60, 6) AS momentum FROM m""")
def momentum(spark, d):
    return pick(S.momentum(V.bars(spark, d)), "roc5", "roc10", "roc20", "roc60", "momentum")


@query("w21_levels", f"""{B}, m AS (SELECT *, max(high) {last(252)} AS high_n, min(low) {last(252)} AS low_n FROM v_bar)
  SELECT {out('high_n', 'low_n')}, round(low_n + 0.236 * (high_n - low_n), 6) AS support,
  round(low_n + 0.764 * (high_n - low_n), 6) AS resistance FROM m""")
def levels(spark, d):
    return pick(S.levels(V.bars(spark, d)), "high_n", "low_n", "support", "resistance")


@query("w22_trend", f"""{B}, {MOVE}, t AS (SELECT *, CASE WHEN {N} >= 5 THEN avg(close) {last(5)} END AS a,
  CASE WHEN {N} >= 20 THEN avg(close) {last(20)} END AS b FROM rs) SELECT symbol, date,
  CASE WHEN a > b * 1.005 AND rsi > 55 THEN 'bullish' WHEN a < b * 0.995 AND rsi < 45 THEN 'bearish' ELSE 'neutral' END AS trend FROM t""")
def trend(spark, d):
    return S.trend(V.bars(spark, d)).select(*KEY, "trend")


@query("w25_volume_ratio", f"""{B} SELECT symbol, date, CASE WHEN {N} >= 21 THEN
  round(least(5.0, volume / (sum(volume) {before(20)} / 20)), 6) END AS volume_ratio FROM v_bar""")
def volume_ratio(spark, d):
    return pick(S.volume_ratio(V.bars(spark, d)), "volume_ratio")


@query("w26_label", f"{B} SELECT symbol, date, CAST(lead(close, 5) {O}) / close > 1.005 AS INTEGER) AS label FROM v_bar")
def label(spark, d):
    return S.label_ahead(V.bars(spark, d)).select(*KEY, "label")


PERF = f"""{RET}, dd AS (SELECT *, close / max(close) {RUN} - 1 AS dd FROM r), p AS (SELECT symbol, count(ret) AS n, avg(ret) * 252 AS ann_return,
  stddev_samp(ret) * sqrt(252) AS ann_vol, stddev_samp(ret) FILTER (ret < 0) * sqrt(252) AS down, min(dd) AS max_drawdown FROM dd GROUP BY symbol)"""


@query("q1_performance", f"""{B}, {PERF} SELECT symbol, n, round(ann_return, 6) AS ann_return, round(ann_vol, 6) AS ann_vol,
  round(max_drawdown, 6) AS max_drawdown, round((ann_return - 0.05) / ann_vol, 6) AS sharpe,
  round(CASE WHEN down > 0 THEN (ann_return - 0.05) / down ELSE 999 END, 6) AS sortino,
  round(CASE WHEN max_drawdown < 0 THEN ann_return / -max_drawdown ELSE 999 END, 6) AS calmar FROM p""")
def performance(spark, d):
    df = Q.performance(V.bars(spark, d))
    names = ("ann_return", "ann_vol", "max_drawdown", "sharpe", "sortino", "calmar")
    return df.select("symbol", "n", *[F.round(c, 6).alias(c) for c in names])


@query("q3_against", f"""{B}, {RET} SELECT a.symbol, round(regr_slope(a.ret, b.ret), 6) AS beta, round(regr_intercept(a.ret, b.ret), 6) AS alpha,
  round(corr(a.ret, b.ret), 6) AS corr, round(regr_r2(a.ret, b.ret), 6) AS r2 FROM r a JOIN r b ON a.date = b.date AND b.symbol = 'Brand#11'
  WHERE a.symbol <> 'Brand#11' AND a.ret IS NOT NULL AND b.ret IS NOT NULL GROUP BY a.symbol""")
def against(spark, d):
    df = Q.against(V.bars(spark, d), "Brand#11")
    return df.select("symbol", *[F.round(c, 6).alias(c) for c in ("beta", "alpha", "corr", "r2")])


@query("q4_correlations", f"""{B}, {RET}, c AS (SELECT a.symbol AS a, b.symbol AS b, corr(a.ret, b.ret) AS corr FROM r a JOIN r b
  ON a.date = b.date AND a.symbol < b.symbol WHERE a.ret IS NOT NULL AND b.ret IS NOT NULL GROUP BY 1, 2)
  SELECT a, b, round(corr, 6) AS corr, CASE WHEN abs(corr) >= 0.7 THEN 'strong' WHEN abs(corr) >= 0.3 THEN 'moderate' ELSE 'weak' END AS label FROM c""")
def correlations(spark, d):
    return Q.correlations(V.bars(spark, d)).select("a", "b", F.round("corr", 6).alias("corr"), "label")


@query("q6_value_at_risk", f"""{B}, {RET}, o AS (SELECT symbol, ret, row_number() OVER (PARTITION BY symbol ORDER BY ret, date) AS p,
  count(*) OVER (PARTITION BY symbol) AS n FROM r WHERE ret IS NOT NULL) SELECT symbol, round(ret, 6) AS var FROM o WHERE p = floor(n * 0.05) + 1""")
def var(spark, d):
    return Q.value_at_risk(V.bars(spark, d)).select("symbol", F.round("var", 6).alias("var"))


@query("q7_shape", f"""{B}, {RET}, m AS (SELECT symbol, avg(ret) AS mu, stddev_samp(ret) AS sd FROM r GROUP BY symbol)
  SELECT symbol, round(avg(power((ret - mu) / sd, 3)), 5) AS skew, round(avg(power((ret - mu) / sd, 4)) - 3, 5) AS kurt
  FROM r JOIN m USING (symbol) WHERE ret IS NOT NULL GROUP BY symbol""")
def shape(spark, d):
    return Q.shape(V.bars(spark, d)).select("symbol", F.round("skew", 5).alias("skew"), F.round("kurt", 5).alias("kurt"))


@query("q9_portfolio", f"""{B}, p AS (SELECT symbol, date, 100 * close / first_value(close) {O}) AS v FROM v_bar WHERE symbol IN ('Brand#11', 'Brand#22'))
  SELECT date, round(sum(v * CASE symbol WHEN 'Brand#11' THEN 3.0 ELSE 1.0 END) / 4, 6) AS nav FROM p GROUP BY date HAVING count(*) = 2""")
def portfolio(spark, d):
    w = spark.createDataFrame([("Brand#11", 3.0), ("Brand#22", 1.0)], "symbol string, weight double")
    return Q.portfolio(V.bars(spark, d), w).select("date", F.round("nav", 6).alias("nav"))


@query("x1_ma_cross", f"""{B}, m AS (SELECT *, CASE WHEN {N} >= 10 THEN avg(close) {last(10)} END AS a, CASE WHEN {N} >= 30 THEN avg(close) {last(30)} END AS b FROM v_bar),
  p AS (SELECT *, lag(a) {O}) AS pa, lag(b) {O}) AS pb FROM m) SELECT symbol, date,
  CASE WHEN pa <= pb AND a > b THEN 'BUY' WHEN pa >= pb AND a < b THEN 'SELL' ELSE 'HOLD' END AS action FROM p""")
def ma_cross(spark, d):
    return X.ma_cross(V.bars(spark, d)).select(*KEY, "action")


@query("x7_sweep", f"""{B}, {MOVE}, {BB.replace('FROM v_bar', 'FROM rs')}, s AS (
  SELECT symbol, date, close, 'rsi_reversion' AS strategy, CASE WHEN rsi < 30 THEN 'BUY' WHEN rsi > 70 THEN 'SELL' ELSE 'HOLD' END AS action FROM b2
  UNION ALL SELECT symbol, date, close, 'bollinger_reversion', CASE WHEN close < bb_low THEN 'BUY' WHEN close > bb_up THEN 'SELL' ELSE 'HOLD' END FROM b2),
  h AS (SELECT *, close / lag(close) OVER w - 1 AS ret, coalesce(last_value(CASE action WHEN 'BUY' THEN 1 WHEN 'SELL' THEN 0 END IGNORE NULLS) OVER
    (PARTITION BY strategy, symbol ORDER BY date ROWS UNBOUNDED PRECEDING), 0) AS pos FROM s WINDOW w AS (PARTITION BY strategy, symbol ORDER BY date)),
  g AS (SELECT *, ln(1 + coalesce(lag(pos) OVER w, 0) * coalesce(ret, 0)) AS gain FROM h WINDOW w AS (PARTITION BY strategy, symbol ORDER BY date)),
  n AS (SELECT *, 100 * exp(sum(gain) OVER (PARTITION BY strategy, symbol ORDER BY date ROWS UNBOUNDED PRECEDING)) AS nav FROM g),
  dd AS (SELECT *, nav / max(nav) OVER (PARTITION BY strategy, symbol ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM n)
  SELECT symbol, strategy, count(*) FILTER (action = 'BUY') AS buys, count(*) FILTER (action = 'SELL') AS sells,
  round(arg_max(nav, date), 5) AS final_nav, round(min(dd), 6) AS max_drawdown FROM dd GROUP BY symbol, strategy""")
def sweep(spark, d):
    df = X.sweep(V.bars(spark, d), ["rsi_reversion", "bollinger_reversion"])
    return df.select("symbol", "strategy", "buys", "sells", F.round("final_nav", 5).alias("final_nav"), F.round("max_drawdown", 6).alias("max_drawdown"))


@query("w13_adx")
def adx(spark, d):
    return pick(S.adx(V.bars(spark, d)), "di_plus", "di_minus", "adx")


@query("w20_performance", f"""{B}, m AS (SELECT symbol, date, close, (close / lag(close, 1) {O}) - 1) * 100 AS d1, (close / lag(close, 4) {O}) - 1) * 100 AS d4,
  (close / lag(close, 19) {O}) - 1) * 100 AS d19, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS p FROM v_bar)
  SELECT symbol, round(close, 6) AS close, round(d1, 6) + 0.0 AS d1, round(d4, 6) + 0.0 AS d4, round(d19, 6) + 0.0 AS d19 FROM m WHERE p = 1""")
def performance_at_end(spark, d):
    return S.performance_at_end(V.bars(spark, d)).select("symbol", *[(F.round(c, 6) + 0.0).alias(c) for c in ("close", "d1", "d4", "d19")])


@query("w23_regime", f"""{B}, {RET}, v AS (SELECT *, CASE WHEN {N} >= 20 THEN avg(close) {last(20)} END AS a, CASE WHEN {N} >= 50 THEN avg(close) {last(50)} END AS b,
  stddev_samp(ret) {last(20)} AS v FROM r), m AS (SELECT *, avg(v) {RUN} AS mv FROM v) SELECT symbol, date, CASE WHEN b IS NULL THEN 'unknown' WHEN v > 1.5 * mv THEN 'volatile'
  WHEN a > 1.015 * b THEN 'up' WHEN a < 0.985 * b THEN 'down' ELSE 'ranging' END AS regime FROM m""")
def regime(spark, d):
    return S.regime(V.bars(spark, d)).select(*KEY, "regime")


@query("w32_thin", f"""{B}, m AS (SELECT symbol, date, {N} - 1 AS p, count(*) OVER (PARTITION BY symbol) AS n FROM v_bar)
  SELECT symbol, date FROM m WHERE p % greatest(1, n // 50) = 0""")
def thin(spark, d):
    return S.thin(V.bars(spark, d), 50).select(*KEY)


@query("w24_reaction", f"""{B}, {RET}, x AS (SELECT symbol, date, close, ret, lead(close, 1) {O}) AS c1, lead(close, 2) {O}) AS c2, lead(close, 5) {O}) AS c5,
  last_value(close) {O} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS cl, avg(abs(ret)) {O} ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) / avg(abs(ret)) {before(10)} AS spike FROM r),
  ev AS (SELECT DISTINCT o_orderkey AS key, CAST(o_orderdate AS DATE) AS "on", p_brand AS symbol FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
  f AS (SELECT key, e.symbol, date FROM ev e ASOF JOIN (SELECT symbol, date FROM x) y ON e.symbol = y.symbol AND y.date >= e."on")
  SELECT key, symbol, date, round(coalesce(c1, cl) / close - 1, 6) + 0.0 AS r1, round(coalesce(c2, cl) / close - 1, 6) + 0.0 AS r2, round(coalesce(c5, cl) / close - 1, 6) + 0.0 AS r5,
  round(spike, 6) AS spike FROM f JOIN x USING (symbol, date)""")
def reaction(spark, d):
    line = V.with_orders(V.table(spark, d, "lineitem"), V.table(spark, d, "orders"))
    o = line.join(V.table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    events = o.select(F.col("o_orderkey").alias("key"), F.col("p_brand").alias("symbol"), F.to_date("o_orderdate").alias("on")).distinct()
    df = S.reaction(V.bars(spark, d), events, "key")
    return df.select("key", "symbol", "date", *[(F.round(c, 6) + 0.0).alias(c) for c in ("r1", "r2", "r5", "spike")])


@query("q5_factor_regression", f"""{B}, {RET}, f AS (SELECT a.symbol, b.symbol AS factor, regr_slope(a.ret, b.ret) AS beta, regr_r2(a.ret, b.ret) AS r2 FROM r a JOIN r b ON a.date = b.date AND a.symbol <> b.symbol
  WHERE b.symbol IN ('Brand#1', 'Brand#2', 'Brand#3') AND a.ret IS NOT NULL AND b.ret IS NOT NULL GROUP BY 1, 2)
  SELECT symbol, factor, round(beta, 6) AS beta, round(r2, 6) AS r2 FROM f""")
def factors(spark, d):
    df = Q.factor_regression(V.bars(spark, d), ["Brand#1", "Brand#2", "Brand#3"])
    return df.select("symbol", "factor", F.round("beta", 6).alias("beta"), F.round("r2", 6).alias("r2"))


@query("q8_pca")
def pca(spark, d):
    return Q.principal_components(V.bars(spark, d), 3)


@query("x4_vote", f"""{B}, {MOVE}, {BB.replace('FROM v_bar', 'FROM rs')}, a AS (SELECT *, CASE WHEN rsi < 30 THEN 1 WHEN rsi > 70 THEN -1 ELSE 0 END * 0.6
  + CASE WHEN close < bb_low THEN 1 WHEN close > bb_up THEN -1 ELSE 0 END * 0.4 AS net FROM b2)
  SELECT symbol, date, round(net, 6) + 0.0 AS net, CASE WHEN net > 0.15 THEN 'BUY' WHEN net < -0.15 THEN 'SELL' ELSE 'HOLD' END AS action FROM a""")
def vote(spark, d):
    df = X.vote(V.bars(spark, d), {"rsi_reversion": 0.6, "bollinger_reversion": 0.4})
    return df.select(*KEY, (F.round("net", 6) + 0.0).alias("net"), "action")


@query("x8_walk_forward", f"""{B}, {MOVE}, s AS (SELECT *, {N} - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n, close / lag(close) {O}) - 1 AS ret, CASE WHEN rsi < 30 THEN 1 WHEN rsi > 70 THEN 0 END AS want FROM rs),
  h AS (SELECT *, coalesce(last_value(want IGNORE NULLS) {RUN}, 0) AS pos FROM s), g AS (SELECT *, ln(1 + coalesce(lag(pos) {O}), 0) * coalesce(ret, 0)) AS gain,
  least(3, i * 4 // n) AS win FROM h), w AS (SELECT *, row_number() OVER (PARTITION BY symbol, win ORDER BY date) - 1 AS j, count(*) OVER (PARTITION BY symbol, win) AS m FROM g)
  SELECT symbol, win AS "window", round(sum(CASE WHEN j < 0.7 * m THEN gain ELSE 0 END), 6) + 0.0 AS inside, round(sum(CASE WHEN j < 0.7 * m THEN 0 ELSE gain END), 6) + 0.0 AS outside FROM w GROUP BY 1, 2""")
def walk_forward(spark, d):
    df = X.walk_forward(V.bars(spark, d), "rsi_reversion", 4)
    return df.select("symbol", "window", (F.round("inside", 6) + 0.0).alias("inside"), (F.round("outside", 6) + 0.0).alias("outside"))


SHARES = [("Brand#1", 0.5), ("Brand#2", 1.5), ("Brand#3", 2.0)]


@query("w28_portfolio_nav", f"""{B}, s(symbol, weight) AS (VALUES {', '.join(f"('{a}', {b}::DOUBLE)" for a, b in SHARES)}),
  p AS (SELECT symbol, date, 100 * close / first_value(close) OVER (PARTITION BY symbol ORDER BY date) AS norm FROM v_bar)
  SELECT date, round(sum(norm * weight) / 4, 6) AS nav FROM p JOIN s USING (symbol) GROUP BY date HAVING count(*) = {len(SHARES)}""")
def portfolio(spark, d):
    weights = spark.createDataFrame(SHARES, "symbol string, weight double")
    return Q.portfolio(V.bars(spark, d), weights).select("date", F.round("nav", 6).alias("nav"))
