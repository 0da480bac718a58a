"""Queries over factor impacts, places, dependency edges, stated measures and pairs, and composite scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import lexicons as LX
from tidemark.operators import digest as D
from tidemark.operators import graph as G
from tidemark.operators import impacts as I
from tidemark.operators import series as S
from tidemark.plans.catalog import ORACLES, query
from tidemark.sources import views as V

E = f"WITH {V.EVENT_SQL}"
DOC = f"WITH {V.DOC_SQL}"

# the tables' event types stand in for categories
STANDS_FOR = {"CLICK": "CONFLICT", "VIEW": "ECONOMICS", "ERROR": "FINANCE", "PURCHASE": "ENERGY", "SIGNUP": "HEALTH"}
FACTORS = [(c, *f) for c, name in STANDS_FOR.items() for f in LX.FACTORS[name]]
MAGNITUDE = "least(10, greatest(1, round_even(severity * 1.05, 0)))"


@query("sf20_factor_impacts", f"""{E}, f(category, instrument, type, sign, base) AS (VALUES {', '.join(f"('{c}', '{i}', '{t}', {s}, {b}::DOUBLE)" for c, i, t, s, b in FACTORS)}),
  m AS (SELECT id, severity, instrument, sign, base, CAST(least(10, greatest(1, round_even({MAGNITUDE} * base * 10, 0))) AS INTEGER) AS short_magnitude FROM v_event JOIN f USING (category))
  SELECT id, instrument, CASE WHEN sign > 0 THEN 'positive' ELSE 'negative' END AS direction, short_magnitude, greatest(1, short_magnitude - 2) AS long_magnitude,
  round(base * severity * 1.5, 6) AS short_move, round(base * severity * 0.8, 6) AS long_move FROM m""")
def factor_impacts(spark, d):
    rules = spark.createDataFrame(FACTORS, "category string, instrument string, type string, sign int, base double")
    df = I.factor_impacts(V.events(spark, d), rules, digits=6)
    return df.select("id", "instrument", "direction", "short_magnitude", "long_magnitude", "short_move", "long_move")


@query("sf8_places", """WITH c AS (SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'q' || n_name ELSE lower(n_name) END AS code FROM customer JOIN nation ON c_nationkey = n_nationkey)
  SELECT c_custkey, coalesce(r_name, code) AS name, coalesce(n_nationkey * 3.5 - 40, 0.0)::DOUBLE AS lat, coalesce(n_nationkey * 14.0 - 170, 0.0)::DOUBLE AS lon FROM c
  LEFT JOIN nation n ON upper(code) = upper(n.n_name) LEFT JOIN region ON n.n_regionkey = r_regionkey""")
def places(spark, d):
    nation = V.table(spark, d, "nation")
    region = V.table(spark, d, "region")
    known = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_name").alias("code"), F.col("r_name").alias("name"), (F.col("n_nationkey") * 3.5 - 40).alias("lat"), (F.col("n_nationkey") * 14.0 - 170).alias("lon")
    )
    code = F.when(F.col("c_acctbal") < 0, F.concat(F.lit("q"), "n_name")).otherwise(F.lower("n_name"))
    c = V.table(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", code.alias("code"))
    return I.places(c, "code", known).select("c_custkey", "name", "lat", "lon")


@query("s7b_late_enrichment", f"""{E}, v AS (SELECT id, severity, k, region, category, CASE WHEN severity < 3 THEN 'XX' ELSE country END AS country FROM v_event)
  SELECT id, CASE WHEN category = 'VIEW' THEN CASE WHEN k > 50 THEN 'CLICK' ELSE 'VIEW' END ELSE category END AS category,
  round(CASE WHEN category = 'VIEW' THEN greatest(severity, k / 10) ELSE severity END, 6) AS severity, CASE WHEN country = 'XX' THEN region ELSE country END AS country FROM v""")
def late_enrichment(spark, d):
    e = V.events(spark, d).withColumn("country", F.when(F.col("severity") < 3, "XX").otherwise(F.col("country")))
    df = I.enriched(e, "VIEW", F.when(F.col("k") > 50, "CLICK").otherwise("VIEW"), F.col("k") / 10, F.col("region"))
    return df.select("id", "category", F.round("severity", 6).alias("severity"), "country")


RULES = [("CLICK", "country", "asset", "macro", 1.0), ("CLICK", "country", "sector", "regulatory", 0.85), ("VIEW", "country", "commodity", "supply_chain", 0.9), ("VIEW", "sector", "commodity", "supply_chain", 0.85)]
PARTS = {"country": "country", "sector": "region", "commodity": "CAST(k AS STRING)", "asset": "CAST(user_id AS STRING)"}


def _weight(n: str, confidence: float) -> str:
    return f"round(greatest(0, least(1, (0.35 * severity / 10 + 0.2 * 0.4 + 0.25 * ln(1 + {n}) / ln(11) + 0.2 * 0.3) * {confidence})), 4)"


@query("g4_dependency_edges", f"""{E}, n AS (SELECT id, 'country' AS kind, 'country:' || country AS node, 0 AS pos FROM v_event UNION ALL SELECT id, 'sector', 'sector:' || region, 1 FROM v_event
  UNION ALL SELECT id, 'commodity', 'commodity:' || CAST(k AS VARCHAR), 2 FROM v_event UNION ALL SELECT id, 'asset', 'asset:' || CAST(user_id AS VARCHAR), 3 FROM v_event),
  p AS (SELECT e.id, e.category, e.severity, a.kind AS sk, a.node AS src, b.kind AS tk, b.node AS tgt, row_number() OVER (PARTITION BY least(a.node, b.node), greatest(a.node, b.node) ORDER BY e.id) AS seen
    FROM n a JOIN n b ON a.id = b.id AND a.pos < b.pos JOIN v_event e ON a.id = e.id),
  r(category, sk, tk, relation, factor) AS (VALUES {', '.join(str(r) for r in RULES)}),
  x AS (SELECT src, tgt, relation, {_weight('1', 0.75)} * factor::DOUBLE AS weight, id FROM p JOIN r USING (category, sk, tk) UNION ALL
    SELECT src, tgt, CASE WHEN sk = 'country' AND tk IN ('sector', 'commodity') THEN 'regulatory' WHEN sk = 'sector' AND tk = 'commodity' THEN 'supply_chain' WHEN sk = 'country' AND tk = 'asset' THEN 'macro' ELSE 'mentions' END,
    {_weight('seen', 1.0)}, id FROM p WHERE severity >= 7 AND {_weight('seen', 1.0)} >= 0.3)
  SELECT src, tgt, relation, count(*) AS evidence, round(least(5.0, arg_min(weight, row(id, weight)) + 0.1 * (count(*) - 1)), 6) AS weight FROM x GROUP BY 1, 2, 3""")
def dependency_edges(spark, d):
    e = V.events(spark, d)
    each = F.array(*[F.struct(F.lit(k).alias("kind"), F.concat(F.lit(f"{k}:"), F.expr(c)).alias("node")) for k, c in PARTS.items()])
    entities = e.select(F.col("id").alias("event"), F.posexplode(each).alias("at", "x")).select("event", "at", "x.kind", "x.node")
    pairs = I.entity_pairs(entities, e.select(F.col("id").alias("event"), "category", "severity"), "event")
    rules = spark.createDataFrame(RULES, "category string, src_kind string, tgt_kind string, relation string, factor double")
    edges = I.dependency_edges(pairs, rules, F.lit(0.3), F.lit(-0.4)).withColumnRenamed("event", "seq")
    return G.merge_edges(edges).select("src", "tgt", "relation", "evidence", F.round("weight", 6).alias("weight"))


# links and verbs of invented prose in four languages
STATED_LINKS = ["of", "was", "is", "the", "and", "und"]
VERBS = ["that", "which", "und", "que", "dans", "und die", "de la"]

CLAUSES = f"""{DOC}, c0 AS (SELECT doc_id, string_split_regex(body, '{I.CLAUSE_END}') AS cs FROM v_doc),
  c1 AS (SELECT doc_id, CAST(generate_subscripts(cs, 1) - 1 AS INTEGER) AS clause, unnest(cs) AS t FROM c0),
  c AS (SELECT doc_id, clause, w, list_transform(w, lambda x: lower(x)) AS low FROM (
    SELECT doc_id, clause, list_filter(string_split_regex(t, '\\s+'), lambda x: x <> '') AS w FROM c1) WHERE len(w) > 1)"""


def _sql_list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{x}'" for x in words) + "]"


def _start_of_run(words: str) -> str:
    """The place of the last word of words that is not of letters only, or 0."""
    return f"coalesce(list_max([j FOR j IN range(1, len({words}) + 1) IF NOT regexp_full_match({words}[j], '\\p{{L}}+')]), 0)"


def _end_of_run(words: str) -> str:
    return f"coalesce(list_min([j FOR j IN range(1, len({words}) + 1) IF NOT regexp_full_match({words}[j], '\\p{{L}}+')]), len({words}) + 1) - 1"


@query("t29_measures", f"""{CLAUSES}, f AS (SELECT doc_id, clause, w, low, unnest(range(2, len(w))) AS "at" FROM c),
  v AS (SELECT doc_id, clause, "at", w[1:"at" - 1] AS b, w["at" + 1] AS token, coalesce(w["at" + 2], '') AS after FROM f
    WHERE list_contains({_sql_list(STATED_LINKS)}, low["at"]) AND regexp_full_match(w["at" + 1], '([0-9][0-9,.]*)(\\D*)')),
  x AS (SELECT doc_id, clause, CAST("at" AS INTEGER) AS "at", array_to_string(b[{_start_of_run('b')} + 1 :], ' ') AS name,
    replace(rtrim(regexp_extract(token, '^([0-9][0-9,.]*)(\\D*)$', 1), '.,'), ',', '') AS value, regexp_extract(token, '^([0-9][0-9,.]*)(\\D*)$', 2) AS own, after FROM v)
  SELECT doc_id, clause, "at", name, value, CASE WHEN list_contains({_sql_list(I.UNITS)}, own) THEN own WHEN own = '' AND list_contains({_sql_list(I.UNITS)}, after) THEN after ELSE '' END AS unit
  FROM x WHERE length(name) > 3 AND length(name) < 50""")
def measures(spark, d):
    return I.measures(V.documents(spark, d), "doc_id", F.col("body"), STATED_LINKS)


@query("t29_stated_pairs", f"""{CLAUSES}, f AS (SELECT *, unnest(range(0, len(w))) AS "at" FROM c),
  v AS (SELECT string_split(unnest({_sql_list(VERBS)}), ' ') AS verb),
  m AS (SELECT doc_id, clause, "at", len(verb) AS size, w[greatest(1, "at" - {I.END_WORDS - 1}) : "at"] AS b, w["at" + len(verb) + 1 : "at" + len(verb) + {I.END_WORDS}] AS a FROM f JOIN v ON low["at" + 1] = verb[1] AND low["at" + 1 : "at" + len(verb)] = verb),
  e AS (SELECT doc_id, clause, "at", size, substr(array_to_string(b[{_start_of_run('b')} + 1 :], ' '), 1, 60) AS src, substr(array_to_string(a[1:{_end_of_run('a')}], ' '), 1, 60) AS tgt FROM m),
  p AS (SELECT *, row_number() OVER (PARTITION BY doc_id, clause ORDER BY "at", size DESC) AS place FROM e WHERE length(src) > 3 AND length(tgt) > 3)
  SELECT doc_id, clause, src, tgt, 'causes' AS relation, 1.2::DOUBLE AS weight FROM p WHERE place = 1""")
def stated_pairs(spark, d):
    return I.stated_pairs(V.documents(spark, d), "doc_id", F.col("body"), VERBS, "causes", 1.2)


@query("x3_composite", f"""WITH t AS ({ORACLES['x2_technical_score']}), m AS ({ORACLES['w19_momentum']}), r AS ({ORACLES['w23_regime']}), c AS (SELECT symbol, count(*) AS n FROM m GROUP BY 1),
  g AS (SELECT t.symbol, n, t.score AS technical, CASE regime WHEN 'up' THEN 0.3 WHEN 'down' THEN -0.3 WHEN 'volatile' THEN -0.1 ELSE 0.0 END::DOUBLE AS regime, greatest(-1.0, least(1.0, m.momentum / 10)) AS momentum
  FROM t JOIN m ON t.symbol = m.symbol AND t.date = m.date JOIN r ON t.symbol = r.symbol AND t.date = r.date JOIN c ON t.symbol = c.symbol),
  s AS (SELECT *, round(greatest(-1.0, least(1.0, 0.3 * technical + 0.15 * regime + 0.2 * momentum)), 4) AS composite FROM g)
  SELECT symbol, composite + 0.0 AS composite, round(least(1.0, n / 200 * 0.4 + abs(technical) * 0.3 + abs(momentum) * 0.3), 3) AS confidence,
  CASE WHEN composite > 0.15 THEN 'BUY' WHEN composite < -0.15 THEN 'SELL' ELSE 'HOLD' END AS action FROM s""")
def composite(spark, d):
    bars = V.bars(spark, d)
    newest = S.momentum(S.regime(bars)).groupBy("symbol").agg(F.count("*").alias("n"), F.max_by(F.struct("regime", "momentum"), "date").alias("x"))
    regime = F.col("x.regime")
    bias = F.when(regime == "up", 0.3).when(regime == "down", -0.3).when(regime == "volatile", -0.1).otherwise(0.0)
    groups = newest.join(D.technical_score(bars), "symbol").select(
        "symbol", "n", F.round("score", 6).alias("technical"), bias.alias("regime"),
        F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.round("x.momentum", 6) / 10)).alias("momentum"),
    )
    return I.composite(groups, F.col("n")).select("symbol", (F.col("composite") + 0.0).alias("composite"), "confidence", "action")


@query("q11_overlay", f"""WITH {V.BAR_SQL}, w AS ({ORACLES['w24_reaction']}), e AS (SELECT o_orderkey AS key, p_brand AS symbol, min(CAST(o_orderdate AS DATE)) AS "on", min(o_orderpriority) AS category,
  least(10.0, min(o_totalprice) / 25000)::DOUBLE AS severity, max(l_discount)::DOUBLE * 10 AS relevance FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
  f AS (SELECT e.* FROM e JOIN (SELECT symbol, min(date) AS a, max(date) AS b FROM v_bar GROUP BY 1) USING (symbol) WHERE severity >= 5 AND relevance >= 0.2 AND "on" BETWEEN a AND b),
  k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY round(relevance * severity, 9) DESC, key) AS place FROM f) WHERE place <= 50),
  g AS (SELECT *, CASE WHEN date_diff('day', lag("on") OVER (PARTITION BY symbol, category ORDER BY "on", key), "on") <= 1 THEN 0 ELSE 1 END AS fresh FROM k),
  c AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY symbol, category ORDER BY "on", key ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cluster FROM g)
  SELECT symbol, key, category, place, cluster, r1, r2, r5, spike FROM c LEFT JOIN w USING (key, symbol)""")
def overlay(spark, d):
    line = V.with_orders(V.table(spark, d, "lineitem"), V.table(spark, d, "orders"))
    o = line.join(V.table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    events = o.groupBy(F.col("o_orderkey").alias("key"), F.col("p_brand").alias("symbol")).agg(
        F.min(F.to_date("o_orderdate")).alias("on"), F.min("o_orderpriority").alias("category"),
        F.least(F.lit(10.0), F.min("o_totalprice") / 25000).cast("double").alias("severity"), (F.max("l_discount").cast("double") * 10).alias("relevance"),
    )
    df = I.overlay(events, V.bars(spark, d), "key")
    return df.select("symbol", "key", "category", "place", "cluster", *[(F.round(c, 6) + 0.0).alias(c) for c in ("r1", "r2", "r5")], F.round("spike", 6).alias("spike"))
