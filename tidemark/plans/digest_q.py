"""Queries over groupings, profiles, patterns and summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import digest as D
from tidemark.operators import series as S
from tidemark.plans.catalog import query
from tidemark.plans.series_q import BB, MOVE, B, N, O, last
from tidemark.plans.text_q import WORDS
from tidemark.sources import views as V
from tidemark.streaming import jobs as J

E = f"WITH {V.EVENT_SQL}"
DOC = f"WITH {V.DOC_SQL}"
PATTERNS = {"english": (["the ", "that ", "thing"], 1.0), "french": (["eau", " les "], 1.5), "german": (["sch", " und "], 0.8)}


def _hit(label: str) -> str:
    t, w = PATTERNS[label]
    h = " + ".join(f"CAST(contains(lower(body), '{x}') AS INTEGER)" for x in t)
    return f"SELECT doc_id, source, '{label}' AS label, {h} AS hits, ({h}) * {w}::DOUBLE AS weighted FROM v_doc"


LH = f"lh AS (SELECT * FROM ({' UNION ALL '.join(_hit(x) for x in PATTERNS)}) WHERE hits > 0)"


@query("t5_top_labels", f"""{DOC}, {LH} SELECT doc_id, label, hits FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, label) AS p FROM lh) WHERE p <= 2""")
def top_labels(spark, d):
    found = D.label_hits(V.documents(spark, d), "doc_id", F.col("body"), PATTERNS)
    return D.top_labels(found, "doc_id", 2).select("doc_id", "label", "hits")


@query("a24_crisis_ranking", f"""{DOC}, {LH} SELECT label, round(least(10.0, 0.4 * sum(weighted)), 6) AS score, count(*) AS n, count(DISTINCT source) AS regions FROM lh GROUP BY label
  ORDER BY least(10.0, 0.4 * sum(weighted)) DESC, n DESC, label LIMIT 2""")
def crisis(spark, d):
    docs = V.documents(spark, d)
    df = D.crisis_ranking(D.label_hits(docs, "doc_id", F.col("body"), PATTERNS), docs, "doc_id", "source", 2)
    return df.select("label", F.round("score", 6).alias("score"), "n", "regions")


NAMES = [("united states", "US"), ("united kingdom", "GB"), ("china", "CN"), ("india", "IN"), ("france", "FR"), ("iran", "IR"), ("ira", "XI"), ("asia", "AS"), ("middle east", "ME"), ("east", "EA"), ("america", "AM"), ("africa", "AF")]


@query("t6_country", f"""{E} SELECT id, CASE WHEN contains(t, 'united kingdom') THEN 'GB' WHEN contains(t, 'united states') THEN 'US' WHEN contains(t, 'middle east') THEN 'ME' WHEN contains(t, 'america') THEN 'AM'
  WHEN contains(t, 'africa') THEN 'AF' WHEN contains(t, 'france') THEN 'FR' WHEN contains(t, 'china') THEN 'CN'
  WHEN contains(t, 'india') THEN 'IN' WHEN contains(t, 'asia') THEN 'AS' WHEN contains(t, 'east') THEN 'EA' WHEN contains(t, 'iran') THEN 'IR' WHEN contains(t, 'ira') THEN 'XI' ELSE 'XX' END AS code FROM (SELECT id, lower('report of ' || region || ' on ' || category) AS t FROM v_event)""")
def country(spark, d):
    text = F.concat(F.lit("report of "), "region", F.lit(" on "), "category")
    return D.extract_names(V.events(spark, d), "id", text, NAMES)


@query("t24_title_groups", f"""{DOC}, w AS (SELECT doc_id, lang, list_slice(list_sort(list_distinct({WORDS.format('title', 4)})), 1, 10) AS w FROM v_doc), f AS (SELECT lang, w, min(doc_id) AS doc_id FROM w WHERE len(w) > 0 GROUP BY 1, 2),
  y AS (SELECT doc_id, lang, w, unnest(w) AS term FROM f), p AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b, a.w AS wa, b.w AS wb FROM y a JOIN y b
  ON a.term = b.term AND a.lang = b.lang AND a.doc_id < b.doc_id UNION ALL SELECT f.doc_id, w.doc_id, w.w, w.w FROM f JOIN w ON f.lang = w.lang AND f.w = w.w AND f.doc_id < w.doc_id), j AS (SELECT a, b, len(list_intersect(wa, wb)) / len(list_distinct(list_concat(wa, wb))) AS j FROM p) SELECT a, b, round(j, 6) AS jaccard FROM j WHERE j >= 0.6""")
def title_groups(spark, d):
    df = D.title_groups(V.documents(spark, d), "doc_id", F.col("title"), "lang", 0.6)
    return df.select("a", "b", F.round("jaccard", 6).alias("jaccard"))


@query("t25_leader_groups", f"""WITH RECURSIVE {V.EVENT_SQL}, s AS (SELECT DISTINCT country, category, epoch_us(ts) AS s FROM v_event),
  c AS (SELECT country, category, min(s) AS lead FROM s GROUP BY 1, 2 UNION ALL
    SELECT c.country, c.category, (SELECT min(s.s) FROM s WHERE s.country = c.country AND s.category = c.category AND s.s - c.lead > 43200000000) FROM c WHERE c.lead IS NOT NULL),
  m AS (SELECT *, (SELECT max(lead) FROM c WHERE c.country = e.country AND c.category = e.category AND c.lead <= epoch_us(e.ts)) AS cluster FROM v_event e)
  SELECT category, country, arg_min(id, {{'t': ts, 'i': id}}) AS leader, min(ts) AS first, count(*) AS n, round(least(10.0::DOUBLE, max(severity) + 0.5::DOUBLE * ln(count(*))), 6) AS severity
  FROM m GROUP BY category, country, cluster""")
def leader_groups(spark, d):
    df = D.leader_groups(V.events(spark, d), ["category", "country"], 12)
    return df.select("category", "country", "leader", "first", "n", F.round("severity", 6).alias("severity"))


@query("t20_profiles", f"""{DOC}, t AS (SELECT source, doc_id, term, count(*) AS tf FROM (SELECT source, doc_id, unnest({WORDS.format('body', 3)}) AS term FROM v_doc) GROUP BY 1, 2, 3),
  n AS (SELECT source, count(*) AS docs FROM v_doc GROUP BY 1), f AS (SELECT source, term, count(*) AS df FROM t GROUP BY 1, 2),
  x AS (SELECT source, doc_id, term, docs, (1 + ln(tf)) * (ln((1 + docs) / (1 + df)) + 1) AS x FROM t JOIN f USING (source, term) JOIN n USING (source)),
  m AS (SELECT source, term, sum(y) / docs AS w FROM (SELECT *, x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)) AS y FROM x) GROUP BY source, term, docs)
  SELECT source, term, round(w, 9) AS w FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY round(w, 9) DESC, term) AS p FROM m) WHERE p <= 20""")
def profiles(spark, d):
    return D.profiles(V.documents(spark, d), "source", "doc_id", F.col("body"), 20).select("source", "term", "w")


@query("t21_profile_scores")
def profile_scores(spark, d):
    docs = V.documents(spark, d)
    return D.profile_scores(docs, "source", "doc_id", F.col("body"), D.profiles(docs, "source", "doc_id", F.col("body"), 20))


@query("x2_technical_score", f"""{B}, {MOVE}, {BB.replace('FROM v_bar', 'FROM rs')}, k AS (SELECT *, {N} AS i, CASE WHEN {N} >= 12 THEN avg(close) {last(12)} END AS a, CASE WHEN {N} >= 26 THEN avg(close) {last(26)} END AS b,
  max(high) {last(14)} AS hh, min(low) {last(14)} AS ll, (close - bb_low) / (bb_up - bb_low) AS pct FROM b2), v AS (SELECT symbol, date, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS p,
  list_filter([CASE WHEN rsi < 30 THEN 1.0 WHEN rsi > 70 THEN -1.0 WHEN rsi IS NOT NULL THEN 0.0 END, CASE WHEN a > b THEN 1.0 WHEN a < b THEN -1.0 END, CASE WHEN pct < 0.2 THEN 1.0 WHEN pct > 0.8 THEN -1.0 WHEN pct IS NOT NULL THEN 0.0 END,
  CASE WHEN i < 14 THEN NULL WHEN hh = ll THEN 0.0 WHEN 100 * (close - ll) / (hh - ll) < 20 THEN 1.0 WHEN 100 * (close - ll) / (hh - ll) > 80 THEN -1.0 ELSE 0.0 END]::DOUBLE[], lambda x: x IS NOT NULL) AS v FROM k)
  SELECT symbol, date, round(coalesce(list_sum(v), 0) / greatest(1, len(v)), 6) + 0.0 AS score FROM v WHERE p = 1""")
def technical(spark, d):
    return D.technical_score(V.bars(spark, d)).select("symbol", "date", (F.round("score", 6) + 0.0).alias("score"))


@query("q12_stress", """SELECT c_custkey AS owner, scenario, round(c_acctbal * (1 + c_nationkey % 3 * 0.25) * shock / 100, 9) + 0.0 AS loss FROM customer, (VALUES ('equity', -20.0), ('rates', -4.0), ('oil', 6.5)) s(scenario, shock)""")
def stress(spark, d):
    p = V.table(spark, d, "customer").select(F.col("c_custkey").alias("owner"), F.col("c_acctbal").alias("value"), (1 + F.col("c_nationkey") % 3 * 0.25).alias("beta"))
    s = spark.createDataFrame([("equity", -20.0), ("rates", -4.0), ("oil", 6.5)], "scenario string, shock double")
    return D.stress(p, s).select("owner", "scenario", (F.round("loss", 9) + 0.0).alias("loss"))


@query("j12_undirected", f"""WITH {V.EDGE_SQL} SELECT src AS node, tgt AS other, round(weight, 6) AS weight FROM v_edge WHERE src IN ('s1', 's9') UNION ALL SELECT tgt, src, round(weight, 6) FROM v_edge WHERE tgt = 'n4'""")
def undirected(spark, d):
    wanted = spark.createDataFrame([("s1",), ("s9",), ("n4",)], "node string")
    return D.undirected_neighbours(V.edges(spark, d), wanted).select("node", "other", F.round("weight", 6).alias("weight"))


@query("a43_movers", f"""{B}, q AS (SELECT symbol, close AS price, (close / lag(close) {O}) - 1) * 100 AS change_pct, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS p FROM v_bar)
  SELECT symbol, round(price, 6) AS price, round(change_pct, 6) AS change_pct FROM q WHERE p = 1 AND price > 0 ORDER BY round(abs(change_pct), 9) DESC, symbol LIMIT 6""")
def movers(spark, d):
    q = S.performance_at_end(V.bars(spark, d)).select("symbol", F.col("close").alias("price"), F.col("d1").alias("change_pct"))
    return D.movers(q, 6).select("symbol", F.round("price", 6).alias("price"), F.round("change_pct", 6).alias("change_pct"))


@query("a27_merge_clusters", f"""{E} SELECT country AS cluster, arg_max(id, row(severity, id)) AS id, count(*) AS n, count(DISTINCT category) AS sources, round(least(10.0, max(severity) + 0.4 * ln(count(*))), 6) AS severity FROM v_event WHERE severity < 6 GROUP BY country""")
def clusters(spark, d):
    e = V.events(spark, d).where("severity < 6").select(F.col("country").alias("cluster"), "id", "severity", F.col("category").alias("source"))
    return D.merge_clusters(e, "cluster").select("cluster", "id", "n", "sources", F.round("severity", 6).alias("severity"))


@query("s21_upsert_partial", """SELECT coalesce(c_custkey, 100000 + s_suppkey) AS id, coalesce(s_acctbal, c_acctbal) AS balance, c_name AS name FROM customer FULL JOIN (SELECT *, CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey ELSE 100000 + s_suppkey END AS k FROM supplier) s ON c_custkey = k""")
def partial(spark, d):
    old = V.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), F.col("c_name").alias("name"))
    key = F.when(F.col("s_suppkey") % 2 == 0, F.col("s_suppkey")).otherwise(100000 + F.col("s_suppkey"))
    return D.upsert_partial(old, V.table(spark, d, "supplier").select(key.alias("id"), F.col("s_acctbal").alias("balance")), "id", ["balance"])


@query("s7_union_first", """SELECT n_nationkey AS id, CASE WHEN n_nationkey % 2 = 0 THEN 'a' ELSE 'b' END AS src FROM nation""")
def union_first(spark, d):
    n = V.table(spark, d, "nation").select(F.col("n_nationkey").alias("id"))
    return D.union_first([n.where("id % 2 = 0").withColumn("src", F.lit("a")), n.withColumn("src", F.lit("b"))], "id")


@query("st6_opened_within", f"""{E}, s AS (SELECT user_id, k AS id, ts AS sent_at FROM v_event WHERE category = 'VIEW'), o AS (SELECT user_id AS open_user, k AS open_id, ts AS opened_at FROM v_event WHERE category = 'CLICK')
  SELECT user_id, id, sent_at, opened_at FROM s LEFT JOIN o ON open_user = user_id AND open_id = id AND opened_at >= sent_at AND opened_at <= sent_at + INTERVAL 7200 MINUTE""")
def opened(spark, d):
    e = V.events(spark, d)
    sends = e.where("category = 'VIEW'").select("user_id", F.col("k").alias("id"), F.col("ts").alias("sent_at"))
    opens = e.where("category = 'CLICK'").select(F.col("user_id").alias("open_user"), F.col("k").alias("open_id"), F.col("ts").alias("opened_at"))
    out = J.opened_within(sends, opens, minutes=7200)
    return out.select("user_id", "id", F.col("sent_at").cast("timestamp_ntz").alias("sent_at"), F.col("opened_at").cast("timestamp_ntz").alias("opened_at"))
