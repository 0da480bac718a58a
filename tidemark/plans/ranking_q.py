"""Queries on ranked search, on profiles of all users and on the alerts that they open."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import insight as I
from tidemark.operators import ml as M
from tidemark.operators import ranking as R
from tidemark.plans.catalog import query
from tidemark.session import shared_path
from tidemark.sources import views as V

STOP = ["the", "that", "and", "an", "in", "of", "it", "le", "la", "de", "et", "un", "en", "der", "die", "und", "el", "los", "que"]
ACTIONS = ["view", "click", "purchase"]
RE = r"[\p{L}\p{N}_]"


def _index(spark, d, stem):
    """Texts weigh 1.5 where their label says good quality, else 1."""
    good = V.table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    docs = V.table(spark, d, "documents").select("doc_id", "text", "source").join(good, "doc_id", "left")
    return R.index(docs, "doc_id", F.col("text"), F.when(F.col("quality") == 1, 1.5).otherwise(1.0), ["source"], stem)


def _queries(spark, d):
    return V.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


@query("t14_ranked", rf"""WITH lb AS (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1), w AS (SELECT doc_id, CASE WHEN quality = 1 THEN 1.5 ELSE 1.0 END::DOUBLE AS weight,
  regexp_extract_all(lower(coalesce(text, '')), '{RE}+') AS w FROM documents LEFT JOIN lb USING (doc_id)), st AS (SELECT count(*) AS docs, avg(len(w)) AS mean FROM w),
  p AS MATERIALIZED (SELECT doc_id, weight, len, term, count(*) AS tf FROM (SELECT doc_id, weight, len(w) AS len, unnest(w) AS term FROM w) GROUP BY ALL), f AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
  q AS (SELECT query_id, term, count(*) AS times FROM (SELECT item_id AS query_id, unnest(regexp_extract_all(lower(text), '{RE}+')) AS term FROM benchmark WHERE length(trim(text)) >= 3) GROUP BY ALL),
  s AS (SELECT query_id, doc_id, round(weight * sum(times * greatest(0.000001::DOUBLE, ln((docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE))) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / mean))), 9) AS score
    FROM q JOIN f USING (term) JOIN p USING (term), st GROUP BY query_id, doc_id, weight)
  SELECT query_id, doc_id, place, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS place FROM s) WHERE place <= 5""")
def ranked(spark, d):
    """The five best texts for all words of every benchmark item, as they stand."""
    out = R.search(_index(spark, d, False), "doc_id", _queries(spark, d), 5, stem=False, most=None)
    return out.select("query_id", "doc_id", F.col("place").cast("long").alias("place"), F.round("score", 6).alias("score"))


@query("t14_stemmed")
def stemmed(spark, d):
    """The same by stems, which SQL lacks; tests hold it against plain Python."""
    out = R.search(_index(spark, d, True), "doc_id", _queries(spark, d), 5, most=None)
    return out.select("query_id", "doc_id", F.col("place").cast("long").alias("place"), F.round("score", 6).alias("score"))


_STOP = ", ".join(f"'{s}'" for s in STOP)


@query("m5_profiles", rf"""WITH {V.ACTIVITY_SQL}, {V.DOC_SQL}, rd AS (SELECT user_id AS owner, detail AS item, max(created_at) AS ts FROM v_activity WHERE action IN ('view', 'click', 'purchase') GROUP BY 1, 2),
  nw AS (SELECT owner, item FROM (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY ts DESC, item) AS p FROM rd) JOIN v_doc ON doc_id = item WHERE p <= 100),
  n AS (SELECT owner, count(*) AS n FROM nw GROUP BY 1 HAVING count(*) >= 5), tk AS (SELECT doc_id AS item, list_filter(regexp_extract_all(lower(coalesce(title, '') || ' ' || coalesce(source, '')), '{RE}{{2,}}'), lambda x: x NOT IN ({_STOP})) AS w FROM v_doc),
  g AS (SELECT item, term, count(*) AS tf FROM (SELECT item, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM tk) GROUP BY ALL),
  t AS MATERIALIZED (SELECT owner, item, n, term, tf FROM nw JOIN n USING (owner) JOIN g USING (item)), c AS (SELECT owner, term, sum(tf) AS total, count(*) AS df FROM t GROUP BY ALL),
  ch AS (SELECT owner, term, df FROM (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY total DESC, term) AS p FROM c) WHERE p <= 200),
  x AS (SELECT owner, item, n, term, (1 + ln(tf)) * (ln((1 + n) / (1 + df)) + 1) AS x FROM t JOIN ch USING (owner, term)),
  m AS (SELECT owner, term, sum(y) / n AS w FROM (SELECT *, x / sqrt(sum(x * x) OVER (PARTITION BY owner, item)) AS y FROM x) GROUP BY owner, term, n)
  SELECT owner, term, round(w, 6) AS w, place FROM (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY round(w, 9) DESC, term) AS place FROM m) WHERE place <= 60""")
def user_profiles(spark, d):
    """Profiles of all users over titles and sources of the documents that they read."""
    a = V.activity(spark, d).select(F.col("user_id").alias("owner"), F.col("detail").alias("item"), "action", F.col("created_at").alias("ts"))
    docs = V.documents(spark, d).select(F.col("doc_id").alias("item"), F.concat_ws(" ", "title", "source").alias("text"))
    out = R.owner_profiles(R.recent_items(a, ACTIONS), docs, STOP)
    return out.select("owner", "term", F.round("w", 6).alias("w"), F.col("place").cast("long").alias("place"))


@query("m4_alert_relevance")
def alert_relevance(spark, d):
    """Clicks as alerts, opened by a view of the same user within half a day, learnt until a week before the newest; tests hold the rule on planted rows."""
    e = V.events(spark, d).withColumn("category_no", F.pmod(F.xxhash64("category", "country"), F.lit(13)).cast("double"))
    sent = e.where("category = 'CLICK'").select("id", "user_id", "ts", "severity", "k", "category_no")
    opened = e.where("category = 'VIEW'").select("user_id", "ts")
    cut = e.agg((F.max("ts") - F.expr("INTERVAL 7 DAYS")).alias("cut"))
    dated = I.within(sent, opened, "user_id", "ts", "ts", 720).join(F.broadcast(cut))
    samples = dated.where("ts < cut").withColumn("label", (F.col("n_within") > 0).cast("int"))
    late = dated.where("ts >= cut").select("id", "user_id", "severity", "k", "category_no")
    out = M.relevance(samples, late, "user_id", ["severity", "k", "category_no"], shared_path(spark, "model"))
    return out.select("id", "user_id", F.round("p", 6).alias("p"))
