"""Streaming and model queries over the event and bar views.

A stream query lands the events in two parts, runs its job after each (with the
same checkpoint, so the second run goes on with the first one's state) and must
equal the batch SQL over all events.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import ml as M
from tidemark.plans.catalog import ORACLES, query
from tidemark.session import settle, shared_path
from tidemark.sources import views as V
from tidemark.streaming import jobs as J

E = f"WITH {V.EVENT_SQL}"


@query("st4_sliding", f"""{E}, s AS (SELECT region, severity, ts, unnest(range(24)) AS k FROM v_event), w AS (SELECT region, severity,
  date_trunc('hour', ts) + to_hours(k + 1) AS until FROM s) SELECT CAST(until AS TIMESTAMP) AS until, region, count(*) AS n,
  round(avg(severity), 11) AS avg_severity FROM w GROUP BY 1, 2""")
def sliding(spark, d):
    df = J.sliding(V.events(spark, d), ["region"])
    return df.select(F.col("until").cast("timestamp_ntz").alias("until"), "region", "n", F.round("avg_severity", 11).alias("avg_severity"))


@query("st7_sessions", f"""WITH {V.ACTIVITY_SQL}, g AS (SELECT *, CASE WHEN created_at - lag(created_at) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS s
  FROM v_activity WINDOW w AS (PARTITION BY user_id ORDER BY created_at)), i AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY created_at
  ROWS UNBOUNDED PRECEDING) AS island FROM g) SELECT user_id, min(created_at) AS start, max(created_at) + INTERVAL 30 MINUTE AS "end", count(*) AS n
  FROM i GROUP BY user_id, island""")
def sessions(spark, d):
    df = J.sessions(V.activity(spark, d))
    return df.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@query("st5_alerts", f"""{E} SELECT DISTINCT id, round(severity, 6) AS severity, u AS rule_user FROM v_event, (VALUES (1, 6.0, 'CLICK'), (2, 9.0, NULL)) r(u, t, c)
  WHERE severity >= t AND (c IS NULL OR c = category)""")
def alerts(spark, d):
    rules = spark.createDataFrame([(1, 10, 6.0, "CLICK"), (2, 11, 9.0, None)], "rule_user int, rule_id int, threshold double, rule_category string")
    return J.alerts(V.events(spark, d), rules).select("id", F.round("severity", 6).alias("severity"), "rule_user")


# longer than the table's time, so that what lands in the second run is not late
LATE = "60 days"


def _in_two_runs(parts, job):
    """The folder that job(stream, folder) leaves after a run over the first part and one over the second."""
    spark = parts[0].sparkSession
    folder = shared_path(spark, "stream")
    for p in parts:
        p.write.mode("append").parquet(f"{folder}/in")
        job(spark.readStream.schema(p.schema).parquet(f"{folder}/in"), folder)
    return folder


def _halves(df):
    return [df.where("id % 2 = 0"), df.where("id % 2 = 1")]


def _result(parts, aggregate):
    folder = _in_two_runs(parts, lambda s, f: J.keep_result(aggregate(s), f"{f}/out", f"{f}/state"))
    return parts[0].sparkSession.read.parquet(f"{folder}/out")


@query("st1_new_only", f"{E} SELECT id, category, country FROM v_event")
def new_only(spark, d):
    e = V.events(spark, d)
    # the second part brings the first one's rows again
    folder = _in_two_runs([e.where("id % 2 = 0"), e], lambda s, f: J.append_rows(J.new_only(s, late=LATE), f"{f}/out", f"{f}/state"))
    return spark.read.parquet(f"{folder}/out").select("id", "category", "country")


@query("st2_hourly_stream", ORACLES["st2_hourly_strip"])
def hourly_stream(spark, d):
    df = _result(_halves(V.events(spark, d)), lambda s: J.hourly(s, late=LATE))
    return df.select(F.col("hour").cast("timestamp_ntz").alias("hour"), "n", F.round("max_severity", 6).alias("max_severity"))


@query("st4_sliding_stream", ORACLES["st4_sliding"])
def sliding_stream(spark, d):
    df = _result(_halves(V.events(spark, d)), lambda s: J.sliding(s, ["region"], late=LATE))
    return df.select(F.col("until").cast("timestamp_ntz").alias("until"), "region", "n", F.round("avg_severity", 11).alias("avg_severity"))


@query("st5_alerts_stream", ORACLES["st5_alerts"])
def alerts_stream(spark, d):
    rules = spark.createDataFrame([(1, 10, 6.0, "CLICK"), (2, 11, 9.0, None)], "rule_user int, rule_id int, threshold double, rule_category string")
    e = V.events(spark, d)
    folder = _in_two_runs([e.where("id % 2 = 0"), e], lambda s, f: J.append_rows(J.alerts(s, rules, cooldown=LATE), f"{f}/out", f"{f}/state"))
    return spark.read.parquet(f"{folder}/out").select("id", F.round("severity", 6).alias("severity"), "rule_user")


@query("st7_sessions_stream", ORACLES["st7_sessions"])
def sessions_stream(spark, d):
    e = V.events(spark, d).select("id", "user_id", F.col("ts").alias("created_at"))
    df = _result(_halves(e), lambda s: J.sessions(s, late=LATE))
    return df.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@query("st8_daily_snapshot", f"""{E} SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n, round(avg(severity), 6) AS avg_severity, round(max(severity), 6) AS max_severity FROM v_event GROUP BY 1""")
def daily_snapshot(spark, d):
    folder = _in_two_runs(_halves(V.events(spark, d)), lambda s, f: J.snapshot(s, f"{f}/out", f"{f}/state"))
    df = J.read_snapshot(spark.read.parquet(f"{folder}/out"))
    return df.select(F.col("day").cast("string").alias("day"), "n", F.round("avg_severity", 6).alias("avg_severity"), F.round("max_severity", 6).alias("max_severity"))


@query("st12_late_rows", f"""{E} SELECT id, id % 2 = 1 AND ts < (SELECT max(ts) FROM v_event WHERE id % 2 = 0) - INTERVAL 10 DAY AS late FROM v_event""")
def late_rows(spark, d):
    folder = _in_two_runs(_halves(V.events(spark, d)), lambda s, f: J.split_late(s, f"{f}/ok", f"{f}/late", f"{f}/state", delay="10 days"))
    ok, late = (spark.read.parquet(f"{folder}/{x}").select("id", F.lit(x == "late").alias("late")) for x in ("ok", "late"))
    return ok.unionByName(late)


@query("m1_features")
def features(spark, d):
    return M.features(V.bars(spark, d))


@query("m2_direction")
def direction(spark, d):
    matrix = settle(M.features(V.bars(spark, d)))
    return M.direction_signals(M.train_direction(matrix, trees=10), matrix)
