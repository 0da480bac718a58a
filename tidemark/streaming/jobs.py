"""Structured Streaming forms of the windowed aggregates, alert joins and deduplication.

Every function maps a streaming DataFrame to a streaming DataFrame, so it also
runs on a batch one; ts must be a timestamp (watermarks reject timestamp_ntz).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_time(df: DataFrame, ts: str = "ts", late: str = "1 day") -> DataFrame:
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def _once(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each key within the watermark; on a batch table, of all its rows."""
    return df.dropDuplicatesWithinWatermark(keys) if df.isStreaming else df.dropDuplicates(keys)


def new_only(df: DataFrame, key: str = "id", ts: str = "ts", late: str = "1 day") -> DataFrame:
    """Each key once within the watermark."""
    return _once(with_time(df, ts, late), [key])


def hourly(df: DataFrame, ts: str = "ts", late: str = "1 day") -> DataFrame:
    w = F.window(ts, "1 hour")
    agg = with_time(df, ts, late).groupBy(w).agg(F.count("*").alias("n"), F.max("severity").alias("max_severity"))
    return agg.select(F.col("window.start").alias("hour"), "n", "max_severity")


def sliding(df: DataFrame, keys: list[str], length: str = "24 hours", slide: str = "1 hour", ts: str = "ts", late: str = "1 day") -> DataFrame:
    """Count and mean severity by keys in sliding windows."""
    agg = with_time(df, ts, late).groupBy(F.window(ts, length, slide), *keys)
    out = agg.agg(F.count("*").alias("n"), F.avg("severity").alias("avg_severity"))
    return out.select(F.col("window.end").alias("until"), *keys, "n", "avg_severity")


def sessions(df: DataFrame, gap: str = "30 minutes", ts: str = "created_at", late: str = "1 day") -> DataFrame:
    """Per user the browsing sessions: rows less than the gap apart."""
    agg = with_time(df, ts, late).groupBy(F.session_window(ts, gap), "user_id").agg(F.count("*").alias("n"))
    return agg.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def alerts(df: DataFrame, rules: DataFrame, ts: str = "ts", cooldown: str = "2 hours") -> DataFrame:
    """Events joined with the rules they meet (a small static table); one alert per user and event within the cooldown."""
    e = df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, cooldown)
    meets = (F.col("severity") >= F.col("threshold")) & (
        F.col("rule_category").isNull() | (F.col("rule_category") == F.col("category"))
    )
    sent = e.join(F.broadcast(rules), meets).select(ts, "id", "severity", "rule_user", "rule_id")
    return _once(sent, ["rule_user", "id"])


def opened_within(sends: DataFrame, opens: DataFrame, minutes: int = 30, late: str = "2 hours") -> DataFrame:
    """Sends (user_id, id, sent_at) with the opens (open_user, open_id, opened_at) up to some minutes later; no open gives nulls."""
    s = with_time(sends, "sent_at", late)
    o = with_time(opens, "opened_at", late)
    near = F.expr(
        "open_user = user_id AND open_id = id AND opened_at >= sent_at"
        f" AND opened_at <= sent_at + INTERVAL {minutes} MINUTES"
    )
    return s.join(o, near, "left_outer")


def run_to_table(df: DataFrame, name: str, checkpoint: str, mode: str = "append"):
    """Runs over everything that is there and stops; the result is the in-memory table name."""
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint)
    q.trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.table(name)


def run_upsert(df: DataFrame, merge: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Hands every micro-batch to merge(batch, number)."""
    q = df.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).outputMode("update")
    q.trigger(availableNow=True).start().awaitTermination()


def _folder(path: str, number: int) -> str:
    """A micro-batch's own folder: a batch that runs again after a failure overwrites its rows."""
    return f"{path.rstrip('/')}/batch={number}"


def push_changes(aggregated: DataFrame, path: str, checkpoint: str) -> None:
    """Hands the groups that a micro-batch changed to listeners, as a folder of rows for each batch under path."""

    def push(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(_folder(path, number))

    run_upsert(aggregated, push, checkpoint)


def split_late(df: DataFrame, on_time: str, late: str, checkpoint: str, ts: str = "ts", delay: str = "1 day") -> None:
    """Writes rows to on_time, and those older than the newest of earlier batches by more than the delay to late.

    A null ts is on time. Both keep a folder for each batch; the newest time is read from the earlier folders, so a
    batch that runs again decides alike.
    """

    def split(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        top = None
        if number:
            top = spark.read.parquet(on_time).where(F.col("batch") < number).agg(F.max(ts)).first()[0]
        old = F.lit(False) if top is None else F.coalesce(F.col(ts) < F.lit(top) - F.expr(f"INTERVAL {delay}"), F.lit(False))
        batch.where(~old).write.mode("overwrite").parquet(_folder(on_time, number))
        batch.where(old).write.mode("overwrite").parquet(_folder(late, number))

    q = df.writeStream.foreachBatch(split).option("checkpointLocation", checkpoint)
    q.trigger(availableNow=True).start().awaitTermination()


def keep_result(df: DataFrame, path: str, checkpoint: str) -> None:
    """Runs an aggregate over what has landed since the last run and leaves its whole result at path."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    q = df.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).outputMode("complete")
    q.trigger(availableNow=True).start().awaitTermination()


def append_rows(df: DataFrame, path: str, checkpoint: str) -> None:
    """Runs a stream over what has landed since the last run and adds its rows at path, each micro-batch once."""
    q = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    q.trigger(availableNow=True).start().awaitTermination()


def snapshot(df: DataFrame, path: str, checkpoint: str, ts: str = "ts") -> None:
    """Adds each micro-batch's part of every day's snapshot (n, total and top severity); read_snapshot() sums the parts up."""
    run_upsert(df, lambda batch, number: day_parts(batch, ts).write.mode("overwrite").parquet(_folder(path, number)), checkpoint)


def day_parts(batch: DataFrame, ts: str) -> DataFrame:
    return batch.groupBy(F.to_date(ts).alias("day")).agg(F.count("*").alias("n"), F.sum("severity").alias("total"), F.max("severity").alias("top"))


def read_snapshot(df: DataFrame) -> DataFrame:
    """day, n, avg_severity and max_severity from the parts."""
    days = df.groupBy("day").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.max("top").alias("max_severity"))
    return days.select("day", "n", (F.col("total") / F.col("n")).alias("avg_severity"), "max_severity")
