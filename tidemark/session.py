"""Session helper for local runs; on a cluster the caller brings their own session."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A UTC session with adaptive execution on, sized for one machine."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_path(spark: SparkSession, kind: str) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir); only in tests, where none is set, in one of our own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = spark.conf.get("spark.tidemark.folder", None) or tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.tidemark.folder", folder)
    return f"{folder.rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back, which cuts its lineage.

    Not checkpoint(): that keeps the estimated size of the plan it cuts, and in a
    loop of joins the estimates multiply until planning takes minutes.
    """
    spark = df.sparkSession
    path = shared_path(spark, "settled")
    df.write.parquet(path)
    return spark.read.parquet(path)
