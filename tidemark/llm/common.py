"""Small helpers that the operators share."""

from __future__ import annotations

import sys
import tempfile
import uuid

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Texts go to Python in batches of so many rows at most, which bounds what a worker and the JVM hold for them; a smaller setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where that is unset (tests on one machine)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir()


def stored(df: DataFrame) -> DataFrame:
    """df written as Parquet to the shared folder and read again."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """df cut from its lineage by a written table.

    Not by checkpoint(): that keeps the size estimate of the plan it cuts, and
    in a loop of joins the estimates multiply until planning itself takes
    minutes. A table has its files' sizes.
    """
    return stored(df)


class Members:
    """A bit per hash slot for a set of 64-bit ids: 2**bits bits whatever the set's size, so it can go to every task.

    Ids that are in the set always pass; others pass by chance and are dropped by the exact join that follows.
    """

    def __init__(self, ids: DataFrame, column: str, bits: int = 24, hashed: bool = False):
        """hashed: the ids are hashes themselves, so their high bits are the slot."""
        self.bits, self.hashed = bits, hashed
        value = self.slot(column) + 1  # Spark's bitmap buckets count from 1
        rows = (
            ids.select(value.alias("v"))
            .groupBy(F.bitmap_bucket_number("v").alias("bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("v")).alias("bitmap"))
            .collect()  # at most 2**bits / 32768 rows of 4 KB
        )
        self.packed = np.zeros((1 << bits) // 8, dtype=np.uint8)
        for r in rows:
            self.packed[(r.bucket - 1) * 4096 :][:4096] = np.frombuffer(bytes(r.bitmap), dtype=np.uint8)

    def slot(self, column: str) -> Column:
        return F.shiftrightunsigned(F.col(column) if self.hashed else F.xxhash64(F.col(column)), 64 - self.bits)

    def inside(self, slots: np.ndarray) -> np.ndarray:
        return (self.packed[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1 == 1

    def inside_hashes(self, hashes: np.ndarray) -> np.ndarray:
        return self.inside((hashes >> np.uint64(64 - self.bits)).astype(np.int64))
