"""Session helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a temporary one only where none is named (tests)."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        named = "file://" + tempfile.mkdtemp(prefix="pointloom-checkpoint-")
        sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared folder and forget its lineage.

    Spark's cleaner drops the shuffle and checkpoint files of frames that nothing refers to any more,
    but only after the driver has collected its garbage, which a driver with little to do may not do
    for many steps; so it is asked to."""
    checkpoint_dir(df.sparkSession)
    out = df.checkpoint()
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
    return out


@contextmanager
def short_batches(spark: SparkSession, rows: int = 1024) -> Iterator[None]:
    """Rows of text that run inside go to Python in batches of this many, not 10,000: whole texts may be
    long, and the JVM and the worker hold a batch each. The session's own setting is put back."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_bucket(doc_id, modulus: int):
    """crc32 of the id as text, modulo; null ids give null."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(modulus)
