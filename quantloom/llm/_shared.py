"""Lineage cuts in the cluster's shared folder."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm._text import trim


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; on a local master without that setting, a temporary one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoint-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


#: What `scratch` has given out and `discard` has not taken back.
open_paths: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which goes when the application ends, or by `discard` once nothing reads it."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4()}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    open_paths.append(path)
    return path


def discard(spark: SparkSession, path: str) -> None:
    """Removes a path that no later step reads."""
    open_paths.remove(path)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def housed(df: DataFrame) -> DataFrame:
    """The rows of df, written as they lie, with home, the partition that holds them, and place, theirs in it.

    The table is bucketed by home without a shuffle, and read by bucket: what is grouped by home, or joined by it, meets
    the rows where they are.
    """
    spark = df.sparkSession
    name, n = f"housed_{uuid.uuid4().hex}", max(1, min(df.rdd.getNumPartitions(), 50_000))
    rows = df.select(F.spark_partition_id().alias("home"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("place"), "*")
    rows.write.bucketBy(n, "home").format("parquet").option("path", scratch(spark, name)).saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the name; the files are not the catalog's
    return out


def cut(df: DataFrame) -> DataFrame:
    """The rows of df, computed now and read from the checkpoint folder from here on; survives lost executors."""
    shared_folder(df.sparkSession)
    out = df.checkpoint()
    release(df)
    return out


def release(df: DataFrame) -> None:
    """Lets the driver's JVM find that shuffles of finished steps are no longer referred to, so that their files go, and
    hands what the driver's Python has freed back."""
    gc.collect()
    trim()
    df.sparkSession.sparkContext._jvm.System.gc()
