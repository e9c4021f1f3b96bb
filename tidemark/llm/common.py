"""Helpers that the training-data operators share."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word contracts: space and tab to carriage return.
WS = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset, a session of one process (a local master) gets one until it ends; a cluster must name one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tidemark-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        base = f"file://{folder}"
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession) -> None:
    """Shuffle files of plans that nothing refers to any more go now, not when the driver's memory next fills.

    Spark's cleaner follows the driver's garbage collector: the first pass drops the plans,
    the second the shuffles that they held.
    """
    gc.collect()
    for _ in range(2):
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)


def batched(df: DataFrame, rows: int = 2000) -> DataFrame:
    """df, whose session sends texts to Python in batches of so many rows at most, where it says nothing else: buffers grow with the batch, and the JVM keeps them."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(df.sparkSession.conf.get(name)) == 10_000:  # the default
        df.sparkSession.conf.set(name, str(rows))
    return df


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: lineage ends here and sizes are known."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once for each row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def spread(df: DataFrame, each: int = 64 << 20, least: int | None = None) -> int:
    """How many parts to deal df's data into: ``least``, by default the session's shuffle partitions, or more if the optimizer's size of df is more than ``each`` bytes a part."""
    parts = least or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(parts, -(-size // each)) if size < 1 << 60 else parts  # beyond that, the size is not known
