"""Tables written to the folder that all executors share, to cut lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a session of one process (a local master) gets a folder until it ends; a cluster must name one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tidemark-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        base = f"file://{folder}"
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


class Tables:
    """Tables of one computation, deleted when it needs them no more."""

    def __init__(self, spark: SparkSession, name: str = "tables"):
        self.spark, self.folder, self.made = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}", 0

    def write(self, df: DataFrame) -> DataFrame:
        path, self.made = f"{self.folder}/{self.made}", self.made + 1
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._table_path = path
        return out

    def drop(self, df: DataFrame | None) -> None:
        if df is not None:
            where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._table_path)
            where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
