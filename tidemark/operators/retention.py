"""Expiry of file groups and merges of observation times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def expired_groups(files: DataFrame, now: str, days: int = 7) -> DataFrame:
    """Groups all of whose files are older than the limit, strictly."""
    limit = F.lit(now).cast("timestamp") - F.make_dt_interval(F.lit(days))
    return files.groupBy("group_key").agg(F.max("mtime").alias("newest"), F.count("*").alias("files"), F.sum("bytes").alias("bytes")).filter(F.col("newest") < limit)


def observation_merge(rows: DataFrame, key: str, at: str) -> DataFrame:
    return rows.groupBy(key).agg(F.min(at).alias("first_observed_at"), F.max(at).alias("last_observed_at"), F.count("*").alias("n"))


def group_key() -> Column:
    """What expires together: a payload with its manifest, a report's files, else a file by itself."""
    path = F.col("path")
    return F.when(F.col("area") == "raw", F.regexp_replace(path, r"\.manifest\.json$", "")).when(F.col("area") == "reports", F.regexp_replace(path, r"\.[^./]*$", "")).otherwise(path)


def expired_files(files: DataFrame, now: str, days: int = 7) -> DataFrame:
    """The files (area, path, mtime, bytes) of groups all of which are older than the limit, strictly."""
    rows = files.withColumn("group_key", group_key())
    old = expired_groups(rows.withColumn("group_key", F.struct("area", "group_key")), now, days).select(F.col("group_key.area").alias("area"), F.col("group_key.group_key").alias("group_key"))
    return rows.join(old, ["area", "group_key"], "left_semi").select(*files.columns)


def unbacked(catalog: DataFrame, files: DataFrame, expired: DataFrame) -> DataFrame:
    """Catalog rows (with a path) whose file is not there, or is about to go."""
    left = files.select("path").join(expired.select("path"), "path", "left_anti")
    return catalog.join(left, "path", "left_anti")


def dangling(pointers: DataFrame, files: DataFrame, expired: DataFrame) -> DataFrame:
    """Pointers (pointer, folder) whose folder has no list of tasks, or one that is about to go."""
    left = files.select("path").join(expired.select("path"), "path", "left_anti")
    return pointers.withColumn("path", F.concat("folder", F.lit("/tasks.json"))).join(left, "path", "left_anti").drop("path")


def receipt(files: DataFrame, catalog: DataFrame, now: str, days: int = 7, dry_run: bool = False) -> DataFrame:
    """One row: what a cleanup finds, and what it takes away unless it only looks."""
    gone = expired_files(files, now, days)
    sums = gone.agg(F.count("*").alias("expired_files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("expired_bytes"))
    entries = unbacked(catalog, files, gone).agg(F.count("*").alias("catalog_entries_removed"))
    taken = lambda c: (F.lit(0) if dry_run else F.col(c)).cast("long")
    return sums.join(entries).select("expired_files", "expired_bytes", taken("expired_files").alias("deleted_files"), taken("expired_bytes").alias("freed_bytes"), "catalog_entries_removed", F.lit(dry_run).alias("dry_run"))


def size_by_area(files: DataFrame) -> DataFrame:
    return files.groupBy("area").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"))
