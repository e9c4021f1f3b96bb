"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import delete, new_path


class _Steps:
    """Tables of a round in the shared folder: a join of tables that are read has shuffles of its own, which adaptive execution can split at a hub."""

    def __init__(self, spark, folder: str):
        self.spark, self.folder, self.made = spark, folder, []

    def write(self, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{len(self.made)}"
        df.write.parquet(path)
        self.made.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, keep: int) -> None:
        """Deletes all tables but the last ``keep``."""
        for k, path in enumerate(self.made[: max(0, len(self.made) - keep)]):
            if path:
                delete(self.spark, path)
                self.made[k] = ""


def _large(edges: DataFrame, steps: _Steps) -> DataFrame:
    both = edges.unionAll(edges.select("v", "u"))
    least = steps.write(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(edges: DataFrame, steps: _Steps) -> DataFrame:
    least = steps.write(edges.groupBy("u").agg(F.min("v").alias("m")))
    down = edges.join(least, "u")
    return down.select("u", F.col("m").alias("v")).unionAll(down.filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")))


def components(links: DataFrame) -> DataFrame:
    """(node, root): each node of links (u, v) with the smallest node of its component.

    Every step is written to the shared folder, so lineage stays short and a lost executor
    costs a step at most; what a round wrote goes after the next. Only two numbers a round
    reach the driver. Rounds go on until nothing changes, which takes a number that grows with
    the logarithm of the nodes. A link of a node to itself and repeated links say nothing; an
    empty table gives an empty one.
    """
    spark = links.sparkSession
    steps = _Steps(spark, new_path(spark, "stars"))
    ordered = F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    links = links.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).filter("u <> v")
    edges = steps.write(links.select(*ordered).distinct())
    before, now = None, ()
    while now != before:
        large = steps.write(_large(edges, steps).filter("u <> v").select(*ordered).distinct())
        edges = steps.write(_small(large, steps).distinct())
        steps.drop(1)
        before, now = now, tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
