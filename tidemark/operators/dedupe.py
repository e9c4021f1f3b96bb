"""Greedy dedup by several keys."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import Tables

ROUNDS = 24


def _scan(part: pd.DataFrame) -> pd.DataFrame:
    """The rule itself over the rows of one component, in order."""
    owner: dict = {}
    out = []
    for row_ord, keys in part.sort_values("rank", kind="stable").groupby("row_ord", sort=False):
        own = [(i, k) for i, k in sorted(zip(keys["i"], keys["k"], strict=True))]
        if not any(x in owner for x in own):
            owner |= dict.fromkeys(own, row_ord)
            out += [(row_ord, i, k) for i, k in own]
    return pd.DataFrame(out, columns=["row_ord", "i", "k"])


def _components(rows: DataFrame, tables: Tables) -> DataFrame:
    """rows (row_ord, pos, i, k) with ``component``: the first position that shared keys lead to, jumped towards by pointers."""
    labels = tables.write(rows.select("row_ord", F.col("pos").alias("component")).distinct())
    while True:
        by_key = rows.join(labels, "row_ord").groupBy("i", "k").agg(F.min("component").alias("least"))
        new = rows.join(by_key, ["i", "k"]).groupBy("row_ord").agg(F.min("least").alias("component"))
        # A label is the position of a row, whose own label may be an earlier one by now.
        further = new.select(F.col("row_ord").alias("_at"), F.col("component").alias("_further"))
        new = tables.write(new.join(further, F.col("component._tie") == F.col("_at")).select("row_ord", F.col("_further").alias("component")))
        changed = new.join(labels.withColumnRenamed("component", "_old"), "row_ord").filter("component <> _old").limit(1).count()
        tables.drop(labels)
        labels = new
        if not changed:
            return rows.join(labels, "row_ord")


def greedy_dedupe(rows: DataFrame, keys: list[str], order: list, rounds: int = ROUNDS) -> DataFrame:
    """rows with ``kept`` and ``duplicate_of`` (the kept row's row_ord).

    Rows are taken in order; one whose keys are all unseen is kept and its keys are
    registered; another is a duplicate of the owner of its first seen key, and its other keys
    are not registered. This is the first maximal independent set in that order: in each
    round a row that comes first for all its keys is kept, and the rows that share a key with
    it and come later are decided. A common key is decided as soon as its first row is, so
    what rounds leave over are long chains of rare keys; these are scanned in order, each
    connected component in a task. Empty keys count as none; keyless rows are kept.
    """
    tables = Tables(rows.sparkSession, "dedupe")
    ordered = rows.select("row_ord", F.struct(*order, F.col("row_ord").alias("_tie")).alias("pos"), *keys)
    long = F.explode(F.filter(F.array(*[F.struct(F.lit(i).alias("i"), F.col(k).alias("k")) for i, k in enumerate(keys)]), lambda x: F.coalesce(x["k"], F.lit("")) != ""))
    every = tables.write(ordered.select("row_ord", "pos", long.alias("x")).select("row_ord", "pos", "x.i", "x.k"))
    undecided, taken = every, []
    for _ in range(rounds):
        first = undecided.groupBy("i", "k").agg(F.min("pos").alias("first"))
        marked = undecided.join(first, ["i", "k"])
        lead = marked.groupBy("row_ord").agg(F.bool_and(F.col("pos") == F.col("first")).alias("lead")).filter("lead").select("row_ord")
        taken.append(tables.write(undecided.join(lead, "row_ord", "left_semi").select("i", "k", F.col("row_ord").alias("owner"), F.col("pos").alias("owner_pos"))))
        hit = undecided.join(taken[-1].select("i", "k"), ["i", "k"], "left_semi").select("row_ord").distinct()
        left = tables.write(undecided.join(hit, "row_ord", "left_anti"))
        if undecided is not every:
            tables.drop(undecided)
        undecided = left
        if undecided.isEmpty():
            break
    else:
        parts = _components(undecided, tables)
        ranked = parts.withColumn("rank", F.dense_rank().over(Window.partitionBy("component").orderBy("pos")))
        kept = ranked.select("component", "row_ord", "rank", "i", "k").groupBy("component").applyInPandas(_scan, "row_ord bigint, i int, k string")
        pos = undecided.select("row_ord", F.col("pos").alias("owner_pos")).distinct()
        taken.append(tables.write(kept.join(pos, "row_ord").select("i", "k", F.col("row_ord").alias("owner"), "owner_pos")))
    owners = taken[0]
    for more in taken[1:]:
        owners = owners.unionAll(more)
    # An owner that comes later than a duplicate had not registered the key yet.
    of = every.join(owners, ["i", "k"]).filter(F.col("owner_pos") <= F.col("pos")).groupBy("row_ord").agg(F.min_by("owner", "i").alias("owner"))
    out = rows.join(of, "row_ord", "left")
    kept = F.col("owner").isNull() | (F.col("owner") == F.col("row_ord"))
    return out.withColumns({"kept": kept, "duplicate_of": F.when(~kept, F.col("owner"))}).drop("owner")


def first_per_task(rows: DataFrame, key: str, published: str, now: str) -> DataFrame:
    """One row for each task: the latest published, a null counting as now, then the first row."""
    order = [F.desc(F.coalesce(published, F.lit(now).cast("timestamp"))), F.asc("row_ord")]
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("_rank = 1").drop("_rank")
