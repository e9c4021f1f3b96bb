"""Point-in-time filters, latest rows and as-of joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import known_at


def visible(events: DataFrame, cutoff: str, lookback_days: int) -> DataFrame:
    """Events known by the cutoff and published within the lookback; no publication time passes."""
    at = F.lit(cutoff).cast("timestamp")
    since = at - F.make_dt_interval(F.lit(max(1, lookback_days)))
    known = known_at(F.col("available_at"), F.col("received_at"), F.col("published_at")) <= at
    return events.filter(known & (F.col("published_at").isNull() | (F.col("published_at") >= since)))


def for_securities(events: DataFrame, market: str, ids: list[str]) -> DataFrame:
    """Events of a market that name one of the securities, or none at all."""
    named = F.coalesce(F.arrays_overlap("security_ids", F.array(*map(F.lit, ids))), F.lit(False))
    return events.filter((F.col("market") == market) & ((F.size("security_ids") == 0) | named))


def latest(rows: DataFrame, keys: list, order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_rank = 1").drop("_rank")


def states_asof(states: DataFrame, cutoff: str) -> DataFrame:
    """Each task's latest state by the cutoff; of equal times the earliest in history."""
    return latest(states.filter(F.col("reviewed_at") <= F.lit(cutoff).cast("timestamp")), ["task_id"], [F.desc("reviewed_at"), F.asc("state_ord")])


def latest_vintages(observations: DataFrame, cutoff: str | None) -> DataFrame:
    """The latest vintage of each (series, date) by the cutoff, or of all without one, where unknown times come first; of equal times the later row."""
    if cutoff is not None:
        at = F.lit(cutoff).cast("timestamp")
        observations = observations.filter((F.col("available_at") <= at) & (F.col("observation_date") <= at.cast("date")))
    return latest(observations, ["series_id", "observation_date"], [F.desc_nulls_last("available_at"), F.desc("row_ord")])
