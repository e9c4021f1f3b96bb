"""Decayed impact of reviewed events: supersession, clusters, sums."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .asof import latest

#: Weights by level, half-lives in days by kind, and the neutral band.
WEIGHTS = {"light": 1.0, "medium": 2.0, "major": 4.0}
HALF_LIVES = {"earnings": 3, "price_move": 2, "institutional_flow": 3, "opinion": 2, "regulation": 14, "partnership": 14, "capacity": 45, "calendar": 7, "other": 7, "unknown": 7}
NEUTRAL_BAND = 0.15


def _looked_up(key: Column, table: dict) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key).cast("double")


def invalid(asof: Column) -> Column:
    """Why an impact cannot be scored, or null. Shares that are missing count as whole."""
    share = lambda c: F.col(c).isNotNull() & (F.isnan(c) | ~F.col(c).between(0, 1))
    known = lambda c, values: F.coalesce(F.col(c).isin(*values), F.lit(False))
    return (
        F.when(~known("direction_sign", (-1, 0, 1)), "direction_sign")
        .when(~known("impact_level", WEIGHTS), "impact_level")
        .when(share("evidence_confidence"), "evidence_confidence")
        .when(share("stock_relevance"), "stock_relevance")
        .when(F.col("event_time").isNull() | (F.col("event_time") > asof), "event_time")
    )


def contribution(asof: Column, half_lives: dict | None = None) -> Column:
    """sign x weight x confidence x relevance, halved every half-life since the event."""
    age = (F.unix_micros(asof) - F.unix_micros("event_time")) / 86_400_000_000
    half = F.coalesce(_looked_up(F.col("event_kind"), half_lives or HALF_LIVES), F.lit(7.0))
    return F.col("direction_sign") * _looked_up(F.col("impact_level"), WEIGHTS) * F.coalesce("evidence_confidence", F.lit(1.0)) * F.coalesce("stock_relevance", F.lit(1.0)) * F.exp(-math.log(2) * age / half)


def review_key() -> Column:
    """What a later review supersedes by: its task, else its event id, else its address."""
    given = lambda c: F.nullif(F.col(c), F.lit(""))
    return F.coalesce(given("task_id"), given("event_id"), F.coalesce("url", F.lit("")))


def superseded(reviews: DataFrame, asof: str) -> DataFrame:
    """The latest review of each key by ``asof``, retractions included; of equal times the first row."""
    return latest(reviews.filter(F.col("available_at") <= F.lit(asof).cast("timestamp")), [review_key()], [F.desc("available_at"), F.asc("row_ord")])


def assessed() -> Column:
    """Whether a review says what its event means: a retraction and one without an assessment do not."""
    return (F.coalesce("grade", F.lit("insufficient")) != "insufficient") & F.col("impact_level").isNotNull()


def representatives(reviews: DataFrame) -> DataFrame:
    """Each cluster's strongest assessed review, dated by the cluster's first event, with the members' number.

    A review without a cluster is one of its own, by its event id. Missing shares count as
    nothing here.
    """
    strength = F.coalesce("evidence_confidence", F.lit(0.0)) * F.coalesce("stock_relevance", F.lit(0.0))
    cluster = F.coalesce(F.nullif("event_cluster", F.lit("")), "event_id", F.lit(""))
    of = Window.partitionBy("event_cluster")
    ranked = reviews.filter(assessed()).withColumn("event_cluster", cluster).withColumns(
        {
            "_rank": F.row_number().over(of.orderBy(strength.desc(), F.desc("available_at"), F.asc("row_ord"))),
            "members": F.count("*").over(of),
            "event_time": F.min("event_time").over(of),
        }
    )
    return ranked.filter("_rank = 1").drop("_rank")


def contributions(reviews: DataFrame, asof: str) -> DataFrame:
    """The representatives of what ``asof`` knows, with their contribution ``x``. One that cannot be scored fails the whole."""
    at = F.lit(asof).cast("timestamp")
    why = invalid(at)
    failed = F.raise_error(F.concat(F.lit("impact cannot be scored: "), why)).cast("double")
    return representatives(superseded(reviews, asof)).withColumn("x", F.when(why.isNotNull(), failed).otherwise(contribution(at)))


def synthesis(reviews: DataFrame, asof: str, band: float = NEUTRAL_BAND) -> DataFrame:
    """One row: sums of the clusters' contributions and their direction."""
    sums = contributions(reviews, asof).agg(
        F.count("*").alias("event_count"),
        F.coalesce(F.sum(F.col("members") - 1), F.lit(0)).alias("deduplicated_reprints"),
        F.coalesce(F.sum(F.greatest("x", F.lit(0.0))), F.lit(0.0)).alias("positive"),
        F.coalesce(F.sum(F.greatest(-F.col("x"), F.lit(0.0))), F.lit(0.0)).alias("negative"),
    )
    net, gross = F.col("positive") - F.col("negative"), F.col("positive") + F.col("negative")
    ratio = F.when(gross == 0, F.lit(0.0)).otherwise(net / gross)
    word = F.when(F.col("event_count") == 0, "no_verified_assessment").when(ratio > band, "bullish").when(ratio < -band, "bearish").otherwise("neutral")
    rounded = lambda c, n: F.round(c, 6).alias(n)
    return sums.select("event_count", "deduplicated_reprints", rounded(F.col("positive"), "positive"), rounded(F.col("negative"), "negative"), rounded(net, "net"), rounded(gross, "gross"), rounded(ratio, "normalized"), word.alias("direction"))
