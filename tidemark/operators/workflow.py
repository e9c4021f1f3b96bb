"""Durable review queues: coverage, dispositions, retractions, pending work."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .asof import latest, states_asof

STATUSES = ["pending", "unrelated", "unresolved", "verified"]


def coverage(tasks: DataFrame, states: DataFrame, cutoff: str) -> DataFrame:
    """One row: the tasks published by the cutoff, by status at the cutoff."""
    at = F.lit(cutoff).cast("timestamp")
    rows = tasks.select("task_id", "published_at").filter(F.col("published_at").isNull() | (F.col("published_at") <= at)).join(states_asof(states, cutoff).select("task_id", "status"), "task_id", "left").withColumn("status", F.coalesce("status", F.lit("pending")))
    counts = [F.count_if(F.col("status") == s).alias(s) for s in STATUSES]
    return rows.agg(*counts, F.count("*").alias("total")).withColumns({"completed": F.col("total") - F.col("pending"), "all_processed": F.col("pending") == 0})


def apply_dispositions(events: DataFrame, states: DataFrame, cutoff: str, key: str) -> DataFrame:
    """Events with their task's status at the cutoff; unrelated ones go, verified ones take the task as cluster."""
    now = states_asof(states, cutoff).select(F.col("task_id").alias("_task"), F.col("status").alias("workflow_status"))
    out = events.join(now, F.col(key) == F.col("_task"), "left").filter(~F.col("workflow_status").eqNullSafe("unrelated"))
    return out.withColumn("event_cluster", F.when(F.col("workflow_status") == "verified", F.concat(F.lit("task:"), F.col("_task"))).otherwise(F.col("event_cluster"))).drop("_task")


def retractions(reviews: DataFrame, reasons: DataFrame, at: str) -> DataFrame:
    """The dated retraction of the latest review of each task that has a reason, with the review's columns; of equal times the first row.

    A review that is insufficient already is left as it is.
    """
    last = latest(reviews, ["task_id"], [F.desc("available_at"), F.asc("row_ord")]).filter(~F.col("grade").eqNullSafe("insufficient"))
    stamp, none = F.lit(at).cast("timestamp"), lambda c: F.lit(None).cast(reviews.schema[c].dataType)
    new = {"event_id": F.lit(""), "available_at": stamp, "received_at": stamp, "grade": F.lit("insufficient"), "grade_method": F.lit("review_retracted"), "grade_reason": F.col("reason"), "evidence_scope": F.lit("none"), "review_status": F.lit("retracted")}
    gone = {c: none(c) for c in ("direction_sign", "impact_level", "event_kind", "event_time", "stock_relevance", "evidence_confidence") if c in reviews.columns}
    return last.join(reasons.select("task_id", "reason"), "task_id").withColumns(new | gone).drop("reason").select("task_id", *[c for c in reviews.columns if c != "task_id"], *[c for c in new if c not in reviews.columns])


def retract(reviews: DataFrame, reasons: DataFrame, at: str) -> DataFrame:
    """The reviews with the retractions appended; nothing that was there changes."""
    return reviews.unionByName(retractions(reviews, reasons, at), allowMissingColumns=True)


def pending(tasks: DataFrame, done: DataFrame, limit: int | None = None) -> DataFrame:
    out = tasks.join(done.select("task_id"), "task_id", "left_anti")
    return out if limit is None else out.orderBy("task_id").limit(limit)


def first_success(attempts: DataFrame) -> DataFrame:
    """Each task's first fetched attempt in order, the attempts made until then, and a reason if none was fetched."""
    got = F.col("status") == "fetched"
    stop = attempts.groupBy("task_id").agg(F.min(F.when(got, F.col("attempt_ord"))).alias("first"), F.count("*").alias("n"))
    hit = attempts.filter(got).select("task_id", F.col("attempt_ord").alias("first"), "kind")
    return stop.join(hit, ["task_id", "first"], "left").select("task_id", F.coalesce("kind", F.lit("none")).alias("kind"), F.coalesce(F.col("first") + 1, F.col("n")).cast("bigint").alias("attempts"), F.when(F.col("first").isNull(), "no_usable_evidence").otherwise("ok").alias("reason"))
