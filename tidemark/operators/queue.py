"""The review queue's life: prepared from events, assessed in batches, finished, told as of a time.

A task is a row (task_id, title, source_url, published_at, security_ids, ticker, market,
search_query, status, reason, reviewed_at, ...); what it was before stays as rows of history.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import DataError
from ..functions import scalars as S
from . import impact, reviews
from .asof import latest

#: What ends a task, the evidence that only discovers, and the kinds of attempt that read.
TERMINAL = ["unrelated", "unresolved", "verified"]
DISCOVERY = ["title", "abstract", "none"]
READING = ["article_read", "original_read", "official_read"]
EXCHANGES = {"US": ("XNAS", "USD"), "HK": ("XHKG", "HKD")}


def default_identity(market: Column, ticker: Column) -> Column:
    """struct(security_id, currency) of a security that no table names."""
    pick = lambda k: F.coalesce(*[F.when(market == m, F.lit(v[k])) for m, v in EXCHANGES.items()])
    return F.struct(S.security_id(market, pick(0), F.trim(ticker)).alias("security_id"), pick(1).alias("currency"))


def reviewed() -> Column:
    """Whether an event has been reviewed already: a review's grade on evidence that does more than discover."""
    return (F.coalesce("grade_method", F.lit("")) == "source_review") & (F.coalesce("grade", F.lit("insufficient")) != "insufficient") & ~F.coalesce(F.col("evidence_scope").isin(DISCOVERY), F.lit(True))


def task_id() -> Column:
    """An event's own id, else one made of its address, title, time and securities."""
    return F.coalesce(F.nullif("event_id", F.lit("")), S.event_id(F.col("published_at"), F.col("security_ids"), F.col("title"), F.col("url")))


def prepare(events: DataFrame, identities: DataFrame, tickers: DataFrame, now: str) -> DataFrame:
    """The tasks of each (ticker, market): unreviewed events of its market that name one of its securities or none.

    The latest published comes first, a null counting as now, and of events with one id the
    first. A ticker without a security takes its default.
    """
    upper = lambda c: F.upper(F.trim(c))
    ids = identities.select(upper("ticker").alias("_t"), F.col("market").alias("_m"), "security_id").distinct()
    wanted = tickers.select("ticker", "market").join(ids, (upper("ticker") == F.col("_t")) & (F.col("market") == F.col("_m")), "left")
    wanted = wanted.select("ticker", "market", F.coalesce("security_id", default_identity(F.col("market"), upper("ticker"))["security_id"]).alias("_id")).distinct()
    open_ = events.filter(~reviewed()).withColumn("task_id", task_id())
    # An event meets a ticker by a security that both name, or by the market if it names none: two equi-joins, no pairs.
    named = open_.withColumn("_id", F.explode("security_ids")).join(wanted, ["market", "_id"]).drop("_id")
    unnamed = open_.filter(F.size("security_ids") == 0).join(wanted.select("ticker", "market").distinct(), "market")
    rows = named.unionByName(unnamed)
    at = F.coalesce("published_at", F.lit(now).cast("timestamp"))
    first = latest(rows, ["ticker", "market", "task_id"], [at.desc(), F.asc("row_ord")])
    return first.select("task_id", "title", F.col("url").alias("source_url"), "published_at", "security_ids", "ticker", "market", F.col("title").alias("search_query"), F.lit("pending").alias("status"), "row_ord")


def next_tasks(tasks: DataFrame, order: list, limit: int = 8) -> DataFrame:
    """The first tasks that are pending, in the queue's order."""
    return tasks.filter("status = 'pending'").orderBy(*order).limit(limit)


def assessment_problems(assessments: DataFrame, tasks: DataFrame) -> DataFrame:
    """Each assessment (task_id, status, reason, attempts array<struct<kind>>, review struct, stock_relevance) with why it is refused, or null.

    The review: impact_reason, reviewed_at, grade, direction_sign, impact_level, event_kind,
    event_time, stock_relevance, evidence_confidence, event_cluster.
    """
    known = tasks.select("task_id", F.lit(True).alias("_known")).distinct()
    counts = assessments.groupBy("task_id").agg(F.count("*").alias("_n"))
    rows = assessments.join(known, "task_id", "left").join(counts, "task_id", "left")
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    for c in ("direction_sign", "impact_level", "stock_relevance", "evidence_confidence", "event_time"):
        rows = rows.withColumn(f"_own_{c}", F.col(c) if c in assessments.columns else F.lit(None))
    flat = rows.withColumns({c: F.col(f"review.{c}") for c in ("direction_sign", "impact_level", "stock_relevance", "evidence_confidence", "event_time", "grade")})
    verified = F.col("status") == "verified"
    read = F.exists("attempts", lambda a: a["kind"].isin(READING))
    problem = (
        F.when(F.col("_n") > 1, "duplicate")
        .when(F.col("_known").isNull(), "unknown_task")
        .when(~F.coalesce(F.col("status").isin(TERMINAL), F.lit(False)) | blank(F.col("reason")) | (F.coalesce(F.size("attempts"), F.lit(-1)) <= 0), "incomplete")
        .when(verified & F.col("review").isNull(), "incomplete")
        .when(verified & blank(F.col("review.impact_reason")), "impact_reason")
        .when(verified & impact.invalid(F.col("review.reviewed_at")).isNotNull(), "impact")
        .when(verified & reviews.sign_contradicts(), "sign")
        .when(verified & ~F.coalesce(read, F.lit(False)), "unread")
        .when(verified & blank(F.col("review.event_cluster")), "event_cluster")
        .when((F.col("status") == "unrelated") & (F.coalesce("_own_stock_relevance", F.lit(0.0)) != 0), "relevance")
    )
    return flat.withColumn("problem", problem).select(*assessments.columns, "problem")


class Applied(NamedTuple):
    tasks: DataFrame
    history: DataFrame
    reviews: DataFrame
    retractions: DataFrame


def apply(tasks: DataFrame, assessments: DataFrame, now: str) -> Applied:
    """The tasks after a batch of assessments, the states that it replaces, the reviews to import, and the (task_id, reason) to retract.

    The whole batch is checked first; one refused assessment refuses all.
    """
    bad = assessment_problems(assessments, tasks).filter("problem IS NOT NULL").orderBy("problem", "task_id").first()
    if bad:
        raise DataError(f"assessment of {bad['task_id']} refused: {bad['problem']}")
    new = assessments.select("task_id", F.col("status").alias("_status"), F.col("reason").alias("_reason"), F.col("attempts").alias("_attempts"), F.col("review").alias("_review"))
    stamp = F.lit(now).cast("timestamp")
    both = tasks.join(new, "task_id", "left")
    hit = F.col("_status").isNotNull()
    state = {"status": "_status", "reason": "_reason", "attempts": "_attempts", "review": "_review"}
    kept = lambda c: F.col(c) if c in tasks.columns else F.lit(None)
    changed = {c: F.when(hit, F.col(n)).otherwise(kept(c)) for c, n in state.items()} | {"reviewed_at": F.when(hit, stamp).otherwise(kept("reviewed_at"))}
    done = both.select(*[F.col(c) for c in tasks.columns if c not in changed], *[v.alias(c) for c, v in changed.items()])
    before = both.filter(hit & (F.col("status") != "pending"))
    history = before.select("task_id", *[kept(c).alias(c) for c in (*state, "reviewed_at")])
    task = {"security_ids": F.col("security_ids"), "market": F.coalesce("market", F.lit("US")), "workflow_task_id": F.col("task_id"), "discovered_titles": F.array("title")}
    accepted = both.filter("_status = 'verified'").select(*[v.alias(c) for c, v in task.items()], "_review.*")
    return Applied(done, history, accepted, new.filter("_status <> 'verified'").select("task_id", F.col("_reason").alias("reason")))


def states(tasks: DataFrame, history: DataFrame) -> DataFrame:
    """What each task was and is, as (task_id, status, reason, reviewed_at, state_ord): its history, then the task itself."""
    columns = ["task_id", "status", "reason", "reviewed_at"]
    return history.select(*columns, F.lit(0).alias("state_ord")).unionAll(tasks.select(*columns, F.lit(1).alias("state_ord"))).filter("reviewed_at IS NOT NULL")


def rows_hash(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """One row: SHA-256 over all rows, whatever their order and layout.

    Each row is hashed as JSON with its columns in alphabetical order; hashes are combined by
    the first three digits of the key's hash, and these 4,096 at most by the last.
    """
    text = F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"})
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    parts = rows.select(F.substring(sha(F.col(key).cast("string")), 1, 3).alias("p"), sha(text).alias("h"))
    joined = parts.groupBy("p").agg(sha(F.array_join(F.array_sort(F.collect_list("h")), ",")).alias("h"))
    return joined.agg(sha(F.array_join(F.array_sort(F.collect_list(F.concat("p", "h"))), ",")).alias("state_sha256"))


def status(tasks: DataFrame) -> DataFrame:
    """One row: tasks by status, how many are done, whether all are, and the hash of their states."""
    counts = [F.count_if(F.col("status") == s).alias(s) for s in ["pending", *TERMINAL]]
    n = tasks.agg(*counts, F.count("*").alias("total"))
    done = n.withColumns({"completed": F.col("total") - F.col("pending"), "all_processed": F.col("pending") == 0})
    return done.join(rows_hash(tasks, "task_id", ["task_id", "status", "reason", "reviewed_at"]))  # one row and one row


def finalize(tasks: DataFrame, now: str) -> DataFrame:
    """The completion of a queue (its status and time), which no task may hinder."""
    out = status(tasks).withColumn("completed_at", F.lit(now).cast("timestamp"))
    pending = F.raise_error(F.lit("cannot finalize while headline tasks remain pending")).cast("boolean")
    return out.withColumn("all_processed", F.when(F.col("all_processed"), True).otherwise(pending))


def finalized(tasks: DataFrame, completion: DataFrame, cutoff: str) -> DataFrame:
    """One row: whether the queue was complete by the cutoff and is what it was then."""
    at = F.lit(cutoff).cast("timestamp")
    now = rows_hash(tasks, "task_id", ["task_id", "status", "reason", "reviewed_at"]).withColumnRenamed("state_sha256", "_now")
    last = completion.filter(F.col("completed_at") <= at).agg(F.max_by("state_sha256", "completed_at").alias("_then"))
    return now.join(last).select((F.col("_then").isNotNull() & (F.col("_then") == F.col("_now"))).alias("finalized"))


def unresolved_items(tasks: DataFrame, states_: DataFrame, cutoff: str) -> DataFrame:
    """(task_id, title, source_url, reason) of the tasks that are unresolved as of the cutoff."""
    at = F.lit(cutoff).cast("timestamp")
    now = latest(states_.filter(F.col("reviewed_at") <= at), ["task_id"], [F.desc("reviewed_at"), F.asc("state_ord")]).select("task_id", F.col("status").alias("_s"), F.col("reason").alias("_r"))
    rows = tasks.filter(F.col("published_at").isNull() | (F.col("published_at") <= at)).join(now, "task_id")
    return rows.filter("_s = 'unresolved'").select("task_id", "title", "source_url", F.col("_r").alias("reason"))
