"""Reviewed evidence: admissibility, the events it makes, import into a store, keys.

A review has ``sources``, an array of (url, published_at, evidence_locator) in order, and
optionally an impact: direction_sign, impact_level, event_time, stock_relevance, evidence_confidence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import versions
from . import impact

#: Scopes that a review may have, and the sign of each grade.
SCOPES = ["full_text", "official_excerpt", "source_excerpt", "numeric"]
SIGNS = {"very_bullish": 1, "bullish": 1, "moderately_bullish": 1, "neutral": 0, "moderately_bearish": -1, "bearish": -1, "very_bearish": -1}


def _one_of(key: Column, table: dict) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def _missing(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("")) == ""


def sign_contradicts(grade: str = "grade", sign: str = "direction_sign") -> Column:
    """Whether a grade has no sign, or another one."""
    return ~F.col(sign).eqNullSafe(_one_of(F.coalesce(F.col(grade), F.lit("")), SIGNS)) | F.col(sign).isNull()


def problem() -> Column:
    """Why a review cannot be imported, or null. A review without an impact level has no impact to check."""
    unlinked = lambda s: ~F.coalesce(s["url"].rlike("^(?i:https)://[^/?#]"), F.lit(False)) | (F.coalesce(s["evidence_locator"], F.lit("")) == "")
    late = lambda s: s["published_at"].isNull() | F.coalesce(s["published_at"] > F.col("reviewed_at"), F.lit(True))
    assessed = F.col("impact_level").isNotNull()
    return (
        F.when((F.coalesce(F.size("sources"), F.lit(-1)) <= 0) | _missing("fact_summary") | _missing("grade_reason"), "uncited")
        .when(~F.coalesce(F.col("evidence_scope").isin(SCOPES), F.lit(False)), "evidence_scope")
        .when(assessed & impact.invalid(F.col("reviewed_at")).isNotNull(), "impact")
        .when(assessed & sign_contradicts(), "sign")
        .when(F.exists("sources", unlinked), "source")
        .when(F.exists("sources", late), "published_after_review")
    )


def to_events(reviews: DataFrame) -> DataFrame:
    """Events as of the review: dated by the last source, addressed by the first, located by all."""
    return reviews.withColumns(
        {
            "event_id": F.lit(""),
            "published_at": F.array_max(F.transform("sources", lambda s: s["published_at"])),
            "available_at": F.col("reviewed_at"),
            "received_at": F.col("reviewed_at"),
            "source_id": F.lit("user_import"),
            "url": F.get("sources", F.lit(0))["url"],
            "evidence_locator": F.array_join(F.transform("sources", lambda s: s["evidence_locator"]), "; "),
            "grade_method": F.lit("source_review"),
            "body": F.lit(""),
        }
    )


def import_reviews(store: versions.Store, name: str, reviews: DataFrame, created_at: str) -> str:
    """A new version of the dataset with the reviews' events; the whole batch is checked before anything is written."""
    counts = reviews.agg(F.count("*").alias("n"), F.min(problem()).alias("why")).first()
    if not counts["n"] or counts["why"]:
        raise ValueError(f"reviews cannot be imported: {counts['why'] or 'none given'}")
    events = to_events(reviews)
    known = store.catalog().filter(F.col("name") == name).limit(1).count()
    return store.save(name, store.load(name).unionByName(events, allowMissingColumns=True) if known else events, created_at)


def synthesis_key(kept_id: Column) -> Column:
    """What a later review supersedes by: its task, else its event id, else its address.

    ``kept_id`` is the id that dedup gives to rows it keeps, and null on duplicates.
    """
    given = lambda c: F.nullif(F.col(c), F.lit(""))
    return F.coalesce(given("workflow_task_id"), given("event_id"), kept_id, F.col("url"))
