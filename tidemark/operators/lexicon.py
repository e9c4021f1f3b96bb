"""Evidence gate and lexicon grades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Phrases and their weights.
BULLISH = {
    "beat": 2, "beats": 2, "raise guidance": 3, "raised guidance": 3, "raises guidance": 3, "guidance raise": 3, "buyback": 2, "repurchase": 2,
    "dividend increase": 2, "raises dividend": 2, "approval": 2, "approved": 2, "contract win": 2, "wins contract": 2, "record revenue": 2,
    "record profit": 2, "upgrade": 2, "upgraded": 2, "outperform": 2, "partnership": 1, "launch": 1, "expansion": 1, "strong demand": 1,
    "profit growth": 1, "revenue growth": 1,
}
BEARISH = {
    "miss": -2, "misses": -2, "cut guidance": -3, "cuts guidance": -3, "lower guidance": -3, "guidance cut": -3, "lawsuit": -2,
    "investigation": -2, "probe": -2, "recall": -2, "downgrade": -2, "downgraded": -2, "underperform": -2, "bankruptcy": -4, "default": -3,
    "fraud": -4, "restatement": -3, "resignation": -1, "layoffs": -2, "weak demand": -1, "profit warning": -3, "impairment": -2,
}
MAGNITUDE = {"record": 1, "major": 1, "significant": 1, "substantial": 1, "minor": -1, "slight": -1, "small": -1}
#: Scopes that any policy admits, and those of the default policy.
ALWAYS_ADMITTED = ["full_text", "official_excerpt", "source_excerpt"]
DEFAULT_SCOPES = ["full_text", "official_excerpt", "numeric"]


def _entries(weights: dict[str, int]) -> Column:
    return F.array(*[F.struct(F.lit(p).alias("p"), F.lit(w).alias("w")) for p, w in weights.items()])


def hits(low: Column, weights: dict[str, int]) -> Column:
    """The entries whose phrase is a substring of the text, which is in lower case."""
    return F.filter(_entries(weights), lambda e: F.contains(low, e["p"]))


def _sum(found: Column) -> Column:
    return F.aggregate(found, F.lit(0), lambda a, e: a + e["w"])


def scored(rows: DataFrame, text: str, weights: dict[str, int], magnitude: dict[str, int] = MAGNITUDE) -> DataFrame:
    """rows with ``_hits`` (the phrases found, in order) and ``_score``; the text is lowered and searched once."""
    out = rows.withColumn("_low", F.lower(text)).withColumns({"_hits": hits(F.col("_low"), weights), "_sizes": hits(F.col("_low"), magnitude)})
    base, size = _sum(F.col("_hits")), _sum(F.col("_sizes"))
    out = out.withColumns({"_base": base, "_size": size})
    score = F.when(F.col("_base") > 0, F.col("_base") + F.col("_size")).when(F.col("_base") < 0, F.col("_base") - F.col("_size")).otherwise(F.col("_base"))
    return out.withColumns({"_score": score, "_hits": F.array_sort(F.transform("_hits", lambda e: e["p"]))}).drop("_low", "_sizes", "_base", "_size")


def grade(total: Column) -> Column:
    return (
        F.when(total >= 5, "very_bullish").when(total >= 3, "bullish").when(total >= 1, "moderately_bullish")
        .when(total <= -5, "very_bearish").when(total <= -3, "bearish").when(total <= -1, "moderately_bearish").otherwise("neutral")
    )


def graded(rows: DataFrame, weights: dict[str, int] | None = None, scopes: list[str] = DEFAULT_SCOPES, version: str = "lexicon_v1") -> DataFrame:
    """Events (evidence_scope, body, fact_summary, title, grade, grade_method) with the grade, its method, version and reason.

    Without an admitted scope the grade is insufficient, whatever it was; a grade that another
    method gave stays; else the first text of body, summary and title is graded.
    """
    admitted = F.coalesce(F.col("evidence_scope").isin(sorted({*scopes, *ALWAYS_ADMITTED})), F.lit(False))
    given = lambda c: F.nullif(F.col(c), F.lit("")) if c in rows.columns else F.lit(None).cast("string")
    out = scored(rows.withColumn("_text", F.coalesce(given("body"), given("fact_summary"), given("title"), F.lit(""))), "_text", weights or {**BULLISH, **BEARISH})
    empty = F.trim("_text") == ""
    preset = F.lit(False)
    if "grade" in rows.columns:
        preset = (F.coalesce("grade", F.lit("insufficient")) != "insufficient") & ~F.coalesce(given("grade_method"), F.lit("insufficient_evidence")).isin("insufficient_evidence")
    keep = lambda c: F.col(c) if c in rows.columns else F.lit(None).cast("string")
    pick = lambda scope, kept, none, else_: F.when(~admitted, scope).when(preset, kept).when(empty, none).otherwise(else_)
    found = F.when(F.size("_hits") > 0, F.concat(F.lit("hits="), F.array_join("_hits", ","))).otherwise("no_recognized_terms")
    return out.withColumns(
        {
            "grade": pick(F.lit("insufficient"), keep("grade"), F.lit("insufficient"), grade(F.col("_score"))),
            "grade_reason": pick(F.concat(F.lit("evidence_scope="), F.coalesce("evidence_scope", F.lit("none"))), keep("grade_reason"), F.lit("empty_text"), found),
            "grade_method": pick(F.lit("insufficient_evidence"), keep("grade_method"), F.lit("insufficient_evidence"), F.lit("lexicon")),
            "grade_version": pick(F.lit(version), keep("grade_version"), F.lit(version), F.lit(version)),
        }
    ).drop("_text", "_hits")
