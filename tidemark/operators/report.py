"""A research report as rows: context, impact, coverage, background, limits, and its lines.

Lines are rows (section, ord, part, line), so a report of any length is written by whoever
reads it in that order. The words are English; ``TEXT`` holds them.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..sources import versions
from . import asof, dedupe, identity, impact, lexicon, macro, workflow

DATASETS = ["securities", "news", "macro"]
LIMIT = 50
#: The order of sections.
HEAD, BACKGROUND, IMPACT, COVERAGE, EVENTS, SUMMARY, LIMITS = range(7)
TEXT = {
    "curve_10y_2y": "10-year less 2-year yield (points)",
    "cpi_yoy": "Consumer prices over a year (%)",
    "fx_20d": "Exchange rate, log change over 20 observations",
    "policy_change_20d": "Policy rate, change over 20 observations (points)",
    "official_excerpt": "official text checked",
    "source_excerpt": "passages of the source checked",
    "full_text": "full text checked",
    "numeric": "figures checked",
    "major": "major",
    "medium": "medium",
    "light": "light",
}


def _said(key: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in TEXT.items() for x in kv]), key), key)


def context(events: DataFrame, cutoff: str, lookback_days: int, limit: int | None = LIMIT, deduplicate: bool = True) -> DataFrame:
    """What is known of the window, graded: admitted evidence first, then the latest published; of equal ones the latest known, then the first row."""
    rows = asof.visible(events, cutoff, lookback_days)
    at = F.coalesce(F.unix_micros("available_at"), F.unix_micros("published_at"), F.lit(-(2**62)))
    if deduplicate:
        keyed = rows.withColumns({"_url": F.when(F.coalesce("url", F.lit("")) != "", S.canonical_url(F.col("url"))).otherwise(""), "_body": S.body_hash(F.col("body"))})
        rows = dedupe.greedy_dedupe(keyed, ["_url", "_body", "event_cluster"], [(-at).alias("_at")]).filter("kept").drop("_url", "_body", "kept", "duplicate_of")
    out = lexicon.graded(rows).drop("_score")
    ordered = out.orderBy((F.col("grade") != "insufficient").desc(), F.desc_nulls_last("published_at"), at.desc(), F.asc("row_ord"))
    return ordered if limit is None else ordered.limit(limit)


def _lines(df: DataFrame, section: int, order: Column | int, line: Column, part: int = 0) -> DataFrame:
    order = F.lit(order) if isinstance(order, int) else order
    return df.select(F.lit(section).alias("section"), order.cast("long").alias("ord"), F.lit(part).alias("part"), line.alias("line"))


def background_lines(background: DataFrame) -> DataFrame:
    value = F.concat(S.fixed(F.col("value"), 4), F.lit(" ("), F.col("series"), F.lit("; latest "), F.coalesce(F.col("latest").cast("string"), F.lit("unknown")), F.lit(")"))
    missing = F.concat(F.lit("missing ("), F.col("series"), F.lit("; "), F.col("reason"), F.lit(")"))
    return _lines(background, BACKGROUND, F.col("ord"), F.concat(F.lit("- "), _said(F.col("name")), F.lit(": "), F.when(F.col("status") == "ok", value).otherwise(missing)))


def impact_lines(contributions: DataFrame, cutoff: str, most: int = 20) -> DataFrame:
    """The table of the largest contributions, the largest first; of equal ones the first row."""
    top = contributions.orderBy(F.abs("x").desc(), F.asc("row_ord")).limit(most)
    rank = F.row_number().over(versions.Window.partitionBy(F.lit(0)).orderBy(F.abs("x").desc(), F.asc("row_ord")))  # most rows
    sign = F.when(F.col("direction_sign") > 0, "+").when(F.col("direction_sign") < 0, "−").otherwise("0")
    half = F.coalesce(impact._looked_up(F.col("event_kind"), impact.HALF_LIVES), F.lit(7.0))
    age = (F.unix_micros(F.lit(cutoff).cast("timestamp")) - F.unix_micros("event_time")) / 86_400_000_000
    cells = [S.markdown_cell(F.col("title")), sign, _said(F.col("impact_level")), S.iso(F.col("event_time")), S.fixed(F.pow(F.lit(2.0), -age / half), 3), S.fixed(F.col("x"), 3, sign=True)]
    return _lines(top.withColumn("_rank", rank), IMPACT, F.col("_rank"), F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")), part=1)


def synthesis_line(summary: DataFrame) -> DataFrame:
    said = F.concat(F.lit("Direction "), F.col("direction"), F.lit("; for "), S.fixed(F.col("positive"), 3), F.lit(", against "), S.fixed(F.col("negative"), 3), F.lit(", net "), S.fixed(F.col("net"), 3, sign=True), F.lit(" over "), F.col("event_count"), F.lit(" events, "), F.col("deduplicated_reprints"), F.lit(" reprints left out. A research score, no probability."))
    return _lines(summary, IMPACT, 0, F.when(F.col("event_count") > 0, said).otherwise("No assessed event is known; that is not neutral."))


def coverage_lines(coverage: DataFrame, unresolved: DataFrame, most: int = 5) -> DataFrame:
    """``coverage``: (ticker, ord and the counts); ``unresolved``: (ticker, task_id, title, reason), of which each ticker's first are told."""
    count = lambda c: F.col(c).cast("string")
    told = F.concat(F.col("ticker"), F.lit(": "), count("completed"), F.lit("/"), count("total"), F.lit(" done; verified "), count("verified"), F.lit(", unrelated "), count("unrelated"), F.lit(", unresolved "), count("unresolved"), F.lit(", pending "), count("pending"))
    rank = F.row_number().over(versions.Window.partitionBy("ticker").orderBy("task_id"))
    gaps = unresolved.withColumn("_rank", rank).filter(F.col("_rank") <= most).join(coverage.select("ticker", "ord"), "ticker")
    gap = F.concat(F.lit("- Gap: "), S.markdown_cell(F.col("title")), F.lit("; "), F.coalesce("reason", F.lit("no reason given")))
    return _lines(coverage, COVERAGE, F.col("ord") * 100, told).unionAll(_lines(gaps, COVERAGE, F.col("ord") * 100 + F.col("_rank"), gap))


def event_lines(events: DataFrame, most_pending: int = 5) -> DataFrame:
    """``events``: context rows with ``ord``. Graded events with their reasons; of the others the number and the first few."""
    graded = events.filter("grade <> 'insufficient'")
    when = F.coalesce(S.iso(F.col("published_at")), F.lit("time unknown"))
    url = F.when(F.coalesce("url", F.lit("")) != "", F.concat(F.lit("; "), F.col("url"))).otherwise("")
    first = F.concat(F.lit("- **"), F.col("grade"), F.lit("**: "), F.coalesce("title", F.lit("")), F.lit(" ("), F.col("source_id"), F.lit(", "), when, F.lit(", "), _said(F.col("evidence_scope")), F.lit(", "), F.col("grade_method"), url, F.lit(")"))
    why = F.concat(F.lit("  - Why: "), F.col("grade_reason"))
    out = _lines(graded, EVENTS, F.col("ord"), first).unionAll(_lines(graded.filter("grade_reason <> ''"), EVENTS, F.col("ord"), why, part=1))
    pending = events.filter("grade = 'insufficient'")
    n = pending.agg(F.count("*").alias("n")).filter("n > 0")
    out = out.unionAll(_lines(n, EVENTS, 1_000_000, F.concat(F.col("n").cast("string"), F.lit(" more records have no checked direction; they count for neither side."))))
    top = pending.orderBy("ord").limit(most_pending)
    return out.unionAll(_lines(top, EVENTS, F.col("ord") + 1_000_001, F.concat(F.lit("- Unchecked: ["), F.coalesce("title", F.lit("")), F.lit("]("), F.coalesce("url", F.lit("")), F.lit("); "), F.col("grade_reason"))))


def limitations(snapshot: DataFrame, unknown_tickers: DataFrame) -> DataFrame:
    """(ord, detail): the datasets that are missing and the tickers that no table names."""
    missing = snapshot.filter("missing").select(F.concat(F.lit("0"), F.col("name")).alias("k"), F.concat(F.lit("dataset "), F.col("name"), F.lit(" is missing; what depends on it is degraded")).alias("detail"))
    unknown = unknown_tickers.select(F.concat(F.lit("1"), F.col("ticker")).alias("k"), F.concat(F.col("ticker"), F.lit(" is not in the security master; default identity "), F.col("security_id")).alias("detail"))
    rank = F.row_number().over(versions.Window.partitionBy(F.lit(0)).orderBy("k"))  # a few rows: datasets and tickers of one request
    return missing.unionAll(unknown).select(rank.cast("long").alias("ord"), "detail")


def stages(context_rows: DataFrame, background: DataFrame) -> DataFrame:
    """(name, status, detail): degraded where there was nothing to tell."""
    news = context_rows.agg(F.count("*").alias("n")).select(F.lit("news_context").alias("name"), F.when(F.col("n") > 0, "ok").otherwise("degraded").alias("status"), F.concat(F.col("n").cast("string"), F.lit(" events")).alias("detail"))
    read = background.agg(F.count_if(F.col("status") == "ok").alias("n")).select(F.lit("macro_background").alias("name"), F.when(F.col("n") > 0, "ok").otherwise("degraded").alias("status"), F.concat(F.col("n").cast("string"), F.lit(" readings")).alias("detail"))
    return news.unionAll(read)


def policy_hash(policy: dict) -> str:
    """SHA-256 of a policy as JSON with its keys in order."""
    return hashlib.sha256(json.dumps(policy, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def impact_policy(changes: dict | None = None) -> dict:
    """The weights, half-lives and band that apply; new kinds of event may be added, levels may not."""
    changes = changes or {}
    out = {"version": "news-impact-v1", "impact_weights": impact.WEIGHTS | changes.get("impact_weights", {}), "half_life_days": impact.HALF_LIVES | changes.get("half_life_days", {}), "neutral_band": float(changes.get("neutral_band", impact.NEUTRAL_BAND))}
    if not 0 <= out["neutral_band"] <= 1 or any(not v > 0 for part in ("impact_weights", "half_life_days") for v in out[part].values()) or set(out["impact_weights"]) != set(impact.WEIGHTS):
        raise ValueError("impact policy: weights and half-lives are positive, levels are given, the band is a share")
    return out


def checked_request(market: str, tickers: list[str], lookback_days: int) -> list[str]:
    """The tickers in upper case, if a market is known, a ticker is named and the window is a day at least."""
    named = [t.strip().upper() for t in tickers if t.strip()]
    if market not in ("US", "HK") or not named or lookback_days < 1:
        raise versions.DataError("a request has a market, a ticker and a window of a day or more")
    return named


def research(events: DataFrame, reviews: DataFrame, observations: DataFrame, tasks: DataFrame, states: DataFrame, securities: DataFrame, market: str, tickers: list[str], cutoff: str, lookback_days: int = 30, changes: dict | None = None) -> dict[str, DataFrame]:
    """The parts of a report on some tickers of a market as of a cutoff; ``lines`` is all of it."""
    spark, tickers = events.sparkSession, checked_request(market, tickers, lookback_days)
    wanted = spark.createDataFrame([(k, t, market, cutoff[:10]) for k, t in enumerate(tickers)], "ord int, ticker string, market string, day string").withColumn("day", F.col("day").cast("date"))
    identities = identity.resolve(wanted.withColumnRenamed("ord", "request_id"), securities).withColumnRenamed("request_id", "ord").join(wanted, "ord")
    ids = [r["security_id"] for r in identities.collect()]  # one for each ticker asked for
    chosen = asof.for_securities(events, market, ids)
    shown = context(chosen, cutoff, lookback_days)
    rank = F.row_number().over(versions.Window.partitionBy(F.lit(0)).orderBy((F.col("grade") != "insufficient").desc(), F.desc_nulls_last("published_at"), F.asc("row_ord")))  # LIMIT rows
    shown = shown.withColumn("ord", rank)
    scored = impact.contributions(reviews, cutoff)
    summary = impact.synthesis(reviews, cutoff)
    known = macro.background(macro.for_market(observations, market), cutoff, changes)
    covered = workflow.coverage(tasks, states, cutoff).select(F.lit(0).alias("ord"), F.lit("/".join(tickers)).alias("ticker"), "*")
    gaps = spark.createDataFrame([], "ticker string, task_id string, title string, reason string")
    limits = limitations(spark.createDataFrame([], "name string, missing boolean"), identities.filter("matches = 0").select("ticker", "security_id"))
    done = stages(shown, known)
    head = spark.createDataFrame([(0, f"# Messages on {', '.join(tickers)}"), (1, f"- Market {market}; known by {cutoff}; window {lookback_days} days")], "ord int, line string")
    tail = _lines(limits, LIMITS, F.col("ord"), F.concat(F.lit("- "), F.col("detail"))).unionAll(_lines(done.filter("status <> 'ok'"), LIMITS, 1_000_000, F.concat(F.lit("- Stage "), F.col("name"), F.lit(": "), F.col("status"), F.lit(" ("), F.col("detail"), F.lit(")"))))
    lines = _lines(head, HEAD, F.col("ord"), F.col("line"))
    for part in (background_lines(known), synthesis_line(summary), impact_lines(scored, cutoff), coverage_lines(covered, gaps), event_lines(shown), tail):
        lines = lines.unionAll(part)
    return {"securities": identities, "context": shown, "contributions": scored, "impact": summary, "background": known, "coverage": covered, "limitations": limits, "stages": done, "lines": lines}


def publish(store: versions.Store, run_id: str, parts: dict[str, DataFrame], request: dict, created_at: str) -> str:
    """Writes a report's lines as a dataset of its own and registers the run; the lines read back in order are the report."""
    name = f"report-{run_id}"
    version = store.save(name, parts["lines"], created_at)
    store.register_run(run_id, store.entry(name, version)["path"], json.dumps(request, ensure_ascii=False, sort_keys=True), created_at)
    return version


def reproduce(store: versions.Store, run_id: str) -> list[str]:
    """A published report's lines."""
    run = store.run(run_id)
    if run is None:
        raise versions.DataError(f"unknown run: {run_id}")
    rows = store.spark.read.parquet(run["path"]).orderBy("section", "ord", "part", "line")
    return [r["line"] for r in rows.toLocalIterator()]
