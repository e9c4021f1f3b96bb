"""Evidence collection over stored searches and readings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S


def candidates(sources: DataFrame, task: str, order: str, url: str, most: int) -> DataFrame:
    """The first ``most`` different public addresses of each task's search results, as (task_id, url, rank)."""
    first = sources.filter(S.public_url(F.col(url))).groupBy(F.col(task).alias("task_id"), F.col(url).alias("url")).agg(F.min(order).alias("_at"))
    rank = F.row_number().over(Window.partitionBy("task_id").orderBy("_at", "url"))
    return first.withColumn("rank", rank).filter(F.col("rank") <= most).select("task_id", "url", F.col("rank").cast("long").alias("rank"))


def replay(requests: DataFrame, readings: DataFrame) -> DataFrame:
    """Requests (task_id, url) answered from stored readings (task_id, url, ord, status, quote), never from a new fetch.

    The first reading of an address counts. What the archive lacks comes back as unavailable,
    with the reason.
    """
    first = readings.groupBy("task_id", "url").agg(F.min_by(F.struct("status", "quote"), "ord").alias("r"))
    kept = readings.groupBy("task_id").agg(F.lit(True).alias("_kept"))
    rows = requests.join(first, ["task_id", "url"], "left").join(kept, "task_id", "left")
    found = F.col("r").isNotNull()
    return rows.select(
        "task_id",
        "url",
        F.when(F.col("r.status") == "read", "fetched").otherwise("unavailable").alias("status"),
        F.when(found, F.lit(None)).when(F.col("_kept"), "URL_not_in_archived_fetch").otherwise("archived_fetch_missing").alias("reason"),
        F.when(found, F.coalesce("r.quote", F.lit(""))).alias("quote"),
    )


def evidence_row(title: Column, status: Column, source: Column, url: Column, published: Column, text: Column, digest: Column) -> Column:
    """One line of the evidence table: title, status, linked source, date, excerpt or gap, hash."""
    cell = S.markdown_cell
    named = F.when(F.coalesce(source, F.lit("")) != "", source).otherwise(url)
    link = F.when(F.coalesce(url, F.lit("")) != "", F.concat(F.lit("["), cell(named), F.lit("]("), url, F.lit(")"))).otherwise(F.lit("无来源"))
    parts = [cell(title), cell(status), link, cell(published), cell(F.coalesce(F.nullif(text, F.lit("")), F.lit("body_missing"))), cell(digest)]
    return F.concat(F.lit("| "), F.concat_ws(" | ", *parts), F.lit(" |"))


def queries(title: Column, ticker: Column, published: Column) -> Column:
    """What is searched for a task, in turn: its title, then ticker, title and day."""
    day = F.coalesce(F.date_format(published, "yyyy-MM-dd"), F.lit(""))
    return F.array(title, F.concat(ticker, F.lit(" "), title, F.lit(" "), day))


def search_results(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """The sources (url, title, published_at, snippet, ord) of a search's JSON answer that have an address; an answer without a list of results fails."""
    kind = "struct<results: array<struct<url: string, title: string, date: string, snippet: string>>>"
    rows = F.from_json(payload, kind)["results"]
    listed = F.get_json_object(payload, "$.results")
    found = F.when(listed.isNull(), F.array().cast("array<struct<url:string,title:string,date:string,snippet:string>>")).when(F.ltrim(listed).startswith("["), rows).otherwise(F.raise_error(F.lit("search results must be a list")).cast("array<struct<url:string,title:string,date:string,snippet:string>>"))
    out = payloads.select(*[c for c in payloads.columns if c != payload], F.posexplode(found).alias("ord", "r"))
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    return out.filter("r.url <> ''").select(*[c for c in payloads.columns if c != payload], "ord", "r.url", blank("r.title").alias("title"), F.col("r.date").alias("published_at"), blank("r.snippet").alias("snippet"))


def documents(rows: DataFrame) -> DataFrame:
    """Fetched rows (status, markdown, fetch_publication, search_publication, reason, content_sha256, excerpt_only) as evidence.

    Adds published_at with its basis, the hash of the body, an excerpt of 200 words and
    whether it is cut. A fetched row without a body, or one that shows a barrier, is
    unavailable, with the reason.
    """
    body = F.coalesce("markdown", F.lit(""))
    out = rows.withColumns({"_words": S.words(body), "_fetch": S.publication_time(F.col("fetch_publication")), "_search": S.publication_time(F.col("search_publication")), "_barred": S.restricted(body)})
    has = body != ""
    excerpt = F.when(has, F.array_join(F.slice("_words", 1, 200), " "))
    basis = F.when(F.col("_fetch").isNotNull(), "fetch_metadata").when(F.col("_search").isNotNull(), "search_metadata").otherwise("unavailable_or_timezone_unknown")
    out = out.withColumns(
        {
            "published_at": F.coalesce("_fetch", "_search"),
            "publication_time_basis": basis,
            "content_sha256": F.when(has, F.coalesce(F.nullif("content_sha256", F.lit("")), F.sha2(body.cast("binary"), 256))).otherwise(F.col("content_sha256")),
            "excerpt": excerpt,
            "excerpt_truncated": F.when(has, F.coalesce("excerpt_only", F.lit(False)) | (F.size("_words") > 200)),
        }
    )
    gone = (F.col("status") == "fetched") & ((F.coalesce("excerpt", F.lit("")) == "") | F.col("_barred"))
    why = F.when(F.col("_barred"), "access_restricted").otherwise("empty_body_or_excerpt")
    out = out.withColumns({"reason": F.when(gone, why).otherwise(F.col("reason")), "status": F.when(gone, "unavailable").otherwise(F.col("status")), "semantic_review_complete": F.lit(False)})
    return out.drop("_words", "_fetch", "_search", "_barred", "markdown")


def resume(tasks: DataFrame, items: DataFrame, completed: bool = False) -> DataFrame:
    """Tasks (task_ord, task_id, title) in order with ``state``: cached if an item is kept, else pending.

    An item whose title is another, or one that a completed collection lacks, is a tampered
    collection.
    """
    kept = items.select(F.col("task_id"), F.col("title").alias("_title"), F.lit(True).alias("_kept"))
    rows = tasks.join(kept, "task_id", "left")
    state = F.when(F.col("_kept") & ~F.col("_title").eqNullSafe(F.col("title")), "tampered").when(F.col("_kept"), "cached").otherwise("missing" if completed else "pending")
    return rows.withColumn("state", state).drop("_title", "_kept")


def totals(attempts: DataFrame) -> DataFrame:
    """One row over a collection's attempts (task_id, kind, status): titles with evidence, without, and searches made."""
    tasks = attempts.groupBy("task_id").agg(F.bool_or(F.col("status") == "fetched").alias("got"), F.count_if(F.col("kind") != "provided_source_url").alias("n"))
    return tasks.agg(F.count("*").alias("total_titles"), F.count_if("got").alias("fetched_for_review"), F.count_if(~F.col("got")).alias("fetch_unresolved"), F.coalesce(F.sum("n"), F.lit(0)).alias("search_requests"))


#: What a finished batch of the connected tool says of itself, and what a plan shows of a task.
PROVIDER = "connected_plugin"
PLAN = ["task_id", "title", "ticker", "published_at"]


def batch_problem(manifest: dict, result: dict, items: int) -> str | None:
    """Why a connected batch cannot be evidence, or None."""
    if manifest.get("provider") != PROVIDER or not manifest.get("connected_authorization"):
        return "provenance"
    if not result.get("all_collected") or result.get("fatal_error"):
        return "incomplete"
    return None if items == result.get("total") else "coverage"


def batch_answers(requests: DataFrame, items: DataFrame) -> DataFrame:
    """Requests (task_id, title, query) answered from a batch's items (task_id, title, searches array<struct<query, searched_at, sources>>).

    The first search with the very query counts. An item with another title, or none, fails.
    """
    kept = items.select("task_id", F.col("title").alias("_title"), "searches")
    rows = requests.join(kept, "task_id", "left")
    wrong = F.raise_error(F.lit("batch item disagrees with original title")).cast("string")
    rows = rows.withColumn("title", F.when(F.col("_title").eqNullSafe(F.col("title")), F.col("title")).otherwise(wrong))
    found = F.get(F.filter("searches", lambda s: s["query"] == F.col("query")), F.lit(0))
    out = rows.withColumn("_s", found)
    return out.select("task_id", "title", "query", F.when(F.col("_s").isNull(), "unavailable").otherwise("ok").alias("status"), F.when(F.col("_s").isNull(), "query_not_present_in_live_plugin_batch").alias("reason"), F.col("_s.searched_at").alias("native_searched_at"), F.coalesce(F.size("_s.sources"), F.lit(0)).alias("sources"))


def title_plan(tasks: DataFrame) -> DataFrame:
    """What a tool that collects may see of the tasks, in order: never what was decided about them."""
    return tasks.select("task_ord", *PLAN)


def changed_plan(old: DataFrame, new: DataFrame) -> DataFrame:
    """The rows in which two plans differ; a frozen plan may have none."""
    return old.exceptAll(new).withColumn("side", F.lit("old")).unionAll(new.exceptAll(old).withColumn("side", F.lit("new")))


def unanswered(requested: DataFrame, answered: DataFrame, keys: list[str]) -> DataFrame:
    """What was asked for and has no answer."""
    return requested.join(answered.select(*keys).distinct(), keys, "left_anti")
