"""Commands over a store: ``python -m tidemark.cli --root ROOT COMMAND``. Each prints one JSON object."""

from __future__ import annotations

import argparse
import datetime as dt
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import TidemarkError
from .operators import impact, queue, report, reviews, workflow
from .sources import imports, versions

#: Columns that an import file may have, by kind.
SCHEMAS = {
    "news": "title string, published_at string, source_id string, event_id string, market string, security_ids string, available_at string, received_at string, source_kind string, evidence_scope string, url string, body string, evidence_locator string, event_cluster string, grade string, grade_method string, grade_reason string, grade_version string, fact_summary string, permissions string",
    "macro": "series_id string, observation_date string, value string, unit string, market string, available_at string, vintage_id string, source_id string, quality string",
    "securities": "ticker string, market string, valid_from string, security_id string, exchange string, security_type string, currency string, valid_to string, name string, industry string, source_id string",
}
#: An assessment in a batch: its review as an import of reviews needs it.
ASSESSMENT = """task_id string, status string, reason string, attempts array<struct<kind: string>>, stock_relevance double, review struct<title: string, impact_reason: string, reviewed_at: timestamp,
  grade: string, grade_reason: string, fact_summary: string, evidence_scope: string, sources: array<struct<url: string, published_at: timestamp, evidence_locator: string>>, direction_sign: int,
  impact_level: string, event_kind: string, event_time: timestamp, stock_relevance: double, evidence_confidence: double, event_cluster: string>"""
IMPACT = ["direction_sign", "impact_level", "event_kind", "event_time", "stock_relevance", "evidence_confidence"]
TASKS, HISTORY, COMPLETIONS = "queue-tasks", "queue-history", "queue-completions"


def _now() -> str:
    return dt.datetime.now(dt.UTC).strftime("%Y-%m-%d %H:%M:%S.%f")


def _known(store: versions.Store, name: str) -> bool:
    return store.catalog().filter(F.col("name") == name).limit(1).count() > 0


def _rows(store: versions.Store, name: str, typed, schema: str) -> DataFrame:
    return typed(store.load(name)) if _known(store, name) else typed(store.spark.createDataFrame([], schema))


def _numbered(df: DataFrame) -> DataFrame:
    return df.withColumn("row_ord", F.monotonically_increasing_id())


def import_file(store: versions.Store, args) -> dict:
    df = imports.read(store.spark, args.path, SCHEMAS[args.kind])
    return imports.import_records(store, args.kind, df, args.market, _now(), args.source)


def prepare(store: versions.Store, args) -> dict:
    news = _numbered(_rows(store, "news", imports.news_rows, SCHEMAS["news"]))
    master = _rows(store, "securities", imports.security_rows, SCHEMAS["securities"])
    wanted = store.spark.createDataFrame([(t.upper(), args.market) for t in args.ticker], "ticker string, market string")
    tasks = queue.prepare(news, master, wanted, _now()).withColumns({"reason": F.lit(None).cast("string"), "reviewed_at": F.lit(None).cast("timestamp")})
    if _known(store, TASKS):
        old = store.load(TASKS)
        if not (old.select("task_id").exceptAll(tasks.select("task_id")).isEmpty() and tasks.select("task_id").exceptAll(old.select("task_id")).isEmpty()):
            raise versions.DataError("workflow source headlines changed; use a new root")
    else:
        store.save(TASKS, tasks, _now())
    return status(store, args)


def status(store: versions.Store, args) -> dict:
    return queue.status(store.load(TASKS)).first().asDict()


def next_tasks(store: versions.Store, args) -> dict:
    rows = queue.next_tasks(store.load(TASKS), [F.desc("published_at"), F.asc("row_ord")], args.limit).select("task_id", "title", "source_url", "search_query")
    return {"tasks": [r.asDict() for r in rows.collect()]}


def _records(reviewed: DataFrame) -> DataFrame:
    """Events of reviews as news records: times as text, the assessment among the permissions."""
    events = reviews.to_events(reviewed)
    permissions = F.to_json(F.struct(F.struct(*IMPACT).alias("impact_assessment"), "workflow_task_id", F.col("sources").alias("review_sources"), "impact_reason"))
    text = {c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'") for c in ("published_at", "available_at", "received_at")}
    return events.withColumns({**text, "security_ids": F.to_json("security_ids"), "permissions": permissions, "source_kind": F.lit("licensed")})


def apply(store: versions.Store, args) -> dict:
    """A batch of assessments: all of it or nothing. Reviews become events, what is withdrawn is retracted, tasks and history move on."""
    batch, now = imports.read(store.spark, args.path, ASSESSMENT), _now()
    done = queue.apply(store.load(TASKS), batch, now)
    refused = done.reviews.select(reviews.problem().alias("why")).filter("why IS NOT NULL").first()
    if refused:
        raise versions.DataError(f"review refused: {refused['why']}")
    known = [f.strip().split()[0] for f in SCHEMAS["news"].split(",")]
    rows = imports.news_rows(store.load("news")) if _known(store, "news") else None
    added = _records(done.reviews)
    added = added.select(*[c for c in known if c in added.columns])
    if rows is not None:
        told = _numbered(rows).withColumnRenamed("workflow_task_id", "task_id")
        gone = workflow.retractions(told, done.retractions, now).drop("row_ord", "review_status", "task_id")
        gone = gone.withColumns({"security_ids": F.to_json("security_ids"), "permissions": F.to_json(F.struct(F.get_json_object("permissions", "$.workflow_task_id").alias("workflow_task_id")))})
        added = added.unionByName(_as_text(gone), allowMissingColumns=True)
    old = store.load("news") if rows is not None else None
    news = added if old is None else _as_text(old).unionByName(_as_text(added), allowMissingColumns=True)
    if not added.isEmpty():
        store.save("news", _as_text(news), now)
    before = store.load(HISTORY) if _known(store, HISTORY) else None
    store.save(HISTORY, done.history if before is None else before.unionByName(done.history, allowMissingColumns=True), now)
    store.save(TASKS, done.tasks, now)
    return status(store, args)


def _as_text(df: DataFrame) -> DataFrame:
    """Records as an import has them: all columns text, times with their zone."""
    return df.select(*[F.date_format(f.name, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias(f.name) if f.dataType.typeName() == "timestamp" else F.col(f.name).cast("string").alias(f.name) for f in df.schema])


def finalize(store: versions.Store, args) -> dict:
    if not status(store, args)["all_processed"]:
        raise versions.DataError("cannot finalize while headline tasks remain pending")
    done = queue.finalize(store.load(TASKS), _now())
    row = done.first().asDict()
    store.save(COMPLETIONS, done, _now())
    return {k: str(v) for k, v in row.items()}


def research(store: versions.Store, args) -> dict:
    """A report from the newest news, macro and securities; reviews are the news that carry an assessment."""
    spark, cutoff = store.spark, args.cutoff or _now()
    news = _numbered(_rows(store, "news", imports.news_rows, SCHEMAS["news"]))
    part = lambda name, kind: F.get_json_object("permissions", f"$.impact_assessment.{name}").try_cast(kind).alias(name)
    assessed = news.withColumnRenamed("workflow_task_id", "task_id").select("*", part("direction_sign", "int"), part("impact_level", "string"), part("event_kind", "string"), part("stock_relevance", "double"), part("evidence_confidence", "double"), part("event_time", "timestamp"))
    macro = _numbered(_rows(store, "macro", imports.macro_rows, SCHEMAS["macro"]))
    master = _rows(store, "securities", imports.security_rows, SCHEMAS["securities"])
    tasks = store.load(TASKS) if _known(store, TASKS) else spark.createDataFrame([], "task_id string, published_at timestamp")
    states = queue.states(tasks, store.load(HISTORY)) if _known(store, HISTORY) else spark.createDataFrame([], "task_id string, status string, reason string, reviewed_at timestamp, state_ord int")
    parts = report.research(news, assessed, macro, tasks, states, master, args.market, args.ticker, cutoff, args.lookback)
    run_id = "run-" + "".join(c for c in _now() if c.isdigit())
    report.publish(store, run_id, parts, {"tickers": args.ticker, "market": args.market, "cutoff": cutoff, "policy_sha256": report.policy_hash(report.impact_policy())}, _now())
    return {"run_id": run_id, "lines": len(report.reproduce(store, run_id))}


def reproduce(store: versions.Store, args) -> dict:
    return {"run_id": args.run_id, "report": report.reproduce(store, args.run_id)}


def doctor(store: versions.Store, args) -> dict:
    rows = versions.latest_versions(store.catalog()).orderBy("name").collect()
    return {"datasets": {r["name"]: {"version": r["version"], "rows": r["rows"]} for r in rows}, "sources": sorted(versions.SOURCES), "half_lives": impact.HALF_LIVES}


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="tidemark", description=__doc__)
    out.add_argument("--root", required=True, help="a folder that Spark can write to")
    commands = out.add_subparsers(dest="command", required=True)

    def command(f, name: str, **options) -> argparse.ArgumentParser:
        sub = commands.add_parser(name, help=f.__doc__)
        sub.set_defaults(run=f)
        for option, settings in options.items():
            sub.add_argument(f"--{option.replace('_', '-')}", **settings)
        return sub

    market = {"choices": imports.MARKETS, "default": "US"}
    tickers = {"nargs": "+", "required": True}
    command(import_file, "import", kind={"choices": sorted(SCHEMAS), "required": True}, path={"required": True}, market=market, source={"default": "user_import"})
    command(prepare, "prepare", ticker=tickers, market=market)
    command(status, "status")
    command(next_tasks, "next", limit={"type": int, "default": 8})
    command(apply, "apply", path={"required": True})
    command(finalize, "finalize")
    command(research, "research", ticker=tickers, market=market, cutoff={}, lookback={"type": int, "default": 30})
    command(reproduce, "reproduce", run_id={"required": True})
    command(doctor, "doctor")
    return out


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    store = versions.Store(spark or SparkSession.builder.appName("tidemark").getOrCreate(), args.root)
    try:
        result, code = args.run(store, args), 0
    except TidemarkError as e:
        result, code = {"error": type(e).__name__, "detail": str(e)}, 2
    print(json.dumps(result, ensure_ascii=False, sort_keys=True, default=str))
    return code


if __name__ == "__main__":
    sys.exit(main())
