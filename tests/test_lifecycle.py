"""Imports, store, queue, raw payloads, retention, report and commands on small inputs."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tidemark import cli
from tidemark.errors import DataError, SourceNotAllowed
from tidemark.functions import scalars as S
from tidemark.operators import collection, macro, queue, report, retention
from tidemark.sources import imports, raw
from tidemark.sources.versions import Store

MACRO = "series_id string, observation_date string, value string"


def test_read_files(spark, tmp_path):
    rows = [{"series_id": "A", "observation_date": "2024-01-01", "value": "1"}, {"series_id": "B", "observation_date": "2024/01/02", "value": "2"}]
    files = {"a.jsonl": "﻿" + "\n\n".join(map(json.dumps, rows)), "b.json": "﻿" + json.dumps(rows), "c.json": json.dumps({"records": rows}), "d.csv": "series_id,observation_date,value\nA,2024-01-01,1\nB,2024/01/02,2\n"}
    for name, text in files.items():
        (tmp_path / name).write_text(text, encoding="utf-8")
        got = imports.read(spark, f"file://{tmp_path}/{name}", MACRO)
        assert sorted(tuple(r) for r in got.collect()) == [tuple(r.values()) for r in rows], name
    (tmp_path / "e.json").write_text(json.dumps(rows[0]))
    assert imports.read(spark, f"file://{tmp_path}/e.json", MACRO).count() == 1


def test_imports(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}")
    good = spark.createDataFrame([("A", "2024/01/02", "1.5")], MACRO)
    got = imports.import_records(store, "macro", good, "US", "2024-01-03 00:00:00")
    assert (got["rows"], got["columns"]) == (1, ["market", "observation_date", "series_id", "source_id", "value"])
    assert tuple(store.load("macro").first()) == ("A", dt.date(2024, 1, 2), 1.5, "US", "user_import")
    for bad, error in (
        (lambda: imports.prepared("macro", good, "US", "sec"), SourceNotAllowed),
        (lambda: imports.prepared("prices", good, "US"), DataError),
        (lambda: imports.prepared("news", good, "US"), DataError),
        (lambda: imports.import_records(store, "macro", good.limit(0), "US", "2024-01-03 00:00:00"), DataError),
        (lambda: imports.prepared("macro", good.withColumn("value", F.lit("inf")), "US").collect(), Exception),
        (lambda: imports.security_master(spark.createDataFrame([("X", "A"), ("X", "B")], "security_id string, ticker string")), DataError),
    ):
        with pytest.raises(error):
            bad()


def test_store_of_versions_and_runs(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/root")
    a = store.save("news", spark.range(3), "2024-01-01 00:00:00")
    b = store.save("news", spark.range(5), "2024-01-02 00:00:00")
    assert [r["version"] for r in store.versions("news").collect()] == [b, a]
    store.replace_path("news", a, f"file://{tmp_path}/root/elsewhere")
    assert store.entry("news", a)["path"].endswith("elsewhere") and store.entry("news")["version"] == b
    store.replace_path("news", a, f"file://{tmp_path}/outside")
    with pytest.raises(DataError):
        store.load("news", a)
    spark.range(3).write.json(f"file://{tmp_path}/old")
    store.replace_path("news", a, f"file://{tmp_path}/old")
    assert store.convert("news", lambda path: spark.read.schema("id long").json(path)) == [a] and store.load("news", a).count() == 3
    store.register_run("run-1", "p", "{}", "2024-01-01 00:00:00")
    assert store.run("run-1")["path"] == "p" and store.run("run-2") is None


def test_raw_store(spark, tmp_path):
    held = raw.open_store(spark, f"file://{tmp_path}")
    rows = lambda *r: spark.createDataFrame(r, "source_id string, dataset string, payload string, received_at timestamp")
    day = lambda k: dt.datetime(2024, 1, k)
    held.save(rows(("s", "d", "x", day(2)), ("s", "d", "y", day(3))), "2024-01-04 00:00:00")
    held.save(rows(("s", "d", "x", day(1)), ("s", "d", "x", day(9))), "2024-01-10 00:00:00")
    got = {r["raw_path"].rpartition("/")[2][:4]: (r["first_observed_at"].day, r["last_observed_at"].day, r["receipts"]) for r in held.manifests().collect()}
    assert sorted(got.values()) == [(1, 9, 3), (3, 3, 1)] and held.payloads().count() == 2
    path = held.manifests().filter("receipts = 3").first()["raw_path"]
    assert held.read(path) == b"x" and held.payloads().count() == 2
    spark.createDataFrame([("gone", "z", "s", "d", 1, day(1), day(1), 1)], "raw_path string, sha256 string, source_id string, dataset string, byte_count long, first_observed_at timestamp, last_observed_at timestamp, receipts long").createOrReplaceTempView("lost")
    assert raw.verified(held.payloads(), spark.table("lost")).first()["state"] == "missing"


TASKS = "task_id string, title string, source_url string, published_at timestamp, security_ids array<string>, ticker string, market string, status string, reason string, reviewed_at timestamp"
REVIEW = "struct<impact_reason: string, reviewed_at: timestamp, grade: string, direction_sign: int, impact_level: string, event_kind: string, event_time: timestamp, stock_relevance: double, evidence_confidence: double, event_cluster: string>"
ASSESSMENT = f"task_id string, status string, reason string, attempts array<struct<kind: string>>, review {REVIEW}, stock_relevance double"


def test_queue(spark):
    at = dt.datetime(2024, 1, 1)
    tasks = spark.createDataFrame([(k, k.upper(), "u", at, ["S"], "T", "US", "pending", None, None) for k in "abc"], TASKS)
    review = ("large", dt.datetime(2024, 1, 5), "bullish", 1, "major", "opinion", at, 1.0, 1.0, "c")
    batch = lambda *r: spark.createDataFrame(r, ASSESSMENT)
    good = [("a", "verified", "seen", [("article_read",)], review, None), ("b", "unrelated", "other", [("search",)], None, 0.0)]
    done = queue.apply(tasks, batch(*good), "2024-01-06 00:00:00")
    assert {r["task_id"]: r["status"] for r in done.tasks.collect()} == {"a": "verified", "b": "unrelated", "c": "pending"}
    assert done.history.count() == 0 and [r["task_id"] for r in done.retractions.collect()] == ["b"] and done.reviews.first()["event_cluster"] == "c"
    again = queue.apply(done.tasks, batch(("a", "unresolved", "gone", [("search",)], None, None), ("c", "unresolved", "none", [("search",)], None, None)), "2024-01-07 00:00:00")
    assert [(r["task_id"], r["status"]) for r in again.history.collect()] == [("a", "verified")]
    for fault in ((good[0], good[0]), (("z", *good[0][1:]),), (("a", "verified", "seen", [("search",)], review, None),), (("b", "unrelated", "x", [("search",)], None, 0.1),)):
        with pytest.raises(DataError):
            queue.apply(tasks, batch(*fault), "2024-01-06 00:00:00")
    with pytest.raises(Exception, match="pending"):
        queue.finalize(tasks, "2024-01-08 00:00:00").collect()
    assert queue.finalize(again.tasks, "2024-01-08 00:00:00").first()["completed"] == 3
    one, other = (queue.rows_hash(df, "task_id", ["task_id", "status"]).first()[0] for df in (tasks.repartition(3), done.tasks))
    assert one == queue.rows_hash(tasks.coalesce(1), "task_id", ["status", "task_id"]).first()[0] != other


def test_collection_rules(spark):
    good, result = {"provider": collection.PROVIDER, "connected_authorization": True}, {"all_collected": True, "total": 3}
    assert collection.batch_problem(good, result, 3) is None
    assert [collection.batch_problem(*x) for x in (({}, result, 3), (good, {**result, "fatal_error": "x"}, 3), (good, result, 2))] == ["provenance", "incomplete", "coverage"]
    items = spark.createDataFrame([("a", "other", None)], "task_id string, title string, searches array<struct<query: string, searched_at: string, sources: array<string>>>")
    with pytest.raises(Exception, match="disagrees"):
        collection.batch_answers(spark.createDataFrame([("a", "A", "A")], "task_id string, title string, query string"), items).collect()
    done = collection.resume(spark.createDataFrame([(1, "a", "A"), (2, "b", "B")], "task_ord int, task_id string, title string"), items.select("task_id", "title"), completed=True)
    assert [r["state"] for r in done.orderBy("task_ord").collect()] == ["tampered", "missing"]
    with pytest.raises(Exception, match="must be a list"):
        collection.search_results(spark.createDataFrame([('{"results": {}}',)], "payload string")).collect()


def test_retention_keeps_young_groups(spark):
    day = lambda k: dt.datetime(2024, 1, k)
    rows = [("raw", "raw/a.json", day(1), 5), ("raw", "raw/a.json.manifest.json", day(20), 1), ("raw", "raw/b.json", day(1), 7), ("reports", "reports/r.md", day(1), 2), ("reports", "reports/r.json", day(2), 3), ("cache", "cache/x", day(13), 1)]
    files = spark.createDataFrame(rows, "area string, path string, mtime timestamp, bytes long")
    gone = sorted(r["path"] for r in retention.expired_files(files, "2024-01-20 00:00:00").collect())
    assert gone == ["raw/b.json", "reports/r.json", "reports/r.md"]
    assert retention.receipt(files, spark.createDataFrame([], "path string"), "2024-01-20 00:00:00", dry_run=True).first().asDict() == {"expired_files": 3, "expired_bytes": 12, "deleted_files": 0, "freed_bytes": 0, "catalog_entries_removed": 0, "dry_run": True}


def test_macro_map_and_policy():
    assert macro.series_map({"fx_20d": " X "})["fx_20d"] == ["X"]
    for bad in ({"other": "X"}, {"curve_10y_2y": "X"}, {"fx_20d": ""}, {"fx_20d": 3}):
        with pytest.raises((DataError, TypeError)):
            macro.series_map(bad)
    changed = report.impact_policy({"half_life_days": {"rumour": 1}, "neutral_band": 0.3})
    assert changed["half_life_days"]["rumour"] == 1 and report.policy_hash(changed) != report.policy_hash(report.impact_policy())
    for bad in ({"impact_weights": {"huge": 9.0}}, {"half_life_days": {"opinion": 0}}, {"neutral_band": 2}):
        with pytest.raises(ValueError):
            report.impact_policy(bad)


def test_requests():
    assert report.checked_request("US", [" abc ", ""], 1) == ["ABC"]
    for bad in (("UK", ["A"], 1), ("US", [" "], 1), ("US", ["A"], 0)):
        with pytest.raises(DataError):
            report.checked_request(*bad)


def test_numbers_as_reports_print_them(spark):
    df = spark.createDataFrame([(0.0625,), (0.1875,), (-1.0,), (2.0005,)], "x double")
    assert [r[0] for r in df.select(S.fixed(F.col("x"), 3, sign=True)).collect()] == ["+0.062", "+0.188", "-1.000", "+2.000"]


def run(spark, root, *argv, capsys):
    code = cli.main(["--root", root, *argv], spark)
    return code, json.loads(capsys.readouterr().out.strip().splitlines()[-1])


def test_commands_from_import_to_report(spark, tmp_path, capsys):
    root = f"file://{tmp_path}/root"
    impact = {"direction_sign": 1, "impact_level": "major", "event_kind": "earnings", "event_time": "2024-01-02T00:00:00Z", "stock_relevance": 1.0, "evidence_confidence": 0.5}
    news = [
        {"title": "Firm beats", "published_at": "2024-01-02T00:00:00Z", "source_id": "s", "event_id": "e1", "available_at": "2024-01-02T00:00:00Z", "evidence_scope": "full_text", "grade": "bullish", "grade_method": "source_review", "security_ids": '["US:XNAS:ABC"]', "permissions": json.dumps({"impact_assessment": impact}), "body": "It beats."},
        {"title": "A headline", "published_at": "2024-01-03T00:00:00Z", "source_id": "s", "event_id": "e2", "available_at": "2024-01-03T00:00:00Z", "evidence_scope": "title"},
    ]
    (tmp_path / "news.json").write_text(json.dumps(news))
    (tmp_path / "macro.csv").write_text("series_id,observation_date,value,available_at\nDGS10,2024-01-02,4.5,2024-01-02\nDGS2,2024-01-02,4.0,2024-01-02\n")
    go = lambda *argv: run(spark, root, *argv, capsys=capsys)
    assert go("import", "--kind", "news", "--path", f"file://{tmp_path}/news.json")[1]["rows"] == 2
    code, refused = go("import", "--kind", "news", "--path", f"file://{tmp_path}/news.json", "--source", "fred")
    assert (code, refused["error"]) == (2, "SourceNotAllowed")
    (tmp_path / "m.json").write_text(json.dumps([{"series_id": s, "observation_date": "2024-01-02", "value": v, "available_at": "2024-01-02"} for s, v in (("DGS10", "4.5"), ("DGS2", "4"))]))
    assert go("import", "--kind", "macro", "--path", f"file://{tmp_path}/m.json")[0] == 0
    assert go("prepare", "--ticker", "abc")[1]["pending"] == 1
    assert [t["task_id"] for t in go("next")[1]["tasks"]] == ["e2"]
    code, made = go("research", "--ticker", "ABC", "--cutoff", "2024-01-05 00:00:00")
    text = "\n".join(go("reproduce", "--run-id", made["run_id"])[1]["report"])
    assert code == 0 and "10-year less 2-year yield (points): 0.5000" in text and "Firm beats" in text and "Direction bullish" in text and "default identity US:XNAS:ABC" in text
    assert "1 more records" in text and "pending 1" in text
    review = {"title": "A headline", "impact_reason": "large", "reviewed_at": "2024-01-04T00:00:00Z", "grade": "bearish", "grade_reason": "cost", "fact_summary": "facts", "evidence_scope": "full_text", "event_cluster": "c2"}
    review |= {**impact, "direction_sign": -1, "event_time": "2024-01-03T00:00:00Z", "sources": [{"url": "https://a.example/x", "published_at": "2024-01-03T00:00:00Z", "evidence_locator": "p1"}]}
    verified = {"task_id": "e2", "status": "verified", "reason": "read", "attempts": [{"kind": "article_read"}], "review": review}
    (tmp_path / "bad.json").write_text(json.dumps([{**verified, "review": {**review, "sources": []}}]))
    assert go("apply", "--path", f"file://{tmp_path}/bad.json")[1]["detail"] == "review refused: uncited"
    assert go("finalize")[0] == 2
    (tmp_path / "good.json").write_text(json.dumps([verified]))
    assert go("apply", "--path", f"file://{tmp_path}/good.json")[1]["verified"] == 1
    before = go("research", "--ticker", "ABC", "--cutoff", "2024-01-03 12:00:00")[1]
    assert "over 1 events" in "\n".join(go("reproduce", "--run-id", before["run_id"])[1]["report"])
    again = go("research", "--ticker", "ABC")[1]
    text = "\n".join(go("reproduce", "--run-id", again["run_id"])[1]["report"])
    assert "over 2 events" in text and "verified 1" in text
    (tmp_path / "gone.json").write_text(json.dumps([{"task_id": "e2", "status": "unresolved", "reason": "withdrawn", "attempts": [{"kind": "search"}]}]))
    assert go("apply", "--path", f"file://{tmp_path}/gone.json")[1]["unresolved"] == 1
    later = go("research", "--ticker", "ABC")[1]
    assert "over 1 events" in "\n".join(go("reproduce", "--run-id", later["run_id"])[1]["report"])
    assert go("finalize")[0] == 0
    assert set(go("doctor")[1]["datasets"]) >= {"news", "macro", "queue-tasks"}
    assert go("reproduce", "--run-id", "none")[0] == 2
