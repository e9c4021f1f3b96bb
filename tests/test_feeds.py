"""Remote payloads, public addresses and small text rules on small inputs."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators import collection, reviews
from tidemark.sources import feeds, versions


def _payload(spark, text):
    return spark.createDataFrame([("S", text)], "series_id string, payload string").withColumn("security_id", F.col("series_id"))


def test_macro_payload(spark):
    text = '{"count": 9, "observations": [{"date": "2024/01/02", "value": "1.5", "realtime_start": "2024-01-03", "realtime_end": "2024-02-01"}, {"date": "2024-01-01", "value": "."}, {"date": "2024-01-04", "value": null}]}'
    got = feeds.macro_vintages(_payload(spark, text)).selectExpr("cast(observation_date AS string)", "value", "vintage_id", "unix_seconds(available_at)").collect()
    assert [tuple(r) for r in got] == [("2024-01-02", 1.5, "2024-01-03:2024-02-01", 1704344399)]  # 2024-01-04T04:59:59Z
    receipt = feeds.page_receipt(_payload(spark, text)).first()
    assert (receipt["exhausted"], receipt["record_count"]) == (False, 1)
    undated = '{"observations": [{"date": "2024-01-02", "value": "1"}]}'
    assert feeds.macro_vintages(_payload(spark, undated), bounds=False).first()["available_at"] is None
    assert feeds.page_receipt(_payload(spark, undated)).first()["exhausted"]
    for bad, bounds in ((undated, True), ("{}", False)):
        with pytest.raises(Exception, match="release dates|no observations"):
            feeds.macro_vintages(_payload(spark, bad), bounds=bounds).collect()


def test_headline_payload(spark):
    text = '[{"headline": "A", "datetime": 1704067200, "url": "u"}, {"headline": ""}, {"url": "x"}, {"headline": "B"}]'
    got = feeds.vendor_headlines(_payload(spark, text)).orderBy("pos").selectExpr("title", "unix_seconds(published_at)", "url").collect()
    assert [tuple(r) for r in got] == [("A", 1704067200, "u"), ("B", None, "")]
    with pytest.raises(Exception, match="not a list"):
        feeds.vendor_headlines(_payload(spark, '{"headline": "A"}')).collect()


def test_text_rules(spark):
    urls = {"https://a.com/x": True, "HTTPS://u:p@a.com:8443": True, "http://a.com": False, "https://LOCALHOST/": False, "https://[::1]/": False, "https://uk.finance.yahoo.com/quote/X": False, "https://finance.yahoo.com/news/": True, "https://www.nasdaq.com/market-activity/x": False, "": False, None: False}
    rows = spark.createDataFrame([(u,) for u in urls], "u string").select(S.public_url(F.col("u")))
    assert [r[0] for r in rows.collect()] == list(urls.values())
    names = spark.createDataFrame([(" a/b  c ",), ("x" * 99,), ("",), (None,)], "t string").select(S.safe_component(F.col("t")))
    assert [r[0] for r in names.collect()] == ["a_b_c", "x" * 80, "unknown", "unknown"]
    cells = spark.createDataFrame([("a|b\n<c>",), ("",), (None,)], "t string").select(S.markdown_cell(F.col("t")))
    assert [r[0] for r in cells.collect()] == ["a／b &lt;c&gt;", "—", "—"]
    params = spark.range(1).select(S.redacted(F.create_map(*map(F.lit, ("API_KEY", "x", "q", "y", "set-cookie", "z")))))
    assert params.first()[0] == {"API_KEY": "***", "q": "y", "set-cookie": "***"}


def test_replay_of_nothing(spark):
    requests = spark.createDataFrame([(1, "u"), (None, "u")], "task_id long, url string")
    empty = spark.createDataFrame([], "task_id long, url string, ord long, status string, quote string")
    assert [r["reason"] for r in collection.replay(requests, empty).collect()] == ["archived_fetch_missing"] * 2


def test_review_import(spark, tmp_path):
    sql = """SELECT {0} AS title, array(named_struct('url', 'https://a.b/c', 'published_at', timestamp'2024-01-01', 'evidence_locator', 'p1')) AS sources, 'f' AS fact_summary, 'w' AS grade_reason,
      'full_text' AS evidence_scope, timestamp'{1}' AS reviewed_at, 'bullish' AS grade, 1 AS direction_sign, 'light' AS impact_level, 0.5D AS stock_relevance, 0.5D AS evidence_confidence, timestamp'2024-01-01' AS event_time"""
    store = versions.Store(spark, f"file://{tmp_path}")
    good = spark.sql(sql.format("'a'", "2024-01-02"))
    reviews.import_reviews(store, "news", good, "2024-01-03 00:00:00")
    reviews.import_reviews(store, "news", spark.sql(sql.format("'b'", "2024-01-05")), "2024-01-06 00:00:00")
    assert sorted(r["title"] for r in store.load("news").collect()) == ["a", "b"]
    late = spark.sql(sql.format("'c'", "2023-12-31"))
    for bad in (late, good.unionByName(late), good.limit(0), good.withColumn("direction_sign", F.lit(-1)), good.withColumn("sources", F.slice("sources", 1, 0))):
        with pytest.raises(ValueError):
            reviews.import_reviews(store, "news", bad, "2024-01-07 00:00:00")
    assert store.load("news").count() == 2
