"""Every registered query against its oracle, and operators on small inputs."""

import datetime as dt
import json
import random

import pytest
from compare import TABLES, differences
from pyspark.sql import functions as F

from tidemark.errors import DataError
from tidemark.functions import scalars as S
from tidemark.operators import dedupe, html, impact, lexicon, workflow
from tidemark.plans import registry
from tidemark.sources.versions import Store, check_required


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf_dir, name):
    df = registry.QUERIES[name](spark, sf_dir)
    if name in registry.ORACLE_SQL:
        assert differences(df, registry.ORACLE_SQL[name], sf_dir) == ([], [])
    else:
        assert df.count() > 0


def _grown(spark, sf_dir, folder, **tables):
    """The tables of sf_dir, with some replaced."""
    for name in TABLES:
        path = folder / f"{name}.parquet"
        tables[name].coalesce(1).write.parquet(f"file://{path}") if name in tables else path.symlink_to(f"{sf_dir}/{name}.parquet")
    return str(folder)


def test_body_hashes_of_control_characters(spark, sf_dir, tmp_path):
    """So many rows that every control character of the query's odd bodies repeats."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("doc_id < 1")
    rows = spark.range(3201).select(F.col("id").alias("doc_id"), F.concat(F.lit("b"), "id").alias("text")).join(documents.drop("doc_id", "text"))
    d = _grown(spark, sf_dir, tmp_path, documents=rows)
    df = registry.QUERIES["body_hash_dups"](spark, d)
    assert df.filter("first % 50 = 1").count() > 20
    assert differences(df, registry.ORACLE_SQL["body_hash_dups"], d) == ([], [])
    # Hashes that are kept have the digits of Python's json.
    df = spark.createDataFrame([("a\x0e\x1b\"",)], "t string")
    assert df.select(S.json_quoted(F.col("t")), S.json_quoted(F.col("t"), upper=True)).first()[:] == (json.dumps("a\x0e\x1b\""), '"a\\u000E\\u001B\\""')


def _greedy(rows):
    owners, out = {}, {}
    for ord_, at, *keys in sorted(rows, key=lambda r: (-r[1], r[0])):
        own = [(i, k) for i, k in enumerate(keys) if k]
        of = next((owners[k] for k in own if k in owners), None)
        out[ord_] = of
        if of is None:
            owners |= dict.fromkeys(own, ord_)
    return out


def test_greedy_dedupe_equals_the_scan(spark):
    rng = random.Random(5)
    rows = [(i, rng.randrange(9), *(rng.choice(["", "a", "b", "c", "d", "e", "f", "g"]) for _ in range(3))) for i in range(60)]
    df = spark.createDataFrame(rows, "row_ord long, at long, x string, y string, z string")
    got = dedupe.greedy_dedupe(df, ["x", "y", "z"], [(-F.col("at")).alias("_at")]).collect()
    assert {r["row_ord"]: r["duplicate_of"] for r in got} == _greedy(rows)


def test_default_lexicon(spark):
    rows = [("Firm beats and raises guidance",), ("a minor slight small launch",), ("fraud lawsuit",), ("",), ("quiet day",)]
    df = spark.createDataFrame(rows, "body string").withColumn("evidence_scope", F.lit("full_text"))
    assert [r["grade"] for r in lexicon.graded(df).collect()] == ["very_bullish", "moderately_bearish", "very_bearish", "insufficient", "neutral"]
    gated = lexicon.graded(df.withColumns({"evidence_scope": F.lit("title"), "grade": F.lit("bullish"), "grade_method": F.lit("source_review")})).first()
    assert (gated["grade"], gated["grade_reason"]) == ("insufficient", "evidence_scope=title")


REVIEW = "row_ord long, task_id string, event_id string, url string, grade string, event_kind string, direction_sign int, impact_level string, evidence_confidence double, stock_relevance double, event_time timestamp, available_at timestamp, event_cluster string"


def review(row_ord, task="", event="", url="", grade="bullish", sign=1, level="medium", conf=0.9, rel=1.0, time=dt.datetime(2024, 1, 3), known=dt.datetime(2024, 1, 3), cluster="c"):
    return (row_ord, task, event, url, grade, "opinion", sign, level, conf, rel, time, known, cluster)


def test_impact_of_a_cluster(spark):
    rows = [review(0, "a"), review(1, "b", conf=0.4, time=dt.datetime(2024, 1, 1))]
    df = spark.createDataFrame(rows, REVIEW)
    got = impact.synthesis(df, "2024-01-03 00:00:00").first()
    assert (got["event_count"], got["deduplicated_reprints"], got["net"], got["direction"]) == (1, 1, 0.9, "bullish")
    none = impact.synthesis(df.limit(0), "2024-01-03 00:00:00").first()
    assert (none["event_count"], none["direction"]) == (0, "no_verified_assessment")


def test_impact_of_what_is_missing(spark):
    """A retraction withdraws, what has no cluster is one of its own, missing shares count whole, keys fall back, what cannot be scored fails."""
    day = lambda k: dt.datetime(2024, 1, k)
    net = lambda *rows: impact.synthesis(spark.createDataFrame(rows, REVIEW), "2024-01-03 00:00:00").first()
    gone = net(review(0, "a", known=day(1)), review(1, "a", grade="insufficient", level=None, sign=None, known=day(2)))
    assert (gone["event_count"], gone["net"]) == (0, 0.0)
    apart = net(review(0, "a", "x", cluster=""), review(1, "b", "y", cluster=None))
    assert (apart["event_count"], apart["deduplicated_reprints"]) == (2, 0)
    assert net(review(0, "a", conf=None, rel=None))["net"] == 2.0
    by_event = net(review(0, None, "x", known=day(1)), review(1, "", "x", sign=-1, grade="bearish", known=day(2), cluster="d"))
    assert (by_event["event_count"], by_event["net"]) == (1, -1.8)
    assert net(review(0, url="u", known=day(2)), review(1, url="u", sign=-1, known=day(2)))["net"] == 1.8
    for bad in (review(0, "a", conf=1.5), review(0, "a", sign=2), review(0, "a", time=day(4))):
        with pytest.raises(Exception, match="cannot be scored"):
            net(bad)


def test_retraction(spark):
    rows = [review(0, "a"), review(1, "a"), review(2, "b", known=dt.datetime(2024, 1, 1)), review(3, "b", grade="insufficient"), review(4, "c")]
    reasons = spark.createDataFrame([("a", "w"), ("b", "w"), ("z", "w")], "task_id string, reason string")
    df = spark.createDataFrame(rows, REVIEW)
    got = workflow.retractions(df, reasons, "2024-01-04 00:00:00").collect()
    assert [(r["task_id"], r["row_ord"], r["grade"], r["grade_reason"], r["impact_level"], r["available_at"]) for r in got] == [("a", 0, "insufficient", "w", None, dt.datetime(2024, 1, 4))]
    assert workflow.retract(df, reasons, "2024-01-04 00:00:00").count() == 6


def test_dedupe_of_a_long_chain(spark):
    """Rows that share a key with the one before and the one after, more than the rounds settle."""
    rows = [(i, -i, f"a{i // 2}", f"b{(i + 1) // 2}", "" if i % 7 else f"c{i % 3}") for i in range(240)]
    df = spark.createDataFrame(rows, "row_ord long, at long, x string, y string, z string")
    got = dedupe.greedy_dedupe(df, ["x", "y", "z"], [(-F.col("at")).alias("_at")], rounds=3).collect()
    assert {r["row_ord"]: r["duplicate_of"] for r in got} == _greedy(rows)


def test_scalars(spark):
    cases = {
        "HTTPS://Ex.com/P?utm_source=x&b=1&a=~*%20z&REF=q#frag": "https://ex.com/P?b=1&a=~%2A+z",
        "http://h/p": "http://h/p",
        "http://h/p?x=&x=2": "http://h/p?x=&x=2",
    }
    df = spark.createDataFrame([(k,) for k in cases], "u string")
    assert [r[0] for r in df.select(S.canonical_url(F.col("u"))).collect()] == list(cases.values())
    times = ["2024-01-02T03:04:05Z", "2024-01-02T03:04:05+01:00", "2024-01-02T03:04:05", "Tue, 2 Jan 2024 03:04:05 +0000", "2024-01-02", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in times], "t string").select(F.unix_seconds(S.publication_time(F.col("t")))).collect()]
    assert got == [1704164645, 1704161045, None, 1704164645, None, None]


def test_html():
    words = "Own words. " * 40
    data = lambda **x: f'<script type="application/ld+json">{json.dumps(x)}</script>'
    story = data(**{"@type": "NewsArticle", "headline": "H", "articleBody": words, "datePublished": "2024-01-02T00:00:00Z"})
    page = lambda head, body: f"<html><head><title>T | Site</title>{head}</head><body>{body}</body></html>"
    assert html.article(page(story, "menu")) == ("T | Site", words, "2024-01-02T00:00:00Z")
    two = page(story + data(headline="Other", articleBody="No."), f"<p>menu</p><div>T</div><p>{words}</p>")
    assert html.article(two)[1] == "T\n" + words.strip() and html.article(two, "h!")[1] == words
    nested = page(data(**{"@graph": [{"x": {"name": "T", "articleBody": words}}, {"articleBody": "other"}]}), "")
    assert html.article(nested)[1] == words
    # A card of another story is marked as article, the story is not.
    card = page("", f"<article>card</article><h1>T</h1><div>{words}</div><nav>no</nav>")
    assert html.article(card)[1].startswith("T\nOwn") and "no" not in html.article(card)[1].split()
    assert html.article(page("", f"<nav>x</nav><article><p>{words}</p></article>"))[1].strip() == words.strip()
    promoted = page("", f"<h1>T</h1>{words}Our analysts just identified a stock\n to buy. Tap here. end")
    assert html.article(promoted)[1].endswith("words.  end")
    assert html.article(page("", f"<h1>T</h1>Access denied {words}"))[1] == "" and html.article(page("", "<h1>T</h1>short"))[1] == ""
    assert html.article(None) == ("", "", "")
    dated = lambda *d: html.article(page("".join(data(**{"@type": ["Article"], "datePublished": x}) for x in d), ""))[2]
    assert dated("2024-01-02") == "2024-01-02" and dated("2024-01-02", "2024-01-03") == ""
    assert html.article('<meta name="PubDate" content="2024-05-06">')[2] == "2024-05-06"


def test_html_references(spark, sf_dir, tmp_path):
    """Titles that are cut within a reference: browsers read it, the query leaves it, as its SQL does."""
    words = "Own words. " * 40
    page = f'<html><head><title>T &amp;&amp</title></head><body><script>a&&b</script><p>R&amp;D &lt;b&gt; &#x27;q&#x27; &quot;</p><p>T &amp;&amp</p><p>{words}</p></body></html>'
    assert html.article(page)[0] == "T &&" and html.article(page, closed=True)[0] == "T &&amp"
    assert html.article(page, closed=True)[1] == f"T &&amp\n{words.strip()}"
    story = f'<script type="application/ld+json">{json.dumps({"headline": "A&amp;B &lt", "articleBody": "x && y &amp; " + words})}</script>'
    assert html.article(story, closed=True) == html.article(story) == ("", "x && y &amp; " + words, "")
    assert html.article("<title>&bogus; &ampx; &notin; &#65; &#x</title>", closed=True)[0] == "&bogus; &ampx; \u2209 A &#x"
    assert html.article('<meta name="pubdate" content="a&amp;b&lt">', closed=True)[2] == "a&b&lt"
    pages = spark.createDataFrame([(1, "u", page), (2, "u", page.replace("&amp</", "&lt</")), (3, "u", page.replace("&amp</", "&am</"))], "page_id long, url string, html string")
    d = _grown(spark, sf_dir, tmp_path, pages=pages)
    assert differences(registry.QUERIES["html_article_text"](spark, d), registry.ORACLE_SQL["html_article_text"], d) == ([], [])


def test_store(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}")
    a = store.save("news", spark.range(3), "2024-01-01 00:00:00")
    b = store.save("news", spark.range(5), "2024-01-02 00:00:00")
    assert a != b and store.load("news").count() == 5 and store.load("news", a).count() == 3
    with pytest.raises(DataError):
        store.load("other")
    with pytest.raises(ValueError):
        store.save("../x", spark.range(1), "2024-01-01 00:00:00")
    with pytest.raises(ValueError):
        check_required("news", spark.range(1))
