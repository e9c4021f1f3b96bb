"""Engine relations made from the test tables by integer rules, so that any engine can repeat them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed points of time of the test runs.
CUTOFF = "2024-02-05 00:00:00"
IMPACT_ASOF = "2024-01-25 00:00:00"
HOUR = 3_600_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _ts(expr: str):
    """A timestamp from an SQL expression in whole hours after 2024-01-01."""
    return F.expr(f"timestamp_micros(1704067200000000 + ({expr}) * {HOUR}L)")


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, pages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages").select("page_id", "url")
    n = "CASE WHEN doc_id % 9 = 0 THEN NULL ELSE"
    rows = docs.select(
        F.col("doc_id").alias("row_ord"),
        F.expr("doc_id % 50").alias("page_id"),
        F.col("text").alias("body"),
        F.substring("text", 1, 60).alias("title"),
        F.expr("CASE WHEN doc_id % 5 = 0 THEN 'HK' ELSE 'US' END").alias("market"),
        F.expr("CASE WHEN doc_id % 11 = 0 THEN cast(array() AS array<string>) ELSE array(concat('T', doc_id % 20)) END").alias("security_ids"),
        _ts("doc_id % 700").alias("published_at"),
        F.when(F.expr("doc_id % 13 <> 0"), _ts("doc_id % 700 + doc_id % 72")).alias("available_at"),
        _ts("doc_id % 700 + 1").alias("received_at"),
        F.concat(F.lit("s"), F.expr("doc_id % 8")).alias("source_id"),
        F.expr("element_at(array('title', 'abstract', 'official_excerpt', 'source_excerpt', 'full_text', 'numeric', 'none'), cast(doc_id % 7 AS int) + 1)").alias("evidence_scope"),
        F.expr("CASE WHEN doc_id % 3 = 0 THEN '' ELSE concat('c', (doc_id * 7) % 900) END").alias("event_cluster"),
        F.expr(f"{n} concat('w', doc_id % 40) END").alias("workflow_task_id"),
    )
    return rows.join(pages, "page_id", "left").withColumn("url", F.coalesce("url", F.lit(""))).drop("page_id")


KIND = "CASE event_type WHEN 'purchase' THEN 'earnings' WHEN 'view' THEN 'price_move' WHEN 'click' THEN 'opinion' WHEN 'error' THEN 'regulation' ELSE 'partnership' END"


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews with retracted ones, missing tasks, clusters, ids and shares, equal times, and some that cannot be scored."""
    micros = "unix_micros(cast(ts AS timestamp))"
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("row_ord"),
        F.expr("CASE WHEN event_id % 29 = 0 THEN '' WHEN event_id % 31 > 0 THEN concat(user_id, '-', event_id % 40) END").alias("task_id"),
        F.expr("CASE WHEN event_id % 5 = 0 THEN '' ELSE concat('e', event_id) END").alias("event_id"),
        F.expr("concat('https://e.example/', event_id % 700)").alias("url"),
        F.expr(KIND).alias("event_kind"),
        F.expr("cast(event_id % 3 - 1 AS int)").alias("direction_sign"),
        F.expr("CASE WHEN event_id % 53 = 0 THEN NULL WHEN value < 10 THEN 'light' WHEN value < 40 THEN 'medium' ELSE 'major' END").alias("impact_level"),
        F.expr("CASE WHEN event_id % 17 = 3 THEN 'insufficient' ELSE element_at(array('bearish', 'neutral', 'bullish'), cast(event_id % 3 AS int) + 1) END").alias("grade"),
        F.expr("CASE WHEN event_id % 37 > 0 THEN cast(get_json_object(props, '$.k') AS double) / 100 END").alias("evidence_confidence"),
        F.expr("CASE WHEN event_id % 41 > 0 THEN (100 - (event_id % 7) * 10) / 100D END").alias("stock_relevance"),
        F.expr("cast(ts AS timestamp)").alias("event_time"),
        F.expr(f"timestamp_micros({micros} - {micros} % {HOUR}L + (1 + event_id % 48) * {HOUR}L)").alias("available_at"),
        F.expr(f"CASE WHEN event_id % 19 = 0 THEN '' WHEN event_id % 23 > 0 THEN concat(user_id, ':', {micros} div 86400000000L) END").alias("event_cluster"),
    )


def macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    micros = "unix_micros(cast(ts AS timestamp))"
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("row_ord"),
        F.col("event_type").alias("series_id"),
        F.expr("cast(ts AS date)").alias("observation_date"),
        "value",
        F.expr(f"timestamp_micros({micros} + (event_id % 96) * {HOUR}L)").alias("available_at"),
    )


def yearly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A monthly series by order priority over some years, in whole cents."""
    orders = table(spark, sf_dir, "orders")
    return orders.groupBy(F.col("o_orderpriority").alias("series_id"), F.expr("cast(trunc(o_orderdate, 'MM') AS date)").alias("observation_date")).agg((F.sum(F.expr("cast(round(o_totalprice * 100) AS bigint)")) / F.count("*") / 100).alias("value"))


def securities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.expr("concat('SEC', c_custkey)").alias("security_id"),
        F.expr("concat('K', c_custkey % 97)").alias("ticker"),
        F.expr("CASE WHEN c_nationkey % 2 = 0 THEN 'US' ELSE 'HK' END").alias("market"),
        F.expr("date_add(date'2020-01-01', cast(c_custkey % 1500 AS int))").alias("valid_from"),
        F.expr("CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE date_add(date'2020-01-01', cast(c_custkey % 1500 + c_custkey % 400 AS int)) END").alias("valid_to"),
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    days = nation.select("n_nationkey", F.explode(F.sequence(F.lit(0), F.lit(40))).alias("k"))
    return days.select(
        F.expr("n_nationkey * 100 + k").cast("bigint").alias("request_id"),
        F.expr("concat('K', (n_nationkey * 41 + k) % 110)").alias("ticker"),
        F.expr("CASE WHEN n_nationkey % 2 = 0 THEN 'US' ELSE 'HK' END").alias("market"),
        F.expr("date_add(date'2020-06-01', cast(k * 30 AS int))").alias("day"),
    )


def task_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("task_id"),
        F.col("turn").alias("state_ord"),
        F.expr("element_at(array('pending', 'unresolved', 'unrelated', 'verified'), cast((conv_id + turn) % 4 AS int) + 1)").alias("status"),
        _ts("(conv_id * 3) % 600 + (turn div 2) * 24").alias("reviewed_at"),
        F.substring("text", 1, 40).alias("reason"),
    )


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("task_id")).agg(F.count("*").alias("n_states")).withColumn("published_at", _ts("(task_id * 5) % 900"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("group_key"), F.col("l_shipdate").cast("timestamp").alias("mtime"), F.col("l_quantity").cast("bigint").alias("bytes"), F.col("l_linenumber").alias("part"))
