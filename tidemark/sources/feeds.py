"""Payloads of remote sources as relations. A payload of the wrong shape fails the read; single rows without a value are left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S

HEADLINES = "array<struct<headline: string, url: string, datetime: double>>"
OBSERVATIONS = "struct<count: bigint, observations: array<struct<date: string, value: string, realtime_start: string, realtime_end: string>>>"


def vendor_headlines(payloads: DataFrame, payload: str = "payload", security: str = "security_id", market: str = "US", source_id: str = "finnhub") -> DataFrame:
    """One event for each entry of a vendor's JSON list that has a headline; known when it was published, evidence a title alone."""
    listed = F.when(F.ltrim(payload).startswith("["), F.from_json(payload, HEADLINES, {"mode": "FAILFAST"})).otherwise(F.raise_error(F.lit("headline payload is not a list")).cast(HEADLINES))
    rows = payloads.select(F.col(security).alias("security_id"), F.posexplode(listed).alias("pos", "h")).filter("h.headline <> ''")
    published = F.timestamp_seconds("h.datetime")
    return rows.select(
        F.lit(market).alias("market"),
        F.array("security_id").alias("security_ids"),
        "pos",
        F.col("h.headline").alias("title"),
        published.alias("published_at"),
        published.alias("available_at"),
        F.lit(source_id).alias("source_id"),
        F.lit("vendor").alias("source_kind"),
        F.lit("title").alias("evidence_scope"),
        F.coalesce("h.url", F.lit("")).alias("url"),
        F.lit("").alias("body"),
        F.lit("headline").alias("evidence_locator"),
    )


def _observations(payload: str) -> Column:
    parsed = F.from_json(payload, OBSERVATIONS, {"mode": "FAILFAST"})
    return F.when(parsed["observations"].isNotNull(), parsed).otherwise(F.raise_error(F.lit("macro payload has no observations list")).cast(OBSERVATIONS))


def macro_vintages(payloads: DataFrame, payload: str = "payload", series: str = "series_id", market: str = "US", source_id: str = "fred", bounds: bool = True) -> DataFrame:
    """Observations with a numeric value.

    With ``bounds`` each row needs its release dates: it is known from the end of the release
    day in New York. Without them it is never known as of a time.
    """
    rows = payloads.select(F.col(series).alias("series_id"), F.explode(_observations(payload)["observations"]).alias("o"))
    rows = rows.withColumn("value", F.col("o.value").try_cast("double")).filter("value IS NOT NULL")
    if bounds:
        known = (F.coalesce("o.realtime_start", F.lit("")) != "") & (F.coalesce("o.realtime_end", F.lit("")) != "")
        start = F.when(known, F.col("o.realtime_start")).otherwise(F.raise_error(F.lit("revision history requires release dates")).cast("string"))
        available, vintage, quality = S.release_available(S.parse_day(start)), F.concat_ws(":", start, "o.realtime_end"), "alfred_vintage_date_conservative"
    else:
        available, vintage, quality = F.lit(None).cast("timestamp"), F.lit(""), "availability_unknown"
    return rows.select("series_id", S.parse_day(F.col("o.date")).alias("observation_date"), "value", F.lit("").alias("unit"), F.lit(market).alias("market"), available.alias("available_at"), vintage.alias("vintage_id"), F.lit(source_id).alias("source_id"), F.lit(quality).alias("quality"))


def page_receipt(payloads: DataFrame, payload: str = "payload", series: str = "series_id", offset: str | None = None) -> DataFrame:
    """Of each page: whether the series ends with it, its numeric rows and the days that they cover. No shuffle."""
    page = payloads.select(F.col(series).alias("series_id"), (F.col(offset) if offset else F.lit(0)).cast("long").alias("offset"), _observations(payload).alias("p"))
    raw = F.size("p.observations").cast("long")
    days = F.transform(F.filter("p.observations", lambda o: o["value"].try_cast("double").isNotNull()), lambda o: S.parse_day(o["date"]))
    ended = F.col("offset") + raw >= F.coalesce("p.count", raw)
    return page.select("series_id", ended.alias("exhausted"), (~ended).alias("cap_reached"), F.size(days).cast("long").alias("record_count"), F.array_min(days).alias("coverage_start"), F.array_max(days).alias("coverage_end"))
