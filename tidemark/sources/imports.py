"""Authorised imports: reading, the policy's gate, required columns, defaults, and typed rows.

Records come as text columns, or typed where the file says so. A row that cannot be typed is
left out of news and macro rows, as one bad record of a feed must not stop the others; a
securities table is taken whole or not at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from ..errors import DataError, SourceNotAllowed
from ..functions import scalars as S
from . import versions

#: Markets, kinds of source, evidence scopes and grades that a typed row may have.
MARKETS = ["US", "HK"]
SOURCE_KINDS = ["official", "licensed", "vendor", "unknown", "user_import"]
SCOPES = ["title", "abstract", "official_excerpt", "source_excerpt", "full_text", "numeric", "none"]
GRADES = ["very_bullish", "bullish", "moderately_bullish", "neutral", "moderately_bearish", "bearish", "very_bearish", "insufficient"]


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of a file: JSON lines, JSON (a list, an object, or an object with ``records``), else CSV with a header. A byte order mark is ignored."""
    if path.endswith(".jsonl"):
        lines = spark.read.text(path).select(F.regexp_replace("value", "^﻿", "").alias("value")).filter(F.trim("value") != "")
        return lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")
    if path.endswith(".json"):
        whole = spark.read.text(path, wholetext=True).select(S.stripped(F.regexp_replace("value", "^\ufeff", "")).alias("value"))
        strict, one = {"mode": "FAILFAST"}, StructType.fromDDL(schema)
        packed = F.get_json_object("value", "$.records")
        many = F.when(F.col("value").startswith("["), F.col("value")).otherwise(packed)
        rows = F.when(many.isNotNull(), F.from_json(many, ArrayType(one), strict)).otherwise(F.array(F.from_json("value", one, strict)))
        return whole.select(F.explode(rows).alias("r")).select("r.*")
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)


def prepared(kind: str, df: DataFrame, market: str, source_id: str = "user_import") -> DataFrame:
    """Records that may be stored: the policy admits them, all required columns are there, defaults filled, dates and values normal."""
    if kind not in versions.REQUIRED:
        raise DataError(f"unknown kind of import: {kind}")
    if not versions.source_allowed(source_id, market, kind):
        raise SourceNotAllowed(f"source {source_id} is not allowed for {market}/{kind}")
    versions.check_required(kind, df)
    for name, value in (("market", market), ("source_id", source_id)):
        df = df.withColumn(name, F.coalesce(F.col(name), F.lit(value)) if name in df.columns else F.lit(value))
    fail = lambda what, c: F.raise_error(F.concat(F.lit(f"{what}: "), F.coalesce(F.col(c).cast("string"), F.lit("null"))))
    if kind == "macro":
        day, value = S.parse_day(F.col("observation_date").cast("string")), F.col("value").try_cast("double")
        finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))
        return df.withColumns({"observation_date": F.coalesce(day, fail("not a date", "observation_date").cast("date")), "value": F.when(finite, value).otherwise(fail("macro values must be finite", "value").cast("double"))})
    if kind == "news":
        given = F.coalesce(F.col("published_at").cast("string"), F.lit("")) != ""
        at = S.parse_time(F.col("published_at").cast("string"))
        return df.withColumn("published_at", F.when(given, F.coalesce(at, fail("not a time", "published_at").cast("timestamp"))))
    return df


def import_records(store: versions.Store, kind: str, df: DataFrame, market: str, created_at: str, source_id: str = "user_import") -> dict:
    """Stores the records as a new version: its name, number of rows and columns."""
    rows = prepared(kind, df, market, source_id)
    if rows.isEmpty():
        raise DataError("import file is empty")
    version = store.save(kind, rows, created_at)
    return {"dataset": kind, "version": version, "rows": store.entry(kind, version)["rows"], "columns": sorted(rows.columns)}


def jsonish(value: Column, kind: str) -> Column:
    """A nested value that some feeds send as text, JSON or with single quotes; null if it is neither."""
    return F.from_json(F.trim(value), kind, {"allowSingleQuotes": "true"})


def _text(df: DataFrame, name: str, default: str | None = "") -> Column:
    if name not in df.columns:
        return F.lit(default).cast("string")
    return F.coalesce(F.nullif(F.col(name).cast("string"), F.lit("")), F.lit(default).cast("string"))


def _time(df: DataFrame, name: str) -> tuple[Column, Column]:
    """(time, whether there was a text that is none)."""
    text = _text(df, name, None)
    at = S.parse_time(text)
    return at, text.isNotNull() & at.isNull()


def security_ids(df: DataFrame) -> Column:
    """A list of ids, from a list, a text that holds one, or a JSON text of one id."""
    if "security_ids" not in df.columns:
        return F.array().cast("array<string>")
    if not df.schema["security_ids"].dataType.simpleString() == "string":
        return F.coalesce("security_ids", F.array().cast("array<string>"))
    text = F.trim(F.coalesce("security_ids", F.lit("")))
    one = F.when(text.rlike('^".*"$'), F.array(F.from_json(F.concat(F.lit('{"v":'), text, F.lit("}")), "v string")["v"]))
    return F.coalesce(F.when(text.startswith("["), jsonish(text, "array<string>")), one, F.array().cast("array<string>"))


def news_rows(df: DataFrame) -> DataFrame:
    """Typed events; rows with an unknown market, kind, scope or grade, or a time that is none, are left out."""
    times = {c: _time(df, c) for c in ("published_at", "available_at", "received_at")}
    plain = {c: _text(df, c) for c in ("event_id", "title", "source_id", "url", "body", "evidence_locator", "event_cluster", "grade_reason", "grade_version", "fact_summary")}
    coded = {"market": ("US", MARKETS), "source_kind": ("unknown", SOURCE_KINDS), "evidence_scope": ("none", SCOPES), "grade": ("insufficient", GRADES)}
    codes = {c: _text(df, c, default) for c, (default, _) in coded.items()}
    bad = F.lit(False)
    for c, (_, values) in coded.items():
        bad = bad | ~codes[c].isin(values)
    for _, wrong in times.values():
        bad = bad | wrong
    permissions = _text(df, "permissions", "{}")
    columns = {"security_ids": security_ids(df), "grade_method": _text(df, "grade_method", "insufficient_evidence"), "permissions": F.when(F.try_parse_json(permissions).isNotNull(), permissions).otherwise("{}"), "workflow_task_id": F.get_json_object(permissions, "$.workflow_task_id")}
    every = codes | plain | {c: at for c, (at, _) in times.items()} | columns
    return df.filter(~bad).select(*[F.col(c) for c in df.columns if c == "row_ord"], *[v.alias(c) for c, v in every.items()])


def macro_rows(df: DataFrame) -> DataFrame:
    """Typed observations; rows without a date or a number, with an unknown market or a time that is none, are left out."""
    day, value, market = S.parse_day(_text(df, "observation_date", None)), _text(df, "value", None).try_cast("double"), _text(df, "market", None)
    at, wrong = _time(df, "available_at")
    fine = day.isNotNull() & value.isNotNull() & F.coalesce(market.isin(MARKETS), F.lit(True)) & ~wrong & F.col("series_id").isNotNull()
    named = {"series_id": F.col("series_id").cast("string"), "observation_date": day, "value": value, "unit": _text(df, "unit"), "market": market, "available_at": at, "vintage_id": _text(df, "vintage_id"), "source_id": _text(df, "source_id"), "quality": _text(df, "quality", "ok")}
    return df.filter(fine).select(*[F.col(c) for c in df.columns if c == "row_ord"], *[v.alias(c) for c, v in named.items()])


def security_rows(df: DataFrame) -> DataFrame:
    """Typed securities; rows without a ticker are left out, a missing id is made of market, exchange and ticker."""
    market, exchange, ticker = _text(df, "market", "US"), _text(df, "exchange"), _text(df, "ticker", None)
    named = {"security_id": F.coalesce(_text(df, "security_id", None), S.security_id(market, exchange, F.trim(ticker))), "ticker": ticker, "market": market, "exchange": exchange}
    named |= {"security_type": _text(df, "security_type", "common_stock"), "currency": _text(df, "currency"), "valid_from": S.parse_day(_text(df, "valid_from", "1900-01-01")), "valid_to": S.parse_day(_text(df, "valid_to", None)), "name": _text(df, "name"), "industry": _text(df, "industry"), "source_id": _text(df, "source_id")}
    return df.filter(ticker.isNotNull()).select(*[v.alias(c) for c, v in named.items()])


def repeated_securities(rows: DataFrame) -> DataFrame:
    """(security_id, n) of ids that stand more than once: an error for a master table."""
    return rows.groupBy("security_id").agg(F.count("*").alias("n")).filter("n > 1")


def security_master(df: DataFrame) -> DataFrame:
    """The typed securities, if no id repeats."""
    rows = security_rows(df)
    twice = repeated_securities(rows).orderBy("security_id").first()
    if twice:
        raise DataError(f"duplicate security_id {twice['security_id']}")
    return rows
