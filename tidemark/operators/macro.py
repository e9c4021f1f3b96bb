"""Readings from vintage-aware series: what was known, or why nothing is."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import DataError
from .asof import latest, latest_vintages

#: The series of each reading.
SERIES = {"curve_10y_2y": ["DGS10", "DGS2"], "cpi_yoy": ["CPIAUCSL"], "fx_20d": ["FX"], "policy_change_20d": ["RATE"]}


def lag_reading(series: DataFrame, lag: int = 20, log: bool = False) -> DataFrame:
    """Each series' last value against the one ``lag`` rows before, with the dates of both, or the reason if there is none."""
    w = Window.partitionBy("series_id").orderBy("observation_date")
    rows = series.withColumns({"past": F.lag("value", lag).over(w), "prior": F.lag("observation_date", lag).over(w), "n": F.count("*").over(Window.partitionBy("series_id"))})
    last = latest(rows, ["series_id"], [F.desc("observation_date")])
    short = F.col("n") < lag + 1
    bad = (F.col("value") <= 0) | (F.col("past") <= 0) if log else F.lit(False)
    value = F.log(F.col("value") / F.col("past")) if log else F.col("value") - F.col("past")
    reason = F.when(short, "window_insufficient").when(bad, "nonpositive_base").otherwise("ok")
    return last.select("series_id", F.when(~short & ~bad, value).alias("change"), reason.alias("reason"), F.col("observation_date").alias("latest"), "prior")


def year_over_year(series: DataFrame, least: int = 13) -> DataFrame:
    """Each series' last value against the row nearest to 365 days earlier, in percent; of equal gaps the earliest."""
    of = Window.partitionBy("series_id")
    rows = series.withColumns({"n": F.count("*").over(of), "last_date": F.max("observation_date").over(of)})
    last = rows.filter("observation_date = last_date").select("series_id", "n", F.col("value").alias("now"), F.col("last_date").alias("latest"))
    gap = F.abs(F.datediff("last_date", "observation_date") - 365)
    near = latest(rows.filter("observation_date < last_date"), ["series_id"], [gap.asc(), F.asc("observation_date")]).select("series_id", F.col("value").alias("past"), F.col("observation_date").alias("prior"))
    out = last.join(near, "series_id", "left")
    short, bad = F.col("n") < least, ~F.coalesce(F.col("past") > 0, F.lit(False))
    reason = F.when(short, "window_insufficient").when(bad, "nonpositive_base").otherwise("ok")
    return out.select("series_id", F.when(~short & ~bad, (F.col("now") / F.col("past") - 1) * 100).alias("yoy"), reason.alias("reason"), "latest", "prior")


def spread(series: DataFrame, long: str, short: str) -> DataFrame:
    """The last value of one series less that of another, each at its own last date; one row if both exist."""
    last = lambda s, n: series.filter(F.col("series_id") == s).agg(F.max_by("value", "observation_date").alias(n)).filter(F.col(n).isNotNull())
    return last(long, "a").join(last(short, "b")).select(F.round(F.col("a") - F.col("b"), 6).alias("spread"))


def series_map(changes: dict[str, str | list[str]] | None = None) -> dict[str, list[str]]:
    """The series of each reading with a policy's changes; an unknown reading, a wrong number or an empty name is an error."""
    out = {k: list(v) for k, v in SERIES.items()}
    for name, value in (changes or {}).items():
        names = [value] if isinstance(value, str) else list(value)
        if name not in out or len(names) != len(out[name]) or any(not isinstance(v, str) or not v.strip() for v in names):
            raise DataError(f"macro series map: {name}")
        out[name] = [v.strip() for v in names]
    return out


def for_market(observations: DataFrame, market: str) -> DataFrame:
    """Observations of a market, and those of none in particular."""
    return observations.filter(F.col("market").isNull() | (F.col("market") == market))


def background(observations: DataFrame, cutoff: str | None, changes: dict | None = None) -> DataFrame:
    """(ord, name, series, status, value, reason, latest, prior): the four readings as of the cutoff, or over all vintages without one."""
    spark, names = observations.sparkSession, series_map(changes)
    wanted = [s for v in names.values() for s in v]
    rows = latest_vintages(observations.filter(F.col("series_id").isin(wanted)), cutoff)
    one = rows.filter(F.col("series_id") == names["cpi_yoy"][0])
    of = lambda k: rows.filter(F.col("series_id") == names[k][0])
    last = lambda k, n: rows.filter(F.col("series_id") == names["curve_10y_2y"][k]).agg(F.max_by("value", "observation_date").alias(f"{n}v"), F.max("observation_date").alias(f"{n}d"))
    both = F.col("av").isNotNull() & F.col("bv").isNotNull()
    curve = last(0, "a").join(last(1, "b")).select(F.lit("curve_10y_2y").alias("name"), F.when(both, F.col("av") - F.col("bv")).alias("value"), F.when(both, "ok").otherwise("no_data").alias("reason"), F.when(both, F.greatest("ad", "bd")).alias("latest"), F.lit(None).cast("date").alias("prior"))
    named = lambda df, name, value: df.select(F.lit(name).alias("name"), F.col(value).alias("value"), "reason", "latest", "prior")
    found = curve.unionAll(named(year_over_year(one), "cpi_yoy", "yoy")).unionAll(named(lag_reading(of("fx_20d"), log=True), "fx_20d", "change")).unionAll(named(lag_reading(of("policy_change_20d")), "policy_change_20d", "change"))
    order = spark.createDataFrame([(k, name, "/".join(v)) for k, (name, v) in enumerate(names.items())], "ord int, name string, series string")
    out = order.join(found, "name", "left")
    ok = F.col("value").isNotNull()
    # A series without any row has a window that is too short.
    return out.select("ord", "name", "series", F.when(ok, "ok").otherwise("missing").alias("status"), "value", F.when(ok, "").otherwise(F.coalesce("reason", F.lit("window_insufficient"))).alias("reason"), F.when(ok, F.col("latest")).alias("latest"), F.when(ok, F.col("prior")).alias("prior"))
