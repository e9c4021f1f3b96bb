"""Securities as of a day."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def resolve(requests: DataFrame, securities: DataFrame) -> DataFrame:
    """(request_id, security_id, matches): the security valid on the day, a default if none is; several are ambiguous."""
    s = securities.select(F.col("ticker").alias("_t"), F.col("market").alias("_m"), "security_id", "valid_from", "valid_to")
    valid = (F.col("day") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("day") <= F.col("valid_to")))
    rows = requests.join(s, (F.col("ticker") == F.col("_t")) & (F.col("market") == F.col("_m")) & valid, "left")
    out = rows.groupBy("request_id", "ticker", "market").agg(F.count("security_id").alias("matches"), F.min("security_id").alias("one"))
    default = F.concat_ws(":", "market", F.when(F.col("market") == "HK", "XHKG").otherwise("XNAS"), "ticker")
    found = F.when(F.col("matches") == 0, default).when(F.col("matches") == 1, F.col("one")).otherwise("ambiguous")
    return out.select("request_id", found.alias("security_id"), "matches")


def by_id(requests: DataFrame, securities: DataFrame) -> DataFrame:
    """Requests with the security that has their id, or nulls."""
    return requests.join(securities, "security_id", "left")
