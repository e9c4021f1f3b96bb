"""Versioned datasets: snapshots in folders, and a catalog table of them."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import DataError

CATALOG = "name string, version string, path string, rows long, created_at timestamp"
_NAME = re.compile(r"[A-Za-z0-9][A-Za-z0-9_.-]{0,100}")


def latest_versions(catalog: DataFrame) -> DataFrame:
    """The newest version of each dataset."""
    return catalog.groupBy("name").agg(F.max_by(F.struct("version", "path", "rows", "created_at"), F.struct("created_at", "version")).alias("v")).select("name", "v.*")


def snapshot(required: DataFrame, catalog: DataFrame) -> DataFrame:
    """Each required name with its newest version, or missing."""
    return required.join(latest_versions(catalog), "name", "left").withColumn("missing", F.col("version").isNull())


RUNS = "run_id string, created_at timestamp, path string, summary string"


def listed(catalog: DataFrame) -> DataFrame:
    """The versions of each dataset, newest first, as rank from 1."""
    rank = F.row_number().over(Window.partitionBy("name").orderBy(F.desc("created_at"), F.desc("version")))
    return catalog.withColumn("rank", rank.cast("long"))


class Store:
    """Datasets and runs under a root that Spark can write to; every save is a new version.

    The catalog is a table that is only appended to: the last row of a name and version counts,
    so a moved path is a row with the same registration time and a later turn.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _named(self, name: str) -> str:
        if not _NAME.fullmatch(name):
            raise DataError(f"not a dataset name: {name!r}")
        return name

    def _table(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def _append(self, table: str, schema: str, row: tuple, created_at: str) -> None:
        self.spark.createDataFrame([row], schema).withColumn("created_at", F.lit(created_at).cast("timestamp")).write.mode("append").parquet(f"{self.root}/{table}")

    def catalog(self) -> DataFrame:
        rows = self._table("catalog", f"{CATALOG}, turn int")
        return rows.groupBy("name", "version").agg(F.max_by(F.struct("path", "rows", "created_at"), "turn").alias("v")).select("name", "version", "v.*")

    def save(self, name: str, df: DataFrame, created_at: str) -> str:
        """Write a snapshot, named by its time and a hash of its rows, and register it."""
        columns = [F.col(f"`{c}`") for c in df.columns]
        rows, digest = df.agg(F.count("*"), F.sum(F.xxhash64(*columns).cast("decimal(38,0)"))).first()
        version = f"{re.sub('[^0-9]', '', created_at)[:20]}-{int(digest or 0) & (1 << 48) - 1:012x}"
        path = f"{self.root}/{self._named(name)}/version={version}"
        df.write.mode("errorifexists").parquet(path)
        self._append("catalog", f"{CATALOG}, turn int", (name, version, path, rows, None, 0), created_at)
        return version

    def entry(self, name: str, version: str | None = None) -> dict:
        """The catalog's row of a version, by default the newest."""
        rows = self.catalog().filter(F.col("name") == self._named(name))
        row = (rows.filter(F.col("version") == version) if version else latest_versions(rows)).first()
        if row is None:
            raise DataError(f"dataset {name} version {version or 'latest'} is not in the catalog")
        return row.asDict()

    def load(self, name: str, version: str | None = None) -> DataFrame:
        path = self.entry(name, version)["path"]
        if ".." in path.split("/") or not path.startswith(f"{self.root}/"):
            raise DataError("dataset leaves the root")
        return self.spark.read.parquet(path)

    def versions(self, name: str) -> DataFrame:
        """All versions of a dataset, newest first."""
        return listed(self.catalog().filter(F.col("name") == self._named(name))).orderBy("rank")

    def replace_path(self, name: str, version: str, path: str) -> None:
        """The version is found elsewhere; its identity and time of registration stay."""
        entry = self.entry(name, version)
        turn = self._table("catalog", f"{CATALOG}, turn int").filter((F.col("name") == name) & (F.col("version") == version)).agg(F.max("turn")).first()[0]
        self._append("catalog", f"{CATALOG}, turn int", (name, version, path, entry["rows"], None, turn + 1), str(entry["created_at"]))

    def convert(self, name: str, read) -> list[str]:
        """Versions kept in another format (``read`` makes a frame of their path) as Parquet, checked row by row before the catalog points to it."""
        done = []
        for row in self.catalog().filter(F.col("name") == self._named(name)).orderBy("version").collect():
            if row["path"].startswith((f"{self.root}/{name}/version=", f"{self.root}/{name}/converted=")):
                continue
            df, path = read(row["path"]), f"{self.root}/{name}/converted={row['version']}"
            df.write.mode("errorifexists").parquet(path)
            back = self.spark.read.parquet(path)
            if not (df.exceptAll(back).isEmpty() and back.exceptAll(df).isEmpty()):
                raise DataError("converted rows differ")
            self.replace_path(name, row["version"], path)
            done.append(row["version"])
        return done

    def register_run(self, run_id: str, path: str, summary: str, created_at: str) -> None:
        self._append("runs", RUNS, (run_id, None, path, summary), created_at)

    def run(self, run_id: str) -> dict | None:
        """The last registration of a run, or None."""
        row = self._table("runs", RUNS).filter(F.col("run_id") == run_id).orderBy(F.desc("created_at")).first()
        return row.asDict() if row else None


REQUIRED = {"news": ["title", "published_at", "source_id"], "macro": ["series_id", "observation_date", "value"], "securities": ["ticker", "market", "valid_from"]}


def check_required(kind: str, df: DataFrame) -> DataFrame:
    missing = [c for c in REQUIRED[kind] if c not in df.columns]
    if missing:
        raise DataError(f"{kind} lacks the columns {', '.join(missing)}")
    return df


#: What each source may be used for.
SOURCES = {
    "sec": (["US"], ["filings"]),
    "fred": (["US"], ["macro"]),
    "finnhub": (["US"], ["news", "calendar"]),
    "gdelt": (["US", "HK"], ["news"]),
    "hkma": (["HK"], ["news", "macro"]),
    "census": (["US"], ["macro"]),
    "company_ir": (["US", "HK"], ["filings", "news"]),
    "user_import": (["US", "HK"], ["macro", "news", "securities"]),
}


def allowed(rows: DataFrame, source: str, market: str, dataset: str) -> DataFrame:
    """Rows whose (source, market, dataset) the policy admits; an unknown source is not."""
    table = [(s, m, d) for s, (ms, ds) in SOURCES.items() for m in ms for d in ds]
    policy = rows.sparkSession.createDataFrame(table, "_s string, _m string, _d string")
    return rows.join(F.broadcast(policy), (F.col(source) == F.col("_s")) & (F.upper(market) == F.col("_m")) & (F.col(dataset) == F.col("_d")), "left_semi")


#: What no source may be used for.
PROHIBITED = {"hk_yahoo": ["HK"], "hkexnews_automation": ["HK"], "ecb_tls_bypass": ["US", "HK"]}


def source_allowed(source: str, market: str, dataset: str) -> bool:
    markets, datasets = SOURCES.get(source, ([], []))
    return market.upper() in markets and dataset in datasets


def prohibited(rows: DataFrame, key: str, market: str) -> DataFrame:
    """Rows whose use is prohibited in their market."""
    hit = F.lit(False)
    for name, markets in PROHIBITED.items():
        hit = hit | (F.col(key) == name) & F.upper(market).isin(markets)
    return rows.filter(hit)
