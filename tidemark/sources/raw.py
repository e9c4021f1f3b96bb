"""Raw payloads under their SHA-256, with manifests of when they were seen."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import DataError
from ..functions import scalars as S
from .versions import Store

BASIS = "earliest_retained_local_receipt_for_this_payload; not_provider_first_publication"
MANIFEST = "sha256 string, source_id string, dataset string, byte_count long, raw_path string, first_observed_at timestamp, last_observed_at timestamp, receipts long"


def addressed(rows: DataFrame, extension: str = ".json") -> DataFrame:
    """rows (source_id, dataset, payload, received_at) with sha256, byte_count and the path that their content gives them."""
    payload = F.col("payload").cast("binary")
    digest = F.sha2(payload, 256)
    folder = F.concat_ws("/", F.lit("raw"), S.safe_component(F.col("source_id")), S.safe_component(F.col("dataset")), F.date_format("received_at", "yyyy"), F.date_format("received_at", "MM"))
    return rows.withColumns({"sha256": digest, "byte_count": F.length(payload).cast("long"), "raw_path": F.concat(folder, F.lit("/"), digest, F.lit(extension if extension.startswith(".") else f".{extension}"))})


def manifests(addressed_rows: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """One manifest for each path: first and last time seen, over these receipts and the manifests before."""
    new = addressed_rows.groupBy("raw_path").agg(*[F.first(c).alias(c) for c in ("sha256", "source_id", "dataset", "byte_count")], F.min("received_at").alias("first_observed_at"), F.max("received_at").alias("last_observed_at"), F.count("*").alias("receipts"))
    if before is not None:
        both = new.unionByName(before.select(*new.columns))
        new = both.groupBy("raw_path").agg(*[F.first(c).alias(c) for c in ("sha256", "source_id", "dataset", "byte_count")], F.min("first_observed_at").alias("first_observed_at"), F.max("last_observed_at").alias("last_observed_at"), F.sum("receipts").alias("receipts"))
    return new


def verified(payloads: DataFrame, manifests_: DataFrame) -> DataFrame:
    """Each manifest with ``state``: intact, corrupted, or missing where no payload has its path."""
    own = payloads.select("raw_path", F.sha2(F.col("payload").cast("binary"), 256).alias("_own"))
    state = F.when(F.col("_own").isNull(), "missing").when(F.col("_own") == F.col("sha256"), "intact").otherwise("corrupted")
    return manifests_.join(own, "raw_path", "left").withColumn("state", state).drop("_own")


class RawStore:
    """Payloads and manifests in a store: a payload that is there already is not written again."""

    def __init__(self, store: Store):
        self.store, self.spark = store, store.spark

    def payloads(self) -> DataFrame:
        return self.store._table("raw/payloads", "raw_path string, payload binary")

    def manifests(self) -> DataFrame:
        known = self.store.catalog().filter("name = 'raw-manifests'").limit(1).count()
        return self.store.load("raw-manifests") if known else self.spark.createDataFrame([], MANIFEST)

    def save(self, rows: DataFrame, created_at: str, extension: str = ".json") -> dict:
        """Stores the payloads that are new and a new version of the manifests; a payload that changed under its name stops it."""
        got = addressed(rows, extension)
        bad = verified(self.payloads(), self.manifests()).filter("state = 'corrupted'").join(got.select("raw_path").distinct(), "raw_path", "left_semi").first()
        if bad:
            raise DataError(f"hash collision or corrupted raw payload at {bad['raw_path']}")
        new = got.join(self.payloads().select("raw_path"), "raw_path", "left_anti").groupBy("raw_path").agg(F.first(F.col("payload").cast("binary")).alias("payload"))
        merged = manifests(got, self.manifests()).select(*[f.split()[0] for f in MANIFEST.split(", ")])
        version = self.store.save("raw-manifests", merged, created_at)
        new.write.mode("append").parquet(f"{self.store.root}/raw/payloads")
        return {"version": version, "manifests": self.store.entry("raw-manifests", version)["rows"]}

    def read(self, raw_path: str) -> bytes:
        row = self.payloads().filter(F.col("raw_path") == raw_path).first()
        if row is None:
            raise DataError(f"no payload at {raw_path}")
        return bytes(row["payload"])


def open_store(spark: SparkSession, root: str) -> RawStore:
    return RawStore(Store(spark, root))
