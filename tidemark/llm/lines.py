"""Line dedup with levelled sorted runs of line hashes.

A run is a table of (hash, n documents, last document, fresh), bucketed and sorted by hash,
so that runs are joined by merging buckets, without a shuffle. Batches arrive from the
largest document ids down. Each is summed by hash and merge-anti-joined with the runs: hashes
that no run holds are fresh, and the batch's largest document with such a line is the one
that keeps it; the others repeat what a larger id holds. The batch is added as a run of its
own on level 0; ``FANOUT`` runs of one level are merged into one of the next, so a hash lies
in a number of runs that grows with the logarithm of the batches, whose number grows with the
data (``BATCH_BYTES``). When all batches are in, the runs are merged into one: lines whose
documents add up to ``min_docs`` stay in the document that the anti-join found fresh alone.

Defined cases: a null or empty text is one empty line; rows with one id are one document,
which counts once for a line, and lose the same lines; rows without an id are one document,
below all others; a document that repeats a line keeps or loses all its places; an empty
table stays empty; a very long text is split whole; columns other than key and text pass
through, whatever their names. Ids are whole numbers.
"""

from __future__ import annotations

import hashlib
import uuid
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import batched, delete, new_path, release, spread
from .textbatch import buffers

BATCHES = 4  # at least
BATCH_BYTES = 64 << 30
FANOUT = 2
MIN_DOCS = 3
MIN_CHARS = 20
P = "__lines_"
_WS = b" \t\n\x0b\x0c\r"


def line_key(line: bytes) -> bytes | None:
    """The 128-bit hash of a line's key, or None if the key is too short to count."""
    key = line.strip(_WS).lower()  # bytes.lower() changes A-Z alone
    if len(key) < MIN_CHARS or len(key) < 4 * MIN_CHARS and len(key.decode("utf-8", "replace")) < MIN_CHARS:
        return None
    return hashlib.blake2b(key, digest_size=16).digest()


def line_hashes(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, h): each distinct line hash of each row."""

    def run(batches):
        for batch in batches:
            raw, at = buffers(batch.column(1))
            whole, row, out = raw.tobytes(), [], []
            for d, (a, b) in enumerate(zip(at, at[1:], strict=False)):
                own = {h for line in whole[a:b].split(b"\n") if (h := line_key(line))}
                out += own
                row += [d] * len(own)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array(out, pa.binary())], ["key", "h"])

    narrow = docs.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").alias("text"))
    return batched(narrow).mapInArrow(run, "key long, h binary")


@contextmanager
def _sorted_buckets(spark: SparkSession):
    """Within, Spark takes the order of a bucket's single file as given."""
    name = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


class RunStore:
    """Levelled runs in a folder, each a table with ``buckets`` buckets of one sorted file."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int, fanout: int = FANOUT):
        self.spark, self.folder, self.buckets, self.fanout = spark, folder, buckets, fanout
        self.levels: dict[int, list[str]] = {}

    def _write(self, rows: DataFrame) -> str:
        name = f"tidemark_run_{uuid.uuid4().hex}"
        with _sorted_buckets(self.spark):
            rows.write.format("parquet").bucketBy(self.buckets, "h").sortBy("h").option("path", f"{self.folder}/{name}").saveAsTable(name)
        return name

    def _drop(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE {name}")
            delete(self.spark, f"{self.folder}/{name}")

    def runs(self) -> list[str]:
        return [name for names in self.levels.values() for name in names]

    def add(self, batch: DataFrame) -> str:
        """Merge-anti-join the batch (key, h) with the runs and add its own run, whose table's name is returned."""
        self._compact()
        own = batch.distinct().groupBy("h").agg(F.count("*").alias("n"), F.max("key").alias("last")).repartition(self.buckets, "h")
        fresh = F.lit(True)
        for k, name in enumerate(self.runs()):
            held = self.spark.table(name).filter("fresh").select(F.col("h").alias(f"h{k}"))
            own = own.join(held.hint("merge"), own["h"] == F.col(f"h{k}"), "left")
            fresh = fresh & F.col(f"h{k}").isNull()
        name = self._write(own.select("h", "n", "last", fresh.alias("fresh")))
        self.levels.setdefault(0, []).append(name)
        return name

    def _merged(self, names: list[str]) -> str:
        """One run of several, which go."""
        out = self.spark.table(names[0])
        for name in names[1:]:
            a, b = out.alias("a"), self.spark.table(name).hint("merge").alias("b")
            n = F.coalesce("a.n", F.lit(0)) + F.coalesce("b.n", F.lit(0))
            # One of them alone has found the line fresh; its last document is the one that keeps it.
            last = F.when(F.coalesce("a.fresh", F.lit(False)), F.col("a.last")).when(F.coalesce("b.fresh", F.lit(False)), F.col("b.last")).otherwise(F.greatest("a.last", "b.last"))
            out = a.join(b, F.col("a.h") == F.col("b.h"), "full_outer").select(F.coalesce("a.h", "b.h").alias("h"), n.alias("n"), last.alias("last"), (F.coalesce("a.fresh", F.lit(False)) | F.coalesce("b.fresh", F.lit(False))).alias("fresh"))
        name = self._write(out.repartition(self.buckets, "h") if len(names) > 2 else out)
        self._drop(names)
        return name

    def _compact(self) -> None:
        for level in range(len(self.levels)):
            if len(self.levels.get(level, [])) >= self.fanout:
                self.levels.setdefault(level + 1, []).append(self._merged(self.levels[level]))
                self.levels[level] = []

    def close(self) -> DataFrame:
        """(h, n, last) of all that was added, as a table in the folder; the runs go."""
        names, path = self.runs()[::-1], f"{self.folder}/totals"
        while len(names) > 1:
            names = [self._merged(names[:2]), *names[2:]]
        self.spark.table(names[0]).select("h", "n", "last").write.parquet(path)
        self._drop(names)
        self.levels = {}
        return self.spark.read.schema("h binary, n long, last long").parquet(path)


def _slice(docs: DataFrame, batches: int) -> Column:
    """The batch of a key, by quantiles of all keys: the largest keys are batch 0, null keys the last."""
    shares = [k / batches for k in range(1, batches)]
    cuts = sorted(set(docs.agg(F.percentile_approx("key", shares, 10_000)).first()[0] or []), reverse=True)
    out = F.lit(0)
    for cut in cuts:
        out = out + F.when(F.col("key") <= cut, 1).otherwise(0)
    return F.when(F.col("key").isNull(), len(cuts)).otherwise(out).cast("int")


def repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_docs: int = MIN_DOCS, batches: int | None = None) -> DataFrame:
    """(key, drop array<binary>): the hashes of the lines that rows with this key lose."""
    spark = docs.sparkSession
    folder = new_path(spark, "lines")
    narrow = docs.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").alias("text"))
    batches = batches or max(BATCHES, spread(narrow, BATCH_BYTES, 1))
    line_hashes(docs, key, text).withColumn("batch", _slice(narrow.select("key"), batches)).write.partitionBy("batch").parquet(f"{folder}/lines")
    lines = spark.read.schema("key long, h binary, batch int").parquet(f"{folder}/lines")
    store = RunStore(spark, folder, spread(narrow))
    for k in range(batches):
        store.add(lines.filter(F.col("batch") == k).select("key", "h"))
    # Written out, so that the join has a shuffle of its own on either side, which Spark can split at a hot line.
    store.close().filter(F.col("n") >= min_docs).select("h", "last").write.parquet(f"{folder}/often")
    often = spark.read.schema("h binary, last long").parquet(f"{folder}/often")
    lost = lines.select("key", "h").join(often, "h").filter(F.col("key").isNull() & F.col("last").isNotNull() | (F.col("key") < F.col("last")))
    lost.groupBy("key").agg(F.collect_set("h").alias("drop")).write.parquet(f"{folder}/drop")
    for step in ("lines", "totals", "often"):
        delete(spark, f"{folder}/{step}")
    del lines, often, lost
    release(spark)
    return spark.read.schema("key long, drop array<binary>").parquet(f"{folder}/drop")


def _marked(docs: DataFrame, key: str, text: str, **options) -> DataFrame:
    drops = repeated_lines(docs, key, text, **options).select(F.col("key").alias(f"{P}key"), F.col("drop").alias(f"{P}drop"))
    return docs.join(drops, F.col(f"`{key}`").cast("long").eqNullSafe(F.col(f"{P}key")), "left").drop(f"{P}key")


def _kept(batch: pa.RecordBatch, text: int, drop: int):
    """(lines, dropped lines, kept bytes) of each row; text and drop are the columns' places."""
    raw, at = buffers(batch.column(text))
    whole, drops = raw.tobytes(), batch.column(drop)
    for d, (a, b) in enumerate(zip(at, at[1:], strict=False)):
        lines = whole[a:b].split(b"\n")
        kept = lines
        if drops[d].is_valid:
            gone = set(drops[d].as_py())
            kept = [x for x in lines if line_key(x) not in gone]
        yield len(lines), len(lines) - len(kept), b"\n".join(kept)


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs with repeated lines taken out of the text; the other columns as they are."""
    place, names = docs.columns.index(text), [f"c{i}" for i in range(len(docs.columns))]

    def run(batches):
        for batch in batches:
            out = pa.array([x.decode("utf-8", "replace") for _, _, x in _kept(batch, place, len(names))], pa.string())
            yield pa.RecordBatch.from_arrays([out if i == place else batch.column(i) for i in range(len(names))], names)

    # By place, as names may hold points.
    schema = StructType([StructField(n, f.dataType) for n, f in zip(names, docs.schema, strict=True)])
    return _marked(docs, key, text, **options).toDF(*names, f"{P}drop").mapInArrow(run, schema).toDF(*docs.columns)


def report(docs: DataFrame) -> DataFrame:
    """One row for each document: doc_id, n_lines, n_dropped, kept_sha256."""

    def run(batches):
        for batch in batches:
            rows = list(_kept(batch, 1, 2))
            columns = [batch.column(0), *(pa.array([r[i] for r in rows], pa.int64()) for i in (0, 1)), pa.array([hashlib.sha256(r[2]).hexdigest() for r in rows], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    narrow = docs.select("doc_id", "text")
    return _marked(narrow, "doc_id", "text").mapInArrow(run, f"doc_id {narrow.schema[0].dataType.simpleString()}, n_lines long, n_dropped long, kept_sha256 string")
