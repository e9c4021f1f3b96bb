"""SimHash near-dedup with pivot distance tables.

Equal fingerprints are one class. Each distinct fingerprint gets a row of Hamming distances,
block by block, to reference fingerprints. In any block the distances to one reference
differ by no more than the blocks do, so fingerprints with ``RADIUS`` differing bits have
equal rows in all but ``RADIUS`` of the ``BLOCKS`` blocks at least: the rows of each choice
of so many blocks are a join key, and no link is lost. Pairs whose largest coordinate
differences, summed over the blocks, exceed the radius are discarded, and survivors are
verified bit by bit. Links between distinct fingerprints alone are listed, never pairs of
copies; components are found by stars over tables in the shared folder.

Defined cases: a text without words has fingerprint zero and links like any other; a null
text counts as empty; ``component_id`` is the smallest id of the component, nulls left out
(null if all are); rows with one id stay or go together; a bit set in just half of the
hashes is 0; a very long text is hashed whole, its shingles' bits summed in pieces; an empty
table stays empty; other columns pass through, whatever their names. Ids are whole numbers.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batched, staged
from .graph import components
from .textbatch import buffers

SHINGLE = 3
SEED = 42
RADIUS = 2
#: Bit ranges of the blocks.
BLOCKS = [(0, 11), (11, 22), (22, 33), (33, 44), (44, 54), (54, 64)]
REFERENCES = 12


def fingerprint(raw: bytes) -> int:
    """The fingerprint of a text's UTF-8 bytes, unsigned."""
    words = raw.lower().split()  # bytes: A-Z and the six ASCII white spaces alone
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(s), SEED) for s in zip(*(words[k:] for k in range(SHINGLE)), strict=False)] or [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    counts = np.zeros(64, np.int64)
    for a in range(0, len(hashes), 1 << 16):
        bits = np.array(hashes[a : a + (1 << 16)], "<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(bits, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp) with the fingerprint as a signed long."""

    def run(batches):
        for batch in batches:
            raw, at = buffers(batch.column(1))
            out = np.array([fingerprint(raw[a:b].tobytes()) for a, b in zip(at, at[1:], strict=False)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out.view(np.int64))], ["key", "fp"])

    narrow = docs.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").alias("text"))
    return batched(narrow).mapInArrow(run, "key long, fp long")


def references() -> list[int]:
    """Reference fingerprints, by a fixed rule, as signed longs."""
    return [int(np.uint64(xxhash.xxh64_intdigest(b"reference %d" % k, SEED)).astype(np.int64)) for k in range(REFERENCES)]


def pivots(fp: Column) -> list[list[Column]]:
    """For each block, the distances to the references within it."""
    masks = [int(np.uint64(((1 << b) - 1) & ~((1 << a) - 1)).astype(np.int64)) for a, b in BLOCKS]
    return [[F.bit_count(fp.bitwiseXOR(F.lit(r)).bitwiseAND(F.lit(m))) for r in references()] for m in masks]


def candidates(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(u, v): distinct fingerprints of ``prints`` (fp, no repeats) whose table rows are equal in all but ``radius`` blocks, once for each choice of blocks."""
    rows = [F.xxhash64(F.array(*coords)) for coords in pivots(F.col("fp"))]
    tabled = prints.select("fp", F.array(*rows).alias("rows"))
    choices = itertools.combinations(range(len(BLOCKS)), len(BLOCKS) - radius)
    keys = F.array(*[F.xxhash64(F.lit(k), *[F.get("rows", F.lit(b)) for b in choice]) for k, choice in enumerate(choices)])
    keyed = tabled.select("fp", F.explode(keys).alias("key"))
    return keyed.alias("a").join(keyed.select(F.col("fp").alias("v"), F.col("key")).alias("b"), F.col("a.key") == F.col("b.key")).filter("a.fp < v").select(F.col("fp").alias("u"), "v")


def bounded(pairs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The pairs whose largest coordinate differences, summed over the blocks, are within the radius: no link is lost, as a block's coordinates differ by no more than the blocks do."""
    apart = F.lit(0)
    for x, y in zip(pivots(F.col("u")), pivots(F.col("v")), strict=True):
        apart = apart + F.greatest(*[F.abs(p - q) for p, q in zip(x, y, strict=True)])
    return pairs.filter(apart <= radius)


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(u, v): distinct fingerprints of ``prints`` (fp, no repeats) that differ in 1 to radius bits."""
    return bounded(candidates(prints, radius), radius).filter(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= radius).distinct()


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp, component_id) for each row of docs."""
    prints = staged(fingerprints(docs, key, text), "fingerprints")
    groups = staged(prints.groupBy("fp").agg(F.min("key").alias("least")), "groups")
    roots = components(links(groups.select("fp")))
    rooted = groups.join(roots, groups["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(rooted.select("fp", "root").join(least, "root").select("fp", "component_id"), "fp").select("key", "fp", "component_id")


def near_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs whose id is the smallest of its component."""
    gone = classes(docs, key, text).filter(~F.col("key").eqNullSafe(F.col("component_id"))).select(F.col("key").alias("__simhash_key")).distinct()
    return docs.join(gone, F.col(f"`{key}`").cast("long").eqNullSafe(F.col("__simhash_key")), "left_anti")


def report(docs: DataFrame) -> DataFrame:
    """One row for each document: doc_id, fingerprint, component_id."""
    out = classes(docs)
    return out.select(F.col("key").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
