"""Token-ID files: patched frame-of-reference blocks.

Documents are put in ascending order by a range partitioning, one shard a partition; each
shard is a row of segments, and a segment is a file image of its own::

    "PFR2", documents u32, ids u64, blocks u32
    document keys i64[], which keys are null u8[], ids of each document u32[], block starts u64[]
    block: minimum u32, width u8, ids u16, exceptions u16, packed bits, positions u16[], high parts u32[]

A block holds up to 1024 ids. Its minimum is subtracted and the rest is packed at the width
that the 90th percentile needs; what does not fit leaves its low bits in place and its high
part in the exception list. Block starts allow reading from any id without the blocks before.
Segments are rows of a Parquet table, as Spark's committer then makes a lost task harmless
and the files lie in any store.

Defined cases: a null text is an empty one (its end id alone); null keys come first, before
the smallest id; rows with one key are ordered by text, so equal rows are alike in any order;
an empty table writes no segment and reads back empty; a very long text is a segment of its
own; other columns are not read. Keys are whole numbers (others are an error of the cast).
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import CHUNK_BYTES, Memory, code_points
from .common import new_path
from .textbatch import buffers, chunks

BLOCK = 1024
PERCENTILE = 90
END_ID = 2
_HEAD = struct.Struct("<4sIQI")
_BLOCK = struct.Struct("<IBHH")


def _widths(values: np.ndarray) -> np.ndarray:
    """Bits that each value needs."""
    return np.ceil(np.log2(values.astype(np.float64) + 1)).astype(np.int64)


def pack(ids: np.ndarray, keys: np.ndarray, lens: np.ndarray, null: np.ndarray | None = None) -> bytes:
    """The file image of a segment; ``null`` tells the documents without a key."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    low = np.zeros((blocks, BLOCK), np.int64)
    if n:
        low.reshape(-1)[:n] = ids
        low.reshape(-1)[n:] = ids[-1]
    least = low.min(axis=1) if n else np.zeros(0, np.int64)
    low -= least[:, None]
    width = _widths(np.percentile(low, PERCENTILE, axis=1, method="higher")) if n else least
    size = np.full(blocks, BLOCK)
    size[-1:] = n - BLOCK * (blocks - 1)
    packed: dict[int, bytes] = {}
    for w in np.unique(width).tolist():
        these = np.flatnonzero(width == w)
        if w:
            bits = (low[these].astype(np.uint32)[:, :, None] >> np.arange(w, dtype=np.uint32)) & 1
            rows = np.packbits(bits.astype(np.uint8).reshape(len(these), -1), axis=1, bitorder="little")
        else:
            rows = np.zeros((len(these), 0), np.uint8)
        packed.update(zip(these.tolist(), map(bytes, rows), strict=True))
    high = low >> width[:, None]
    row, col = np.nonzero(high)
    over, at = high[row, col].astype("<u4"), col.astype("<u2")
    cut = np.searchsorted(row, np.arange(blocks + 1))
    body, starts, where = [], [], 0
    for k in range(blocks):
        a, b = cut[k], cut[k + 1]
        data = _BLOCK.pack(int(least[k]), int(width[k]), int(size[k]), int(b - a)) + packed[k] + at[a:b].tobytes() + over[a:b].tobytes()
        starts.append(where)
        where += len(data)
        body.append(data)
    head = _HEAD.pack(b"PFR2", len(keys), n, blocks)
    null = np.zeros(len(keys), bool) if null is None else null
    return head + keys.astype("<i8").tobytes() + null.astype("u1").tobytes() + lens.astype("<u4").tobytes() + np.array(starts, "<u8").tobytes() + b"".join(body)


def _block(data: memoryview, at: int) -> np.ndarray:
    least, width, size, extra = _BLOCK.unpack_from(data, at)
    at += _BLOCK.size
    out = np.full(BLOCK, least, np.int64)
    if width:
        bits = np.unpackbits(np.frombuffer(data, np.uint8, BLOCK * width // 8, at), bitorder="little").reshape(BLOCK, width)
        out += bits @ (1 << np.arange(width, dtype=np.int64))
    at += BLOCK * width // 8
    if extra:
        where = np.frombuffer(data, "<u2", extra, at)
        out[where] += np.frombuffer(data, "<u4", extra, at + 2 * extra).astype(np.int64) << width
    return out[:size].astype(np.uint32)


def unpack(image: bytes, first: int = 0, last: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids first to last, keys, lens, null keys) of a segment; only the blocks that hold the ids are read."""
    magic, docs, n, blocks = _HEAD.unpack_from(image, 0)
    if magic != b"PFR2":
        raise ValueError("not a token segment")
    at = _HEAD.size
    keys = np.frombuffer(image, "<i8", docs, at)
    null = np.frombuffer(image, "u1", docs, at + 8 * docs).astype(bool)
    lens = np.frombuffer(image, "<u4", docs, at + 9 * docs)
    starts = np.frombuffer(image, "<u8", blocks, at + 13 * docs)
    body = at + 13 * docs + 8 * blocks
    last = n if last is None else min(last, n)
    if first >= last:
        return np.zeros(0, np.uint32), keys, lens, null
    view, a = memoryview(image), first // BLOCK
    ids = np.concatenate([_block(view, body + int(starts[k])) for k in range(a, -(-last // BLOCK))])
    return ids[first - a * BLOCK : last - a * BLOCK], keys, lens, null


_workers: dict = {}


def _tokenizer(path: str) -> tuple:
    """A worker's (tokenizer, memory of pre-tokens, special strings)."""
    if path not in _workers:
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)

        def encode(cp: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            text, at = cp.astype("<u4").tobytes().decode("utf-32-le"), np.concatenate([[0], np.cumsum(lens)]).tolist()
            out = tok.encode([text[a:b] for a, b in zip(at, at[1:], strict=False)], is_pretokenized=True, add_special_tokens=False)
            return np.array(out.ids, np.uint32), np.bincount(np.array(out.word_ids, np.int64), minlength=len(lens))

        special = [t.content.encode() for t in tok.get_added_tokens_decoder().values()]
        _workers[path] = tok, Memory(encode), special
    return _workers[path]


def token_ids(column: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids, bounds) of a batch of texts, as the tokenizers library gives them."""
    tok, memory, special = _tokenizer(path)
    ids, bounds = memory.batch(*code_points(column))
    raw, at = buffers(column)
    whole = raw.tobytes()
    if not any(s in whole for s in special):
        return ids, bounds
    # The library cuts at special strings first; texts that hold one go through it whole.
    parts = []
    for d, (a, b) in enumerate(zip(at, at[1:], strict=False)):
        text = whole[a:b]
        own = any(s in text for s in special)
        parts.append(np.array(tok.encode(text.decode(), add_special_tokens=False).ids, np.uint32) if own else ids[bounds[d] : bounds[d + 1]])
    return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])


def write_tokens(docs: DataFrame, path: str, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int = END_ID, shards: int | None = None) -> None:
    """Encode docs, end each with end_id, and write the segments in ascending key order."""
    shards = shards or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        for k, batch in enumerate(chunks(batches, "text", CHUNK_BYTES)):
            ids, bounds = token_ids(batch.column(1), tokenizer)
            out = np.full(len(ids) + batch.num_rows, end_id, np.uint32)
            out[np.arange(len(ids)) + np.repeat(np.arange(batch.num_rows), np.diff(bounds))] = ids
            null = batch.column(0).is_null().to_numpy(zero_copy_only=False)
            keys = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            image = pack(out, keys, np.diff(bounds) + 1, null)
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (shard, k, len(out), image)], ["shard", "segment", "n_ids", "image"])

    ordered = docs.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").alias("text")).repartitionByRange(shards, "key").sortWithinPartitions("key", "text")
    ordered.mapInArrow(run, "shard long, segment long, n_ids long, image binary").write.parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of each document, from the files."""

    def run(batches):
        for batch in batches:
            for shard, segment, image in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                ids, keys, lens, null = unpack(image)
                at = np.concatenate([[0], np.cumsum(lens, dtype=np.int64)])
                wide = ids.astype("<u4")
                crc = [zlib.crc32(wide[a:b]) for a, b in zip(at, at[1:], strict=False)]
                n = len(keys)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, shard)), pa.array(np.full(n, segment)), pa.array(keys, mask=null), pa.array(at[:-1]), pa.array(lens.astype(np.int64)), pa.array(crc, pa.int64())],
                    ["shard", "segment", "key", "within", "n_tokens", "ids_crc32"],
                )

    segments = spark.read.schema("shard long, segment long, n_ids long, image binary").parquet(path)
    # Sums of all ids before: by segment within a shard, and by shard, of which there are as many as write tasks.
    shards = segments.groupBy("shard").agg(F.sum("n_ids").alias("n")).withColumn("base", F.sum("n").over(Window.orderBy("shard")) - F.col("n"))
    before = F.sum("n_ids").over(Window.partitionBy("shard").orderBy("segment")) - F.col("n_ids")
    index = segments.select("shard", "segment", "n_ids").withColumn("before", before).join(shards.select("shard", "base"), "shard")
    rows = segments.select("shard", "segment", "image").mapInArrow(run, "shard long, segment long, key long, within long, n_tokens long, ids_crc32 long")
    out = rows.join(index.select("shard", "segment", (F.col("base") + F.col("before")).alias("first")), ["shard", "segment"])
    return out.select("key", (F.col("first") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """One row for each document, read back: doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    path = new_path(spark, "tokens")
    write_tokens(docs, path, tokenizer)
    return read_tokens(spark, path).withColumnRenamed("key", "doc_id")
