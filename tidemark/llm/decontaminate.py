"""Benchmark decontamination: CGK walks, bit-sampling LSH, exact edit verification.

Items and texts are sequences of words: digits, letters and all that is not ASCII, A-Z in
lower case, so that punctuation, case and line breaks make no difference. A text holds an
item if some stretch of it has a word edit distance of at most ``floor((1 - SIMILARITY) *
words of the item)`` to it.

Embedding: a walk reads a sequence word by word; at each of its steps it writes the word it
stands on, and a random bit of step and word tells whether it moves on. Two sequences with
few edits get out of step at an edit and, as the bits of unlike words are independent, fall
into step again, so edit distance becomes Hamming distance of what is written. A walk has
``STEPS`` steps for each word of the item, enough to read the item to its end on average.

LSH: ``REPEATS`` walks, each sampled at ``SAMPLES`` random steps, give every item that many
buckets, and so they do for the windows of that size at every start in a text. A text and an
item are a candidate if a window of the one and the other share a bucket. Items of about
the same length (within ``RATIO``) share walks and samples. README lists the measured recall.

Gate: an edit spoils q runs of q words, so a match holds ``L - q + 1 - q * e`` runs of an item
of L words with e edits, q = min(3, ceil((L - e) / (e + 1))); windows with fewer runs of any
items at all need no walk. The gate knows no items, loses no match and only saves work: tests
hold the result with it against the result without. It and the table of buckets that items
have are bitmaps of fixed size, which is what reaches each task whatever the number of items.

Verification is exact: bit vectors tell the least distance of the item to any stretch of the
text's windows, and the first stretch that has it.

Items are a table throughout: texts meet them in joins by bucket, only the regions of texts
that share a bucket travel, and all items are met in one pass over the texts.

Defined cases: null or empty texts hold nothing; items without words match nothing; null and
repeated item ids are each judged; rows are judged one by one, equal rows alike; of an item's
places in a text the least distance counts, then the first start, then the shortest stretch;
a very long text is a chunk of its own, read whole; an empty table of either kind gives no
match; columns other than id and text pass through. Ids are whole numbers.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_path
from .textbatch import PUNCTUATION, Words, chunks, mixed

SIMILARITY = 0.8
REPEATS = 24
SAMPLES = 2
STEPS = 2
RATIO = 1.15
SEED = 0x13198A2E03707344
BITMAP = 26
CHUNK_BYTES = 3 << 20
P = "__items_"


def allowed(n: int, similarity: float = SIMILARITY) -> int:
    return math.floor((1 - similarity) * n + 1e-9)


def run_size(n: int, e: int) -> int:
    """Words of the runs that a match of n words with e edits keeps whole."""
    return min(3, math.ceil((n - e) / (e + 1)))


def _grams(hashes: np.ndarray, q: int) -> np.ndarray:
    """Hashes of q words from each position on."""
    n = len(hashes) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(q):
        out = mixed(out * np.uint64(3) + hashes[k : k + n] + np.uint64(q))
    return out


def bits(item: list[int]) -> dict[int, int]:
    """For each word of the item, the places where it stands, as bits."""
    out: dict[int, int] = {}
    for k, w in enumerate(item):
        out[w] = out.get(w, 0) | 1 << k
    return out


def costs(places: dict[int, int], size: int, text: list[int]) -> list[int]:
    """The least edit distance of an item to a stretch of the text that ends before each place: Myers' bit vectors, a column a word."""
    full, top = (1 << size) - 1, 1 << (size - 1)
    up, down, cost, out = full, 0, size, [size]
    for w in text:
        same = places.get(w, 0)
        zero = (((same & up) + up) ^ up) | same | down
        rise, fall = down | (full & ~(zero | up)), up & zero
        if rise & top:
            cost += 1
        elif fall & top:
            cost -= 1
        rise, fall = rise << 1 & full, fall << 1 & full
        up, down = fall | (full & ~(zero | rise)), rise & zero
        out.append(cost)
    return out


def best(item: list[int], text: list[int], most: int) -> tuple[int, int, int] | None:
    """(distance, first word, words) of the text's best stretch for the item, or None beyond most."""
    size = len(item)
    cost = costs(bits(item), size, text)
    least = min(cost)
    if least > most:
        return None
    back, found = bits(item[::-1]), []
    for end in (k for k, c in enumerate(cost) if c == least):
        # Read backwards from the end, the same distance tells where such stretches start.
        reach = min(end, size + least)
        behind = costs_from(back, size, text[end - reach : end][::-1])
        found += [(end - n, n) for n, c in enumerate(behind) if c == least]
    return least, *min(found)


def costs_from(places: dict[int, int], size: int, text: list[int]) -> list[int]:
    """The edit distance of an item to each prefix of the text."""
    full, top = (1 << size) - 1, 1 << (size - 1)
    up, down, cost, out = full, 0, size, [size]
    for w in text:
        same = places.get(w, 0)
        zero = (((same & up) + up) ^ up) | same | down
        rise, fall = down | (full & ~(zero | up)), up & zero
        if rise & top:
            cost += 1
        elif fall & top:
            cost -= 1
        rise, fall = rise << 1 & full | 1, fall << 1 & full  # a prefix, not any stretch: what stands before costs
        up, down = fall | (full & ~(zero | rise)), rise & zero
        out.append(cost)
    return out


def floor_of(n: int) -> int:
    """The least length of the class of n: one class for each length up to 8, then RATIO from one to the next."""
    if n <= 8:
        return n
    low = 9
    while (high := max(low + 1, math.ceil(low * RATIO))) <= n:
        low = high
    return low


class Class:
    """Lengths that share walks: what a window of them must hold, and where its walks are sampled."""

    def __init__(self, lengths: list[int], similarity: float):
        self.low = floor_of(min(lengths))
        edits = [allowed(n, similarity) for n in lengths]
        self.q = min(run_size(n, e) for n, e in zip(lengths, edits, strict=True))
        self.runs = min(max(1, n - self.q + 1 - self.q * e) for n, e in zip(lengths, edits, strict=True))
        self.shortest = min(n - e for n, e in zip(lengths, edits, strict=True))
        self.span = max(n + e for n, e in zip(lengths, edits, strict=True))
        rng = np.random.default_rng([SEED & 0xFFFFFFFF, self.low])
        last = max(1, STEPS * self.low - 1)
        # Steps of each walk; short walks are written down whole.
        self.steps = np.array([np.sort(rng.choice(last, min(SAMPLES, last), replace=False)) for _ in range(REPEATS)])


def classes(lengths: list[int], similarity: float = SIMILARITY) -> list[Class]:
    of: dict[int, list[int]] = {}
    for n in sorted(set(lengths)):
        of.setdefault(floor_of(n), []).append(n)
    return [Class(x, similarity) for x in of.values()]


def buckets(hashes: np.ndarray, starts: np.ndarray, stops: np.ndarray, kinds: list[Class]) -> list[np.ndarray]:
    """For each class, the bucket of each start in each walk: an array (starts, REPEATS).

    A walk stays on the last word before its stop, so that short texts have buckets, too.
    """
    out = [np.zeros((len(starts), REPEATS), np.uint64) for _ in kinds]
    if not len(starts):
        return out
    last = max(int(k.steps.max()) for k in kinds)
    for r in range(REPEATS):
        wanted: dict[int, list[int]] = {}
        for k, kind in enumerate(kinds):
            for step in kind.steps[r].tolist():
                wanted.setdefault(step, []).append(k)
            out[k][:, r] = mixed(np.full(len(starts), kind.low * REPEATS + r, np.uint64))
        at = starts.copy()
        for step in range(last + 1):
            if step % 64 == 0:
                coins = mixed(hashes ^ np.uint64((SEED * (2 * r + 1) + step) & (1 << 64) - 1))
            for k in wanted.get(step, ()):
                out[k][:, r] = mixed(out[k][:, r] * np.uint64(3) + hashes[at])
            at = np.minimum(at + ((coins[at] >> np.uint64(step % 64)) & np.uint64(1)).astype(np.int64), stops - 1)
    return out


def holds(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of the hashes have their bit set; all if there is no bitmap."""
    if not len(bitmap):
        return np.ones(len(hashes), bool)
    at = (hashes >> np.uint64(64 - BITMAP)).astype(np.int64)
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


def regions(column: pa.Array, kinds: list[Class], runs: np.ndarray, filled: np.ndarray):
    """(row, first word, words, buckets) of the stretches of texts whose windows share buckets with items.

    ``runs`` and ``filled`` are the bitmaps of the items' runs and buckets.
    """
    words = Words(column, PUNCTUATION)
    hashes, bounds = words.hashes(), words.bounds
    if not len(hashes) or not kinds:
        return
    stop = np.repeat(bounds[1:], np.diff(bounds))
    place = np.arange(len(hashes))
    seen = {}
    for q in {k.q for k in kinds}:
        hit = np.zeros(len(hashes), np.int64)
        grams = _grams(hashes, q)
        hit[: len(grams)] = holds(runs, grams) & (place[: len(grams)] + q <= stop[: len(grams)])
        seen[q] = np.concatenate([[0], np.cumsum(hit)])
    gate = []
    for k in kinds:
        end = np.minimum(stop, place + k.span)
        gate.append((seen[k.q][np.maximum(end - k.q + 1, place)] - seen[k.q][place] >= k.runs) & (stop - place >= k.shortest))
    starts = np.flatnonzero(np.any(gate, axis=0))
    if not len(starts):
        return
    shared: dict[int, list[tuple[int, int, np.ndarray]]] = {}
    # Starts are walked in pieces of bounded size.
    for a in range(0, len(starts), 1 << 16):
        part = starts[a : a + (1 << 16)]
        lo, hi = int(part[0]), min(len(hashes), int(part[-1]) + STEPS * max(k.span for k in kinds) + 1)
        for k, own in zip(range(len(kinds)), buckets(hashes[lo:hi], part - lo, np.minimum(stop[part], hi) - lo, kinds), strict=True):
            mine = np.flatnonzero(gate[k][part])
            hit = holds(filled, own[mine].reshape(-1)).reshape(len(mine), REPEATS)
            for i in np.flatnonzero(hit.any(axis=1)).tolist():
                shared.setdefault(int(part[mine[i]]), []).append((k, 0, own[mine[i]][hit[i]]))
    # Starts that are gated side by side make a stretch with all words that their windows may hold.
    far = max(k.span for k in kinds)
    cut = np.flatnonzero((np.diff(starts) > far) | (stop[starts[1:]] != stop[starts[:-1]])) + 1
    have = np.array(sorted(shared), np.int64)
    for x, y in zip(np.append(0, cut).tolist(), np.append(cut, len(starts)).tolist(), strict=True):
        first, end = int(starts[x]), int(min(stop[starts[x]], starts[y - 1] + far))
        inside = have[np.searchsorted(have, first) : np.searchsorted(have, starts[y - 1], "right")]
        if len(inside):
            found = np.unique(np.concatenate([b for s in inside.tolist() for _, _, b in shared[s]]))
            row = int(words.text_of(np.array([first]))[0])
            yield row, first - int(bounds[row]), hashes[first:end], found


def bitmap(rows: DataFrame, column: str) -> np.ndarray:
    """A bitmap of the top bits of a column of hashes: a fixed number of rows of 4,096 bytes, whatever the number of hashes."""
    top = F.shiftrightunsigned(column, 64 - BITMAP) + 1  # bits and buckets count from 1
    parts = rows.groupBy(F.bitmap_bucket_number(top).alias("n")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(top)).alias("b")).collect()
    out = np.zeros(1 << BITMAP - 3, np.uint8)
    for n, b in parts:
        out[4096 * (n - 1) : 4096 * n] = np.frombuffer(b, np.uint8)
    return out


def _longs(values: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate(values) if values else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, values)]), pa.int32()), pa.array(flat.view(np.int64)))


class Benchmark:
    """The items as tables in the shared folder, and what texts need to know of them."""

    def __init__(self, benchmark: DataFrame, folder: str, item: str = "item_id", text: str = "text", similarity: float = SIMILARITY):
        spark = benchmark.sparkSession
        schema = "item long, item_id long, words array<bigint>, n int, runs array<bigint>"

        def cut(batches):
            from pyspark import TaskContext

            made = TaskContext.get().partitionId() << 32
            for batch in batches:
                words = Words(batch.column(1), PUNCTUATION)
                hashes, n = words.hashes(), np.diff(words.bounds)
                some = np.flatnonzero(n > 0)
                own = [hashes[words.bounds[k] : words.bounds[k + 1]] for k in some.tolist()]
                runs = [_grams(w, q) for w in own for q in [run_size(len(w), allowed(len(w), similarity))]]
                columns = [pa.array(made + some), batch.column(0).take(pa.array(some)), _longs(own), pa.array(n[some].astype(np.int32)), _longs(runs)]
                made += batch.num_rows
                yield pa.RecordBatch.from_arrays(columns, ["item", "item_id", "words", "n", "runs"])

        narrow = benchmark.select(F.col(f"`{item}`").cast("long").alias("item_id"), F.col(f"`{text}`").alias("text"))
        narrow.mapInArrow(cut, schema).write.parquet(f"{folder}/items")
        self.items = spark.read.schema(schema).parquet(f"{folder}/items")
        # One number for each length: bounded by the longest item.
        kinds = self.kinds = classes([n for (n,) in self.items.select("n").distinct().collect()], similarity)
        of = {k.low: i for i, k in enumerate(kinds)}

        def fill(batches):
            for batch in batches:
                for number, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    hashes, kind = np.array(own, np.int64).view(np.uint64), kinds[of[floor_of(len(own))]]
                    b = buckets(hashes, np.zeros(1, np.int64), np.array([len(own)]), [kind])[0][0]
                    yield pa.RecordBatch.from_arrays([pa.array(b.view(np.int64)), pa.array(np.full(REPEATS, number))], ["bucket", "item"])

        self.items.select("item", "words").mapInArrow(fill, "bucket long, item long").write.parquet(f"{folder}/buckets")
        self.buckets = spark.read.schema("bucket long, item long").parquet(f"{folder}/buckets")
        self.runs = bitmap(self.items.select(F.explode("runs").alias("run")), "run")
        self.filled = bitmap(self.buckets, "bucket")


def candidates(docs: DataFrame, made: Benchmark, folder: str, gated: bool = True) -> DataFrame:
    """(region, row, key, check, first, words, item): stretches of texts and the items that they share a bucket with."""
    spark = docs.sparkSession
    none = np.zeros(0, np.uint8)
    shared = spark.sparkContext.broadcast((made.kinds, made.runs if gated else none, made.filled))
    schema = "region long, row long, key long, check long, first long, words array<bigint>, buckets array<bigint>"

    def run(batches):
        from pyspark import TaskContext

        kinds, runs, filled = shared.value
        row = region = TaskContext.get().partitionId() << 32
        for batch in chunks(batches, "text", CHUNK_BYTES):
            found = list(regions(batch.column(1), kinds, runs, filled))
            at = np.array([x[0] for x in found], np.int64)
            columns = [pa.array(region + np.arange(len(found))), pa.array(row + at), batch.column(0).take(pa.array(at)), batch.column(2).take(pa.array(at)), pa.array([x[1] for x in found], pa.int64()), _longs([x[2] for x in found]), _longs([x[3] for x in found])]
            yield pa.RecordBatch.from_arrays(columns, ["region", "row", "key", "check", "first", "words", "buckets"])
            row += batch.num_rows
            region += len(found)

    docs.select("key", "text", F.xxhash64("text").alias("check")).mapInArrow(run, schema).write.parquet(f"{folder}/regions")
    rows = spark.read.schema(schema).parquet(f"{folder}/regions")
    pairs = rows.select("region", F.explode("buckets").alias("bucket")).join(made.buckets, "bucket").select("region", "item").distinct()
    return pairs.join(rows.drop("buckets"), "region")


def _held(docs: DataFrame, benchmark: DataFrame, key: str, text: str, item: str, similarity: float, gated: bool = True) -> DataFrame:
    """(row, key, check, item, item_id, edits, start, n): the best place of each row and item that it holds."""
    folder = new_path(docs.sparkSession, "benchmark")
    made = Benchmark(benchmark, f"{folder}/made", item=item, similarity=similarity)
    narrow = docs.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    own = made.items.select("item", "item_id", F.col("words").alias("own"))
    tried = candidates(narrow, made, folder, gated).join(own, "item").select("row", "key", "check", "item", "item_id", "first", "words", "own")

    def verify(batches):
        for batch in batches:
            found = [best(own, words, allowed(len(own), similarity)) for words, own in zip(batch.column(6).to_pylist(), batch.column(7).to_pylist(), strict=True)]
            at = [i for i, x in enumerate(found) if x is not None]
            take = pa.array(at, pa.int64())
            first = batch.column(5).to_pylist()
            size = batch.column(7).value_lengths().cast(pa.int64()).take(take)
            columns = [*(batch.column(i).take(take) for i in range(5)), *(pa.array([f(i) for i in at], pa.int64()) for f in (lambda i: found[i][0], lambda i: first[i] + found[i][1], lambda i: found[i][2])), size]
            yield pa.RecordBatch.from_arrays(columns, ["row", "key", "check", "item", "item_id", "edits", "start", "n", "size"])

    schema = "row long, key long, check long, item long, item_id long, edits long, start long, n long, size long"
    places = tried.mapInArrow(verify, schema)
    return places.groupBy("row", "key", "check", "item", "item_id", "size").agg(F.min(F.struct("edits", "start", "n")).alias("b")).select("row", "key", "check", "item", "item_id", "size", "b.*")


def matches(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", similarity: float = SIMILARITY, gated: bool = True) -> DataFrame:
    """(key, item_id, start_word, n_words, edits, similarity): the best match of each row and item."""
    held = _held(docs, benchmark, key, text, item, similarity, gated)
    return held.select("key", "item_id", F.col("start").alias("start_word"), F.col("n").alias("n_words"), "edits", (1 - F.col("edits") / F.col("size")).alias("similarity"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The rows of docs that hold no item."""
    folder = new_path(docs.sparkSession, "held")
    held = _held(docs, benchmark, key, text, "item_id", similarity).select(F.col("key").alias(f"{P}key"), F.col("check").alias(f"{P}check")).distinct()
    # Written out, so its size is known: Spark broadcasts it if small and else joins by shuffle.
    held.write.parquet(folder)
    held = docs.sparkSession.read.schema(held.schema).parquet(folder)
    same = F.col(f"`{key}`").cast("long").eqNullSafe(F.col(f"{P}key")) & (F.xxhash64(F.col(f"`{text}`").cast("string")) == F.col(f"{P}check"))
    return docs.join(held, same, "left_anti")


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document and item that it holds."""
    return matches(docs, benchmark).withColumnRenamed("key", "doc_id").withColumn("similarity", F.round("similarity", 6))
