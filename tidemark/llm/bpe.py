"""Byte-level BPE over whole batches of texts.

Texts are parted into pre-tokens with array operations, equal pre-tokens are found by hash
and compared code point by code point, and only those a worker has not met are encoded; a
worker's memory of them is bounded in bytes.

``RankQueue`` encodes: all new pre-tokens of a batch lie in one linked list of byte
positions. A bucket for each merge rank holds the positions whose pair has that rank, a
three-level bitmap says which buckets are filled, and find-first-set gives the next rank.
Entries whose pair has changed meanwhile are stale and skipped. A pre-token's pairs merge
lowest rank first, leftmost first, as they would alone, so one queue serves them all, and a
pre-token of any length costs a logarithm-free step for each merge.

Defined cases: a null text counts as empty: no tokens, both hashes those of no bytes. Rows
are encoded one by one, so repeated rows and null ids get a row each. An empty table gives
an empty table. Ties of rank within a pre-token go to the leftmost pair. A very long text is a
batch of its own, whole. Columns other than key and text are not read, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import sys
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbatch import buffers, chunks, mixed, segment_hash

SPACE, LETTER, NUMBER, OTHER = range(4)
#: Unicode's White_Space, which \s means in the pattern.
WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
CHUNK_BYTES = 3 << 20
MEMORY_BYTES = 128 << 20
_classes: list[np.ndarray] = []


def classes() -> np.ndarray:
    """The class of every code point."""
    if not _classes:
        kind = {"L": LETTER, "N": NUMBER}
        out = np.fromiter((kind.get(unicodedata.category(chr(i))[0], OTHER) for i in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
        out[WHITE] = SPACE
        _classes.append(out)
    return _classes[0]


def code_points(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(code points, offsets) of a string column; null counts as empty."""
    raw, at = buffers(column)
    try:
        cp = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    except UnicodeDecodeError:
        texts = [raw[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(at, at[1:], strict=False)]
        return np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32), np.cumsum([0, *map(len, texts)])
    heads = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    return cp, heads[at]


def pretokens(cp: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where the matches of the public pattern start; none crosses a bound of ``at``."""
    n = len(cp)
    if not n:
        return np.zeros(0, np.int64)
    kind = classes()[cp]
    first = np.zeros(n + 4, bool)
    first[at] = True
    change = np.ones(n + 4, bool)
    change[1:n] = kind[1:] != kind[:-1]
    change |= first
    start = change[:n].copy()
    # The last of a run of white space stands apart; a space then joins what follows it.
    b = np.flatnonzero(start[1:] & ~first[1:n] & (kind[1:] != SPACE) & (kind[:-1] == SPACE)) + 1
    start[b - 1] = True
    start[b] = cp[b - 1] != 32
    # Contractions: an apostrophe that starts a match, then letters.
    a = np.flatnonzero(cp[: n - 1] == 39)
    a = a[start[a] & change[a] & change[a + 1] & ~first[a + 1] & (kind[a + 1] == LETTER)]
    if len(a):
        wide = np.concatenate([cp, np.zeros(4, np.uint32)])
        one, two = wide[a + 1], np.where(change[a + 2], 0, wide[a + 2])
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        for size, hit in ((2, a[short]), (3, a[long & ~short])):
            start[hit + 1] = False
            rest = hit + size
            start[rest[~change[rest]]] = True
    return np.flatnonzero(start)


def read_ranks(path: str) -> list[bytes]:
    """The tokens' bytes by rank."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    out = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        out[rank] = token
    return out


class Hashed:
    """Whole numbers to values of 0 or more, by open addressing: a key's slot is probed in steps of one."""

    def __init__(self, expected: int = 1024):
        self.count = 0
        self._empty(1 << max(10, (2 * expected).bit_length()))

    def _empty(self, size: int) -> None:
        self.keys, self.values, self.mask = np.zeros(size, np.int64), np.full(size, -1, np.int64), size - 1

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return (mixed(keys.view(np.uint64)) & np.uint64(self.mask)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key, or -1."""
        slot = self._home(keys)
        found = self.values[slot]
        other = self.keys[slot] != keys
        out = np.where(other, -1, found)
        open_ = np.flatnonzero(other & (found >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & self.mask
            at = slot[open_]
            found, hit = self.values[at], self.keys[at] == keys[open_]
            out[open_[hit]] = found[hit]
            open_ = open_[~hit & (found >= 0)]
        return out

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Keys without repeats; the value of one that is there already is replaced."""
        if 2 * (self.count + len(keys)) > len(self.keys):
            have = self.values >= 0
            keys, values, old = np.concatenate([self.keys[have], keys]), np.concatenate([self.values[have], values]), have.sum()
            self._empty(1 << (2 * len(keys)).bit_length())
            self.count = 0
            if old:
                self._insert(keys[:old], values[:old])
                keys, values = keys[old:], values[old:]
        self._insert(keys, values)

    def _insert(self, keys: np.ndarray, values: np.ndarray) -> None:
        slot = self._home(keys)
        self.count += len(keys)
        while len(keys):
            free = self.values[slot] < 0
            self.keys[slot[free]], self.values[slot[free]] = keys[free], values[free]  # of several, one stays
            won = self.keys[slot] == keys
            self.values[slot[won]] = values[won]
            keys, values, slot = keys[~won], values[~won], (slot[~won] + 1) & self.mask


class RankQueue:
    """Encoder of pre-tokens by merge ranks."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        rank = {t: r for r, t in enumerate(tokens) if t}
        self.byte_id = np.array([rank[bytes([i])] for i in range(256)], np.int64)
        pairs = {}
        for t, r in rank.items():
            for k in range(1, len(t)):
                x, y = rank.get(t[:k]), rank.get(t[k:])
                if x is not None and y is not None:
                    pairs[x << 32 | y] = r
        self.pairs = Hashed(len(pairs))
        self.pairs.add(np.fromiter(pairs, np.int64, len(pairs)), np.fromiter(pairs.values(), np.int64, len(pairs)))

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, or -1."""
        return self.pairs.find(left << 32 | right)

    def encode(self, raw: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids of each) for pre-tokens of ``lens`` bytes that lie one after another in ``raw``."""
        n = len(raw)
        word = np.repeat(np.arange(len(lens)), lens)
        token = self.byte_id[raw]
        last = np.cumsum(lens)[lens > 0] - 1
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[last] = -1
        before[(last + 1)[last + 1 < n]] = -1
        before[:1] = -1
        rank = np.full(n, -1, np.int64)
        live = np.flatnonzero(after >= 0)
        rank[live] = self.rank_of(token[live], token[live + 1])
        buckets: dict[int, list[np.ndarray]] = {}
        low, mid, top = [0] * (len(self.tokens) // 64 + 1), [0] * (len(self.tokens) // 4096 + 1), 0

        def push(at: np.ndarray) -> None:
            nonlocal top
            at = at[rank[at] >= 0]
            if not len(at):
                return
            by = rank[at]
            order = np.argsort(by, kind="stable")
            at, by = at[order], by[order]
            cut = np.flatnonzero(by[1:] != by[:-1]) + 1
            for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(at)], strict=True):
                r = int(by[a])
                buckets.setdefault(r, []).append(at[a:b])
                low[r >> 6] |= 1 << (r & 63)
                mid[r >> 12] |= 1 << (r >> 6 & 63)
                top |= 1 << (r >> 12)

        push(live)
        gone: list[np.ndarray] = []
        while top:
            i = (top & -top).bit_length() - 1
            i = i << 6 | (mid[i] & -mid[i]).bit_length() - 1
            r = i << 6 | (low[i] & -low[i]).bit_length() - 1
            low[r >> 6] &= ~(1 << (r & 63))
            if not low[r >> 6]:
                mid[r >> 12] &= ~(1 << (r >> 6 & 63))
                if not mid[r >> 12]:
                    top &= ~(1 << (r >> 12))
            held = buckets.pop(r)
            at = held[0] if len(held) == 1 else np.unique(np.concatenate(held))
            at = at[rank[at] == r]
            if not len(at):
                continue
            if len(at) > 1:
                chained = at[1:] == after[at[:-1]]
                if chained.any():  # of pairs that overlap, the leftmost merges
                    k = np.arange(len(at))
                    head = np.maximum.accumulate(np.where(np.concatenate([[True], ~chained]), k, 0))
                    at = at[(k - head) % 2 == 0]
                twice = np.flatnonzero(word[at[1:]] == word[at[:-1]])
                if len(twice):
                    later = self._out_of_turn(at, r, word, token, after, before)
                    if later is not None:
                        push(at[later])
                        at = at[~later]
            right = after[at]
            beyond = after[right]
            token[at] = r
            after[at] = beyond
            before[beyond[beyond >= 0]] = at[beyond >= 0]
            gone.append(right)
            rank[right] = -1
            rank[at] = -1
            left = before[at]
            left = left[left >= 0]
            rank[left] = self.rank_of(token[left], token[after[left]])
            more = at[beyond >= 0]
            rank[more] = self.rank_of(token[more], token[after[more]])
            push(np.unique(np.concatenate([left, more])))
        dead = np.zeros(n, bool)
        for at in gone:
            dead[at] = True
        return token[~dead], np.bincount(word[~dead], minlength=len(lens))

    def _out_of_turn(self, at, r, word, token, after, before):
        """Mask of positions that must wait, as a pair of lower rank arises in their pre-token first; None if there are none."""
        right = after[at]
        beyond = after[right]
        merged = np.full(len(at), r, np.int64)
        worst = np.zeros(len(at), bool)
        has = beyond >= 0
        x = self.rank_of(merged[has], token[beyond[has]])
        worst[has] |= (x >= 0) & (x < r)
        left = before[at]
        has = left >= 0
        t = token[left[has]]
        # What stands before may be the merge just done in the same pre-token.
        joined = np.concatenate([[False], (right[:-1] == left[1:])])[has]
        x = self.rank_of(np.where(joined, r, t), merged[has])
        worst[has] |= (x >= 0) & (x < r)
        if not worst.any():
            return None
        bad = np.zeros(int(word[at].max()) + 1, bool)
        bad[word[at[worst]]] = True
        later = np.concatenate([[False], word[at[1:]] == word[at[:-1]]]) & bad[word[at]]
        return later if later.any() else None


class Grown:
    """An array that grows by doubling, so that adding to it copies each value a few times at most."""

    def __init__(self, kind):
        self.held, self.size = np.zeros(1024, kind), 0

    def add(self, values: np.ndarray) -> int:
        """Where the values begin."""
        first, self.size = self.size, self.size + len(values)
        if self.size > len(self.held):
            held = np.zeros(max(self.size, 2 * len(self.held)), self.held.dtype)
            held[:first] = self.held[:first]
            self.held = held
        self.held[first : self.size] = values
        return first


def _spread(first: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The places first, first + 1, ... of each of the segments."""
    return np.repeat(first - (np.cumsum(lens) - lens), lens) + np.arange(int(lens.sum()))


class Memory:
    """Ids of the pre-tokens met so far, by hash; every hit is compared with the code points it stands for.

    Beyond ``limit`` bytes the memory is emptied; what one batch adds to it is bounded by the batch.
    """

    ENTRY = 96  # bytes of an entry in the table and the arrays, without its code points and ids

    def __init__(self, encode: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], limit: int = MEMORY_BYTES):
        self.encode, self.limit = encode, limit
        self.clear()

    def clear(self) -> None:
        self.slot = Hashed()
        self.ids, self.cp = Grown(np.uint32), Grown(np.uint32)
        self.start, self.count, self.cp_start, self.cp_count = (Grown(np.int64) for _ in range(4))

    def bytes(self) -> int:
        return 4 * (self.ids.size + self.cp.size) + self.ENTRY * self.count.size

    def _same(self, points: np.ndarray, lens: np.ndarray, slot: np.ndarray) -> np.ndarray:
        """Whether each of the pre-tokens, which lie one after another, is the one that its slot holds."""
        same = self.cp_count.held[slot] == lens
        if not same.all():
            points, lens, slot = points[np.repeat(same, lens)], lens[same], slot[same]
        unlike = np.flatnonzero(points != self.cp.held[_spread(self.cp_start.held[slot], lens)])
        if len(unlike):
            same[np.flatnonzero(same)[np.searchsorted(np.cumsum(lens), unlike, "right")]] = False
        return same

    def _put(self, cp: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """Encodes pre-tokens; their slots."""
        points = cp[_spread(starts, lens)]
        ids, count = self.encode(points, lens)
        self.start.add(self.ids.add(ids.astype(np.uint32)) + np.cumsum(count) - count)
        self.cp_start.add(self.cp.add(points) + np.cumsum(lens) - lens)
        self.cp_count.add(lens)
        return self.count.add(count) + np.arange(len(lens))

    def batch(self, cp: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds): text d has ids[bounds[d]:bounds[d + 1]]."""
        starts = pretokens(cp, at)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(at), np.int64)
        if self.bytes() > self.limit:
            self.clear()
        lens = np.diff(np.append(starts, len(cp)))
        group, unique = pd.factorize(segment_hash(cp, lens).view(np.int64))
        lead = np.empty(len(unique), np.int64)
        lead[group[::-1]] = np.arange(len(group))[::-1]
        slot = self.slot.find(unique)
        held = np.flatnonzero(slot >= 0)
        a, n = starts[lead[held]], lens[lead[held]]
        slot[held[~self._same(cp[_spread(a, n)], n, slot[held])]] = -1
        new = np.flatnonzero(slot < 0)
        if len(new):
            slot[new] = self._put(cp, starts[lead[new]], lens[lead[new]])
            self.slot.add(unique[new], slot[new])
        mine = slot[group]
        odd = np.flatnonzero(~self._same(cp, lens, mine))
        if len(odd):  # another pre-token has the same hash
            mine[odd] = self._put(cp, starts[odd], lens[odd])
        count = self.count.held[mine]
        return self.ids.held[_spread(self.start.held[mine], count)], np.concatenate([[0], np.cumsum(count)])[np.searchsorted(starts, at)]


def utf8_of(cp: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of code point segments, and their lengths."""
    raw = np.frombuffer(cp.astype("<u4").tobytes().decode("utf-32-le").encode("utf-8"), np.uint8)
    width = 1 + (cp >= 0x80).astype(np.int64) + (cp >= 0x800) + (cp >= 0x10000)
    return raw, np.add.reduceat(width, np.cumsum(lens) - lens)


_workers: dict[str, tuple] = {}


def codec(path: str) -> tuple[Memory, np.ndarray, np.ndarray, np.ndarray]:
    """A worker's encoder of the rank file, and its decoder: all bytes, and where each id's start and their number."""
    if path not in _workers:
        tokens = read_ranks(path)
        queue = RankQueue(tokens)
        size = np.array([len(t) for t in tokens], np.int64)
        _workers[path] = Memory(lambda cp, lens: queue.encode(*utf8_of(cp, lens))), np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(size) - size, size
    return _workers[path]


def decode(ids: np.ndarray, table: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, bounds): id k has the bytes from bounds[k] to bounds[k + 1]."""
    n = size[ids]
    bounds = np.concatenate([[0], np.cumsum(n)])
    return table[np.repeat(start[ids] - bounds[:-1], n) + np.arange(bounds[-1])], bounds


def encoded(batches: Iterator[pa.RecordBatch], path: str, text: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(batch, ids, bounds) of each chunk of rows."""
    memory = codec(path)[0]
    for batch in chunks(batches, text, CHUNK_BYTES):
        yield batch, *memory.batch(*code_points(batch.column(batch.schema.get_field_index(text))))


def encode_texts(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids array<int>) for each row of docs."""

    def run(batches):
        for batch, ids, bounds in encoded(batches, path, "text"):
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["key", "ids"])

    out = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    return out.mapInArrow(run, f"key {out.schema[0].dataType.simpleString()}, ids array<int>").withColumnRenamed("key", key)


def decode_ids(frame: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, bytes binary) for each row of (key, ids array<int>)."""

    def run(batches):
        _, *decoder = codec(path)
        for batch in batches:
            out = [decode(np.asarray(x.as_py() or [], np.int64), *decoder)[0].tobytes() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["key", "bytes"])

    out = frame.select(F.col(f"`{key}`").alias("key"), F.col(f"`{ids}`").alias("ids"))
    return out.mapInArrow(run, f"key {out.schema[0].dataType.simpleString()}, bytes binary").withColumnRenamed("key", key)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """One row for each document: doc_id, n_tokens, ids_sha256, decoded_sha256."""

    def run(batches):
        _, *decoder = codec(path)
        for batch, ids, bounds in encoded(batches, path, "text"):
            back, at = decode(ids, *decoder)
            wide, at = ids.astype("<u4"), at[bounds]
            rows = [batch.column(0), pa.array(np.diff(bounds))]
            rows.append(pa.array([hashlib.sha256(wide[a:b]).hexdigest() for a, b in zip(bounds, bounds[1:], strict=False)]))
            rows.append(pa.array([hashlib.sha256(back[a:b]).hexdigest() for a, b in zip(at, at[1:], strict=False)]))
            yield pa.RecordBatch.from_arrays(rows, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    out = docs.select("doc_id", "text")
    return out.mapInArrow(run, f"doc_id {out.schema[0].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
