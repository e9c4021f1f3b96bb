"""Whole-batch text work on Arrow buffers with numpy: code points, words, hashes."""

from __future__ import annotations

import ctypes
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WS = np.zeros(256, bool)
_IS_WS[[32, 9, 10, 11, 12, 13]] = True
#: ASCII but digits and letters.
PUNCTUATION = np.arange(256) < 128
PUNCTUATION[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False
_PLACES = [np.zeros(0, np.uint64)]
SEED = 0x9E3779B97F4A7C15


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


def chunks(batches: Iterator[pa.RecordBatch], text: str, limit: int) -> Iterator[pa.RecordBatch]:
    """The rows anew in batches of about ``limit`` bytes of text, or of one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(text)).cast(pa.large_string())
        at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        first = 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(at, at[first] + limit, "right")) - 1)
            yield batch.slice(first, last - first)
            first = last


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def places(n: int) -> np.ndarray:
    """A number for each of the first n places of a segment; kept up to 2**16 of them."""
    if n <= len(_PLACES[0]):
        return _PLACES[0][:n]
    size = 1 << max(10, (n - 1).bit_length())
    out = mixed(np.arange(1, size + 1, dtype=np.uint64) * np.uint64(SEED))
    if size <= 1 << 16:
        _PLACES[0] = out
    return out[:n]


def segment_hash(values: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """64-bit hash of segments of ``lens`` values, none empty, that lie one after another.

    Value and place are mixed together before the sum, so no pattern of values makes sums
    meet, as it does with powers of a base modulo 2**64. Chance may still: compare what meets.
    """
    if not len(lens):
        return np.zeros(0, np.uint64)
    first = np.cumsum(lens) - lens
    within = np.arange(len(values)) - np.repeat(first, lens)
    sums = np.add.reduceat(mixed(values.astype(np.uint64) ^ places(int(lens.max()))[within]), first)
    return mixed(sums + lens.astype(np.uint64) * np.uint64(0x632BE59BD9B4E019))


def returned() -> None:
    """Gives freed memory back to the system: a worker keeps what earlier steps took while the JVM needs its own."""
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def squeeze(*arrays: np.ndarray) -> bytes:
    """The arrays in one blob, packed."""
    body = b"".join(a.tobytes() for a in arrays)
    return np.array([len(arrays), *(len(a) for a in arrays)], "<i8").tobytes() + "".join(a.dtype.str.ljust(4) for a in arrays).encode() + zlib.compress(body, 1)


def loose(blob: bytes) -> list[np.ndarray]:
    """The arrays of squeeze."""
    n = int(np.frombuffer(blob, "<i8", 1)[0])
    lens = np.frombuffer(blob, "<i8", n, 8).tolist()
    kinds = blob[8 + 8 * n : 8 + 12 * n].decode()
    body, at, out = zlib.decompress(blob[8 + 12 * n :]), 0, []
    for k, m in enumerate(lens):
        kind = np.dtype(kinds[4 * k : 4 * k + 4].strip())
        out.append(np.frombuffer(body, kind, m, at))
        at += m * kind.itemsize
    return out


_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


class Words:
    """Words `[^\\x20\\x09-\\x0D]+` of a batch of texts, A-Z in lower case; ``between`` may name other bytes that part words.

    Word k is raw[starts[k]:ends[k]]; text d has the words bounds[d] to bounds[d + 1].
    """

    def __init__(self, column: pa.Array, between: np.ndarray = _IS_WS):
        raw, at = buffers(column)
        self.raw, n = _LOWER[raw], len(raw)
        space = between[raw]
        first = np.zeros(n + 1, bool)
        first[at] = True  # a text's bound parts words, too
        head = ~space
        tail = ~space
        head[1:] &= space[:-1] | first[1:n]
        tail[:-1] &= space[1:] | first[1:n]
        self.starts, self.ends = np.flatnonzero(head), np.flatnonzero(tail) + 1
        self.bounds = np.searchsorted(self.starts, at)

    def text_of(self, words: np.ndarray) -> np.ndarray:
        """The texts that words are of."""
        return np.searchsorted(self.bounds, words, "right") - 1

    def hashes(self, seed: int = SEED) -> np.ndarray:
        """A 64-bit hash of each word, read eight bytes at a time."""
        padded = np.zeros(len(self.raw) + 8, np.uint8)
        padded[: len(self.raw)] = self.raw
        eight = np.ndarray(len(self.raw) + 1, "<u8", padded, strides=(1,))
        left = self.ends - self.starts
        out = mixed(eight[self.starts] & _MASKS[np.minimum(left, 8)] ^ mixed(left.astype(np.uint64) + np.uint64(seed)))
        more, k = np.flatnonzero(left > 8), 8
        while len(more):
            out[more] = mixed(out[more] * np.uint64(5) + (eight[self.starts[more] + k] & _MASKS[np.minimum(left[more] - k, 8)]))
            k += 8
            more = more[left[more] > k]
        return out
