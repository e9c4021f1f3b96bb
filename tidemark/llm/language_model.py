"""LM scoring with a hierarchical Pitman-Yor model.

A token is a word, or the end of a text; its context is the token before it, the end for the
first. Every context is a restaurant, and all of them share the root as their parent, whose
base is uniform over the V training tokens and one unknown. A cell (context, token) with c
customers has t tables, and each table is a customer of the root. Gibbs sweeps draw the
tables of every cell and of every token at the root given the parents' probabilities and all
other tables; the predictive probabilities of the sweeps kept are averaged, and a text's
score is the sum of their logarithms.

Every cell is drawn from its exact conditional given the rest, however many customers it has:
by generalised Stirling numbers up to ``STIRLING`` customers, beyond by the law of a sum of
Sibuya variables, which these numbers are but for known factors and whose logarithm an integral
gives to a millionth at least. A sweep sees the totals of the restaurants and the root as the one
before left them.

Everything is split into buckets whose number grows with the data, and texts are read once,
in chunks, which exchange dictionaries with the buckets, never tokens: first the chunk's
distinct tokens, for a number each, small for frequent ones, and a count; then its distinct
cells by the token's bucket, and what the contexts' buckets know of its tokens. The cells of
a token with more than a ``HOT``-th of a bucket's share of all tokens are dealt by context
instead: HOT such tokens a bucket there can be at most, and these alone reach the driver.
The number of buckets does not follow the session's partitions, as any two buckets exchange
a row a sweep; beyond MOST_BUCKETS buckets grow instead.

Defined cases: null or empty texts are one end token; a null id counts as the text "" for
the split; rows are scored one by one, repeated ones alike; without training rows N = V = 0
and scores are 0 (the unknown token is all there is); an empty table gives an empty table; a
very long text is a chunk of its own, scored whole; other columns are not read. Ids are whole
numbers. Words with one 64-bit hash, if two ever were, would be one token.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import delete, new_path, release, spread
from .textbatch import Words, chunks, loose, mixed, returned, squeeze

CHUNK_BYTES = 6 << 20
BUCKET_BYTES = 8 << 20
LEAST_BUCKETS, MOST_BUCKETS = 6, 4096
FOLDS, HELD_OUT = 5, 1
BURN_IN, KEPT = 2, 2
STIRLING = 1024
MOVES = 32  # of Tables, by default; no query makes them
HOT = 4
THETA = (1.0, 1.0)  # root, contexts
END = np.uint64(0x2545F4914F6CDD1D)
SEED = 20240131
_ROWS = "chunk long, bucket long, payload binary"


def held_out(key: int | None) -> bool:
    return zlib.crc32(b"" if key is None else str(key).encode()) % FOLDS == HELD_OUT


def _steps(x: np.ndarray) -> np.ndarray:
    """Differences, which pack better; np.cumsum brings x back."""
    return np.diff(x, prepend=0)


_WIDTHS = [(np.dtype("u1"), 0, 1 << 8), (np.dtype("<u2"), 0, 1 << 16), (np.dtype("<i4"), -(1 << 31), 1 << 31)]


def _packed(*arrays: np.ndarray) -> bytes:
    """Whole numbers in the width that takes the least room, those beyond it as a list of places and values; other arrays as they are."""
    flat, none = [], np.zeros(0, np.int64)
    for x in arrays:
        if x.dtype.kind == "f":
            flat += [x, none, none]
            continue
        x = x.astype(np.int64)
        costs = [kind.itemsize * len(x) + 12 * np.count_nonzero((x < low) | (x >= high)) for kind, low, high in _WIDTHS]
        if min(costs) > 8 * len(x):
            flat += [x, none, none]
            continue
        kind, low, high = _WIDTHS[int(np.argmin(costs))]
        beyond = np.flatnonzero((x < low) | (x >= high))
        small = x.astype(kind)
        small[beyond] = 0
        flat += [small, beyond.astype("<u4"), x[beyond]]
    return squeeze(*flat)


def _unpacked(blob: bytes) -> list[np.ndarray]:
    """The arrays of _packed, whole numbers in 64 bits."""
    parts, out = loose(blob), []
    for small, beyond, values in zip(parts[::3], parts[1::3], parts[2::3], strict=True):
        if small.dtype.kind != "f":
            small = small.astype(np.int64)
            small[beyond] = values
        out.append(small)
    return out


def _table(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    returned()  # what made the rows is free by now
    chunk, bucket, payload = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.table({"chunk": pa.array(chunk, pa.int64()), "bucket": pa.array(bucket, pa.int64()), "payload": pa.array(payload, pa.binary())})


# Chunks ----------------------------------------------------------------------------------


def _texts(batch: pa.RecordBatch, buckets: int):
    """(bucket, payload) of a chunk of texts: -1 for its sequences of codes, then each bucket's distinct tokens with their training counts.

    Codes number the tokens by bucket and hash, so the buckets' answers in order are by code.
    """
    words, keys = Words(batch.column(1)), batch.column(0).to_pylist()
    n, docs = len(words.starts), batch.num_rows
    count = np.diff(words.bounds) + 1
    token = np.full(n + docs, END)
    inner = np.ones(n + docs, bool)
    inner[np.cumsum(count) - 1] = False
    token[inner] = words.hashes()
    code, unique = pd.factorize(token)
    bucket = (unique % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((unique, bucket))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    code = rank[code]
    unique, bucket = unique[order], bucket[order]
    train = np.array([not held_out(k) for k in keys], bool)
    seen = np.bincount(code, weights=np.repeat(train, count), minlength=len(unique)).astype("<u4")
    null = np.array([k is None for k in keys], "u1")
    yield -1, squeeze(np.array([k or 0 for k in keys], "<i8"), null, count.astype("<u4"), code.astype("<u4"))
    cuts = np.searchsorted(bucket, np.arange(buckets + 1))
    for b in np.unique(bucket).tolist():
        yield b, squeeze(unique[cuts[b] : cuts[b + 1]].astype("<u8"), seen[cuts[b] : cuts[b + 1]])


class Chunk:
    """A chunk's sequences with the numbers of their tokens, and its distinct cells by bucket, token and context."""

    def __init__(self, texts: bytes, answers: list[bytes], buckets: int, hot: np.ndarray):
        self.keys, self.null, count, code = loose(texts)
        self.count, self.code = count.astype(np.int64), code.astype(np.int64)
        parts = [_unpacked(p) for p in answers]
        ids = np.concatenate([np.cumsum(p[0]) for p in parts])  # by code, ordered by hash within a bucket
        self.ids, self.seen = ids, np.concatenate([p[1] for p in parts])
        end = int(self.code[-1])  # every text has an end
        before = np.concatenate([[end], self.code[:-1]])
        before[np.cumsum(self.count)[:-1]] = end
        # Cells as pairs of ranks: of the token by its bucket and number, of the context by its number.
        m = len(ids)
        by_bucket, by_number = np.lexsort((ids, ids % buckets)), np.argsort(ids)
        rank, at = np.empty((2, m), np.int64)
        rank[by_bucket], at[by_number] = np.arange(m), np.arange(m)
        pair, self.cell = np.unique(rank[self.code] * m + at[before], return_inverse=True)
        self.token, self.context = by_bucket[pair // m], by_number[pair % m]  # codes
        self.w, self.u = ids[self.token], ids[self.context]
        self.home = home_of(self.w, self.u, buckets, hot)
        if len(hot):  # their cells go to other buckets
            order = np.argsort(self.home, kind="stable")
            back = np.empty(len(order), np.int64)
            back[order] = np.arange(len(order))
            self.cell = back[self.cell]
            self.token, self.context, self.w, self.u, self.home = (x[order] for x in (self.token, self.context, self.w, self.u, self.home))

    def asked(self, buckets: int):
        """(bucket, payload) of the cells that a bucket holds: tokens, cells of each, contexts, training counts."""
        train = np.repeat([not held_out(None if n else k) for k, n in zip(self.keys.tolist(), self.null.tolist(), strict=True)], self.count)
        seen = np.bincount(self.cell, weights=train, minlength=len(self.w)).astype("<u4")
        cuts = np.searchsorted(self.home, np.arange(buckets + 1))
        for b in np.unique(self.home).tolist():
            part = slice(cuts[b], cuts[b + 1])
            w = self.w[part]
            head = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
            yield b, _packed(_steps(w[head]), np.diff(np.append(head, len(w))), _steps(self.u[part]), seen[part])


def home_of(w: np.ndarray, u: np.ndarray, buckets: int, hot: np.ndarray) -> np.ndarray:
    """The bucket of each cell: its token's, or for hot tokens the context's."""
    spread_ = (mixed(u.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
    return np.where(np.isin(w, hot), spread_, w % buckets)


def _asked(payload: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct tokens, cells of each, contexts, training counts)."""
    w, per, u, seen = _unpacked(payload)
    return np.cumsum(w), per, np.cumsum(u), seen


# Vocabulary ------------------------------------------------------------------------------


def _numbered(table: pa.Table, buckets: int) -> pa.Table:
    """Each chunk's answer: the numbers and training counts of its tokens. Chunk -1: the bucket's vocabulary.

    The frequent tokens of a bucket come first, and number k of bucket b is k * buckets + b.
    """
    bucket, parts = table["bucket"][0].as_py(), [loose(x) for x in table["payload"].to_pylist()]
    unique, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    count = np.bincount(at, weights=np.concatenate([p[1] for p in parts]), minlength=len(unique)).astype(np.int64)
    number = np.empty(len(unique), np.int64)
    number[np.lexsort((unique, -count))] = np.arange(len(unique)) * buckets + bucket
    cuts = np.cumsum([0, *(len(p[0]) for p in parts)])
    rows = [(c, bucket, _packed(_steps(number[at[x:y]]), count[at[x:y]])) for c, x, y in zip(table["chunk"].to_pylist(), cuts, cuts[1:], strict=False)]
    return _table([*rows, (-1, bucket, squeeze(number, count))])


# Seating ---------------------------------------------------------------------------------

_stirling: dict[float, np.ndarray] = {}


def log_stirling(d: float) -> np.ndarray:
    """log of the generalised Stirling numbers S(c, t) for discount d, c and t up to STIRLING."""
    if d not in _stirling:
        out = np.full((STIRLING + 1, STIRLING + 1), -np.inf)
        out[1, 1] = 0
        with np.errstate(divide="ignore"):
            for c in range(1, STIRLING):
                t = np.arange(1, STIRLING + 1)
                out[c + 1, 1:] = np.logaddexp(out[c, :-1], out[c, 1:] + np.log(np.maximum(c - t * d, 0)))
        _stirling[d] = out
    return _stirling[d]


def seat(c: np.ndarray, t: np.ndarray, tables: np.ndarray, parent: np.ndarray, d: float, theta: float, rng: np.random.Generator) -> np.ndarray:
    """New table counts of cells with c customers, given all other tables of their restaurants: draws from the conditional."""
    out = np.minimum(c, 1)
    others, log_s = np.maximum(tables - t, 0), log_stirling(d)
    order = np.argsort(c, kind="stable")
    found = np.unique(c)
    found = found[(found > 1) & (found <= STIRLING)]
    for n, x, y in zip(found.tolist(), *(np.searchsorted(c[order], found, side) for side in ("left", "right")), strict=True):
        rows = (1 << 19) // n
        for a in range(x, y, rows):
            part, steps = order[a : min(y, a + rows)], np.arange(n)
            rising = np.cumsum(np.log(theta + d * (others[part][:, None] + steps)), axis=1)
            weight = log_s[n, 1 : n + 1] + rising + (steps + 1) * np.log(parent[part])[:, None]
            weight = np.cumsum(np.exp(weight - weight.max(axis=1, keepdims=True)), axis=1)
            out[part] = 1 + np.count_nonzero(weight < (rng.random(len(part)) * weight[:, -1])[:, None], axis=1)
    large = np.flatnonzero(c > STIRLING)
    for a in range(0, len(large), 256):
        part = large[a : a + 256]
        out[part] = _seat_large(c[part], others[part], parent[part], d, theta, rng)
    return out


#: Of the integrals: nodes, reach in widths of the peak, least c * z of a bent path, least z of a straight one; nodes of the interpolation over t.
NODES, WIDTHS, BENT, STRAIGHT, CHEBYSHEV = 48, 9.0, 8.0, 0.3, 20


def _sibuya(z: np.ndarray, d: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The logarithm of the generating function F of Sibuya(d) at exp(-z), and its first two derivatives."""
    y, e = -np.expm1(-z), np.exp(-z)
    f = -np.expm1(d * np.log(y))
    first = -d * e * y ** (d - 1) / f
    return np.log(f), first, (d * e * y ** (d - 1) - d * (d - 1) * e * e * y ** (d - 2)) / f - first * first


_LOG_Z = -200.0, np.log(30.0)


def log_sibuya_sum(c: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    """log P(X_1 + ... + X_t = c) for independent Sibuya(d); t may be broken.

    c! / (t! d^t) times it are the generalised Stirling numbers of c and t. It is the integral of
    exp(c z) F(exp(-z))^t, which goes through the saddle of the integrand: straight up where that
    is far from the branch at 0, on a parabola round the branch else; where the saddle is too
    near to the branch, exp(c z) is taken off, whose integral is zero.
    """
    c, t = c.astype(np.float64), t.astype(np.float64)
    low, high = (np.full(len(c), x) for x in _LOG_Z)
    for _ in range(60):
        mid = (low + high) / 2
        falls = -t * _sibuya(np.exp(mid), d)[1] > c
        low, high = np.where(falls, mid, low), np.where(falls, high, mid)
    saddle, least = np.exp(low), BENT / c
    near = (saddle < least) & (-t * _sibuya(least, d)[0] < 14)
    straight = saddle >= STRAIGHT
    z0 = np.where(near, least, saddle)
    log_f, first, second = _sibuya(z0, d)
    width = np.where(straight, t * second, 2 * z0 * (c + t * first) + 4 * z0 * z0 * t * second) ** -0.5
    reach = np.where(straight, np.minimum(np.pi, WIDTHS * width), WIDTHS * width)
    x = reach[:, None] * (np.arange(NODES + 1) / NODES)
    bend = 1 + 1j * x
    z = np.where(straight[:, None], z0[:, None] + 1j * x, z0[:, None] * bend * bend)
    slope = np.where(straight[:, None], 1, 2 * z0[:, None] * bend)
    power = t[:, None] * np.log1p(-((-np.expm1(-z)) ** d))
    top = c * z0 + np.where(near, 0, t * log_f)
    value = np.exp(c[:, None] * z - top[:, None] + np.where(near[:, None], 0, power))
    value = (np.where(near[:, None], value * np.expm1(np.where(near[:, None], power, 0)), value) * slope).real
    whole = value.sum(axis=1) - (value[:, 0] + value[:, -1]) / 2
    with np.errstate(divide="ignore"):
        return np.where(t >= c, t * np.log(d), np.log(whole * reach / (NODES * np.pi)) + top)


def _law(c: np.ndarray, others: np.ndarray, parent: np.ndarray, d: float, theta: float):
    """For each cell the least of a range of table counts and their logarithmic weights; beyond it are no more than exp(-30) of all.

    The weights are log-concave. Their peak is found by the slope of the integrand at its saddle;
    over the range, the logarithm of the law less log t is a polynomial.
    """
    a = theta / d + others
    low, high = (np.full(len(c), x) for x in _LOG_Z)

    def slope(log_z):
        log_f, first, _ = _sibuya(np.exp(log_z), d)
        t = np.clip(-c / first, 1e-9, c)
        return np.log(parent) + np.log((a + t) / (t + 0.5)) + log_f, t

    for _ in range(60):
        mid = (low + high) / 2
        rises = slope(mid)[0] > 0
        low, high = np.where(rises, mid, low), np.where(rises, high, mid)
    t = slope(low)[1]
    (up, t_up), (down, t_down) = slope(low + 0.02), slope(low - 0.02)
    half = 9 * np.sqrt(np.clip((t_up - t_down) / np.maximum(down - up, 1e-12), 0, c)) + 16
    first, last = np.clip(np.floor(t - half), 1, c - 1).astype(np.int64), np.clip(np.ceil(t + half), 2, c).astype(np.int64)
    nodes = np.cos(np.pi * (np.arange(CHEBYSHEV) + 0.5) / CHEBYSHEV)
    fit = np.polynomial.chebyshev.chebvander(nodes, CHEBYSHEV - 1)
    # Broken t are none near c, where F(x)^t is felt at x = 0; short ranges are taken whole, too.
    whole = (last - first < 6 * CHEBYSHEV) | (last > c - 64)
    at = [np.arange(x, y + 1) if w else (x + y) / 2 + (y - x) / 2 * nodes for w, x, y in zip(whole.tolist(), first.tolist(), last.tolist(), strict=True)]
    sizes = [len(x) for x in at]
    flat = np.concatenate(at).astype(np.float64)
    law = np.split(np.concatenate([log_sibuya_sum(x, y, d) for x, y in zip(*(np.array_split(v, len(flat) // 4096 + 1) for v in (np.repeat(c, sizes), flat)), strict=True)]), np.cumsum(sizes)[:-1])
    for k in range(len(c)):
        t, h = np.arange(first[k], last[k] + 1), law[k]
        if not whole[k]:
            series = np.linalg.solve(fit, h - np.log(at[k]))
            h = np.polynomial.chebyshev.chebval((2 * t - first[k] - last[k]) / (last[k] - first[k]), series) + np.log(t)
        steps = np.log(parent[k]) + np.log((a[k] + t[:-1]) / (t[:-1] + 1))
        yield int(first[k]), h + np.concatenate([[0], np.cumsum(steps)])


def _seat_large(c: np.ndarray, others: np.ndarray, parent: np.ndarray, d: float, theta: float, rng: np.random.Generator) -> np.ndarray:
    out = np.empty(len(c), np.int64)
    for k, (first, weight) in enumerate(_law(c, others, parent, d, theta)):
        weight = np.cumsum(np.exp(weight - weight.max()))
        out[k] = first + np.searchsorted(weight, rng.random() * weight[-1], "right")
    return out


class Tables:
    """The sizes of the tables of cells, seated by moves of single customers: cell i has sizes[bounds[i]:bounds[i + 1]].

    Another way to the law of seat, which needs many moves from far off; the model does not take it.
    """

    def __init__(self, sizes: np.ndarray, t: np.ndarray):
        self.sizes, self.t = sizes.astype(np.int64), t.astype(np.int64)
        self.bounds = np.concatenate([[0], np.cumsum(self.t)])

    @classmethod
    def one_each(cls, c: np.ndarray) -> Tables:
        return cls(c, np.ones(len(c), np.int64))

    def take(self, these: np.ndarray) -> Tables:
        n = self.t[these]
        return Tables(self.sizes[np.repeat(self.bounds[these] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))], n)

    def reseated(self, c: np.ndarray, tables: np.ndarray, parent: np.ndarray, d: float, theta: float, rng: np.random.Generator, moves: int = MOVES) -> Tables:
        """The cells with c customers, after moves of their customers; ``tables`` are those of the whole restaurants."""
        out: list[tuple[np.ndarray, np.ndarray]] = []
        others = np.maximum(tables - self.t, 0)
        kind = np.ceil(np.log2(self.t + 1)).astype(np.int64)
        for k in np.unique(kind).tolist():
            these = np.flatnonzero(kind == k)
            for a in range(0, len(these), max(1, (1 << 22) // (2**k + moves))):
                part = these[a : a + max(1, (1 << 22) // (2**k + moves))]
                out.append((part, _moved(self.take(part), c[part], others[part], parent[part], d, theta, rng, moves)))
        t, sizes = np.zeros(len(c), np.int64), np.zeros(0, np.int64)
        for part, dense in out:
            t[part] = (dense > 0).sum(axis=1)
        bounds, sizes = np.concatenate([[0], np.cumsum(t)]), np.zeros(int(t.sum()), np.int64)
        for part, dense in out:
            n = t[part]
            sizes[np.repeat(bounds[part] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))] = dense[dense > 0]
        return Tables(sizes, t)


def _picked(weight: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of each row, the column in whose share of the weights ``at`` lies."""
    return np.minimum((np.cumsum(weight, axis=1) <= at[:, None]).sum(axis=1), weight.shape[1] - 1)


def _moved(tables: Tables, c, others, parent, d, theta, rng, moves: int) -> np.ndarray:
    """Sizes, a row for each cell, zeros where there is no table."""
    n = len(c)
    dense, row = np.zeros((n, int(tables.t.max()) + moves), np.int64), np.arange(n)
    dense[np.repeat(row, tables.t), np.arange(len(tables.sizes)) - np.repeat(tables.bounds[:-1], tables.t)] = tables.sizes
    have = dense.sum(axis=1)
    while (late := np.flatnonzero(have != c)).size:  # customers who came or went since, in blocks
        block = np.minimum(np.abs(c - have)[late], np.maximum(1, have[late] // 8))
        come = late[c[late] > have[late]]
        if len(come):
            dense = dense if (dense[come] == 0).any(axis=1).all() else np.pad(dense, ((0, 0), (0, moves)))
            weight = np.maximum(dense[come] - d, 0) * (dense[come] > 0)
            new = (theta + d * (others[come] + (dense[come] > 0).sum(axis=1))) * parent[come]
            weight[np.arange(len(come)), (dense[come] == 0).argmax(axis=1)] = new
            dense[come] += rng.multinomial(block[c[late] > have[late]], weight / weight.sum(axis=1, keepdims=True))
        go = late[c[late] < have[late]]
        if len(go):
            dense[go] -= _leaving(dense[go], block[c[late] < have[late]], rng)
        have = dense.sum(axis=1)
    t = (dense > 0).sum(axis=1)
    for _ in range(moves):
        k = _picked(dense, rng.random(n) * c)  # a customer leaves
        dense[row, k] -= 1
        t = t - (dense[row, k] == 0)
        new = (theta + d * (others + t)) * parent
        weight = np.where(dense > 0, dense - d, 0)
        at = rng.random(n) * (c - 1 - d * t + new)
        opens = at >= c - 1 - d * t
        k = np.where(opens, (dense == 0).argmax(axis=1), _picked(weight, at))
        full = opens & (dense[row, k] > 0)
        if full.any():
            dense = np.pad(dense, ((0, 0), (0, moves)))
            k = np.where(full, (dense == 0).argmax(axis=1), k)
        t = t + (dense[row, k] == 0)
        dense[row, k] += 1
    return dense


def _leaving(dense: np.ndarray, block: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """How many of block customers, drawn at random, leave each table."""
    out, left, rest = np.zeros_like(dense), block.copy(), dense.sum(axis=1)
    for k in range(dense.shape[1]):
        rest = rest - dense[:, k]
        out[:, k] = np.where(left > 0, rng.hypergeometric(dense[:, k], np.maximum(rest, 0), np.minimum(left, dense[:, k] + rest)), 0)
        left = left - out[:, k]
    return out


class Seats:
    """Table counts of many cells. The sizes of the tables bear on nothing else, so that none are kept, of no cells."""

    large, tables = np.zeros(0, np.int64), Tables.one_each(np.zeros(0, np.int64))

    def __init__(self, t: np.ndarray):
        self.t = t.astype(np.int64)

    @classmethod
    def first(cls, c: np.ndarray) -> Seats:
        return cls(np.minimum(c, 1))

    def drawn(self, c: np.ndarray, tables: np.ndarray, parent: np.ndarray, d: float, theta: float, rng: np.random.Generator) -> Seats:
        """New seats of cells with c customers, given the tables of their restaurants and the parents' probabilities."""
        return Seats(seat(c, np.minimum(c, self.t), tables, parent, d, theta, rng))


# State -----------------------------------------------------------------------------------


class Root:
    """Totals and discounts, enough for a token's probability at the root given its customers and tables."""

    def __init__(self, customers: int, tables: int, v: int, discount: tuple[float, float]):
        self.customers, self.tables, self.v, self.discount = customers, tables, v, discount

    def p(self, c: np.ndarray, t: np.ndarray) -> np.ndarray:
        d = self.discount[0]
        return (c - d * t + (THETA[0] + d * self.tables) / (self.v + 1)) / (THETA[0] + self.customers)


def leaf(c, t, customers, tables, parent, d):
    """A token's probability in its context."""
    return (c - d * t + (THETA[1] + d * tables) * parent) / (THETA[1] + customers)


class State:
    """A bucket's training cells, ordered by token and context, and the seats of the cells and of its tokens at the root.

    Hot tokens have cells in all buckets; their seats at the root are the driver's.
    """

    def __init__(self, w, u, c, seats: Seats, root: Seats):
        self.w, self.u, self.c, self.seats, self.root = w, u, c, seats, root
        head = np.ones(len(w), bool)
        head[1:] = w[1:] != w[:-1]
        self.tokens, self.of = w[head], np.cumsum(head) - 1

    @classmethod
    def merged(cls, payloads: list[bytes]) -> State:
        parts = [_asked(p) for p in payloads]
        w = np.concatenate([np.repeat(p[0], p[1]) for p in parts])
        u, seen = (np.concatenate([p[k] for p in parts]) for k in (2, 3))
        w, u, seen = w[seen > 0], u[seen > 0], seen[seen > 0]
        order = np.lexsort((u, w))
        w, u, seen = w[order], u[order], seen[order]
        head = np.ones(len(w), bool)
        head[1:] = (w[1:] != w[:-1]) | (u[1:] != u[:-1])
        c = np.add.reduceat(seen, np.flatnonzero(head)) if len(w) else seen
        out = cls(w[head], u[head], c, Seats.first(c), Seats.first(np.zeros(0, np.int64)))
        out.root = Seats.first(out.at_root())
        return out

    def at_root(self) -> np.ndarray:
        """Each token's customers at the root: the tables of its cells."""
        return np.bincount(self.of, weights=self.seats.t, minlength=len(self.tokens)).astype(np.int64)

    @classmethod
    def read(cls, cells: bytes, seats: bytes) -> State:
        w, u, c = _unpacked(cells)
        return cls(np.cumsum(w), np.cumsum(u), c, *map(Seats, _unpacked(seats)))

    def cells_blob(self) -> bytes:
        """What no sweep changes."""
        return _packed(_steps(self.w), _steps(self.u), self.c)

    def seats_blob(self) -> bytes:
        return _packed(self.seats.t, self.root.t)

    def contexts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(contexts, customers, tables) of the cells here."""
        u, at = np.unique(self.u, return_inverse=True)
        return u, *(np.bincount(at, weights=x, minlength=len(u)).astype(np.int64) for x in (self.c, self.seats.t))

    def sweep(self, tables: np.ndarray, root: Root, hot: tuple[np.ndarray, np.ndarray, np.ndarray], rng: np.random.Generator) -> None:
        """``tables``: those of each cell's context in all; ``hot``: the hot tokens with their customers and tables at the root."""
        c0, t0 = self.rooted(hot)
        self.seats = self.seats.drawn(self.c, tables, root.p(c0, t0)[self.of], root.discount[1], THETA[1], rng)
        own = ~_found(hot[0], self.tokens)[1]
        c0 = np.where(own, self.at_root(), 0)
        self.root = self.root.drawn(c0, np.full(len(c0), root.tables), np.full(len(c0), 1 / (root.v + 1)), root.discount[0], THETA[0], rng)

    def rooted(self, hot: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Customers and tables at the root of the tokens here."""
        return _overridden(self.tokens, self.at_root(), self.root.t, hot)

    def totals(self, hot: np.ndarray) -> bytes:
        """For the driver: sums over the tokens and cells here, and the customers of the hot tokens' cells here."""
        c0, is_hot = self.at_root(), np.isin(self.tokens, hot)
        own = c0[~is_hot]
        counts = [own.sum(), self.root.t[~is_hot].sum(), (own == 1).sum(), (own == 2).sum(), (self.c == 1).sum(), (self.c == 2).sum()]
        return squeeze(np.array(counts, "<i8"), self.tokens[is_hot].astype("<i8"), c0[is_hot].astype("<i8"))


def _found(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(where each wanted key is, whether it is there) in ascending keys."""
    at = np.minimum(np.searchsorted(keys, wanted), max(0, len(keys) - 1))
    return at, keys[at] == wanted if len(keys) else np.zeros(len(wanted), bool)


def _overridden(tokens: np.ndarray, c: np.ndarray, t: np.ndarray, hot: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Customers and tables at the root, of hot tokens those that the driver has."""
    i, is_hot = _found(hot[0], tokens)
    return (np.where(is_hot, hot[1][i], c), np.where(is_hot, hot[2][i], t)) if len(hot[0]) else (c, t)


class Lookup:
    """Where the cells of a bucket are that chunks ask for; the same for all samples."""

    def __init__(self, state: State):
        self.tokens, (self.contexts, u) = state.tokens, np.unique(state.u, return_inverse=True)
        self.size = len(self.contexts)
        self.keys = state.of * self.size + u  # ascending

    def find(self, w: np.ndarray, per: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(each token's place, whether it is here, each cell's place, whether it is here)."""
        at, known = _found(self.tokens, w)
        ui, there = _found(self.contexts, u)
        i, has = _found(self.keys, np.repeat(at, per) * self.size + ui)
        return at, known, i, has & there & np.repeat(known, per)


def _taken(values: np.ndarray, at: np.ndarray, has: np.ndarray) -> np.ndarray:
    return np.where(has, values[at], 0) if len(values) else np.zeros(len(at), np.int64)


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", buckets: int | None = None, burn_in: int = BURN_IN, kept: int = KEPT) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row."""
    spark = docs.sparkSession
    folder = new_path(spark, "model")
    narrow = docs.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").alias("text"))
    buckets = buckets or min(MOST_BUCKETS, spread(narrow, BUCKET_BYTES, LEAST_BUCKETS))
    at = lambda name: f"{folder}/{name}"

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(at(name))
        return spark.read.schema(df.schema).parquet(at(name))

    def of_kind(name: str, kind: str) -> DataFrame:
        return spark.read.schema(f"{_ROWS}, kind string").parquet(at(name)).filter(F.col("kind") == kind).drop("kind")

    def cut(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for k, batch in enumerate(chunks(batches, "text", CHUNK_BYTES)):
            for b, payload in _texts(batch, buckets):
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (part << 32 | k, b, payload)], ["chunk", "bucket", "payload"])
        returned()

    made = narrow.mapInArrow(cut, _ROWS).withColumn("kind", F.when(F.col("bucket") < 0, "texts").otherwise("tokens"))
    made.write.partitionBy("kind").parquet(at("chunks"))
    chunked = spark.read.schema(f"{_ROWS}, kind string").parquet(at("chunks"))
    texts, tokens = (chunked.filter(F.col("kind") == k).drop("kind") for k in ("texts", "tokens"))
    numbers = written(tokens.groupBy("bucket").applyInArrow(lambda t: _numbered(t, buckets), _ROWS), "numbers")
    delete(spark, at("chunks/kind=tokens"))
    del tokens, made
    release(spark)
    vocabulary, numbers = numbers.filter("chunk = -1").select("payload"), numbers.filter("chunk >= 0")

    def counted(batches):
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                count = loose(blob)[1]
                yield pa.RecordBatch.from_arrays([pa.array([int(count.sum())]), pa.array([int(np.count_nonzero(count))])], ["n", "v"])

    n, v = (int(x or 0) for x in vocabulary.mapInArrow(counted, "n long, v long").agg(F.sum("n"), F.sum("v")).first())

    def frequent(batches):
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                number, count = loose(blob)
                yield pa.RecordBatch.from_arrays([pa.array(number[count * HOT * buckets > n])], ["number"])

    # HOT * buckets tokens at most have so large a share.
    hot = np.array(sorted(r[0] for r in vocabulary.mapInArrow(frequent, "number long").collect()), np.int64)

    def chunk_of(table: pa.Table) -> tuple[int, Chunk, list[tuple[int, bytes]]]:
        """A chunk from its texts (bucket -1) and its numbers (kind 0), and the other payloads by kind and bucket."""
        rows = sorted(zip(table["kind"].to_pylist(), table["bucket"].to_pylist(), table["payload"].to_pylist(), strict=True))
        numbered = [p for k, b, p in rows if k == 0 and b >= 0]
        return table["chunk"][0].as_py(), Chunk(rows[0][2], numbered, buckets, hot), [(k, p) for k, _, p in rows if k > 0]

    def cells(table: pa.Table) -> pa.Table:
        number, chunk, _ = chunk_of(table)
        return _table([(number, b, p) for b, p in chunk.asked(buckets)])

    kind = lambda df, k: df.select(F.lit(k).alias("kind"), "chunk", "bucket", "payload")
    asked = written(kind(texts, 0).unionAll(kind(numbers, 0)).groupBy("chunk").applyInArrow(cells, _ROWS), "cells")
    release(spark)
    def rows_of(bucket: int, state: State, first: bool = False) -> pa.Table:
        """A bucket's seats, its totals for the driver, and its contexts' tables for the contexts' buckets; at first also its cells, and its contexts with their customers."""
        u, customers, tables = state.contexts()
        home = u % buckets
        order = np.argsort(home, kind="stable")
        cuts = np.searchsorted(home[order], np.arange(buckets + 1))
        rows = [("seats", -1, state.seats_blob()), ("totals", -1, state.totals(hot))]
        rows += [("cells", -2, state.cells_blob())] if first else []
        for b in np.unique(home).tolist():
            part = order[cuts[b] : cuts[b + 1]]
            rows.append(("tables", b, _packed(tables[part])))
            if first:
                rows.append(("contexts", b, _packed(_steps(u[part]), customers[part])))
        out = _table([(bucket, b, payload) for _, b, payload in rows])
        return out.append_column("kind", pa.array([k for k, _, _ in rows]))

    kinds = f"{_ROWS}, kind string"

    def merge(table: pa.Table) -> pa.Table:
        return rows_of(table["bucket"][0].as_py(), State.merged(table["payload"].to_pylist()), True)

    asked.groupBy("bucket").applyInArrow(merge, kinds).write.partitionBy("kind").parquet(at("0"))
    release(spark)

    def summed(k: int) -> tuple[np.ndarray, dict[int, int]]:
        """Sums over the buckets, and the customers at the root of each hot token."""

        def run(batches):
            for batch in batches:
                for blob in batch.column(0).to_pylist():
                    counts, w, c = loose(blob)
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([-1 - np.arange(len(counts)), w])), pa.array(np.concatenate([counts, c]))], ["place", "n"])

        rows = of_kind(str(k), "totals").select("payload").mapInArrow(run, "place long, n long").groupBy("place").agg(F.sum("n")).collect()
        found = {p: c for p, c in rows}
        return np.array([found.get(-1 - k, 0) for k in range(6)], np.int64), {p: c for p, c in found.items() if p >= 0}

    def shared_of(counts, hot_c: np.ndarray, hot_t: np.ndarray, discount) -> tuple[Root, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        return Root(int(counts[0] + hot_c.sum()), int(counts[1] + hot_t.sum()), v, discount), (hot, hot_c, hot_t)

    def estimated(one: int, two: int) -> float:
        return min(0.95, max(0.05, one / (one + 2 * two))) if one else 0.5

    counts, at_root = summed(0)
    hot_c = np.array([at_root.get(w, 0) for w in hot.tolist()], np.int64)
    seats = Seats.first(hot_c)
    discount = estimated(int(counts[2]), int(counts[3])), estimated(int(counts[4]), int(counts[5]))
    current = shared_of(counts, hot_c, seats.t, discount)
    kept_states: dict[int, tuple] = {}

    def paired(samples: list[int]) -> DataFrame:
        """(chunk, bucket, payload) of the contexts and of their tables in each sample; chunk tells state and sample, see apart."""
        n = len(samples) + 1
        told = None
        for j, (k, kind) in enumerate([(0, "contexts"), *((k, "tables") for k in samples)]):
            part = of_kind(str(k), kind).select((-1 - (F.col("chunk") * n + j)).alias("chunk"), "bucket", "payload")
            told = part if told is None else told.unionAll(part)
        return told

    def apart(rows: list[tuple[int, bytes]], n: int) -> dict[int, list]:
        """Of each state the arrays of its contexts and its samples."""
        out: dict[int, list] = {}
        for chunk, payload in rows:
            state, j = divmod(-1 - chunk, n)
            out.setdefault(state, [None] * n)[j] = _unpacked(payload)
        return out

    def context_tables(table: pa.Table) -> pa.Table:
        """To each state's list of contexts, the tables of each in all."""
        back = table["bucket"][0].as_py()
        parts = apart(list(zip(table["chunk"].to_pylist(), table["payload"].to_pylist(), strict=True)), 2)
        u, where = np.unique(np.concatenate([np.cumsum(c[0]) for c, _ in parts.values()]), return_inverse=True)
        total = np.bincount(where, weights=np.concatenate([t[0] for _, t in parts.values()]), minlength=len(u)).astype(np.int64)
        cuts = np.cumsum([0, *(len(t[0]) for _, t in parts.values())])
        return _table([(state, back, _packed(total[where[x:y]])) for state, x, y in zip(parts, cuts, cuts[1:], strict=False)])

    def swept(shared, k: int):
        def sweep(table: pa.Table) -> pa.Table:
            root, hot_seats = shared.value
            bucket, rows = table["chunk"][0].as_py(), sorted(zip(table["bucket"].to_pylist(), table["payload"].to_pylist(), strict=True))
            state = State.read(rows[0][1], rows[1][1])
            u = np.unique(state.u)
            order = np.argsort(u % buckets, kind="stable")
            total = np.empty(len(u), np.int64)
            total[order] = np.concatenate([_unpacked(p)[0] for _, p in rows[2:]] or [np.zeros(0, np.int64)])
            state.sweep(total[np.searchsorted(u, state.u)], root, hot_seats, np.random.Generator(np.random.PCG64([SEED, k, bucket])))
            return rows_of(bucket, state)

        return sweep

    for k in range(1, burn_in + kept + 1):
        told = paired([k - 1]).groupBy("bucket").applyInArrow(context_tables, _ROWS)
        every = of_kind("0", "cells").unionAll(of_kind(str(k - 1), "seats")).unionAll(told).groupBy("chunk")
        every.applyInArrow(swept(spark.sparkContext.broadcast(current), k), kinds).write.partitionBy("kind").parquet(at(str(k)))
        counts, at_root = summed(k)
        hot_c = np.array([at_root.get(w, 0) for w in hot.tolist()], np.int64)
        root, rng = current[0], np.random.Generator(np.random.PCG64([SEED, k]))
        seats = seats.drawn(hot_c, np.full(len(hot), root.tables), np.full(len(hot), 1 / (v + 1)), discount[0], THETA[0], rng)
        current = shared_of(counts, hot_c, seats.t, discount)
        if k > burn_in:
            kept_states[k] = current
        if k - 1 <= burn_in:
            for kind_ in ("seats", "tables", "totals"):
                delete(spark, at(f"{k - 1}/kind={kind_}"))
        del told, every
        release(spark)
    shared = spark.sparkContext.broadcast(kept_states)
    samples = sorted(kept_states)
    both = asked.unionAll(of_kind("0", "cells").select(F.lit(-1).cast("long").alias("chunk"), F.col("chunk").alias("bucket"), "payload"))
    for k in samples:
        both = both.unionAll(of_kind(str(k), "seats").select(F.lit(-1 - k).cast("long").alias("chunk"), F.col("chunk").alias("bucket"), "payload"))

    def cells_told(table: pa.Table) -> pa.Table:
        """To each chunk: the tokens' probabilities at the root in each sample, then the cells' customers, and tables in each sample."""
        rows, bucket = list(zip(table["chunk"].to_pylist(), table["payload"].to_pylist(), strict=True)), table["bucket"][0].as_py()
        cells = next((p for c, p in rows if c == -1), None)
        states = {-1 - c: State.read(cells, p) for c, p in rows if c < -1}
        lookup = Lookup(states[samples[0]]) if states else None
        rooted = {k: s.rooted(shared.value[k][1]) for k, s in states.items()}
        out = []
        for chunk, payload in rows:
            if chunk >= 0:
                w, per, u, _ = _asked(payload)
                none = np.zeros(0, np.int64)
                at, known, i, has = lookup.find(w, per, u) if states else (np.zeros(len(w), int), np.zeros(len(w), bool), np.zeros(len(u), int), np.zeros(len(u), bool))
                p0, tables = [], []
                for k in samples:
                    root, hot_seats = shared.value[k]
                    c0, t0 = (_taken(x, at, known) for x in (rooted[k] if states else (none, none)))
                    p0.append(root.p(*_overridden(w, c0, t0, hot_seats)).astype("<f4"))
                    tables.append(_taken(states[k].seats.t if states else none, i, has))
                customers = _taken(states[samples[0]].c if states else none, i, has)
                out.append((chunk, bucket, _packed(per, *p0, customers, *tables)))
        return _table(out)

    told_cells = written(both.groupBy("bucket").applyInArrow(cells_told, _ROWS), "told")
    delete(spark, at("cells"))
    del both, asked
    release(spark)
    def contexts_told(table: pa.Table) -> pa.Table:
        """To each chunk, for its tokens as contexts: customers, and tables in each sample."""
        rows, bucket = list(zip(table["chunk"].to_pylist(), table["payload"].to_pylist(), strict=True)), table["bucket"][0].as_py()
        parts = list(apart([r for r in rows if r[0] < 0], len(samples) + 1).values())
        none = np.zeros(0, np.int64)
        u, where = np.unique(np.concatenate([np.cumsum(p[0][0]) for p in parts] or [none]), return_inverse=True)
        summed_ = lambda arrays: np.bincount(where, weights=np.concatenate(arrays or [none]), minlength=len(u)).astype(np.int64)
        totals = [summed_([p[0][1] for p in parts]), *(summed_([p[1 + j][0] for p in parts]) for j in range(len(samples)))]
        out = []
        for chunk, payload in rows:
            if chunk >= 0:
                i, has = _found(u, np.cumsum(_unpacked(payload)[0]))
                out.append((chunk, bucket, _packed(*(_taken(x, i, has) for x in totals))))
        return _table(out)

    told_contexts = written(numbers.unionAll(paired(samples)).groupBy("bucket").applyInArrow(contexts_told, _ROWS), "about")

    def total(table: pa.Table) -> pa.Table:
        _, chunk, told = chunk_of(table)
        cells = [_unpacked(p) for k, p in told if k == 1]
        contexts = [_unpacked(p) for k, p in told if k == 2]
        m = len(samples)
        per = [c[0] for c in cells]
        join = lambda parts, i: np.concatenate([p[i] for p in parts])
        c, customers = join(cells, 1 + m), join(contexts, 0)[chunk.context].astype(np.float64)
        mean = np.zeros(len(c))
        for s in range(m):
            p0 = np.concatenate([np.repeat(p[1 + s], n) for p, n in zip(cells, per, strict=True)]).astype(np.float64)
            mean += leaf(c, join(cells, 2 + m + s), customers, join(contexts, 1 + s)[chunk.context].astype(np.float64), p0, discount[1])
        log_p = np.log10(mean / m)
        base = np.log10((chunk.seen + 0.5) / (n + 0.5 * (v + 1)))
        starts = np.cumsum(chunk.count) - chunk.count
        add = lambda x: np.add.reduceat(x, starts)
        ids = pa.array(chunk.keys, mask=chunk.null.astype(bool))
        columns = {"key": ids, "held_out": [held_out(k) for k in ids.to_pylist()], "n_tokens": chunk.count, "n_known": add((chunk.seen > 0).astype(np.int64)[chunk.code])}
        return pa.table(columns | {"train_tokens": np.full(len(ids), n), "base_score": add(base[chunk.code]), "score": add(log_p[chunk.cell])})

    schema = "key long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    every = kind(texts, 0).unionAll(kind(numbers, 0)).unionAll(kind(told_cells, 1)).unionAll(kind(told_contexts, 2))
    return every.groupBy("chunk").applyInArrow(total, schema)


def perplexity(scores: DataFrame) -> DataFrame:
    """Perplexity of the model and of the base over the held-out rows."""
    of = lambda c: F.pow(F.lit(10.0), -F.sum(c) / F.sum("n_tokens"))
    return scores.filter("held_out").agg(of("score").alias("perplexity"), of("base_score").alias("base_perplexity"))


def report(docs: DataFrame) -> DataFrame:
    return score(docs).withColumnRenamed("key", "doc_id")
