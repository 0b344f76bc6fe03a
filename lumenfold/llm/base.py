"""Shared pieces of the training-data operators: tables, cut points, text blocks, components.

Text is handled as UTF-8 bytes in numpy blocks of bounded size, so no worker ever holds
more than a few dozen bytes for each byte of one block (or of one longer text).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.sources.store import cut, drop_cut

BLOCK_BYTES = 1 << 20
U64 = np.uint64


# --------------------------------------------------------------------------- tables
def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _trimmer():
    import ctypes

    return getattr(ctypes.CDLL(None), "malloc_trim", None)


_TRIM = _trimmer()


def tidy() -> None:
    """Gives memory that a worker has freed back to the system, so that what waits for its next task is small."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


# --------------------------------------------------------------------------- hashes
def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64 (the splitmix64 steps)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def stream64(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random words."""
    with np.errstate(over="ignore"):
        return mix64((np.arange(1, n + 1, dtype=U64) + U64(seed)) * U64(0x9E3779B97F4A7C15))


_BASE = 0x9E3779B97F4A7C15 | 1
_BYTE = stream64(256, 77)
_POW: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POW[0]) < n:
        size = max(n, BLOCK_BYTES + (1 << 16))
        out = []
        for b in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(size, b, U64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        if size > 8 * BLOCK_BYTES:
            return out[0], out[1]
        _POW[:] = out
    return _POW[0], _POW[1]


class Hasher:
    """Hashes of any spans of one block of symbols, from one prefix sum of powers modulo 2**64."""

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        p, self._inv = _powers(n + 1)
        self._sum = np.zeros(n + 1, U64)
        np.cumsum(symbols * p[:n], out=self._sum[1:])

    def spans(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        h = (self._sum[b] - self._sum[a]) * self._inv[a]
        return mix64(h + (b - a).astype(U64) * U64(0xD6E8FEB86659FD93))


# --------------------------------------------------------------------------- text blocks
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
WORD = np.ones(256, bool)
WORD[[9, 10, 11, 12, 13, 32]] = False


class Block:
    """Some whole texts as one byte array; docs start at offs[:-1]."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, first: int):
        self.data, self.offs, self.first, self.n = data, offs, first, len(offs) - 1

    def text(self, i: int) -> bytes:
        return self.data[self.offs[i] : self.offs[i + 1]].tobytes()

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and doc index of the words [^\\x20\\x09-\\x0D]+."""
        w = WORD[self.data]
        full = self.offs[:-1][self.offs[:-1] < self.offs[1:]]
        before = np.empty_like(w)
        before[1:] = w[:-1]
        before[full] = False
        starts = np.flatnonzero(w & ~before)
        after = np.empty_like(w)
        after[:-1] = w[1:]
        last = self.offs[1:][self.offs[:-1] < self.offs[1:]] - 1
        after[last] = False
        ends = np.flatnonzero(w & ~after) + 1
        return starts, ends, np.searchsorted(self.offs, starts, side="right") - 1

    def lowered(self) -> np.ndarray:
        return LOWER[self.data]


def blocks(column: pa.Array, most: int = BLOCK_BYTES, rows: int = 1 << 14) -> Iterator[Block]:
    """The texts of a string column in blocks of about `most` bytes and at most `rows` texts; nulls are empty texts.

    A text longer than `most` is a block of its own: memory is in proportion to the longest text, never to the table.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    _, o, d = column.buffers()
    offs = np.frombuffer(o, np.int64, n + 1 + column.offset)[column.offset :]
    data = np.frombuffer(d, np.uint8) if d is not None and d.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = min(i + rows, max(i + 1, int(np.searchsorted(offs, offs[i] + most, side="right")) - 1))
        yield Block(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], i)
        i = j


def starts_of(group: np.ndarray, n: int) -> np.ndarray:
    """Where each of n groups begins in a sorted array of group indexes; n + 1 entries."""
    return np.searchsorted(group, np.arange(n + 1))


def reduce_groups(op: np.ufunc, x: np.ndarray, st: np.ndarray, empty) -> np.ndarray:
    """op over x[st[i]:st[i+1]] for each i; `empty` where that is empty."""
    out = np.full(len(st) - 1, empty, x.dtype)
    full = np.flatnonzero(st[1:] > st[:-1])
    if len(full):
        out[full] = op.reduceat(x, st[:-1][full])
    return out


class Lookup:
    """An immutable uint64 -> row-number table for vectorised probes (open addressing)."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 1.7))))
        self.keys, size = keys.astype(U64), 1 << self.bits
        self.slot = np.full(size, -1, np.int32)
        todo = np.arange(len(keys), dtype=np.int64)
        at = self._home(self.keys)
        while len(todo):
            free = self.slot[at] < 0
            self.slot[at[free]] = todo[free]
            lost = self.slot[at] != todo
            todo, at = todo[lost], (at[lost] + 1) & (size - 1)

    def _home(self, k: np.ndarray) -> np.ndarray:
        return ((k * U64(0x9E3779B97F4A7C15)) >> U64(64 - self.bits)).astype(np.int64)

    def find(self, k: np.ndarray) -> np.ndarray:
        """Row of each key, -1 where it is absent."""
        out = np.full(len(k), -1, np.int32)
        if not len(self.keys):
            return out
        at = self._home(k)
        row = self.slot[at]
        hit = (row >= 0) & (self.keys[row] == k)
        out[hit] = row[hit]
        todo = np.flatnonzero((row >= 0) & ~hit)
        at = at[todo]
        while len(todo):
            at = (at + 1) & (len(self.slot) - 1)
            row = self.slot[at]
            hit = (row >= 0) & (self.keys[row] == k[todo])
            out[todo[hit]] = row[hit]
            on = (row >= 0) & ~hit
            todo, at = todo[on], at[on]
        return out


def runs(data: np.ndarray, offs: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text index of the maximal runs of bytes of the table `inside`; texts start at offs[:-1]."""
    w = inside[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offs] = True
    first, last = w.copy(), w.copy()
    first[1:] &= ~w[:-1] | edge[1:-1]
    last[:-1] &= ~w[1:] | edge[1:-1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(offs, starts, side="right") - 1


# --------------------------------------------------------------------------- components
HOT = 10_000


def _nodes(e: DataFrame) -> DataFrame:
    """(node, up, down, m) of edges (u, v): how many edges leave and reach each node, and its smallest neighbour."""
    out, back = F.struct(F.col("u").alias("node"), F.col("v").alias("o"), F.lit(1).alias("up")), F.struct(F.col("v").alias("node"), F.col("u").alias("o"), F.lit(0).alias("up"))
    ends = e.select(F.explode(F.array(out, back)).alias("x")).select("x.*")
    return cut(ends.groupBy("node").agg(F.sum("up").alias("up"), F.sum(1 - F.col("up")).alias("down"), F.min("o").alias("m")))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, comp): the smallest node reachable from each node that has an edge.

    Alternates the two star contractions of large graphs on a cluster until the edges are
    stars; each round is two aggregations and two joins, written to the shared folder. Edges
    point from the larger node to the smaller, so the centre of a star is its smallest node.

    A node that more than one of HOT edge ends meet is hot: there are at most HOT such nodes, so
    their minima are broadcast, and no task gets all edges of one centre.
    """
    e = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    while True:
        nodes = _nodes(e)
        # stars: each node is either the child of one parent, or only a parent
        state = nodes.agg(F.count_if(F.expr("up > 1 or up = 1 and down > 0")).alias("bad"), F.sum(F.col("up") + F.col("down")).alias("ends"), F.max(F.col("up") + F.col("down")).alias("most")).first()
        if not state.bad:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).where("v > u")
        low = nodes.select(F.col("node").alias("u"), F.least("node", "m").alias("m"), (F.col("up") + F.col("down")).alias("deg"))
        much = max(1000, state.ends // HOT)
        if state.most > much:
            hot = F.broadcast(low.where(F.col("deg") > much).select("u", F.col("m").alias("hm")))
            marked = both.join(hot, "u", "left")
            large = marked.where("hm is null").drop("hm").join(low.where(F.col("deg") <= much), "u").select("u", "v", "m").unionByName(marked.where("hm is not null").select("u", "v", F.col("hm").alias("m")))
        else:
            large = both.join(low, "u")
        large = large.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("x"))
        new = cut(small.select(F.col("x.v").alias("u"), F.col("x.m").alias("v")).where("u <> v").distinct())
        drop_cut(e)
        drop_cut(nodes)
        e = new
    pairs = nodes.select("node", F.when(F.col("up") > 0, F.col("m")).otherwise(F.col("node")).alias("comp"))
    pairs._cut_path = nodes._cut_path
    drop_cut(e)
    return pairs
