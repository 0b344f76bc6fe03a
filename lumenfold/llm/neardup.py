"""Near-duplicate texts by min-max hashing.

Each of PERMS permutations of a text's shingle hashes gives two signature values, its minimum
and its maximum, so a signature of 2 * PERMS values costs PERMS evaluations. Values are banded
by fours; texts that share a band are candidates, and links are confirmed on the full shingle
sets. At a similarity of exactly 0.8 a pair shares no band with probability 3e-6.

Equal sets, by a BLAKE2b digest of the whole sorted set, are one class from the start. Within a band, members are first compared with its hub,
the member of the smallest doc_id, so a large group of copies costs at most one comparison a
member and band. Then candidate pairs that are still in different components are compared. Which pairs
are compared does not depend on sizes, only how: bands of at most SMALL members pair by pair, and
texts that larger bands connect side by side, SIDE against SIDE in one task, where a pair counts if
it shares a band. Components therefore are those of all linked candidates.

Defined results: null texts and texts without words have no shingles, link with nothing and are
kept as their own component; a text of fewer words than a shingle is one shingle; a null doc_id
links with nothing, has a null component and is kept; rows that repeat a doc_id are one node; an
empty table gives no rows. A text is held whole, at about 60 bytes a byte, however long it is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import _BYTE, Block, Hasher, U64, blocks, connected_components, cut, drop_cut, mix64, reduce_groups, starts_of, stream64, table, tidy

PERMS = 48
BAND = 4
SMALL = 32
SIDE = 192
_MUL = stream64(PERMS, 11) | U64(1)
_ADD = stream64(PERMS, 12)
SIG = "doc_id long, n_shingles long, h1 long, h2 long, bands array<long>"


def shingle_sets(block: Block, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted within it, and where each text's begin (n + 1 entries)."""
    s, e, doc = block.words()
    if not len(s):
        return np.zeros(0, U64), np.zeros(block.n + 1, np.int64)
    h = Hasher(_BYTE[block.lowered()]).spans(s, e)
    st = starts_of(doc, block.n)
    count = np.diff(st)
    roll = np.zeros(len(h), U64)
    for k in range(words):
        m = max(0, len(h) - k)
        roll[:m] = mix64(roll[:m] * U64(0x9E3779B97F4A7C15) + h[len(h) - m :])
        if k + 1 < words:
            short = np.flatnonzero(count == k + 1)
            held = roll[st[short]].copy() if len(short) else None
            if held is not None:
                keep = (short, held) if k == 0 else (np.concatenate([keep[0], short]), np.concatenate([keep[1], held]))
            elif k == 0:
                keep = (short, np.zeros(0, U64))
    out = []
    at = np.zeros(block.n + 1, np.int64)
    brief = dict(zip(keep[0].tolist(), keep[1].tolist(), strict=True)) if words > 1 else {}
    for i in range(block.n):
        if i in brief:
            out.append(np.array([brief[i]], U64))
        elif count[i]:
            out.append(np.unique(roll[st[i] : st[i + 1] - words + 1]))
        at[i + 1] = at[i] + (len(out[-1]) if count[i] else 0)
    return np.concatenate(out), at


def signatures(block: Block, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Set size, a 128-bit cryptographic digest of the whole set and the band keys of each text."""
    x, st = shingle_sets(block, words)
    n = np.diff(st)
    zero = U64(0)
    raw = memoryview(x.tobytes())
    at = (8 * st).tolist()
    digest = np.frombuffer(b"".join([hashlib.blake2b(raw[i:j], digest_size=16).digest() for i, j in zip(at, at[1:], strict=False)]), np.int64).reshape(-1, 2)
    values = np.empty((2 * PERMS, block.n), U64)
    for p in range(PERMS):
        v = x * _MUL[p] + _ADD[p]
        values[2 * p] = reduce_groups(np.minimum, v, st, zero)
        values[2 * p + 1] = reduce_groups(np.maximum, v, st, zero)
    bands = np.empty((block.n, 2 * PERMS // BAND), U64)
    for b in range(bands.shape[1]):
        key = np.full(block.n, b + 1, U64)
        for v in values[b * BAND : (b + 1) * BAND]:
            key = mix64(key * U64(0x9E3779B97F4A7C15) + v)
        bands[:, b] = key
    return n, digest[:, 0].copy(), digest[:, 1].copy(), bands.view(np.int64)


def _sign(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column("text")):
                n, h1, h2, bands = signatures(block, words)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(block.n + 1, dtype=np.int32) * bands.shape[1]), pa.array(bands.ravel()))
                ids = batch.column("doc_id").slice(block.first, block.n)
                yield pa.RecordBatch.from_arrays([ids, pa.array(n), pa.array(h1), pa.array(h2), flat], ["doc_id", "n_shingles", "h1", "h2", "bands"])
            tidy()

    return run


def _confirm(words: int, percent: int):
    """Keeps the pairs (a, b) whose texts' sets have percent or more of their union in common."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            right = batch.column("text_b")
            row = 0
            for left in blocks(batch.column("text_a")):
                x, xs = shingle_sets(left, words)
                for other in blocks(right.slice(left.first, left.n)):
                    y, ys = shingle_sets(other, words)
                    for j in range(other.n):
                        i = other.first + j
                        p, q = x[xs[i] : xs[i + 1]], y[ys[j] : ys[j + 1]]
                        both = len(np.intersect1d(p, q, assume_unique=True))
                        keep[row + i] = both > 0 and 100 * both >= percent * (len(p) + len(q) - both)
                row += left.n
            tidy()
            found = pa.array(keep)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(found), batch.column("b").filter(found)], ["a", "b"])

    return run


def _compare(words: int, percent: int):
    """Links between two sides of a group, or within one: a forest of them that connects what they connect."""

    def run(t: pa.Table) -> pa.Table:
        ids, side = t["doc_id"].to_numpy(), t["side"].to_numpy()
        sets, size = [], []
        for block in blocks(t["text"]):
            x, st = shingle_sets(block, words)
            sets.append(x)
            size.append(np.diff(st))
        n = np.concatenate(size)
        band = np.stack([np.asarray(x) for x in t["bands"].to_numpy()])
        doc = np.repeat(np.arange(len(n)), n)
        _, col, freq = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        several = freq[col] > 1
        doc, col = doc[several], np.cumsum(freq > 1)[col[several]] - 1
        a, b = np.flatnonzero(side == side.min()), np.flatnonzero(side == side.max())
        both = np.zeros((len(a), len(b)), np.float32)
        for at in range(0, int(col.max(initial=-1)) + 1, 8192):
            here = (col >= at) & (col < at + 8192)
            m = np.zeros((len(n), 8192), np.float32)
            m[doc[here], col[here] - at] = 1
            both += m[a] @ m[b].T
        i, j = np.nonzero((both > 0) & (100 * both >= percent * (n[a][:, None] + n[b][None, :] - both)))
        meet = (band[a[i]] == band[b[j]]).any(axis=1)
        i, j = i[meet], j[meet]
        root = np.arange(len(n))
        keep = []

        def top(k: int) -> int:
            while root[k] != k:
                root[k] = root[root[k]]
                k = root[k]
            return k

        for k, m in zip(a[i].tolist(), b[j].tolist(), strict=True):
            p, q = top(k), top(m)
            if p != q:
                root[p] = q
                keep.append((k, m))
        k = np.array(keep, np.int64).reshape(-1, 2)
        return pa.table({"a": ids[k[:, 0]], "b": ids[k[:, 1]]})

    return run


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sig = cut(rows.mapInArrow(_sign(words), SIG))
    real = sig.where("n_shingles > 0 and doc_id is not null")
    classes = cut(real.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.min("n_shingles").alias("n"), F.min_by("bands", "doc_id").alias("bands")))
    rep_bands = classes.select(F.col("rep").alias("doc_id"), "n", F.explode("bands").alias("band"))

    hubs = rep_bands.groupBy("band").agg(F.min(F.struct("doc_id", "n")).alias("hub"), F.count("*").alias("c")).where("c > 1").select("band", "hub")
    shared = cut(rep_bands.join(hubs, "band").select("band", "doc_id", "n", F.col("hub.doc_id").alias("hub"), F.col("hub.n").alias("hub_n")))
    fits = f"100 * least(n, hub_n) >= {percent} * greatest(n, hub_n)"
    star = cut(shared.where("doc_id <> hub").where(fits).select(F.col("doc_id").alias("a"), F.col("hub").alias("b")).distinct())

    # the texts that any candidate pair can need
    need = shared.select("doc_id").distinct()
    texts = cut(rows.join(need, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]))

    def confirm(pairs: DataFrame) -> DataFrame:
        a = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
        b = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
        return pairs.select("a", "b").join(a, "a").join(b, "b").mapInArrow(_confirm(words, percent), "a long, b long")

    edges = cut(confirm(star))
    first = connected_components(edges)

    # bands that still hold several components: the pairs across them of small bands, block by block for large ones
    placed = shared.join(first.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("band", "doc_id", "n", F.coalesce("comp", "doc_id").alias("comp"))
    mixed = placed.groupBy("band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("doc_id").alias("hub"), F.count("*").alias("c")).where("lo < hi")
    mixed = cut(mixed.select("band", "hub", (F.col("c") > SMALL).alias("large")))
    left = placed.join(mixed.where("not large").select("band"), "band", "left_semi")
    x, y = left.alias("x"), left.alias("y")
    pairs = x.join(y, (F.col("x.band") == F.col("y.band")) & (F.col("x.doc_id") > F.col("y.doc_id")) & (F.col("x.comp") != F.col("y.comp")) & F.expr(f"100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n)"))
    pairs = pairs.select(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b")).distinct()
    more = cut(confirm(pairs.join(star, ["a", "b"], "left_anti")))
    meet = placed.join(mixed.where("large").select("band", "hub"), "band").where("doc_id <> hub").select(F.col("doc_id").alias("a"), F.col("hub").alias("b"))
    group = connected_components(meet)
    size = group.groupBy("comp").agg(F.ceil(F.count("*") / SIDE).cast("int").alias("sides"))
    dealt = group.join(size, "comp").withColumn("side", F.pmod(F.xxhash64("node"), F.col("sides")).cast("int"))
    dealt = dealt.join(classes.select(F.col("rep").alias("node"), "bands"), "node")
    dealt = dealt.join(texts.withColumnRenamed("doc_id", "node"), "node").withColumn("other", F.explode(F.expr("sequence(0, sides - 1)")))
    dealt = dealt.select("comp", F.least("side", "other").alias("lo"), F.greatest("side", "other").alias("hi"), "side", F.col("node").alias("doc_id"), "bands", "text")
    more = cut(more.unionByName(dealt.groupBy("comp", "lo", "hi").applyInArrow(_compare(words, percent), "a long, b long")))
    comps = connected_components(edges.unionByName(more))

    members = classes.select("rep", "h1", "h2").join(comps.withColumnRenamed("node", "rep"), "rep", "left").select("h1", "h2", F.coalesce("comp", "rep").alias("component_id"))
    out = sig.select("doc_id", "n_shingles", "h1", "h2").join(members, ["h1", "h2"], "left")
    own = F.coalesce("component_id", "doc_id")
    out = out.select("doc_id", "n_shingles", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), own).otherwise(F.col("doc_id")).alias("component_id"))
    for old in (shared, star, texts, edges, more, mixed, group, first):
        drop_cut(old)
    return out.withColumn("kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=4, percent=80)
