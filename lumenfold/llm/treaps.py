"""Ranked lexical search over inverted treaps.

Documents are dealt into shards as they are read. In a shard every term has a treap of its postings:
a binary search tree by document (in order of doc_id) and a heap by impact, so that the root of a
subtree bounds the impact of everything below it. A search walks the treaps of all terms of an item
at once over intervals of documents. The sum of the roots bounds the score of an interval; one that
can't enter the k best is left with all below it, else the document of the greatest root is scored
and the interval is split there.

Impacts are integers: weight * (10**9 tf div (1000 tf + 8 m)), with a term's weight from the number of
documents that hold it and m from the length of the document against the average. Heaps are ordered by
the second factor, ties by a hash of the document, so copies of one text don't make a chain.

A shard holds about SHARD postings (or one longer text), whatever the table: an index is built by one
scan of the texts and a pass over the postings, without a shuffle; a search shuffles the postings of
its terms by shard. Each shard gives at most k rows for an item.

Defined results: a text that is null or has no term is no document; rows of one doc_id are documents
of their own, those without doc_id come last among equal scores; the texts of one item_id are one
item, its terms counted once; an item without a matching document has no rows; an empty table on
either side gives none; further columns are not read, whatever their names.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .base import _BYTE, LOWER, U64, Hasher, Lookup, blocks, cut, drop_cut, mix64, runs, stream64, table, tidy

K = 10
SHARD = 2_000_000
TERMS = 65_536
BLOCK = 4 << 20
STATES = 512

_TERM = np.zeros(256, bool)
_TERM[48:58] = _TERM[65:91] = _TERM[97:123] = _TERM[128:] = True
_BYTE2 = stream64(256, 313)
_POSTINGS = "shard long, term string, ids array<long>, docs array<int>, tf array<int>, size array<int>"
_TREAPS = "shard long, term string, ids array<long>, docs array<int>, quality array<int>, down array<int>, up array<int>"


def _terms_of(block):
    data = LOWER[block.data]
    starts, ends, doc = runs(data, block.offs, _TERM)
    return data, starts, ends, doc, Hasher(_BYTE[data]).spans(starts, ends), Hasher(_BYTE2[data]).spans(starts, ends)


def _strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[bytes]:
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


# --------------------------------------------------------------------------- index
class _Shard:
    """Postings of some documents, gathered block by block."""

    def __init__(self):
        self.ids, self.null, self.size = [], [], []
        self.h, self.doc, self.tf = [], [], []
        self.names: dict[int, bytes] = {}
        self.n_docs = self.n = 0

    def add(self, ids: pa.Array, block, wanted: tuple[Lookup, np.ndarray] | None) -> None:
        data, starts, ends, doc, h, g = _terms_of(block)
        self.null.append(ids.is_null().to_numpy(zero_copy_only=False))
        self.ids.append(ids.fill_null(0).to_numpy(zero_copy_only=False))
        self.size.append(np.bincount(doc, minlength=block.n))
        if wanted is not None:
            row = wanted[0].find(h)
            keep = row >= 0
            keep[keep] = wanted[1][row[keep]] == g[keep]
            starts, ends, doc, h = starts[keep], ends[keep], doc[keep], h[keep]
        order = np.lexsort((doc, h))
        hs, ds = h[order], doc[order]
        new = np.ones(len(hs), bool)
        new[1:] = (hs[1:] != hs[:-1]) | (ds[1:] != ds[:-1])
        first = np.flatnonzero(new)
        self.h.append(hs[first])
        self.doc.append(ds[first] + self.n_docs)
        self.tf.append(np.diff(np.append(first, len(hs))))
        head = first[np.append(True, hs[first][1:] != hs[first][:-1])] if len(first) else first
        self.names.update(zip(hs[head].tolist(), _strings(data, starts[order[head]], ends[order[head]]), strict=True))
        self.n_docs += block.n
        self.n += len(first)

    def rows(self, shard: int) -> Iterator[pa.RecordBatch]:
        ids, null, size = (np.concatenate(x) for x in (self.ids, self.null, self.size))
        h, doc, tf = (np.concatenate(x) for x in (self.h, self.doc, self.tf))
        by_id = np.lexsort((ids, null))
        place = np.empty(len(ids), np.int64)
        place[by_id] = np.arange(len(ids))
        doc = place[doc]
        order = np.lexsort((doc, h))
        h, doc, tf = h[order], doc[order], tf[order]
        first = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
        offs = pa.array(np.append(first, len(h)).astype(np.int32))
        ints = lambda x: pa.ListArray.from_arrays(offs, pa.array(x.astype(np.int32)))
        names = pa.array([self.names[k] for k in h[first].tolist()], pa.binary()).cast(pa.string())
        n = len(first)
        none = pa.nulls(n, pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array([shard] * n, pa.int64()), names, none, ints(doc), ints(tf), ints(size[by_id][doc])], ["shard", "term", "ids", "docs", "tf", "size"])
        head = pa.array([pa.array(ids[by_id], mask=null[by_id]).to_pylist()], pa.list_(pa.int64()))
        nothing = pa.nulls(1, pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.nulls(1, pa.string()), head, nothing, nothing, pa.array([size[by_id].tolist()], pa.list_(pa.int32()))], ["shard", "term", "ids", "docs", "tf", "size"])


def _gather(wanted, postings: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only = None if wanted is None else (Lookup(wanted.value[0]), wanted.value[1])
        base, held, done = TaskContext.get().partitionId() << 24, _Shard(), 0
        for batch in batches:
            ids = batch.column("doc_id")
            for block in blocks(batch.column("text"), BLOCK):
                held.add(ids.slice(block.first, block.n), block, only)
                if held.n >= postings:
                    yield from held.rows(base + done)
                    held, done = _Shard(), done + 1
            tidy()
        if held.n_docs:
            yield from held.rows(base + done)

    return run


def heaps(starts: list[int], key: list[int]) -> tuple[list[int], list[int]]:
    """The children of each posting before and behind it (-1: none) in the treaps of the segments that begin at starts; key is the heap order."""
    down, up = [-1] * len(key), [-1] * len(key)
    for a, b in pairwise([*starts, len(key)]):
        spine: list[int] = []
        for i in range(a, b):
            under = -1
            while spine and key[spine[-1]] < key[i]:
                under = spine.pop()
            down[i] = under - a if under >= 0 else -1
            if spine:
                up[spine[-1]] = i - a
            spine.append(i)
    return down, up


def _build(n: int, total: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [batch.column(c) for c in ("shard", "term", "ids")]
            docs, tf, size = (batch.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("docs", "tf", "size_of"))
            m = 10 + (90 * size * n) // max(1, total)
            quality = (1_000_000_000 * tf) // (1000 * tf + 8 * m)
            counts = batch.column("docs").value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            offs = np.concatenate([[0], counts.cumsum()])
            key = (quality << 24) | (mix64(docs.astype(U64)) >> U64(40)).astype(np.int64)
            down, up = heaps(offs[:-1][counts > 0].tolist(), key.tolist())
            ints = lambda x: pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), pa.array(np.asarray(x, np.int32)))
            yield pa.RecordBatch.from_arrays([*cols, ints(docs), ints(quality), ints(down), ints(up)], ["shard", "term", "ids", "docs", "quality", "down", "up"])

    return run


@dataclass
class Treaps:
    """An index: rows of _TREAPS (a row without a term holds the ids of its shard), the documents that hold each term, their number, and all their terms."""

    rows: DataFrame
    held: DataFrame
    n: int
    total: int


def index(docs: DataFrame, terms: DataFrame | None = None, postings: int = SHARD) -> Treaps:
    """The treaps of docs (doc_id, text): of all terms, or of those of `terms` (term), at most TERMS of them."""
    spark = docs.sparkSession
    wanted = None
    if terms is not None:
        names = [r.term for r in terms.select("term").distinct().limit(TERMS + 1).collect()]
        if len(names) > TERMS:
            raise ValueError(f"more than {TERMS} terms; index all of them")
        block = next(blocks(pa.array(names or [""]), 1 << 40, len(names) + 1))
        _, _, _, _, h, g = _terms_of(block)
        wanted = spark.sparkContext.broadcast((h, g))
    rows = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_gather(wanted, postings), _POSTINGS))
    stats = rows.where("term is null").agg(F.sum(F.size(F.filter("size", lambda x: x > 0))).alias("n"), F.sum(F.aggregate("size", F.lit(0).cast("long"), lambda s, x: s + x)).alias("total")).first()
    n, total = stats.n or 0, stats.total or 0
    held = cut(rows.where("term is not null").groupBy("term").agg(F.sum(F.size("docs")).alias("df")))
    built = cut(rows.select("shard", "term", "ids", "docs", "tf", F.when(F.col("term").isNotNull(), F.col("size")).alias("size_of")).mapInArrow(_build(n, total), _TREAPS))
    drop_cut(rows)
    return Treaps(built, held, n, total)


# --------------------------------------------------------------------------- search
def _descend(at: np.ndarray, root: np.ndarray, docs, down, up, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The highest posting with lo <= document <= hi at or below each `at` (-1: none); root is where the term's postings begin."""
    at = at.copy()
    todo = np.flatnonzero(at >= 0)
    while len(todo):
        now = at[todo]
        d = docs[now]
        after, before = d > hi[todo], d < lo[todo]
        todo, now, after = todo[after | before], now[after | before], after[after | before]
        child = np.where(after, down[now], up[now])
        at[todo] = np.where(child >= 0, child + root[todo], -1)
        todo = todo[child >= 0]
    return at


def walk(tops: np.ndarray, roots: np.ndarray, weights: np.ndarray, docs, quality, down, up, k: int) -> tuple[list[tuple[int, int]], int]:
    """The k best (score, document) of one shard, by score and then by smaller document, and how many documents were scored.

    tops are the roots of the item's treaps, roots where their postings begin. An interval of documents is
    one row of `at`, with its highest posting of each term.
    """
    t = len(tops)
    at, lo, hi = tops[None, :].copy(), np.zeros(1, np.int64), np.full(1, 1 << 40)
    best: list[tuple[int, int]] = []
    scored = 0

    def impact(p: np.ndarray) -> np.ndarray:
        return np.where(p >= 0, weights * quality[np.maximum(p, 0)], 0)

    bound = impact(at).sum(axis=1)
    while len(at):
        if len(best) == k:
            live = bound >= best[0][0]
            at, lo, hi, bound = at[live], lo[live], hi[live], bound[live]
            if not len(at):
                break
        take = np.argpartition(-bound, STATES)[:STATES] if len(bound) > STATES else np.arange(len(bound))
        rest = np.ones(len(bound), bool)
        rest[take] = False
        now, a, b = at[take], lo[take], hi[take]
        each = impact(now)
        pivot = docs[now[np.arange(len(now)), each.argmax(axis=1)]].astype(np.int64)
        flat, own = now.ravel(), np.tile(roots, len(now))
        wide = lambda x: np.repeat(x, t)
        hit = _descend(flat, own, docs, down, up, wide(pivot), wide(pivot)).reshape(-1, t)
        score = impact(hit).sum(axis=1)
        scored += len(score)
        for s, d in zip(score.tolist(), pivot.tolist(), strict=True):
            if s > 0:
                (heapq.heappush if len(best) < k else heapq.heappushpop)(best, (s, -d))
        left = _descend(flat, own, docs, down, up, wide(a), wide(pivot - 1)).reshape(-1, t)
        right = _descend(flat, own, docs, down, up, wide(pivot + 1), wide(b)).reshape(-1, t)
        new = np.concatenate([left, right])
        at = np.concatenate([at[rest], new])
        lo, hi = np.concatenate([lo[rest], a, pivot + 1]), np.concatenate([hi[rest], pivot - 1, b])
        bound = np.concatenate([bound[rest], impact(new).sum(axis=1)])
        some = bound > 0
        at, lo, hi, bound = at[some], lo[some], hi[some], bound[some]
    return sorted(((s, -d) for s, d in best), key=lambda x: (-x[0], x[1])), scored


def _search(asked, k: int, counted: bool):
    def run(t: pa.Table) -> pa.Table:
        items, weight = asked.value
        t = t.combine_chunks()
        names = t["term"].to_pylist()
        head = names.index(None)
        ids = t["ids"][head].values
        flat = lambda c: t[c].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        docs, quality, down, up = flat("docs"), flat("quality").astype(np.int64), flat("down"), flat("up")
        counts = t["docs"].combine_chunks().value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        offs = np.concatenate([[0], counts.cumsum()])
        row = {x: i for i, x in enumerate(names)}
        # the root of a treap is its posting that is nobody's child
        root = {}
        out: list[tuple] = []
        for item, terms in items:
            mine = [x for x in terms if x in row]
            for x in mine:
                if x not in root:
                    a, b = offs[row[x]], offs[row[x] + 1]
                    child = np.zeros(b - a, bool)
                    for c in (down[a:b], up[a:b]):
                        child[c[c >= 0]] = True
                    root[x] = int(np.flatnonzero(~child)[0] + a)
            if not mine:
                continue
            found, scored = walk(np.array([root[x] for x in mine]), offs[[row[x] for x in mine]], np.array([weight[x] for x in mine], np.int64), docs, quality, down, up, k)
            out += [(item, ids[d].as_py(), s, scored if counted else 0) for s, d in found]
        cols = list(zip(*out, strict=True)) or [[], [], [], []]
        return pa.table({"item": pa.array(cols[0], pa.int64()), "doc_id": pa.array(cols[1], pa.int64()), "score": pa.array(cols[2], pa.int64()), "scored": pa.array(cols[3], pa.int64())})

    return run


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term), each once, of items (item_id, text)."""
    low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return items.select("item_id", F.explode(F.regexp_extract_all(low, F.lit(r"([^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+)"), F.lit(1))).alias("term")).distinct()


def search(held: Treaps, asked: DataFrame, k: int = K, counted: bool = False) -> DataFrame:
    """(item_id, rank, doc_id, score) of the k best documents of each item (item_id, term).

    asked is a block of items of about TERMS rows: it is sent to every task. counted adds, for each row, how many documents its item scored in the shard.
    """
    spark = asked.sparkSession
    w = F.floor(F.lit(1000.0) * F.ln((F.lit(2.0) * held.n + 2) / (F.lit(2.0) * F.col("df") + 1))).cast("long")
    rows = asked.join(held.held, "term").select("item_id", "term", w.alias("w")).where("w > 0").collect()
    names: dict = {}
    for r in rows:
        names.setdefault(r.item_id, []).append(r.term)
    order = list(names)
    weight = {r.term: r.w for r in rows}
    told = spark.sparkContext.broadcast(([(i, sorted(names[x])) for i, x in enumerate(order)], weight))
    key = spark.createDataFrame([(i, x) for i, x in enumerate(order)], f"item long, item_id {asked.schema['item_id'].dataType.simpleString()}")
    used = held.rows.join(F.broadcast(spark.createDataFrame([(x,) for x in weight], "t string")), F.col("term") == F.col("t"), "left").where("term is null or t is not null").drop("t")
    found = used.groupBy("shard").applyInArrow(_search(told, k, counted), "item long, doc_id long, score long, scored long")
    # a few shares of each item first, so that no task sorts the rows of all shards
    best = [F.desc("score"), F.asc_nulls_last("doc_id")]
    share = Window.partitionBy("item", F.pmod(F.hash("doc_id"), F.lit(64))).orderBy(*best)
    few = found.withColumn("rank", F.row_number().over(share)).where(F.col("rank") <= k)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*best))).where(F.col("rank") <= k)
    return ranked.join(F.broadcast(key), "item").select("item_id", "rank", "doc_id", "score", *["scored"] * counted)


def rank(docs: DataFrame, items: DataFrame, k: int = K, postings: int = SHARD) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents (doc_id, text) for each item (item_id, text). Items are asked in blocks of about TERMS terms."""
    asked = cut(item_terms(items))
    n = asked.count()
    parts = -(-n // TERMS)
    held = index(docs, asked if parts < 2 else None, postings)
    out = [search(held, asked.where(F.pmod(F.hash("item_id"), F.lit(parts)) == i) if parts > 1 else asked, k) for i in range(max(1, parts))]
    for x in out[1:]:
        out[0] = out[0].unionByName(x)
    return out[0]


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))


_TERM_RE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
OP11_SQL = rf"""
with doc as (
  select row_number() over () as r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_TERM_RE}') as t
  from documents),
size as (select r, doc_id, cast(len(t) as bigint) as n from doc where len(t) > 0),
stat as (select cast(count(*) as bigint) as nn, cast(sum(n) as bigint) as ll from size),
item as (
  select distinct item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_TERM_RE}')) as term
  from benchmark),
posting as (
  select r, term, cast(count(*) as bigint) as tf from (select r, unnest(t) as term from doc)
  where term in (select term from item) group by all),
weight as (
  select term, cast(floor(1000.0::double * ln((2.0::double * nn + 2) / (2.0::double * count(*) + 1))) as bigint) as w from posting, stat group by term, nn),
scored as (
  select i.item_id, p.r, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * nn) // ll)))) as score
  from item i join weight using (term) join posting p using (term) join size using (r), stat group by all),
ranked as (
  select item_id, row_number() over (partition by item_id order by score desc, doc_id nulls last) as rank, doc_id, score
  from scored join size using (r) where score > 0)
select item_id, cast(rank as bigint) as rank, doc_id, cast(score as bigint) as score from ranked where rank <= {K}
"""
