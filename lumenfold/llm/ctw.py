"""Language-model scoring by context-tree weighting.

A text is scored as its words, lower-cased, each followed by a blank, and one end mark. A byte is
eight binary decisions; for each of the 255 decision nodes a tree over the DEPTH bytes before it
holds Krichevsky-Trofimov estimates, mixed over all depths with the weights that the counts of
all training texts give. A context never seen in training ends the mixture at its parent.

Counts of (DEPTH + 1)-grams of the whole training part meet in one aggregation. Trees are built from
the bottom by contexts that end in the same three bytes, then two, the top beside the driver. The model is scored in parts of at most
PART_NODES nodes: a part is broadcast (about 16 bytes a node), and where there are several, each adds
its share in a pass of its own, so no worker holds more than one part. Word counts for the
unigram base are broadcast for the TOP_WORDS most frequent words; the rest is a join.

Where there are several parts the texts are written once with a row number, so that shares of one
row meet whatever order a repeated task reads in. bits_per_byte is the code length of a text over
the bytes scored.

Words and grams are told apart by 64-bit keys. A text is held whole, at about 100 bytes a byte. Defined results: null and empty texts are the end
mark alone; without a training row every decision has probability 1/2; a null doc_id trains and
is not held out; repeated rows are scored alike; an empty table gives no rows; further columns stay
out of the result.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import _BYTE, LOWER, U64, WORD, Block, Hasher, Lookup, blocks, cut, drop_cut, mix64, table, tidy
from .langid import remainder

DEPTH = 5
PART_NODES = 2_500_000
GRAMS = 40_000
TOP_WORDS = 65_536
END_KEY = 1
_HALF = np.log(0.5)


# --------------------------------------------------------------------------- streams
def stream(block: Block, part: tuple[np.ndarray, int] | None = None) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
    """Gram codes (context bytes and the byte itself lowest) of every byte scored, its doc, the words, and each doc's bytes.

    With part, a table from the last two context bytes to a part's number and one number, only the codes of that part.
    """
    s, e, doc = block.words()
    width = e - s + 1
    size = np.full(block.n, DEPTH + 1, np.int64)
    size += np.bincount(doc, width, block.n).astype(np.int64)
    begin = np.zeros(block.n + 1, np.int64)
    np.cumsum(size, out=begin[1:])
    total = int(begin[-1])
    before = np.cumsum(width) - width
    out_at = before + doc * (DEPTH + 1) + DEPTH
    z = np.full(total + 8, 32, np.uint8)
    word = WORD[block.data]
    z[np.flatnonzero(word) + np.repeat(out_at - s, e - s)] = LOWER[block.data[word]]
    z[begin[1:] - 1] = 10
    for k in range(DEPTH):
        z[begin[:-1] + k] = 10
    n = total - DEPTH
    keep = np.ones(n, bool)
    for k in range(DEPTH):  # windows that begin in one text and end in the next one's padding
        keep[begin[1:-1] - DEPTH + k] = False
    if part is not None:
        last = np.ndarray(n, ">u2", z.data, DEPTH - 2, (1,))
        keep &= part[0][last] == part[1]
    at = np.flatnonzero(keep)
    # six bytes from each place on, read as one number
    code = np.ndarray(n, ">u8", z.data, 0, (1,))[at].astype(U64) >> U64(16)
    of = np.repeat(np.arange(block.n, dtype=np.int32), size)[at + DEPTH]
    return code, of, (s, e, doc), size - DEPTH


def _word_keys(block: Block, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    return Hasher(_BYTE[block.lowered()]).spans(s, e)


def _merge(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, back = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
    return keys, np.bincount(back, np.concatenate([c for _, c in held]), len(keys)).astype(np.int64)


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, list] = {0: [], 1: []}
    size = {0: 0, 1: 0}

    def flush(kind: int) -> Iterator[pa.RecordBatch]:
        if held[kind]:
            k, c = _merge(held[kind])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int32)), pa.array(k.view(np.int64)), pa.array(c)], ["kind", "key", "n"])
        held[kind], size[kind] = [], 0

    for batch in batches:
        for block in blocks(batch.column("text")):
            code, _, (s, e, _), _ = stream(block)
            for kind, keys in ((0, np.append(_word_keys(block, s, e), np.full(block.n, END_KEY, U64))), (1, code)):
                k, c = np.unique(keys, return_counts=True)
                held[kind].append((k, c))
                size[kind] += len(k)
                if size[kind] > 1_000_000:
                    held[kind] = [_merge(held[kind])]
                    size[kind] = len(held[kind][0][0])
                    if size[kind] > 750_000:
                        yield from flush(kind)
        tidy()
    yield from flush(0)
    yield from flush(1)
    tidy()


# --------------------------------------------------------------------------- trees
def _lgamma(x: np.ndarray) -> np.ndarray:
    y = x + 8.0
    low = np.zeros_like(x)
    for k in range(8):
        low += np.log(x + k)
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - low


def _log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    return _lgamma(n0 + 0.5) + _lgamma(n1 + 0.5) - np.log(np.pi) - _lgamma(n0 + n1 + 1.0)


def _nodes(gram: np.ndarray, n: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys (context, decision node) at one depth with their counts of zeros and ones."""
    g = gram & U64((1 << (8 * (depth + 1))) - 1)
    ctx, byte = (g >> U64(8)) << U64(8), g & U64(255)
    keys = np.concatenate([ctx | (U64(1 << k) | (byte >> U64(8 - k))) for k in range(8)])
    bit = np.concatenate([(byte >> U64(7 - k)) & U64(1) for k in range(8)]).astype(bool)
    keys, back = np.unique(keys, return_inverse=True)
    w = np.tile(n.astype(np.float64), 8)
    return keys, *(np.bincount(back[b], w[b], len(keys)).astype(np.float64) for b in (~bit, bit))


def _up(keys: np.ndarray, depth: int) -> np.ndarray:
    """The node's key one depth up: its oldest byte is dropped."""
    return keys & U64((1 << (8 * depth)) - 1)


def _weigh(levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]], low: int, last: np.ndarray | None = None):
    """Bottom up: the weighted log probability of each node, and the weight that its own estimate keeps."""
    out: list[tuple[np.ndarray, np.ndarray]] = []
    for i in range(len(levels) - 1, -1, -1):
        keys, n0, n1 = levels[i]
        kt = _log_kt(n0, n1)
        if i == len(levels) - 1:
            pw = kt if last is None else last
            w = np.ones(len(keys)) if last is None else None
        else:
            below = levels[i + 1][0]
            split = np.bincount(np.searchsorted(keys, _up(below, low + i + 1)), out[0][0], len(keys))
            pw = np.logaddexp(_HALF + kt, _HALF + split)
            w = np.exp(_HALF + kt - pw)
        out.insert(0, (pw, w))
    return out


def _depth_key(keys: np.ndarray, depth: int) -> np.ndarray:
    return keys | U64(depth << 56)


def grow(gram: np.ndarray, n: np.ndarray) -> pa.Table:
    """Nodes of depths 3 to DEPTH over all grams of some three-byte endings: the mixture from depth 3 on, as a probability of one.

    Nodes of depth 3 also have their counts and weighted probability.
    """
    levels = [_nodes(gram, n, d) for d in range(3, DEPTH + 1)]
    weights = _weigh(levels, 3)
    cols = []
    for i, (keys, n0, n1) in enumerate(levels):
        p = (n1 + 0.5) / (n0 + n1 + 1)
        if i:
            at = np.searchsorted(levels[i - 1][0], _up(keys, 3 + i))
            s, q = s[at], q[at]  # noqa: F821
        else:
            s, q = np.zeros(len(keys)), np.ones(len(keys))
        own = lambda x: pa.array(x if i == 0 else np.zeros(len(keys)), pa.float64(), mask=np.full(len(keys), i > 0))  # noqa: B023, E731
        cols.append(pa.table({"key": _depth_key(keys, 3 + i).view(np.int64), "r": s + q * p, "n0": own(n0), "n1": own(n1), "pw": own(weights[i][0])}))
        w = weights[i][1]
        s, q = s + q * w * p, q * (1 - w)
    return pa.concat_tables(cols)


def _grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """grow() over one partition, which holds whole endings."""
    held = [(b.column("key").to_numpy().view(U64), b.column("n").to_numpy()) for b in batches if b.num_rows]
    if held:
        gram, n = np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held])
        del held
        out = grow(gram, n).to_batches(max_chunksize=50_000)
        del gram, n
        while out:
            yield out.pop()
    tidy()


def join_ends(t: pa.Table) -> pa.Table:
    """From depth 3 to depth 2, over whole two-byte endings: nodes of depth 2, and what each node of depth 3 has above it up to there."""
    keys = t["key"].to_numpy().view(U64) & U64((1 << 56) - 1)
    n0, n1, pw = (t[c].to_numpy() for c in ("n0", "n1", "pw"))
    two, back = np.unique(_up(keys, 3), return_inverse=True)
    a, b, below = (np.bincount(back, x, len(two)) for x in (n0, n1, pw))
    kt = _log_kt(a, b)
    whole = np.logaddexp(_HALF + kt, _HALF + below)
    w, p = np.exp(_HALF + kt - whole), (b + 0.5) / (a + b + 1)
    none = pa.nulls(len(keys), pa.float64())
    upper = pa.table({"key": _depth_key(two, 2).view(np.int64), "r": p, "n0": a, "n1": b, "pw": whole, "s": pa.nulls(len(two), pa.float64()), "q": pa.nulls(len(two), pa.float64())})
    lower = pa.table({"key": keys.view(np.int64), "r": none, "n0": none, "n1": none, "pw": none, "s": (w * p)[back], "q": (1 - w)[back]})
    return pa.concat_tables([upper, lower])


def build(grams: DataFrame) -> DataFrame:
    """(key, r, n0, n1, pw) of all nodes from depth 2 on, r being the mixture from depth 2 on; counts and pw for depth 2 only.

    Grams are dealt by the last three bytes of their context, about GRAMS of them a task, and each task
    grows all its trees at once, so that no frequent ending is one task's work. Depth 2 then joins what
    is left of each ending, at most 256 endings by 255 nodes.
    """
    parts = max(grams.sparkSession.sparkContext.defaultParallelism, -(-grams.count() // GRAMS))
    ending = F.shiftrightunsigned("key", 8).bitwiseAND(F.lit(0xFFFFFF))
    low = cut(grams.repartition(parts, ending).mapInArrow(_grow, "key long, r double, n0 double, n1 double, pw double"))
    three = low.where("pw is not null").withColumn("g", F.shiftrightunsigned("key", 8).bitwiseAND(F.lit(0xFFFF)))
    ends = cut(three.groupBy("g").applyInArrow(join_ends, "key long, r double, n0 double, n1 double, pw double, s double, q double"))
    above = ends.where("s is not null").select(F.col("key").alias("at"), "s", "q")
    full = low.select("key", "r", F.col("key").bitwiseAND(F.lit(0xFFFFFFFF)).alias("at")).join(above, "at")
    none = F.lit(None).cast("double")
    rest = full.select("key", (F.col("s") + F.col("q") * F.col("r")).alias("r"), *[none.alias(c) for c in ("n0", "n1", "pw")])
    nodes = cut(ends.where("s is null").select("key", "r", "n0", "n1", "pw").unionByName(rest))
    for old in (low, ends):
        drop_cut(old)
    return nodes


@dataclass
class Part:
    """One part of the model: log10 of seen grams, and the log odds of one at every node."""

    grams: Lookup
    gram_log: np.ndarray
    nodes: np.ndarray
    odds: np.ndarray


def _top(two: pa.Table) -> tuple[np.ndarray, ...]:
    """Depths 0 and 1 from the nodes at depth 2: their keys and odds, and what a node at depth 2 has above it."""
    keys = two["key"].to_numpy().view(U64) & U64((1 << 56) - 1)
    order = np.argsort(keys)
    keys = keys[order]
    n0, n1, pw = (two[c].to_numpy()[order] for c in ("n0", "n1", "pw"))
    levels = [(keys, n0, n1)]
    for d in (2, 1):
        k, back = np.unique(_up(levels[0][0], d), return_inverse=True)
        levels.insert(0, (k, np.bincount(back, levels[0][1], len(k)), np.bincount(back, levels[0][2], len(k))))
    w = _weigh(levels, 0, pw)
    p = [(b + 0.5) / (a + b + 1) for _, a, b in levels]
    one_at = np.searchsorted(levels[0][0], _up(levels[1][0], 1))
    s1, q1 = (w[0][1] * p[0])[one_at], (1 - w[0][1])[one_at]
    r1 = s1 + q1 * p[1]
    two_at = np.searchsorted(levels[1][0], _up(keys, 2))
    s2, q2 = (s1 + q1 * w[1][1] * p[1])[two_at], (q1 * (1 - w[1][1]))[two_at]
    return _depth_key(levels[0][0], 0), p[0], _depth_key(levels[1][0], 1), r1, keys, s2, q2


def _bit_logs(code: np.ndarray, nodes: np.ndarray, odds: np.ndarray) -> np.ndarray:
    """log10 of the byte's probability, each decision at its deepest seen context."""
    out = np.zeros(len(code))
    byte = code & U64(255)
    for k in range(8):
        node = U64(1 << k) | (byte >> U64(8 - k))
        bit = ((byte >> U64(7 - k)) & U64(1)).astype(bool)
        got = np.zeros(len(code))
        todo = np.arange(len(code))
        for d in range(DEPTH, -1, -1):
            c = code[todo] & U64((1 << (8 * (d + 1))) - 1)
            key = _depth_key(((c >> U64(8)) << U64(8)) | node[todo], d)
            at = np.minimum(np.searchsorted(nodes, key), max(0, len(nodes) - 1))
            hit = nodes[at] == key if len(nodes) else np.zeros(len(todo), bool)
            got[todo[hit]] = odds[at[hit]]
            todo = todo[~hit]
            if not len(todo):
                break
        out -= np.logaddexp(0, np.where(bit, -got, got))
    return out / np.log(10)


def _route(parts: int) -> np.ndarray:
    """The part of each two last bytes of a context."""
    return (mix64(np.arange(1 << 16, dtype=U64)) % U64(parts)).astype(np.int32)


def _route_col(key: str, parts: int, table_: DataFrame, shift: int) -> DataFrame:
    if parts == 1:
        return table_
    suffix = F.shiftrightunsigned(key, shift).bitwiseAND(F.lit(0xFFFF))
    lut = _route(parts).tolist()
    spark = table_.sparkSession
    part_of = spark.createDataFrame(list(enumerate(lut)), "suffix long, part int")
    return table_.withColumn("suffix", suffix.cast("long")).join(F.broadcast(part_of), "suffix").drop("suffix")


def _assemble(nodes: DataFrame, grams: DataFrame, top: tuple) -> Part:
    k0, p0, k1, r1, two, s2, q2 = top
    t = nodes.select("key", "r").toArrow()
    key, r = t["key"].to_numpy().view(U64), t["r"].to_numpy()
    above = np.searchsorted(two, key & U64((1 << 24) - 1))
    r = np.concatenate([p0, r1, s2[above] + q2[above] * r])
    key = np.concatenate([k0, k1, key])
    del t, above
    odds = (np.log(r) - np.log1p(-r)).astype(np.float32)
    del r
    order = np.argsort(key).astype(np.int32)
    key, odds = key[order], odds[order]
    del order
    code = np.sort(grams.select("key").toArrow()["key"].to_numpy().view(U64))
    logs = np.concatenate([_bit_logs(code[i : i + 100_000], key, odds) for i in range(0, len(code), 100_000)]) if len(code) else np.zeros(0)
    return Part(Lookup(code), logs.astype(np.float32), key, odds)


# --------------------------------------------------------------------------- scoring
def log_bytes(code: np.ndarray, part: Part) -> np.ndarray:
    row = part.grams.find(code)
    out = part.gram_log[row].astype(np.float64) if len(part.gram_log) else np.zeros(len(code))
    lost = np.flatnonzero(row < 0)
    if len(lost):
        some, back = np.unique(code[lost], return_inverse=True)
        out[lost] = _bit_logs(some, part.nodes, part.odds)[back]
    return out


SCORED = "rid long, doc_id long, n_tokens long, n_bytes long, known long, base double, part double, tail array<long>, tail_n array<int>"


def score_texts(train: DataFrame, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) for each row of docs."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    rows = train.select(F.col(text).alias("text"))
    counts = cut(rows.mapInArrow(_gather, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")))
    words, grams = counts.where("kind = 0").select("key", "n"), counts.where("kind = 1").select("key", "n")
    total = words.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    n_all, v_all = int(total.n or 0), int(total.v)
    denom = n_all + 0.1 * (v_all + 1)
    most = words.orderBy(F.desc("n"), "key").limit(TOP_WORDS).toArrow()
    word_key, word_n = most["key"].to_numpy().view(U64), most["n"].to_numpy()

    nodes = build(grams)
    top = _top(nodes.where("pw is not null").select("key", "n0", "n1", "pw").toArrow())
    parts = max(1, -(-nodes.count() // PART_NODES))
    nodes_at, grams_at = _route_col("key", parts, nodes, 8), _route_col("key", parts, grams, 8)

    source = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    if parts > 1:
        source = cut(source)
    lut = _route(parts)
    scored = []
    for p in range(parts):
        pick = (lambda t: t) if parts == 1 else (lambda t: t.where(F.col("part") == p))  # noqa: B023
        model = sc.broadcast(_assemble(pick(nodes_at), pick(grams_at), top))
        top_words = sc.broadcast((Lookup(word_key), word_n)) if p == 0 else None

        def run(batches: Iterator[pa.RecordBatch], model=model, top_words=top_words, p=p) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block in blocks(batch.column("text")):
                    code, of, (s, e, doc), size = stream(block, None if parts == 1 else (lut, p))
                    share = np.bincount(of, log_bytes(code, model.value), block.n).astype(np.float64)
                    n = np.bincount(doc, minlength=block.n) + 1
                    zeros = np.zeros(block.n)
                    known = base = zeros
                    tail_st, tail_k, tail_n = np.zeros(block.n + 1, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int32)
                    if top_words is not None:
                        find, c = top_words.value
                        keys = np.append(_word_keys(block, s, e), np.full(block.n, END_KEY, U64))
                        whose = np.append(doc, np.arange(block.n))
                        at = find.find(keys)
                        hit = at >= 0
                        known = np.bincount(whose[hit], minlength=block.n)
                        base = np.bincount(whose[hit], np.log10((c[at[hit]] + 0.1) / denom), block.n).astype(np.float64)
                        # the rest, once for each text, in order of texts
                        k, w = keys[~hit], whose[~hit]
                        order = np.lexsort((k, w))
                        k, w = k[order], w[order]
                        new = np.ones(len(k), bool)
                        new[1:] = (k[1:] != k[:-1]) | (w[1:] != w[:-1])
                        first = np.flatnonzero(new)
                        tail_k, tail_n = k[first].view(np.int64), np.diff(np.append(first, len(k))).astype(np.int32)
                        tail_st = np.searchsorted(w[first], np.arange(block.n + 1)).astype(np.int32)
                    rid, ids = (batch.column(c).slice(block.first, block.n) for c in ("rid", "doc_id"))
                    st = pa.array(tail_st)
                    yield pa.RecordBatch.from_arrays(
                        [rid, ids, pa.array(n), pa.array(size), pa.array(known.astype(np.int64)), pa.array(base), pa.array(share), pa.ListArray.from_arrays(st, pa.array(tail_k)), pa.ListArray.from_arrays(st, pa.array(tail_n))],
                        ["rid", "doc_id", "n_tokens", "n_bytes", "known", "base", "part", "tail", "tail_n"],
                    )
                tidy()

        scored.append(cut(source.mapInArrow(run, SCORED)))
        model.destroy()
        del model, run
        gc.collect()
        pa.default_memory_pool().release_unused()
    out = scored[0]
    if parts > 1:
        rest = scored[1].select("rid", "part")
        for s in scored[2:]:
            rest = rest.unionByName(s.select("rid", "part"))
        out = out.join(rest.groupBy("rid").agg(F.sum("part").alias("other")), "rid")
        out = out.withColumn("part", F.col("part") + F.col("other")).drop("other")

    tail = scored[0].select("rid", F.explode(F.arrays_zip("tail", "tail_n")).alias("x")).select("rid", F.col("x.tail").alias("key"), F.col("x.tail_n").alias("m"))
    tail = tail.join(words, "key", "left")
    more = tail.groupBy("rid").agg(
        F.sum(F.when(F.col("n") > 0, F.col("m")).otherwise(0)).alias("known_more"),
        F.sum(F.col("m") * F.log10((F.coalesce("n", F.lit(0)) + F.lit(0.1)) / F.lit(denom))).alias("base_more"),
    )
    out = out.join(more, "rid", "left")
    return out.select(
        "doc_id",
        "n_tokens",
        (F.col("known") + F.coalesce("known_more", F.lit(0))).alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("base_more", F.lit(0.0))).alias("base_score"),
        F.col("part").alias("score"),
        (-F.col("part") * F.log2(F.lit(10.0)) / F.col("n_bytes")).alias("bits_per_byte"),
    )


def op8_context_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(remainder("doc_id", 10) == 0, F.lit(False))
    out = score_texts(docs.where(~held_out), docs)
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")
