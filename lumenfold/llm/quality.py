"""A quality classifier from weak labels.

Heuristic labellers vote good, bad or nothing on each text. Expectation-maximisation over the
counts of all vote patterns (at most 3**8) estimates how each labeller votes on good and on bad
texts; the posterior of a text's pattern is its label. A linear scorer on hashed features (words
and byte pairs) is trained on the posteriors of at most about SAMPLE texts, those of least id hash,
and scores every text. No gold label is used.

Defined results: null and empty texts vote as texts of no words; repeated rows score alike; an
empty table gives no rows; with no text at all the weights are 0 and every score 1/2.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import _BYTE, Block, Hasher, U64, blocks, table, tidy

SAMPLE = 4096
BUCKETS = 4096
ROUNDS = 100
STEPS = 300
ROWS = 512

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = _UPPER.copy()
_LETTER[97:123] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:'\"-?()!"]] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".,;:?"]] = True


def _per_doc(flag: np.ndarray, offs: np.ndarray) -> np.ndarray:
    at = np.zeros(len(flag) + 1, np.int64)
    np.cumsum(flag, out=at[1:])
    return np.diff(at[offs]).astype(np.float64)


def _distinct(doc: np.ndarray, key: np.ndarray, n: int) -> np.ndarray:
    pair = np.unique(doc.astype(U64) * U64(0x9E3779B97F4A7C15) ^ key, return_index=True)[1]
    return np.bincount(doc[pair], minlength=n).astype(np.float64)


def votes(block: Block) -> np.ndarray:
    """Each labeller's vote on each text: 0 bad, 1 none, 2 good."""
    d, offs, n = block.data, block.offs, block.n
    s, e, doc = block.words()
    words = np.bincount(doc, minlength=n).astype(np.float64)
    chars = np.maximum(1, np.diff(offs))
    share = lambda x, y: x / np.maximum(1, y)
    keys = Hasher(_BYTE[block.lowered()]).spans(s, e)
    mean = share(np.bincount(doc, e - s, n), words)
    symbol = _per_doc(_SYMBOL[d], offs) / chars
    upper = share(_per_doc(_UPPER[d], offs), _per_doc(_LETTER[d], offs))
    digit = _per_doc(_DIGIT[d], offs) / chars
    fresh = share(_distinct(doc, keys, n), words)
    stops = share(np.bincount(doc, _STOP[d[e - 1]] if len(e) else None, n), words)
    brk = np.flatnonzero(d == 10)
    st = np.sort(np.concatenate([offs[:-1][offs[:-1] < offs[1:]], brk + 1]))
    st = st[st < len(d)]
    of = np.searchsorted(offs, st, side="right") - 1
    stop_at = np.append(st[1:], len(d))
    lines = np.bincount(of, minlength=n).astype(np.float64)
    again = 1 - share(_distinct(of, Hasher(_BYTE[d]).spans(st, stop_at), n), lines)
    pick = lambda bad, good: np.where(bad, 0, np.where(good, 2, 1))
    return np.stack([
        pick(words < 5, words >= 60),
        pick((mean < 2.5) | (mean > 11), (mean > 3.5) & (mean < 9)),
        pick(symbol > 0.06, symbol < 0.015),
        pick(upper > 0.3, upper < 0.12),
        pick((words >= 40) & (fresh < 0.3), (words >= 40) & (fresh > 0.5)),
        pick((stops > 0.45) | ((words >= 30) & (stops == 0)), (stops > 0.03) & (stops < 0.3)),
        pick((lines >= 3) & (again > 0.3), (lines >= 3) & (again == 0)),
        pick(digit > 0.2, (digit < 0.05) & (words >= 20)),
    ])


LABELLERS = 8
_PLACE = 3 ** np.arange(LABELLERS)


def patterns(block: Block) -> np.ndarray:
    return _PLACE @ votes(block)


@dataclass
class LabelModel:
    """posterior[pattern] of good, the prior of good, and the chance that a vote of each labeller says bad, on bad and on good texts.

    Whether a labeller votes at all is taken to tell nothing about the class.
    """

    posterior: np.ndarray
    prior: float
    chance: np.ndarray


def fit_labels(pattern: np.ndarray, count: np.ndarray, rounds: int = ROUNDS) -> LabelModel:
    """Expectation-maximisation on the counts of vote patterns, begun at the number of bad votes."""
    v = (pattern[:, None] // _PLACE) % 3
    bad = (v == 0).sum(axis=1)
    post = np.where(bad == 0, 0.95, np.where(bad == 1, 0.5, 0.05))
    chance, prior = np.full((LABELLERS, 2), 0.5), 0.5
    for _ in range(rounds if len(pattern) else 0):
        w = np.stack([count * (1 - post), count * post])
        prior = float(np.clip(w[1].sum() / count.sum(), 0.02, 0.98))
        for j in range(LABELLERS):
            for c in range(2):
                tally = np.bincount(v[:, j], w[c], 3) + 1.0
                chance[j, c] = tally[0] / (tally[0] + tally[2])
        chance[:, 0] = np.maximum(chance[:, 0], chance[:, 1])  # no labeller is worse than chance
        post = _posterior(v, prior, chance)
    every = np.arange(3**LABELLERS)
    return LabelModel(_posterior((every[:, None] // _PLACE) % 3, prior, chance), prior, chance)


def _posterior(v: np.ndarray, prior: float, chance: np.ndarray) -> np.ndarray:
    odds = np.full(len(v), np.log(prior) - np.log(1 - prior))
    for j in range(LABELLERS):
        bad, good = chance[j]
        odds += np.array([np.log(good / bad), 0.0, np.log((1 - good) / (1 - bad))])[v[:, j]]
    return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def features(block: Block) -> np.ndarray:
    """Hashed word counts and byte-pair counts, damped and each half brought to length 1."""
    half = BUCKETS // 2
    s, e, doc = block.words()
    word = (Hasher(_BYTE[block.lowered()]).spans(s, e) % U64(half)).astype(np.int64)
    x = np.bincount(doc * BUCKETS + word, minlength=block.n * BUCKETS)
    d = block.data.astype(np.int64)
    if len(d) > 1:
        pair = ((d[:-1] * 257 + d[1:]) * 40503 >> 4) % half
        of = np.repeat(np.arange(block.n), np.diff(block.offs))
        one = of[:-1] == of[1:]
        x += np.bincount(of[:-1][one] * BUCKETS + half + pair[one], minlength=block.n * BUCKETS)
    x = np.log1p(x.astype(np.float32)).reshape(block.n, 2, half)
    return (x / np.maximum(1e-6, np.linalg.norm(x, axis=2, keepdims=True))).reshape(block.n, BUCKETS)


def fit_scorer(x: np.ndarray, y: np.ndarray, steps: int = STEPS, ridge: float = 1e-4) -> np.ndarray:
    """Weights (the last is the constant) of a logistic scorer for soft labels y."""
    w, look = np.zeros(x.shape[1] + 1), np.zeros(x.shape[1] + 1)
    if not len(x):
        return w
    rate = 4 / 3.0
    for k in range(steps):
        p = 1 / (1 + np.exp(-(x @ look[:-1].astype(np.float32) + look[-1])))
        g = (p - y) / len(y)
        step = look - rate * 4 * np.append(x.T @ g.astype(np.float32) + ridge * look[:-1], g.sum())
        look, w = step + k / (k + 3) * (step - w), step
    return w


def score_quality(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """(doc_id, pattern, posterior, score) for each row of docs."""
    sc = docs.sparkSession.sparkContext
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(3**LABELLERS, np.int64)
        for batch in batches:
            for block in blocks(batch.column("text")):
                total += np.bincount(patterns(block), minlength=len(total))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["pattern", "n"])

    tally = rows.select("text").mapInArrow(count, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).orderBy("pattern").toPandas()
    labels = fit_labels(tally["pattern"].to_numpy(np.int64), tally["n"].to_numpy(np.float64))
    total = int(tally["n"].sum())
    below = int(min(1.0, sample / max(1, total)) * (2**62 - 1))

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column("text"), 1 << 18, ROWS):
                x = features(block)
                at = [np.flatnonzero(r) for r in x]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("h").slice(block.first, block.n), pa.array(patterns(block)), pa.array(at, pa.list_(pa.int32())), pa.array([r[i] for r, i in zip(x, at, strict=True)], pa.list_(pa.float32()))],
                    ["h", "pattern", "at", "x"],
                )

    # with a constant, so that rows without id and text have no special place either
    h = F.xxhash64("doc_id", "text", F.lit(5)).bitwiseAND(F.lit(2**62 - 1))
    few = rows.select(h.alias("h"), "text").where(F.col("h") <= below).mapInArrow(sparse, "h long, pattern long, at array<int>, x array<float>")
    few = few.orderBy("h", "pattern").limit(2 * sample).toArrow()
    few = few.take(pc.sort_indices(few, [("h", "ascending"), ("pattern", "ascending")]))
    x = np.zeros((len(few), BUCKETS), np.float32)
    for i, (at, v) in enumerate(zip(few["at"], few["x"], strict=True)):
        x[i, at.values.to_numpy()] = v.values.to_numpy()
    w = fit_scorer(x, labels.posterior[few["pattern"].to_numpy()])
    held = sc.broadcast((labels.posterior, w))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        post, w = held.value
        for batch in batches:
            for block in blocks(batch.column("text"), rows=ROWS):
                p = patterns(block)
                s = 1 / (1 + np.exp(-(features(block) @ w[:-1].astype(np.float32) + w[-1])))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(block.first, block.n), pa.array(p), pa.array(post[p]), pa.array(s.astype(np.float64))], ["doc_id", "pattern", "posterior", "score"])

    return rows.mapInArrow(score, "doc_id long, pattern long, posterior double, score double")


def op5_weak_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score_quality(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.withColumn("kept", F.col("score") >= 0.5)
