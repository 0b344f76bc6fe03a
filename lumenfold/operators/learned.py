"""Token vectors learned from a corpus, which texts average: a model for `embedding` that needs none from elsewhere.

Tokens near each other are counted over all texts; the positive part of the pointwise mutual information of
the counts is factorised by a randomised range finder whose products with the matrix are Spark jobs over
blocks of its rows. What the driver holds is bounded by the vocabulary: VOCABULARY rows of WIDTH + SPARE numbers.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.functions import text as fn
from lumenfold.sources.store import Tables, cut, drop_cut, spread

#: Tokens that get vectors, how often one must occur, how far apart two count as near, components of a vector.
VOCABULARY, LEAST, NEAR, WIDTH = 20_000, 3, 5, 64
#: Directions held beyond WIDTH, products after the first, blocks of rows, entries of one product.
SPARE, ROUNDS, BLOCKS, TILE = 16, 4, 256, 1 << 16
#: Places of tokens whose pairs a task sums at once.
PIECE = 1 << 18
#: A token of this share of all counts half in a text.
COMMON = 1e-3


def vocabulary(docs: DataFrame, text: str = "text", most: int = VOCABULARY, least: int = LEAST) -> list[tuple[str, int]]:
    """(token, count) of the `most` most frequent lower-cased tokens, ties in order of the token."""
    toks = spread(docs.select(text)).select(F.explode(fn.lower_tokens(text)).alias("tok"))
    rows = toks.groupBy("tok").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return [(r.tok, r.n) for r in rows.orderBy(F.desc("n"), "tok").limit(most).collect()]


def _near(ids: np.ndarray, size: int, near: int, own: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes, once each, of the pairs up to `near` apart whose first place is among the first `own`, with their summed weights near + 1 - distance; -1 is no token of the vocabulary."""
    codes, weights = [], []
    for gap in range(1, near + 1):
        b = ids[gap : gap + own]
        a = ids[: len(b)]
        held = (a >= 0) & (b >= 0)
        a, b = a[held], b[held]
        codes.append(np.minimum(a, b) * size + np.maximum(a, b))
        weights.append(np.full(len(a), near + 1 - gap, np.int64))
    code = np.concatenate(codes)
    order = np.argsort(code)
    code = code[order]
    first = np.flatnonzero(np.diff(code, prepend=-1))
    return code[first], np.add.reduceat(np.concatenate(weights)[order], first) if len(first) else first


def _streams(texts: Iterable[str | None], place: dict[str, int], near: int, most: int) -> Iterator[np.ndarray]:
    """The tokens of all texts in turn as places in the vocabulary, in arrays of some `most` or of one longer text; `near` times -1 stands after each text."""
    held, n = [], 0
    for text in texts:
        held.append(np.fromiter((place.get(t[0].lower(), -1) for t in re.finditer(fn.TOKEN, text or "")), np.int64))
        held.append(np.full(near, -1, np.int64))
        n += len(held[-2]) + near
        if n >= most:
            yield np.concatenate(held)
            held, n = [], 0
    if held:
        yield np.concatenate(held)


def cooccurrences(docs: DataFrame, tokens: list[str], text: str = "text", near: int = NEAR, piece: int = PIECE) -> DataFrame:
    """(i, j, n) with i <= j: the summed weights of the places where tokens i and j of the list stand near each other.

    Pairs are summed over `piece` places at a time, so a task holds those of one piece beside its batch of texts.
    """
    place, size = {t: i for i, t in enumerate(tokens)}, len(tokens)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids in _streams((x.as_py() for x in batch.column("text")), place, near, piece):
                for at in range(0, len(ids), piece):
                    codes, sums = _near(ids[at : at + piece + near], size, near, piece)
                    cols = [(codes // max(1, size)).astype(np.int32), (codes % max(1, size)).astype(np.int32), sums]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["i", "j", "n"])

    rows = spread(docs.where(F.col(text).isNotNull()).select(F.col(text).alias("text")))
    return rows.mapInArrow(run, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n"))


def both_ways(pairs: DataFrame) -> DataFrame:
    """The symmetric matrix of counts; a pair of one token counts for each of its two sides."""
    sides = F.when(F.col("i") == F.col("j"), F.array(F.struct("i", "j", (F.col("n") * 2).alias("n")))).otherwise(F.array(F.struct("i", "j", "n"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"), "n")))
    return pairs.select(F.explode(sides).alias("x")).select("x.*")


def information(pairs: DataFrame) -> DataFrame:
    """(i, j, n, v) of both_ways(pairs) where v = ln(n * total / (sum of i * sum of j)) is above 0."""
    every = both_ways(pairs)
    sums = every.groupBy("i").agg(F.sum("n").alias("s"))
    total = sums.agg(F.sum("s").alias("total"))
    # a row for each token of the vocabulary at most
    a, b = F.broadcast(sums.withColumnRenamed("s", "si")), F.broadcast(sums.select(F.col("i").alias("j"), F.col("s").alias("sj")))
    v = F.ln(F.col("n").cast("double") * F.col("total") / (F.col("si").cast("double") * F.col("sj")))
    return every.join(a, "i").join(b, "j").crossJoin(F.broadcast(total)).select("i", "j", "n", v.alias("v")).where("v > 0")


def _product(rows: DataFrame, q: np.ndarray) -> np.ndarray:
    """The matrix of rows (b, i, j, v) times q, by blocks of its rows; entries of a row are summed in one order, so reruns agree."""
    tile = TILE

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["i", "j"])
        i, j, v = (pdf[c].to_numpy() for c in ("i", "j", "v"))
        ids, at = np.unique(i, return_inverse=True)
        out = np.zeros((len(ids), q.shape[1]))
        for k in range(0, len(i), tile):
            first = np.flatnonzero(np.diff(at[k : k + tile], prepend=-1))
            out[at[k : k + tile][first]] += np.add.reduceat(v[k : k + tile, None] * q[j[k : k + tile]], first, axis=0)
        return pd.DataFrame({"i": ids, "y": list(out)})

    got = rows.groupBy("b").applyInPandas(block, "i int, y array<double>").toPandas()
    out = np.zeros_like(q)
    if len(got):
        out[got["i"].to_numpy()] = np.stack(got["y"])
    return out


def factors(rows: DataFrame, size: int, width: int = WIDTH, rounds: int = ROUNDS, seed: int = 0) -> np.ndarray:
    """size rows of the leading directions of a symmetric matrix (i, j, v), each scaled by the root of its singular value."""
    kept = min(size, width + SPARE)
    held = cut(rows.select(F.pmod("i", F.lit(BLOCKS)).alias("b"), "i", "j", "v"), "b", parts=BLOCKS // 4)
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, kept)))[0]
    for _ in range(rounds):
        q = np.linalg.qr(_product(held, q))[0]
    small = q.T @ _product(held, q)
    value, vector = np.linalg.eigh((small + small.T) / 2)
    first = np.argsort(-np.abs(value), kind="stable")[:width]
    drop_cut(held)
    return (q @ vector[:, first]) * np.sqrt(np.abs(value[first]))


@dataclass
class Learned:
    """A model: texts to the weighted means of their tokens' vectors, frequent tokens counting less; no known token, no direction."""

    tokens: list[str]
    counts: np.ndarray
    vectors: np.ndarray

    def __post_init__(self) -> None:
        share = self.counts / max(1, self.counts.sum())
        weight = COMMON / (COMMON + share)
        self.place = {t: i for i, t in enumerate(self.tokens)}
        middle = share @ self.vectors if len(share) else 0.0
        self.weighted = (self.vectors - middle) * weight[:, None]

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.vectors.shape[1]))
        for row, text in enumerate(texts):
            at = [i for t in re.findall(fn.TOKEN, text) if (i := self.place.get(t.lower())) is not None]
            ids, n = np.unique(np.array(at, np.int64), return_counts=True)
            out[row] = n @ self.weighted[ids]
        return out

    def save(self, spark: SparkSession, root: str, name: str = "token_vectors") -> None:
        rows = [(i, t, int(n), v.tolist()) for i, (t, n, v) in enumerate(zip(self.tokens, self.counts, self.vectors, strict=True))]
        Tables(spark, root).save(name, spark.createDataFrame(rows, "i int, tok string, n long, vector array<double>"))

    @staticmethod
    def load(spark: SparkSession, root: str, name: str = "token_vectors") -> Learned | None:
        held = Tables(spark, root).load(name)
        if held is None:
            return None
        rows = held.orderBy("i").collect()
        width = len(rows[0].vector) if rows else 0
        return Learned([r.tok for r in rows], np.array([r.n for r in rows], np.int64), np.array([r.vector for r in rows], float).reshape(len(rows), width))


def learn(docs: DataFrame, text: str = "text", most: int = VOCABULARY, least: int = LEAST, width: int = WIDTH, near: int = NEAR, seed: int = 0) -> Learned:
    """The model of a corpus; all of its texts count. Texts without tokens, or none at all, give a model that knows nothing."""
    words = vocabulary(docs, text, most, least)
    tokens, counts = [t for t, _ in words], np.array([n for _, n in words], np.int64)
    if not tokens:
        return Learned([], counts, np.zeros((0, width)))
    pairs = cut(cooccurrences(docs, tokens, text, near))
    found = factors(information(pairs), len(tokens), width, seed=seed)
    drop_cut(pairs)
    return Learned(tokens, counts, np.hstack([found, np.zeros((len(tokens), width - found.shape[1]))]))
