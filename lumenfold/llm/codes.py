"""Binary codes of vectors by iterative quantisation, and multi-index tables over them.

A code stacks several learned orthogonal rotations of the vector, one bit for each rotated
component; rotations are fitted on a bounded sample (SAMPLE vectors, those of least id hash).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE = 4096
ITERATIONS = 20
CODE = ["c0", "c1", "c2", "c3"]


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(vec_id, v, d): rows that have a direction, one a vec_id (the least vector), and their size.

    Null, zero and non-finite vectors, those with a null component, and null ids are left out.
    """
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where("vec_id is not null and v is not null").where(~bad).where(F.exists("v", lambda x: x != 0))
    return rows.groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("d", F.size("v"))


def sizes(rows: DataFrame) -> list[tuple[int, int]]:
    """(size, rows) of the vectors; vectors of different sizes have no cosine, so each size is a table of its own."""
    return [(r.d, r.n) for r in rows.groupBy("d").agg(F.count("*").alias("n")).orderBy("d").collect()]


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column as unit vectors in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def learn(rows: DataFrame, bits: int, seed: int = 7) -> np.ndarray:
    """Stacked rotations, (d, at least `bits`), each fitted so that the rotated sample lies near its own signs."""
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").toArrow()["v"]
    if not len(sample):
        return np.zeros((1, bits))
    x = matrix(sample)
    d = x.shape[1]
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(-(-bits // d)):
        r = np.linalg.qr(rng.standard_normal((d, d)))[0]
        for _ in range(ITERATIONS):
            u, _, w = np.linalg.svd(np.sign(x @ r).T @ x)
            r = (u @ w).T
        out.append(r)
    return np.concatenate(out, axis=1)[:, :bits]


def encode(x: np.ndarray, rotation: np.ndarray) -> np.ndarray:
    """Codes as rows of bytes."""
    return np.packbits(x @ rotation > 0, axis=1)


def with_codes(rows: DataFrame, rotation: np.ndarray, sub: int) -> DataFrame:
    """(vec_id, c0, c1, c2, c3, subs array<long>): the first 256 bits, and the substrings of `sub` bits, numbered in the upper part."""
    held = rows.sparkSession.sparkContext.broadcast(rotation)
    tables = rotation.shape[1] // sub

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                on = matrix(part.column("v")) @ held.value > 0
                code = np.packbits(np.pad(on[:, :256], ((0, 0), (0, max(0, 256 - on.shape[1])))), axis=1).view(np.int64)
                subs = (on[:, : tables * sub].reshape(len(on), tables, sub) @ (np.int64(1) << np.arange(sub))) | (np.arange(tables, dtype=np.int64) << 40)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(on) + 1, dtype=np.int32) * subs.shape[1]), pa.array(np.ascontiguousarray(subs).ravel()))
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), *[pa.array(np.ascontiguousarray(code[:, k])) for k in range(4)], lists], ["vec_id", *CODE, "subs"])

    return rows.mapInArrow(run, "vec_id long, c0 long, c1 long, c2 long, c3 long, subs array<long>")


class MultiIndex:
    """Tables over the 8-bit substrings of the codes of one shard; retrieves every code within a Hamming radius."""

    def __init__(self, codes: np.ndarray):
        n, self.tables = codes.shape
        self.codes, self.words = codes, codes.view(np.uint64)
        self.order = np.argsort(codes, axis=0, kind="stable").T.astype(np.int32).ravel()
        self.start = np.zeros(self.tables * 256 + 1, np.int64)
        np.cumsum(np.bincount((codes + 256 * np.arange(self.tables)).ravel(), minlength=self.tables * 256), out=self.start[1:])
        pop = np.bitwise_count(np.arange(256, dtype=np.uint8))
        self.rings = [np.flatnonzero(pop == r) for r in range(9)]

    def search(self, code: np.ndarray, least: int) -> np.ndarray:
        """Rows of at least `least` nearest codes: probes grow until the radius they cover holds that many.

        After all tables were probed to substring radius r, each code within tables * (r + 1) - 1 bits is found.
        """
        n = len(self.codes)
        if n <= least:
            return np.arange(n)
        seen = np.zeros(n, bool)
        shift = 256 * np.arange(self.tables)[:, None]
        for r, ring in enumerate(self.rings):
            at = ((ring ^ code.astype(np.int64)[:, None]) + shift).ravel()
            a = self.start[at]
            c = self.start[at + 1] - a
            seen[self.order[np.repeat(a - np.cumsum(c) + c, c) + np.arange(c.sum())]] = True
            radius = self.tables * (r + 1) - 1
            if seen.sum() < least:
                continue
            rows = np.flatnonzero(seen)
            d = np.bitwise_count(self.words[rows] ^ code.view(np.uint64)).sum(axis=1, dtype=np.int64)
            sure = d <= radius
            if sure.sum() >= least:
                far = np.partition(d[sure], least - 1)[least - 1]
                return rows[d <= far]
        return np.arange(n)
