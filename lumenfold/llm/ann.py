"""Nearest neighbours by multi-index hashing.

The index is dealt into shards of at most about HELD components (32 MB), queries into blocks of as
many, and each block meets each shard in one task, so a task's memory is bounded however many rows
or queries there are. A shard cuts its learned rotated codes into 8-bit substrings, indexes each,
probes by the pigeonhole principle until the radius it covers holds RERANK codes, and reranks
those by exact cosine. Tasks keep their best k for each query, and one aggregation merges them.

Defined results: vectors that are null, zero, or that hold null or non-finite components are neither
queries nor candidates; of rows with one vec_id the least vector counts; vectors of different sizes
are no candidates of each other; equal scores rank by smaller id; a query with fewer than k
candidates gets all of them; an empty table gives no rows; further columns stay out of the result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import cut, table, tidy
from .codes import MultiIndex, encode, learn, matrix, sizes, usable

BITS = 256
HELD = 1 << 22
SHARD = 8192
SPREAD = 8
RERANK = 200
OUT = "query_id long, vec_id long, score double"


def nearest(vectors: DataFrame, is_query: F.Column, k: int = 5, key: str = "vec_id", vector: str = "embedding", rerank: int = RERANK) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest other rows found for each row where is_query (over vec_id) holds."""
    rows = cut(usable(vectors, key, vector))
    found = None
    for d, n in sizes(rows):
        one = _search(rows.where(F.col("d") == d), d, n, is_query, k, rerank)
        found = one if found is None else found.unionByName(one)
    if found is None:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score"))
    best = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))), 1, k)
    top = found.groupBy("query_id").agg(best.alias("best"))
    return top.select("query_id", F.posexplode("best").alias("p", "b")).select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), (-F.col("b.s")).alias("score"))


def _search(rows: DataFrame, d: int, n: int, is_query: F.Column, k: int, rerank: int) -> DataFrame:
    """(query_id, vec_id, score): the k best of each shard for each query."""
    spark = rows.sparkSession
    rotation = spark.sparkContext.broadcast(learn(rows, BITS))
    asked = rows.where(is_query)
    # as few shards as memory allows, since each costs each query a search, but up to SPREAD to share the work; by rows alone, so that clusters of any size find the same
    shards = max(-(-n * d // HELD), min(-(-n // SHARD), SPREAD), 1)
    qblocks = max(1, -(-asked.count() * d // HELD))
    deal = lambda m: F.pmod(F.xxhash64("vec_id"), F.lit(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    base = rows.select(deal(shards).alias("shard"), every(qblocks).alias("qb"), "vec_id", "v")
    to = asked.select(every(shards).alias("shard"), deal(qblocks).alias("qb"), "vec_id", "v")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[int, np.ndarray, np.ndarray]] = []
        if len(left) and len(right):
            ids = left["vec_id"].to_numpy()
            order = np.argsort(ids, kind="stable")
            ids, x = ids[order], matrix(left["v"])[order]
            index = MultiIndex(encode(x, rotation.value))
            q = matrix(right["v"])
            code = encode(q, rotation.value)
            for i, own in enumerate(right["vec_id"].to_pylist()):
                got = index.search(code[i], rerank + 1)
                got = got[ids[got] != own]
                s = (x[got] * q[i]).sum(axis=1)
                best = np.lexsort((ids[got], -s))[:k]
                out.append((own, ids[got][best], s[best]))
        tidy()
        join = lambda parts, kind: np.concatenate([np.zeros(0, kind), *parts]).astype(kind)
        whose = np.repeat(np.array([o for o, _, _ in out], np.int64), [len(v) for _, v, _ in out])
        return pa.table({"query_id": whose, "vec_id": join([v for _, v, _ in out], np.int64), "score": join([s for _, _, s in out], np.float64)})

    return base.groupBy("shard", "qb").cogroup(to.groupBy("shard", "qb")).applyInArrow(run, OUT)


def op3_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.pmod("vec_id", F.lit(50)) == 0)
