"""A stored proximity graph: neighbour lists refined through neighbours of neighbours, searched by a frontier of joins.

The graph starts from short lists: the best of each vector among those that lie on the same sides of
some random planes. A few links to any place keep its parts together.
In each round every vector meets the neighbours of its neighbours, in both directions, and keeps its
best. A list goes into a round only with what is new in it, and what points at one vector is cut to a
fixed number by a hash of the pair, so a round costs rows times a constant, whatever the degrees.

A search holds a short list of places for each of many queries. In a round all queries step together:
the unvisited best places of each are joined with the graph and with the vectors, and the lists are
merged. Nothing but counts reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenfold.sources.store import Tables, cut, drop_cut

DEGREE, BLOCK, TREES, ANY = 24, 96, 4, 4
ROUNDS, EACH = 4, 12
WIDTH, STEPS, TRIES, DOORS = 96, 16, 12, 12


def products(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """pairs with score, the inner product of two vector columns (which are dropped), a batch at a time."""

    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype="float64")
        return pd.Series(np.einsum("ij,ij->i", np.stack(x).astype(np.float64), np.stack(y).astype(np.float64)))

    return pairs.withColumn("score", F.pandas_udf(run, "double")(a, b)).drop(a, b)


def best(rows: DataFrame, by: str, n: int) -> DataFrame:
    """The n best rows by score of each value of `by`."""
    w = Window.partitionBy(by).orderBy(F.desc("score"), "dst")
    return rows.withColumn("r", F.row_number().over(w)).where(F.col("r") <= n).drop("r")


def _spread(of: Column, *by) -> Column:
    return F.xxhash64(of, *[F.lit(x) for x in by])


def code_bits(n: int, block: int = BLOCK) -> int:
    """How many bits part n vectors into cells of about half a block."""
    return max(1, int(np.ceil(np.log2(max(1, n / (block / 2))))))


def coded(rows: DataFrame, bits: int, trees: int = TREES, seed: int = 1) -> DataFrame:
    """rows (id, v) with tree and code: the sides of random planes that each vector lies on, in several ways."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.stack(pdf["v"]).astype(np.float64)
            planes = np.random.default_rng(seed).standard_normal((trees, bits, x.shape[1]))
            for t in range(trees):
                yield pd.DataFrame({"tree": t, "code": (x @ planes[t].T > 0) @ (1 << np.arange(bits)), "id": pdf["id"], "v": pdf["v"]})

    return rows.mapInPandas(run, f"tree int, code long, id {rows.schema['id'].dataType.simpleString()}, v array<float>")


def _first_lists(rows: DataFrame, degree: int, block: int, trees: int, seed: int) -> DataFrame:
    """(src, dst, score): the best of each vector in blocks that random planes put together, in several ways."""
    kind = rows.schema["id"].dataType.simpleString()
    dealt = coded(rows, code_bits(rows.count(), block), trees, seed)
    # a code that many vectors share is dealt into blocks of about `block`
    size = dealt.groupBy("tree", "code").agg(F.greatest(F.lit(1), F.count("*") / block).cast("long").alias("parts"))
    dealt = dealt.join(size, ["tree", "code"]).withColumn("part", F.pmod(_spread(F.col("id"), seed), F.col("parts")))

    def near(pdf: pd.DataFrame) -> pd.DataFrame:
        x, ids = np.stack(pdf["v"]).astype(np.float64), pdf["id"].to_numpy()
        s = x @ x.T
        np.fill_diagonal(s, -np.inf)
        k = min(degree, len(ids) - 1)
        top = np.argsort(-s, axis=1, kind="stable")[:, :k]
        return pd.DataFrame({"src": np.repeat(ids, k), "dst": ids[top].ravel(), "score": np.take_along_axis(s, top, 1).ravel()})

    return dealt.groupBy("tree", "code", "part").applyInPandas(near, f"src {kind}, dst {kind}, score double")


def _anywhere(rows: DataFrame, n: int, seed: int) -> DataFrame:
    """(src, dst): n others for each vector, by joining two hashes of the ids."""
    places = max(1, rows.count())
    ring = rows.select("id").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    a = ring.select(F.col("id").alias("src"), "i", F.pmod(F.xxhash64("id", "i", F.lit(seed)), F.lit(places)).alias("h"))
    b = rows.select(F.col("id").alias("dst"), F.pmod(F.xxhash64("id", F.lit(seed + 1)), F.lit(places)).alias("h"))
    return a.join(b, "h").where("src <> dst").select("src", "dst")


def build(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", degree: int = DEGREE, block: int = BLOCK, trees: int = TREES, rounds: int = ROUNDS, seed: int = 1) -> DataFrame:
    """(src, dst, score): the `degree` nearest by inner product that were found for each vector."""
    rows = cut(vectors.where(F.col(vector).isNotNull()).select(F.col(key).alias("id"), F.col(vector).cast("array<float>").alias("v")))
    near = _first_lists(rows, degree, block, trees, seed).repartition("src")
    one = cut(best(near.groupBy("src", "dst").agg(F.first("score").alias("score")), "src", degree).withColumn("new", F.lit(True)))
    for k in range(rounds):
        # both directions of every edge; at most EACH of a list, and of what points at one vector, go on
        both = one.select("src", "dst", "new").unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "new")).repartition("src")
        both = both.groupBy("src", "dst").agg(F.max("new").alias("new"))
        turn = Window.partitionBy("src", "new").orderBy(_spread(F.col("dst"), seed, k), "dst")
        some = both.withColumn("r", F.row_number().over(turn)).where(F.col("r") <= EACH).groupBy("src").agg(F.collect_list(F.struct("dst", "new")).alias("l"))
        # each pair once; both ends are asked after its score is known
        met = some.select(F.explode(F.expr("flatten(transform(l, p -> transform(filter(l, q -> p.dst < q.dst and (p.new or q.new)), q -> struct(p.dst as src, q.dst as dst))))")).alias("p"))
        met = met.select("p.src", "p.dst").repartition("src").distinct()
        # a full list takes nothing below its last: what can't enter is left out where it was scored
        least = one.groupBy(F.col("src").alias("id")).agg(F.when(F.count("*") >= degree, F.min("score")).alias("least"))
        held = rows.join(least, "id", "left")
        a = held.select(F.col("id").alias("src"), F.col("v").alias("va"), F.col("least").alias("la"))
        b = held.select(F.col("id").alias("dst"), F.col("v").alias("vb"), F.col("least").alias("lb"))
        pairs = products(met.join(a, "src").join(b, "dst"), "va", "vb")
        ends = F.array(F.struct("src", "dst", "score", F.col("la").alias("least")), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"), "score", F.col("lb").alias("least")))
        scored = pairs.select(F.explode(ends).alias("e")).select("e.*").where("least is null or score >= least").drop("least")
        scored = scored.join(one.select("src", "dst"), ["src", "dst"], "left_anti").withColumn("new", F.lit(True))
        done = cut(best(one.withColumn("new", F.lit(False)).unionByName(scored), "src", degree))
        drop_cut(one)
        one = done
        if one.where("new").limit(1).isEmpty():
            break
    drop_cut(rows)
    return one.drop("new")


def links(lists: DataFrame, rows: DataFrame, seed: int = 1) -> DataFrame:
    """(src, dst) to walk along: lists in both directions, those that point at one vector cut to twice DEGREE, and ANY links to any place."""
    back = best(lists.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "score"), "src", 2 * DEGREE)
    return lists.select("src", "dst").unionByName(back.select("src", "dst")).unionByName(_anywhere(rows, ANY, seed)).distinct()


def entries(rows: DataFrame, seed: int = 1) -> DataFrame:
    """(tree, code, bits, id): for each cell of random planes at most DOORS of its vectors, where a walk may begin."""
    bits = code_bits(rows.count())
    w = Window.partitionBy("tree", "code").orderBy(_spread(F.col("id"), seed), "id")
    return coded(rows, bits, seed=seed).drop("v").withColumn("r", F.row_number().over(w)).where(F.col("r") <= DOORS).select("tree", "code", F.lit(bits).alias("bits"), "id")


def walk(vectors: DataFrame, edges: DataFrame, doors: DataFrame, queries: DataFrame, k: int, width: int = WIDTH, steps: int = STEPS, tries: int = TRIES, seed: int = 1) -> DataFrame:
    """(query_id, dst, score, touched): the k best found for each query (query_id, q), and how many vectors were compared with it.

    vectors are (id, v), edges (src, dst), doors the entries. Each query begins at the doors of its own cells and at a few places
    by a hash of its id; in each step its `tries` best unvisited places are opened. It ends when no query has one among its
    `width` best.
    """
    n = max(1, vectors.count())
    asked = cut(queries)
    # dealt by id once and held by the executors, so that no step moves the vectors or the graph again
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    v = vectors.select(F.col("id").alias("dst"), "v").repartition(parts, "dst").persist(StorageLevel.DISK_ONLY)
    edges = edges.repartition(parts, "src").groupBy("src").agg(F.collect_list("dst").alias("to")).persist(StorageLevel.DISK_ONLY)
    ring = vectors.select(F.col("id").alias("dst"), F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n)).alias("h"))
    some = asked.select("query_id", F.explode(F.sequence(F.lit(0), F.lit(DOORS - 1))).alias("i")).withColumn("h", F.pmod(F.xxhash64("query_id", "i"), F.lit(n)))
    begin = some.join(ring, "h").select("query_id", "dst")
    held = doors.first()
    if held is not None:
        mine = coded(asked.select(F.col("query_id").alias("id"), F.col("q").alias("v")), held.bits, seed=seed).select(F.col("id").alias("query_id"), "tree", "code")
        begin = begin.unionByName(mine.join(doors.withColumnRenamed("id", "dst"), ["tree", "code"]).select("query_id", "dst"))
    first = begin.distinct().join(asked, "query_id").join(v, "dst")
    seen = cut(products(first, "q", "v").select("query_id", "dst", "score", F.lit(False).alias("opened")))
    for _ in range(steps):
        # everything compared stays in `seen`, so nothing is compared twice and what was touched can be counted
        w = Window.partitionBy("query_id").orderBy(F.desc("score"), "dst")
        top = seen.withColumn("r", F.row_number().over(w)).where(F.col("r") <= width)
        fresh = cut(best(top.where("not opened").drop("r"), "query_id", tries).select("query_id", "dst", F.lit(True).alias("now")))
        if fresh.isEmpty():
            break
        stepped = fresh.select("query_id", F.col("dst").alias("src")).join(edges, "src").select("query_id", F.explode("to").alias("dst")).distinct()
        stepped = stepped.join(seen.select("query_id", "dst"), ["query_id", "dst"], "left_anti")
        scored = products(stepped.join(v, "dst").join(asked, "query_id"), "q", "v").select("query_id", "dst", "score", F.lit(False).alias("opened"))
        old = seen.join(fresh, ["query_id", "dst"], "left").select("query_id", "dst", "score", (F.col("opened") | F.coalesce("now", F.lit(False))).alias("opened"))
        new = cut(old.unionByName(scored))
        for x in (seen, fresh):
            drop_cut(x)
        seen = new
    for x in (v, edges):
        x.unpersist()
    touched = Window.partitionBy("query_id")
    return best(seen.withColumn("touched", F.count("*").over(touched)), "query_id", k).select("query_id", "dst", "score", "touched")


class GraphIndex:
    """Vectors (key, embedding) and the graph over them, kept in Parquet."""

    def __init__(self, spark: SparkSession, root: str, key: str = "vec_id", degree: int = DEGREE):
        self.tables, self.key, self.spark, self.degree = Tables(spark, root), key, spark, degree

    def _rows(self) -> DataFrame:
        return self.tables.load("vectors")

    def build(self, vectors: DataFrame, vector: str = "embedding") -> "GraphIndex":
        """The vectors replace what the index held."""
        self.tables.save("vectors", vectors.where(F.col(vector).isNotNull()).select(F.col(self.key).alias("id"), F.col(vector).cast("array<float>").alias("v")))
        self._keep(build(self._rows(), "id", "v", self.degree))
        return self

    def _keep(self, lists: DataFrame) -> None:
        self.tables.save("lists", lists)
        self.tables.save("links", links(self.tables.load("lists"), self._rows()).repartition("src"))
        self.tables.save("doors", entries(self._rows()))

    def search(self, queries: DataFrame, k: int = 10, vector: str = "embedding", **how) -> DataFrame:
        """(query_id, key, score, touched) of the k best vectors found for each query (query_id, embedding), all queries at once."""
        asked = queries.select("query_id", F.col(vector).cast("array<float>").alias("q"))
        return walk(self._rows(), self.tables.load("links"), self.tables.load("doors"), asked, k, **how).withColumnRenamed("dst", self.key)

    def add(self, vectors: DataFrame, vector: str = "embedding", fresh_width: int = WIDTH) -> "GraphIndex":
        """New vectors find their places by a search of the graph; they join the lists of those they are near to. Vectors of known keys are replaced."""
        if self._rows() is None:
            return self.build(vectors, vector)
        new = cut(vectors.where(F.col(vector).isNotNull()).select(F.col(self.key).alias("id"), F.col(vector).cast("array<float>").alias("v")))
        self.remove(new.select(F.col("id").alias(self.key)))
        near = walk(self._rows(), self.tables.load("links"), self.tables.load("doors"), new.select(F.col("id").alias("query_id"), F.col("v").alias("q")), self.degree, fresh_width)
        near = near.select(F.col("query_id").alias("src"), "dst", "score")
        own = _first_lists(new, self.degree, BLOCK, TREES, 1)  # among the new ones
        every = self.tables.load("lists").unionByName(near).unionByName(near.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "score")).unionByName(own)
        lists = cut(best(every.groupBy("src", "dst").agg(F.max("score").alias("score")), "src", self.degree))
        self.tables.append("vectors", new)
        self._keep(lists)
        for x in (new, lists):
            drop_cut(x)
        return self

    def remove(self, keys: DataFrame) -> "GraphIndex":
        """Vectors go; each one's neighbours are linked with one another in its place."""
        gone = cut(keys.select(F.col(self.key).alias("id")).distinct())
        rows, lists = self._rows(), self.tables.load("lists")
        if gone.join(rows, "id", "left_semi").isEmpty():
            drop_cut(gone)
            return self
        left = cut(rows.join(gone, "id", "left_anti"))
        out = lists.join(gone.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("src").alias("x"), "dst")
        into = best(lists.join(gone.select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("dst").alias("by"), F.col("src").alias("dst"), "score"), "by", 2 * self.degree).select(F.col("by").alias("x"), F.col("dst").alias("src"))
        bridge = into.join(out, "x").where("src <> dst").select("src", "dst").distinct()
        a, b = left.select(F.col("id").alias("src"), F.col("v").alias("va")), left.select(F.col("id").alias("dst"), F.col("v").alias("vb"))
        scored = products(bridge.join(a, "src").join(b, "dst"), "va", "vb")
        kept = lists.join(gone.select(F.col("id").alias("src")), "src", "left_anti").join(gone.select(F.col("id").alias("dst")), "dst", "left_anti")
        new = cut(best(kept.unionByName(scored.select("src", "dst", "score")).groupBy("src", "dst").agg(F.max("score").alias("score")), "src", self.degree))
        self.tables.save("vectors", left)
        self._keep(new)
        for x in (gone, left, new):
            drop_cut(x)
        return self
