"""Near-duplicate vectors by iterative quantisation and multi-index Hamming tables.

Codes of several learned rotations are cut into substrings of about log2(rows) bits; vectors that
agree on a substring meet in its table. There are so many tables that two vectors at exactly the
threshold meet in none with probability MISS. Candidates pass a Hamming filter, then the original
vectors decide in double precision.

Copies are not expanded into pairs. Vectors within half the threshold angle of a pivot form a
ball: any two of its members are within the threshold by the triangle inequality. Two balls are
wholly linked, wholly apart, or, where their radii leave it open, compared member by member.

Bits are signs of rotated vectors about the origin, not about the table's mean: that alone bounds
the chance of a miss for every pair by its angle. On vectors that all lie to one side of the origin
bits are less balanced and buckets fuller, at more work and with the same result.

Defined results: vectors that are null, zero, or that hold null or non-finite components link with
nothing and are kept; vectors of different sizes do not link; of rows with one vec_id the least
vector counts; a null vec_id has a null component and is kept; an empty table gives no rows;
further columns stay out of the result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import connected_components, cut, drop_cut, table
from .codes import CODE, learn, matrix, sizes, usable, with_codes

MISS = 1e-5
EDGE = 1e-6
NEAR_SD = 7.0


def _shape(n: int, angle: float) -> tuple[int, int]:
    """Bits of a substring and number of tables for n rows."""
    sub = min(32, max(12, math.ceil(math.log2(max(2, n))) - 2))
    meet = (1 - angle / math.pi) ** sub
    return sub, math.ceil(math.log(MISS) / math.log(1 - meet))


def _bits_within(angle: float) -> int:
    """Hamming distance in 256 bits that vectors at this angle stay below."""
    p = min(0.5, angle / math.pi)
    return math.ceil(256 * p + NEAR_SD * math.sqrt(256 * p * (1 - p)))


def _hamming(other: str) -> F.Column:
    return sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"{other}{c}"))) for c in CODE), F.lit(0))


def _least(prefix: str) -> list[F.Column]:
    """The least vec_id of a group, and its code, in plain numbers, so that the aggregation hashes and never sorts."""
    return [F.min("vec_id").alias(f"{prefix}id"), *[F.min_by(c, "vec_id").alias(f"{prefix}{c}") for c in CODE]]


def _cosines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 8192):
            part = batch.slice(at, 8192)
            c = (matrix(part.column("va")) * matrix(part.column("vb"))).sum(axis=1)
            yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(c)], ["a", "b", "c"])


def vector_duplicates(vectors: DataFrame, cosine: float = 0.95, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of vectors."""
    rows = cut(usable(vectors, key, vector))
    found = None
    for d, n in sizes(rows):
        one = _linked(rows.where(F.col("d") == d), n, math.acos(cosine), cosine)
        found = one if found is None else found.unionByName(one)
    if found is None:
        found = rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    every = vectors.select(F.col(key).cast("long").alias("vec_id")).join(found, "vec_id", "left")
    component = F.coalesce("component_id", "vec_id")
    return every.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))


def _linked(rows: DataFrame, n: int, angle: float, cosine: float) -> DataFrame:
    """(vec_id, n_links, component_id) of vectors of one size."""
    sub, tables = _shape(n, angle)
    coded = cut(with_codes(rows, learn(rows, max(256, sub * tables)), sub))

    def measured(pairs: DataFrame) -> DataFrame:
        va = rows.select(F.col("vec_id").alias("a"), F.col("v").alias("va"))
        vb = rows.select(F.col("vec_id").alias("b"), F.col("v").alias("vb"))
        return pairs.join(va, "a").join(vb, "b").select("a", "b", "va", "vb").mapInArrow(_cosines, "a long, b long, c double")

    # balls: members near the least vector that they meet in a table
    meets = coded.select("vec_id", *CODE, F.explode("subs").alias("t"))
    hubs = meets.groupBy("t").agg(*_least("h_"), F.count("*").alias("n")).where("n > 1").drop("n")
    star = meets.join(hubs.hint("shuffle_hash"), "t").where("vec_id <> h_id").where(_hamming("h_") <= _bits_within(angle))
    star = star.select(F.col("vec_id").alias("a"), F.col("h_id").alias("b")).distinct()
    inner = cut(measured(star).where(F.acos(F.least("c", F.lit(1.0))) <= angle / 2 - EDGE))
    pivots = inner.join(inner.select(F.col("a").alias("b")).distinct(), "b", "left_anti")
    held = pivots.groupBy("a").agg(F.min(F.struct("b", "c")).alias("x")).select(F.col("a").alias("vec_id"), F.col("x.b").alias("ball"), F.col("x.c").alias("c"))
    member = cut(coded.join(held, "vec_id", "left").select("vec_id", F.coalesce("ball", "vec_id").alias("ball"), F.coalesce("c", F.lit(1.0)).alias("c"), *CODE, "subs"))
    balls = cut(member.groupBy("ball").agg(F.count("*").alias("size"), F.max(F.acos(F.least("c", F.lit(1.0)))).alias("r")))

    # balls that meet in a table
    seen = member.select("vec_id", "ball", *CODE, F.explode("subs").alias("t"))
    x = seen.groupBy("t", "ball").agg(*_least("")).select("t", F.col("ball").alias("a"), *CODE)
    y = x.toDF("t", "b", *[f"y_{c}" for c in CODE])
    close = x.join(y, "t").where("a < b").where(_hamming("y_") <= _bits_within(2 * angle)).select("a", "b").distinct()
    ra = balls.select(F.col("ball").alias("a"), F.col("size").alias("na"), F.col("r").alias("ra"))
    rb = balls.select(F.col("ball").alias("b"), F.col("size").alias("nb"), F.col("r").alias("rb"))
    gap = F.acos(F.greatest(F.lit(-1.0), F.least("c", F.lit(1.0))))
    pairs = measured(close).join(ra, "a").join(rb, "b").withColumn("gap", gap)
    pairs = pairs.withColumn("whole", gap + F.col("ra") + F.col("rb") <= angle - EDGE).withColumn("apart", gap - F.col("ra") - F.col("rb") > angle + EDGE)
    pairs = cut(pairs.where("not apart").select("a", "b", "na", "nb", "whole"))
    whole = pairs.where("whole")
    ids = member.select("vec_id", "ball")
    open_ = pairs.where("not whole").select(F.col("a").alias("ball_a"), F.col("b").alias("ball_b"))
    open_ = open_.join(ids.select(F.col("ball").alias("ball_a"), F.col("vec_id").alias("a")), "ball_a").join(ids.select(F.col("ball").alias("ball_b"), F.col("vec_id").alias("b")), "ball_b")
    single = cut(measured(open_.select("a", "b")).where(F.col("c") >= cosine).select("a", "b"))

    of_ball = whole.select(F.explode(F.array(F.struct(F.col("a").alias("ball"), F.col("nb").alias("n")), F.struct(F.col("b").alias("ball"), F.col("na").alias("n")))).alias("x")).select("x.*")
    of_ball = of_ball.groupBy("ball").agg(F.sum("n").alias("more"))
    of_one = single.select(F.explode(F.array("a", "b")).alias("vec_id")).groupBy("vec_id").agg(F.count("*").alias("own"))
    to_ball = lambda c: ids.select(F.col("vec_id").alias(c), F.col("ball").alias(f"ball_{c}"))
    joined = single.join(to_ball("a"), "a").join(to_ball("b"), "b").select(F.col("ball_a").alias("a"), F.col("ball_b").alias("b"))
    comps = connected_components(whole.select("a", "b").unionByName(joined))

    found = ids.join(balls.select("ball", "size"), "ball").join(of_ball, "ball", "left").join(of_one, "vec_id", "left").join(comps.withColumnRenamed("node", "ball"), "ball", "left")
    links = F.col("size") - 1 + F.coalesce("more", F.lit(0)) + F.coalesce("own", F.lit(0))
    found = cut(found.select("vec_id", links.cast("long").alias("n_links"), F.coalesce("comp", "ball").alias("component_id")))
    for old in (coded, inner, member, balls, pairs, single, comps):
        drop_cut(old)
    return found


def op9_vector_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_duplicates(table(spark, sf_dir, "embeddings"), 0.95)
