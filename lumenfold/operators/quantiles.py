"""Exact order statistics of groups of any size: counts in a narrowing range of values, never a group in one row or task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenfold.sources.store import cut as store_cut

BUCKETS = 4096
REST = 1 << 16


def _bucket(v: Column, lo: Column, hi: Column) -> Column:
    """A number that never falls as v rises; values beyond the finite ones have their own."""
    width = hi - lo
    # a range wider than the largest double is measured in halves
    part = F.when(width == float("inf"), F.try_divide(v / 2 - lo / 2, hi / 2 - lo / 2)).otherwise(F.try_divide(v - lo, width))
    return F.when(F.isnan(v), BUCKETS + 1).when(v == float("inf"), BUCKETS).when(v == float("-inf"), -1).otherwise(F.coalesce(F.floor(part * (BUCKETS - 1)), F.lit(0))).cast("int")


def order_statistics(rows: DataFrame, by: list[str], value: str, places: dict[str, float], cut=store_cut) -> DataFrame:
    """(*by, n, one column a place): the value at place int(n * p), the last one at most, of each group's n values in order.

    Values are read as doubles. Nulls don't count, a group without values has nulls, NaN stands last; a null key is a group.
    Each pass counts, for each group and place, the values of the range that holds the place in BUCKETS buckets and
    goes on with the bucket that holds it. Once no range holds over REST values, its distinct values are counted instead.
    """
    keys = [f"_k{i}" for i in range(len(by))]
    data = rows.select(*(F.col(b).alias(k) for b, k in zip(by, keys, strict=True)), F.col(value).cast("double").alias("v"))
    finite = F.when(~F.isnan("v") & (F.abs("v") < float("inf")), F.col("v"))
    groups = cut(data.groupBy(*keys).agg(F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.min(finite).alias("from"), F.max(finite).alias("to")))
    place = F.explode(F.array(*(F.struct(F.lit(c).alias("place"), F.lit(float(p)).alias("p")) for c, p in places.items())))
    left = groups.where("n > 0").select("*", place.alias("x")).select(*keys, "lo", "hi", "from", "to", F.col("n").alias("held"), F.col("x.place").alias("place"), F.least(F.col("n") - 1, F.floor(F.col("n") * F.col("x.p"))).alias("at"))

    def narrow(left: DataFrame, bucket: Column) -> DataFrame:
        ranges = left.where("lo < hi").select(*(F.col(k).alias(f"r{k}") for k in keys), "lo", "hi", "from", "to").distinct()
        same = [F.col(k).eqNullSafe(F.col(f"r{k}")) for k in keys]
        held = data.join(ranges, [*same, F.col("v").between(F.col("lo"), F.col("hi"))]).groupBy(*keys, "lo", "hi", bucket.alias("b"))
        counts = held.agg(F.count("*").alias("c"), F.min("v").alias("least"), F.max("v").alias("most"))
        upto = F.sum("c").over(Window.partitionBy(*keys, "lo", "hi").orderBy("b"))
        counts = counts.withColumn("upto", upto).select(*(F.col(k).alias(f"c{k}") for k in keys), F.col("lo").alias("clo"), F.col("hi").alias("chi"), "c", "least", "most", "upto")
        here = [*(F.col(k).eqNullSafe(F.col(f"c{k}")) for k in keys), F.col("lo") == F.col("clo"), F.col("hi") == F.col("chi"), F.col("at") < F.col("upto"), F.col("at") >= F.col("upto") - F.col("c")]
        found = left.join(counts, here, "left")
        lo, hi = F.coalesce("least", "lo"), F.coalesce("most", "hi")
        at = F.col("at") - F.coalesce(F.col("upto") - F.col("c"), F.lit(0))
        return cut(found.select(*keys, lo.alias("lo"), hi.alias("hi"), lo.alias("from"), hi.alias("to"), F.coalesce("c", "held").alias("held"), "place", at.alias("at")))

    size = lambda df: df.where("lo < hi").agg(F.coalesce(F.max("held"), F.lit(0)).alias("n")).first().n
    most, before = size(left), None
    while most > REST and most != before:
        left = narrow(left, _bucket(F.col("v"), F.col("from"), F.col("to")))
        most, before = size(left), most
    if most > 0:
        left = narrow(left, F.col("v"))
    found = left.groupBy(*(F.col(k).alias(f"l{k}") for k in keys)).agg(*(F.max(F.when(F.col("place") == c, F.col("lo"))).alias(c) for c in places))
    out = groups.join(found, [F.col(k).eqNullSafe(F.col(f"l{k}")) for k in keys], "left") if keys else groups.crossJoin(found)
    return out.select(*(F.col(k).alias(b) for b, k in zip(by, keys, strict=True)), "n", *places)
