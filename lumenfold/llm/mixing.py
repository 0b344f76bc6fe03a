"""Mixing sources to target weights by hash-threshold histograms [DataFrame operators only].

Every document has a fixed 32-bit hash of its key. A source that should give a fraction of
itself gives the documents below a hash threshold. The threshold is found without sorting:
sizes are summed by source and hash bucket, the bucket in which the budget is met is the only
one looked into further, eight bits at a time. Thresholds for growing budgets are nested, so a
larger mix contains the smaller one.

Defined results: null text or no word has size 0; a null source is a source of its own, last in
order; rows with one key are taken or left together, and so are keys of one 32-bit hash; an empty
table gives no rows; further columns stay out of the result of the query and pass through `apply_mix`
unchanged, whatever their names, but columns named like the added ones are replaced.

What reaches the driver is one row a source. It must be in the thousands at most, as weights by
order of source already suppose; hosts or authors are no sources.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .base import cut, drop_cut, table

WEIGHTS = (3.0, 1.0, 2.0)
SHARE, CAP = 1.5, 2.0
LEVELS, BITS = 4, 8


def word_count(text) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def key_hash(key) -> F.Column:
    """32 bits of md5 over the key as text."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 8), 16, 10).cast("long")


def source_key(source) -> F.Column:
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("-"))


def targets(totals: dict[str, int], weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> dict[str, float]:
    """The words each source shall give: by weight, at most cap times its size, the excess shared again."""
    order = sorted(totals, key=lambda k: (k == "-", k))
    w = {k: weights[i % len(weights)] for i, k in enumerate(order)}
    left, free = share * sum(totals.values()), sum(w.values())
    by_ratio = sorted(order, key=lambda k: (cap * totals[k] / w[k], order.index(k)))
    out: dict[str, float] = {}
    for i, k in enumerate(by_ratio):
        if cap * totals[k] / w[k] > left / free:
            return out | {x: left / free * w[x] for x in by_ratio[i:]}
        out[k] = cap * totals[k]
        left, free = left - out[k], free - w[k]
    return out


def plan_mix(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(sk, source_size, target, base, below): each source's whole copies and the hash below which one more is taken.

    sized has sk, size and h. What reaches the driver is one row for each source.
    """
    spark = sized.sparkSession
    totals = {r.sk: int(r.n or 0) for r in sized.groupBy("sk").agg(F.sum("size").alias("n")).collect()}
    goal = targets(totals, weights, share, cap)
    state = {}
    for k, n in totals.items():
        base = int(goal[k] // n) if n else 0
        state[k] = (k, n, float(goal[k]), base, float(goal[k] - base * n), 0, 0)
    names = "sk string, source_size long, target double, base int, extra double, prefix long, held long"
    for level in range(1, LEVELS + 1):
        now = spark.createDataFrame(list(state.values()), names)
        left = 32 - BITS * level
        at = F.shiftrightunsigned("h", left)
        hist = (
            sized.join(now.select("sk", "prefix", "extra", "held"), "sk")
            .where((F.shiftrightunsigned("h", left + BITS) == F.col("prefix")) & (F.col("size") > 0))
            .groupBy("sk", at.alias("at"), "extra", "held")
            .agg(F.sum("size").alias("n"))
        )
        upto = F.sum("n").over(Window.partitionBy("sk").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
        over = hist.withColumn("upto", upto + F.col("held")).where("upto > extra")
        edge = over.groupBy("sk").agg(F.min(F.struct("at", "upto", "n")).alias("e")).select("sk", "e.*").collect()
        for r in edge:
            k, n, t, base, extra, _, _ = state[r.sk]
            before = r.upto - r.n
            prefix = r["at"]
            if level == LEVELS and before + r.n / 2 <= extra:
                prefix += 1
            state[r.sk] = (k, n, t, base, extra, prefix, before)
        for k in set(state) - {r.sk for r in edge}:
            s = state[k]
            state[k] = (*s[:5], s[5] << BITS, s[6])
    rows = [(k, n, t, base, below) for k, n, t, base, _, below, _ in state.values()]
    return spark.createDataFrame(rows, "sk string, source_size long, target double, base int, below long")


def apply_mix(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", weights=WEIGHTS, share=SHARE, cap=CAP) -> DataFrame:
    """docs with _size, _source_size, _target and _copies, the number of times the mix takes the row."""
    sized = cut(docs.select(source_key(F.col(source)).alias("sk"), word_count(F.col(text)).alias("size"), key_hash(F.col(key)).alias("h")))
    plan = plan_mix(sized, weights, share, cap)
    drop_cut(sized)
    # the row as one struct, so that no name of the table can clash with one of the plan
    own = [F.col(f"`{c}`") for c in docs.columns if c not in ("_size", "_source_size", "_target", "_copies")]
    full = docs.select(F.struct(*own).alias("row"), source_key(F.col(source)).alias("sk"), word_count(F.col(text)).alias("size"), key_hash(F.col(key)).alias("h"))
    copies = F.col("base") + (F.col("h") < F.col("below")).cast("int")
    return full.join(plan, "sk").select("row.*", F.col("size").alias("_size"), F.col("source_size").alias("_source_size"), F.col("target").alias("_target"), copies.alias("_copies"))


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    sized = cut(docs.select("doc_id", source_key(F.col("source")).alias("sk"), word_count(F.col("text")).alias("size"), key_hash(F.col("doc_id")).alias("h")))
    plan = plan_mix(sized)
    taken = F.col("size") * (F.col("base") + (F.col("h") < F.col("below")).cast("int"))
    return sized.join(plan, "sk").select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"))


OP7_SQL = r"""
with sized as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size,
         cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), '')), 1, 8) as bigint) as h
  from documents),
src as (
  select source, sum(size) as n, [3.0, 1.0, 2.0][((row_number() over (order by source nulls last) - 1) % 3) + 1]::double as w,
         row_number() over (order by source nulls last) as pos
  from sized group by source),
ranked as (
  select *, 2.0::double * n / w as ratio,
         1.5::double * sum(n) over () - coalesce(sum(2.0::double * n) over (order by 2.0::double * n / w, pos rows between unbounded preceding and 1 preceding), 0) as remaining,
         sum(w) over () - coalesce(sum(w) over (order by 2.0::double * n / w, pos rows between unbounded preceding and 1 preceding), 0) as free
  from src),
level as (select arg_min(remaining / free, ratio) as lam from ranked where ratio > remaining / free),
goal as (
  select source, n, case when lam is null or ratio <= lam then 2.0::double * n else lam * w end as target from ranked, level),
plan as (select source, n, target, case when n > 0 then floor(target / n) else 0 end as base from goal),
cum as (
  select s.*, p.n as source_size, p.target, p.base, p.target - p.base * p.n as extra,
         sum(size) over (partition by s.source order by h range between unbounded preceding and current row) as upto,
         sum(size) over (partition by s.source, h) as peers
  from sized s join plan p on s.source is not distinct from p.source)
select doc_id, cast(size as bigint) as size, cast(source_size as bigint) as source_size, target,
       cast(size * (base + case when upto - peers + peers / 2.0::double <= extra then 1 else 0 end) as bigint) as taken
from cum
"""
