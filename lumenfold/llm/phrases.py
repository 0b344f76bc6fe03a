"""Phrases that stand together more often than chance, by hashed pass counts (PCY, DHP) and Apriori pruning.

Phrases of n words are counted in pass n. Each pass also adds every phrase of n + 1 words that may
still be frequent to a table of hash buckets. Between passes two bitmaps go to the workers: the
buckets that reached the least count, and the hashes of the phrases counted so far that did. The
next pass counts only phrases whose bucket is set and whose parts, without the first or the last
word, are both set; what is counted is the phrase itself, so a collision in a bitmap costs a count
and never changes a result.

Both bitmaps have a bucket for each 16 bytes of text, at most 2**MOST_BITS (16 MB of bits). A worker adds
up buckets in one byte each (counts stop at the least count, which is all that is asked), and their
sums are merged by slices of the table. Past about ten times as many words as buckets, some 20 GB of
text, most bits are set; the result stays the same, and pruning rests on the frequent parts. Texts are read once a pass, and counts are added up within a
block of texts and within a task before they are shuffled.

Defined results: null and empty texts have no words; a null language is `und`; repeated rows count
as often as they stand there; ties are ordered by count and by phrase; an empty table gives no rows;
further columns are not read, whatever their names. A text is held whole, at about 60 bytes a byte.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .base import _BYTE, LOWER, U64, Block, Hasher, blocks, cut, drop_cut, mix64, runs, stream64, table, tidy

LEAST, MOST_WORDS, TOP = 10, 3, 2000
INSIDE = 50
LEAST_BITS, MOST_BITS, SLICE = 16, 27, 16
BLOCK = 2 << 20

_PIECE = np.zeros(256, bool)
_PIECE[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
_IN_WORD = ~_PIECE
_IN_WORD[[9, 32]] = False
_BYTE2 = stream64(256, 991)
_PAIR, _PAIR2 = U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F)
_COUNTED = "lang string, phrase string, n long, slice int, counts binary"


def lang_seed(lang: str) -> np.uint64:
    return U64(int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little"))


class Phrases:
    """The words of a block and two independent hashes of each phrase of n of them (rows i to i + n - 1 of one piece)."""

    def __init__(self, block: Block, seeds: np.ndarray):
        self.data = LOWER[block.data]
        self.starts, self.ends, self.doc = runs(self.data, block.offs, _IN_WORD)
        cum = np.zeros(len(self.data) + 1, np.int64)
        np.cumsum(_PIECE[self.data], out=cum[1:])
        self.next = np.zeros(len(self.starts), bool)  # whether the word after this one belongs to its piece
        if len(self.starts):
            self.next[:-1] = (self.doc[1:] == self.doc[:-1]) & (cum[self.starts[1:]] == cum[self.ends[:-1]])
        self.h = [Hasher(_BYTE[self.data]).spans(self.starts, self.ends) ^ seeds[self.doc]]
        self.g = [Hasher(_BYTE2[self.data]).spans(self.starts, self.ends)]
        self.valid = [np.ones(len(self.starts), bool)]

    def up_to(self, n: int) -> None:
        while len(self.h) < n:
            k = len(self.h)
            longer = np.zeros_like(self.valid[-1])
            h, g = np.zeros_like(self.h[0]), np.zeros_like(self.g[0])
            if len(h) > k:
                longer[:-k] = self.valid[-1][:-k] & self.next[k - 1 : -1]
                h[:-k] = mix64(self.h[-1][:-k] * _PAIR + self.h[0][k:])
                g[:-k] = mix64(self.g[-1][:-k] * _PAIR2 + self.g[0][k:])
            self.valid.append(longer)
            self.h.append(h)
            self.g.append(g)

    def joined(self, first: np.ndarray, n: int) -> pa.StringArray:
        """The phrases of n words from each word of first, joined by single spaces."""
        word = (first[:, None] + np.arange(n)).ravel()
        size = self.ends[word] - self.starts[word]
        apart = np.tile(np.arange(n) < n - 1, len(first))
        size = size + apart  # the byte behind a word that is not the last is its separator
        stop = size.cumsum()
        at = np.repeat(self.starts[word] - (stop - size), size) + np.arange(stop[-1] if len(stop) else 0)
        raw = self.data[at]
        raw[stop[apart] - 1] = 32
        offs = np.zeros(len(first) + 1, np.int32)
        offs[1:] = stop[n - 1 :: n]
        return pa.StringArray.from_buffers(len(first), pa.py_buffer(offs), pa.py_buffer(np.ascontiguousarray(raw)))


class Buckets:
    """Counts by hash bucket, up to `least`."""

    def __init__(self, least: int, bits: int):
        self.least, self.bits, self.n = least, bits, np.zeros(1 << bits, np.uint8)

    def add(self, h: np.ndarray) -> None:
        at, n = np.unique(place(h, self.bits), return_counts=True)
        self.n[at] = np.minimum(self.n[at] + n, self.least)

    def rows(self) -> Iterator[pa.RecordBatch]:
        step = 1 << min(SLICE, self.bits)
        full = [i for i in range(0, len(self.n), step) if self.n[i : i + step].any()]
        for k in range(0, len(full), 32):
            some = full[k : k + 32]
            none = pa.nulls(len(some))
            cols = [none.cast(pa.string()), none.cast(pa.string()), none.cast(pa.int64()), pa.array([i // step for i in some], pa.int32()), pa.array([self.n[i : i + step].tobytes() for i in some], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["lang", "phrase", "n", "slice", "counts"])


def place(h: np.ndarray, bits: int) -> np.ndarray:
    return (mix64(h) >> U64(64 - bits)).astype(np.int64)


def is_set(bitmap: np.ndarray, h: np.ndarray, bits: int) -> np.ndarray:
    at = place(h, bits)
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


def _pass(n: int, known, least: int, most: int, bits: int):
    """Pass n over (lang, text): counts of phrases of n words, words by language (phrase ''), and the buckets of longer phrases."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        longer = Buckets(least, bits) if n < most else None
        seeds: dict[str, np.uint64] = {}
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            seed = np.array([seeds.setdefault(x, lang_seed(x)) for x in langs], U64)
            for block in blocks(batch.column("text"), BLOCK):
                mine = slice(block.first, block.first + block.n)
                p = Phrases(block, seed[mine])
                p.up_to(min(n + 1, most))
                ok = p.valid[n - 1]
                if n > 1:
                    parts, buckets = known.value
                    fit = is_set(parts, p.h[n - 2], bits)
                    ok = ok.copy()
                    ok[:-1] &= fit[:-1] & fit[1:]
                    ok &= is_set(buckets, p.h[n - 1], bits)
                if longer is not None and len(ok):
                    more = p.valid[n].copy()
                    more[:-1] &= ok[:-1] & ok[1:]
                    longer.add(p.h[n][more])
                at = np.flatnonzero(ok)
                order = np.argsort(p.h[n - 1][at], kind="stable")
                at = at[order]
                h, g = p.h[n - 1][at], p.g[n - 1][at]
                new = np.ones(len(at), bool)
                new[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
                first = np.flatnonzero(new)
                names = pa.array(langs[mine], pa.string())
                count = np.diff(np.append(first, len(at)))
                yield _counts(names.take(pa.array(p.doc[at[first]])), p.joined(at[first], n), count)
                if n == 1:
                    per = np.bincount(p.doc, minlength=block.n)
                    totals: dict[str, int] = {}
                    for x, c in zip(langs[mine], per.tolist(), strict=True):
                        totals[x] = totals.get(x, 0) + c
                    yield _counts(pa.array(list(totals), pa.string()), pa.array([""] * len(totals), pa.string()), np.array(list(totals.values()), np.int64))
            tidy()
        if longer is not None:
            yield from longer.rows()

    return run


def _counts(lang: pa.Array, phrase: pa.Array, n: np.ndarray) -> pa.RecordBatch:
    none = pa.nulls(len(lang))
    return pa.RecordBatch.from_arrays([lang, phrase, pa.array(n.astype(np.int64)), none.cast(pa.int32()), none.cast(pa.binary())], ["lang", "phrase", "n", "slice", "counts"])


def _known(least: int, n: int, bits: int):
    """The buckets of phrases (lang, phrase) that are frequent, as counted ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Buckets(least, bits)
        for batch in batches:
            seed = np.array([lang_seed(x) for x in batch.column("lang").to_pylist()], U64)
            for block in blocks(batch.column("phrase"), BLOCK):
                p = Phrases(block, seed[block.first : block.first + block.n])
                p.up_to(n)
                out.n[place(p.h[n - 1][p.valid[n - 1]], bits)] = least
        yield from out.rows()

    return run


def _merged(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, raw in zip(batch.column("slice").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                n = np.frombuffer(raw, np.uint8)
                held[i] = np.minimum(held[i] + n, least) if i in held else n
        keys = list(held)
        bits = [np.packbits(held[i] >= least, bitorder="little").tobytes() for i in keys]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(bits, pa.binary())], ["slice", "bits"])

    return run


def bitmap(parts: DataFrame, least: int, bits: int) -> np.ndarray:
    """The bits of the buckets that reach `least` in all parts (slice, counts); 2**bits of them reach the driver."""
    step = 1 << min(SLICE, bits)
    merged = parts.select("slice", "counts").repartition(F.col("slice")).mapInArrow(_merged(least), "slice int, bits binary")
    out = np.zeros((1 << bits) // 8, np.uint8)
    for r in merged.toLocalIterator():
        out[r.slice * step // 8 : (r.slice + 1) * step // 8] = np.frombuffer(r.bits, np.uint8)
    return out


def table_bits(docs: DataFrame) -> int:
    """The size of the bucket table for these texts, in bits of a place in it."""
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    return min(MOST_BITS, max(LEAST_BITS, (size // 16).bit_length() - 1))


def frequent(docs: DataFrame, least: int = LEAST, most: int = MOST_WORDS, bits: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(lang, words, phrase, f) of phrases of 1 to `most` words that occur `least` times or more, and (lang, n), the words of each language; docs has lang and text."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    bits = bits or table_bits(docs)
    found, totals, known = [], None, None
    for n in range(1, most + 1):
        raw = cut(rows.mapInArrow(_pass(n, known, least, most, bits), _COUNTED))
        counted = raw.where("slice is null").groupBy("lang", "phrase").agg(F.sum("n").alias("f"))
        if n == 1:
            totals = cut(counted.where("phrase = ''").select("lang", F.col("f").alias("n")))
        often = cut(counted.where((F.col("f") >= least) & (F.col("phrase") != "")).select("lang", F.lit(n).alias("words"), "phrase", "f"))
        found.append(often)
        if n < most:
            parts = bitmap(often.mapInArrow(_known(least, n, bits), _COUNTED), least, bits)
            known = spark.sparkContext.broadcast((parts, bitmap(raw.where("slice is not null"), least, bits)))
        drop_cut(raw)
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out, totals


def _part(first: int, last: int) -> F.Column:
    """Words first to last (from 1) of the phrase."""
    return F.array_join(F.slice("w", first, last - first + 1), " ")


def collocations(docs: DataFrame, least: int = LEAST, most: int = MOST_WORDS, top: int = TOP, inside: int = INSIDE, bits: int | None = None) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best phrases of 2 to `most` words of each language.

    A phrase scores floor(1000000 a a / (l r)) at its weakest cut. Phrases that lie inside a longer
    one with at least `inside` % of their occurrences are left out.
    """
    all_, totals = frequent(docs, least, most, bits)
    phrases = all_.where("words > 1").withColumn("w", F.split("phrase", " "))
    halves = [F.struct(F.lit(k).alias("k"), _part(1, k).alias("l"), F.array_join(F.slice("w", k + 1, most), " ").alias("r")) for k in range(1, most)]
    cuts = phrases.select("lang", "phrase", "f", F.explode(F.filter(F.array(*halves), lambda x: x["r"] != "")).alias("c"))
    sides = cuts.select("lang", "phrase", "f", F.explode(F.array(*[F.struct(F.col("c.k").alias("k"), F.lit(s).alias("side"), F.col(f"c.{s}").alias("part")) for s in "lr"])).alias("c")).select("lang", "phrase", "f", "c.*")
    part = all_.select("lang", F.col("phrase").alias("part"), F.col("f").alias("pf"))
    valued = sides.join(part, ["lang", "part"]).select("lang", "phrase", "k", "side", F.col("f").alias("a"), "pf", F.lit(0).cast("long").alias("over"))
    # a phrase of m words names each shorter one of 2 words or more inside it, which thereby learns the largest count of a longer one
    spans = [F.when(F.size("w") > n, _part(i, i + n - 1)) for n in range(2, most) for i in range(1, most - n + 2)]
    names = F.array_distinct(F.filter(F.array(*spans), lambda x: x.isNotNull())) if spans else F.array().cast("array<string>")
    none = F.lit(None)
    over = phrases.select("lang", F.explode(names).alias("phrase"), none.cast("int").alias("k"), none.cast("string").alias("side"), none.cast("long").alias("a"), none.cast("long").alias("pf"), F.col("f").alias("over"))
    pick = lambda k, s: F.max(F.when((F.col("k") == k) & (F.col("side") == s), F.col("pf")))
    one = valued.unionByName(over).groupBy("lang", "phrase").agg(F.max("a").alias("a"), F.max("over").alias("over"), *[pick(k, s).alias(f"{s}{k}") for k in range(1, most) for s in "lr"])
    whole = lambda x: F.col(x).cast("decimal(19,0)")
    score = lambda k: F.call_function("div", whole("a") * whole("a") * F.lit(1_000_000).cast("decimal(7,0)"), whole(f"l{k}") * whole(f"r{k}"))
    weakest = F.least(*[F.when(F.col(f"l{k}").isNotNull(), F.struct(score(k).cast("long").alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"))) for k in range(1, most)], F.lit(None))
    kept = one.where(F.col("a").isNotNull() & (F.col("over") * 100 < F.col("a") * inside)).select("lang", "phrase", "a", weakest.alias("x")).select("lang", "phrase", "a", "x.l", "x.r", "x.score")
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # the best of 64 shares of a language first, so that no task sorts all phrases of one
    share = Window.partitionBy("lang", "share").orderBy(*best)
    few = kept.withColumn("share", F.pmod(F.hash("phrase"), F.lit(64))).withColumn("rank", F.row_number().over(share)).where(F.col("rank") <= top)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best))).where(F.col("rank") <= top)
    return ranked.join(F.broadcast(totals), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents").select("lang", "text"))


OP13_SQL = rf"""
with piece as (
  select coalesce(lang, 'und') as lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as p
  from documents),
word as (select lang, regexp_extract_all(p, '[^\x20\x09]+') as w from piece),
gram as (
  select lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) as phrase
  from word, (select unnest([1, 2, 3]) as k) where len(w) >= k),
freq as (select lang, k, phrase, count(*) as f from gram group by all),
total as (select lang, sum(f) as n from freq where k = 1 group by lang),
cand as (select lang, k as words, phrase, f as a, string_split(phrase, ' ') as w from freq where k > 1 and f >= {LEAST}),
cuts as (
  select lang, words, phrase, a, w, k, array_to_string(w[1:k], ' ') as first, array_to_string(w[k + 1:], ' ') as rest
  from cand, (select unnest([1, 2]) as k) where k < words),
scored as (
  select c.lang, c.phrase, c.a, c.k, x.f as l, y.f as r,
         (1000000::hugeint * c.a::hugeint * c.a::hugeint) // (x.f::hugeint * y.f::hugeint) as score
  from cuts c join freq x on x.lang = c.lang and x.phrase = c.first and x.k = c.k
              join freq y on y.lang = c.lang and y.phrase = c.rest and y.k = c.words - c.k),
weakest as (select *, row_number() over (partition by lang, phrase order by score, k) as i from scored),
inside as (
  select lang, phrase, max(a) as over from (
    select lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) as phrase from cand where words = 3) group by all),
ranked as (
  select s.lang, s.phrase, s.a, s.l, s.r, s.score, row_number() over (partition by s.lang order by s.score desc, s.a desc, encode(s.phrase)) as rank
  from weakest s left join inside i on i.lang = s.lang and i.phrase = s.phrase
  where s.i = 1 and (i.over is null or i.over * 100 < s.a * {INSIDE}))
select lang, cast(rank as bigint) as rank, phrase, cast(a as bigint) as a, cast(l as bigint) as l, cast(r as bigint) as r, cast(n as bigint) as n, cast(score as bigint) as score
from ranked join total using (lang) where rank <= {TOP}
"""
