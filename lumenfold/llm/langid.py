"""Language identification by rank-order profiles.

A profile is the list of a language's most frequent byte n-grams (one to three bytes, lower-cased,
with anything that is not part of a word as one blank). A text gets the language whose profile
has the least out-of-place distance to the text's own list.

A text is held whole, at about 40 bytes a byte; texts of many megabytes count in full.

Defined results: null texts and texts without a letter are `und` with score 0; ties go to the
language that sorts first; rows with null language train nothing; with no training row at all
every text is `und`; repeated rows are predicted alike; further columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .base import LOWER, Block, blocks, table, tidy

PROFILE = 400
GRAMS = 3
SALTS = 32

_CLASS = LOWER.copy()
for _b in range(128):
    if not chr(_b).isalpha():
        _CLASS[_b] = 32
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[97:123] = _ASCII_LETTER[65:91] = True


def _symbols(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """The block's bytes with runs of blanks made one, and where each text begins in them."""
    d = _CLASS[block.data]
    wide = np.zeros(len(d), bool)
    wide[1:] = (block.data[:-1] == 0xC3) & (block.data[1:] >= 0x80) & (block.data[1:] <= 0x9E) & (block.data[1:] != 0x97)
    d = np.where(wide, d + np.uint8(32), d)
    keep = np.ones(len(d), bool)
    keep[1:] = (d[1:] != 32) | (d[:-1] != 32)
    keep[block.offs[:-1][block.offs[:-1] < block.offs[1:]]] = True  # a text's first byte, whatever the text before it ended in
    at = np.zeros(len(d) + 1, np.int64)
    np.cumsum(keep, out=at[1:])
    return d[keep], at[block.offs]


def _codes(d: np.ndarray) -> list[np.ndarray]:
    """Codes of the n-grams that begin at each byte, n in the top byte."""
    one = d.astype(np.uint32)
    out = [one | np.uint32(1 << 24)]
    if len(d) > 1:
        two = (one[:-1] << 8) | one[1:]
        out.append(two | np.uint32(2 << 24))
    if len(d) > 2:
        out.append(((two[:-1] << 8) | one[2:]) | np.uint32(3 << 24))
    return out


def _has_letter(block: Block, i: int) -> bool:
    a, b = block.offs[i], block.offs[i + 1]
    return bool(_ASCII_LETTER[block.data[a:b]].any()) or any(c.isalpha() for c in block.text(i).decode("utf-8", "replace"))


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names: dict[str, int] = {}
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        if held:
            keys = np.concatenate([k for k, _ in held])
            counts = np.concatenate([c for _, c in held])
            keys, back = np.unique(keys, return_inverse=True)
            sums = np.bincount(back, counts, len(keys)).astype(np.int64)
            label = list(names)
            yield pa.RecordBatch.from_arrays(
                [pa.array([label[i] for i in keys >> np.uint64(32)], pa.string()), pa.array((keys & np.uint64(0xFFFFFFFF)).astype(np.int64)), pa.array(sums)],
                ["lang", "gram", "n"],
            )
            held.clear()

    for batch in batches:
        langs = batch.column("lang").to_pylist()
        for block in blocks(batch.column("text")):
            d, st = _symbols(block)
            tag = np.array([names.setdefault(x, len(names)) for x in langs[block.first : block.first + block.n]], np.uint64)
            of = np.repeat(tag, np.diff(st)) << np.uint64(32)
            doc = np.repeat(np.arange(block.n), np.diff(st))
            for n, code in enumerate(_codes(d)):
                whole = doc[: len(code)] == doc[n:]
                k, c = np.unique((of[: len(code)] | code)[whole], return_counts=True)
                held.append((k, c))
                size += len(k)
            if size > 1_000_000:
                yield from flush()
                size = 0
        tidy()
    yield from flush()


@dataclass
class Profiles:
    """langs, and for each n-gram of any profile its rank by language (PROFILE where it is absent)."""

    langs: list[str]
    grams: np.ndarray
    ranks: np.ndarray


def fit(train: DataFrame, text: str = "text", lang: str = "lang", profile: int = PROFILE) -> Profiles:
    """Profiles of all rows of train; `profile` n-grams for each language come to the driver."""
    rows = train.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    counts = rows.mapInArrow(_count_grams, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    by = [F.desc("n"), F.asc("gram")]
    part = Window.partitionBy("lang", F.pmod("gram", F.lit(SALTS))).orderBy(*by)
    few = counts.withColumn("r", F.row_number().over(part)).where(F.col("r") <= profile)
    top = few.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(*by))).where(F.col("r") <= profile)
    found = top.select("lang", "gram", "r").toPandas()
    langs = sorted(found["lang"].unique())
    grams = np.unique(found["gram"].to_numpy(np.uint32)) if len(found) else np.zeros(0, np.uint32)
    ranks = np.full((len(grams) + 1, len(langs)), profile, np.int32)
    if len(found):
        ranks[np.searchsorted(grams, found["gram"].to_numpy(np.uint32)), [langs.index(x) for x in found["lang"]]] = found["r"].to_numpy() - 1
    return Profiles(langs, grams, ranks)


def out_of_place(model: Profiles, codes: np.ndarray, profile: int = PROFILE) -> np.ndarray:
    """Mean out-of-place distance to each language, from 0 to 1."""
    keys, counts = np.unique(codes, return_counts=True)
    order = ((np.int64(1 << 31) - counts) << np.int64(32)) | keys.astype(np.int64)
    if len(order) > profile:
        order = np.partition(order, profile - 1)[:profile]
    order.sort()
    mine = (order & 0xFFFFFFFF).astype(np.uint32)
    at = np.searchsorted(model.grams, mine)
    at[at == len(model.grams)] = 0
    row = np.where(model.grams[at] == mine, at, len(model.grams))
    theirs = model.ranks[row]
    far = np.abs(theirs - np.arange(len(mine))[:, None])
    return np.where(theirs < profile, far, profile).sum(axis=0) / (len(mine) * profile)


def predict(docs: DataFrame, model: Profiles, text: str = "text", profile: int = PROFILE) -> DataFrame:
    """docs with lang_pred and score added (columns of these names are replaced)."""
    docs = docs.drop("lang_pred", "score")
    held = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            langs, scores = [], []
            for block in blocks(batch.column(text)):
                d, st = _symbols(block)
                codes = _codes(d)
                for i in range(block.n):
                    a, b = st[i], st[i + 1]
                    if not m.langs or a == b or not _has_letter(block, i):
                        langs.append("und")
                        scores.append(0.0)
                        continue
                    own = np.concatenate([c[a : max(a, b - n)] for n, c in enumerate(codes)])
                    far = out_of_place(m, own, profile)
                    best = int(far.argmin())
                    langs.append(m.langs[best])
                    scores.append(float(min(1.0, max(0.0, 1.0 - far[best]))))
            tidy()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*batch.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(run, schema)


def remainder(doc_id: str, by: int) -> F.Column:
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(by))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(remainder("doc_id", 4) == 2, F.lit(False))
    model = fit(docs.where(~held_out).select("text", "lang"))
    out = predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
