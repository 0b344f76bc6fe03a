"""From raw documents to a sampled token corpus, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents. Null or empty texts are rejected by the first stage, since they have no language. A text
that the second stage empties was repeated elsewhere as a whole and goes.

Every stage works on all rows that reach it. Rows with a null doc_id, rows that share one, and rows with a
null source pass like others; an empty table gives an empty table; the columns of the input other than
those in READ are kept: they pass each stage in one struct, so none of their names meets the operators' own.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm import langid, linededup, mixing, neardup, pieces
from lumenfold.llm.base import cut

#: Below this share of its profile's order kept a text is in none of the learned languages; the least score on sf0.01 is 0.45.
LEAST_LANG_SCORE = 0.1
#: What the stages read and write.
READ = ("doc_id", "text", "lang", "source", "n_chars")
CARRIED = "_carried"
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def carrying(stage: Stage) -> Stage:
    """The stage on the columns of READ, the others in one struct beside them; the result has all columns in their places."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        own = {c: F.col("`" + c.replace("`", "``") + "`") for c in docs.columns}
        read, others = ([c for c in docs.columns if (c.lower() in READ) == wanted] for wanted in (True, False))
        if not others:
            return stage(spark, docs, sf_dir)
        out = stage(spark, docs.select(*read, F.struct(*(own[c] for c in others)).alias(CARRIED)), sf_dir)
        return out.select(*(F.col(c) if c in read else F.col(CARRIED).getField(c).alias(c) for c in docs.columns))

    return run


@carrying
def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps texts in one of the learned languages; a null lang is filled with the prediction."""
    model = langid.fit(docs)
    out = langid.predict(docs, model).where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_LANG_SCORE))
    return out.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*docs.columns)


@carrying
def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out lines that stand in an earlier text too; n_chars follows. A text that was empty of words before stays."""
    out = linededup.remove_repeated(docs)
    out = out.where((F.col("removed_lines") == 0) | F.col("text").rlike(r"\S"))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


@carrying
def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Decides by row: of each component the row of the smallest doc_id stays (of rows that share it, that of the
    smallest hash of its text); rows without doc_id link with nothing and stay."""
    # written once, so that the numbers of the rows hold
    rows = cut(docs.withColumn("_row", F.monotonically_increasing_id()))
    named = rows.where("doc_id is not null")
    found = neardup.near_duplicates(named, doc_id="_row").select(F.col("doc_id").alias("_row"), "component_id")
    order = named.select("_row", F.struct("doc_id", F.xxhash64("text"), "_row").alias("order"))
    keep = found.join(order, "_row").groupBy("component_id").agg(F.min_by("_row", "order").alias("_row")).select("_row")
    return named.join(keep, "_row", "left_semi").unionByName(rows.where("doc_id is null")).select(*docs.columns)


@carrying
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the mix takes twice come twice."""
    out = mixing.apply_mix(docs).where(F.col("_copies") > 0)
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).select(*docs.columns)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_pieces, pieces): one sampled segmentation a row; rows of one doc_id and text are cut alike."""
    out = pieces.encode(docs.select("doc_id", "lang", "source", "text"))
    return out.select("doc_id", "lang", "source", F.size("pieces").cast("long").alias("n_pieces"), "pieces")


STAGES: list[tuple[str, Stage]] = [
    ("language", identify_languages),
    ("line_dedup", remove_repeated_passages),
    ("near_dedup", keep_one_of_near_duplicates),
    ("mix", mix_sources),
    ("pieces", encode_pieces),
]
#: Rank-order prediction, rolling hashes over line hashes and seeded sampling have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs)
    return docs
