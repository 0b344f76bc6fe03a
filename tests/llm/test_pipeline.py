from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
A, B, C, D, E = [" ".join(f"{w} the and of {c}{i}" for i, w in enumerate(["house", "river", "town", "people", "street"] * 5)) for c in "abcde"]
ROWS = [(1, A), (7, A), (7, B), (None, C), (None, D), (5, E), (5, E)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", "web", len(t)) for i, t in ROWS], SCHEMA).repartition(3)


def held(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


def test_language_keeps_null_and_repeated_ids(spark, docs):
    assert held(corpus_pipeline.identify_languages(spark, docs, "")) == Counter(ROWS)


def test_line_dedup_with_null_and_repeated_ids(spark, docs):
    assert held(corpus_pipeline.remove_repeated_passages(spark, docs, "")) == Counter([(1, A), (7, B), (None, C), (None, D), (5, E)])


def test_near_dedup_decides_by_row(spark, docs):
    assert held(corpus_pipeline.keep_one_of_near_duplicates(spark, docs, "")) == Counter([(1, A), (7, B), (None, C), (None, D), (5, E)])
    assert corpus_pipeline.keep_one_of_near_duplicates(spark, docs.where("false"), "").count() == 0


def test_mix_and_pieces_keep_null_and_repeated_ids(spark, docs):
    mixed = held(corpus_pipeline.mix_sources(spark, docs, ""))
    assert all(n <= 2 * Counter(ROWS)[k] for k, n in mixed.items())
    out = corpus_pipeline.encode_pieces(spark, docs, "").collect()
    assert Counter(r.doc_id for r in out) == Counter(i for i, _ in ROWS) and all(r.n_pieces > 0 for r in out)


def test_columns_named_like_the_operators_own(spark, docs):
    names = ["score", "_own", "lang_pred", "n_lines", "removed_lines", "_row", "_size", "_source_size", "_target", "_copies", "_copy", "_carried", "component_id", "a.b"]
    more = docs.select("*", *(F.concat(F.lit(n), F.coalesce("text", F.lit(""))).alias(n) for n in names))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, more, "")
        assert out.columns == more.columns, name
        rows = out.collect()
        assert held(out) == held(stage(spark, docs, "")) and all(r[n] == n + r.text for r in rows for n in names), name
    assert corpus_pipeline.encode_pieces(spark, more, "").count() == len(ROWS)
