"""Repeated spans are decided by their bytes, whatever their digests say."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from lumenfold.llm import linededup, queries

SF = "/root/testdata/sf0.001"
LONG = [" ".join(f"{c}{i}" for i in range(55)) for c in "abcdefgh"]
TEXTS = [
    (1, f"{LONG[0]}\n{LONG[1]}\n\nown line of one"),
    (2, f"own line of two\n{LONG[1]}\n\n{LONG[2]}"),
    (3, f"{LONG[2]}\nshort one here\nshort two here\nshort three\n{LONG[3]}"),
    (4, f"{LONG[4]}\n{LONG[4]}\n{LONG[4]}"),
    (5, f"{LONG[0]}\n{LONG[1]}\n\nown line of one"),
    (None, f"{LONG[3]}\n{LONG[5]}"),
    (7, "the same line of seven words again\n" * 40),
    (8, "une ligne é\nà côté\n" * 30 + LONG[6]),
    (9, None),
    (10, ""),
]


@pytest.mark.parametrize("digest", [1, 2])
def test_digests_that_collide_change_nothing(spark, digest):
    """Of 256 or 65,536 digests many are shared by different spans; all of these stay."""
    more = [(100 + i, "\n".join([f"line {i} alone {j} of many words" for j in range(12)] + [LONG[i % 8]] + [f"tail {i % 5} {j}" for j in range(9)])) for i in range(60)]
    df = spark.createDataFrame(TEXTS + more, "doc_id long, text string").repartition(3)
    sure, weak = (Counter((r.doc_id, r.text, r.n_lines, r.removed_lines) for r in linededup.remove_repeated(df, digest=size).collect()) for size in (16, digest))
    assert weak == sure and sum(k[3] for k in sure) > 100


def test_query_gives_the_operators_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    want = linededup.remove_repeated(docs, digest=2).select("doc_id", "n_lines", "removed_lines", F.length("text").cast("long"), F.xxhash64("text")).collect()
    assert Counter(queries.QUERIES["op6_line_dedup"](spark, SF).collect()) == Counter(want)
