"""Models over tables, against plain loops."""

import numpy as np

from lumenfold import retrieval_queries as rq
from lumenfold.operators import inference as inf


def test_batches_hold_every_row_once_within_bounds():
    lengths = [5, 900, 1, 1, 1, 7, 3, 2000, 2]
    got = inf.batches(lengths, rows=3, area=1000)
    assert sorted(i for b in got for i in b) == list(range(len(lengths)))
    assert all(len(b) <= 3 and (len(b) == 1 or len(b) * max(lengths[i] for i in b) <= 1000) for b in got)
    assert [7] in got and inf.batches([]) == []


def test_scores_of_a_table_are_those_of_a_plain_loop(spark):
    rows = [(i, None if i % 7 == 0 else "q" * (i % 5), None if i % 11 == 0 else "t" * (i % 13)) for i in range(500)] + [(500, "", "x" * 300_000)]
    df = spark.createDataFrame(rows, "id long, a string, b string").repartition(5)

    def load():
        return lambda a, b: [len(x) * 1000 + len(y) for x, y in zip(a, b, strict=True)]

    got = {r.id: r.s for r in inf.scored(df, ["a", "b"], load, "s", 16, 64).collect()}
    assert got == {i: None if a is None or b is None else float(len(a) * 1000 + len(b)) for i, a, b in rows}


def test_a_model_is_loaded_once_a_worker_not_once_a_batch(spark, tmp_path):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    folder = str(tmp_path)

    def load():
        import tempfile

        tempfile.mkstemp(dir=folder)
        return lambda a: [0.0] * len(a)

    df = spark.range(0, 400, 1, 2).selectExpr("cast(id as string) as a")
    assert inf.scored(df, ["a"], load).where("model_score = 0").count() == 400
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert 1 <= len(list(tmp_path.iterdir())) <= 2


def test_rerank_with_nulls_ties_and_a_query_of_most_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(1 if i % 3 else 2, i, "a b c", None if i % 50 == 0 else " ".join(rng.choice(list("abcdef"), 4))) for i in range(600)]
    rows += [(3, 900, "a", None), (4, 901, None, "a")]
    df = spark.createDataFrame(rows, "query_id long, key long, query string, content string").withColumn("score", inf.F.lit("clash")).withColumn("_x", inf.F.lit(1))
    got = sorted((r.query_id, r.rank, r.key, r.score) for r in inf.rerank(df, rq.shared_words, 4).collect())
    score = rq.shared_words()
    want = []
    for q in (1, 2, 3, 4):
        own = [(k, None if a is None or t is None else score([a], [t[:500]])[0]) for i, k, a, t in rows if i == q]
        own.sort(key=lambda x: (x[1] is None, -(x[1] or 0), x[0]))
        want += [(q, r + 1, k, s) for r, (k, s) in enumerate(own[:4])]
    assert got == want
    assert inf.rerank(df.limit(0), rq.shared_words, 4).collect() == []
