"""The stored proximity graph and the log of batches against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.operators import graph
from lumenfold.sources.store import Log
from lumenfold.streaming import jobs


def frame(spark, ids, x):
    return spark.createDataFrame([(int(i), [float(c) for c in r]) for i, r in zip(ids, x, strict=True)], "vec_id long, embedding array<float>")


def recall(found, ids, x, asked, k):
    got = {}
    for r in found:
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hit = 0
    for i, q in asked:
        s = x @ q
        hit += len(got.get(i, set()) & set(np.asarray(ids)[np.lexsort((ids, -s))[:k]].tolist()))
    return hit / (k * len(asked))


def test_graph_finds_neighbours_after_additions_and_removals(spark, tmp_path):
    rng = np.random.default_rng(2)
    centre = rng.standard_normal((30, 16))
    x = centre[rng.integers(0, 30, 900)] + 0.5 * rng.standard_normal((900, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[700:740] = x[3]  # a group of copies
    q = x[::45] + 0.05 * rng.standard_normal((20, 16))
    asked = [(i, r) for i, r in enumerate(q)]
    queries = frame(spark, range(20), q).withColumnRenamed("vec_id", "query_id")
    ids = np.arange(900)
    index = graph.GraphIndex(spark, str(tmp_path)).build(frame(spark, ids[:800], x[:800]))
    index.add(frame(spark, ids[800:], x[800:]))
    found = index.search(queries, 10).collect()
    assert recall(found, ids, x, asked, 10) >= 0.9
    left = ids[(ids % 5 != 0)]
    index.remove(spark.createDataFrame([(int(i),) for i in ids[ids % 5 == 0]], "vec_id long"))
    found = index.search(queries, 10).collect()
    assert {r.vec_id for r in found} <= set(left.tolist()) and recall(found, left, x[left], asked, 10) >= 0.9
    assert index.tables.load("lists").groupBy("src").count().agg(F.max("count")).first()[0] <= graph.DEGREE


def test_registered_graph_query_reaches_its_recall(spark):
    from lumenfold.catalog import QUERIES

    sf = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    x, ids = np.array([r.embedding for r in rows], float), np.array([r.vec_id for r in rows])
    found = QUERIES["graph_topk"](spark, sf).collect()
    hit = total = 0
    for i in np.flatnonzero(ids % 100 == 0):
        s = x @ x[i]
        s[i] = -np.inf
        best = set(ids[np.lexsort((ids, -s))[:10]].tolist())
        hit, total = hit + len(best & {r.vec_id for r in found if r.query_id == ids[i]}), total + 10
    assert hit >= 0.9 * total


def test_log_against_a_dictionary(spark, tmp_path):
    log, rng, want = Log(spark, str(tmp_path / "log"), "k"), np.random.default_rng(6), {}
    assert log.read() is None and log.compact() == 0
    for n in range(14):
        size = 3000 if n == 0 else int(rng.integers(1, 12))
        rows = {int(k): (int(v), bool(g)) for k, v, g in zip(rng.integers(0, 4000, size), rng.integers(0, 99, size), rng.random(size) < 0.3, strict=True)}
        batch = spark.createDataFrame([(k, v, g) for k, (v, g) in rows.items()] + [(None, 1, False)], "k long, v long, deleted boolean").coalesce(1)
        before = {x: log.bytes(x) for _, _, x in log.runs()}
        assert log.append(batch, "a", n) and not log.append(batch, "a", n)  # repeating a batch adds nothing
        if n:
            (new,) = {x for _, _, x in log.runs()} - set(before)
            assert log.bytes(new) < max(before.values()) / 4  # what a batch writes follows the batch
        for k, (v, g) in rows.items():
            want.pop(k, None) if g else want.update({k: v})
        if n % 2:
            log.compact()
        if n in (0, 5, 13):
            assert {r.k: r.v for r in log.read().collect()} == want
    assert len(log.runs()) <= 6 and not log.append(batch, "a", 3)
    assert log.append(spark.createDataFrame([(1, 7, False)], "k long, v long, deleted boolean"), "b", 0) and log.read().where("k = 1").first().v == 7


def test_log_survives_a_merge_that_did_not_end_and_one_that_was_not_cleared(spark, tmp_path):
    log = Log(spark, str(tmp_path), "k")
    make = lambda v: spark.createDataFrame([(1, v, False)], "k long, v long, deleted boolean")
    for n in range(3):
        log.append(make(n), "s", n)
    make(9).withColumnRenamed("deleted", "_gone").write.parquet(f"{tmp_path}/run={0:012d}-{2:012d}")
    (tmp_path / f"run={0:012d}-{2:012d}" / "_SUCCESS").unlink()
    assert [r.v for r in log.read().collect()] == [2] and len(log.runs()) == 3
    assert log.compact() == 3 and [r.v for r in log.read().collect()] == [2] and len(log.runs()) == 1 and len(log._found()) == 4


@pytest.mark.parametrize("times", [1, 2])
def test_a_stream_that_repeats_its_last_batch_adds_it_once(spark, tmp_path, times):
    schema, src, store = "path string, content_hash string, deleted boolean", str(tmp_path / "in"), str(tmp_path / "store")
    spark.createDataFrame([("a", "1", False), ("b", "1", False)], schema).coalesce(1).write.parquet(src)
    for _ in range(times):
        jobs.keep_index(jobs.watch(spark, src, schema), store, "path", str(tmp_path / "c")).awaitTermination()
        for done in (tmp_path / "c" / "commits").glob("*0"):  # as if the driver had been lost before it noted the batch
            done.unlink()
        for done in (tmp_path / "c" / "commits").glob(".*0.crc"):
            done.unlink()
    assert sorted(r.path for r in jobs.read_index(spark, store, "path").collect()) == ["a", "b"] and len(Log(spark, store, "path").runs()) == 1
