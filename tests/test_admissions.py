"""Admission in parts of one caller, and as a stream with timers, against one plain pass."""

import random

import pytest

from lumenfold.operators import history
from lumenfold.streaming import jobs


def plain(rows, rpm, tpm, seconds):
    out, by = {}, {}
    for who, i, ts, n in rows:
        if ts is None:
            out[i] = (False, None)
        else:
            by.setdefault(who, []).append((ts, i, n or 0))
    for own in by.values():
        own.sort()
        got, _ = history.admit([t for t, _, _ in own], [n for _, _, n in own], rpm, tpm, seconds)
        out |= {i: (ok, round(w, 6)) for (_, i, _), (ok, w) in zip(own, got, strict=True)}
    return out


def found(df):
    return {r.id: (r.admitted, None if r.retry_after is None else round(r.retry_after, 6)) for r in df.collect()}


SCHEMA = "caller string, id long, ts double, tokens long"


@pytest.mark.parametrize(("rpm", "tpm", "step"), [(3, 0, 1.0), (0, 9, 2.0), (4, 12, 30.0)])
def test_parts_of_one_caller_agree_with_one_pass(spark, rpm, tpm, step):
    rng = random.Random(rpm * 100 + tpm)
    rows = [("hot" if i % 5 else rng.choice(["a", "b", None]), i, float(round(rng.random() * 400 * step)), rng.randrange(0, 4)) for i in range(700)]
    rows += [("hot", 900, 7.0, 1), ("hot", 901, 7.0, 1), ("hot", 902, None, 1), ("z", 903, 1.0, None)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"who": history.F.lit("clash"), "part": history.F.lit(1)})
    got = history.admitted(df, "caller", rpm, tpm, 60.0, part=60)
    assert found(got) == plain(rows, rpm, tpm, 60.0) and got.count() == len(rows)


def test_dense_requests_whose_parts_depend_on_one_another(spark):
    rows = [("hot", i, float(i), 1) for i in range(400)]  # never a pause, and the first request sets the rhythm
    df = spark.createDataFrame(rows, SCHEMA)
    assert found(history.admitted(df, "caller", 2, 0, 7.0, part=40)) == plain(rows, 2, 0, 7.0)


def test_no_requests(spark):
    assert history.admitted(spark.createDataFrame([], SCHEMA), "caller", 2).collect() == []


def test_a_stream_forgets_callers_whose_window_has_passed(spark, tmp_path):
    rows = [("u", i, float(i * 20), 1) for i in range(12)] + [("v", 100 + i, float(i * 5), None) for i in range(6)]
    df = spark.createDataFrame(rows, SCHEMA)
    for k, cond in enumerate(("ts < 60", "ts >= 60")):
        df.where(cond).coalesce(1).write.parquet(f"{tmp_path}/in/b{k}")
    late = spark.createDataFrame([("w", 200, 10_000.0, 1), ("x", 201, None, 1)], SCHEMA)
    out, kept = [], []

    def run():
        src = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
        q = jobs.admissions(src, "caller", rpm=2).writeStream.foreachBatch(lambda b, n: out.extend(b.collect())).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination()
        kept.append(q.lastProgress["stateOperators"][0]["numRowsTotal"])

    run()
    late.coalesce(1).write.parquet(f"{tmp_path}/in/b2")
    run()
    assert {r.id: (r.admitted, round(r.retry_after, 6)) for r in out} == plain([*rows, ("w", 200, 10_000.0, 1)], 2, 0, 60.0)
    assert kept == [1, 1]  # u after the first run, w after the second: v, then u have gone
