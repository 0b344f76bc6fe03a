import math
import random

from lumenfold.operators import history as hi
from lumenfold.operators import quantiles as qn


def plain(values, p):
    xs = sorted((v for v in values if v is not None), key=lambda v: (math.isnan(v), v))
    return xs[min(len(xs) - 1, int(len(xs) * p))] if xs else None


def test_order_statistics_equal_sorted_lists(spark, monkeypatch):
    monkeypatch.setattr(qn, "BUCKETS", 8)
    monkeypatch.setattr(qn, "REST", 5)
    rng = random.Random(3)
    groups = {
        "even": [rng.random() for _ in range(300)], "wide": [math.exp(rng.uniform(-300, 300)) * rng.choice([-1, 1]) for _ in range(300)],
        "ties": [float(rng.randrange(3)) for _ in range(200)], "same": [2.5] * 50, "one": [7.0], "none": [None, None], None: [1.0, None, 3.0],
        "odd": [math.nan, math.inf, -math.inf, 0.0, -0.0, 1.0, math.inf, 1.7e308, -1.7e308, None], "tiny": [5e-324 * i for i in range(40)],
    }
    rows = [(k, v) for k, vs in groups.items() for v in vs]
    rng.shuffle(rows)
    places = {"p0": 0.0, "p50": 0.5, "p99": 0.99, "p100": 1.0}
    df = spark.createDataFrame(rows, "lo string, v double").repartition(5)
    got = {r.lo: r for r in qn.order_statistics(df, ["lo"], "v", places).collect()}
    assert set(got) == set(groups)
    for k, vs in groups.items():
        assert got[k].n == sum(v is not None for v in vs)
        for c, p in places.items():
            a, b = got[k][c], plain(vs, p)
            assert a == b or (math.isnan(a) and math.isnan(b)), (k, c, a, b)
    every = qn.order_statistics(df.where("lo <> 'odd'"), [], "v", places).first()
    assert every.p50 == plain([v for k, v in rows if k not in (None, "odd")], 0.5)
    assert qn.order_statistics(df.where("false"), ["lo"], "v", places).count() == 0


def test_latency_report(spark):
    df = spark.createDataFrame([("a", 10.0), ("a", 30.0), ("a", 20.0), ("b", None)], "mode string, ms double")
    got = {r.mode: tuple(r)[1:] for r in hi.latency_report(df).collect()}
    assert got == {"a": (20.0, 20.0, 30.0, 50.0), "b": (None, None, None, None)}
