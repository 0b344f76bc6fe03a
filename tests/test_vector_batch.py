import random

import numpy as np

from lumenfold.operators import history
from lumenfold.operators import search as se


def test_both_ways_equal_sorted_products(spark, monkeypatch):
    monkeypatch.setattr(se, "HELD", 60)
    monkeypatch.setattr(se, "TILE", 64)
    rng = np.random.default_rng(2)
    x = rng.integers(-2, 3, (70, 4)).astype(float)  # many ties
    rows = [(i * 7 % 71, v.tolist()) for i, v in enumerate(x)] + [(500, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    asked = df.where("vec_id % 5 = 0")
    held = {i: np.array(v) for i, v in rows if v}
    want = {(q, *p) for q in held if q % 5 == 0 for p in sorted(((-float(held[q] @ v), i) for i, v in held.items() if i != q))[:3]}
    for sent in (1 << 20, 0):
        got = {(r.query_id, -r.score, r.vec_id) for r in se.vector_top_batch(df, asked, 3, sent=sent).collect()}
        assert got == want
    assert se.vector_top_batch(df, asked.where("false"), 3).count() == 0
    assert se.vector_top_batch(df.where("vec_id < 2"), asked, 3, sent=0).where("query_id = 0").count() == 1


def test_admission_equals_a_plain_window():
    rng = random.Random(1)
    t, stamps = 0.0, []
    for _ in range(400):
        t += rng.choice([0.0, 0.5, 3.0])
        stamps.append(t)
    tokens = [rng.randrange(1, 9) for _ in stamps]
    for rpm, tpm in ((5, 0), (0, 20), (6, 25), (0, 0)):
        kept, want = [], []
        for s, n in zip(stamps, tokens):
            now = [x for x in kept if x[0] > s - 10.0]
            ok = (not rpm or len(now) < rpm) and (not tpm or sum(x[1] for x in now) + n <= tpm)
            want.append(ok)
            kept += [(s, n)] * ok
        got, held = history.admit(stamps, tokens, rpm, tpm, 10.0)
        assert [ok for ok, _ in got] == want
        half, rest = history.admit(stamps[:200], tokens[:200], rpm, tpm, 10.0)
        assert half + history.admit(stamps[200:], tokens[200:], rpm, tpm, 10.0, rest)[0] == got
