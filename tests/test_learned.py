"""Vectors learned from a corpus, against plain counts, an exact factorisation and hashed vectors."""

import math
import re
import uuid
from collections import Counter

import numpy as np
import pyarrow.parquet as pq

from lumenfold import catalog
from lumenfold.functions import text as fn
from lumenfold.operators import embedding as em
from lumenfold.operators import learned as le
from lumenfold.sources.store import work_dir

SF = "/root/testdata/sf0.001"


def words(text):
    return [t.lower() for t in re.findall(fn.TOKEN, text)]


def plain_counts(texts, tokens, near):
    out, place = Counter(), {t: i for i, t in enumerate(tokens)}
    for text in texts:
        w = [place.get(x, -1) for x in words(text)]
        for a in range(len(w)):
            for b in range(a + 1, min(len(w), a + near + 1)):
                if w[a] >= 0 and w[b] >= 0:
                    out[min(w[a], w[b]), max(w[a], w[b])] += near + 1 - (b - a)
    return out


def plain_matrix(counts, size):
    m = np.zeros((size, size))
    for (i, j), n in counts.items():
        m[i, j] += n
        m[j, i] += n
    s = m.sum(axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        v = np.log(m * m.sum() / np.outer(s, s))
    return np.where(np.isfinite(v) & (v > 0), v, 0.0)


def test_counts_and_information_are_those_of_all_pairs_of_places(spark):
    rows = [(1, "the cat sat on the cat mat"), (2, None), (3, ""), (4, "cat"), (5, "The Mat, the mat the mat"), (6, "the cat " * 4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("i", le.F.lit("clash")).withColumn("toks", le.F.lit(1))
    found = le.vocabulary(docs, most=4, least=2)
    every = Counter(w for _, t in rows for w in words(t or ""))
    assert found == sorted(((t, n) for t, n in every.items() if n >= 2), key=lambda x: (-x[1], x[0]))[:4]
    tokens = [t for t, _ in found]
    pairs = le.cooccurrences(docs, tokens, near=3)
    want = plain_counts([t or "" for _, t in rows], tokens, 3)
    assert {(r.i, r.j): r.n for r in pairs.collect()} == dict(want)
    m = plain_matrix(want, len(tokens))
    got = {(r.i, r.j): r.v for r in le.information(pairs).collect()}
    assert set(got) == {(i, j) for i in range(len(tokens)) for j in range(len(tokens)) if m[i, j] > 0}
    assert all(math.isclose(v, m[k], rel_tol=1e-12) for k, v in got.items())


def test_factors_are_the_leading_ones(spark):
    rng = np.random.default_rng(1)
    a = rng.standard_normal((150, 6)) * np.array([9, 7, 5, 4, 3, 2])
    m = a @ a.T + 0.01 * np.diag(rng.random(150))
    m[np.abs(m) < 1] = 0
    rows = spark.createDataFrame([(int(i), int(j), float(m[i, j])) for i, j in np.argwhere(m)], "i int, j int, v double")
    got = le.factors(rows, 150, 4)
    value, vector = np.linalg.eigh(m)
    first = np.argsort(-np.abs(value))[:4]
    want = vector[:, first] * np.sqrt(np.abs(value[first]))
    assert np.allclose(got @ got.T, want @ want.T, atol=1e-6)
    assert np.array_equal(got, le.factors(rows, 150, 4))


def topics(rng, topics=8, vocabulary=60, texts=600, length=6):
    """Short texts of one topic each, whose words seldom recur from text to text."""
    names = [["".join(rng.choice(list("bcdfghklmnprstvz"), 6)) for _ in range(vocabulary)] for _ in range(topics)]
    label = rng.integers(0, topics, texts)
    return label, [" ".join(rng.choice(names[k], length)) for k in label]


def own_label(x, label):
    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    s = x @ x.T
    np.fill_diagonal(s, -2)
    return float(np.mean(label[s.argmax(axis=1)] == label))


def test_neighbours_share_topics_more_often_than_by_hashed_tokens(spark):
    rng = np.random.default_rng(7)
    label, texts = topics(rng)
    model = le.learn(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), width=16)
    learned, hashed = own_label(model(texts), label), own_label(em.hashed(texts), label)
    assert learned >= 0.95 and learned - hashed >= 0.1, (learned, hashed)


def test_neighbours_of_openings_of_documents_share_languages(spark):
    docs = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    known = [d for d in docs if d["text"] and d["lang"]]
    asked = [" ".join(d["text"].split()[:12]) for d in known]
    label = np.array([d["lang"] for d in known])
    model = le.learn(spark.read.parquet(f"{SF}/documents.parquet"))
    learned, hashed = own_label(model(asked), label), own_label(em.hashed(asked), label)
    assert learned > hashed and learned >= 0.9, (learned, hashed)


def test_model_is_kept_and_knows_nothing_of_nothing(spark):
    root = f"{work_dir(spark)}/learned-{uuid.uuid4().hex}"
    assert le.Learned.load(spark, root) is None
    docs = spark.createDataFrame([(1, "red green blue red green"), (2, "red blue green blue")], "doc_id long, text string")
    model = le.learn(docs, least=1, width=8)
    model.save(spark, root)
    again = le.Learned.load(spark, root)
    assert np.array_equal(model(["red blue", "", "unknown"]), again(["red blue", "", "unknown"])) and not again(["", "unknown"]).any()
    empty = le.learn(docs.where("text is null"))
    assert not empty(["red"]).any() and empty(["red"]).shape == (1, le.WIDTH)
    got = docs.unionByName(spark.createDataFrame([(3, None)], "doc_id long, text string")).select("doc_id", em.embed("text", model).alias("v")).collect()
    assert [r.v is None for r in sorted(got)] == [False, False, True]


def test_learned_topk_against_plain_cosines(spark):
    docs = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    model = le.learn(spark.read.parquet(f"{SF}/documents.parquet"))
    x = em._unit(model([d["text"] for d in docs])).astype(float) @ em.embed_query("the town and the river", model)
    want = sorted((-round(s, 5), d["doc_id"]) for s, d in zip(x.tolist(), docs, strict=True))[:10]
    assert [round(-r.score, 5) for r in catalog.QUERIES["learned_topk"](spark, SF).collect()] == [w[0] for w in want]


def test_pairs_are_summed_in_pieces_of_bounded_size(spark):
    texts = ["a b c d " * 5000, "b a", "", "c " * 9, "d a b " * 700]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    tokens = ["a", "b", "c", "d"]
    want = plain_counts(texts, tokens, 3)
    for piece in (7, 64, 1 << 18):
        got = {(r.i, r.j): r.n for r in le.cooccurrences(docs, tokens, near=3, piece=piece).collect()}
        assert got == dict(want)
    place = {t: i for i, t in enumerate(tokens)}
    assert max(map(len, le._streams(["a b"] * 1000, place, 3, 64))) < 64 + 5
