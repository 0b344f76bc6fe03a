"""Queries over whole tables that have no SQL, against plain versions."""

import re

import pyarrow.parquet as pq

from lumenfold import catalog
from lumenfold.functions import text as fn
from lumenfold.operators import relations as rel

SF = "/root/testdata/sf0.001"


def test_complexity_of_all_documents(spark):
    hit = [re.compile(p) for p in fn.DECISIONS]
    want = {r["doc_id"]: 1 + sum(bool(p.search(x)) for x in r["text"].split("\n") if x.strip() and not x.strip().startswith(("#", "//")) for p in hit) for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()}
    got = {r.doc_id: r.complexity for r in catalog.QUERIES["complexity_regex_all"](spark, SF).collect()}
    assert got == want and len(set(want.values())) > 5


def test_trigram_duplicates_hold_copies_as_one_class(spark):
    text = [f"line one {i}\nline two of it\nthird line here\nfourth line of body {i}" for i in (1, 2)]
    rows = [(k, text[0], "x") for k in range(300)] + [(900, text[1], "y"), (901, "a\nb", "y"), (902, "quite other\nwords stand\nin this\nlast text", "y")]
    df = spark.createDataFrame(rows, "id long, body string, repo string")
    grams = lambda x: {x[i : i + 3] for i in range(len(x) - 2)}
    a, b = grams(text[0]), grams(text[1])
    got = [(r.a, r.b, round(r.similarity, 9)) for r in rel.duplicate_classes(df).collect()]
    assert sorted(got) == sorted([(0, k, 1.0) for k in range(1, 300)] + [(0, 900, round(len(a & b) / len(a | b), 9))])
    assert [(r.a, r.b) for r in rel.duplicate_classes(df, apart="repo").where("similarity < 1").collect()] == [(0, 900)]


def test_stored_postings_rank_as_texts_do(spark):
    a, b = (catalog.QUERIES[n](spark, SF).collect() for n in ("bm25_topk", "bm25_stored"))
    assert [(r.doc_id, r.score) for r in a] == [(r.doc_id, r.score) for r in b]


def test_cells_find_what_all_vectors_hold(spark):
    import numpy as np

    from lumenfold.operators import indexes as ix

    full, cells = ({r.vec_id for r in catalog.QUERIES[n](spark, SF).collect()} for n in ("vector_topk", "ivf_topk"))
    assert len(full & cells) >= 8
    v = spark.read.parquet(f"{SF}/embeddings.parquet")
    x = np.array([r.embedding for r in v.orderBy("vec_id").collect()], float)
    centres = ix.fit_cells(v, 32)
    probes = ix.probes_needed(v, centres)
    cell = (x @ centres.T - (centres**2).sum(axis=1) / 2).argmax(axis=1)
    hits = [np.isin(cell[np.argsort(-(x @ q))[:10]], ix.nearest_cells(q.tolist(), centres, probes)).mean() for q in x[::5]]
    assert probes < 32 and np.mean(hits) >= 0.9


def test_admissions_against_a_plain_limiter(spark):
    rows = pq.read_table(f"{SF}/events.parquet", columns=["event_id", "user_id", "ts"]).to_pylist()
    want, held = {}, {}
    for r in sorted(rows, key=lambda r: (r["user_id"], r["ts"], r["event_id"])):
        own = [t for t in held.get(r["user_id"], []) if (r["ts"] - t).total_seconds() < 3600]
        want[r["event_id"]] = len(own) < 2
        held[r["user_id"]] = own + ([r["ts"]] if len(own) < 2 else [])
    assert {r.event_id: r.admitted for r in catalog.QUERIES["rate_admissions"](spark, SF).collect()} == want and not all(want.values())


def test_line_chunks_of_all_documents_hold_every_line(spark):
    docs = {r["doc_id"]: r["text"] for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()}
    seen = {}
    for r in catalog.QUERIES["line_chunks"](spark, SF).collect():
        seen.setdefault(int(r.file_path), set()).update(range(r.start_line, r.end_line + 1))
    for k, text in docs.items():
        lines = text.splitlines()
        assert {i + 1 for i, x in enumerate(lines) if x.strip()} <= seen.get(k, set())


def test_semantic_topk_against_plain_cosines(spark):
    from lumenfold.operators import embedding as em

    docs = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    x = em._unit(em.hashed([r["text"] for r in docs])).astype(float) @ em.embed_query("the town and the river")
    want = sorted(((-round(s, 5), r["doc_id"]) for s, r in zip(x.tolist(), docs, strict=True)))[:10]
    assert [round(-r.score, 5) for r in catalog.QUERIES["semantic_topk"](spark, SF).collect()] == [w[0] for w in want]
