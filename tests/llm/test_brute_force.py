"""The operators and their registered queries against plain versions written anew here, with edge cases in every table."""

import math
import os
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lumenfold.llm import ann, base, ctw, langid, linededup, mixing, neardup, pieces, quality, queries, toolcalls

SF = "/root/testdata/sf0.001"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
EN, DE = "the river and the town are where people walk in the evening ", "der Fluss und die Stadt sind wo Leute am Abend spazieren gehen "


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    """The documents of sf0.001 with rows that are null, empty, repeated, very short and longer than a block, and a clashing column."""
    d = str(tmp_path_factory.mktemp("sf"))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    long_ = " ".join(f"{EN}{i}" for i in range(20_000))
    rows = [(900_001, None, "en", "a"), (900_002, "", None, "a"), (900_003, "two words", "en", None), (900_004, EN * 3, "en", "b"), (900_004, EN * 3, "en", "b"), (900_005, " " + EN, "de", "b"), (900_006, long_, "en", "b"), (None, DE * 4, "de", "c"), (None, EN * 4, None, "c"), (900_007, "x\r\ny\n\n", "en", "a")]
    more = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], docs.select("doc_id", "text", "lang", "source", "n_chars").schema)
    docs.unionByName(more).withColumn("base", F.lit(1)).repartition(5).write.parquet(f"{d}/documents.parquet")
    return d


@pytest.fixture(scope="module")
def docs(spark, sf):
    return [r.asDict() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]


def lower(b: bytes) -> bytes:
    return bytes(c + 32 if 65 <= c <= 90 else c for c in b)


def crc(doc_id, by):
    return zlib.crc32(str(doc_id).encode()) % by if doc_id is not None else None


# ----------------------------------------------------------------- 1
def plain_grams(text: str) -> Counter:
    fold = lambda c: c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32
    raw = text.encode()
    out = bytearray()
    for i, c in enumerate(raw):
        c = fold(c)
        if i and raw[i - 1] == 0xC3 and 0x80 <= raw[i] <= 0x9E and raw[i] != 0x97:
            c += 32
        if not (c == 32 and out and out[-1] == 32):
            out.append(c)
    return Counter(bytes(out[i : i + n]) for n in (1, 2, 3) for i in range(len(out) - n + 1))


def order(grams: Counter) -> list[bytes]:
    return sorted(grams, key=lambda g: (-grams[g], len(g), g))[: langid.PROFILE]


def test_language_against_plain_profiles(spark, sf, docs):
    profile = defaultdict(Counter)
    for r in docs:
        if crc(r["doc_id"], 4) != 2 and r["lang"] is not None and r["text"] is not None:
            profile[r["lang"]] += plain_grams(r["text"])
    rank = {k: {g: i for i, g in enumerate(order(c))} for k, c in profile.items()}
    want = Counter()
    for r in docs:
        if not any(c.isalpha() for c in r["text"] or ""):
            want[r["doc_id"], crc(r["doc_id"], 4) == 2, "und", 0.0] += 1
            continue
        mine = order(plain_grams(r["text"]))
        far = {k: sum(abs(i - t[g]) if g in t else langid.PROFILE for i, g in enumerate(mine)) / (len(mine) * langid.PROFILE) for k, t in sorted(rank.items())}
        best = min(far, key=far.get)
        want[r["doc_id"], crc(r["doc_id"], 4) == 2, best, round(1 - far[best], 9)] += 1
    got = Counter((r.doc_id, r.held_out, r.lang_pred, round(r.score, 9)) for r in queries.QUERIES["op1_language_id"](spark, sf).collect())
    assert got == want


def test_language_of_a_text_is_its_own_whatever_stands_before_it(spark):
    model = langid.Profiles(["en"], np.zeros(0, np.uint32), np.full((1, 1), langid.PROFILE, np.int32))
    alone, behind = (langid._symbols(next(base.blocks(pa.array(t)))) for t in ([" the cat"], ["xx ", " the cat"]))
    assert alone[0].tobytes() == behind[0][behind[1][1] :].tobytes() and model.langs == ["en"]


def test_language_ties_go_to_the_first_name(spark):
    train = spark.createDataFrame([("same text", "b"), ("same text", "a")], "text string, lang string")
    assert langid.predict(train, langid.fit(train)).select("lang_pred").distinct().collect()[0].lang_pred == "a"


# ----------------------------------------------------------------- 2
def plain_sets(docs, k):
    out = []
    for r in docs:
        w = WORD.findall(lower((r["text"] or "").encode()))
        out.append(frozenset() if not w else frozenset([tuple(w)]) if len(w) < k else frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)))
    return out


def test_near_duplicates_query_against_all_pairs(spark, sf, docs):
    sets = plain_sets(docs, 4)
    comp = {r["doc_id"]: r["doc_id"] for r in docs if r["doc_id"] is not None}
    rows = [(r["doc_id"], s) for r, s in zip(docs, sets) if s and r["doc_id"] is not None]
    links = [(a, b) for i, (a, x) in enumerate(rows) for b, y in rows[:i] if min(len(x), len(y)) * 10 >= 8 * max(len(x), len(y)) and 100 * len(x & y) >= 80 * len(x | y)]
    for _ in range(30):
        for a, b in links:
            comp[a] = comp[b] = min(comp[a], comp[b])
    want = Counter((r["doc_id"], len(s), comp.get(r["doc_id"]), r["doc_id"] is None or comp[r["doc_id"]] == r["doc_id"]) for r, s in zip(docs, sets))
    assert Counter(tuple(r) for r in queries.QUERIES["op2_near_duplicates"](spark, sf).select("doc_id", "n_shingles", "component_id", "kept").collect()) == want


@pytest.mark.parametrize("texts", [["hello world"], ["a"], ["a b", "a b"], ["one two three"], ["", None]])
@pytest.mark.parametrize("words", [4, 5])
def test_near_duplicates_of_very_short_tables(spark, texts, words):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r for r in neardup.near_duplicates(df, words).collect()}
    assert len(got) == len(texts) and [got[i].component_id for i in sorted(got)] == ([0, 0] if texts == ["a b", "a b"] else list(range(len(texts))))


def test_components_with_a_hot_centre(spark, monkeypatch):
    monkeypatch.setattr(base, "HOT", 4)
    edges = spark.range(1, 3000).selectExpr("id + 10 as a", "5 as b").unionByName(spark.createDataFrame([(5, 2), (2, 1), (7000, 7001)], "a long, b long"))
    got = {r.node: r.comp for r in base.connected_components(edges).collect()}
    assert len(got) == 3004 and {c for n, c in got.items() if n < 7000} == {1} and got[7001] == 7000


# ----------------------------------------------------------------- 3 and 9
def test_nearest_with_repeated_ids_and_ties(spark):
    rng = np.random.default_rng(2)
    x = [[float(v) for v in r] for r in rng.standard_normal((60, 8))]
    rows = [(i, v) for i, v in enumerate(x)] + [(7, [v + 1e-9 for v in x[0]])] * 6 + [(100, x[0]), (101, x[0]), (102, x[0][:5]), (103, x[1][:5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(0)).withColumn("rank", F.lit("x"))
    got = defaultdict(list)
    for r in sorted(ann.nearest(df, F.col("vec_id").isin(0, 102), 5).collect(), key=lambda r: r.rank):
        got[r.query_id].append(r.vec_id)
    least = {}
    for k, v in rows:
        least[k] = min(least.get(k, v), v)
    q = np.array(least[0]) / np.linalg.norm(least[0])
    score = {k: float(np.array(v) @ q / np.linalg.norm(v)) for k, v in least.items() if len(v) == 8 and k != 0}
    want = sorted(score, key=lambda k: (-round(score[k], 12), k))[:5]
    assert got[0] == want and got[0].index(101) == got[0].index(100) + 1 and got[102] == [103]


def test_nearest_query_recall(spark):
    v = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    x = np.array([r.embedding for r in v], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = np.array([r.vec_id for r in v])
    got = defaultdict(set)
    for r in queries.QUERIES["op3_nearest_vectors"](spark, SF).collect():
        got[r.query_id].add(r.vec_id)
    hit = 0
    for i in np.flatnonzero(ids % 50 == 0):
        s = x @ x[i]
        s[i] = -9
        hit += len(got[ids[i]] & set(ids[np.lexsort((ids, -s))[:5]].tolist()))
    assert hit >= 0.95 * 5 * (ids % 50 == 0).sum()


def test_vector_duplicates_query_against_all_pairs(spark):
    v = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    x = np.array([r.embedding for r in v], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = [r.vec_id for r in v]
    link = x @ x.T >= 0.95
    np.fill_diagonal(link, False)
    comp = np.array(ids)
    for _ in range(len(ids)):
        new = np.array([min([comp[i], *comp[link[i]]]) for i in range(len(ids))])
        if (new == comp).all():
            break
        comp = new
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in queries.QUERIES["op9_vector_duplicates"](spark, SF).collect()}
    assert got == {k: (int(link[i].sum()), int(comp[i]), bool(comp[i] == k)) for i, k in enumerate(ids)}


# ----------------------------------------------------------------- 4 and 7: SQL
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql_of_queries(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    same = lambda v: float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    rows = lambda df: sorted(repr([same(v) for v in r]) for r in df[sorted(df.columns)].astype(object).where(df[sorted(df.columns)].notna(), None).values.tolist())
    assert rows(queries.QUERIES[name](spark, SF).toPandas()) == rows(con.sql(queries.SQL[name]).df())


def test_levels_of_long_chains_and_of_several_references(spark):
    calls = spark.createDataFrame([(1, f"c{i}") for i in range(100)] + [(2, x) for x in "abcd"] + [(3, "x"), (3, "y"), (3, "z")], "conv_id long, call_id string")
    chain = [(1, f"c{i}", f"c{i - 1}") for i in range(1, 100)] + [(3, "x", "y"), (3, "y", "x"), (3, "z", "x"), (2, "a", "none")]
    both = [(2, "b", "a"), (2, "c", "b"), (2, "d", "a"), (2, "d", "c")]
    schema = "conv_id long, call_id string, ref string"
    for refs in (chain, chain + both):
        got = {(r.conv_id, r.call_id): r.level for r in toolcalls.levels(calls, spark.createDataFrame(refs, schema)).collect()}
        assert len(got) == 107 and [got[1, f"c{i}"] for i in range(100)] == list(range(100)) and {got[3, x] for x in "xyz"} == {None}
        assert [got[2, x] for x in "abcd"] == ([0, 1, 2, 3] if refs != chain else [0] * 4)


def test_mix_keeps_columns_of_any_name_and_ties(spark, docs, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet").withColumn("below", F.lit("b")).withColumn("sk", F.lit(2)).withColumn("_size", F.lit(9))
    out = mixing.apply_mix(df)
    assert out.count() == len(docs) and [c for c in df.columns if c != "_size"] == out.columns[:-4] and out.where("below = 'b' and sk = 2 and base = 1").count() == len(docs)
    one = spark.createDataFrame([(5, "a b c", "s")] * 7 + [(6, "a", "t")], "doc_id long, text string, source string")
    assert mixing.apply_mix(one).where("source = 's'").select("_copies").distinct().count() == 1


# ----------------------------------------------------------------- 5
def test_label_model_against_plain_expectation_maximisation(spark, docs, sf):
    tally = Counter()
    for b in base.blocks(pa.array([r["text"] for r in docs])):
        tally.update(quality.patterns(b).tolist())
    pattern, count = np.array(sorted(tally)), np.array([tally[p] for p in sorted(tally)], float)
    m = quality.fit_labels(pattern, count)
    digits = [[p // 3**j % 3 for j in range(8)] for p in pattern.tolist()]
    post = [0.95 if d.count(0) == 0 else 0.5 if d.count(0) == 1 else 0.05 for d in digits]
    for _ in range(quality.ROUNDS):
        prior = min(0.98, max(0.02, sum(c * p for c, p in zip(count, post)) / sum(count)))
        chance = []
        for j in range(8):
            pair = []
            for good in (False, True):
                w = [c * (p if good else 1 - p) for c, p in zip(count, post)]
                bad, fine = (1 + sum(x for x, d in zip(w, digits) if d[j] == v) for v in (0, 2))
                pair.append(bad / (bad + fine))
            chance.append((max(pair), pair[1]))
        post = []
        for d in digits:
            odds = math.log(prior / (1 - prior)) + sum(0 if d[j] == 1 else math.log(g / b) if d[j] == 0 else math.log((1 - g) / (1 - b)) for j, (b, g) in enumerate(chance))
            post.append(1 / (1 + math.exp(-odds)))
    assert np.allclose(m.posterior[pattern], post, atol=1e-9) and math.isclose(m.prior, prior)
    got = queries.QUERIES["op5_weak_quality"](spark, sf).collect()
    assert len(got) == len(docs) and all(math.isclose(r.posterior, post[sorted(tally).index(r.pattern)], abs_tol=1e-9) and r.kept == (r.score >= 0.5) for r in got)
    same = defaultdict(set)
    for r in got:
        same[r.doc_id].add(r.score)
    assert len(same[900_004]) == 1


def test_features_against_plain_counts():
    texts = ["Ab ab abc", "", "xyz é"]
    block = next(base.blocks(pa.array(texts)))
    x = quality.features(block)
    half = quality.BUCKETS // 2
    for i, t in enumerate(texts):
        raw = t.encode()
        pairs = Counter(((a * 257 + b) * 40503 >> 4) % half for a, b in zip(raw, raw[1:]))
        v = np.zeros(half)
        for k, n in pairs.items():
            v[k] = math.log1p(n)
        assert np.allclose(x[i, half:], v / max(1e-6, np.linalg.norm(v)), atol=1e-6)
        assert math.isclose(np.linalg.norm(x[i, :half]), 1 if t else 0, abs_tol=1e-6)


# ----------------------------------------------------------------- 6
def plain_marks(texts: list[tuple]) -> list[set[int]]:
    """Lines to remove of texts (doc_id, text) in order, by comparing the spans themselves."""
    first, gone = {}, [set() for _ in texts]
    spans = []
    for i, (_, text) in enumerate(texts):
        if text is None:
            continue
        lines = text.encode().split(b"\n")
        words = [len(WORD.findall(x)) for x in lines]
        block = next(base.blocks(pa.array([text])))
        for a, b, _, lo, hi in zip(*linededup.spans_of(block), strict=True):
            assert b"\n".join(lines[lo : hi + 1]) == text.encode()[a:b]
            spans.append((i, int(lo), int(hi), text.encode()[a:b]))
        for lo in range(len(lines)):  # every shortest run of LONG words is among the spans
            total = 0
            for hi in range(lo, len(lines)):
                total += words[hi]
                if total >= linededup.LONG:
                    assert not words[lo] or (i, lo, hi) in {s[:3] for s in spans[-20 * len(lines) - 50 :]}
                    break
    for i, lo, hi, raw in spans:
        if raw not in first:
            first[raw] = (i, lo, hi)
        elif first[raw] != (i, lo, hi):
            f = first[raw]
            gone[i] |= set(range(max(lo, f[2] + 1) if i == f[0] else lo, hi + 1))
    return gone


def test_line_dedup_against_plain_spans(spark, sf, docs):
    rows = [r for r in docs if len(r["text"] or "") < 100_000]
    key = {id(r): h for r, h in zip(rows, [x.h for x in spark.createDataFrame([(i, r["text"]) for i, r in enumerate(rows)], "i int, text string").select("i", F.xxhash64("text").alias("h")).orderBy("i").collect()])}
    rows.sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, key[id(r)]))
    gone = plain_marks([(r["doc_id"], r["text"]) for r in rows])
    want = Counter()
    for r, g in zip(rows, gone):
        lines = None if r["text"] is None else r["text"].split("\n")
        want[r["doc_id"], None if lines is None else "\n".join(x for i, x in enumerate(lines) if i not in g), len(lines or []), len(g)] += 1
    df = spark.createDataFrame([(r["doc_id"], r["text"], 1, 2) for r in rows], "doc_id long, text string, _row int, h int").repartition(3)
    got = linededup.remove_repeated(df)
    assert got.columns == ["doc_id", "text", "_row", "h", "n_lines", "removed_lines"] and sum(g > 0 for g in map(len, gone)) > 10
    assert Counter((r.doc_id, r.text, r.n_lines, r.removed_lines) for r in got.collect()) == want


# ----------------------------------------------------------------- 8
def plain_ctw(train: list[str], texts: list[str]) -> list[float]:
    """log10 of each text's probability by context-tree mixtures written as dictionaries."""
    depth = ctw.DEPTH
    stream = lambda t: b"\n" * depth + b"".join(w + b" " for w in WORD.findall(lower(t.encode()))) + b"\n"
    count: dict = defaultdict(lambda: [0, 0])
    children = defaultdict(set)
    for t in train:
        s = stream(t)
        for i in range(depth, len(s)):
            for k in range(8):
                node, bit = 1 << k | s[i] >> (8 - k), s[i] >> (7 - k) & 1
                for d in range(depth + 1):
                    count[s[i - d : i], node][bit] += 1
                    if d:
                        children[s[i - d + 1 : i], node].add((s[i - d : i], node))
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)
    weight: dict = {}

    def mixed(key) -> float:
        own = kt(*count[key])
        if len(key[0]) == depth:
            weight[key] = 1.0
            return own
        below = sum(mixed(c) for c in children[key])
        total = np.logaddexp(math.log(0.5) + own, math.log(0.5) + below)
        weight[key] = math.exp(math.log(0.5) + own - total)
        return total

    for node in {k[1] for k in count if k[0] == b""}:
        mixed((b"", node))
    out = []
    for t in texts:
        s, total = stream(t), 0.0
        for i in range(depth, len(s)):
            for k in range(8):
                node, bit = 1 << k | s[i] >> (8 - k), s[i] >> (7 - k) & 1
                p, left = 0.0, 1.0
                est = 0.5
                d = 0
                while d <= depth and (s[i - d : i], node) in count:
                    a, b = count[s[i - d : i], node]
                    est = (b + 0.5) / (a + b + 1)
                    last = d == depth or (s[i - d - 1 : i], node) not in count
                    w = 1.0 if last else weight[s[i - d : i], node]
                    p, left = p + left * w * est, left * (1 - w)
                    d += 1
                p = p if d else 0.5
                total += math.log10(p if bit else 1 - p)
        out.append(total)
    return out


def test_context_tree_score_against_dictionaries(spark):
    train = ["The cat sat on the mat", "the dog sat", "a cat and a dog and é", "", "the cat sat"]
    texts = [*train, "the bat sat on it", "zzz", "ab " * 30]
    want = plain_ctw(train, texts)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(99, None)], "doc_id long, text string").withColumn("score", F.lit("clash"))
    got = {r.doc_id: r for r in ctw.score_texts(df.where("doc_id < 5"), df).collect()}
    assert np.allclose([got[i].score for i in range(len(texts))], want, rtol=1e-5) and math.isclose(got[99].score, got[3].score)
    size = len("the bat sat on it") + 2
    assert math.isclose(got[5].bits_per_byte, -want[5] * math.log2(10) / size, rel_tol=1e-5)


def test_context_tree_query_base_score(spark, sf, docs):
    tok = lambda r: [*WORD.findall(lower((r["text"] or "").encode())), None]
    c = Counter()
    for r in docs:
        if crc(r["doc_id"], 10) != 0:
            c.update(tok(r))
    n, v = sum(c.values()), len(c)
    want = Counter()
    for r in docs:
        t = tok(r)
        want[r["doc_id"], crc(r["doc_id"], 10) == 0, len(t), sum(x in c for x in t), n, round(sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in t), 4)] += 1
    got = queries.QUERIES["op8_context_tree_scores"](spark, sf).collect()
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) and all(r.bits_per_byte > 0 for r in got)


# ----------------------------------------------------------------- 10
def test_sampling_of_units_by_either_path(spark, sf, docs, monkeypatch):
    rng = np.random.default_rng(0)
    texts = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyzé梦"), n)) for n in (50, 300, 1000, 9000)] + ["x" * 100_000, "", "a b"]
    v, block, keys = pieces.load(), next(base.blocks(pa.array(texts), 1 << 22)), np.arange(len(texts), dtype=np.uint64)
    forms = []
    for long_, edges in ((256, 4_000_000), (10**9, 4_000_000), (256, 3000)):
        monkeypatch.setattr(pieces, "LONG", long_)
        monkeypatch.setattr(pieces, "STORE_EDGES", edges)
        pieces._STORES.clear()
        ids, st = pieces.encode_block(v, block, keys)
        forms.append(ids.tolist())
        assert [b.decode() for b in pieces.decode_ids(v, ids, st)] == texts
    assert forms[0] == forms[1] == forms[2]
    got = queries.QUERIES["op10_piece_sampling"](spark, sf).collect()
    assert len(got) == len(docs) and all(r.lossless for r in got)
    assert {r.n_pieces for r in got if r.doc_id == 900_004} != set() and len({r.pieces_hash for r in got if r.doc_id == 900_004}) == 1


# ----------------------------------------------------------------- pipeline
def test_pipeline_stages_against_plain_versions(spark, sf, docs):
    cols = ["doc_id", "text", "lang", "source", "n_chars"]
    frame = spark.read.parquet(f"{sf}/documents.parquet").select(cols)
    as_rows = lambda df: Counter(tuple(r) for r in df.select(cols).collect())
    # language: texts without a letter go, a null lang is filled
    one = corpus_pipeline.STAGES[0][1](spark, frame, sf)
    lettered = [r for r in docs if any(c.isalpha() for c in r["text"] or "")]
    got = as_rows(one)
    assert sum(got.values()) == len(lettered) and all(k[2] is not None for k in got)
    assert Counter((k[0], k[1]) for k in got.elements()) == Counter((r["doc_id"], r["text"]) for r in lettered)
    # line dedup: as the operator, without texts that it empties
    two = corpus_pipeline.STAGES[1][1](spark, one, sf)
    full = linededup.remove_repeated(one).collect()
    assert as_rows(two) == Counter((r.doc_id, r.text, r.lang, r.source, len(r.text)) for r in full if r.removed_lines == 0 or r.text.strip())
    # near dedup: one row of each component by all pairs of the plain sets
    rows = [r.asDict() for r in two.collect()]
    sets = plain_sets(rows, 5)
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if rows[i]["doc_id"] is not None and rows[j]["doc_id"] is not None and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    three = corpus_pipeline.STAGES[2][1](spark, spark.createDataFrame([tuple(r[c] for c in cols) for r in rows], two.select(cols).schema), sf)
    kept = three.collect()
    groups = defaultdict(list)
    for i, r in enumerate(rows):
        groups[root[i] if r["doc_id"] is not None else ("none", i)].append(r["doc_id"])
    assert sorted(str(r.doc_id) for r in kept) == sorted(str(min(g, key=lambda x: (x is None, x or 0))) for g in groups.values())
    # mix and pieces: words near their targets, every row encoded
    four = corpus_pipeline.STAGES[3][1](spark, three, sf)
    times = Counter(str(r.doc_id) for r in four.collect())
    assert all(n <= 2 * sum(str(r.doc_id) == k for r in kept) for k, n in times.items())
    five = corpus_pipeline.STAGES[4][1](spark, four, sf)
    assert five.count() == four.count() and five.where("n_pieces = 0").count() == 0


def test_pipeline_of_an_empty_table(spark, sf, tmp_path):
    spark.read.parquet(f"{sf}/documents.parquet").where("false").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
