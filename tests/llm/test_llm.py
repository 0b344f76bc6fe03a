import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumenfold.llm import ann, base, codes, ctw, langid, linededup, mixing, neardup, pieces, quality, toolcalls, vecdup

LONG = " ".join(f"wort{i % 977} und{i % 31}" for i in range(40_000))
BASE = [f"w{i}" for i in range(60)]
DOCS = [
    (1, "the cat and the dog went to the house. The end of it.\nA second line here.", "en", "a", 1),
    (2, "der Hund und die Katze sind in dem Haus und nicht auf der Straße.", "de", "b", 1),
    (3, None, "en", "a", 1),
    (4, "", None, None, 1),
    (5, "12345 !!! \n\n", "en", "b", 1),
    (6, LONG, "de", "a", 1),
    (7, " ".join(BASE), "en", "c", 1),
    (8, " ".join(BASE).upper(), "en", "c", 1),
    (9, " ".join([*BASE[:-1], "other"]), "en", None, 1),
    (10, "the cat and the dog went to the house. The end of it.\nA second line here.", "en", "a", 1),
    (11, "▁ mark \u2581 and 梦 \U0001f600 tab\there", "en", "a", 1),
    (11, "▁ mark \u2581 and 梦 \U0001f600 tab\there", "en", "a", 1),
    (None, "a row without a key", "en", "b", 1),
]
SCHEMA = "doc_id long, text string, lang string, source string, score int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def test_language(spark, docs, none):
    got = {r.doc_id: r for r in langid.predict(docs, langid.fit(docs)).collect()}
    assert got[1].lang_pred == "en" and got[2].lang_pred == "de"
    assert all(got[k].lang_pred == "und" and got[k].score == 0 for k in (3, 4, 5))
    assert langid.predict(docs, langid.fit(none)).where("lang_pred <> 'und'").count() == 0
    assert langid.predict(none, langid.fit(docs)).count() == 0
    # the distance itself, against a plain version
    m = langid.fit(docs)
    own = np.concatenate(langid._codes(np.frombuffer(b"the cat", np.uint8)))
    order = sorted(Counter(own.tolist()).items(), key=lambda x: (-x[1], x[0]))
    for j in range(len(m.langs)):
        rank = {int(g): int(r) for g, r in zip(m.grams, m.ranks[:-1, j]) if r < langid.PROFILE}
        far = sum(abs(rank[g] - i) if g in rank else langid.PROFILE for i, (g, _) in enumerate(order))
        assert math.isclose(langid.out_of_place(m, own)[j], far / (len(order) * langid.PROFILE))


def plain_components(rows, k, percent=80):
    sets = defaultdict(list)
    for i, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode()))
        if w and i is not None:
            sets[i].append({tuple(w)} if len(w) < k else {tuple(w[j : j + k]) for j in range(len(w) - k + 1)})
    comp = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if any(x & y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                    comp[a] = comp[b] = min(comp[a], comp[b])
    return comp


def test_near_duplicates(spark, docs, none):
    got = {r.doc_id: r for r in neardup.near_duplicates(docs, 4).collect()}
    want = plain_components([r[:2] for r in DOCS], 4)
    assert {i: got[i].component_id for i in want} == want
    assert all(got[k].n_shingles == 0 and got[k].kept for k in (3, 4)) and got[None].kept
    assert neardup.near_duplicates(none).count() == 0


def test_near_duplicates_in_a_large_group(spark):
    """Near copies about as far apart as the threshold: components equal those of all pairs."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(120):
        w = [f"g{j}" for j in range(70)]
        for j in rng.choice(70, rng.integers(0, 5), replace=False):
            w[j] = f"x{i}_{j}"
        rows.append((i, " ".join(w)))
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()}
    assert got == plain_components(rows, 4)


def vectors(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((400, 16))
    x[50:80] = x[50] + 0.05 * rng.standard_normal((30, 16))
    x[80:90] = x[3] + 0.25 * rng.standard_normal((10, 16))
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [(400, None), (401, [0.0] * 16), (402, [float("nan")] * 16), (403, [1.0, 2.0]), (404, [None] * 16), (None, rows[0][1])]
    return x, spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("label", F.lit(1))


def test_nearest(spark):
    x, df = vectors(spark)
    got = ann.nearest(df, F.pmod("vec_id", F.lit(50)) == 0).collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = 0
    for q in range(0, 400, 50):
        s = u @ u[q]
        s[q] = -9
        mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert [m[0] for m in mine] == [1, 2, 3, 4, 5] and all(abs(s[v] - c) < 1e-12 for _, v, c in mine)
        hit += len({m[1] for m in mine} & set(np.argsort(-s)[:5].tolist()))
    assert hit >= 36 and not any(r.query_id == 400 for r in got)
    assert ann.nearest(df.where("false"), F.lit(True)).count() == 0


def test_multi_index_finds_every_code_within_its_radius():
    rng = np.random.default_rng(0)
    c = rng.integers(0, 256, (3000, 32), dtype=np.uint8)
    index = codes.MultiIndex(c)
    got = index.search(c[0], 40)
    d = np.bitwise_count(c ^ c[0]).sum(axis=1)
    assert set(got.tolist()) == set(np.flatnonzero(d <= np.sort(d)[39]).tolist())


def test_vector_duplicates(spark):
    x, df = vectors(spark)
    got = {r.vec_id: r for r in vecdup.vector_duplicates(df).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = u @ u.T >= 0.95
    assert all(got[i].n_links == link[i].sum() - 1 for i in range(400))
    comp = np.arange(400)
    for _ in range(20):
        comp = np.array([comp[link[i]].min() for i in range(400)])
    assert [got[i].component_id for i in range(400)] == comp.tolist()
    assert all(got[i].n_links == 0 and got[i].kept for i in (400, 401, 402, 403, 404, None))
    assert vecdup.vector_duplicates(df.where("false")).count() == 0


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101), (102, 101), (7, 7)], "a long, b long")
    got = {r.node: r.comp for r in base.connected_components(edges).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 100, 101: 100, 102: 100}


def test_tool_calls(spark):
    calls = spark.createDataFrame(
        [(1, "a", 0, "reply", '{"turn": 0, "prompt": "x", "after": "b"}'), (1, "b", 1, "reply", '{"prompt":"é","turn":1}'), (1, "c", 2, "reply", "not json"), (1, "d", 3, "nope", "{}"),
         (1, "e", 4, "reply", '{"prompt":1,"zz":2}'), (2, "p", 0, "reply", '{"prompt":"q","turn":0,"after":"r"}'), (2, "r", 1, "reply", '{"prompt":"q","turn":1,"after":"p"}'), (1, "a", 9, "reply", None), (3, None, 0, "reply", None), (1, "g", 5, "reply", '{"prompt":"q","turn":5,"after":"gone"}')],
        "conv_id long, call_id string, turn long, tool string, args string",
    )
    results = spark.createDataFrame([(1, "b", 7, "late"), (1, "b", 2, "first"), (1, "zz", 3, "lost")], "conv_id long, call_id string, turn long, content string")
    got = {(r.conv_id, r.call_id): r for r in toolcalls.link_calls(calls, results, toolcalls.REPLY, ("after",)).collect()}
    assert len(got) == 9 and got[1, "zz"].status == "orphan" and got[1, "a"].copies == 2
    assert (got[1, "b"].status, got[1, "b"].result_turn, got[1, "b"].json) == ("linked", 2, '{"arguments":{"prompt":"é","turn":1},"id":"b","name":"reply","result":"first"}')
    assert got[1, "a"].level == 1 and got[1, "b"].level == 0 and got[2, "p"].level is None and got[2, "r"].level is None
    assert got[1, "c"].errors == ["not_json"] and got[1, "d"].errors == ["unknown_tool"] and got[1, "g"].errors == ["unknown_ref"]
    assert got[1, "e"].errors == ["missing:turn", "type:prompt", "unknown:zz"]
    assert toolcalls.link_calls(calls.where("false"), results.where("false"), toolcalls.REPLY, ("after",)).count() == 0


def test_tool_calls_without_ids_or_turns_and_backward_chains(spark, tmp_path):
    calls = spark.createDataFrame(
        [(1, "a", 0, "reply", '{"prompt":"x","turn":0}'), (1, "b", 1, "reply", '{"prompt":"x","turn":1,"after":"a"}'), (1, "c", 2, "reply", '{"prompt":"x","turn":2,"after":"b"}'),
         (2, "t", None, "reply", '{"prompt":"x"}'), (3, None, 4, "reply", '{"prompt":"x","turn":4,"after":"gone"}'), (3, None, 5, "reply", None)],
        "conv_id long, call_id string, turn long, tool string, args string",
    )
    results = spark.createDataFrame([(2, "t", None, "r"), (3, None, 6, "s")], "conv_id long, call_id string, turn long, content string")
    got = toolcalls.link_calls(calls, results, toolcalls.REPLY, ("after",), keep_null=True).collect()
    by = {r.call_id: r for r in got if r.call_id}
    assert [by[k].level for k in "abc"] == [0, 1, 2] and by["t"].status == "linked" and by["t"].errors == ["missing:turn"]
    bare = sorted((r.status, r.turn or r.result_turn, r.errors, r.level) for r in got if r.call_id is None)
    assert bare == [("no_result", 4, ["unknown_ref"], None), ("no_result", 5, ["not_json"], None), ("orphan", 6, None, None)] and len(got) == 7
    chat = spark.createDataFrame([(1, None, "user", "x"), (1, None, "user", "y"), (1, None, "assistant", "z"), (1, 0, "user", "w")], "conv_id long, turn long, role string, text string")
    chat.write.parquet(f"{tmp_path}/conversations.parquet")
    assert sorted(r.status for r in toolcalls.op4_tool_calls(spark, str(tmp_path)).collect()) == ["no_result"] * 3 + ["orphan"]


def test_quality(spark, docs, none):
    junk = spark.createDataFrame([(1000 + i, "ZZ!! QQ$$$ " * 40, "en", "a", 1) for i in range(30)] + [(2000 + i, f"This is text number {i}, and it says a thing or two about the river in the town, where people walk." * 3, "en", "a", 1) for i in range(120)], SCHEMA)
    got = {r.doc_id: r.score for r in quality.score_quality(docs.unionByName(junk)).collect()}
    assert min(got[2000 + i] for i in range(120)) > 0.5 > max(got[1000 + i] for i in range(30))
    assert quality.score_quality(none).count() == 0


def test_quality_sample_holds_rows_with_and_without_id(spark, monkeypatch):
    good = "This is text number {}, and it says a thing or two about the river in the town, where people walk. "
    rows = [(None, f"ZZ!! QQ$$$ {i} " * 40) for i in range(300)] + [(i, good.format(i) * 3) for i in range(300)]
    held, fit = [], quality.fit_scorer
    monkeypatch.setattr(quality, "fit_scorer", lambda x, p: held.append(p) or fit(x, p))
    assert quality.score_quality(spark.createDataFrame(rows, "doc_id long, text string"), sample=80).count() == 600
    assert 40 <= len(held[0]) <= 160 and 0.2 < (held[0] > 0.5).mean() < 0.8


def test_line_dedup(spark, docs, none):
    passage = "first line of it\nsecond line of it\nthird line of it\nfourth line\nfifth line of the passage"
    long_line = " ".join(f"tok{i}" for i in range(55))
    more = [(50 + i, f"intro {i}\n{passage}\n{long_line}\nend {i}", "en", "a", 1) for i in range(4)]
    df = docs.unionByName(spark.createDataFrame(more, SCHEMA))
    got = {r.doc_id: r for r in linededup.remove_repeated(df).collect()}
    assert got[50].removed_lines == 0 and got[50].text == more[0][1]
    assert all(long_line not in got[k].text and got[k].removed_lines >= 1 and f"end {k - 50}" in got[k].text for k in (51, 52, 53))
    assert got[3].text is None and got[4].text == "" and got[1].removed_lines == 0 and got[6].text == LONG
    assert linededup.remove_repeated(none).count() == 0


def test_line_dedup_finds_passages_of_a_few_lines(spark):
    """Passages of 2 to 5 lines, each under 50 words, of 51 to 90 words, stand in contexts of their own."""
    rng = np.random.default_rng(5)
    rows, want = [], {}
    for p in range(60):
        n = 2 + p % 4
        sizes = [28, 39] if n == 2 else [51 // n + 1 + p % 5] * n
        passage = [" ".join(f"p{p}w{rng.integers(1 << 30)}" for _ in range(k)) for k in sizes]
        for c in range(3):
            own = [" ".join(f"c{rng.integers(1 << 30)}" for _ in range(rng.integers(1, 30))) for _ in range(rng.integers(1, 4) + rng.integers(1, 4))]
            at = rng.integers(0, len(own) + 1)
            rows.append((3 * p + c, "\n".join([*own[:at], *passage, *own[at:]])))
            want[3 * p + c] = "\n".join(own) if c else rows[-1][1]
    rows.append((900, rows[0][1]))
    rows.append((901, "\n".join(["the same line of seven words again"] * 40)))
    got = {r.doc_id: r.text for r in linededup.remove_repeated(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert {i: got[i] for i in want} == want
    assert got[900] == "" and 8 <= len(got[901].split("\n")) < 40


@pytest.mark.parametrize("key", [None, 7])
def test_line_dedup_decides_each_row_by_itself(spark, key):
    long_ = [" ".join(f"{c}{i}" for i in range(60)) for c in "abcdefg"]
    rows = [(1, f"{long_[0]}\n{long_[1]}"), (key, f"{long_[2]}\n{long_[3]}"), (key, f"{long_[4]}\n{long_[1]}"), (key, f"{long_[5]}\n{long_[6]}"), (key, f"{long_[5]}\n{long_[6]}")]
    got = [r.text for r in linededup.remove_repeated(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()]
    first = {None: [long_[0], rows[2][1]], 7: [rows[0][1], long_[4]]}[key]
    assert sorted(got) == sorted([*first, rows[1][1], rows[3][1], ""])


def test_mixing(spark, docs, none):
    out = mixing.apply_mix(docs)
    assert out.count() == len(DOCS) and out.where("_copies > 2").count() == 0
    goal = mixing.targets({"sa": 100, "sb": 10, "-": 0})
    assert goal["-"] == 0 and goal["sb"] <= 20 and math.isclose(sum(goal.values()), 165)
    assert mixing.apply_mix(none).count() == 0
    many = spark.range(4000).select(F.col("id").alias("doc_id"), F.expr("repeat('w ', cast(id % 13 as int))").alias("text"), F.expr("case id % 3 when 0 then 'x' when 1 then 'y' end").alias("source"))
    for r in mixing.apply_mix(many).groupBy("source").agg(F.sum(F.col("_size") * F.col("_copies")).alias("got"), F.first("_target").alias("goal")).collect():
        assert abs(r.got - r.goal) <= 12


def test_scores_are_probabilities(spark):
    block = next(base.blocks(pa.array(["ab ab abc", "b", "é a"])))
    code, *_ = ctw.stream(block)
    k, n = np.unique(code, return_counts=True)
    t = ctw.build(spark.createDataFrame([(int(x), int(c)) for x, c in zip(k.view(np.int64), n)], "key long, n long")).toArrow()
    k0, p0, k1, r1, two, s2, q2 = ctw._top(t.filter(pa.compute.is_valid(t["pw"])).select(["key", "n0", "n1", "pw"]))
    key, r = t["key"].to_numpy().view(np.uint64), t["r"].to_numpy()
    at = np.searchsorted(two, key & np.uint64((1 << 24) - 1))
    key, r = np.concatenate([k0, k1, key]), np.concatenate([p0, r1, s2[at] + q2[at] * r])
    order = np.argsort(key)
    odds = (np.log(r) - np.log1p(-r))[order]
    for c in (code[0], code[-1], np.uint64(0x7A7A7A7A7A00)):
        every = (c >> np.uint64(8) << np.uint64(8)) | np.arange(256, dtype=np.uint64)
        assert math.isclose((10 ** ctw._bit_logs(every, key[order], odds)).sum(), 1, rel_tol=1e-9)


def test_context_tree(spark, docs, none, monkeypatch):
    got = {r.doc_id: r for r in ctw.score_texts(docs, docs).collect()}
    c = Counter()
    for _, t, *_ in DOCS:
        c.update([*re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in t or "")), 0])
    n, v = sum(c.values()), len(c)
    for i, t, *_ in DOCS:
        w = [*re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in t or "")), 0]
        assert got[i].n_tokens == len(w) == got[i].n_known and got[i].train_tokens == n and got[i].score < 0
        assert math.isclose(got[i].base_score, sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), rel_tol=1e-9)
    monkeypatch.setattr(ctw, "PART_NODES", 3000)
    monkeypatch.setattr(ctw, "TOP_WORDS", 3)
    for r in ctw.score_texts(docs, docs).collect():
        assert math.isclose(r.score, got[r.doc_id].score, rel_tol=1e-5) and math.isclose(r.base_score, got[r.doc_id].base_score, rel_tol=1e-9)
    assert ctw.score_texts(none, none).count() == 0 and ctw.score_texts(none, docs).count() == len(DOCS)


def test_pieces(spark, docs, none):
    enc = pieces.encode(docs)
    got = pieces.decode(enc).collect()
    assert all(r.text == r.decoded and (r.pieces is None) == (r.text is None) for r in got)
    again = {(r.doc_id, r.text): r.pieces for r in pieces.encode(docs.repartition(1)).collect()}
    assert all(again[r.doc_id, r.text] == r.pieces for r in got)
    assert pieces.encode(none).count() == 0
    v = pieces.load()
    assert pieces.encode_block(v, next(base.blocks(pa.array(["abc def" * 3]))), np.zeros(1, np.uint64))[0].tolist() != pieces.encode_block(v, next(base.blocks(pa.array(["abc def" * 3]))), np.ones(1, np.uint64))[0].tolist()


def test_sampling_follows_the_lattice():
    """Frequencies of sampled segmentations against their exact chances."""
    v = pieces.load()
    n, word = 4000, "the"
    block = next(base.blocks(pa.array([word] * n), 1 << 22))
    ids, st = pieces.encode_block(v, block, np.arange(n, dtype=np.uint64))
    seen = Counter(tuple(ids[st[i] : st[i + 1]].tolist()) for i in range(n))
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    text = "▁" + word
    ways = [[]]
    full = []
    while ways:
        w = ways.pop()
        at = sum(map(len, w))
        if at == len(text):
            full.append(w)
        ways += [[*w, text[at:e]] for e in range(at + 1, len(text) + 1) if sp.piece_to_id(text[at:e]) != sp.unk_id()]
    weight = {tuple(sp.piece_to_id(p) for p in w): math.exp(pieces.ALPHA * sum(sp.get_score(sp.piece_to_id(p)) for p in w)) for w in full}
    total = sum(weight.values())
    assert set(seen) <= set(weight)
    for k, x in weight.items():
        p = x / total
        assert abs(seen[k] / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-3
