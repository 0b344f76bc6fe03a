"""Stored indexes, history, limits, quality reports, tools and streams on small inputs."""

import math
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.functions import text as fn
from lumenfold.operators import embedding, history, indexes, parsing, quality
from lumenfold.operators import relations as rel
from lumenfold.plans.engine import Engine, Workspace
from lumenfold.plans.tools import Executor, Plugins, annotator_plugin, marks_plugin, page_of
from lumenfold.sources import files
from lumenfold.sources.store import Tables, children
from lumenfold.streaming import jobs

CODE = [
    ("core.py", 'import os\nimport ctypes\n\n\ndef helper():\n    return 1\n\n\ndef compute(x):\n    if x and x > 1:\n        return helper()\n    return 0\n'),
    ("api.py", "from core import compute\n\n\nclass Api:\n    def handle(self, req):\n        # TODO later\n        print(req)\n        for r in req:\n            compute(r)\n        return eval(req)\n"),
    ("lib.rs", "use core;\nfn helper() {\n  1\n}\n"),
]


@pytest.fixture(scope="module")
def code(spark):
    return spark.createDataFrame(CODE, "file_path string, content string")


@pytest.fixture(scope="module")
def engine(spark, code):
    e = Engine(spark, code)
    yield e
    e.close()


def test_tables_keep_versions(spark, tmp_path):
    t = Tables(spark, str(tmp_path))
    assert t.load("x") is None
    row = lambda *r: spark.createDataFrame(list(r), "k string, v int")
    t.save("x", row(("a", 1), ("b", 1)))
    t.append("x", row(("c", 1)))
    t.upsert("x", row(("a", 2)), "k", gone=row(("b", 0)))
    assert {(r.k, r.v) for r in t.load("x").collect()} == {("a", 2), ("c", 1)}
    assert t.remove("x", F.col("k") == "c") == 1 and t.load("x").count() == 1


def test_vector_index(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(indexes, "CELLS_FROM", 40)
    monkeypatch.setattr(indexes, "CELLS", 4)
    vec = lambda i: [float((i * k) % 7 - 3) + 0.01 * i for k in range(1, 5)]
    make = lambda ids: spark.createDataFrame([(f"k{i}", f"f{i % 3}.py", vec(i)) for i in ids], "key string, file_path string, embedding array<double>")
    ix = indexes.VectorIndex(spark, str(tmp_path), 4)
    assert ix.search([1.0, 0, 0, 0]).count() == 0
    ix.add(make(range(20)))
    assert ix.centres() is None and ix.search(vec(3), 1).first().score >= sum(x * x for x in vec(3)) - 1e-6
    ix.add(make(range(20, 45)))
    ix.add(make(range(45, 50)))
    assert ix.centres() is not None and ix.search(vec(3), 5, probes=4).count() == 5
    with pytest.raises(ValueError):
        ix.add(spark.createDataFrame([("bad", "f", [1.0])], "key string, file_path string, embedding array<double>"))
    assert ix.vectors_for_file("f1.py").count() == 17 and ix.remove_by_file("f1.py") == 17 and ix.load().count() == 33
    ix.add(make(range(50, 70)))  # after a removal the layout by cells is still there, so nothing is lost
    assert ix.load().count() == 53 and "cell=" in " ".join(children(spark, f"{tmp_path}/vectors/v={ix.tables._versions('vectors')[-1]}"))
    assert {r.key for r in ix.search(vec(4), 53, probes=100).collect()} == {f"k{i}" for i in range(70) if i >= 50 or i % 3 != 1}


def test_keyword_index(spark, tmp_path):
    docs = spark.createDataFrame([(1, "the cat sat"), (2, "theDog ran"), (3, "")], "doc_id long, text string")
    ix = indexes.KeywordIndex(spark, str(tmp_path)).ensure(docs)
    assert ix.load(3) and not ix.load(4) and ix.num_docs() == 3
    assert [r.doc_id for r in ix.search("dog").collect()] == [2]
    ix.add(spark.createDataFrame([(2, "a bird"), (4, "dog dog")], "doc_id long, text string"))
    assert [r.doc_id for r in ix.search("dog").collect()] == [4] and ix.num_docs() == 4
    ix.add(spark.createDataFrame([(5, "dog")], "doc_id long, text string"))
    assert [r.doc_id for r in ix.search("dog").collect()] == [4, 5] and ix.num_docs() == 5
    ix.remove(spark.createDataFrame([(4,), (5,)], "doc_id long"))
    assert ix.search("dog").count() == 0 and ix.num_docs() == 3


def test_phrases_and_boolean_clauses_against_plain_lists(spark, tmp_path):
    rng = np.random.default_rng(4)
    words = "alpha beta gamma delta the of".split()
    texts = {i: " ".join(rng.choice(words, rng.integers(0, 25))) for i in range(80)} | {90: None, 91: "", 92: "alpha alpha alpha beta", 93: "theOf42 beta", 94: "of of the of the"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    index = indexes.KeywordIndex(spark, str(tmp_path)).build(docs)
    toks = {i: [x.lower() for x in re.findall(r"[a-z]+|[A-Z][a-z]*|[0-9]+", t or "")] for i, t in texts.items()}
    often = lambda i, c: sum(toks[i][k : k + len(c)] == list(c) for k in range(len(toks[i])))
    average = sum(map(len, toks.values())) / len(toks)
    cases = {
        '"alpha beta"': ([], ["alpha beta"], []), '"of the of"': ([], ["of the of"], []), '+alpha "beta gamma" -delta': (["alpha"], ["beta gamma"], ["delta"]), "alpha AND beta": (["beta", "alpha"], [], []),
        'the NOT "the of"': ([], ["the"], ["the of"]), "alpha OR gamma": ([], ["alpha", "gamma"], []), "theOf42": ([], ["the of 42"], []), "-alpha": ([], [], ["alpha"]), "unseen +zz": (["zz"], ["unseen"], []), "": ([], [], []), '"alpha alpha"': ([], ["alpha alpha"], []),
    }
    for query, (must, may, never) in cases.items():
        wanted = [c.split() for c in must + may]
        df = [sum(often(i, c) > 0 for i in toks) for c in wanted]
        want = {}
        for i in toks:
            f = [often(i, c) for c in wanted]
            if wanted and (all(f[: len(must)]) if must else any(f)) and not any(often(i, c.split()) for c in never):
                want[i] = sum(math.log((len(toks) - n + 0.5) / (n + 0.5) + 1) * x * 2.5 / (x + 1.5 * (0.25 + 0.75 * len(toks[i]) / average)) for x, n in zip(f, df) if x)
        got = {r.doc_id: r.score for r in index.matches(query).collect()}
        assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in want), query


def test_a_phrase_outside_the_best_words_is_found(spark):
    texts = {f"better{i}.md": "green tea green tea tea green " * 2 + f"x{i}" for i in range(30)} | {"holder.md": "tall grass and a cup of tea green and other words about the weather " * 3}
    e = Engine(spark, spark.createDataFrame(list(texts.items()), "file_path string, content string"))
    assert [r.file_path for r in e.keyword_search('"cup of tea"', 5).collect()] == ["holder.md"]
    e.close()


def test_digests_symbols_manifest(spark, tmp_path, engine, code):
    d = indexes.DigestStore(spark, str(tmp_path / "d"))
    rows = spark.createDataFrame([("a.py:1:2", "x"), ("a.py:3:4", "y"), ("b.py:1:2", "z")], "key string, content_hash string")
    assert d.changed(rows).count() == 3
    d.save(rows)
    d.update(rows.where("key = 'b.py:1:2'").withColumn("content_hash", F.lit("new")))
    assert d.changed(rows).count() == 1 and d.keys_for_file("a.py").count() == 2 and d.remove_by_file("a.py") == 2
    s = indexes.SymbolStore(spark, str(tmp_path / "s"))
    s.save(engine.symbols)
    assert indexes.search_name(s.load(), "HELP").count() == 2 and s.remove_file("lib.rs") == 2
    s.replace_files(engine.symbols.where("file_path = 'core.py' and name = 'helper'"))
    assert s.load().where("file_path = 'core.py'").count() == 1
    assert {r.language: r.n for r in indexes.language_summary(engine.symbols).collect()}["rust"] == 2
    assert indexes.listing(engine.symbols, "core", "function", 1).first().total == 2
    m = indexes.Manifest(spark, str(tmp_path / "m"))
    assert m.load() is None and not m.is_compatible("x", 3)
    m.save(model="x", dimension=3)
    assert m.is_compatible("x", 3) and not m.is_compatible("x", 4)
    stats = indexes.index_stats(engine.chunks, engine.symbols, 100.0)
    assert stats.first().files == 3 and indexes.language_stats(stats, "rust").first().files == 1 and indexes.staleness(stats, 130.0).first().seconds == 30.0


def test_query_history(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(history, "QUERIES_KEPT", 3)
    h = history.QueryHistory(spark, str(tmp_path))
    results = spark.createDataFrame([(0, 0.9, "b.py", "python"), (1, 0.5, "a.rs", "rust"), (2, 0.4, "b.py", "python")], "rank int, score double, file_path string, language string")
    for i, q in enumerate("abcd"):
        h.record(history.query_record(results, q, float(i)))
    assert [r.query for r in h.recent(9).collect()] == ["b", "c", "d"]
    last = h.recent(1).first()
    assert last.top_files == ["b.py", "a.rs"] and last.languages == ["python", "rust"] and (last.result_count, last.top_score) == (3, 0.9)
    assert [(r.file_path, r.n) for r in history.popular_files(h.load()).collect()] == [("b.py", 3), ("a.rs", 3)] or history.popular_files(h.load()).count() == 2
    assert history.average_results(h.load().where("false")).first().avg_result_count == 0.0
    rows = spark.createDataFrame([("foo", 1.0), ("bar", 2.0), ("foo", 3.0), ("bar", 4.0), ("foo", 5.0)], "query string, ts double")
    assert [(r.query, r.n) for r in history.popular(rows, "query").collect()] == [("foo", 3), ("bar", 2)]


def test_memories_sessions_answers(spark, tmp_path):
    w = history.Memory(spark, str(tmp_path / "w"))
    for i, (k, c) in enumerate([("a", "old text"), ("b", "text two"), ("a", "new text")]):
        w.add(k, c, float(i))
    assert w.get("a").first().content == "new text" and [r.key for r in w.search("TEXT", 1).collect()] == ["b"]
    s = history.Memory(spark, str(tmp_path / "s"), by_key=False)
    for i in range(3):
        s.add("k", f"note {i}", float(i))
    assert [r.content for r in s.search("note", 2).collect()] == ["note 1", "note 2"] and [r.content for r in s.recent(1).collect()] == ["note 2"]
    c = history.Conversations(spark, str(tmp_path / "c"))
    msg = spark.createDataFrame([("s1", 0, "system", "x", 1.0), ("s1", 1, "user", "y", 2.0), ("s2", 0, "user", "z", 3.0)], history.MESSAGE)
    c.save(msg)
    assert [r.session_id for r in c.sessions().collect()] == ["s2", "s1"] and c.load("s1").count() == 2 and c.delete("s1") and not c.delete("s1")
    a = history.AnswerCache(spark, str(tmp_path / "a"), ttl=10.0, most=2)
    for i in range(3):
        a.put(f"k{i}", f"v{i}", float(i))
    assert a.get("k2", 12.0) == "v2" and a.get("k2", 12.1) is None and a.get("k0", 2.0) is None and round(a.hit_rate(), 2) == 33.33
    touch = spark.createDataFrame([("s", 0.0, "q"), ("s", 50.0, None), ("t", 10.0, "q")], "session_id string, ts double, query string")
    assert [r.session_id for r in history.active_sessions(touch, 3650.0).collect()] == ["s"]


def test_limits():
    got, held = history.admit([0.0, 1.0, 59.9, 60.0, 61.0], [5, 5, 5, 5, 90], rpm=2, tpm=50)
    assert [ok for ok, _ in got] == [True, True, False, True, False] and len(held) == 1
    assert history.admit([0.0, 1.0], [1, 1])[0] == [(True, 0.0), (True, 0.0)]


def test_admissions_stream_equals_its_batch_twin(spark, tmp_path):
    rows = [("u", i, float(i * 20), 1) for i in range(12)] + [("v", 100 + i, float(i * 5), 1) for i in range(6)]
    df = spark.createDataFrame(rows, "who string, id long, ts double, tokens long")
    for k, cond in enumerate(("ts < 60", "ts >= 60")):
        df.where(cond).coalesce(1).write.parquet(f"{tmp_path}/in/b{k}")
    out = []
    src = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    jobs.run_once(jobs.admissions(src, "who", rpm=2), lambda b, n: out.extend(b.collect()), str(tmp_path / "ck"))
    want = {(r.id, r.admitted, round(r.retry_after, 6)) for r in history.admitted(df, "who", rpm=2).collect()}
    assert {(r.id, r.admitted, round(r.retry_after, 6)) for r in out} == want and len(out) == 18


def test_streams_count_sessions_and_rates(spark, tmp_path):
    df = spark.createDataFrame([("u", 0, 3), ("u", 1800, 4), ("u", 9000, 5), ("z", 90000, 1)], "who string, s long, tokens long").withColumn("ts", F.timestamp_seconds("s"))
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    src = lambda: spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    out, rates = [], []
    jobs.run_once(jobs.session_counts(src(), "who", "ts"), lambda b, n: out.extend(b.collect()), str(tmp_path / "c1"))
    assert sorted((r.who, r.n) for r in out) == [("u", 1), ("u", 2)]
    jobs.run_once(jobs.rate(src(), "who", "ts", "tokens", "60 seconds", "60 seconds"), lambda b, n: rates.extend(b.collect()), str(tmp_path / "c2"))
    assert sorted(r.tokens for r in rates) == [3, 4, 5]


def test_poller_and_events(spark, tmp_path):
    versions = iter([[("a", "1")], [("a", "2"), ("b", "1")], [("b", "1")]])
    p = jobs.Poller(spark, str(tmp_path), lambda: spark.createDataFrame(next(versions), "key string, content_hash string"))
    assert p.once().count() == 0
    assert {(r.key, r.change) for r in p.once().collect()} == {("a", "modified"), ("b", "created")}
    assert [(r.key, r.change) for r in p.once().collect()] == [("a", "deleted")]
    answers = spark.createDataFrame([(1, "two words")], "id int, text string")
    assert [(r.kind, r.content) for r in jobs.token_events(answers).orderBy("ord").collect()] == [("start", ""), ("token", "two"), ("token", " words"), ("done", "two words")]
    docs = spark.createDataFrame([("u", 1, "open", "a"), ("u", 2, "change", "b"), ("v", 1, "open", "c"), ("v", 2, "close", None)], "uri string, version int, event string, text string")
    assert [(r.uri, r.text) for r in jobs.latest_documents(docs).collect()] == [("u", "b")]


def test_watch_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.py").write_text("x = 1")
    (tmp_path / "in/b.txt").write_text("no")
    out = []
    jobs.run_once(jobs.watch_files(spark, str(tmp_path / "in"), [".py"]), lambda b, n: out.extend(b.collect()), str(tmp_path / "ck"))
    assert [r.content for r in out] == ["x = 1"]


def test_semantic_and_definition_chunks():
    path, text = CODE[1]
    got = parsing.semantic_chunk_lines(path, text)
    lines = text.splitlines(keepends=True)
    assert [(r[4], r[5]) for r in got] == [("", "module_header"), ("Api", "class"), ("handle", "method")] and got[2][6] == "Api"
    long_ = "def f():\n" + "".join(f"    x{i} = {i}\n" for i in range(100))
    parts = parsing.semantic_chunk_lines("f.py", long_, 200)
    assert len(parts) > 3 and [r[1] for r in parts[1:]] == [r[2] + 1 for r in parts[:-1]] and all(r[4] == "f" for r in parts)
    assert parsing.semantic_chunk_lines("x.txt", "plain words\n")[0][5] == "block" and parsing.semantic_chunk_lines("f.py", " \n") == []
    body = "".join(f"def f{i}():\n    return {i}\n\n" for i in range(20))
    spans = parsing.definition_chunk_lines("f.py", body, 120, 20)
    assert len(spans) > 3 and spans[0][0] == 1 and spans[-1][1] == len(body.splitlines()) and all(b[0] <= a[1] + 1 for a, b in zip(spans, spans[1:]))
    assert parsing.uncovered_runs(9, [(2, 3), (3, 5), (8, 20)]) == [(1, 1), (6, 7)] and len(lines) == 10


def test_calls_and_complexity_by_tree():
    assert parsing.tree_calls("    def f():\n        a.b(c())\n        # d()\n        'e()'") == ["b", "c"]
    assert parsing.tree_calls("def f(:") is None
    assert parsing.tree_complexity("def f(x):\n    if x and x > 1 or x:\n        return [i for i in x if i]\n    while x:\n        pass") == 7
    assert parsing.tree_complexity("x = 1") is None


def test_map_rows_isolates_failures(spark):
    df = spark.createDataFrame([(1,), (0,), (2,)], "n int").coalesce(1)
    good, bad = parsing.map_rows(df, lambda rows: [{"x": 10 // r["n"]} for r in rows], "x int", batch=1)
    assert sorted(r.x for r in good.collect()) == [5, 10] and [(r.skipped, "ZeroDivision" in r.error) for r in bad.collect()] == [(1, True)]


def test_engine_searches_in_every_mode(engine):
    for mode in ("semantic", "keyword", "hybrid", "multi"):
        assert engine.search("compute helper", mode, least=0.0).count() > 0
    assert {tuple(r.matched_lines) for r in engine.search("comp.te", "regex").where("symbol_name = 'handle'").collect()} == {(9,)}
    assert engine.search("compute", "keyword", exclude="core*").where("file_path = 'core.py'").count() == 0
    assert {r.name for r in engine.search("return helper", "keyword", sections=True).collect()} & {"compute", "helper"}
    with pytest.raises(ValueError):
        engine.search("x", "none")
    assert engine.keyword_search('"return helper"').select("file_path").distinct().collect()[0].file_path == "core.py"
    got = engine.retrieve_context("compute helper", 200, mode="keyword")
    assert got.count() >= 1 and "[1] " in engine.prompt("what does compute do?", mode="keyword")
    assert engine.retrieval_stats("compute", mode="keyword").first().after_budget >= 1


def test_engine_graphs(engine):
    assert {(r.caller, r.callee) for r in engine.edges.collect()} == {("core.py:compute", "helper"), ("api.py:handle", "compute")}
    assert [r.caller for r in engine.callers("compute").collect()] == ["api.py:handle"] and engine.callees("handle").first().callee == "compute"
    assert {(r.name, r.depth) for r in engine.trace("compute").collect()} == {("handle", -1), ("helper", 1)}
    assert {(r.file_path, r.how) for r in engine.affected_modules("core.py").collect()} == {("api.py", "imports_target"), ("lib.rs", "imports_target")}
    assert engine.dependencies("core.py").count() == 2 and engine.dependents("core").count() == 2
    assert [(r.source_file, r.target_language) for r in engine.polyglot().collect()] == [("core.py", "cpp")]
    assert engine.call_graph("compute").count() == 2 and engine.universal_graph().count() >= 2
    assert {r.node for r in engine.impact("core.py").collect()} >= {"handle"}


def test_quality(spark, engine, code):
    m = {r.file_path: r for r in engine.metrics().collect()}
    assert (m["api.py"].code, m["api.py"].comment, m["api.py"].blank, m["core.py"].max_complexity) == (7, 1, 2, 3)
    p = quality.project_metrics(engine.metrics()).first()
    assert p.files_analyzed == 3 and p.total_blank_lines == 6 and 0 < p.maintainability_index <= 100
    r = engine.report().first()
    assert r.unsafe == 1 and r.issue_count == r.complex + r.dead_code + r.duplicates + r.unsafe
    assert [x.rule for x in engine.gate().collect()] == ["require_safety_pass"]
    assert {(x.file_path, x.safe) for x in quality.is_safe(code).collect()} == {("core.py", True), ("api.py", False), ("lib.rs", True)}
    assert {(x.line_number, x.severity) for x in quality.marked_lines(code).collect()} == {(6, "info"), (7, "warning")}
    issues, verdict = quality.precommit(code, quality.marked_lines)
    assert issues.count() == 3 and not verdict.first().passed
    assert quality.code_actions(engine.unsafe_lines()).count() == 1 and quality.diagnostics(engine.unsafe_lines()).first().line == 9
    assert engine.hotspots(k=2).count() == 2
    s = {r.language: r for r in engine.summary().collect()}
    assert (s[None].files, s["python"].functions, s["python"].classes, s["python"].methods) == (3, 2, 1, 1)
    assert "Total symbols" in quality.summary_text(engine.summary()).first().text
    why = {r.name: r for r in engine.explain(file_path="api.py").collect()}
    assert why["handle"].summary == "Method `handle(self, req)` of class `Api` defined at line 5." and why["Api"].related == ["handle"] and why["Api"].file_imports == 1


def test_pull_request(spark, code):
    old = spark.createDataFrame([("core.py", "def helper():\n    return 2\n\n\ndef gone():\n    pass\n"), CODE[1], CODE[2]], "file_path string, content string")
    e = Engine(spark, code)
    pr = e.pull_request(old)
    got = pr["summary"].first()
    assert (got.added, got.removed, got.modified, got.import_changes) == (["compute"], ["gone"], ["helper"], ["+import ctypes", "+import os"])
    assert {r.name for r in pr["impact"].collect()} == {"compute", "handle"}
    risk = pr["risk"].first()
    assert (risk.risk, risk.level) == (20, "low") and pr["reviewers"].first().domain == "core.py"
    e.close()


def test_risk_bands(spark):
    df = spark.createDataFrame([(21, 11, 11, 3, 21), (11, 1, 1, 0, 6), (0, 0, 0, 0, 0)], "f int, r int, m int, u int, a int")
    assert [x.s for x in df.select(quality.risk("f", "r", "m", "u", "a").alias("s")).collect()] == [100, 35, 0]


def test_tasks(spark):
    block = "\n".join(f"    value_{i} = some_function_name({i})" for i in range(5))
    rows = [("a.py", "def f(x):\n    pass\ndef g(y):\n    pass\n"), ("b.py", "try:\n    x\nexcept:\n    pass\n"), ("c.py", "\n".join([block] * 3 + ["x"] * 300)), ("d.py", "def f(x) -> int:\n    pass\n")]
    df = spark.createDataFrame(rows, "file_path string, content string")
    assert {(r.category, r.file_path) for r in quality.tasks(df).collect()} == {("type_hints", "a.py"), ("error_handling", "b.py"), ("reduce_duplication", "c.py")}
    assert quality.next_task(df).first().file_path == "a.py" and quality.next_task(df, 2).first().category == "fix_tests"
    out = spark.range(1).select(quality.test_summary(F.lit("x\n== 1 failed, 3 passed, 2 errors in 1s ==\n")).alias("t")).first().t
    assert (out.total, out.failed, out.errors) == (6, 1, 2)


def test_tools_and_plugins(spark, engine, tmp_path):
    ex = Executor({"greet": lambda name: spark.createDataFrame([(name,)], "n string")})
    ex.register("boom", lambda: 1 / 0)
    assert ex.execute("greet", name="x").data.first().n == "x"
    got = ex.execute_batch([("nope", {}), ("greet", {}), ("boom", {})])
    assert [o.code for o in got] == ["unknown_tool", "missing_argument", "execution_error"]
    with pytest.raises(ValueError):
        ex.register("greet", lambda: None)
    assert engine.execute("find", name="x").code == "unknown_tool" and engine.execute("callers", name="compute").success
    p = Plugins()
    (tmp_path / "one.py").write_text("from lumenfold.plans.tools import annotator_plugin\ncreate_plugin = annotator_plugin\n")
    (tmp_path / "bad.py").write_text("1 / 0")
    assert p.discover(str(tmp_path)) == 1 and len(p.errors) == 1
    p.register(marks_plugin())
    df = spark.range(2)
    assert "annotated_by" in p.dispatch("post_search", df).columns
    p.activate("search-annotator", False)
    assert p.dispatch("post_search", df).columns == ["id"] and annotator_plugin().name == "search-annotator"
    rows, cursor = page_of(spark.range(5), 0, 3, "id")
    assert cursor == 3 and page_of(spark.range(5), cursor, 3, "id")[1] is None


def test_workspace(spark, code):
    w = Workspace(spark)
    twin = "def same_name(x):\n    total = x + 1\n    total = total * 2\n    for value in range(total):\n        print(value, 'of all the values')\n    return total\n"
    w.add("one", spark.createDataFrame([("a.py", twin)], code.schema))
    w.add("two", spark.createDataFrame([("b.py", twin.replace("same_name", "other_nam"))], code.schema))
    with pytest.raises(ValueError):
        w.add("one", code)
    got = w.cross_duplicates().collect()
    assert [(r.a, r.b) for r in got] == [("one:same_name", "two:other_nam")]
    assert {r.repo for r in w.search("total", mode="keyword").collect()} == {"one", "two"}


def test_drawings_and_scan(spark, engine, tmp_path):
    (tmp_path / "src/venv").mkdir(parents=True)
    (tmp_path / "src/venv/x.py").write_text("no")
    (tmp_path / "src/A.PY").write_text("yes")
    (tmp_path / "src/skip_me.py").write_text("no")
    got = files.scan(spark, str(tmp_path / "src"), [".py"], globs=("skip*",)).collect()
    assert [(r.relative_path, r.extension) for r in got] == [("A.PY", ".py")] and files.file_count(spark, str(tmp_path / "src"), [".py"]) == 2
    (tmp_path / "log.txt").write_text("commit 0123456789\nAuthor: x\n\na.py\nb.py\n\na.py\n")
    assert {(r.file_path, r.churn) for r in files.change_counts(spark, str(tmp_path / "log.txt")).collect()} == {("a.py", 2), ("b.py", 1)}
    assert 'core_py' in files.mermaid_dependencies(engine.deps).first().text or "core" in files.mermaid_dependencies(engine.deps).first().text
    assert "+handle()" in files.mermaid_classes(engine.symbols).first().text
    assert "No call edges found" in files.mermaid(engine.edges.where("false").select(F.col("caller").alias("src"), F.col("callee").alias("dst"))).first().text
    repos = spark.createDataFrame([("r", 3, 4)], "name string, file_count int, vector_count int")
    assert "3 files, 4 vectors" in files.mermaid_workspace(repos).first().text


def test_passages_in_texts(spark):
    texts = spark.createDataFrame([(1, "zero one two three four five six"), (2, "tiny a b"), (3, "xone two three four five six"), (4, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "one two three four five six"), (2, "a"), (3, "y a b"), (4, None), (5, "tiny a b")], "item_id long, text string")
    want = {(d.doc_id, i.item_id) for d in texts.collect() for i in items.collect() if d.text and i.text and i.text in d.text}
    assert {(r.doc_id, r.item_id) for r in rel.contained(texts, items, "doc_id", "item_id").collect()} == want


def test_very_short_passages_are_all_sought(spark):
    texts = spark.createDataFrame([(i, f"w{i}x tail" if i % 2 else "é") for i in range(1300)] + [(2000, ""), (2001, None)], "doc_id long, text string")
    items = spark.createDataFrame([(i, f"w{i}x") for i in range(1300)] + [(3000, "é"), (3001, "x t"), (3002, "ta"), (3003, "")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in rel.contained(texts, items, "doc_id", "item_id").collect()}
    rows = [(d.doc_id, d.text) for d in texts.collect() if d.text is not None]
    want = {(i, i) for i in range(1, 1300, 2)} | {(i, k) for i, t in rows for k, p in ((3000, "é"), (3001, "x t"), (3002, "ta"), (3003, "")) if p in t}
    assert got == want


def test_embedding(spark):
    df = spark.createDataFrame([(1, "the cat"), (2, ""), (3, None)], "id int, content string")
    got = {r.id: r.v for r in df.select("id", embedding.embed("content").alias("v")).collect()}
    assert abs(sum(x * x for x in got[1]) - 1) < 1e-6 and set(got[2]) == {0.0} and got[3] is None
    assert got[1] == pytest.approx(embedding.embed_query(" the cat "))


def test_models_and_profiles(spark):
    row = spark.range(1).select(fn.model_of(F.lit("minilm")).alias("a"), fn.model_of(F.lit("own/x")).alias("b"), *[fn.profile_for_memory(F.lit(g)).alias(f"p{i}") for i, g in enumerate((2.0, 0.7, 0.1))], fn.grammar_of(F.lit("x.tsx")).alias("g"), fn.grammar_of(F.lit("x.c")).alias("h")).first()
    assert list(row) == ["all-MiniLM-L6-v2", "own/x", "precise", "balanced", "fast", "tsx", None] and time.time() > 0


def test_postings_shuffle_no_tokens(spark):
    from lumenfold.operators import positions

    texts = ["the Cat and the cat", "", None, "a1 b2 " * 50, "..."]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = positions.postings(docs)
    assert {(r.doc_id, r.tok, r.tf, r.dl, tuple(r.pos)) for r in rows.where("doc_id < 3").collect()} == {(0, "the", 2, 5, (0, 3)), (0, "cat", 2, 5, (1, 4)), (0, "and", 1, 5, (2,))}
    assert rows.where("doc_id = 3").count() == 4 and "hashpartitioning" not in rows._jdf.queryExecution().executedPlan().toString()
    batch = positions.pa.RecordBatch.from_arrays([positions.pa.array(range(100)), positions.pa.array(["a b a c"] * 100)], ["row", "text"])
    assert [b.num_rows for b in positions._posting_batches(iter([batch]), 40)] == [30] * 10
