import re

import pytest
from pyspark.sql import functions as F

from lumenfold.functions import text as fn
from lumenfold.operators import parsing, search
from lumenfold.operators import relations as rel
from lumenfold.plans.engine import Engine
from lumenfold.sources import files
from lumenfold.streaming import jobs

CORE = "def helper():\n    return 1\n\n\ndef compute(x):\n    return helper() + x\n\n\nclass Box:\n    @property\n    def size(self, a=1, *b):\n        return compute(a)\n"


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


def test_chunks_cover_all_lines_and_overlap():
    text = "".join(f"line_{i} = {i}\n" for i in range(100))
    got = parsing.chunk_lines(text, 200, 50)
    assert len(got) > 1 and got[0][0] == 1 and got[-1][1] == 100
    assert all(b[0] <= a[1] and b[0] > a[0] for a, b in zip(got, got[1:]))
    assert parsing.chunk_lines("def hello():\n    return 'world'\n", 1000) == [(1, 2, "def hello():\n    return 'world'\n")]
    assert parsing.chunk_lines("  \n\n") == [] and parsing.chunk_lines("") == []


@pytest.mark.parametrize(("score", "band"), [(1, "low"), (5, "low"), (6, "moderate"), (10, "moderate"), (11, "high"), (20, "high"), (21, "very_high")])
def test_bands(spark, score, band):
    assert one(spark, fn.complexity_band(F.lit(score))) == band


@pytest.mark.parametrize(("text", "grams"), [("abcde", ["abc", "bcd", "cde"]), ("ab", ["ab"]), ("", []), ("abc", ["abc"])])
def test_trigrams(spark, text, grams):
    assert sorted(one(spark, fn.trigrams(F.lit(text)))) == grams


def test_jaccard_edges(spark):
    arr = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    assert one(spark, fn.jaccard(arr("a"), arr("a"))) == 1.0
    assert one(spark, fn.jaccard(arr(), arr())) == 1.0
    assert one(spark, fn.jaccard(arr("a"), arr())) == 0.0
    assert one(spark, fn.jaccard(arr("a"), arr("b"))) == 0.0


def test_text_functions(spark):
    assert one(spark, fn.qualified_name(F.lit("A"), F.lit("f"))) == "A.f" and one(spark, fn.qualified_name(F.lit(""), F.lit("f"))) == "f"
    assert one(spark, fn.language_of(F.lit("a/b.TSX"))) == "typescript" and one(spark, fn.language_of(F.lit("a/b"))) == "unknown"
    assert one(spark, fn.diff_line_count(F.lit("--- a\n+++ b/x\n+one\n-two\n three"))) == 2
    assert one(spark, fn.diff_files(F.lit("+++ b/x.py\n+++ b/x.py\n+++ b/y"))) == ["x.py", "y"]
    assert one(spark, fn.word_at(F.lit("x = foo_bar(1)"), 6)) == "foo_bar"
    assert one(spark, fn.path_of_uri(F.lit("file:///a%20b"))) == "/a b"
    assert one(spark, fn.last_lines(F.lit("a\n\nb\nc"), 2)) == "b\nc"
    assert one(spark, fn.for_embedding(F.lit("a  \n\n\n\nb \n"), F.lit("[x]"))) == "[x]\na\n\nb"
    assert one(spark, fn.complexity(F.lit("def f():\n    if a and b:\n        pass\n    # if x"))) == 3
    assert one(spark, fn.semantic_label(F.lit("go"), F.lit("method"), F.lit("P"), F.lit("f"), F.array(F.lit("a"), F.lit("b")))) == "[go] method P.f (a, b)"


def test_fill_budget_truncates_then_goes_on(spark):
    df = spark.createDataFrame([("g", 1, "x" * 400), ("g", 2, "y" * 1200), ("g", 3, "z" * 40), ("h", 1, "w" * 9000)], "g string, o int, content string")
    got = {(r.g, r.o): r.content for r in parsing.fill_budget(df, 200, ["g"], "o").collect()}
    assert set(got) == {("g", 1), ("g", 2), ("h", 1)}
    assert got["g", 2].endswith("... [truncated]") and got["h", 1] == "w" * 9000


def test_lines_of_any_break_and_blank_kinds(spark):
    text = F.lit("a\n\n")
    assert one(spark, fn.lines(text)) == ["a", ""] and one(spark, fn.lines(F.lit(""))) == []
    assert one(spark, fn.lines(F.lit("a\r\nb\rc\x0bd\n"))) == "a\r\nb\rc\x0bd\n".splitlines()
    assert [one(spark, fn.line_kind(F.lit(x))) for x in ("\t", "\t# x", "\t x", "  */", "")] == ["blank", "comment", "code", "comment", "blank"]
    assert one(spark, fn.normal_body(F.lit("\tx = 1\n\t# no\n\t\n// no\r\n y "))) == "x = 1\ny"


def test_regex_search_counts_lines_in_the_file_and_tests_patterns_where_they_run(spark):
    docs = spark.createDataFrame([("k", "one\nTwo\nthree two", 40)], "key string, content string, start_line int")
    got = search.regex_search(docs, "two", 5, key="key", text="content", first="start_line").first()
    assert (got.score, got.matched_lines) == (2, [41, 42])
    assert search.regex_search(docs, "(?P<x>a)", 5, key="key", text="content").count() == 0
    hit = search.grep(docs, "two", word=True, key="key", text="content").first()
    assert (hit.line_number, hit.col, hit.line) == (3, 6, "three two")
    assert [r.match for r in search.grep_matches(docs, "[a-z]wo|t", "key", "content").orderBy("line_number", "ord").collect()] == ["t", "two"]


def test_dead_code_reports_classes(spark):
    rows = [("Api", "class", "a.py", "class Api:\n    pass"), ("used", "function", "a.py", "def used():\n    return 1"), ("caller", "function", "b.py", "def caller():\n    return used()"), ("__call__", "method", "b.py", "def __call__(self): pass")]
    s = spark.createDataFrame(rows, "name string, kind string, file_path string, body string")
    assert {r.name for r in rel.dead_code(s, rel.call_edges(s)).collect()} == {"Api", "caller"}


def test_regex_search_with_a_broken_pattern(spark):
    docs = spark.createDataFrame([(1, "a\nb")], "doc_id long, text string")
    assert search.regex_search(docs, "[broken", 5).count() == 0
    assert search.regex_search(docs, "A", 5).first().matched_lines == [1]


def test_sections_and_context(spark):
    chunks = spark.createDataFrame([(0, "a.py", 3, 4), (1, "a.py", 5, 5), (2, "b.py", 1, 2)], "ord int, file_path string, start_line int, end_line int")
    syms = spark.createDataFrame([("big", "a.py", 1, 9), ("small", "a.py", 2, 6)], "name string, file_path string, start_line int, end_line int")
    got = sorted((r.ord, r.start_line, r.end_line, r.name) for r in search.expand_sections(chunks, syms).collect())
    assert got == [(0, 2, 6, "small"), (2, 1, 2, None)]


def test_trend_directions(spark):
    rows = [("up", i, v) for i, v in enumerate((40.0, 60.0, 80.0))] + [("down", i, v) for i, v in enumerate((80.0, 50.0, 30.0))] + [("flat", 0, 50.0), ("flat", 1, 50.0), ("one", 0, 5.0)]
    got = {r.k: r.direction for r in rel.trend(spark.createDataFrame(rows, "k string, ts int, v double"), "v", "ts", ["k"]).collect()}
    assert got == {"up": "improving", "down": "degrading", "flat": "stable", "one": "stable"}


def test_trend_where_less_is_better(spark):
    df = spark.createDataFrame([("a", 1, 5.0), ("a", 2, 9.0)], "k string, ts int, v double")
    assert rel.trend(df, "v", "ts", ["k"], higher_is_better=False).first().direction == "degrading"


def test_engine_and_scan(spark, tmp_path):
    (tmp_path / "src" / ".git").mkdir(parents=True)
    (tmp_path / "src/core.py").write_text(CORE)
    (tmp_path / "src/.git/x.py").write_text("hidden = 1")
    (tmp_path / "src/app.js").write_text("function main() {\n  compute(1)\n}\n")
    found = files.scan(spark, str(tmp_path / "src"), [".py", ".js"])
    assert sorted(r.relative_path for r in found.select("relative_path").collect()) == ["app.js", "core.py"]
    e = Engine(spark, found.select(F.col("relative_path").alias("file_path"), "content"))
    syms = {r.name: r for r in e.symbols.where("kind <> 'import'").collect()}
    assert set(syms) == {"helper", "compute", "Box", "size", "main"} and syms["size"].parent == "Box" and syms["size"].parameters == ["self", "a", "b"]
    assert {(r.caller, r.callee) for r in e.edges.collect()} == {("core.py:compute", "helper"), ("core.py:size", "compute"), ("app.js:main", "compute")}
    assert {(r.node, r.depth) for r in e.impact("helper").collect()} == {("compute", 1), ("size", 2), ("main", 2)}
    assert {(r.name, r.depth) for r in e.trace("compute").collect()} == {("size", -1), ("main", -1), ("helper", 1)}
    assert e.keyword_search("helper").first().file_path == "core.py"
    assert e.invoke("references", name="helper").count() == 2
    with pytest.raises(ValueError):
        e.register_tool("grep", lambda: None)
    assert "flowchart LR" in files.mermaid(e.edges.select(F.col("caller").alias("src"), F.col("callee").alias("dst"))).first().text


def test_streaming_index_keeps_the_last_state(spark, tmp_path):
    src = str(tmp_path / "in")
    schema = "path string, content_hash string, deleted boolean"
    spark.createDataFrame([("a", "1", False), ("b", "1", False)], schema).coalesce(1).write.parquet(f"{src}/x1")
    spark.createDataFrame([("a", "2", False), ("b", "1", True)], schema).coalesce(1).write.parquet(f"{src}/x2")
    store = str(tmp_path / "store")
    for k, want in ((1, {("a", "1"), ("b", "1")}), (2, {("a", "2")})):
        jobs.keep_index(jobs.watch(spark, f"{src}/x{k}", schema), store, "path", str(tmp_path / f"c{k}")).awaitTermination()
        assert {(r.path, r.content_hash) for r in jobs.read_index(spark, store, "path").collect()} == want


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 10
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_call_edges_are_distinct_and_sort_no_calls(spark):
    rows = [("run", "method", "a.py", "", "help() help() run()", 1), ("run", "method", "a.py", "", "help() stop() gone()", 9), ("help", "function", "b.py", "", "pass", 1), ("stop", "function", None, "", "help()", 1)]
    s = spark.createDataFrame(rows, "name string, kind string, file_path string, parent string, body string, start_line int")
    edges = rel.call_edges(s)
    assert sorted(tuple(r)[:2] for r in edges.collect()) == [("a.py:run", "help"), ("a.py:run", "stop"), ("stop", "help")]
    plan = edges._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan


def test_trace_writes_its_edges_once_and_follows_names_to_their_first_place(spark):
    from lumenfold.sources.store import cut

    rows = [("a", "function", "1.py", "", "b() c()", 1), ("b", "function", "2.py", "", "c()", 1), ("b", "function", "3.py", "", "d()", 1), ("c", "function", "1.py", "", "a() d()", 5), ("d", "function", "4.py", "", "pass", 1)]
    s = spark.createDataFrame(rows, "name string, kind string, file_path string, parent string, body string, start_line int")
    held = []
    found = rel.trace(s, rel.call_edges(s), "a", cut=lambda df: held.append(df.columns) or cut(df))
    assert sorted((r.name, r.file_path, r.depth) for r in found.collect()) == [("b", "2.py", -2), ("b", "2.py", 1), ("c", "1.py", -1), ("c", "1.py", 1), ("d", "4.py", 2)]
    assert held.count(["caller", "callee"]) == 1


def test_tasks_of_parts_are_those_of_whole_files(spark):
    import random

    from lumenfold.operators import quality as qu

    rng = random.Random(3)
    line = lambda: rng.choice(["", "except:", "except Exception:", "def f(a):", "x = 1" * 9, "y = 2" * 8, "z = f(3) + 4" * 5])
    parts = [(f"{f}.py", i, "\n".join(line() for _ in range(rng.randint(1, 9)))) for f in "abc" for i in range(90)] + [("c.py", 90, ""), ("d.py", 0, "def f():\n"), ("d.py", 1, "\n"), ("e.txt", 0, "def f():\ndef g():")]
    text = {}
    for f, i, t in parts:
        text[f] = t if i == 0 else text[f] + "\n" + t
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    got = rows(qu.tasks_of_parts(spark.createDataFrame(parts, "file_path string, i int, content string"), ("i",)))
    want = []
    for f, t in text.items():
        ls = t.split("\n")[: -1 if t.endswith("\n") else None]
        blocks = ["\n".join(ls[i : i + 5]).strip(" \t\n\r\x0b\x0c") for i in range(len(ls) - 4)] if len(ls) >= 300 else []
        again = sum(1 for b in set(blocks) if len(b) > 60 and blocks.count(b) > 1)
        counts = (("type_hints", 2, len(re.findall(r"(?m)^\s*def\s+\w+\([^)]*\)\s*:", t)), 2), ("error_handling", 3, len(re.findall(r"\nexcept(?: Exception)?:", t)), 1), ("reduce_duplication", 4, again, 2))
        want += [(c, k, f, n) for c, k, n, least in counts if n >= least and f.endswith(".py")]
    assert got == sorted(want) and {r[0] for r in got} == {"type_hints", "error_handling", "reduce_duplication"}
    assert rows(qu.tasks(spark.createDataFrame(list(text.items()), "file_path string, content string"))) == got


def test_work_tasks_look_through_whole_files(spark):
    import __spark_entry__ as entry

    # a file a brand and a nation, so that files of many parts are looked through as well
    rows = entry.queries()["work_tasks"](spark, "/root/testdata/sf0.01").collect()
    brands = {f"{r.p_brand}.py" for r in spark.read.parquet("/root/testdata/sf0.01/part.parquet").select("p_brand").distinct().collect()}
    assert {r.file_path for r in rows if r.category == "type_hints" and r.file_path.startswith("Brand")} == brands
    assert {r.category for r in rows} == {"type_hints", "reduce_duplication"}


def test_chunks_leave_a_task_in_batches_of_bounded_size(spark):
    import pyarrow as pa

    texts = ["line of text\n" * n for n in (400, 0, 3, 900)] + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(list("abcde")), pa.array(texts, pa.string())], ["p", "t"])
    out = [b.to_pylist() for b in parsing._chunk_batches(iter([batch]), 100, 20, 1000)]
    assert len(out) > 15 and max(sum(len(r["content"]) for r in rows) for rows in out) < 1000 + 120
    want = [(p, k, *c) for p, t in zip("abcde", texts, strict=True) for k, c in enumerate(parsing.chunk_lines(t or "", 100, 20))]
    assert [tuple(r.values()) for rows in out for r in rows] == want
    got = parsing.chunks(spark.createDataFrame(list(zip("abcde", texts, strict=True)), "p string, t string"), 100, 20, "p", "t")
    assert sorted(tuple(r) for r in got.collect()) == want
