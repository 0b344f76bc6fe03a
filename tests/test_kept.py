import random

import pytest

from lumenfold.functions import text as fn
from lumenfold.operators import indexes, quality
from lumenfold.operators import relations as rel
from lumenfold.plans.engine import Workspace


def grams(t):
    return {t[i : i + 3] for i in range(max(1, len(t) - 2))} if t else set()


@pytest.mark.parametrize("threshold", [0.3, 0.75])
def test_duplicates_equal_all_pairs(spark, threshold):
    rng = random.Random(5)
    base = ["".join(rng.choice("abcde é😀") for _ in range(rng.choice([2, 3, 9, 40, 120]))).strip() for _ in range(12)]
    texts = [b if k == 0 else "".join(ch if rng.random() > 0.03 * k else rng.choice("abcx") for ch in b).strip() for b in base for k in range(4)]
    rows = [(i, t, "l" if i % 2 else "r") for i, t in enumerate([*texts, "", "", None, "ab", "ab"])]
    df = spark.createDataFrame(rows, "id int, body string, side string")
    want = {}
    for i, a, p in rows:
        for j, b, q in rows:
            if i < j and a and b and (x := grams(a)) and (y := grams(b)) and len(x & y) / len(x | y) >= threshold:
                want[i, j] = (len(x & y) / len(x | y), p != q)
    got = {(r.a, r.b): r.similarity for r in rel.duplicates(df, threshold, 1).collect()}
    assert got == {k: v for k, (v, _) in want.items()}
    across = {(r.a, r.b) for r in rel.duplicates(df, threshold, 1, apart="side").collect()}
    assert across == {k for k, (_, other) in want.items() if other}


def test_snapshots_and_statistics(spark, tmp_path):
    held = quality.Snapshots(spark, str(tmp_path / "s"))
    assert held.load().count() == 0
    row = lambda m: spark.createDataFrame([(m, 2.0, 10)], "maintainability_index double, avg_complexity double, total_loc long")
    report = spark.createDataFrame([(3,)], "issue_count int")
    for ts, m in ((1.0, 50.0), (2.0, 60.0), (3.0, 90.0), (3.0, 70.0)):
        held.save(ts, row(m), report, {"branch": "main"})
    assert [(r.ts, r.metadata["branch"]) for r in held.load(2).collect()] == [(3.0, "main"), (2.0, "main")]
    assert [(r.ts, r.maintainability_index) for r in held.measures().orderBy("ts").collect()] == [(1.0, 50.0), (2.0, 60.0), (3.0, 70.0)]
    assert {r.issue_count for r in held.measures("issue_count int", "report").collect()} == {3}
    assert rel.trend(held.measures(), "maintainability_index", "ts", []).first().direction == "improving"
    stats = indexes.IndexStats(spark, str(tmp_path / "i"))
    assert stats.load() is None
    chunks = spark.createDataFrame([("a.py", 1, 4, "abcd"), ("b.ts", 1, 1, "ab")], "file_path string, start_line int, end_line int, content string")
    stats.save(indexes.index_stats(chunks, chunks.select("file_path"), 7.0))
    got = stats.load().first()
    assert (got.files, got.chunks, got.avg_chunk_chars, got.last_indexed_at) == (2, 2, 3.0, 7.0) and [x.language for x in got.language_coverage] == ["python", "typescript"]


def test_workspace_is_kept_and_indexed_once(spark, tmp_path):
    for name, text in (("one", "def alpha():\n    return 1\n"), ("two", "def beta():\n    return alpha()\n")):
        (tmp_path / name).mkdir()
        (tmp_path / name / f"{name}.py").write_text(text)
    root = str(tmp_path / "w")
    w = Workspace(spark, root)
    w.add_folder("one", str(tmp_path / "one"))
    w.add_folder("two", str(tmp_path / "two"))
    with pytest.raises(ValueError):
        w.add_folder("one", str(tmp_path / "two"))
    assert {n: s.first().symbols for n, s in w.index_all(5.0).items()} == {"one": 1, "two": 1}
    first = w.engine("one")
    assert {r.repo for r in w.search("alpha", mode="keyword").collect()} == {"one", "two"} and w.engine("one") is first
    again = Workspace.load(spark, root)
    assert sorted(again.repos) == ["one", "two"] and again.stats("one").first().last_indexed_at == 5.0 and again.stats("three") is None
    again.remove("one")
    assert sorted(Workspace.load(spark, root).repos) == ["two"]
    w.close()


def test_languages_and_sizes(spark):
    assert indexes.languages()["python"] == [".py"] and ".tsx" in indexes.languages()["typescript"]
    df = spark.createDataFrame([("a.ts",), ("b.TSX",), ("b.TSX",), ("c",), (None,)], "file_path string")
    got = {r.language: (r.endings, r.files) for r in indexes.language_endings(df).collect()}
    assert got["typescript"] == ([".ts", ".tsx"], 2) and got["unknown"] == ([], 1)
    nodes = spark.createDataFrame([("x", -1), ("y", 2), ("t", 0)], "name string, depth int")
    assert tuple(rel.trace_size(nodes).first()) == (1, 1, 2) and tuple(rel.impact_size(nodes).first()) == (0, 1, 1)
    row = spark.createDataFrame([("aé😀b",), ("ab",), ("",), ("aaaa",)], "t string").select(fn.trigrams("t").alias("x")).collect()
    assert [r.x for r in row] == [["aé😀", "é😀b"], ["ab"], [], ["aaa"]]
