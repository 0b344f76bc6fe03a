import duckdb
from test_graph_shuffle import shuffled

from lumenfold import code_queries  # noqa: F401  adds to the catalogue
from lumenfold.catalog import QUERIES, SQL
from lumenfold.operators import quality as qu

SCHEMA = "file_path string, name string, kind string, start_line int, end_line int, parent string, body string, parameters array<string>"


def test_a_long_file_is_not_carried_by_each_of_its_symbols(spark):
    """One target in a file of 40,000 symbols: 535,282 bytes were shuffled when all of these went on as one list, and 1,177 since."""
    n = 40_000
    long = spark.range(n).selectExpr("'a.py' as file_path", "concat('f', id) as name", "'function' as kind", "cast(id + 1 as int) as start_line", "cast(id + 1 as int) as end_line", "'' as parent", "'' as body", "cast(array() as array<string>) as parameters")
    before = shuffled(spark)
    got = qu.explained(long, long.where("start_line = 3")).collect()
    assert [(r.name, r.related, r.file_imports) for r in got] == [("f2", ["f0", "f1", "f3", "f4", "f5"], 0)] and shuffled(spark) - before < 50_000
    got = {r.name: r.related for r in qu.explained(long, long).collect()}
    assert got == {f"f{i}": [f"f{k}" for k in range(6) if k != i][:5] for i in range(n)}


def test_relatives_of_symbols_that_share_name_and_line(spark):
    row = lambda f, name, line, kind="function": (f, name, kind, line, line, "", " import x ", [])
    one = [row("a.js", "a", 1)] * 9 + [row("a.js", "b", 1)] * 2 + [row("a.js", x, k) for k, x in enumerate("acde", 2)] + [row("a.js", "x", 1, "import")] * 3
    rows = one + [row("b.js", "only", 4), row("c.js", "y", 1, "import"), row(None, "n", 2), row(None, "m", 1)]
    symbols = spark.createDataFrame(rows, SCHEMA).repartition(5)
    targets = spark.createDataFrame([row("a.js", "a", 1), row("a.js", "b", 1), row("a.js", "a", 2), row("b.js", "only", 4), row("c.js", "y", 1, "import"), row(None, "n", 2), row("d.js", "z", 1)], SCHEMA)
    got = {(r.file_path, r.name, r.start_line): (r.related, r.file_imports) for r in qu.explained(symbols, targets).collect()}
    assert got == {
        ("a.js", "a", 1): (["b", "b", "a", "c", "d"], 3), ("a.js", "b", 1): (["a"] * 5, 3), ("a.js", "a", 2): (["a"] * 5, 3), ("b.js", "only", 4): ([], 0),
        ("c.js", "y", 1): ([], 1), (None, "n", 2): (["m"], 0), ("d.js", "z", 1): (None, None),
    }


def test_explanations_of_odd_tables_equal_sql(spark, tmp_path):
    """Keys that repeat or are null, parts without a brand or size, files of one symbol."""
    tables = {
        "supplier": ([(1, 0), (1, 0), (1, 0), (2, 0), (3, 0), (4, 0), (5, 0), (6, 0), (7, 0), (8, 1), (9, None), (None, 0), (None, None), (2, 1)], "s_suppkey long, s_nationkey int"),
        "part": ([(1, "A", 50), (2, "A", 3), (2, "A", 45), (2, "A", 45), (3, "A", None), (None, "A", 41), (4, "A", 41), (5, "A", 1), (6, None, 41), (7, None, 2), (8, "B", 50)], "p_partkey long, p_brand string, p_size int"),
        "lineitem": ([(1, 2), (1, 2), (1, 1), (9, 3), (None, 1), (2, None)], "l_suppkey long, l_partkey long"),
    }
    db = duckdb.connect()
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
        db.sql(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    key = lambda rows: sorted(map(repr, map(tuple, rows)))
    got = key(QUERIES["symbol_explanations"](spark, str(tmp_path)).select("name", "summary", "related").collect())
    assert got == key(db.sql(SQL["symbol_explanations"]).fetchall()) and len(got) == 25
