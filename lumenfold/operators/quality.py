"""Measures and judgements of code: lines, complexity, maintainability, gates, risk, changes, tasks, explanations."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenfold.functions import text as fn
from lumenfold.operators import parsing
from lumenfold.operators import relations as rel
from lumenfold.operators import search as se
from lumenfold.sources.store import Tables, spread
from lumenfold.sources.store import cut as store_cut

# What a project must hold to, by rule.
POLICY = {"min_maintainability": 40.0, "max_complexity": 25, "max_issues": 20, "max_dead_code": 15, "max_duplicates": 10, "require_safety_pass": 0}
# Folders that do not name an area of the code, marks that a reviewer should see.
PLAIN_FOLDERS = ("src", "lib")
MARKS = ("TODO", "FIXME", "HACK", "XXX")


# ----------------------------------------------------------------- measures
def line_counts(files: DataFrame, key: str = "file_path", text: str = "content") -> DataFrame:
    """(key, n_lines, code, comment, blank), counted inside each row."""
    kinds = F.transform(fn.lines(text), lambda x: fn.line_kind(x))
    of = lambda k: F.size(F.filter("kinds", lambda x: x == k)).cast("long").alias(k)
    return spread(files.where(F.col(text).isNotNull()).select(key, text)).select(key, kinds.alias("kinds")).select(key, F.size("kinds").cast("long").alias("n_lines"), of("code"), of("comment"), of("blank"))


def file_metrics(files: DataFrame, symbols: DataFrame, complexity: Column | None = None) -> DataFrame:
    """Lines by kind, complexity, symbols and maintainability of each file; complexity (of a symbol's body) is by pattern if not given."""
    cc = fn.complexity("body") if complexity is None else complexity
    own = symbols.select("file_path", F.when(F.col("kind").isin("function", "method"), cc).alias("cc"))
    own = own.groupBy("file_path").agg(F.coalesce(F.avg("cc"), F.lit(0.0)).alias("avg_complexity"), F.coalesce(F.max("cc"), F.lit(0)).alias("max_complexity"), F.count("*").alias("symbol_count"))
    rows = line_counts(files).join(own, "file_path", "left").fillna(0, ["avg_complexity", "max_complexity", "symbol_count"])
    ratio = F.coalesce(F.try_divide("comment", "n_lines"), F.lit(0.0))
    return rows.withColumn("comment_ratio", ratio).withColumn("maintainability_index", fn.maintainability(F.col("code").cast("double"), "avg_complexity", "comment_ratio"))


def project_metrics(metrics: DataFrame) -> DataFrame:
    """One row: sums over files, the mean of their mean complexities, and maintainability from the averages."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias
    one = metrics.agg(
        F.count("*").alias("files_analyzed"), total("code")("total_loc"), total("comment")("total_comment_lines"), total("blank")("total_blank_lines"),
        F.coalesce(F.avg("avg_complexity"), F.lit(0.0)).alias("avg_complexity"), F.coalesce(F.max("max_complexity"), F.lit(0)).alias("max_complexity"), total("symbol_count")("total_symbols"),
    )
    ratio = F.coalesce(F.try_divide("total_comment_lines", F.col("total_loc") + F.col("total_comment_lines") + F.col("total_blank_lines")), F.lit(0.0))
    one = one.withColumn("comment_ratio", ratio)
    loc = F.col("total_loc") / F.greatest(F.col("files_analyzed"), F.lit(1))
    return one.withColumn("maintainability_index", fn.maintainability(loc, "avg_complexity", "comment_ratio"))


def complex_symbols(symbols: DataFrame, least: int = 10, complexity: Column | None = None) -> DataFrame:
    """Functions and methods of at least this complexity, with their band."""
    rows = symbols.where(F.col("kind").isin("function", "method")).withColumn("complexity", fn.complexity("body") if complexity is None else complexity)
    return rows.where(F.col("complexity") >= least).withColumn("band", fn.complexity_band("complexity"))


# ----------------------------------------------------------------- safety
def unsafe_lines(files: DataFrame, key: str = "file_path", text: str = "content") -> DataFrame:
    """(key, line_number, pattern, line): one row for each danger pattern that a line meets."""
    hits = F.filter(F.transform(fn.lines(text), lambda x, i: F.struct((i + 1).alias("line_number"), fn.bad_patterns(x).alias("patterns"), x.alias("line"))), lambda r: F.size(r["patterns"]) > 0)
    rows = files.select(key, F.explode(hits).alias("x"))
    return rows.select(key, F.col("x.line_number").alias("line_number"), F.explode("x.patterns").alias("pattern"), F.col("x.line").alias("line"))


def is_safe(files: DataFrame, key: str = "file_path", text: str = "content") -> DataFrame:
    """(key, safe) of each text."""
    bad = unsafe_lines(files, key, text).select(key).distinct().withColumn("bad", F.lit(True))
    return files.select(key).join(bad, key, "left").select(key, F.col("bad").isNull().alias("safe"))


def diagnostics(unsafe: DataFrame) -> DataFrame:
    """Editor diagnostics of unsafe lines; line numbers from 0."""
    return unsafe.select("file_path", (F.col("line_number") - 1).alias("line"), F.lit(0).alias("start_col"), F.length("line").alias("end_col"), F.lit("warning").alias("severity"), F.format_string("matches danger pattern %d", "pattern").alias("message"))


def code_actions(unsafe: DataFrame) -> DataFrame:
    """One quick fix for each unsafe line."""
    return unsafe.select("file_path", "line_number", F.format_string("Review line %d", "line_number").alias("title"), F.lit("quickfix").alias("kind"), "pattern")


def complexity_diagnostics(symbols: DataFrame, complexity: Column | None = None) -> DataFrame:
    rows = complex_symbols(symbols, 0, complexity).where(F.col("band").isin("high", "very_high"))
    return rows.select("file_path", (F.col("start_line") - 1).alias("line"), F.concat(F.lit("complexity "), F.col("complexity").cast("string"), F.lit(" ("), "band", F.lit(")")).alias("message"))


def marked_lines(files: DataFrame, key: str = "file_path", text: str = "content") -> DataFrame:
    """(key, line_number, description, severity): comments that wait for work, and bare prints."""
    rows = se.line_rows(files, key, text)
    marks = F.filter(F.array(*[F.when(F.contains("line", F.lit(m)), F.struct(F.lit(f"{m} comment found").alias("description"), F.lit("info").alias("severity"))) for m in MARKS],
        F.when(F.startswith(fn.stripped("line"), F.lit("print(")) & ~F.startswith(fn.stripped("line"), F.lit('print(f"DEBUG')), F.struct(F.lit("Consider using logging instead of print()").alias("description"), F.lit("warning").alias("severity")))), lambda x: x.isNotNull())
    return rows.select(key, "line_number", F.explode(marks).alias("x")).select(key, "line_number", "x.*")


def precommit(files: DataFrame, *validators) -> tuple[DataFrame, DataFrame]:
    """(issues, verdict): unsafe lines and what validators (files -> file_path, line_number, description) add; one row says whether all pass."""
    issues = unsafe_lines(files).select("file_path", "line_number", F.format_string("matches danger pattern %d", "pattern").alias("description"))
    for v in validators:
        issues = issues.unionByName(v(files).select("file_path", "line_number", "description"))
    return issues, issues.agg(F.count("*").alias("issues"), (F.count("*") == 0).alias("passed"))


# ----------------------------------------------------------------- gates
def quality_report(files: DataFrame, symbols: DataFrame, edges: DataFrame, threshold: int = 10, similarity: float = 0.75, complexity: Column | None = None) -> DataFrame:
    """One row of counts: complex symbols, dead code, duplicates, unsafe lines and all of these as issues."""
    able = symbols.where(F.col("kind").isin("function", "method")).withColumn("id", F.concat_ws(":", "file_path", "name"))
    parts = {"complex": complex_symbols(symbols, threshold, complexity), "dead_code": rel.dead_code(symbols, edges), "duplicates": rel.duplicates(able, similarity), "unsafe": unsafe_lines(files)}
    out = None
    for name, rows in parts.items():
        one = rows.agg(F.count("*").alias(name))
        out = one if out is None else out.crossJoin(one)  # single rows
    return out.withColumn("issue_count", sum((F.col(n) for n in parts), F.lit(0)))


def gate(measured: DataFrame, policy: dict[str, float] | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., rule, actual, threshold): a row for each rule of the policy that the measures break; none means it holds.

    measured has, for each rule in the policy, a column of the rule's name without min_, max_ or require_: of min_ rules less is
    a breach, of the others more. A null measure breaks nothing.
    """
    checks = []
    for rule, limit in (POLICY | (policy or {})).items():
        column = rule.split("_", 1)[1]
        if column in measured.columns:
            x = F.col(column).cast("double")
            checks.append(F.when(x < limit if rule.startswith("min_") else x > limit, F.struct(F.lit(rule).alias("rule"), x.alias("actual"), F.lit(float(limit)).alias("threshold"))))
    if not checks:
        raise ValueError("no rule of the policy has a measure")
    return measured.select(*by, F.explode(F.filter(F.array(*checks), lambda x: x.isNotNull())).alias("x")).select(*by, "x.*")


def measures_for_gate(project: DataFrame, report: DataFrame) -> DataFrame:
    """The row that gate() tests, from project_metrics and quality_report."""
    a = project.select(F.col("maintainability_index").alias("maintainability"), F.col("max_complexity").alias("complexity"))
    return a.crossJoin(report.select(F.col("issue_count").alias("issues"), "dead_code", "duplicates", F.col("unsafe").alias("safety_pass")))  # single rows


# ----------------------------------------------------------------- snapshots
class Snapshots:
    """Measures of a project over time: one row a snapshot, by its time; saving a time again replaces its row.

    A row holds all columns of project_metrics and quality_report as JSON, so that later measures don't change the table.
    """

    SCHEMA = "ts double, project string, report string, metadata map<string,string>"

    def __init__(self, spark: SparkSession, root: str):
        self.tables, self.spark = Tables(spark, root), spark

    def save(self, ts: float, project: DataFrame, report: DataFrame, metadata: dict[str, str] | None = None) -> DataFrame:
        """project and report are single rows."""
        whole = lambda df, name: df.limit(1).select(F.to_json(F.struct("*")).alias(name))
        marks = F.from_json(F.lit(json.dumps(metadata or {})), "map<string,string>")
        row = whole(project, "project").crossJoin(whole(report, "report")).select(F.lit(float(ts)).alias("ts"), "project", "report", marks.alias("metadata"))  # single rows
        return self.tables.upsert("snapshots", row, "ts")

    def load(self, limit: int = 50) -> DataFrame:
        """The newest first."""
        held = self.tables.load("snapshots")
        held = self.spark.createDataFrame([], self.SCHEMA) if held is None else held
        return held.orderBy(F.desc("ts")).limit(limit)

    def measures(self, schema: str = "maintainability_index double, avg_complexity double, total_loc long", of: str = "project") -> DataFrame:
        """(ts, the columns of schema) of all snapshots, for relations.trend."""
        return self.load(1 << 30).select("ts", F.from_json(of, schema).alias("m")).select("ts", "m.*")


# ----------------------------------------------------------------- changes
def change_summary(old: DataFrame, new: DataFrame) -> DataFrame:
    """By file: sorted names of symbols added, removed and modified, and import changes; of one name the last symbol counts."""
    last = lambda t, n: t.groupBy("file_path", "name", (F.col("kind") == "import").alias("imp")).agg(F.max_by("body", "start_line").alias(n))
    both = last(old, "ob").join(last(new, "nb"), ["file_path", "name", "imp"], "full_outer")
    names = lambda cond: F.sort_array(F.collect_list(F.when(cond, F.col("name"))))
    code = ~F.col("imp")
    signs = F.when(F.col("imp") & F.col("ob").isNull(), F.concat(F.lit("+"), "name")).when(F.col("imp") & F.col("nb").isNull(), F.concat(F.lit("-"), "name"))
    return both.groupBy("file_path").agg(
        names(code & F.col("ob").isNull()).alias("added"), names(code & F.col("nb").isNull()).alias("removed"),
        names(code & (F.col("ob") != F.col("nb"))).alias("modified"), F.sort_array(F.collect_list(signs)).alias("import_changes"),
    )


def changed_impact(changed: DataFrame, symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """(name, file_path): callers of the symbols of changed files (file_path), once each."""
    names = symbols.where("kind <> 'import'").join(changed.select("file_path").distinct(), "file_path", "left_semi").select(F.col("name").alias("callee")).distinct()
    return edges.join(names, "callee", "left_semi").select(F.element_at(F.split("caller", ":"), -1).alias("name"), "file_path").distinct()


def area(path) -> Column:
    """The first two parts of a path that say something: no dotted ones, no src or lib."""
    parts = F.filter(F.split(fn.c(path), "/"), lambda x: (x != "") & ~x.startswith(".") & ~x.isin(*PLAIN_FOLDERS))
    return F.coalesce(F.nullif(F.array_join(F.slice(parts, 1, 2), "/"), F.lit("")), F.lit("root"))


def reviewers(paths: DataFrame, path: str = "file_path") -> DataFrame:
    """(domain, file_count, files): changed files by area, largest first."""
    return paths.groupBy(area(path).alias("domain")).agg(F.count("*").alias("file_count"), F.sort_array(F.collect_list(path)).alias("files")).orderBy(F.desc("file_count"), "domain")


def risk(files, removed, modified, unsafe=0, affected=0) -> Column:
    """0 to 100 from the counts of a change."""
    n, r, m, u, a = (F.lit(x) if isinstance(x, int) else fn.c(x) for x in (files, removed, modified, unsafe, affected))
    score = F.when(n > 20, 20).when(n > 10, 10).when(n > 0, 5).otherwise(0) + F.when(r > 10, 20).when(r > 0, 10).otherwise(0)
    score = score + F.when(m > 10, 15).when(m > 0, 5).otherwise(0) + F.least(F.lit(30), u * 10) + F.when(a > 20, 15).when(a > 5, 10).otherwise(0)
    return F.least(F.lit(100), score).cast("int")


def change_report(summary: DataFrame, unsafe: DataFrame | None = None, affected: DataFrame | None = None) -> DataFrame:
    """One row: files, symbols added, removed and modified, unsafe lines, affected symbols, risk and its level."""
    size = lambda c: F.coalesce(F.sum(F.size(c)), F.lit(0)).cast("int").alias(c)
    out = summary.agg(F.count("*").alias("files"), size("added"), size("removed"), size("modified"))
    for name, rows in (("unsafe", unsafe), ("affected", affected)):
        out = out.withColumn(name, F.lit(0)) if rows is None else out.crossJoin(rows.agg(F.count("*").alias(name)))  # single rows
    score = risk("files", "removed", "modified", "unsafe", "affected")
    return out.withColumn("risk", score).withColumn("level", fn.risk_band("risk"))


# ----------------------------------------------------------------- tasks
#: Lines of a block that may be repeated, and from how many lines on a file is looked through for it.
BLOCK_LINES, LONG_FILE = 5, 300


def tasks(files: DataFrame) -> DataFrame:
    """tasks_of_parts of files (file_path, content) that are rows of their own."""
    return tasks_of_parts(files.withColumn("_at", F.lit(0)), ("_at",))


def tasks_of_parts(parts: DataFrame, order: tuple[str, ...], text: str = "content", cut=store_cut) -> DataFrame:
    """(category, priority, file_path, found): Python files to work on, by what they lack: result types, narrow except clauses, helpers for repeated blocks.

    Two functions without a result type; a broad except clause at the margin; in files of 300 lines or more two repeated blocks of five lines over 60 characters.
    A file is its parts (rows of file_path and text) in order, a line break between two; no head of a function goes over the end of a part.
    No row holds a file: blocks over the end of a part come from the first and last lines of the parts alone.
    """
    near, at = BLOCK_LINES - 1, Window.partitionBy("file_path").orderBy(*order)
    rows = cut(parts.where(F.endswith("file_path", F.lit(".py")) & F.col(text).isNotNull()).select("file_path", *order, F.col(text).alias("text")))
    windows = lambda x: F.explode(F.transform(F.sequence(F.lit(1), F.size(x) - near), lambda i: fn.stripped(F.array_join(F.slice(x, i, F.lit(BLOCK_LINES)), "\n")))).alias("block")
    # where another part follows, a break at the end of the text is an empty line
    own, broken = fn.lines("text"), fn.lines(F.concat("text", F.lit("\n")))
    ends = rows.select("file_path", *order, F.size(own).alias("n"), (F.size(broken) - F.size(own)).alias("more"), F.slice(broken, 1, near).alias("head"), F.reverse(F.slice(F.reverse(own), 1, near)).alias("tail"),
        F.regexp_count("text", F.lit(r"(?m)^\s*def\s+\w+\([^)]*\)\s*:")).alias("untyped"), F.regexp_count("text", F.lit(r"\nexcept(?: Exception)?:")).alias("broad"), F.rlike("text", F.lit(r"\Aexcept(?: Exception)?:")).cast("int").alias("opens"))
    ends = ends.withColumns({"more": F.when(F.lead(F.lit(1)).over(at).isNull(), 0).otherwise(F.col("more")), "broad": F.col("broad") + F.when(F.row_number().over(at) > 1, F.col("opens")).otherwise(0)})
    ends = ends.withColumn("head", F.slice("head", F.lit(1), F.col("n") + F.col("more")))
    ends = cut(ends.withColumn("after", F.slice(F.flatten(F.collect_list("head").over(at.rowsBetween(1, near))), 1, near)))
    size = ends.groupBy("file_path").agg(F.sum(F.col("n") + F.col("more")).alias("lines"), F.sum("untyped").cast("int").alias("untyped"), F.sum("broad").cast("int").alias("broad"))
    over = F.concat("tail", F.array_repeat(F.lit(""), F.col("more")), "after").alias("ls")
    inside, crossing = (x.where(F.size("ls") >= BLOCK_LINES).select("file_path", windows(F.col("ls"))) for x in (rows.select("file_path", own.alias("ls")), ends.select("file_path", over)))
    blocks = inside.unionByName(crossing).where(F.length("block") > 60).join(F.broadcast(size.where(F.col("lines") >= LONG_FILE).select("file_path")), "file_path", "left_semi")
    # dealt before they are counted: blocks are seldom equal, so counts in the tasks that cut them would hold nearly all
    blocks = blocks.select("file_path", F.unhex(F.sha2("block", 256)).alias("h")).repartition("file_path", "h")
    again = blocks.groupBy("file_path", "h").agg(F.count("*").alias("n")).where("n >= 2").groupBy("file_path").agg(F.count("*").cast("int").alias("found"))
    part = lambda df, name, k: df.select(F.lit(name).alias("category"), F.lit(k).alias("priority"), "file_path", "found")
    typed, broad = size.withColumn("found", F.col("untyped")).where("found >= 2"), size.withColumn("found", F.col("broad")).where("found > 0")
    return part(typed, "type_hints", 2).unionByName(part(broad, "error_handling", 3)).unionByName(part(again.where("found >= 2"), "reduce_duplication", 4))


def next_task(files: DataFrame, failures: int = 0) -> DataFrame:
    """The task of highest priority: failing tests first, then by category and path; without any, a small improvement."""
    spark = files.sparkSession
    schema = "category string, priority int, file_path string, found int"
    fixed = [("small_optimisation", 5, None, 0)] + ([("fix_tests", 1, None, failures)] if failures else [])
    return tasks(files).unionByName(spark.createDataFrame(fixed, schema)).orderBy("priority", "file_path").limit(1)


def test_summary(output) -> Column:
    """(total, failed, errors) from the last summary line of a test run."""
    last = F.element_at(F.filter(fn.lines(output), lambda x: x.rlike(r"\d+ (passed|failed|error)")), -1)
    n = lambda word: F.coalesce(F.nullif(F.regexp_extract(last, rf"(\d+) {word}", 1), F.lit("")).cast("int"), F.lit(0))
    return F.struct((n("passed") + n("failed") + n("error")).alias("total"), n("failed").alias("failed"), n("error").alias("errors"))


# ----------------------------------------------------------------- summaries and explanations
def repository_summary(symbols: DataFrame) -> DataFrame:
    """Counts by language, and of all in the row whose language is null."""
    lang = F.coalesce(fn.grammar_of("file_path"), F.lit("unknown")).alias("language")
    kinds = [F.count_if(F.col("kind") == k).alias(n) for k, n in (("function", "functions"), ("class", "classes"), ("method", "methods"), ("import", "imports"))]
    return symbols.select("*", lang).rollup("language").agg(F.countDistinct("file_path").alias("files"), F.count("*").alias("symbols"), *kinds)


def longest(symbols: DataFrame, kind: str, n: int = 10) -> DataFrame:
    return symbols.where(F.col("kind") == kind).orderBy(F.desc(F.col("end_line") - F.col("start_line")), "file_path", "start_line").limit(n)


def summary_text(summary: DataFrame) -> DataFrame:
    """The summary as text, one row."""
    line = F.when(F.col("language").isNull(), F.format_string("Files: %d\nTotal symbols: %d\nFunctions: %d\nClasses: %d\nMethods: %d\nImports: %d\n\n-- Languages --", "files", "symbols", "functions", "classes", "methods", "imports")).otherwise(F.format_string("  %s: %d files, %d functions, %d classes", "language", "files", "functions", "classes"))
    rows = F.transform(F.sort_array(F.collect_list(F.struct(F.col("language").isNotNull().alias("a"), (-F.col("files")).alias("b"), "language", line.alias("line")))), lambda x: x["line"])
    return summary.agg(F.concat(F.lit("=== Repository Summary ===\n"), F.array_join(rows, "\n")).alias("text"))


def context_windows(symbols: DataFrame, targets: DataFrame) -> DataFrame:
    """Each target symbol (rows of symbols) with the names of the other symbols and the imports of its file."""
    code = F.col("kind") != "import"
    peers = symbols.groupBy("file_path").agg(
        F.sort_array(F.collect_list(F.when(code, F.struct("start_line", "name", "kind")))).alias("_peers"),
        F.transform(F.sort_array(F.collect_list(F.when(~code, F.struct("start_line", fn.stripped("body").alias("text"))))), lambda x: x["text"]).alias("imports"),
    )
    rows = targets.join(peers, "file_path", "left")
    others = F.filter("_peers", lambda x: ~((x["name"] == F.col("name")) & (x["start_line"] == F.col("start_line"))))
    return rows.withColumn("related", F.transform(others, lambda x: x["name"])).drop("_peers")


def first_peers(symbols: DataFrame, n: int) -> DataFrame:
    """(file_path, _peers, imports): of each file's symbols in order as many as hold the first n beside any one of them, and how many imports it has.

    A symbol goes by name and line, so of n + 1 of these one can be left out; each stands at most n + 1 times.
    """
    w = Window.partitionBy("file_path").orderBy(F.asc_nulls_last("start_line"), F.asc_nulls_last("name"))
    first = symbols.where("kind <> 'import'").select("file_path", "start_line", "name").withColumn("_r", F.dense_rank().over(w)).where(F.col("_r") <= n + 1)
    first = first.groupBy("file_path", "_r", "start_line", "name").agg(F.least(F.count("*"), F.lit(n + 1)).cast("int").alias("_n"))
    imports = symbols.groupBy("file_path").agg(F.count_if(F.col("kind") == "import").alias("imports"))
    places = F.sort_array(F.collect_list(F.when(F.col("_r").isNotNull(), F.struct("_r", "start_line", "name", "_n"))))
    files = first.unionByName(imports, allowMissingColumns=True).groupBy("file_path").agg(places.alias("_places"), F.sum("imports").cast("int").alias("imports"))
    return files.select("file_path", F.flatten(F.transform("_places", lambda x: F.array_repeat(F.struct(x["name"].alias("name"), x["start_line"].alias("start_line")), x["_n"]))).alias("_peers"), "imports")


def explained(symbols: DataFrame, targets: DataFrame, among: int = 0) -> DataFrame:
    """One factual sentence about each target symbol, its first five relatives and the number of its file's imports.

    Relatives are the file's symbols of another name or line, with `among` (six at most) those that its first `among` symbols hold.
    """
    args = F.concat(F.lit("("), F.array_join("parameters", ", "), F.lit(")"))
    n = F.col("end_line") - F.col("start_line") + 1
    owner = F.when(F.coalesce("parent", F.lit("")) != "", F.concat(F.lit(" of class `"), "parent", F.lit("`"))).otherwise("")
    head = lambda kind: F.concat(F.lit(f"{kind} `"), "name")
    at = F.concat(F.lit(" defined at line "), F.col("start_line").cast("string"))
    text = (
        F.when(F.col("kind") == "function", F.concat(head("Function"), args, F.lit("`"), at, F.lit(".")))
        .when(F.col("kind") == "method", F.concat(head("Method"), args, F.lit("`"), owner, at, F.lit(".")))
        .when(F.col("kind") == "class", F.concat(head("Class"), F.lit("`"), at, F.lit(", spanning "), n.cast("string"), F.lit(" lines.")))
        .when(F.col("kind") == "import", F.concat(F.lit("Import statement at line "), F.col("start_line").cast("string"), F.lit(": `"), fn.stripped("body"), F.lit("`")))
        .otherwise(F.concat(F.initcap("kind"), F.lit(" `"), "name", F.lit("` at line "), F.col("start_line").cast("string"), F.lit(".")))
    )
    rows = targets.select("file_path", "name", "kind", "start_line", text.alias("summary"))
    rows = rows.join(first_peers(symbols, 5).withColumnRenamed("file_path", "_file"), F.expr("file_path <=> _file"), "left")
    others = F.filter(F.slice("_peers", 1, among) if among else "_peers", lambda x: ~((x["name"] == F.col("name")) & (x["start_line"] == F.col("start_line"))))
    return rows.select("file_path", "name", "kind", "start_line", "summary", F.slice(F.transform(others, lambda x: x["name"]), 1, 5).alias("related"), F.col("imports").alias("file_imports"))


def hotspots(files: DataFrame, symbols: DataFrame, edges: DataFrame, churn: DataFrame | None = None, k: int = 20, complexity: Column | None = None) -> DataFrame:
    """The k symbols of highest weighted risk: complexity, callers, callees, near copies in the file, commits of the file."""
    able = symbols.where(F.col("kind").isin("function", "method")).withColumn("key", F.concat_ws(":", "file_path", "name")).withColumn("complexity", fn.complexity("body") if complexity is None else complexity)
    able = able.groupBy("key", "name", "file_path").agg(F.max("complexity").alias("complexity"), F.max_by("body", "start_line").alias("body"))
    into = able.select("key", F.col("name").alias("callee")).join(edges, "callee").groupBy("key").agg(F.count("*").alias("fan_in"))
    out = edges.groupBy(F.col("caller").alias("key")).agg(F.count("*").alias("fan_out"))
    pairs = rel.duplicates(able, 0.70, 3, "key").select(F.explode(F.array("a", "b")).alias("key"))
    dup = pairs.join(able.select("key", "file_path"), "key").groupBy("file_path").agg(F.count("*").alias("duplication"))
    return rel.hotspots(able.drop("body"), into, out, dup, churn, k)


def symbols_and_edges(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    symbols = parsing.symbols(files)
    return symbols, rel.call_edges(symbols, parsing.called_names("body", "file_path"))


def last_of_name(symbols: DataFrame, kind: str | None = None) -> DataFrame:
    """One row a name, the last by place: imports by name alone, other symbols by name and line."""
    rows = symbols if kind is None else symbols.where(F.col("kind") == kind)
    key = F.when(F.col("kind") == "import", F.col("name")).otherwise(F.concat_ws(":", "name", "start_line"))
    return rows.withColumn("_k", key).withColumn("_r", F.row_number().over(Window.partitionBy("_k").orderBy(F.desc("file_path"), F.desc("start_line")))).where("_r = 1").drop("_k", "_r")
