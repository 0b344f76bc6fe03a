"""Files as tables, and the text sinks."""

from __future__ import annotations

import fnmatch

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.functions import text as fn

# Folders that a scan leaves out.
IGNORED = (
    ".git", "node_modules", "build", "dist", "venv", ".venv", "__pycache__", ".tox", ".mypy_cache", ".pytest_cache", "egg-info", ".eggs",
    ".idea", ".vscode", "target", "bin", "obj",
)


def glob_pattern(glob: str) -> str:
    """A glob as a pattern over the whole of a path; * crosses folders."""
    return r"\A" + fnmatch.translate(glob).replace(r"\Z", r"\z")


def scan(spark: SparkSession, root: str, extensions: list[str] | None = None, ignore_dirs: tuple[str, ...] = IGNORED, globs: tuple[str, ...] = (), hidden: bool = True) -> DataFrame:
    """(path, relative_path, extension, size_bytes, content_hash, content); extensions, in any case, are tested before contents are read.

    A file is left out if a folder of its relative path is ignored, or if that path fits one of the globs; with hidden=False
    also if a part of it begins with a dot.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if extensions:
        either = lambda e: "".join(f"[{ch.lower()}{ch.upper()}]" if ch.isalpha() else ch for ch in e)
        reader = reader.option("pathGlobFilter", "*{" + ",".join(map(either, extensions)) + "}")
    df = reader.load(root)
    rel = F.regexp_replace("path", "^.*?" + _quoted(root.rstrip("/")) + "/", "")
    parts = F.split("relative_path", "/")
    df = df.withColumn("relative_path", rel)
    if ignore_dirs:
        df = df.where(~F.arrays_overlap(parts, F.array(*[F.lit(d) for d in ignore_dirs])))
    if not hidden:
        df = df.where(~F.exists(parts, lambda x: x.startswith(".")))
    if globs:
        df = df.where(~F.col("relative_path").rlike("|".join(glob_pattern(g) for g in globs)))
    ext = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    return df.select("path", "relative_path", ext.alias("extension"), F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("content_hash"), F.decode("content", "UTF-8").alias("content"))


def file_count(spark: SparkSession, root: str, extensions: list[str]) -> int:
    """Files that an index would hold; no content is read."""
    return scan(spark, root, extensions, hidden=False).select("relative_path").count()


def hashes(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, content_hash) of given files."""
    return spark.read.format("binaryFile").load(paths).select("path", F.sha2("content", 256).alias("content_hash"))


def _quoted(x: str) -> str:
    return "".join("\\" + ch if not ch.isalnum() and ch not in "/_" else ch for ch in x)


def ignore_patterns(spark: SparkSession, path: str) -> list[str]:
    rows = spark.read.text(path).where((F.trim("value") != "") & ~F.trim("value").startswith("#"))
    return [r.value.strip() for r in rows.collect()]


def change_counts(spark: SparkSession, log: str) -> DataFrame:
    """(file_path, churn): commits by file, from a log of names (git log --name-only --pretty=format:); commit headers and blank lines do not count."""
    line = fn.stripped("value")
    names = spark.read.text(log).select(line.alias("file_path")).where("file_path <> '' and not file_path rlike '^(commit [0-9a-f]{7,}|Author:|Date:|Merge:)'")
    return names.groupBy("file_path").agg(F.count("*").alias("churn"))


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Unknown keys are dropped, absent ones null, broken records empty."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)


def results_json(results: DataFrame, query: str) -> DataFrame:
    rows = F.sort_array(F.collect_list(F.struct(*results.columns)))
    return results.agg(rows.alias("results")).select(F.to_json(F.struct(F.lit(query).alias("query"), F.size("results").alias("count"), "results")).alias("json"))


def results_jsonl(results: DataFrame) -> DataFrame:
    return results.select(F.to_json(F.struct(*results.columns)).alias("line"))


def results_text(results: DataFrame, context: int = 0) -> DataFrame:
    """One line a result for a terminal: place, score and the first lines of its content."""
    head = F.format_string("%s:%d-%d", "file_path", "start_line", "end_line")
    body = F.array_join(F.slice(fn.lines("content"), 1, 1 + context), "\n")
    return results.select(F.concat_ws("  ", head, F.format_number("score", 4), body).alias("line"))


def _figure(head: str, body: DataFrame, empty: str) -> DataFrame:
    """Lines under a heading as one row of text: a drawing is small by nature."""
    text = F.coalesce(F.nullif(F.array_join(F.sort_array(F.collect_list("line")), "\n"), F.lit("")), F.lit(empty))
    return body.agg(F.concat(F.lit(head + "\n"), text).alias("text"))


def _arrow(src: Column, src_label: Column, dst: Column, dst_label: Column) -> Column:
    return F.concat(F.lit("    "), src, F.lit('["'), src_label, F.lit('"] --> '), dst, F.lit('["'), dst_label, F.lit('"]'))


def mermaid(edges: DataFrame, direction: str = "LR", title: str = "Call Graph") -> DataFrame:
    """One row of flowchart text from (src, dst)."""
    line = _arrow(fn.node_id("src"), fn.short_label("src"), fn.node_id("dst"), fn.short_label("dst"))
    body = edges.where("src <> '' and dst <> ''").select(line.alias("line")).distinct()
    return _figure(f"---\ntitle: {title}\n---\nflowchart {direction}", body, '    empty["No call edges found"]')


def mermaid_dependencies(deps: DataFrame, direction: str = "TD", title: str = "Dependency Graph") -> DataFrame:
    """Flowchart of (source_file, import_text); long imports are cut to 40 characters."""
    last = F.element_at(F.split("import_text", " "), -1)
    brief = F.when(F.length(last) > 40, F.concat(F.substring(last, 1, 37), F.lit("..."))).otherwise(last)
    line = _arrow(fn.node_id("source_file"), F.element_at(F.split("source_file", "/"), -1), fn.node_id("import_text"), brief)
    body = deps.where("source_file <> '' and import_text <> ''").select(line.alias("line")).distinct()
    return _figure(f"---\ntitle: {title}\n---\nflowchart {direction}", body, '    empty["No dependencies found"]')


def mermaid_workspace(repos: DataFrame, title: str = "Workspace Repositories") -> DataFrame:
    """Star of (name, file_count, vector_count)."""
    line = F.concat(F.lit("    workspace --> "), fn.node_id(F.concat(F.lit("repo_"), "name")), F.lit('["'), "name", F.lit("\\n"), "file_count", F.lit(" files, "), "vector_count", F.lit(' vectors"]'))
    return _figure(f'---\ntitle: {title}\n---\nflowchart TD\n    workspace(("Workspace"))', repos.select(line.alias("line")), '    workspace --> none["No repositories"]')


def mermaid_classes(symbols: DataFrame, title: str = "Symbol Map") -> DataFrame:
    """Class diagram: methods under their class, free functions under Functions."""
    able = symbols.where("kind in ('class', 'method', 'function')")
    home = F.when(F.col("kind") == "class", F.col("name")).when((F.col("kind") == "method") & (F.col("parent") != ""), F.col("parent")).when(F.col("kind") == "function", F.lit("Functions"))
    member = F.when(F.col("kind") != "class", F.concat(F.lit("        +"), "name", F.lit("()\n")))
    boxes = able.select(home.alias("home"), member.alias("m"), "start_line", "name").where("home is not null").groupBy("home")
    members = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start_line", "name", "m"))), lambda x: x["m"]), "")
    line = F.concat(F.lit("    class "), F.regexp_replace("home", "[^A-Za-z0-9_]", "_"), F.lit(" {\n"), members, F.lit("    }"))
    return _figure(f"---\ntitle: {title}\n---\nclassDiagram", boxes.agg(line.alias("line")).select("line"), "    class Empty {\n        No symbols found\n    }")
