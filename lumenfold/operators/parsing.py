"""Chunks and symbols of source text; sequential work, so Arrow batches through Python."""

from __future__ import annotations

import ast
import re
import textwrap
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenfold.functions import text as fn
from lumenfold.operators import scopes

CHUNK = "file_path string, chunk_index int, start_line int, end_line int, content string"
SYMBOL = "name string, kind string, file_path string, start_line int, end_line int, start_col int, end_col int, body string, parent string, parameters array<string>, decorators array<string>"
SEMANTIC = "file_path string, chunk_index int, start_line int, end_line int, content string, symbol_name string, symbol_kind string, parent_symbol string, parameters array<string>"
#: Characters of chunks that a task gives on at once.
HELD = 1 << 22
_DEF = re.compile(r"^\s*(?:export\s+)?(?:pub\s+|public\s+|private\s+|static\s+|async\s+)*(?:function|func|fn|def|class)\s+([A-Za-z_]\w*)")
_IMPORT = re.compile(r"^\s*(?:import\s|from\s+\S+\s+import\s|use\s+\w|#include\s|require\b|using\s+\w|(?:const|let|var)\s+.*=\s*require\()")


def chunk_lines(content: str, size: int = 512, overlap: int = 64) -> list[tuple[int, int, str]]:
    """(first line, last line, text): a chunk closes at the line that fills it; the next begins with lines worth the overlap."""
    if not content or not content.strip():
        return []
    rows = content.splitlines(keepends=True)
    out, first, used = [], 0, 0
    for i, row in enumerate(rows):
        used += len(row)
        if used < size:
            continue
        out.append((first + 1, i + 1, "".join(rows[first : i + 1])))
        back, again = i + 1, 0
        while back > first and again < overlap:
            back -= 1
            again += len(rows[back])
        first = back if again >= overlap else i + 1
        used = sum(map(len, rows[first : i + 1]))
    if first < len(rows) and "".join(rows[first:]).strip():
        out.append((first + 1, len(rows), "".join(rows[first:])))
    return out


def _chunk_batches(batches: Iterator[pa.RecordBatch], size: int, overlap: int, most: int = HELD) -> Iterator[pa.RecordBatch]:
    names, kinds = ["file_path", "chunk_index", "start_line", "end_line", "content"], [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
    packed = lambda rows: pa.RecordBatch.from_arrays([pa.array(x, y) for x, y in zip(zip(*rows, strict=True), kinds, strict=True)], names)
    for batch in batches:
        rows, held = [], 0
        for p, t in zip(batch.column("p"), batch.column("t"), strict=True):
            name = p.as_py()
            for k, c in enumerate(chunk_lines(t.as_py() or "", size, overlap)):
                rows.append((name, k, *c))
                held += len(c[2])
                if held >= most:
                    yield packed(rows)
                    rows, held = [], 0
        if rows:
            yield packed(rows)


def chunks(files: DataFrame, size: int = 512, overlap: int = 64, path: str = "file_path", text: str = "content") -> DataFrame:
    """The chunks of all files; a task gives on some HELD characters of them at once, so it holds its batch of files and the chunks of one more."""
    rows = files.select(F.col(path).cast("string").alias("p"), F.col(text).alias("t"))
    return rows.mapInArrow(lambda batches: _chunk_batches(batches, size, overlap), CHUNK)


def parse(path: str, content: str) -> list[tuple]:
    """Symbol rows; Python by its syntax tree, languages with braces by their scopes, others by definition lines."""
    if scopes.family(path):
        return scopes.definitions(path, content)
    rows = content.split("\n")
    if not path.endswith(".py"):
        found = [(m[1], i) for i, r in enumerate(rows) if (m := _DEF.match(r))]
        ends = ([i for _, i in found[1:]] + [len(rows)]) if found else []
        out = []
        for (n, i), e in zip(found, ends, strict=True):
            kind = "class" if "class" in rows[i].split(n)[0] else "function"
            out.append((n, kind, path, i + 1, e, len(rows[i]) - len(rows[i].lstrip()), len(rows[e - 1]), "\n".join(rows[i:e]), "", [], []))
        return out + [(r.strip(), "import", path, i + 1, i + 1, 0, len(r), r, "", [], []) for i, r in enumerate(rows) if _IMPORT.match(r)]
    try:
        tree = ast.parse(content)
    except SyntaxError:
        return []
    out: list[tuple] = []

    def visit(node: ast.AST, parent: str) -> None:
        for x in ast.iter_child_nodes(node):
            span = lambda: (x.lineno, x.end_lineno, x.col_offset, x.end_col_offset, "\n".join(rows[x.lineno - 1 : x.end_lineno]))  # noqa: B023, E731
            if isinstance(x, (ast.Import, ast.ImportFrom)):
                *at, body = span()
                out.append((body.strip(), "import", path, *at, body, parent, [], []))
            elif isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                *at, body = span()
                marks = [ast.unparse(d) for d in x.decorator_list]
                if isinstance(x, ast.ClassDef):
                    out.append((x.name, "class", path, *at, body, parent, [], marks))
                    visit(x, x.name)
                else:
                    a = x.args
                    names = [p.arg for p in [*a.posonlyargs, *a.args, *([a.vararg] if a.vararg else []), *a.kwonlyargs, *([a.kwarg] if a.kwarg else [])]]
                    out.append((x.name, "method" if parent else "function", path, *at, body, parent, names, marks))
                    visit(x, parent)
            else:
                visit(x, parent)

    visit(tree, "")
    return out


def symbols(files: DataFrame, path: str = "file_path", text: str = "content") -> DataFrame:
    names = [x.split()[0] for x in SYMBOL.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([r for p, t in zip(pdf["p"], pdf["t"], strict=True) for r in parse(p, t or "")], columns=names)

    return files.select(F.col(path).cast("string").alias("p"), F.col(text).alias("t")).mapInPandas(run, SYMBOL)


def fill_budget(chunks: DataFrame, budget: int, by: list[str], order: str, text: str = "content") -> DataFrame:
    """Rows by rank within a token budget: what does not fit is cut to the rest of it if over 50 tokens remain, else the fill ends.

    A fold over each group's sorted array; groups are ranked lists of results, bounded by their top k.
    """
    item = F.struct(F.col(order).alias("o"), F.col(text).alias("t"))
    size = lambda t: F.greatest(F.lit(1), F.floor(F.length(t) / 4)).cast("int")
    empty = F.struct(F.lit(0).alias("used"), F.lit(False).alias("done"), F.array().cast("array<struct<o:int,t:string>>").alias("out"))

    def step(acc, x):
        fits = (acc["used"] + size(x["t"]) <= budget) | (F.size(acc["out"]) == 0)
        room = F.lit(budget) - acc["used"]
        brief = F.concat(F.substr(x["t"], F.lit(1), room * 4), F.lit("\n... [truncated]"))
        t = F.when(fits, x["t"]).otherwise(brief)
        stop = acc["done"] | (~fits & (room <= 50))
        take = ~stop & (fn.stripped(x["t"]) != "")
        more = F.array(F.struct(x["o"].cast("int").alias("o"), t.alias("t")))
        return F.struct(
            F.when(take, acc["used"] + size(t)).otherwise(acc["used"]).alias("used"), stop.alias("done"),
            F.when(take, F.concat(acc["out"], more)).otherwise(acc["out"]).alias("out"),
        )

    folded = chunks.groupBy(*by).agg(F.sort_array(F.collect_list(item)).alias("rows")).withColumn("f", F.aggregate("rows", empty, step))
    return folded.select(*by, F.posexplode("f.out").alias("p", "x")).select(*by, (F.col("p") + 1).alias("cite_id"), F.col("x.o").alias(order), F.col("x.t").alias(text))


# ----------------------------------------------------------------- by syntax tree
def _tree(body: str) -> ast.AST | None:
    try:
        return ast.parse(textwrap.dedent(body))
    except (SyntaxError, ValueError, RecursionError):
        return None


def tree_calls(body: str) -> list[str] | None:
    """Called names of Python code: plain names, and the last part of dotted ones; None where it does not parse."""
    tree = _tree(body)
    if tree is None:
        return None
    targets = [n.func for n in ast.walk(tree) if isinstance(n, ast.Call)]
    return sorted({t.id if isinstance(t, ast.Name) else t.attr for t in targets if isinstance(t, (ast.Name, ast.Attribute))})


_BRANCH = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.IfExp, ast.Assert, ast.comprehension)


def tree_complexity(body: str) -> int | None:
    """Cyclomatic complexity of the most complex function of Python code; None where there is none."""
    tree = _tree(body)
    if tree is None:
        return None

    def own(root: ast.AST) -> int:
        total, todo = 1, list(ast.iter_child_nodes(root))
        while todo:
            x = todo.pop()
            if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef)):
                continue
            total += isinstance(x, _BRANCH) + (len(x.values) - 1 if isinstance(x, ast.BoolOp) else 0)
            total += len(x.ifs) if isinstance(x, ast.comprehension) else len(x.cases) if isinstance(x, ast.Match) else 0
            todo += ast.iter_child_nodes(x)
        return total

    return max((own(n) for n in ast.walk(tree) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef))), default=None)


@F.pandas_udf(T.ArrayType(T.StringType()))
def calls_by_code(body: pd.Series, path: pd.Series) -> pd.Series:
    one = lambda b, p: None if b is None else scopes.calls(b, k) if (k := scopes.family(p or "")) else tree_calls(b) if (p or "").lower().endswith(".py") else None
    return pd.Series([one(b, p) for b, p in zip(body, path, strict=True)], dtype=object)


@F.pandas_udf(T.IntegerType())
def complexity_by_code(body: pd.Series, path: pd.Series) -> pd.Series:
    one = lambda b, p: None if b is None else scopes.complexity(b, k) if (k := scopes.family(p or "")) else tree_complexity(b) if (p or "").lower().endswith(".py") else None
    return pd.Series([one(b, p) for b, p in zip(body, path, strict=True)], dtype="Int32")


def _readable(path) -> Column:
    endings = (".py", *(x for v in scopes.FAMILIES.values() for x in v))
    return F.lower(F.regexp_extract(fn.c(path), r"(\.[^./]+)$", 1)).isin(*endings)


def called_names(body, path) -> Column:
    """Names that a body calls: by syntax tree for Python that parses, by tokens for languages with braces, else by pattern."""
    return F.coalesce(F.when(_readable(path), calls_by_code(fn.c(body), fn.c(path))), fn.calls(body))


def complexity_of(body, path) -> Column:
    """Complexity by syntax tree for Python that parses, by tokens for languages with braces, else by pattern."""
    return F.coalesce(F.when(_readable(path), complexity_by_code(fn.c(body), fn.c(path))), fn.complexity(body))


# ----------------------------------------------------------------- chunks along symbols
def _pieces(rows: list[str], first: int, last: int, size: int) -> list[tuple[int, int, str]]:
    """rows (of lines first to last) whole if they fit, else cut where a piece is full; blank rests go."""
    if sum(map(len, rows)) <= size:
        return [(first, last, "".join(rows))]
    out, start, used = [], 0, 0
    for i, row in enumerate(rows):
        used += len(row)
        if used >= size:
            out.append((first + start, first + i, "".join(rows[start : i + 1])))
            start, used = i + 1, 0
    rest = "".join(rows[start:])
    return [*out, (first + start, last, rest)] if rest.strip() else out


def uncovered_runs(n: int, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs of the lines 1 to n that no span covers."""
    out, at = [], 1
    for a, b in sorted(spans):
        if a > at:
            out.append((at, min(n, a - 1)))
        at = max(at, b + 1)
    return [*out, (at, n)] if at <= n else out


def semantic_chunk_lines(path: str, content: str, size: int = 512, overlap: int = 64) -> list[tuple]:
    """Rows of SEMANTIC without path: one chunk a symbol, long ones cut at lines, and what no symbol covers; without symbols, line chunks."""
    if not content or not content.strip():
        return []
    every = parse(path, content)
    symbols = [s for s in every if s[1] != "import" and s[7].strip()]
    if not every:
        return [(i, a, b, t, "", "block", "", []) for i, (a, b, t) in enumerate(chunk_lines(content, size, overlap))]
    rows, out = content.splitlines(keepends=True), []
    for name, kind, _, a, b, _, _, body, parent, params, _ in sorted(symbols, key=lambda s: (s[3], -s[4])):
        out += [(x, y, t, name, kind, parent, params) for x, y, t in _pieces(body.splitlines(keepends=True), a, b, size)]
    for a, b in uncovered_runs(len(rows), [(s[3], s[4]) for s in symbols]):
        block = rows[a - 1 : b]
        if "".join(block).strip():
            found = _pieces(block, a, b, size)
            kind = "module_header" if a <= 5 and len(found) == 1 and found[0][2] == "".join(block) else "block"
            out += [(x, y, t, "", kind, "", []) for x, y, t in found]
    out.sort(key=lambda r: r[0])
    return [(i, *r) for i, r in enumerate(out)]


def definition_chunk_lines(path: str, content: str, size: int = 1500, overlap: int = 200) -> list[tuple[int, int, str]]:
    """Top-level definitions with what stands before them, merged while they fit in size; a new chunk begins with lines worth the overlap."""
    if not content or not content.strip():
        return []
    top = sorted({(s[3], s[4]) for s in parse(path, content) if s[1] != "import" and not s[8]})
    ends = []
    for _, b in top:
        if not ends or b > ends[-1]:
            ends.append(b)
    if not ends:
        return chunk_lines(content, size, overlap)
    rows = content.splitlines()
    ends[-1] = len(rows)
    width = lambda a, b: sum(len(r) + 1 for r in rows[a - 1 : b])
    out, first, last = [], 1, ends[0]
    for a, b in zip([e + 1 for e in ends], ends[1:], strict=False):
        if width(first, last) + width(a, b) > size:
            out.append((first, last))
            back = last
            while back > first and width(back, last) < overlap:
                back -= 1
            first = min(back, a)
        last = b
    return [(a, b, "\n".join(rows[a - 1 : b])) for a, b in [*out, (first, last)]]


def semantic_chunks(files: DataFrame, size: int = 512, overlap: int = 64, path: str = "file_path", text: str = "content") -> DataFrame:
    """Chunks along symbols, with language and label."""
    names = [x.split()[0] for x in SEMANTIC.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(p, *r) for p, t in zip(pdf["p"], pdf["t"], strict=True) for r in semantic_chunk_lines(p, t or "", size, overlap)], columns=names)

    out = files.select(F.col(path).cast("string").alias("p"), F.col(text).alias("t")).mapInPandas(run, SEMANTIC).withColumn("language", fn.language_of("file_path"))
    label = fn.semantic_label(F.nullif("language", F.lit("unknown")), F.nullif("symbol_kind", F.lit("")), "parent_symbol", F.nullif("symbol_name", F.lit("")), "parameters")
    return out.withColumn("semantic_label", label)


def definition_chunks(files: DataFrame, size: int = 1500, overlap: int = 200, path: str = "file_path", text: str = "content") -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(p, k, *c) for p, t in zip(pdf["p"], pdf["t"], strict=True) for k, c in enumerate(definition_chunk_lines(p, t or "", size, overlap))]
            yield pd.DataFrame(rows, columns=["file_path", "chunk_index", "start_line", "end_line", "content"])

    return files.select(F.col(path).cast("string").alias("p"), F.col(text).alias("t")).mapInPandas(run, CHUNK)


# ----------------------------------------------------------------- guarded work
def map_rows(df: DataFrame, work, schema: str, batch: int = 64) -> tuple[DataFrame, DataFrame]:
    """(results, errors): work(rows of a batch as dicts) gives rows of schema; a batch that fails is an error row and is skipped, not tried again.

    batch=1 isolates single rows. Errors have the message and the number of rows skipped.
    """
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = pdf.to_dict("records")
            out = []
            for i in range(0, len(rows), batch):
                part = rows[i : i + batch]
                try:
                    out += [(*(r[n] for n in names), None, 0) for r in work(part)]
                except Exception as e:  # noqa: BLE001  user code; its failure is a row
                    out.append((*[None] * len(names), f"{type(e).__name__}: {e}", len(part)))
            yield pd.DataFrame(out, columns=[*names, "_error", "_skipped"]).astype(object)

    both = df.mapInPandas(run, f"{schema}, _error string, _skipped long")
    return both.where("_error is null").drop("_error", "_skipped"), both.where("_error is not null").select(F.col("_error").alias("error"), F.col("_skipped").alias("skipped"))
