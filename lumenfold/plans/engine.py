"""One facade over an indexed corpus: retrieval, analysis, context, tools and hooks."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.functions import text as fn
from lumenfold.operators import embedding, history, indexes, parsing, quality, trigrams
from lumenfold.operators import relations as rel
from lumenfold.operators import search as se
from lumenfold.plans.tools import Executor, Outcome, Plugin, Plugins
from lumenfold.sources import files as sources
from lumenfold.sources.store import Tables, cut, delete, drop_cut, work_dir

# How many results, of what least score, and how many tokens of context, where none are given.
TOP, LEAST, RAG_LEAST, BUDGET, SUMMARY_CHARS, LEAST_BUDGET = 10, 0.3, 0.15, 3000, 1500, 200
MODES = ("semantic", "keyword", "regex", "hybrid", "multi")
TASKS = {"answer": "Answer the question from the context below.", "review": "Review the code below; list issues with severity, line, message and suggestion.",
         "refactor": "Suggest a better form of the code below, with an explanation.", "investigate": "Decide the next step of the investigation from the context below."}


@dataclass
class Engine:
    """files has file_path and content. Chunks, symbols, edges and vectors are made when first asked for and kept in the shared folder until close()."""

    spark: SparkSession
    files: DataFrame
    model: embedding.Model = embedding.hashed
    plugins: Plugins = field(default_factory=Plugins)

    # tables
    @cached_property
    def chunks(self) -> DataFrame:
        files = self.plugins.dispatch("pre_index", self.files)
        out = parsing.semantic_chunks(files).withColumn("key", F.concat_ws(":", fn.chunk_key("file_path", "start_line", "end_line"), "chunk_index"))
        return cut(self.plugins.dispatch("post_index", out))

    @cached_property
    def symbols(self) -> DataFrame:
        return cut(parsing.symbols(self.files))

    @cached_property
    def edges(self) -> DataFrame:
        return cut(rel.call_edges(self.symbols, parsing.called_names("body", "file_path")))

    @cached_property
    def vectors(self) -> DataFrame:
        return cut(embedding.embed_chunks(self.chunks, self.model))

    @cached_property
    def words(self) -> indexes.KeywordIndex:
        return indexes.KeywordIndex(self.spark, f"{self._root}/words", "key").build(self.chunks, "content")

    @cached_property
    def near(self) -> indexes.VectorIndex:
        size = len(embedding.embed_query("", self.model))
        index = indexes.VectorIndex(self.spark, f"{self._root}/near", size)
        index.add(self.vectors.where("embedding is not null"))
        return index

    @cached_property
    def trigrams(self) -> trigrams.TrigramIndex:
        return trigrams.TrigramIndex(self.spark, f"{self._root}/trigrams", "key").build(self.chunks, "content")

    @cached_property
    def _root(self) -> str:
        return f"{work_dir(self.spark)}/engine-{uuid.uuid4().hex}"

    @cached_property
    def deps(self) -> DataFrame:
        return rel.dependencies(self.symbols)

    def close(self) -> None:
        for name in ("chunks", "symbols", "edges", "vectors"):
            if name in self.__dict__:
                drop_cut(self.__dict__.pop(name))
        for name in ("words", "near", "trigrams"):
            self.__dict__.pop(name, None)
        if "_root" in self.__dict__:
            delete(self.spark, self.__dict__.pop("_root"))

    # retrieval
    def _shown(self, ranked: DataFrame) -> DataFrame:
        return self.plugins.dispatch("post_search", ranked.join(self.chunks, "key").orderBy(F.desc("score"), "key"))

    def keyword_search(self, query: str, k: int = TOP, least: float = 0.0) -> DataFrame:
        """The k best chunks for words, "phrases" and boolean clauses, from the stored postings."""
        return self._shown(self._keyword(query, k, least))

    def _keyword(self, query: str, k: int, least: float = 0.0) -> DataFrame:
        return se.threshold_after_top(self.words.matches(query), k, least, "key")

    def _semantic(self, query: str, k: int) -> DataFrame:
        return self.near.search(embedding.embed_query(query, self.model), k).select("key", "score")

    def semantic_search(self, query: str, k: int = TOP, least: float = LEAST) -> DataFrame:
        return self._shown(self._semantic(query, k).where(F.col("score") >= least))

    def regex_search(self, pattern: str, k: int = TOP, insensitive: bool = True) -> DataFrame:
        """The k chunks with most matching lines; only those are read whose stored trigrams a match can have."""
        return self._shown(self.trigrams.search(self.chunks, pattern, k, insensitive, "content", "start_line"))

    def hybrid_search(self, query: str, k: int = TOP) -> DataFrame:
        a, b = se.ranked(self._semantic(query, 2 * k), "key"), se.ranked(self._keyword(query, 2 * k), "key")
        return self._shown(se.top(se.rrf(a, b, "key"), k, "key"))

    def multi_search(self, query: str, k: int = TOP, least: float = RAG_LEAST) -> DataFrame:
        """Semantic hits, then keyword hits that are not among them."""
        a = self._semantic(query, k).where(F.col("score") >= least)
        both = se.multi_retrieve(a, self._keyword(query, k), ["key"])
        return both.join(self.chunks, "key").orderBy("arm", F.desc("score"), "key")

    def search(self, query: str, mode: str = "semantic", k: int = TOP, least: float = LEAST, sections: bool = False, exclude: str | None = None, snippet: int | None = None) -> DataFrame:
        """Any mode; 0 results asked are the usual number, and the least score holds for semantic search only."""
        if mode not in MODES:
            raise ValueError(f"mode is one of {', '.join(MODES)}")
        k = k or TOP
        found = {"semantic": lambda: self.semantic_search(query, k, least), "keyword": lambda: self.keyword_search(query, k), "regex": lambda: self.regex_search(query, k), "hybrid": lambda: self.hybrid_search(query, k), "multi": lambda: self.multi_search(query, k)}[mode]()
        if sections:
            found = se.expand_sections(se.ranked(found, "key").withColumnRenamed("rank", "ord").select("ord", "file_path", "start_line", "end_line"), self.symbols.where("kind <> 'import'"))
        return se.shown(found, exclude, None if sections else snippet)

    def similar(self, q: list[float], k: int = TOP) -> DataFrame:
        return self._shown(self.near.search(q, k).select("key", "score"))

    def grep(self, pattern: str, glob: str | None = None, limit: int | None = 50, **how) -> DataFrame:
        files = self.files if glob is None else self.files.where(F.col("file_path").rlike(se.glob_pattern(glob)))
        return se.grep(files, pattern, key="file_path", text="content", limit=limit, **how)

    def file_context(self, path: str, line: int, around: int = 30) -> DataFrame:
        rows = se.line_rows(self.files.where(F.col("file_path") == path), "file_path", "content")
        return rows.where(F.col("line_number").between(line - around, line + around))

    def retrieve_context(self, query: str, budget: int = BUDGET, k: int = TOP, mode: str = "hybrid", summary: bool = False) -> DataFrame:
        """(cite_id, rank, content, place...): hits of any mode, once each, ranked anew and cut to a budget of tokens; a summary is charged to it."""
        if summary:
            used = quality.summary_text(self.summary()).select(fn.token_estimate(F.substring("text", 1, SUMMARY_CHARS)).alias("n")).first().n
            budget = max(LEAST_BUDGET, budget - used)
        hits = self.search(query, mode, k, RAG_LEAST)
        hits = rel.first_of(hits, ["file_path", "start_line", "end_line"], F.desc("score"), "key").withColumn("score", fn.rerank_score("score", "content", query))
        ranked = se.ranked(hits, "key").withColumn("one", F.lit(1))
        return parsing.fill_budget(ranked, budget, ["one"], "rank").drop("one").join(ranked.drop("content", "one"), "rank")

    def retrieval_stats(self, query: str, budget: int = BUDGET, k: int = TOP, mode: str = "hybrid") -> DataFrame:
        """(total, after_dedup, after_budget, total_chars, budget_used) of one retrieval."""
        hits = self.search(query, mode, k, RAG_LEAST)
        kept = self.retrieve_context(query, budget, k, mode)
        a = hits.agg(F.count("*").alias("total"), F.countDistinct("file_path", "start_line", "end_line").alias("after_dedup"))
        b = kept.agg(F.count("*").alias("after_budget"), F.coalesce(F.sum(F.length("content")), F.lit(0)).alias("total_chars"))
        return a.crossJoin(b).withColumn("budget_used", F.round(F.col("total_chars") / (4 * budget), 3))  # single rows

    def prompt(self, question: str, task: str = "answer", cite: bool = True, **how) -> str:
        """Instructions, context with citations, and the question: what a chat provider would be sent."""
        rows = self.retrieve_context(question, **how).orderBy("cite_id")
        ref = fn.citation("cite_id", "file_path", "start_line", "end_line")
        found = rows.select(ref.alias("ref"), "content").collect()  # within the token budget
        head = TASKS.get(task, TASKS["answer"]) + (" Cite sources as [N]." if cite else "")
        return "\n\n".join([head, *[f"{r.ref}\n{r.content}" for r in found], question])

    # symbols
    def find_symbol(self, name: str | None = None, kind: str | None = None, file_path: str | None = None, parent: str | None = None, language: str | None = None) -> DataFrame:
        return indexes.find(self.symbols, name, kind, file_path, parent, language)

    def functions(self, file_path: str | None = None) -> DataFrame:
        return self.find_symbol(file_path=file_path).where("kind in ('function', 'method')")

    def classes(self, file_path: str | None = None) -> DataFrame:
        return self.find_symbol(kind="class", file_path=file_path)

    def imports(self, file_path: str | None = None) -> DataFrame:
        return self.find_symbol(kind="import", file_path=file_path)

    def symbol_listing(self, file_part: str | None = None, kind: str | None = None, most: int = 200) -> DataFrame:
        return indexes.listing(self.symbols, file_part, kind, most)

    def named(self, name: str, most: int) -> DataFrame:
        """The first symbols of a name: 5 for a hover, 10 for its definitions, 20 for a completion, 50 for a workspace."""
        return self.find_symbol(name).orderBy("file_path", "start_line").limit(most)

    def completion(self, name: str, most: int = 20) -> tuple[DataFrame, bool]:
        return self.named(name, most), self.find_symbol(name).limit(most + 1).count() > most

    def word_references(self, word: str) -> DataFrame:
        return self.keyword_search(word, 20)

    def references(self, name: str) -> DataFrame:
        word = rf"(^|[^A-Za-z0-9_]){re.escape(name)}([^A-Za-z0-9_]|$)"
        return self.symbols.where((F.col("name") == name) | F.col("body").rlike(word)).withColumn("how", F.when(F.col("name") == name, "definition").otherwise("reference"))

    def target(self, what: str) -> tuple[str, DataFrame]:
        """What is meant: a file's symbols if there is such a file, else the symbols of a name."""
        rows = self.find_symbol(file_path=what)
        if not self.files.where(F.col("file_path") == what).isEmpty():
            return "file", rows
        return "symbol", self.find_symbol(what).where("kind <> 'import'")

    # graphs
    def callers(self, name: str) -> DataFrame:
        return rel.callers_of(self.edges, name)

    def callees(self, key: str) -> DataFrame:
        return rel.callees_of(self.edges, key)

    def call_graph(self, name: str) -> DataFrame:
        return rel.call_graph(self.edges, name)

    def impact(self, what: str, depth: int = 5) -> DataFrame:
        """(node, depth) of all that calls a symbol, or the symbols of a file, directly or not."""
        _, rows = self.target(what)
        up = self.edges.select(F.col("callee").alias("src"), F.element_at(F.split("caller", ":"), -1).alias("dst"))
        return rel.reach(up, rows.select(F.col("name").alias("node")), depth).where("depth > 0")

    def affected_modules(self, what: str) -> DataFrame:
        """(file_path, how) of files that import the file of a target, or hold a direct caller."""
        _, rows = self.target(what)
        own = rows.select("file_path").distinct()
        stem = F.regexp_extract("file_path", r"([^/]+?)(?:\.[^./]*)?$", 1)
        words = self.deps.select(F.col("source_file").alias("file_path"), F.explode(F.array_distinct(F.regexp_extract_all("import_text", F.lit(r"[A-Za-z0-9_\-]+"), 0))).alias("stem"))
        users = words.join(own.select(stem.alias("stem")).distinct(), "stem", "left_semi").select("file_path", F.lit("imports_target").alias("how"))
        direct = self.edges.join(rows.select(F.col("name").alias("callee")).distinct(), "callee", "left_semi").select("file_path", F.lit("contains_caller").alias("how"))
        every = users.unionByName(direct).join(own, "file_path", "left_anti")
        return every.groupBy("file_path").agg(F.max("how").alias("how"))

    def trace(self, name: str, depth: int = 5) -> DataFrame:
        return rel.trace(self.symbols, self.edges, name, depth)

    def dependencies(self, file_path: str) -> DataFrame:
        return self.deps.where(F.col("source_file") == file_path)

    def dependents(self, module: str) -> DataFrame:
        return rel.dependents(self.deps, module)

    def polyglot(self) -> DataFrame:
        return rel.polyglot(self.deps)

    def cross_language(self) -> DataFrame:
        return rel.cross_language_edges(self.symbols)

    def universal_graph(self) -> DataFrame:
        return rel.universal_edges(self.edges, self.cross_language())

    # quality
    def dead_code(self) -> DataFrame:
        return rel.dead_code(self.symbols, self.edges)

    def complexity(self, least: int = 10) -> DataFrame:
        return quality.complex_symbols(self.symbols, least, parsing.complexity_of("body", "file_path"))

    def duplicates(self, threshold: float = 0.75, most: int | None = None) -> DataFrame:
        able = self.symbols.where(F.col("kind").isin("function", "method")).withColumn("id", F.concat_ws(":", "file_path", "name"))
        out = rel.duplicates(able, threshold).withColumn("similarity", F.round("similarity", 3))
        return out if most is None else out.orderBy(F.desc("similarity"), "a", "b").limit(most)

    def unsafe_lines(self) -> DataFrame:
        return quality.unsafe_lines(self.files)

    def metrics(self) -> DataFrame:
        return quality.file_metrics(self.files, self.symbols, parsing.complexity_of("body", "file_path"))

    def report(self) -> DataFrame:
        return quality.quality_report(self.files, self.symbols, self.edges, complexity=parsing.complexity_of("body", "file_path"))

    def gate(self, policy: dict[str, float] | None = None) -> DataFrame:
        return quality.gate(quality.measures_for_gate(quality.project_metrics(self.metrics()), self.report()), policy)

    def hotspots(self, churn: DataFrame | None = None, k: int = 20) -> DataFrame:
        return quality.hotspots(self.files, self.symbols, self.edges, churn, k, parsing.complexity_of("body", "file_path"))

    def pull_request(self, old: DataFrame) -> dict[str, DataFrame]:
        """Summary, impact, unsafe lines, reviewers and risk of the change from old files to these."""
        before = parsing.symbols(old)
        differ = rel.changes(old.select("file_path", fn.content_hash("content").alias("content_hash")), self.files.select("file_path", fn.content_hash("content").alias("content_hash")), "file_path")
        changed = cut(differ)
        near = lambda t: t.join(changed.select("file_path"), "file_path", "left_semi")
        summary = cut(quality.change_summary(near(before), near(self.symbols)))
        impact = quality.changed_impact(changed, self.symbols, self.edges)
        unsafe = quality.unsafe_lines(near(self.files))
        return {"summary": summary, "impact": impact, "unsafe": unsafe, "reviewers": quality.reviewers(changed), "risk": quality.change_report(summary, unsafe, impact)}

    def validate(self, code: str) -> DataFrame:
        return quality.unsafe_lines(self.spark.createDataFrame([("", code)], "file_path string, content string"))

    # summaries and context
    def summary(self) -> DataFrame:
        return quality.repository_summary(self.symbols)

    def explain(self, name: str | None = None, file_path: str | None = None) -> DataFrame:
        return quality.explained(self.symbols, self.find_symbol(name, file_path=file_path).where("kind <> 'import'"))

    def context(self, name: str, most: int = 5) -> DataFrame:
        return quality.context_windows(self.symbols, self.named(name, most))

    def context_for_symbol(self, name: str) -> dict[str, DataFrame]:
        first = self.named(name, 1).select(F.col("file_path").alias("source_file"))
        return {"explanations": self.explain(name).limit(5), "windows": self.context(name), "call_graph": self.call_graph(name), "dependencies": self.deps.join(first, "source_file", "left_semi")}

    def context_for_file(self, path: str) -> dict[str, DataFrame]:
        return {"symbols": self.find_symbol(file_path=path), "explanations": self.explain(file_path=path), "dependencies": self.dependencies(path)}

    def context_for_query(self, query: str, k: int = 5, least: float = 0.2) -> DataFrame:
        return self.semantic_search(query, k, least)

    def context_bundle(self, name: str | None = None, file_path: str | None = None) -> dict[str, DataFrame]:
        """Summary, focus, call graph and dependencies."""
        focus = {"focus": self.context(name)} if name else {"focus": self.find_symbol(file_path=file_path)} if file_path else {}
        return {"summary": self.summary(), **focus, "call_graph": self.edges, "dependencies": self.deps}

    # extension
    def register_hook(self, name: str, hook: Callable[[DataFrame], DataFrame], point: str = "post_search") -> None:
        self.plugins.register(Plugin(name, {point: hook}))

    @cached_property
    def executor(self) -> Executor:
        own = (self.keyword_search, self.semantic_search, self.hybrid_search, self.regex_search, self.grep, self.references, self.callers, self.call_graph, self.impact, self.trace, self.dependencies, self.dead_code, self.complexity, self.duplicates, self.summary, self.explain, self.context, self.retrieve_context, self.report, self.file_context, self.validate)
        return Executor({f.__name__: f for f in own})

    def register_tool(self, name: str, tool: Callable[..., DataFrame]) -> None:
        self.executor.register(name, tool)

    def tools(self) -> dict[str, Callable[..., DataFrame]]:
        return self.executor.tools()

    def execute(self, tool: str, /, **arguments) -> Outcome:
        return self.executor.execute(tool, **arguments)

    def invoke(self, tool: str, /, **arguments) -> DataFrame:
        found = self.tools().get(tool)
        if found is None:
            raise KeyError(f"no tool {tool}")
        return found(**arguments)

    def record(self, store: history.QueryHistory, query: str, results: DataFrame, now: float) -> DataFrame:
        rows = se.ranked(results, "key").withColumn("language", fn.language_of("file_path"))
        return store.record(history.query_record(rows, query, now))


def files_in(spark: SparkSession, path: str) -> DataFrame:
    """The files of known languages below a folder."""
    return sources.scan(spark, path, sorted(fn.LANGUAGES)).select(F.col("relative_path").alias("file_path"), "content")


@dataclass
class Workspace:
    """Several repositories, by name, searched and analysed together.

    Each is indexed once, when first searched or by index_all(), until close(). With a root, the names and folders of
    repositories added by folder are kept there and load() finds them again; statistics of the last indexing likewise.
    """

    spark: SparkSession
    root: str | None = None
    repos: dict[str, DataFrame] = field(default_factory=dict)
    engines: dict[str, Engine] = field(default_factory=dict)

    @classmethod
    def load(cls, spark: SparkSession, root: str) -> Workspace:
        out = cls(spark, root)
        held = out.manifest()
        for r in held.orderBy("name").collect() if held is not None else []:
            out.add(r.name, files_in(spark, r.path))
        return out

    def manifest(self) -> DataFrame | None:
        return Tables(self.spark, self.root).load("workspace") if self.root else None

    def add(self, name: str, files: DataFrame) -> None:
        if name in self.repos:
            raise ValueError(f"{name} exists")
        self.repos[name] = files

    def add_folder(self, name: str, path: str) -> None:
        self.add(name, files_in(self.spark, path))
        if self.root:
            Tables(self.spark, self.root).upsert("workspace", self.spark.createDataFrame([(name, path)], "name string, path string"), "name")

    def remove(self, name: str) -> None:
        del self.repos[name]
        if name in self.engines:
            self.engines.pop(name).close()
        if self.root:
            Tables(self.spark, self.root).remove("workspace", F.col("name") == name)

    def engine(self, name: str) -> Engine:
        if name not in self.engines:
            self.engines[name] = Engine(self.spark, self.repos[name])
        return self.engines[name]

    def index_all(self, now: float, force: bool = False) -> dict[str, DataFrame]:
        """Statistics by repository; those indexed before are indexed again only with force."""
        out = {}
        for name in self.repos:
            if force and name in self.engines:
                self.engines.pop(name).close()
            e = self.engine(name)
            stats = indexes.index_stats(e.chunks, e.symbols, now)
            out[name] = indexes.IndexStats(self.spark, f"{self.root}/stats/{name}").save(stats) if self.root else stats
        return out

    def stats(self, name: str) -> DataFrame | None:
        return indexes.IndexStats(self.spark, f"{self.root}/stats/{name}").load() if self.root else None

    def close(self) -> None:
        while self.engines:
            self.engines.popitem()[1].close()

    def files(self) -> DataFrame:
        out = None
        for name, files in self.repos.items():
            one = files.select(F.lit(name).alias("repo"), "file_path", "content")
            out = one if out is None else out.unionByName(one)
        return out

    def search(self, query: str, k: int = TOP, mode: str = "semantic", least: float = LEAST) -> DataFrame:
        """The k best of each repository, then of all; the least score holds for semantic search only."""
        out = None
        for name in self.repos:
            one = self.engine(name).search(query, mode, k, least).select(F.lit(name).alias("repo"), "key", "score", "file_path", "start_line", "end_line")
            out = one if out is None else out.unionByName(one)
        return se.top(out, k, "key")

    def cross_duplicates(self, threshold: float = 0.7, min_lines: int = 4, chars: int = 600) -> DataFrame:
        """Symbols of different repositories whose bodies, up to a length, resemble each other."""
        symbols = parsing.symbols(self.files().withColumn("file_path", F.concat_ws("|", "repo", "file_path")))
        repo, able = F.split("file_path", r"\|"), symbols.where("kind in ('function', 'method', 'class')")
        rows = able.where(F.size(fn.lines("body")) >= min_lines).select(F.concat_ws(":", repo[0], "name").alias("id"), repo[0].alias("repo"), F.substring("body", 1, chars).alias("body"))
        return rel.duplicates(rows.groupBy("id", "repo").agg(F.min("body").alias("body")), threshold, 1, "id", "body", "repo").withColumn("similarity", F.round("similarity", 2)).orderBy(F.desc("similarity"), "a", "b")
