"""Stored indexes over Parquet: vectors with cells, postings by token, digests, symbols, manifest and statistics."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.functions import text as fn
from lumenfold.operators import positions
from lumenfold.operators import search as se
from lumenfold.sources.store import Tables, cut, drop_cut, spread

# From how many vectors on an index is cut into cells, how many, and how many a query visits.
CELLS_FROM, CELLS, PROBES = 50_000, 100, 10
SAMPLE = 20_000
BUCKETS = 64


# ----------------------------------------------------------------- vectors
def _stack(s: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in s]) if len(s) else np.zeros((0, 1))


def dots(vector, q: list[float]) -> Column:
    """Inner products with one query, a matrix product a batch."""
    query = np.asarray(q, np.float64)

    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in series:
            yield pd.Series(_stack(s) @ query if len(s) else [], dtype="float64")

    return F.pandas_udf(run, "double")(fn.c(vector))


def fit_cells(vectors: DataFrame, cells: int = CELLS, vector: str = "embedding", seed: int = 1, sample: int = SAMPLE) -> np.ndarray:
    """Centres of at most `cells` cells, fitted on about `sample` vectors."""
    n = vectors.count()
    some = vectors if n <= sample else vectors.where(F.pmod(F.xxhash64(vector), F.lit(1 << 20)) < (1 << 20) * sample // n)
    data = some.select(array_to_vector(F.transform(vector, lambda x: x.cast("double"))).alias("features"))
    return np.array(KMeans(k=max(2, min(cells, max(2, n // 4))), seed=seed, maxIter=10).fit(data).clusterCenters())


def cell_of(vector, centres: np.ndarray) -> Column:
    half = (centres**2).sum(axis=1) / 2

    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in series:
            yield pd.Series((_stack(s) @ centres.T - half).argmax(axis=1) if len(s) else [], dtype="int32")

    return F.pandas_udf(run, "int")(fn.c(vector))


def nearest_cells(q: list[float], centres: np.ndarray, probes: int = PROBES) -> list[int]:
    score = centres @ np.asarray(q) - (centres**2).sum(axis=1) / 2
    return np.argsort(-score)[:probes].tolist()


def probes_needed(vectors: DataFrame, centres: np.ndarray, recall: float = 0.95, k: int = 10, vector: str = "embedding", sample: int = 4096, asked: int = 128) -> int:
    """How many cells a query must visit for this recall, measured on a sample of rows of which some are queries."""
    rows = vectors.orderBy(F.xxhash64(vector)).limit(sample).select(vector).collect()
    x = np.array([r[0] for r in rows], np.float64)
    q = x[:asked]
    near = np.argsort(-(q @ x.T), axis=1)[:, :k]
    cell = (x @ centres.T - (centres**2).sum(axis=1) / 2).argmax(axis=1)
    order = np.argsort(-(q @ centres.T - (centres**2).sum(axis=1) / 2), axis=1)
    place = np.argsort(order, axis=1)  # of each cell among those that a query visits
    at = np.sort(np.take_along_axis(place, cell[near], axis=1).ravel())
    return int(at[min(len(at) - 1, int(np.ceil(recall * len(at))) - 1)]) + 1 if len(at) else 1


class VectorIndex:
    """Rows (key, file_path, ..., embedding) of one dimension; from CELLS_FROM rows on they are kept by cell, and a search reads the nearest cells only."""

    def __init__(self, spark: SparkSession, root: str, dim: int, key: str = "key"):
        self.tables, self.dim, self.key, self.spark = Tables(spark, root), dim, key, spark

    def add(self, rows: DataFrame) -> DataFrame:
        bad = rows.where(F.col("embedding").isNull() | (F.size("embedding") != self.dim)).count()
        if bad:
            raise ValueError(f"{bad} rows have no vector of {self.dim} components")
        rows = rows.withColumn("embedding", F.transform("embedding", lambda x: x.cast("float")))
        centres = self.centres()
        if centres is not None:
            return self.tables.append("vectors", rows.withColumn("cell", cell_of("embedding", centres)), "cell")
        out = self.tables.append("vectors", rows.withColumn("cell", F.lit(0)), "cell")
        return self.build_cells() if out.count() >= CELLS_FROM else out

    def load(self) -> DataFrame | None:
        return self.tables.load("vectors")

    def centres(self) -> np.ndarray | None:
        held = self.tables.load("centres")
        return None if held is None else np.array([r.c for r in held.orderBy("i").collect()])

    def build_cells(self, cells: int = CELLS) -> DataFrame:
        """Fits the cells anew and rewrites the vectors by them."""
        rows = self.load()
        centres = fit_cells(rows, cells)
        need = max(PROBES, probes_needed(rows, centres))
        self.tables.save("centres", self.spark.createDataFrame([(i, c.tolist(), need) for i, c in enumerate(centres)], "i int, c array<double>, probes int"))
        return self.tables.save("vectors", rows.drop("cell").withColumn("cell", cell_of("embedding", centres)).repartition("cell"), "cell")

    def search(self, q: list[float], k: int = 10, probes: int | None = None) -> DataFrame:
        """The k best of the cells visited: of as many as the recall measured when they were built asks for, or of `probes`."""
        rows, centres = self.load(), self.centres()
        if centres is not None and probes is None:
            probes = self.tables.load("centres").first().probes
        if rows is None:
            return self.spark.createDataFrame([], f"{self.key} string, score double")
        if centres is not None:
            rows = rows.where(F.col("cell").isin(nearest_cells(q, centres, probes)))
        return se.top(rows.withColumn("score", dots("embedding", q)).drop("embedding", "cell"), k, self.key)

    def remove_by_file(self, path: str) -> int:
        return self.tables.remove("vectors", F.col("file_path") == path)

    def vectors_for_file(self, path: str) -> DataFrame:
        return self.load().where(F.col("file_path") == path).orderBy(self.key)


# ----------------------------------------------------------------- words
class KeywordIndex:
    """Postings with positions by token bucket, text lengths and corpus statistics; a search reads the buckets of its tokens alone."""

    def __init__(self, spark: SparkSession, root: str, key: str = "doc_id"):
        self.tables, self.key, self.spark = Tables(spark, root), key, spark

    def _laid_out(self, post: DataFrame) -> DataFrame:
        return post.withColumn("b", F.pmod(F.crc32("tok"), F.lit(BUCKETS)).cast("int")).repartition("b").sortWithinPartitions("b", "tok")

    def _lengths(self, keys: DataFrame, post: DataFrame) -> DataFrame:
        return keys.select(self.key).distinct().join(post.groupBy(self.key).agg(F.first("dl").cast("long").alias("dl")), self.key, "left").fillna(0, ["dl"])

    def build(self, docs: DataFrame, text: str = "text") -> "KeywordIndex":
        self.tables.save("postings", self._laid_out(positions.postings(docs, self.key, text)), "b")
        # from the texts: each has postings in most buckets, so that they would bring its key many times
        size = F.greatest(F.lit(0), F.coalesce(F.size(fn.tokens(text)), F.lit(0))).cast("long")
        self.tables.save("lengths", spread(docs.select(self.key, text)).select(self.key, size.alias("dl")).groupBy(self.key).agg(F.max("dl").alias("dl")))
        return self._count()

    def _count(self) -> "KeywordIndex":
        self.tables.save("corpus", self.tables.load("lengths").agg(F.count("*").alias("n"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("average")))
        return self

    def load(self, n_docs: int | None = None) -> bool:
        """Whether a stored index can be used: it is there, and holds n_docs documents."""
        held = self.tables.load("corpus")
        return held is not None and (n_docs is None or held.first().n == n_docs)

    def ensure(self, docs: DataFrame, text: str = "text") -> "KeywordIndex":
        return self if self.load(docs.count()) else self.build(docs, text)

    def num_docs(self) -> int:
        held = self.tables.load("corpus")
        return 0 if held is None else held.first().n

    def matches(self, query: str) -> DataFrame:
        """(key, score) of every document that meets a query of words, "phrases", AND, OR, NOT, + and - (positions.clauses)."""
        asked, stats = positions.clauses(query), self.tables.load("corpus").first()
        wanted = sorted({zlib.crc32(t.encode()) % BUCKETS for t in asked.tokens()})
        post = self.tables.load("postings").where(F.col("b").isin(wanted))
        return positions.matches(post, asked, stats.n, stats.average or 1.0, self.key)

    def search(self, query: str, k: int = 10) -> DataFrame:
        """The k best of them."""
        return se.top(self.matches(query), k, self.key)

    def add(self, docs: DataFrame, text: str = "text") -> "KeywordIndex":
        """Documents replace those of their keys; where all keys are new nothing is rewritten."""
        if self.tables.load("postings") is None:
            return self.build(docs, text)
        fresh = docs.select(self.key).distinct()
        if not self.tables.load("lengths").join(fresh, self.key, "left_semi").isEmpty():
            self.remove(fresh)
        post = cut(positions.postings(docs, self.key, text))
        self.tables.append("lengths", self._lengths(fresh, post))
        self.tables.append("postings", self._laid_out(post), "b")
        drop_cut(post)
        return self._count()

    def remove(self, gone: DataFrame) -> None:
        gone = gone.select(self.key).distinct()
        for name, by in (("lengths", ()), ("postings", ("b",))):
            self.tables.save(name, self.tables.load(name).join(gone, self.key, "left_anti"), *by)
        self._count()

    def drop(self) -> None:
        for name in ("postings", "lengths", "corpus"):
            self.tables.drop(name)


# ----------------------------------------------------------------- digests
class DigestStore:
    """(key, content_hash) of files or chunks; a chunk's key is path:start:end."""

    def __init__(self, spark: SparkSession, root: str, name: str = "digests"):
        self.tables, self.name, self.spark = Tables(spark, root), name, spark

    def save(self, rows: DataFrame) -> DataFrame:
        return self.tables.save(self.name, rows.select("key", "content_hash"))

    def load(self) -> DataFrame:
        held = self.tables.load(self.name)
        return self.spark.createDataFrame([], "key string, content_hash string") if held is None else held

    def update(self, fresh: DataFrame, gone: DataFrame | None = None) -> DataFrame:
        return self.tables.upsert(self.name, fresh.select("key", "content_hash"), "key", gone=gone)

    def changed(self, current: DataFrame) -> DataFrame:
        """Rows of current (key, content_hash) that are new or differ."""
        return current.join(self.load().select("key", F.col("content_hash").alias("_s")), "key", "left").where(~F.col("content_hash").eqNullSafe(F.col("_s"))).drop("_s")

    def keys_for_file(self, path: str) -> DataFrame:
        return self.load().where(F.startswith("key", F.lit(f"{path}:"))).select("key")

    def remove_by_file(self, path: str) -> int:
        return self.tables.remove(self.name, F.startswith("key", F.lit(f"{path}:")))


# ----------------------------------------------------------------- symbols
class SymbolStore:
    """Symbol rows by file."""

    def __init__(self, spark: SparkSession, root: str):
        self.tables = Tables(spark, root)

    def save(self, symbols: DataFrame) -> DataFrame:
        return self.tables.save("symbols", symbols)

    def load(self) -> DataFrame | None:
        return self.tables.load("symbols")

    def replace_files(self, fresh: DataFrame, gone: DataFrame | None = None) -> DataFrame:
        """Symbols of changed files replace theirs, those of deleted files go."""
        return self.tables.upsert("symbols", fresh, "file_path", gone=gone)

    def remove_file(self, path: str) -> int:
        return self.tables.remove("symbols", F.col("file_path") == path)


def find(symbols: DataFrame, name: str | None = None, kind: str | None = None, file_path: str | None = None, parent: str | None = None, language: str | None = None) -> DataFrame:
    """Rows that equal all values given."""
    for column, value in ((F.col("name"), name), (F.col("kind"), kind), (F.col("file_path"), file_path), (F.col("parent"), parent), (fn.language_of("file_path"), language)):
        symbols = symbols if value is None else symbols.where(column == value)
    return symbols


def search_name(symbols: DataFrame, part: str) -> DataFrame:
    return symbols.where(F.contains(F.lower("name"), F.lit(part.lower())))


def listing(symbols: DataFrame, file_part: str | None = None, kind: str | None = None, most: int = 200) -> DataFrame:
    """At most `most` symbols whose path holds a text, with the number of all of them."""
    rows = symbols if file_part is None else symbols.where(F.contains("file_path", F.lit(file_part)))
    rows = rows if kind is None else rows.where(F.col("kind") == kind)
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy("file_path", "start_line", "name").limit(most).crossJoin(F.broadcast(total))


def language_summary(symbols: DataFrame) -> DataFrame:
    return symbols.groupBy(fn.language_of("file_path").alias("language")).agg(F.count("*").alias("n"))


def kind_summary(symbols: DataFrame) -> DataFrame:
    return symbols.groupBy("kind").agg(F.count("*").alias("n"))


# ----------------------------------------------------------------- manifest and statistics
MANIFEST = "model string, dimension int, created_at double, updated_at double, files long, chunks long"
STATS = "last_indexed_at double, files long, chunks long, symbols long, avg_chunk_chars double, language_coverage array<struct<language:string,files:long,chunks:long,lines:long,symbols:long>>"


class Manifest:
    """One row on what an index was built with. Unknown keys are dropped, absent ones null; no manifest is None."""

    def __init__(self, spark: SparkSession, root: str):
        self.tables, self.spark = Tables(spark, root), spark

    def save(self, **values) -> None:
        names = [x.split()[0] for x in MANIFEST.split(", ")]
        self.tables.save("manifest", self.spark.createDataFrame([tuple(values.get(n) for n in names)], MANIFEST))

    def load(self):
        held = self.tables.load("manifest")
        return None if held is None else held.first()

    def is_compatible(self, model: str, dimension: int) -> bool:
        m = self.load()
        return m is not None and m.model == model and m.dimension == dimension


def index_stats(chunks: DataFrame, symbols: DataFrame, now: float) -> DataFrame:
    """One row of STATS: counts of all and by language (chunks: file_path, start_line, end_line, content)."""
    lang = fn.language_of("file_path").alias("language")
    a = chunks.groupBy(lang).agg(F.countDistinct("file_path").alias("files"), F.count("*").alias("chunks"), F.sum(F.col("end_line") - F.col("start_line") + 1).cast("long").alias("lines"), F.sum(F.length("content")).alias("chars"))
    b = symbols.groupBy(lang).agg(F.count("*").alias("symbols"))
    rows = a.join(b, "language", "full_outer").fillna(0)
    cover = F.sort_array(F.collect_list(F.struct("language", "files", "chunks", "lines", "symbols")))
    average = F.round(F.coalesce(F.try_divide(F.sum("chars"), F.sum("chunks")), F.lit(0.0)), 1)
    return rows.agg(F.lit(now).alias("last_indexed_at"), *[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("files", "chunks", "symbols")], average.alias("avg_chunk_chars"), cover.alias("language_coverage"))


class IndexStats:
    """The statistics of the last indexing, kept as one row; None before the first."""

    def __init__(self, spark: SparkSession, root: str):
        self.tables = Tables(spark, root)

    def save(self, stats: DataFrame) -> DataFrame:
        return self.tables.save("index_stats", stats.coalesce(1))

    def load(self) -> DataFrame | None:
        return self.tables.load("index_stats")


def languages() -> dict[str, list[str]]:
    """The file endings of each language, in order."""
    return {lang: sorted(e for e, x in fn.LANGUAGES.items() if x == lang) for lang in sorted(set(fn.LANGUAGES.values()))}


def language_endings(files: DataFrame, path: str = "file_path") -> DataFrame:
    """(language, endings, files) of the languages that files are in: which endings they have, in order, and how many files there are."""
    ending = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1)).alias("ending")
    rows = files.select(F.col(path).alias("path"), fn.language_of(path).alias("language"), ending).groupBy("language", "ending").agg(F.countDistinct("path").alias("n"))
    # the endings of a language are few; those of no language are not listed
    known = rows.withColumn("ending", F.when(F.col("language") != "unknown", F.col("ending")))
    return known.groupBy("language").agg(F.array_sort(F.collect_set("ending")).alias("endings"), F.sum("n").alias("files"))


def language_stats(stats: DataFrame, language: str) -> DataFrame:
    return stats.select(F.explode(F.filter("language_coverage", lambda x: x["language"] == language)).alias("x")).select("x.*")


def staleness(stats: DataFrame, now: float) -> DataFrame:
    """Seconds since the last indexing; 0 if there was none."""
    return stats.select(F.when(F.coalesce("last_indexed_at", F.lit(0.0)) <= 0, 0.0).otherwise(F.lit(now) - F.col("last_indexed_at")).alias("seconds"))
