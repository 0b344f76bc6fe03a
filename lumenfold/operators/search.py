"""Ranking and retrieval: BM25, exact vectors, fusion, regular expressions, grep, paging."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenfold.functions import text as fn
from lumenfold.sources.files import glob_pattern
from lumenfold.sources.store import cut, spread

K1, B, RRF_K = 1.5, 0.75, 60


def query_terms(query: str) -> list[str]:
    return list(dict.fromkeys(t.lower() for t in re.findall(fn.TOKEN, query)))


def postings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, tok, tf): what a stored index holds, by token."""
    toks = spread(docs.select(key, text)).select(key, F.explode(fn.tokens(text)).alias("t"))
    return toks.groupBy(key, F.lower("t").alias("tok")).agg(F.count("*").alias("tf"))


#: Distinct tokens that a task counts before it gives them on.
COUNTED = 1 << 17


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df, cf, token = Counter(), Counter(), re.compile(fn.TOKEN)

    def packed() -> pa.RecordBatch:
        # a token as it is spelt tells how often it occurs, in lower case also how many texts hold it
        seen = [(x.lower(), 0, n) for x, n in cf.items()] + [(x, n, 0) for x, n in df.items()]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*seen, strict=True), (pa.string(), pa.int64(), pa.int64()), strict=True)], ["tok", "df", "cf"])

    for batch in batches:
        for text in batch.column("text"):
            toks = token.findall(text.as_py() or "")
            cf.update(toks)
            df.update({x.lower() for x in set(toks)})
            if len(cf) >= COUNTED:
                yield packed()
                df.clear()
                cf.clear()
    if cf:
        yield packed()


def terms(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(tok, df, cf): how many keys hold each token, and how often it occurs; no posting is a row.

    Texts are counted where they lie. Rows that share a key are one document, and go by their postings.
    """
    shared = cut(docs.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("n")).where("n > 1").select("_key"))
    once, counted = docs, None
    if not shared.isEmpty():
        same = F.col(key).eqNullSafe(F.col("_key"))
        once = docs.join(shared, same, "left_anti")
        counted = postings(docs.join(shared, same, "left_semi"), key, text).groupBy("tok").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
    parts = spread(once.select(F.col(text).cast("string").alias("text"))).mapInArrow(_count_terms, "tok string, df long, cf long")
    parts = parts if counted is None else parts.unionByName(counted)
    return parts.groupBy("tok").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))


def bm25_score(tf, df, n: float, length, average: float) -> Column:
    idf = F.ln((n - df + 0.5) / (df + 0.5) + 1)
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / average))


def _count_of(array: str, value: str) -> Column:
    return F.size(F.filter(array, lambda x: x == value))


def bm25(docs: DataFrame, query: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score) of every document with a query token, from texts alone.

    Each text is cut into tokens once, and a row of its length and its counts of the query's tokens is
    all that goes on: no token is a row, and nothing is shuffled but the sums. To search often, keep
    the postings instead (indexes.KeywordIndex).
    """
    terms = query_terms(query)
    toks = spread(docs.select(key, text)).select(key, fn.lower_tokens(text).alias("toks"))
    rows = cut(toks.select(key, F.size("toks").alias("dl"), *[_count_of("toks", t).alias(f"tf{i}") for i, t in enumerate(terms)]))
    stats = rows.agg(F.count("*").alias("n"), F.sum(F.greatest("dl", F.lit(0))).alias("dl"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))]).first()
    average = (stats.dl or 0) / max(1, stats.n)
    parts = [F.when(F.col(f"tf{i}") > 0, bm25_score(F.col(f"tf{i}"), F.lit(float(stats[f"df{i}"])), float(stats.n), F.col("dl"), average)).otherwise(0.0) for i in range(len(terms))]
    some = F.greatest(F.lit(0), F.lit(0), *[F.col(f"tf{i}") for i in range(len(terms))]) > 0
    return rows.where(some).select(key, sum(parts, F.lit(0.0)).alias("score"))


def top(ranked: DataFrame, k: int, key: str = "doc_id") -> DataFrame:
    return ranked.orderBy(F.desc("score"), key).limit(k)


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(fn.c(a), fn.c(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def vector_top(vectors: DataFrame, query: list[float], k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    q = F.array(*[F.lit(float(x)) for x in query])
    return top(vectors.select(key, dot(vector, q).alias("score")), k, key)


#: Bytes of queries that are sent to every task; components that a task holds of either side beyond it; entries of one matrix product.
SENT, HELD, TILE = 1 << 26, 1 << 22, 1 << 22


def _best(ids: np.ndarray, q: np.ndarray, own: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score): the k best other rows for each query, ties to the smaller id; a product of a part of the queries at a time."""
    order = np.argsort(own, kind="stable")
    own, x = own[order], x[order]
    step, out = max(1, TILE // max(1, len(own))), []
    for at in range(0, len(ids), step):
        s = q[at : at + step] @ x.T
        s[np.isnan(s) | (own[None, :] == ids[at : at + step, None])] = -np.inf
        least = np.partition(s, -k, axis=1)[:, -k] if s.shape[1] > k else np.full(len(s), -np.inf)
        r, c = np.nonzero((s >= least[:, None]) & (s > -np.inf))
        v = s[r, c]
        order = np.lexsort((c, -v, r))
        r, c, v = r[order], c[order], v[order]
        keep = np.arange(len(r)) - np.searchsorted(r, r) < k
        out.append((ids[at + r[keep]], own[c[keep]], v[keep]))
    return tuple(np.concatenate(part) for part in zip(*out, strict=True)) if out else (ids[:0], own[:0], np.zeros(0))


def vector_top_batch(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", sent: int = SENT) -> DataFrame:
    """(query_id, key, score): the k best other rows for each query; null vectors take no part.

    Up to `sent` bytes of queries go to every task and rows stay where they are. Of more, blocks of queries meet shards of rows, of
    HELD components each, so a task's memory is bounded by neither table. Each task keeps its k best for each query.
    """
    able = lambda t: t.where(F.col(vector).isNotNull()).select(key, vector)
    rows, asked = able(vectors), able(queries)
    kind = vectors.schema[key].dataType.simpleString()
    schema = f"query_id {kind}, {key} {kind}, score double"
    stack = lambda v: np.array([np.asarray(x, np.float64) for x in v])
    frame = lambda found: pd.DataFrame(dict(zip(("query_id", key, "score"), found, strict=True)))
    n, width = asked.agg(F.count("*"), F.coalesce(F.max(F.size(vector)), F.lit(1))).first()
    if n * width * 8 <= sent:
        held = asked.collect()
        ids, q = np.array([r[0] for r in held]), stack([r[1] for r in held])

        def run(batches):
            for pdf in batches:
                if len(pdf) and len(ids):
                    yield frame(_best(ids, q, pdf[key].to_numpy(), stack(pdf[vector]), k))

        found = rows.mapInPandas(run, schema)
    else:
        shards, blocks = (max(1, -(-m * width // HELD)) for m in (rows.count(), n))
        deal = lambda m: F.pmod(F.xxhash64(key), F.lit(m)).cast("int")
        every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
        a = rows.select("*", deal(shards).alias("_shard"), every(blocks).alias("_block"))
        b = asked.select("*", every(shards).alias("_shard"), deal(blocks).alias("_block"))

        def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            if not len(left) or not len(right):
                return frame(([], [], []))
            return frame(_best(right[key].to_numpy(), stack(right[vector]), left[key].to_numpy(), stack(left[vector]), k))

        found = a.groupBy("_shard", "_block").cogroup(b.groupBy("_shard", "_block")).applyInPandas(meet, schema)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return found.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).drop("r")


def rrf(left: DataFrame, right: DataFrame, key: str = "doc_id") -> DataFrame:
    """Fuses two rankings (key, rank from 0)."""
    part = lambda r: F.when(r.isNotNull(), 1 / (F.lit(RRF_K) + r + 1)).otherwise(0.0)
    both = left.select(key, F.col("rank").alias("ra")).join(right.select(key, F.col("rank").alias("rb")), key, "full_outer")
    return both.select(key, (part(F.col("ra")) + part(F.col("rb"))).alias("score"))


def ranked(scored: DataFrame, key: str = "doc_id") -> DataFrame:
    """Adds rank from 0; meant for a short list."""
    return scored.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), key)) - 1)


def line_rows(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, line_number from 1, line)."""
    return docs.select(key, F.posexplode(fn.lines(text)).alias("p", "line")).select(key, (F.col("p") + 1).alias("line_number"), "line")


def valid_pattern(spark: SparkSession, pattern: str) -> bool:
    """Whether the engine that will run the pattern takes it."""
    try:
        spark._jvm.java.util.regex.Pattern.compile(pattern)
    except Exception:  # noqa: BLE001  the gateway's error type depends on the connection
        return False
    return True


def regex_search(docs: DataFrame, pattern: str, k: int, insensitive: bool = True, key: str = "doc_id", text: str = "text", first: str | None = None) -> DataFrame:
    """(key, score, matched_lines): documents by their number of matching lines; no row for an invalid pattern.

    Lines count from 1, or in a chunk from the column first, the chunk's first line in its file. Matches are
    counted inside each row, so no line is a row of its own.
    """
    p = ("(?i)" if insensitive else "") + pattern
    start = F.col(first) if first else F.lit(1)
    rows = spread(docs.select(key, text, start.cast("int").alias("start"))).select(key, fn.lines(text).alias("lines"), "start")
    rows = rows if valid_pattern(docs.sparkSession, p) else rows.where("false")
    hits = F.filter(F.transform("lines", lambda x, i: F.when(x.rlike(p), i)), lambda i: i.isNotNull())
    found = rows.select(key, F.transform(hits, lambda i: i + F.col("start")).alias("matched_lines"), "start")
    return top(found.where(F.size("matched_lines") > 0).select(key, F.size("matched_lines").cast("long").alias("score"), "matched_lines"), k, key)


def grep(docs: DataFrame, pattern: str, invert: bool = False, word: bool = False, before: int = 0, after: int = 0, key: str = "doc_id", text: str = "text", insensitive: bool = False, limit: int | None = None, per_key: int | None = None) -> DataFrame:
    """(key, line_number, line, col, is_context), each line once, no row for an invalid pattern.

    Hits and their context are found inside each row; only these lines become rows. per_key keeps the first
    matching lines of each document, limit the first lines of all.
    """
    p = ("(?i)" if insensitive else "") + (rf"(?<![A-Za-z0-9_])(?:{pattern})(?![A-Za-z0-9_])" if word else pattern)
    docs = docs if valid_pattern(docs.sparkSession, p) else docs.where("false")
    hit = lambda x: ~x.rlike(p) if invert else x.rlike(p)
    rows = spread(docs.select(key, text)).select(key, fn.lines(text).alias("lines"))
    rows = rows.select(key, "lines", F.filter(F.transform("lines", lambda x, i: F.when(hit(x), i)), lambda i: i.isNotNull()).alias("hits")).where(F.size("hits") > 0)
    if per_key is not None:
        rows = rows.withColumn("hits", F.slice("hits", 1, per_key))
    shown = F.col("hits")
    if before or after:
        near = F.transform("hits", lambda i: F.sequence(F.greatest(F.lit(0), i - before), F.least(F.size("lines") - 1, i + after)))
        shown = F.array_sort(F.array_distinct(F.flatten(near)))
    rows = rows.select(key, "hits", "lines", F.explode(shown).alias("i"))
    out = rows.select(key, (F.col("i") + 1).alias("line_number"), F.element_at("lines", F.col("i") + 1).alias("line"), (~F.array_contains("hits", F.col("i"))).alias("is_context"))
    out = out.select(key, "line_number", "line", F.when(~F.col("is_context"), F.greatest(F.lit(0), F.regexp_instr("line", F.lit(p)) - 1)).alias("col"), "is_context")
    return out if limit is None else out.orderBy(key, "line_number").limit(limit)


def grep_matches(docs: DataFrame, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, line_number, ord, match): one row for each match in a line."""
    rows = line_rows(docs, key, text).where(F.col("line").rlike(pattern))
    return rows.select(key, "line_number", F.posexplode(F.regexp_extract_all("line", F.lit(pattern), 0)).alias("ord", "match"))


def grep_counts(docs: DataFrame, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    return grep(docs, pattern, key=key, text=text).groupBy(key).agg(F.count("*").alias("n"))


def without_match(docs: DataFrame, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    return docs.select(key).join(grep(docs, pattern, key=key, text=text).select(key).distinct(), key, "left_anti")


def with_match(docs: DataFrame, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    return grep(docs, pattern, key=key, text=text).select(key).distinct()


def shown(results: DataFrame, exclude: str | None = None, snippet: int | None = None, path: str = "file_path", text: str = "content") -> DataFrame:
    """Results without those whose path fits a glob, texts cut to a snippet."""
    out = results if exclude is None else results.where(~F.col(path).rlike(glob_pattern(exclude)))
    return out if snippet is None else out.withColumn(text, F.substring(text, 1, snippet))


def multi_retrieve(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of first, and those of second that first does not have."""
    return first.withColumn("arm", F.lit(0)).unionByName(second.join(first.select(*keys), keys, "left_anti").withColumn("arm", F.lit(1)))


def boost_language(results: DataFrame, language: str | None, factor: float = 1.5, column: str = "lang") -> DataFrame:
    return results if not language else results.withColumn("score", F.when(F.col(column) == language, F.col("score") * factor).otherwise(F.col("score")))


def merge_repositories(scored: DataFrame, k: int, repo: str, key: str, threshold: float | None = None) -> DataFrame:
    """The k best of each repository, then the k best of all."""
    rows = scored if threshold is None else scored.where(F.col("score") >= threshold)
    own = F.row_number().over(Window.partitionBy(repo).orderBy(F.desc("score"), key))
    return top(rows.withColumn("r", own).where(F.col("r") <= k).drop("r"), k, key)


def page(results: DataFrame, offset: int, size: int, *order) -> DataFrame:
    return results.orderBy(*order).offset(offset).limit(size)


def threshold_after_top(scored: DataFrame, k: int, least: float, key: str) -> DataFrame:
    return top(scored, k, key).where(F.col("score") >= least)


def context_lines(docs: DataFrame, spans: DataFrame, around: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Text of each span (key, start_line, end_line) with `around` lines on both sides."""
    first = F.greatest(F.lit(1), F.col("start_line") - around)
    body = F.array_join(F.slice(fn.lines(text), first, F.col("end_line") + around - first + 1), "\n")
    return spans.join(docs.select(key, text), key).select(*spans.columns, body.alias("expanded"), first.alias("first_line"))


def expand_sections(chunks: DataFrame, symbols: DataFrame) -> DataFrame:
    """The tightest symbol that contains each chunk (file_path, start_line, end_line, ord); the chunk itself if there is none."""
    s = symbols.select("file_path", F.col("start_line").alias("s"), F.col("end_line").alias("e"), "name")
    both = chunks.join(s, "file_path", "left").where("s is null or (s <= start_line and e >= end_line)")
    alone = chunks.join(both.select("ord"), "ord", "left_anti").withColumns({"s": F.lit(None).cast("int"), "e": F.lit(None).cast("int"), "name": F.lit(None).cast("string")})
    best = both.unionByName(alone).groupBy("ord").agg(F.min(F.struct((F.col("e") - F.col("s")).alias("span"), "s", "e", "name", "file_path", "start_line", "end_line")).alias("x"))
    out = best.select("ord", "x.file_path", F.coalesce("x.s", "x.start_line").alias("start_line"), F.coalesce("x.e", "x.end_line").alias("end_line"), "x.name")
    return out.groupBy("file_path", "start_line", "end_line").agg(F.min(F.struct("ord", "name")).alias("x")).select("file_path", "start_line", "end_line", "x.ord", "x.name")
