"""What users and agents leave behind: query history, memories, sessions, cached answers, request limits."""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenfold.functions import text as fn
from lumenfold.operators import relations as rel
from lumenfold.operators.quantiles import order_statistics
from lumenfold.sources.store import Tables, cut

# How many queries, memories and answers are kept, and how long answers and sessions live.
QUERIES_KEPT, MEMORIES_KEPT, ANSWERS_KEPT = 500, 200, 500
ANSWER_SECONDS, SESSION_SECONDS, LIMIT_SECONDS = 86_400.0, 3_600.0, 60.0
QUERY = "query string, ts double, result_count int, top_score double, languages array<string>, top_files array<string>"
ENTRY = "key string, content string, kind string, ts double"
ANSWER = "key string, response string, ts double"
#: Requests of one task, and rounds in which all parts that differ are done anew.
REQUESTS_A_TASK, ROUNDS = 1 << 16, 3
MESSAGE = "session_id string, ord int, role string, content string, ts double"


# ----------------------------------------------------------------- queries
def query_record(results: DataFrame, query: str, now: float) -> DataFrame:
    """The history's row for ranked results (rank, score, file_path, language): distinct languages in order, the first five distinct files."""
    files = F.transform(F.sort_array(F.collect_list(F.struct("rank", "file_path"))), lambda x: x["file_path"])
    langs = F.sort_array(F.collect_set("language"))
    return results.agg(F.lit(query).alias("query"), F.lit(now).alias("ts"), F.count("*").cast("int").alias("result_count"), F.coalesce(F.max("score"), F.lit(0.0)).alias("top_score"), langs.alias("languages"), F.slice(F.array_distinct(files), 1, 5).alias("top_files"))


def popular(rows: DataFrame, what: str, n: int = 10, ts: str = "ts") -> DataFrame:
    """The n most frequent values; of equally frequent ones the earliest first."""
    return rows.groupBy(what).agg(F.count("*").alias("n"), F.min(ts).alias("_first")).orderBy(F.desc("n"), "_first", what).limit(n).drop("_first")


def popular_files(history: DataFrame, n: int = 10) -> DataFrame:
    return popular(history.select("ts", F.explode("top_files").alias("file_path")), "file_path", n)


def average_results(history: DataFrame) -> DataFrame:
    return history.agg(F.coalesce(F.avg("result_count"), F.lit(0.0)).alias("avg_result_count"))


class QueryHistory:
    """The last QUERIES_KEPT queries."""

    def __init__(self, spark: SparkSession, root: str):
        self.tables, self.spark = Tables(spark, root), spark

    def load(self) -> DataFrame:
        held = self.tables.load("history")
        return self.spark.createDataFrame([], QUERY) if held is None else held

    def record(self, row: DataFrame) -> DataFrame:
        return self.tables.save("history", rel.newest(self.load().unionByName(row), QUERIES_KEPT, F.desc("ts")))

    def recent(self, n: int = 10) -> DataFrame:
        return rel.newest(self.load(), n, F.desc("ts")).orderBy("ts")


# ----------------------------------------------------------------- memories
def search_memory(entries: DataFrame, query: str, n: int = 5, newest: bool = True) -> DataFrame:
    """Entries whose key or content holds the query, whatever its case: the n newest, or the n first."""
    q = F.lit(query.lower())
    hits = entries.where(F.contains(F.lower("content"), q) | F.contains(F.lower("key"), q))
    return hits.orderBy(F.desc("ts") if newest else F.col("ts"), "key").limit(n).orderBy("ts", "key")


def numbered_steps(steps: DataFrame) -> DataFrame:
    """steps (chain_id, ts, ...) with step_id, the place in the chain from 1."""
    return steps.withColumn("step_id", F.row_number().over(Window.partitionBy("chain_id").orderBy("ts")))


class Memory:
    """Entries by key. A workspace keeps the last of each key; a session keeps the last MEMORIES_KEPT of all."""

    def __init__(self, spark: SparkSession, root: str, name: str = "memory", by_key: bool = True):
        self.tables, self.spark, self.name, self.by_key = Tables(spark, root), spark, name, by_key

    def load(self) -> DataFrame:
        held = self.tables.load(self.name)
        return self.spark.createDataFrame([], ENTRY) if held is None else held

    def add(self, key: str, content: str, now: float, kind: str = "general") -> DataFrame:
        row = self.spark.createDataFrame([(key, content, kind, now)], ENTRY)
        if self.by_key:
            return self.tables.upsert(self.name, row, "key")
        return self.tables.save(self.name, rel.newest(self.load().unionByName(row), MEMORIES_KEPT, F.desc("ts")))

    def get(self, key: str) -> DataFrame:
        return self.load().where(F.col("key") == key)

    def recent(self, n: int = 10) -> DataFrame:
        return rel.newest(self.load(), n, F.desc("ts")).orderBy("ts")

    def search(self, query: str, n: int = 5) -> DataFrame:
        return search_memory(self.load(), query, n, newest=not self.by_key)


# ----------------------------------------------------------------- conversations
def for_model(messages: DataFrame, turns: int, by: str = "conv_id", order: str = "turn") -> DataFrame:
    """All system messages, and the last 2 * turns others of each conversation."""
    rest = rel.newest(messages.where("role <> 'system'"), 2 * turns, F.desc(order), by=[by])
    return messages.where("role = 'system'").unionByName(rest)


def turn_counts(messages: DataFrame, by: str = "conv_id") -> DataFrame:
    return messages.groupBy(by).agg(F.count_if(F.col("role").isin("user", "assistant")).alias("turns"))


class Conversations:
    """Messages of chat sessions."""

    def __init__(self, spark: SparkSession, root: str):
        self.tables, self.spark = Tables(spark, root), spark

    def _all(self) -> DataFrame:
        held = self.tables.load("messages")
        return self.spark.createDataFrame([], MESSAGE) if held is None else held

    def save(self, messages: DataFrame) -> DataFrame:
        """Messages (MESSAGE) replace those of their sessions."""
        return self.tables.upsert("messages", messages, "session_id")

    def load(self, session: str) -> DataFrame:
        return self._all().where(F.col("session_id") == session).orderBy("ord")

    def delete(self, session: str) -> bool:
        return self.tables.remove("messages", F.col("session_id") == session) > 0

    def sessions(self) -> DataFrame:
        """(session_id, messages, updated_at), newest first."""
        return self._all().groupBy("session_id").agg(F.count("*").alias("messages"), F.max("ts").alias("updated_at")).orderBy(F.desc("updated_at"), "session_id")


def active_sessions(touches: DataFrame, now: float, ttl: float = SESSION_SECONDS) -> DataFrame:
    """(session_id, last_active, searches) of sessions touched within the time to live; at exactly its end a session lives."""
    rows = touches.groupBy("session_id").agg(F.max("ts").alias("last_active"), F.count_if(F.col("query").isNotNull()).alias("searches"))
    return rows.where(F.col("last_active") >= now - ttl)


def shared_discoveries(discoveries: DataFrame, exclude: str | None = None) -> DataFrame:
    """The last write of each key (key, session_id, data, ts), without those of one session."""
    last = discoveries.groupBy("key").agg(F.max_by(F.struct("session_id", "data", "ts"), "ts").alias("x")).select("key", "x.*")
    return last if exclude is None else last.where(F.col("session_id") != exclude)


def session_report(touches: DataFrame, discoveries: DataFrame) -> DataFrame:
    """(session_id, searches, symbols): searches made and distinct things found."""
    a = touches.groupBy("session_id").agg(F.count_if(F.col("query").isNotNull()).alias("searches"))
    b = discoveries.groupBy("session_id").agg(F.countDistinct("key").alias("symbols"))
    return a.join(b, "session_id", "full_outer").fillna(0)


# ----------------------------------------------------------------- answers
class AnswerCache:
    """Answers by request key (functions.text.request_key); they live ANSWER_SECONDS, the last ANSWERS_KEPT stay."""

    def __init__(self, spark: SparkSession, root: str, ttl: float = ANSWER_SECONDS, most: int = ANSWERS_KEPT):
        self.tables, self.spark, self.ttl, self.most = Tables(spark, root), spark, ttl, most
        self.hits = self.misses = 0

    def load(self, now: float) -> DataFrame:
        held = self.tables.load("answers")
        return self.spark.createDataFrame([], ANSWER) if held is None else held.where(F.lit(now) - F.col("ts") <= self.ttl)

    def get(self, key: str, now: float) -> str | None:
        row = self.load(now).where(F.col("key") == key).first()
        self.hits, self.misses = self.hits + (row is not None), self.misses + (row is None)
        return None if row is None else row.response

    def put(self, key: str, response: str, now: float) -> DataFrame:
        row = self.spark.createDataFrame([(key, response, now)], ANSWER)
        return self.tables.save("answers", rel.newest(self.load(now).where(F.col("key") != key).unionByName(row), self.most, F.desc("ts")))

    def hit_rate(self) -> float:
        return 100.0 * self.hits / (self.hits + self.misses) if self.hits + self.misses else 0.0


def cache_hits(requests: DataFrame, keys: list[str], ts: str = "ts", hours: int = 24, order: tuple[str, ...] = ()) -> DataFrame:
    """requests with hit: whether the same request came within the time to live before."""
    last = F.lag(ts).over(Window.partitionBy(*keys).orderBy(ts, *order))
    return requests.withColumn("hit", F.coalesce(F.col(ts) <= last + F.expr(f"interval {hours} hours"), F.lit(False)))


# ----------------------------------------------------------------- limits
def usage(requests: DataFrame, who: str, ts: str, tokens: str | None = None, seconds: float = LIMIT_SECONDS) -> DataFrame:
    """requests with n and, with tokens, total: what the window of less than `seconds` up to each holds."""
    w = Window.partitionBy(who).orderBy(F.unix_micros(F.col(ts).cast("timestamp"))).rangeBetween(1 - int(seconds * 1e6), 0)
    out = requests.withColumn("n", F.count("*").over(w))
    return out if tokens is None else out.withColumn("total", F.sum(tokens).over(w))


def admit(stamps: list[float], tokens: list[int], rpm: int = 0, tpm: int = 0, seconds: float = LIMIT_SECONDS, held: list[tuple[float, int]] = ()) -> tuple[list[tuple[bool, float]], list[tuple[float, int]]]:
    """(admitted, retry_after) of requests in order of time, and the admitted ones of the last window.

    One is admitted if the requests and tokens admitted within the window before it, at first those of held, leave room;
    a limit of 0 is none.
    """
    held, out = deque(held), []
    total = sum(x[1] for x in held)
    for t, n in zip(stamps, tokens, strict=True):
        while held and held[0][0] <= t - seconds:
            total -= held.popleft()[1]
        ok = (rpm <= 0 or len(held) < rpm) and (tpm <= 0 or total + n <= tpm)
        out.append((ok, 0.0 if ok else max(seconds - (t - held[0][0]), 0.1) if held else 0.1))
        if ok:
            held.append((t, n))
            total += n
    return out, list(held)


ADMITTED = "who {0}, id {1}, ts double, admitted boolean, retry_after double"


def request_rows(requests: DataFrame, who: str) -> DataFrame:
    """(who, id, ts, tokens) of requests; no tokens are 0."""
    return requests.select(F.col(who).alias("who"), "id", F.col("ts").cast("double").alias("ts"), F.coalesce(F.col("tokens").cast("long"), F.lit(0)).alias("tokens"))


def admitted_schema(rows: DataFrame) -> str:
    return ADMITTED.format(*(rows.schema[c].dataType.simpleString() for c in ("who", "id")))


def _part(pdf: pd.DataFrame, held: list[tuple[float, int]], rpm: int, tpm: int, seconds: float) -> tuple[pd.DataFrame, list[tuple[float, int]]]:
    """What is admitted of a part of the requests in order, whose first caller comes with what it holds; and what its last caller holds at the end."""
    pdf = pdf.sort_values("n")
    # requests of one caller stand side by side
    first = pdf["first"].to_numpy(bool)
    starts = [k for k in range(len(pdf)) if first[k] or k == 0] + [len(pdf)]
    stamps, tokens = pdf["ts"].tolist(), pdf["tokens"].tolist()
    got: list[tuple[bool, float]] = []
    for k, (i, j) in enumerate(zip(starts, starts[1:], strict=False)):
        one, rest = admit(stamps[i:j], tokens[i:j], rpm, tpm, seconds, () if k or first[i] else held)
        got.extend(one)
    return pd.DataFrame({"who": pdf["who"], "id": pdf["id"], "ts": pdf["ts"], "admitted": [ok for ok, _ in got], "retry_after": [w for _, w in got]}), rest


def admitted(requests: DataFrame, who: str, rpm: int = 0, tpm: int = 0, seconds: float = LIMIT_SECONDS, part: int = REQUESTS_A_TASK) -> DataFrame:
    """(who, id, ts, admitted, retry_after) of requests (who, id, ts double, tokens long), each caller in order of ts, then id.

    The requests are laid out in this order in parts of about `part`, so one caller's may be many tasks. What a caller holds at the
    end of a part is what it brings to the next. At first every part begins with nothing held; a part that was given other than
    the one before it leaves is done anew, until none is. After a pause of the window, and mostly far sooner, what was held
    before makes no difference, so a few rounds do; where it goes on to make one, parts of a caller follow one another, each done
    once more. A request without a time isn't admitted and holds nothing. The driver holds what each part leaves: at most rpm
    requests, or tpm of one token.
    """
    rows = request_rows(requests, who)
    schema, timed = admitted_schema(rows), rows.where("ts is not null and not isnan(ts)")
    untimed = rows.where("ts is null or isnan(ts)").select("who", "id", "ts", F.lit(False).alias("admitted"), F.lit(None).cast("double").alias("retry_after"))
    parts = max(1, -(-timed.count() // part))
    placed = timed.repartitionByRange(parts, "who", "ts", "id").sortWithinPartitions("who", "ts", "id")
    laid = cut(placed.withColumns({"part": F.spark_partition_id(), "n": F.monotonically_increasing_id()}))
    ends = laid.groupBy("part").agg(F.min_by(F.struct("who"), "n").alias("a"), F.max_by(F.struct("who"), "n").alias("b")).orderBy("part").collect()
    goes_on = {q.part: p.part for p, q in zip(ends, ends[1:], strict=False) if p.b == q.a}  # a part that begins with its predecessor's last caller
    # a caller's first request in the order
    w = Window.partitionBy("part").orderBy("n")
    before = F.lag(F.struct("who")).over(w)
    laid = laid.withColumn("first", F.when(F.row_number().over(w) == 1, ~F.col("part").isin(list(goes_on))).otherwise(~before.eqNullSafe(F.struct("who"))))
    given: dict[int, list] = {}
    left: dict[int, list] = {}

    def leaves(held: dict[int, list]):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            at = int(pdf["part"].iloc[0])
            rest = _part(pdf, held.get(at, []), rpm, tpm, seconds)[1]
            return pd.DataFrame({"part": [at], "ts": [[float(t) for t, _ in rest]], "tokens": [[int(n) for _, n in rest]]})

        return run

    # what only the last part of a caller leaves is asked by none
    todo, rounds = sorted(set(goes_on.values())), 0
    while todo:
        found = laid.where(F.col("part").isin(todo)).groupBy("part").applyInPandas(leaves({p: given.get(p, []) for p in todo}), "part int, ts array<double>, tokens array<long>")
        left |= {r.part: list(zip(r.ts, r.tokens, strict=True)) for r in found.collect()}
        rounds += 1
        other = [p for p in goes_on if left[goes_on[p]] != given.get(p, [])]
        if rounds > ROUNDS:
            other = [p for p in other if goes_on[p] not in other]  # those whose predecessor is settled
        given |= {p: left[goes_on[p]] for p in other}
        todo = sorted(set(other) & set(goes_on.values()))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return _part(pdf, given.get(int(pdf["part"].iloc[0]), []), rpm, tpm, seconds)[0]

    return laid.groupBy("part").applyInPandas(run, schema).unionByName(untimed)


def latency_report(runs: DataFrame, by: str = "mode", ms: str = "ms") -> DataFrame:
    """Mean, median and 99th percentile (the value at place int(n * p)) of latencies, and queries a second."""
    sums = runs.groupBy(F.col(by).alias("_by")).agg(F.avg(ms).alias("avg"), F.sum(ms).alias("_sum"))
    found = order_statistics(runs, [by], ms, {"p50": 0.5, "p99": 0.99}).join(sums, F.col(by).eqNullSafe(F.col("_by")))
    return found.select(by, "avg", "p50", "p99", F.try_divide(F.col("n") * 1000, F.col("_sum")).alias("qps"))


def citation_footer(citations: DataFrame) -> DataFrame:
    """The sources (cite_id, file_path, start_line, end_line) of an answer as one text."""
    line = F.concat(F.lit("  "), fn.citation("cite_id", "file_path", "start_line", "end_line"))
    rows = F.transform(F.sort_array(F.collect_list(F.struct("cite_id", line.alias("line")))), lambda x: x["line"])
    return citations.agg(F.when(F.count("*") > 0, F.concat(F.lit("\nSources:\n"), F.array_join(rows, "\n"))).otherwise("").alias("text"))
