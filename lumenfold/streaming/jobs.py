"""Continuous twins of the batch operators."""

from __future__ import annotations

import hashlib
import math
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from lumenfold.operators import history
from lumenfold.operators import relations as rel
from lumenfold.operators.indexes import DigestStore
from lumenfold.sources.store import Log, children, cut


# ----------------------------------------------------------------- sources
def watch(spark: SparkSession, folder: str, schema: str, files_a_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(folder)


def watch_files(spark: SparkSession, folder: str, extensions: list[str]) -> DataFrame:
    """(path, modified, content) of new files with these extensions; folders and files that begin with a dot are passed over."""
    raw = spark.readStream.format("binaryFile").schema(spark.read.format("binaryFile").load(folder).schema if children(spark, folder) else "path string, modificationTime timestamp, length long, content binary")
    df = raw.option("recursiveFileLookup", True).load(folder)
    ext = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    return df.where(ext.isin([e.lower() for e in extensions]) & ~F.col("path").rlike(r"/\.[^/]+")).select("path", F.col("modificationTime").alias("modified"), F.decode("content", "UTF-8").alias("content"))


class Poller:
    """Changes of a table of digests between scans; the first scan is the baseline and reports none."""

    def __init__(self, spark: SparkSession, root: str, scan: Callable[[], DataFrame]):
        self.store, self.scan = DigestStore(spark, root, "seen"), scan

    def once(self) -> DataFrame:
        """(key, change) since the last scan; scan() gives (key, content_hash)."""
        first = self.store.tables.load("seen") is None
        old, new = self.store.load(), cut(self.scan().select("key", "content_hash"))
        found = cut(rel.changes(new if first else old, new, "key"))
        self.store.save(new)
        return found

    def loop(self, sink: Callable[[DataFrame], None], seconds: float = 2.0, rounds: int | None = None) -> None:
        n = 0
        while rounds is None or n < rounds:
            found = self.once()
            if not found.isEmpty():
                sink(found)
            n += 1
            if rounds is None or n < rounds:
                time.sleep(seconds)


# ----------------------------------------------------------------- sinks
def keep_index(changes: DataFrame, store: str, key: str, checkpoint: str) -> StreamingQuery:
    """Adds each micro-batch (key, ..., deleted boolean) to a log of batches, whose last word on a key counts.

    A batch is named by its stream and number, so however often it is repeated it is added once. What is written is the batch,
    and now and then a merge of young runs.
    """
    source = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]

    def merge(batch: DataFrame, n: int) -> None:
        log = Log(batch.sparkSession, store, key)
        if log.append(batch, source, n):
            log.compact()

    return changes.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_index(spark: SparkSession, store: str, key: str) -> DataFrame:
    return Log(spark, store, key).read()


def run_once(df: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    q = df.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def status(query: StreamingQuery) -> dict:
    """What a running index does: whether it runs, batches done and rows in the last one."""
    last = query.lastProgress
    return {"running": query.isActive, "waiting": query.status["isDataAvailable"], "completed": (last.batchId + 1) if last else 0, "events": last.numInputRows if last else 0}


# ----------------------------------------------------------------- windows and state
def session_counts(events: DataFrame, who: str, ts: str, ttl: str = "1 hour", late: str = "1 hour") -> DataFrame:
    stamped = events.withColumn("at", F.col(ts).cast("timestamp")).withWatermark("at", late)
    return stamped.groupBy(who, F.session_window("at", ttl).alias("w")).agg(F.count("*").alias("n")).select(who, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def rate(events: DataFrame, who: str, ts: str, tokens: str, window: str = "60 seconds", slide: str = "10 seconds", late: str = "60 seconds") -> DataFrame:
    stamped = events.withColumn("at", F.col(ts).cast("timestamp")).withWatermark("at", late)
    return stamped.groupBy(who, F.window("at", window, slide).alias("w")).agg(F.count("*").alias("requests"), F.sum(tokens).alias("tokens")).select(who, F.col("w.end").alias("at"), "requests", "tokens")


#: Seconds that event times are moved on by, as a stream takes times up to 1970 for late before its first row.
SHIFT = 86_400


class Admission(StatefulProcessor):
    """Holds each caller's admitted requests of the last window, and forgets a caller whose window has passed."""

    def __init__(self, rpm: int, tpm: int, seconds: float):
        self.rpm, self.tpm, self.seconds = rpm, tpm, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "ts double, tokens long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = pd.concat(list(rows)).sort_values(["ts", "id"], kind="stable")
        held = [(float(t), int(n)) for t, n in self.held.get()]
        got, held = history.admit(new["ts"].tolist(), new["tokens"].tolist(), self.rpm, self.tpm, self.seconds, held)
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        if held:
            self.held.put([(float(t), int(n)) for t, n in held])
            self.handle.registerTimer(math.ceil((held[-1][0] + self.seconds + SHIFT) * 1000))
        else:
            self.held.clear()
        yield pd.DataFrame({"who": [key[0]] * len(new), "id": new["id"].tolist(), "ts": new["ts"].tolist(), "admitted": [ok for ok, _ in got], "retry_after": [w for _, w in got]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.held.clear()
        yield pd.DataFrame()

    def close(self) -> None:
        pass


def admissions(requests: DataFrame, who: str, rpm: int = 0, tpm: int = 0, seconds: float = history.LIMIT_SECONDS, late: str = "60 seconds") -> DataFrame:
    """(who, id, ts, admitted, retry_after) of a stream of requests (who, id, ts double, tokens long).

    A request counts against the limits only if it was admitted. State holds the admitted requests of a caller's last window, no
    more than the limits let in; once the watermark has passed that window, a timer drops the caller. Requests later than `late`
    behind the newest, those without a time and those of a day or more before 1970 are left out. The session's streams keep state in RocksDB from then on, which
    timers need.
    """
    requests.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = history.request_rows(requests, who)
    stamped = rows.where("ts is not null and not isnan(ts)").withColumn("at", F.timestamp_micros(((F.col("ts") + SHIFT) * 1_000_000).cast("long"))).withWatermark("at", late)
    return stamped.groupBy("who").transformWithStateInPandas(Admission(rpm, tpm, seconds), history.admitted_schema(rows), "append", "eventTime")


# ----------------------------------------------------------------- answers as events
def token_events(answers: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """(key, ord, kind, content): start, one event a word with its leading blank, done with the whole text; for batches and streams."""
    words = F.transform(F.split(text, " "), lambda w, i: F.struct(F.lit("token").alias("kind"), F.when(i > 0, F.concat(F.lit(" "), w)).otherwise(w).alias("content")))
    ends = lambda kind, x: F.array(F.struct(F.lit(kind).alias("kind"), x.alias("content")))
    every = F.concat(ends("start", F.lit("")), words, ends("done", F.col(text)))
    return answers.select(key, F.posexplode(every).alias("ord", "x")).select(key, "ord", "x.kind", "x.content")


def context_events(context: DataFrame, answers: DataFrame, key: str = "id") -> DataFrame:
    """Events with the context (key, content) first, numbered on."""
    first = context.select(key, F.lit(-1).alias("ord"), F.lit("context").alias("kind"), "content")
    out = first.unionByName(token_events(answers, key).where("kind <> 'start'"))
    return out.withColumn("ord", F.col("ord") + 1)


def latest_documents(changes: DataFrame) -> DataFrame:
    """The text of each open document from its open, change and close events (uri, version, event, text)."""
    last = changes.groupBy("uri").agg(F.max_by(F.struct("event", "text", "version"), "version").alias("x"))
    return last.where("x.event <> 'close'").select("uri", "x.version", "x.text")
