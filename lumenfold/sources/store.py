"""Tables in the folder that all executors share: cut points of a lineage, and named versioned tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def work_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset, a local session gets a temporary one; a cluster is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        sc = spark.sparkContext
        held = sc._jsc.sc().getCheckpointDir()
        if held.isDefined():
            found = held.get()
        else:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            import tempfile

            found = tempfile.mkdtemp(prefix="lumenfold-")
            sc.setCheckpointDir(found)
            found = sc._jsc.sc().getCheckpointDir().get()
    return found.rstrip("/")


def cut(df: DataFrame, *by: str, parts: int | None = None) -> DataFrame:
    """Writes df to the shared folder and reads it back: the lineage ends there, and survives lost executors."""
    spark = df.sparkSession
    if by:
        df = df.repartition(parts, *by) if parts else df.repartition(*by)
    path = f"{work_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def drop_cut(df: DataFrame) -> None:
    """Deletes a table made by cut() that no later plan reads."""
    path = getattr(df, "_cut_path", None)
    if path:
        delete(df.sparkSession, path)


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _at(spark, path)
    fs.delete(p, True)


def children(spark: SparkSession, path: str) -> list[str]:
    fs, p = _at(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where its files give fewer tasks than there are, for work that costs far more than moving the rows."""
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString():  # asking a shuffled plan for its tasks would run it
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


#: The file that names the columns of a version without rows.
SCHEMA = "_columns"


class Tables:
    """Named Parquet tables below one folder. Each write is a new numbered version, complete once its _SUCCESS is there.

    A reader of an earlier version is never disturbed, and the last KEPT versions stay; an absent table is None.
    """

    KEPT = 2

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _versions(self, name: str) -> list[int]:
        return sorted(int(v[2:]) for v in children(self.spark, f"{self.root}/{name}") if v.startswith("v=") and "_SUCCESS" in children(self.spark, f"{self.root}/{name}/{v}"))

    def _partition(self, name: str) -> list[str]:
        """The columns the present version is laid out by, from the names of its folders."""
        have, out = self._versions(name), []
        path = f"{self.root}/{name}/v={have[-1]}" if have else None
        while path and (folders := [x for x in children(self.spark, path) if "=" in x and not x.startswith(("_", "."))]):
            out.append(folders[0].split("=")[0])
            path = f"{path}/{folders[0]}"
        return out

    def _read(self, path: str) -> DataFrame:
        """A version's rows. A partitioned one that was empty when written has no file to tell its columns, but their names and kinds."""
        if SCHEMA not in children(self.spark, path):
            return self.spark.read.parquet(path)
        fs, p = _at(self.spark, f"{path}/{SCHEMA}")
        held = fs.open(p)
        ddl = bytes(held.readAllBytes()).decode()
        held.close()
        return self.spark.read.schema(ddl).parquet(path)

    def _note_columns(self, path: str, df: DataFrame, partition: tuple[str, ...]) -> None:
        """Beside a partitioned version without rows, its columns, those of the layout last."""
        if partition and not any("=" in x for x in children(self.spark, path)):
            order = [*(c for c in df.columns if c not in partition), *partition]
            fs, p = _at(self.spark, f"{path}/{SCHEMA}")
            out = fs.create(p, True)
            out.write(bytearray(df.select(*order)._jdf.schema().toDDL().encode()))
            out.close()

    def load(self, name: str) -> DataFrame | None:
        have = self._versions(name)
        return self._read(f"{self.root}/{name}/v={have[-1]}") if have else None

    def save(self, name: str, df: DataFrame, *partition: str) -> DataFrame:
        have = self._versions(name)
        path = f"{self.root}/{name}/v={have[-1] + 1 if have else 0}"
        (df.write.partitionBy(*partition) if partition else df.write).mode("overwrite").parquet(path)
        self._note_columns(path, df, partition)
        for old in have[: -self.KEPT + 1] if self.KEPT > 1 else have:
            delete(self.spark, f"{self.root}/{name}/v={old}")
        return self._read(path)

    def append(self, name: str, df: DataFrame, *partition: str) -> DataFrame:
        """New rows beside the present version's files; nothing is rewritten. partition is that of the table."""
        have = self._versions(name)
        if not have:
            return self.save(name, df, *partition)
        path = f"{self.root}/{name}/v={have[-1]}"
        (df.write.partitionBy(*partition) if partition else df.write).mode("append").parquet(path)
        return self._read(path)

    def upsert(self, name: str, fresh: DataFrame, *key: str, gone: DataFrame | None = None) -> DataFrame:
        """fresh replaces the rows of its keys, and the keys of gone go; the layout stays."""
        old = self.load(name)
        if old is None:
            return self.save(name, fresh)
        out = fresh.select(*key)
        out = out if gone is None else out.unionByName(gone.select(*key))
        return self.save(name, old.join(out.distinct(), list(key), "left_anti").unionByName(fresh), *self._partition(name))

    def remove(self, name: str, condition) -> int:
        """Rows removed; the layout stays."""
        old = self.load(name)
        if old is None:
            return 0
        before = old.count()
        return before - self.save(name, old.where(~F.coalesce(condition, F.lit(False))), *self._partition(name)).count()

    def drop(self, name: str) -> None:
        delete(self.spark, f"{self.root}/{name}")


class Log:
    """Rows by key in immutable runs of batches; the last batch that names a key decides, by its rows or by deleting it.

    A batch is written as one run and nothing else is touched, so what it costs is in proportion to it. compact() merges the
    youngest runs whenever an older one is no longer twice as large as those after it, so there are about as many runs as
    doublings of the table, and a row is rewritten about as often. A run counts once its _SUCCESS is there; one that lies inside a
    longer run is passed over, and is deleted when the next merge is done, so that a reader that has planned on it can finish.
    """

    def __init__(self, spark: SparkSession, root: str, key: str):
        self.spark, self.root, self.key = spark, root.rstrip("/"), key

    def _found(self) -> list[tuple[int, int, str]]:
        """(first, last, name) of all complete runs."""
        names = [x for x in children(self.spark, self.root) if x.startswith("run=") and "_SUCCESS" in children(self.spark, f"{self.root}/{x}")]
        return sorted((int(a), int(b), x) for x in names for a, b in [x[4:].split(".")[0].split("-")])

    def runs(self) -> list[tuple[int, int, str]]:
        """The runs that readers merge, oldest first."""
        out: list[tuple[int, int, str]] = []
        for r in sorted(self._found(), key=lambda r: (r[0], -r[1])):
            if not out or r[1] > out[-1][1]:
                out.append(r)
        return out

    def bytes(self, name: str) -> int:
        fs, p = _at(self.spark, f"{self.root}/{name}")
        return fs.getContentSummary(p).getLength()

    def _done(self, source: str) -> int:
        return max((int(x.rsplit(".", 1)[1]) for x in children(self.spark, f"{self.root}/_applied") if x.rsplit(".", 1)[0] == source), default=-1)

    def append(self, rows: DataFrame, source: str, number: int, deleted: str = "deleted") -> bool:
        """Adds batch `number` of a source (its rows, with a column that tells whether the key is deleted). False if it was added before."""
        held = self._found()
        again = any(x.endswith(f".{source}.{number}") for _, _, x in held)
        if number <= self._done(source):
            return False
        if not again:
            at = max((b for _, b, _ in held), default=-1) + 1
            batch = rows.where(F.col(self.key).isNotNull()).withColumnRenamed(deleted, "_gone")
            batch.write.mode("overwrite").parquet(f"{self.root}/run={at:012d}-{at:012d}.{source}.{number}")
        fs, p = _at(self.spark, f"{self.root}/_applied/{source}.{number}")
        fs.create(p, True).close()
        if number and source:
            delete(self.spark, f"{self.root}/_applied/{source}.{number - 1}")
        return not again

    def _merged(self, runs: list[tuple[int, int, str]]) -> DataFrame:
        """What the runs say of each key they name, deletions included."""
        every = None
        for a, _, name in runs:
            one = self.spark.read.parquet(f"{self.root}/{name}").withColumn("_at", F.lit(a))
            every = one if every is None else every.unionByName(one, allowMissingColumns=True)
        if len(runs) == 1:
            return every.drop("_at")
        last = every.groupBy(self.key).agg(F.max("_at").alias("_at"))
        return every.join(last, [self.key, "_at"], "left_semi").drop("_at")

    def read(self) -> DataFrame | None:
        """The rows of keys that are not deleted; of several rows of one key in a batch a deletion is followed by the rest."""
        runs = self.runs()
        return self._merged(runs).where("not _gone").drop("_gone") if runs else None

    def compact(self) -> int:
        """Merges the youngest runs where one before them is less than twice as large; how many runs went into it."""
        runs = self.runs()
        size = [self.bytes(x) for _, _, x in runs]
        first, total = len(runs) - 1, size[-1] if runs else 0
        for i in range(len(runs) - 2, -1, -1):
            if size[i] < 2 * total:
                first = i
            total += size[i]
        mine = runs[first:]
        if len(mine) < 2:
            return 0
        covered = {x for _, _, x in self._found()} - {x for _, _, x in runs}
        out = self._merged(mine)
        out = out if first else out.where("not _gone")
        out.write.mode("overwrite").parquet(f"{self.root}/run={mine[0][0]:012d}-{mine[-1][1]:012d}")
        for x in covered:
            delete(self.spark, f"{self.root}/{x}")
        return len(mine)
