"""A model over the rows of a table: loaded once in a worker, asked in batches of like lengths, nothing beside the driver.

A model is given by a function that loads it; what that returns takes lists of texts, one for each input
column, and returns a number for each row. Texts are cut to what the model reads.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

Scorer = Callable[..., Sequence[float]]
#: Rows of a batch, and characters of a batch with every row as long as its longest.
ROWS, AREA = 64, 1 << 18

_loaded: dict[str, Scorer] = {}


def _model(name: str, load: Callable[[], Scorer]) -> Scorer:
    """This worker's model: a worker that serves several tasks loads it once, and holds one at a time."""
    if name not in _loaded:
        _loaded.clear()
        _loaded[name] = load()
    return _loaded[name]


def batches(lengths: Sequence[int], rows: int = ROWS, area: int = AREA) -> list[list[int]]:
    """The places of rows in order of length, in batches within both bounds; a row longer than area is a batch of its own."""
    out: list[list[int]] = []
    for i in np.argsort(np.asarray(lengths, np.int64), kind="stable").tolist():
        if not out or len(out[-1]) >= rows or (len(out[-1]) + 1) * lengths[i] > area:
            out.append([])
        out[-1].append(i)
    return out


def scored(rows: DataFrame, columns: Sequence[str], load: Callable[[], Scorer], out: str = "model_score", rows_a_batch: int = ROWS, area: int = AREA) -> DataFrame:
    """rows with the model's number for the texts in `columns`; null where one of them is null or the model gives none.

    Each partition passes its rows through in Arrow batches; no row moves to another task.
    """
    name = uuid.uuid4().hex

    def run(series: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for s in series:
            s = s if isinstance(s, tuple) else (s,)  # one column alone comes bare
            values = np.full(len(s[0]), np.nan)
            able = np.flatnonzero(~np.any([x.isna().to_numpy() for x in s], axis=0))
            texts = [x.to_numpy(object)[able] for x in s]
            for part in batches([sum(len(t[i]) for t in texts) for i in range(len(able))], rows_a_batch, area):
                values[able[part]] = np.asarray(_model(name, load)(*[t[part].tolist() for t in texts]), np.float64)
            yield pd.Series(values).astype(object).where(~np.isnan(values), None)

    score = F.pandas_udf(run, "double")
    return rows.withColumn(out, score(*[F.col(c) for c in columns]))


def rerank(candidates: DataFrame, load: Callable[[], Scorer], k: int, by: str = "query_id", key: str = "key", query: str = "query", text: str = "content", chars: int = 500) -> DataFrame:
    """(by, rank from 1, key, score): each query's k best candidates by a model of the query and the text's first `chars` characters.

    Ties go to the smaller key; candidates without a score come last. Tasks keep k rows of a query before rows of one query meet,
    so a query with any number of candidates is no task's burden.
    """
    rows = candidates.select(F.col(by).alias("_by"), F.col(key).alias("_key"), F.col(query).alias("_query"), F.substring(text, 1, chars).alias("_text"))
    got = scored(rows, ["_query", "_text"], load, "_score").select("_by", "_key", "_score")
    best = F.row_number().over(Window.partitionBy("_by").orderBy(F.desc_nulls_last("_score"), "_key"))
    ranked = got.withColumn("_rank", best).where(F.col("_rank") <= k)
    return ranked.select(F.col("_by").alias(by), F.col("_rank").alias("rank"), F.col("_key").alias(key), F.col("_score").alias("score"))
