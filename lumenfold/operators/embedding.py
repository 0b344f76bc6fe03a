"""Vectors of texts. Without a model at hand, hashed tokens; a model is a function from texts to a matrix."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenfold.functions import text as fn

DIM, BATCH = 384, 64
Model = Callable[[list[str]], np.ndarray]


def hashed(texts: list[str], dim: int = DIM) -> np.ndarray:
    """Signed counts of lower-cased tokens and of neighbouring pairs in dim hashed places."""
    out = np.zeros((len(texts), dim))
    for row, text in enumerate(texts):
        toks = [t.lower() for t in re.findall(fn.TOKEN, text)]
        for t in [*toks, *(f"{a} {b}" for a, b in zip(toks, toks[1:], strict=False))]:
            h = zlib.crc32(t.encode())
            out[row, h % dim] += 1 - 2 * ((h >> 31) & 1)
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    return (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)).astype(np.float32)


def embed(text, model: Model = hashed, batch: int = BATCH) -> Column:
    """Unit vectors of a text column, batch by batch in Arrow workers; a text without tokens has the zero vector, a null text none."""

    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in series:
            out: list = [None] * len(s)
            rows = [i for i, t in enumerate(s) if t is not None]
            for k in range(0, len(rows), batch):
                part = rows[k : k + batch]
                for i, v in zip(part, _unit(np.asarray(model([s.iloc[i] for i in part]))), strict=True):
                    out[i] = v
            yield pd.Series(out, dtype=object)

    return F.pandas_udf(run, T.ArrayType(T.FloatType()))(fn.c(text))


def embed_chunks(chunks: DataFrame, model: Model = hashed, text: str = "content", label: str | None = "semantic_label") -> DataFrame:
    """chunks with embedding, of the cleaned text under its label."""
    clean = fn.for_embedding(text, label if label and label in chunks.columns else None)
    return chunks.withColumn("embedding", embed(clean, model))


def embed_query(query: str, model: Model = hashed) -> list[float]:
    return [float(v) for v in _unit(np.asarray(model([query.strip()])))[0]]
