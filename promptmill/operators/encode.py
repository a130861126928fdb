"""Encoders: text to unit vectors. The default is a hashed bag of words, which measures shared words, not meaning."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scale import parallel, ship

DIMENSIONS = 384
_words = re.compile(r"[^\W_]+")


class HashedWords:
    """Counts of words by the first 4 hex digits of their MD5, modulo the dimensions, made a unit vector."""

    def __init__(self, dimensions: int = DIMENSIONS) -> None:
        self.dimensions, self.memo = dimensions, {}

    def __call__(self, text: str | None) -> list[float] | None:
        """None for texts without a word."""
        v = np.zeros(self.dimensions)
        for w in _words.findall((text or "").lower()):
            if (b := self.memo.get(w)) is None:
                if len(self.memo) > 500_000:
                    self.memo.clear()
                b = self.memo[w] = int(hashlib.md5(w.encode("utf-8", "replace")).hexdigest()[:4], 16) % self.dimensions
            v[b] += 1
        n = np.linalg.norm(v)
        return (v / n).tolist() if n else None


def encode(df: DataFrame, row_id: str, text: str, encoder: Callable[[], Callable] = HashedWords) -> DataFrame:
    """(vec_id, v) of the rows that the encoder gives a vector for. ``encoder`` is called once per task."""
    ship(df.sparkSession)

    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoder()
        for s in batches:
            yield pd.Series([enc(t) for t in s], dtype=object)

    rows = parallel(df.where(F.col(row_id).isNotNull() & F.col(text).isNotNull()).select(F.col(row_id).alias("vec_id"), F.col(text).alias("_t")))
    return rows.select("vec_id", F.pandas_udf(vectors, "array<double>")("_t").alias("v")).where("v is not null")


def mean_pool(token_vectors: DataFrame, row_id: str, vector: str) -> DataFrame:
    """(row_id, v): mean of the vectors of each row's tokens. The average is taken per dimension, partially first."""
    each = token_vectors.select(row_id, F.posexplode(vector).alias("dim", "x")).groupBy(row_id, "dim").agg(F.avg("x").alias("x"))
    order: Column = F.array_sort(F.collect_list(F.struct("dim", "x")))
    return each.groupBy(row_id).agg(F.transform(order, lambda s: s["x"]).alias("v"))
