"""Duplicates that differ in spacing, letter case, punctuation or field order (problem 4).

Canonical records (words in order, in lower case) are range-partitioned and sorted on (record, id), so equal records
lie side by side; a scan of adjacent runs compares whole keys. As the id takes part in the ranges, a record that a
third of all rows share is spread over many partitions; its runs are joined again by the two edges of each partition.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scale import ship, stage

SCAN = "kind int, origin string, id bigint, first_id bigint, n bigint, edge binary"
COPY, RUN, EDGE = 0, 1, 2


def words_key(text: Column) -> Column:
    """The words of a text, in lower case, joined by one space: '' if there is none."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def _usable(raw: pd.Series) -> pd.DataFrame:
    """Prompt and payload of a line that is a JSON object where both are strings; else nulls."""
    out = []
    for line in raw:
        got = (None, None)
        try:
            x = json.loads(line) if line is not None else None
            if isinstance(x, dict) and isinstance(x.get("prompt"), str) and isinstance(x.get("payload"), str):
                got = tuple(x[k].encode("utf-8", "replace").decode() for k in ("prompt", "payload"))
        except (ValueError, RecursionError):
            pass
        out.append(got)
    return pd.DataFrame(out, columns=["prompt", "payload"], dtype=object)


def text_records(df: DataFrame, row_id: str, text: str, origin: str) -> DataFrame:
    """(origin, id, key) of the rows whose text has a word; rows without an id or a word take no part."""
    df = df.select(F.lit(origin).alias("origin"), F.col(row_id).cast("bigint").alias("id"), words_key(F.col(text)).alias("key"))
    return df.where("id is not null and key <> ''")


def json_records(df: DataFrame, row_id: str, raw: str, origin: str) -> DataFrame:
    """(origin, id, key) of lines that are JSON objects in which prompt and payload are strings with a word each.

    Order and spelling of fields, escapes and further fields make no difference.
    """
    ship(df.sparkSession)
    df = df.select(F.lit(origin).alias("origin"), F.col(row_id).cast("bigint").alias("id"), F.pandas_udf(_usable, "struct<prompt:string,payload:string>")(F.col(raw)).alias("x"))
    df = df.select("origin", "id", words_key(F.col("x.prompt")).alias("a"), words_key(F.col("x.payload")).alias("b"))
    return df.where("id is not null and a <> '' and b <> ''").select("origin", "id", F.concat_ws("\n", "a", "b").alias("key"))


def _scan(runs: bool):
    """Scan of a sorted partition. Emits copies (id, first id of its run here) or runs, and the edges: its first and last run."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_origin = last_key = last_id = None
        first = n = 0
        opened = 0
        out: list[tuple] = []

        def close() -> None:
            if runs:
                out.append((RUN, last_origin, None, first, n, None))

        def edge() -> None:
            out.append((EDGE, last_origin, None, first, None, hashlib.sha256(f"{last_origin}\x1f{last_key}".encode("utf-8", "replace")).digest()))

        def flush() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) if out else [[]] * 6
            out.clear()
            kinds = (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            names = ("kind", "origin", "id", "first_id", "n", "edge")
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=list(names))

        for batch in batches:
            for origin, key, i in zip(*(batch.column(c).to_pylist() for c in ("origin", "key", "id")), strict=True):
                if key == last_key and origin == last_origin:
                    if i == last_id:
                        continue  # an exact repeat
                    n += 1
                    if not runs:
                        out.append((COPY, origin, i, first, None, None))
                else:
                    if opened:
                        close()
                        if opened == 1:
                            edge()
                    opened += 1
                    last_origin, last_key, first, n = origin, key, i, 1
                last_id = i
            if len(out) > 20_000:
                yield flush()
        if opened:
            close()
            edge()
        yield flush()

    return scan


def _scanned(records: DataFrame, runs: bool) -> tuple[DataFrame, DataFrame]:
    """The scan's rows, and (origin, local, first_id) for runs that began in an earlier partition: two a partition at most."""
    ship(records.sparkSession)
    n = max(int(records.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    order = ["origin", "key", "id"]
    # The ranges are found by a sample, which would parse everything once more.
    got = stage(records.select(*order), "records").repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(_scan(runs), SCAN)
    got = stage(got, "runs")
    edges = got.where(F.col("kind") == EDGE).groupBy("origin", "edge").agg(F.min("first_id").alias("to_id"), F.collect_set("first_id").alias("local"))
    moved = edges.select("origin", "to_id", F.explode("local").alias("local")).where("local <> to_id")
    return got, stage(moved, "edges")


def copies(records: DataFrame) -> DataFrame:
    """(origin, first_id, copy_id): each id that isn't the smallest of its group, with the smallest.

    ``records`` has (origin, id, key), as text_records and json_records give them. Rows of one id count once. Ties
    can't arise: ids of one origin are distinct. No records give no rows.
    """
    got, moved = _scanned(records, runs=False)
    found = got.where(F.col("kind") == COPY).select("origin", F.col("first_id").alias("local"), F.col("id").alias("copy_id"))
    found = found.join(F.broadcast(moved), ["origin", "local"], "left")
    found = found.select("origin", F.coalesce("to_id", "local").alias("first_id"), "copy_id")
    return found.union(moved.select("origin", "to_id", "local"))


def collapsed(records: DataFrame) -> DataFrame:
    """(origin, first_id, copies): one row for each distinct record, with the number of ids that have it."""
    got, moved = _scanned(records, runs=True)
    runs = got.where(F.col("kind") == RUN).select("origin", F.col("first_id").alias("local"), "n")
    cut = stage(moved.select("origin", "local", "to_id").union(moved.select("origin", F.col("to_id").alias("local"), "to_id").distinct()), "cut")
    whole = runs.join(F.broadcast(cut), ["origin", "local"], "left_anti").select("origin", F.col("local").alias("first_id"), F.col("n").alias("copies"))
    parts = runs.join(F.broadcast(cut), ["origin", "local"]).groupBy("origin", F.col("to_id").alias("first_id")).agg(F.sum("n").alias("copies"))
    return whole.union(parts)
