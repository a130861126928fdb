"""Admission of clients by a sliding window, in batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as SqlWindow
from pyspark.sql import functions as F

from ..scale import lookup, ship, stage


class Window:
    """Counter of one client: the last window's count fades out over the current one. Denied requests don't count."""

    __slots__ = ("current", "limit", "previous", "start", "width")

    def __init__(self, width: int, limit: int, start: int | None = None, previous: int = 0, current: int = 0) -> None:
        self.width, self.limit, self.start, self.previous, self.current = width, limit, start, previous, current

    def admit(self, now: int) -> bool:
        if self.start is None:
            self.start = now
        passed = (now - self.start) // self.width
        if passed >= 1:
            self.previous = self.current if passed == 1 else 0
            self.current = 0
            self.start += passed * self.width
        estimate = self.current + self.previous * (self.width - (now - self.start)) / self.width
        if int(estimate) >= self.limit:
            return False
        self.current += 1
        return True


def _room(limit: int, previous: np.ndarray | int, elapsed: int, width: int) -> np.ndarray | int:
    """How many admissions the window may have had before a request is denied, as ``Window.admit`` reckons."""
    faded = previous * (width - elapsed) / width
    room = limit - np.floor(faded)
    return room - (np.floor(room - 1 + faded) >= limit)


def admit(events: DataFrame, key: str, at: str, row_id: str, width: int, limit: int, hot_rows: int = 1_000_000) -> DataFrame:
    """(row_id, key, admitted): decisions for each event in order of (``at`` in milliseconds, row_id) per client.

    A decision depends on the earlier ones of its client. Where no client has over ``hot_rows`` events each one's stream
    through a task in order; else clients are spread over their windows (``_by_windows``), with the same result. Rows with
    a null key or time are left out.
    """
    ship(events.sparkSession)
    rows = events.where(F.col(key).isNotNull() & F.col(at).isNotNull()).select(row_id, key, F.col(at).alias("_at"))
    most = rows.groupBy(key).count().agg(F.max("count")).first()[0] or 0
    return _by_windows(rows, key, row_id, width, limit) if most > hot_rows else _by_clients(rows, key, row_id, width, limit)


def _by_clients(rows: DataFrame, key: str, row_id: str, width: int, limit: int) -> DataFrame:
    """Clients in order, each by its counter, which keeps four numbers."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, window = None, None
        for b in batches:
            out = []
            for k, t in zip(b[key], b["_at"], strict=True):
                if window is None or k != last:
                    last, window = k, Window(width, limit)
                out.append(window.admit(t))
            yield pd.DataFrame({row_id: b[row_id], key: b[key], "admitted": out})

    schema = f"`{row_id}` {dict(rows.dtypes)[row_id]}, `{key}` {dict(rows.dtypes)[key]}, admitted boolean"
    return rows.repartition(key).sortWithinPartitions(key, "_at", row_id).mapInPandas(fold, schema)


def _by_windows(rows: DataFrame, key: str, row_id: str, width: int, limit: int) -> DataFrame:
    """Windows of a client follow one another from its first event on, and a window knows of the one before only how many it
    admitted, from 0 to ``limit``. So each window is reckoned for all of these at once, by itself and from the counts of
    its milliseconds; then only one row for each window is taken in order of time; then each window is reckoned with what
    came before it. A window has at most ``width`` rows, and a client with a third of all events is spread over its own.
    """
    kind = dict(rows.dtypes)[key]
    starts = rows.groupBy(key).agg(F.min("_at").alias("_start"))
    rows = lookup(rows, starts, key)
    since = F.col("_at") - F.col("_start")
    window = F.floor(since / width).cast("bigint")
    rows = rows.select(row_id, key, window.alias("_w"), (since - window * width).cast("bigint").alias("_e"))
    ticks = stage(rows.groupBy(key, "_w", "_e").agg(F.count(F.lit(1)).alias("_c")), "ticks")

    def outcomes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Of each window what it admits, by what the one before admitted."""
        before, last, admitted = np.arange(limit + 1), None, None
        for b in batches:
            out = []
            for k, w, e, c in zip(b[key], b["_w"], b["_e"], b["_c"], strict=True):
                if (k, w) != last:
                    if last is not None:
                        out.append((*last, admitted))
                    last, admitted = (k, w), np.zeros(limit + 1)
                room = _room(limit, before, e, width)
                admitted = np.where(admitted < room, np.minimum(admitted + c, room), admitted)
            yield pd.DataFrame(out, columns=[key, "_w", "_f"])
        if last is not None:
            yield pd.DataFrame([(*last, admitted)], columns=[key, "_w", "_f"])

    def chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """What the window before each one admitted."""
        last, n = (None, 0), 0
        for b in batches:
            out = []
            for k, w, f in zip(b[key], b["_w"], b["_f"], strict=True):
                n = n if last == (k, w - 1) else 0
                out.append((k, w, n))
                last, n = (k, w), int(f[n])
            yield pd.DataFrame(out, columns=[key, "_w", "_p"])

    def counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """How many of each millisecond's requests are admitted."""
        last, admitted = None, 0
        for b in batches:
            out = []
            for k, w, e, c, p in zip(b[key], b["_w"], b["_e"], b["_c"], b["_p"], strict=True):
                if (k, w) != last:
                    last, admitted = (k, w), 0
                n = int(max(0, min(c, _room(limit, p, e, width) - admitted)))
                admitted += n
                out.append((k, w, e, n))
            yield pd.DataFrame(out, columns=[key, "_w", "_e", "_n"])

    order = [key, "_w", "_e"]
    each = ticks.repartition(key, "_w").sortWithinPartitions(*order).mapInPandas(outcomes, f"`{key}` {kind}, _w bigint, _f array<double>")
    before = each.repartition(key).sortWithinPartitions(key, "_w").mapInPandas(chain, f"`{key}` {kind}, _w bigint, _p bigint")
    known = ticks.join(before, [key, "_w"]).repartition(key, "_w").sortWithinPartitions(*order)
    n = known.mapInPandas(counts, f"`{key}` {kind}, _w bigint, _e bigint, _n bigint")
    place = F.row_number().over(SqlWindow.partitionBy(*order).orderBy(row_id))  # among the requests of one millisecond
    return rows.join(n, order).select(row_id, key, (place <= F.col("_n")).alias("admitted"))
