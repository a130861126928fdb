"""Structured Streaming forms: traffic windows, admission with idle expiry, coalescing, pending expiry, exact-cache sink."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..model import PENDING_MILLIS
from ..operators.admission import Window
from ..operators.cache import digest
from ..scale import ship


def read_stream(spark: SparkSession, path: str, schema: T.StructType | str, format: str = "parquet", files_per_batch: int | None = None) -> DataFrame:
    """A stream of request files. ``ts`` columns without zone become timestamps, as watermarks need."""
    reader = spark.readStream.format(format).schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    df = reader.load(path)
    return df.withColumns({c: F.col(c).cast("timestamp") for c, kind in df.dtypes if kind == "timestamp_ntz"})


def traffic(stream: DataFrame, every: str = "1 hour", late: str = "2 days") -> DataFrame:
    """(window, check_state, n): requests per tumbling window of event time; rows later than ``late`` are dropped."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", every), "check_state").agg(F.count(F.lit(1)).alias("n"))


def first_per_node(stream: DataFrame, key: str = "node_id", late: str = "2 days") -> DataFrame:
    """The first row of each key that arrives within the watermark: the pioneer that asks upstream for its followers."""
    return stream.where(F.col(key).isNotNull()).withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def admit(stream: DataFrame, key: str, row_id: str, width: int, limit: int, idle: int = 300_000, late: str = "1 hour") -> DataFrame:
    """(row_id, key, admitted): sliding-window admission. A client's state is four numbers; it goes ``idle`` ms after its last event.

    Rows of one micro-batch are taken in order of (ts, row_id); order across batches is that of arrival.
    """
    ship(stream.sparkSession)
    kind = dict(stream.dtypes)[key]

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        start, previous, current, last = state.get if state.exists else (None, 0, 0, 0)
        w = Window(width, limit, start, previous, current)
        rows = pd.concat(list(batches)).sort_values(["ts", row_id])
        at = rows["ts"].astype("datetime64[us]").astype("int64") // 1000
        out = [w.admit(int(t)) for t in at]
        last = max(last, int(at.max()))
        state.update((w.start, w.previous, w.current, last))
        state.setTimeoutTimestamp(max(last + idle, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({row_id: rows[row_id], key: rows[key], "admitted": out})

    rows = stream.where(F.col(key).isNotNull()).withWatermark("ts", late).select(row_id, key, "ts")
    return rows.groupBy(key).applyInPandasWithState(step, f"`{row_id}` bigint, `{key}` {kind}, admitted boolean", "start bigint, previous bigint, current bigint, last bigint", "append", GroupStateTimeout.EventTimeTimeout)


def pending(stream: DataFrame, late: str = "1 minute", life: int = PENDING_MILLIS) -> DataFrame:
    """(node_id, outcome, at): READY when a pending node is committed in time, EXPIRED when it isn't.

    ``stream`` has (node_id, ts, kind) with kind MISS or COMMIT. A commit without a pending node is STALE. Nodes expire
    as the watermark passes their life.
    """
    ship(stream.sparkSession)

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out = []
        if state.hasTimedOut:
            out.append((k[0], "EXPIRED", state.get[0] + life))
            state.remove()
        else:
            since = state.get[0] if state.exists else None
            rows = pd.concat(list(batches)).sort_values("ts", kind="stable")
            for t, kind in zip(rows["ts"].astype("datetime64[us]").astype("int64") // 1000, rows["kind"], strict=True):
                t = int(t)
                if since is not None and t - since > life:
                    out.append((k[0], "EXPIRED", since + life))
                    since = None
                if kind == "MISS":
                    since = t if since is None else since
                else:
                    out.append((k[0], "STALE" if since is None else "READY", t))
                    since = None
            if since is None:
                if state.exists:
                    state.remove()
            else:
                state.update((since,))
                state.setTimeoutTimestamp(max(since + life + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["node_id", "outcome", "at"])

    rows = stream.where("node_id is not null").withWatermark("ts", late).select("node_id", "ts", "kind")
    return rows.groupBy("node_id").applyInPandasWithState(step, "node_id bigint, outcome string, at bigint", "since bigint", "append", GroupStateTimeout.EventTimeTimeout)


def exact_cache_sink(path: str, row_id: str = "record_id", most_bytes: int = 65_536):
    """A foreachBatch function that keeps ``path`` an exact cache: per prompt the last payload, in one folder per batch.

    Each batch writes a new epoch from the last one and its own rows; a batch that is run again overwrites its epoch.
    """

    def put(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = batch.where(F.col("prompt").isNotNull() & (F.octet_length("payload") < most_bytes)).select(digest(F.col("prompt")).alias("hash"), F.col(row_id).alias("row_id"), "payload")
        old = read_epoch(spark, path, before=batch_id)
        every = new if old is None else new.unionByName(old)
        last = every.groupBy("hash").agg(F.max(F.struct("row_id", "payload")).alias("x")).select("hash", "x.row_id", "x.payload")
        last.write.mode("overwrite").parquet(f"{path}/epoch={batch_id:012d}")

    return put


def read_epoch(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """The last epoch of an exact cache, or the last one before a batch; None if there is none."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(hadoop):
        return None
    names = sorted(n for s in fs.listStatus(hadoop) if (n := s.getPath().getName()).startswith("epoch="))
    names = [n for n in names if before is None or int(n[6:]) < before]
    return spark.read.parquet(f"{path}/{names[-1]}") if names else None
