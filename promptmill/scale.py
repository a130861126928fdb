"""Helpers that keep plans safe at size: staged tables, bounded broadcasts and hot-key salting.

Nothing here uses localCheckpoint or a machine-local folder on a cluster: staged tables go below the folder
that ``spark.checkpoint.dir`` names, which all executors share. Only where that setting is absent and all tasks run in
the driver's process (a local master: unit tests, a laptop) a temporary folder is made; on a cluster it is an error.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows a side may have to be broadcast: a row of two longs takes some 50 bytes in a hashed relation.
BROADCAST_ROWS = 100_000

_own_dirs: list[str] = []
_shipped: set[str] = set()
_scopes: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for staged tables: ``spark.checkpoint.dir``, or a temporary one where that is unset.

    RuntimeError without the setting if the executors are other processes, whose files the driver may not see.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
    if not _own_dirs:
        _own_dirs.append(tempfile.mkdtemp(prefix="promptmill-"))
        atexit.register(shutil.rmtree, _own_dirs[0], True)
    return "file://" + _own_dirs[0]


def stage(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and survives lost executors.

    The files are removed when the ``scratch`` block around it ends, else when the driver ends. A staged table is
    computed once however often it is read.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/promptmill/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    remove_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def remove_at_exit(spark: SparkSession, path: str) -> None:
    """Have a folder removed when the ``scratch`` block or else the driver ends."""
    if _scopes:
        _scopes[-1].append(path)
    else:
        atexit.register(_remove, spark, path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables staged inside are removed at the end of the block: results must be written or collected in it."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            _remove(spark, path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001 - the session may be gone; the cluster's own cleaning applies then
        pass


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    root = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="promptmill-zip-"), "promptmill_pkg.zip")
    with zipfile.ZipFile(target, "w") as z:
        for at, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(at, f)
                    z.write(full, os.path.join("promptmill", os.path.relpath(full, root)))
    sc.addPyFile(target)
    atexit.register(shutil.rmtree, os.path.dirname(target), True)


def parallel(df: DataFrame, least: int | None = None) -> DataFrame:
    """Spread a table whose files give fewer tasks than the cluster has cores (a single small file gives one).

    Plans with an exchange are left alone: they are spread already, and counting their partitions would run them.
    """
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString():
        return df
    n = least or df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def fits(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``rows`` rows; reads no more than needed to know."""
    return df.select(F.lit(1)).limit(rows + 1).count() <= rows


def join_bounded(left: DataFrame, right: DataFrame, on, how: str = "inner", rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join that broadcasts ``right`` only if its row count, checked here, is at most ``rows``; else it shuffles."""
    return left.join(F.broadcast(right) if fits(right, rows) else right, on, how)


def salted_pairs(left: DataFrame, right: DataFrame, key: str, pairs_each: int = 2_000_000, most_hot: int = 1000, salts: int = 64) -> DataFrame:
    """Inner join on ``key`` in which no task gets more than a share of a hot key's pairs.

    A key is hot if its pairs number over ``pairs_each`` and over a ``most_hot``-th of all pairs, so at most
    ``most_hot`` keys are hot (the broadcast table of hot keys is bounded by that). The rows of a hot key are spread
    over ``salts`` tasks on the left and repeated for each of them on the right. Keys on one side only are dropped
    before rows are shuffled. Null keys match nothing.
    """
    n = F.count(F.lit(1))
    sizes = left.groupBy(key).agg(n.alias("_l")).join(right.groupBy(key).agg(n.alias("_r")), key)
    sizes = stage(sizes.select(key, (F.col("_l").cast("double") * F.col("_r")).alias("_p")), "sizes")
    total = sizes.agg(F.sum("_p")).first()[0] or 0.0
    limit = max(pairs_each, total / most_hot)
    hot = sizes.where(F.col("_p") > limit).select(key, F.lit(True).alias("_hot"))
    both = sizes.select(key)
    small = fits(both)
    both = F.broadcast(both) if small else both
    left, right = left.join(both, key, "left_semi"), right.join(both, key, "left_semi")
    if total <= limit:
        return left.join(right, key)
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(*left.columns), F.lit(salts))).otherwise(0).cast("int")  # of the row: the same on a retry
    left = left.join(F.broadcast(hot), key, "left").withColumn("_salt", salt).drop("_hot")
    every = F.sequence(F.lit(0), F.lit(salts - 1))
    right = right.join(F.broadcast(hot), key, "left").withColumn("_salt", F.explode(F.when(F.col("_hot"), every).otherwise(F.array(F.lit(0))))).drop("_hot")
    return left.join(right, [key, "_salt"]).drop("_salt")


def running(df: DataFrame, keys: list[str], order: str, value, out: str, width: int = 50_000) -> DataFrame:
    """Running total of ``value`` by the integer column ``order`` (unique per key) within ``keys``, added as ``out``.

    Plain running windows put a whole key, or without keys everything, into one task. Here rows are taken in ranges of
    ``width`` orders: totals per range are aggregated first and summed up over the few ranges, then each range is
    summed by itself and shifted. The table of ranges has one row per key and range.
    """
    df = df.withColumn("_v", value).withColumn("_b", F.floor(F.col(order) / width))
    sums = df.groupBy(*keys, "_b").agg(F.sum("_v").alias("_s"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, "_b", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_o"))
    inner = Window.partitionBy(*keys, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("_i", F.sum("_v").over(inner)).join(sums, [*keys, "_b"]).withColumn(out, F.col("_i") + F.col("_o")).drop("_v", "_b", "_i", "_o")


def lookup(left: DataFrame, right: DataFrame, key: str, hot_rows: int = 200_000, most_hot: int = 1000) -> DataFrame:
    """Left join with a table that has one row per key, in which hot keys of the left side aren't shuffled together.

    Keys with more than ``hot_rows`` rows and more than a ``most_hot``-th of all rows are at most ``most_hot``; their
    right rows are broadcast, the rest is joined by shuffle (or by a broadcast, if Spark knows the table to be small).
    """
    counts = left.groupBy(key).count()
    if fits(left, hot_rows):
        return left.join(right, key, "left")
    total = left.count()
    hot = stage(counts.where(F.col("count") > max(hot_rows, total / most_hot)).where(F.col(key).isNotNull()).select(key), "hot")
    if hot.isEmpty():
        return left.join(right, key, "left")
    few = right.join(F.broadcast(hot), key, "left_semi")
    a = left.join(F.broadcast(hot), key, "left_semi").join(F.broadcast(few), key, "left")
    return a.unionByName(left.join(F.broadcast(hot), key, "left_anti").join(right, key, "left"))
