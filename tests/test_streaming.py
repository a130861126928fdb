import datetime as dt

from pyspark.sql import functions as F

from promptmill.operators.admission import Window
from promptmill.streaming import requests as R

from .conftest import DATA


def run(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return df.sparkSession.table(name)


def split(df, path, n=3):
    df.repartitionByRange(n, "ts").write.parquet(str(path))


def test_traffic_equals_batch(spark, tmp_path):
    src = spark.read.parquet(f"{DATA}/check_requests.parquet")
    src.coalesce(1).write.parquet(str(tmp_path / "in"))
    s = R.read_stream(spark, str(tmp_path / "in"), src.schema)
    got = {(r["window"]["start"], r["check_state"]): r["n"] for r in run(R.traffic(s), "traffic", "complete").collect()}
    want = src.withColumn("ts", F.col("ts").cast("timestamp")).groupBy(F.window("ts", "1 hour"), "check_state").count()
    assert got == {(r["window"]["start"], r["check_state"]): r["count"] for r in want.collect()}


def test_admission_stream(spark, tmp_path):
    t0 = dt.datetime(2031, 1, 1)
    rows = [(i, f"c{i % 3}", t0 + dt.timedelta(seconds=7 * i)) for i in range(60)]
    df = spark.createDataFrame(rows, "request_id bigint, client_ip string, ts timestamp")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    s = R.read_stream(spark, str(tmp_path / "in"), df.schema)
    got = {r["request_id"]: r["admitted"] for r in run(R.admit(s, "client_ip", "request_id", 60_000, 2), "admitted").collect()}
    want, windows = {}, {}
    for i, c, t in rows:
        w = windows.setdefault(c, Window(60_000, 2))
        want[i] = w.admit(int(t.replace(tzinfo=dt.timezone.utc).timestamp() * 1000))
    assert got == want and set(want.values()) == {True, False}


def test_first_per_node(spark, tmp_path):
    t0 = dt.datetime(2031, 1, 1)
    df = spark.createDataFrame([(i, None if i == 5 else i % 4, t0 + dt.timedelta(seconds=i)) for i in range(20)], "request_id bigint, node_id bigint, ts timestamp")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    got = run(R.first_per_node(R.read_stream(spark, str(tmp_path / "in"), df.schema)), "firsts").collect()
    assert sorted(r["node_id"] for r in got) == [0, 1, 2, 3]


def test_pending_expires(spark, tmp_path):
    t0 = dt.datetime(2031, 1, 1)
    at = lambda s: t0 + dt.timedelta(seconds=s)
    one = [(1, at(0), "MISS"), (1, at(10), "COMMIT"), (2, at(0), "MISS"), (2, at(40), "COMMIT"), (3, at(1), "COMMIT"), (4, at(5), "MISS")]
    two = [(9, at(600), "MISS")]
    schema = "node_id bigint, ts timestamp, kind string"
    for k, rows in enumerate((one, two, [(9, at(601), "COMMIT")])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = R.read_stream(spark, str(tmp_path / "in"), schema)
    got = sorted((r["node_id"], r["outcome"]) for r in run(R.pending(s), "pending").collect())
    assert (1, "READY") in got and (2, "EXPIRED") in got and (2, "STALE") in got and (3, "STALE") in got and (9, "READY") in got
    assert (4, "READY") not in got


def test_exact_cache_sink(spark, tmp_path):
    put = R.exact_cache_sink(str(tmp_path / "cache"))
    schema = "record_id bigint, prompt string, payload string"
    put(spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (3, None, "n")], schema), 0)
    put(spark.createDataFrame([(4, "a", "z")], schema), 1)
    put(spark.createDataFrame([(4, "a", "z")], schema), 1)  # a batch that is run again
    got = sorted(r["payload"] for r in R.read_epoch(spark, str(tmp_path / "cache")).collect())
    assert got == ["y", "z"]
    assert R.read_epoch(spark, str(tmp_path / "none")) is None
