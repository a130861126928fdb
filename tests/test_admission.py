"""Batch admission against the counter of one client, event by event."""

import random

import pytest

from promptmill.operators import admission as A
from promptmill.operators import lifecycle


def brute(rows, width, limit):
    out, windows = {}, {}
    for t, i, k in sorted((t, i, k) for i, k, t in rows if k is not None and t is not None):
        out[i] = windows.setdefault(k, A.Window(width, limit)).admit(t)
    return out


@pytest.mark.parametrize("hot_rows", [1_000_000, 100])
@pytest.mark.parametrize(("width", "limit"), [(100, 1), (100, 7), (1000, 20), (7, 3)])
def test_admission_with_a_hot_client(spark, width, limit, hot_rows):
    """A third of the rows come from one client; many fall on one millisecond; some windows stay empty."""
    rng = random.Random(width + limit)
    rows, at = [], {}
    for i in range(4000):
        k = "hot" if rng.random() < 0.34 else f"c{rng.randint(0, 40)}"
        at[k] = at.get(k, rng.randint(0, 500)) + rng.choice([0, 0, 0, 1, 2, 5, width // 3, width] + [5 * width] * (rng.random() < 0.05))
        rows.append((i, k, at[k]))
    rng.shuffle(rows)
    df = spark.createDataFrame([*rows, (9001, None, 5), (9002, "hot", None)], "id bigint, k string, t bigint")
    got = {r["id"]: r["admitted"] for r in A.admit(df, "k", "t", "id", width, limit, hot_rows).collect()}
    assert got == brute(rows, width, limit) and set(got.values()) == {True, False}
    assert A.admit(df.where("false"), "k", "t", "id", width, limit, hot_rows).count() == 0


def test_fifo_refuses_when_full(spark):
    df = spark.createDataFrame([(5, "a"), (9, "b"), (7, "c"), (None, "d")], "o bigint, x string")
    assert sorted(map(tuple, lifecycle.fifo(df, "o", 2).select("x", "place", "admitted").collect())) == [("a", 1, True), ("b", 3, False), ("c", 2, True)]
    assert lifecycle.fifo(df.where("false"), "o", 2).count() == 0


def test_clock_reclaims_orphans_first(spark):
    rows = [(0, 1, 10, "ORPHAN", True), (0, 2, 10, "READY", True), (0, 3, 10, "PENDING", False), (0, 4, 10, "READY", False), (0, 5, 10, "DEAD", False), (0, 6, 10, "READY", False)]
    df = spark.createDataFrame(rows, "ring int, id bigint, n_bytes int, state string, hot boolean")
    got = {r["id"]: r["fate"] for r in lifecycle.clock(df, "ring", "id", 25).collect()}
    assert got == {1: "RECLAIMED", 2: "MOVED", 3: "SKIPPED", 4: "EVICTED", 5: "RECLAIMED", 6: "EVICTED"}
