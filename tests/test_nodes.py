"""Slots, lookups, walks and commits on small hand-made tables."""

import pytest

from promptmill import scale
from promptmill.operators import nodes as N

NODE = "node_id bigint, state string, version int, created_ms bigint, outcome string"
ROWS = [(0, "DEAD", 3, 0, "x"), (1, "READY", 15, 0, "x"), (2, "PENDING", 2, 50_000, "x"), (3, "PENDING", 2, 1_000, "x"), (4, "DEAD", 15, 0, "x"), (6, "DEAD", 7, 0, "x"), (None, "READY", 1, 0, "x")]


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_slots_in_order_with_the_next_version(spark):
    nodes = table(spark, ROWS, NODE)
    asked = table(spark, [(9,), (5,), (7,), (None,)], "request_id bigint")
    assert sorted(map(tuple, N.acquire(asked, nodes).collect())) == [(5, 0, 4, "PENDING"), (7, 4, 0, "PENDING"), (9, 6, 8, "PENDING")]
    more = table(spark, [(i,) for i in range(5)], "request_id bigint")
    assert sorted(map(tuple, N.acquire(more, nodes).collect()))[3:] == [(3, None, None, "REJECTED"), (4, None, None, "REJECTED")]
    assert sorted(map(tuple, N.acquire(more, nodes, flat_room=1).collect())) == [(0, 0, 4, "PENDING"), (1, 4, 0, "REJECTED"), (2, 4, 1, "REJECTED"), (3, 4, 2, "REJECTED"), (4, 4, 3, "REJECTED")]
    assert N.acquire(asked.where("false"), nodes).count() == 0
    assert {r["outcome"] for r in N.acquire(asked, nodes.where("false")).collect()} == {"REJECTED"}


def test_point_lookup(spark):
    refs = [(1, 1, 15, "HIT"), (2, 1, 14, "MISS"), (3, 2, 2, "PENDING"), (4, 3, 2, "MISS"), (5, 0, 3, "MISS"), (6, 99, 1, "MISS"), (7, None, 1, "MISS"), (8, 1, None, "MISS")]
    got = N.point_lookup(table(spark, [r[:3] for r in refs], "id bigint, node_id bigint, version int"), table(spark, ROWS, NODE), 60_000)
    assert {r["id"]: r["outcome"] for r in got.collect()} == {r[0]: r[3] for r in refs}


def test_a_live_pending_node_blocks_a_later_ready_one(spark):
    c = [(1, 1, 0, 3), (1, 2, 2, 2), (1, 3, 1, 15), (2, 1, 3, 2), (2, 2, 1, 15), (3, 1, 1, 1), (None, 1, 1, 15)]
    got = N.walk(table(spark, c, "query_id bigint, rnk int, node_id bigint, version int"), table(spark, ROWS, NODE), 60_000)
    assert sorted(map(tuple, got.collect())) == [(1, "PENDING", 2, 2), (2, "HIT", 1, 2), (3, "MISS", None, None)]


def test_commits(spark):
    c = [(1, 2, 2, 10, 5), (2, 2, 2, 10, 4), (3, 2, 1, 10, 1), (4, 1, 15, 10, 1), (5, 99, 1, 10, 1), (6, 3, 2, 0, 1), (7, 3, 2, None, 1), (8, 3, 2, 1 << 21, 2), (9, 3, 2, (1 << 21) - 1, 3), (None, 3, 2, 1, 0)]
    got = N.commit(table(spark, c, "commit_id bigint, node_id bigint, version int, n_bytes int, at bigint"), table(spark, ROWS, NODE))
    want = {1: "LATE", 2: "READY", 3: "STALE", 4: "NOT_PENDING", 5: "UNKNOWN", 6: "EMPTY", 7: "EMPTY", 8: "OVERSIZED", 9: "READY"}
    assert {r["commit_id"]: r["outcome"] for r in got.collect()} == want


def test_zombies(spark):
    nodes = table(spark, [(1, "READY", 5), (2, "DEAD", 5), (3, "READY", None), (4, "PENDING", 6)], "node_id bigint, state string, cluster_of int")
    members = table(spark, [(1, 5), (2, 5), (3, 5), (4, 5), (9, 5)], "node_id bigint, cluster_id int")
    assert {(r["node_id"], r["reason"]) for r in N.zombies(members, nodes).collect()} == {(2, "DEAD"), (3, "UNOWNED"), (4, "ELSEWHERE"), (9, "DEAD")}


def test_staged_tables_go_with_their_block(spark):
    with scale.scratch(spark):
        t = scale.stage(spark.range(3))
        path = t.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file:")
        assert t.count() == 3 and spark.read.parquet(path).count() == 3
    import os

    assert not os.path.exists(path)


def test_a_cluster_needs_a_shared_folder(spark):
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError):
        scale.shared_dir(Session())
