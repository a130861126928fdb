"""Queries on the life of nodes: slots, point lookups, the candidate walk, commits with versions, the request front.

The tables have node ids but no state machine, so states, versions and times are derived from the ids, the same way in
Spark and in SQL: they stand for a snapshot of a node table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..model import PAYLOAD_BYTES, PENDING_MILLIS
from ..operators import front, nodes

NOW = 60_000
FLAT_ROOM = 100


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A node for each id of check_requests: states, versions, times and owners by the id."""
    n = _t(spark, sf_dir, "check_requests").where("node_id is not null").select("node_id").distinct()
    i = F.col("node_id")
    state = F.when(i % 5 == 0, "DEAD").when(i % 5 == 1, "PENDING").otherwise("READY")
    return n.select("node_id", state.alias("state"), (i % 16).cast("int").alias("version"), (NOW - i % 40_000).alias("created_ms"), F.when(i % 11 != 0, i % 7).alias("cluster_of"))


def _references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What requests know of their node: each thirteenth an old version."""
    r = _t(spark, sf_dir, "check_requests").select("request_id", "node_id").distinct()
    return r.withColumn("version", ((F.col("node_id") + F.when(F.col("request_id") % 13 == 0, 15).otherwise(0)) % 16).cast("int"))


def slot_acquire(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slots for the misses without a node, in order of their ids."""
    r = _t(spark, sf_dir, "check_requests").where("node_id is null").select("request_id").distinct()
    return nodes.acquire(r, _nodes(spark, sf_dir), flat_room=FLAT_ROOM)


def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each request finds under its node id and version."""
    return nodes.point_lookup(_references(spark, sf_dir), _nodes(spark, sf_dir), NOW).select("request_id", "node_id", "outcome")


def decision_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decision on four candidates of each request: its node and the three before it."""
    r = _references(spark, sf_dir).where("node_id is not null")
    c = r.select(F.col("request_id").alias("query_id"), "node_id", "version", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("rnk"))
    c = c.select("query_id", "rnk", (F.col("node_id") - F.col("rnk") + 1).alias("node_id"), F.pmod(F.col("version") - F.col("rnk") + 1, F.lit(16)).alias("version"))
    return nodes.walk(c, _nodes(spark, sf_dir), NOW)


def commit_versioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcome of each commit against the versions and states of the nodes."""
    s = _t(spark, sf_dir, "set_requests")
    c = s.select("set_id", "node_id", ((F.col("node_id") + F.when(F.col("set_id") % 13 == 0, 15).otherwise(0)) % 16).cast("int").alias("version"), F.octet_length("uncached_payload").alias("n_bytes"), text.millis("ts").alias("at")).distinct()
    return nodes.commit(c, _nodes(spark, sf_dir), "set_id")


def zombie_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of clusters that don't belong there. A tenth of the nodes is where another cluster owns it."""
    n = _nodes(spark, sf_dir)
    at = F.coalesce((F.col("cluster_of") + F.when(F.col("node_id") % 10 == 3, 1).otherwise(0)) % 7, F.lit(0))
    return nodes.zombies(n.select("node_id", at.alias("cluster_id")), n)


def request_front(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status and source of the answer of each event as a request; its body's ``k`` is the prompt. Bodies of nine bytes or
    more count as too long here."""
    e = _t(spark, sf_dir, "events")
    i = F.col("event_id")
    r = e.select("event_id", F.when(i % 9 == 4, "GET").otherwise("POST").alias("method"), F.when(i % 17 != 3, F.col("props")).alias("body"), F.when(i % 4 == 1, "true").alias("only"), (i % 3 == 0).alias("cached"))
    r = r.withColumn("status", front.status(F.col("method"), F.col("body"), "k", 8))
    return r.select("event_id", "status", front.answer(F.col("status"), F.col("cached"), F.col("only")).alias("answer"))


_N = f"""n AS (SELECT node_id, CASE node_id % 5 WHEN 0 THEN 'DEAD' WHEN 1 THEN 'PENDING' ELSE 'READY' END AS state, node_id % 16 AS version, {NOW} - node_id % 40000 AS created_ms,
  CASE WHEN node_id % 11 <> 0 THEN node_id % 7 END AS cluster_of FROM (SELECT DISTINCT node_id FROM check_requests WHERE node_id IS NOT NULL))"""
_R = "r AS (SELECT request_id, node_id, (node_id + CASE WHEN request_id % 13 = 0 THEN 15 ELSE 0 END) % 16 AS version FROM (SELECT DISTINCT request_id, node_id FROM check_requests))"
_OUTCOME = f"CASE WHEN n.version = {{0}}.version AND state = 'READY' THEN 'HIT' WHEN n.version = {{0}}.version AND state = 'PENDING' AND {NOW} - created_ms <= {PENDING_MILLIS} THEN 'PENDING' ELSE 'MISS' END"

ORACLES = {
    "slot_acquire": f"""WITH {_N}, q AS (SELECT request_id, row_number() OVER (ORDER BY request_id) - 1 AS r FROM (SELECT DISTINCT request_id FROM check_requests WHERE node_id IS NULL)),
f AS (SELECT node_id, version, row_number() OVER (ORDER BY node_id) - 1 AS f FROM n WHERE state = 'DEAD')
SELECT request_id, node_id, ((version + 1 + greatest(0, r - {FLAT_ROOM})) % 16)::INT AS version, CASE WHEN node_id IS NULL OR r >= {FLAT_ROOM} THEN 'REJECTED' ELSE 'PENDING' END AS outcome FROM q LEFT JOIN f ON f.f = least(q.r, {FLAT_ROOM})""",
    "point_lookup": f"WITH {_N}, {_R} SELECT request_id, r.node_id, {_OUTCOME.format('r')} AS outcome FROM r LEFT JOIN n USING (node_id)",
    "decision_walk": f"""WITH {_N}, {_R}, c AS (SELECT request_id AS query_id, k AS rnk, node_id - k + 1 AS node_id, (version - k + 17) % 16 AS version FROM r CROSS JOIN (SELECT unnest([1, 2, 3, 4])::INT AS k) WHERE node_id IS NOT NULL),
o AS (SELECT query_id, rnk, c.node_id, {_OUTCOME.format('c')} AS outcome FROM c LEFT JOIN n USING (node_id))
SELECT query_id, coalesce(arg_min(outcome, rnk) FILTER (outcome <> 'MISS'), 'MISS') AS decision, arg_min(node_id, rnk) FILTER (outcome <> 'MISS') AS node_id, min(rnk) FILTER (outcome <> 'MISS') AS rnk FROM o GROUP BY 1""",
    "commit_versioned": f"""WITH {_N}, c AS (SELECT DISTINCT set_id, node_id, (node_id + CASE WHEN set_id % 13 = 0 THEN 15 ELSE 0 END) % 16 AS version, strlen(uncached_payload) AS b, epoch_us(ts) // 1000 AS tm FROM set_requests),
o AS (SELECT set_id, c.node_id, tm, CASE WHEN state IS NULL THEN 'UNKNOWN' WHEN coalesce(b, 0) <= 0 THEN 'EMPTY' WHEN b > {PAYLOAD_BYTES} THEN 'OVERSIZED' WHEN n.version IS DISTINCT FROM c.version THEN 'STALE' WHEN state <> 'PENDING' THEN 'NOT_PENDING' END AS bad FROM c LEFT JOIN n USING (node_id))
SELECT set_id, node_id, coalesce(bad, CASE WHEN row_number() OVER (PARTITION BY node_id, bad ORDER BY tm, set_id) = 1 THEN 'READY' ELSE 'LATE' END) AS outcome FROM o""",
    "zombie_members": f"""WITH {_N}, m AS (SELECT *, coalesce((cluster_of + CASE WHEN node_id % 10 = 3 THEN 1 ELSE 0 END) % 7, 0) AS cluster_id FROM n)
SELECT * FROM (SELECT node_id, cluster_id, CASE WHEN state = 'DEAD' THEN 'DEAD' WHEN cluster_of IS NULL THEN 'UNOWNED' WHEN cluster_of <> cluster_id THEN 'ELSEWHERE' END AS reason FROM m) WHERE reason IS NOT NULL""",
    "request_front": """WITH s AS (SELECT event_id, event_id % 3 = 0 AS cached, event_id % 4 = 1 AS cache_only, CASE WHEN event_id % 9 = 4 THEN 405 WHEN event_id % 17 = 3 OR strlen(props) > 8 OR coalesce(json_extract_string(props, '$.k'), '') = '' THEN 400 ELSE 200 END AS status FROM events)
SELECT event_id, status::INT AS status, CASE WHEN status <> 200 THEN 'ERROR' WHEN cached THEN 'CACHE' WHEN cache_only THEN 'NOT_FOUND' ELSE 'UPSTREAM' END AS answer FROM s""",
}

QUERIES = {f.__name__: f for f in (slot_acquire, point_lookup, decision_walk, commit_versioned, zombie_members, request_front)}
