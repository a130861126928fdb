"""The life of cache nodes as set operators: slots, point lookups, the walk over candidates, and commits, with versions.

Nodes are (node_id, state, version, created_ms, ...) with one row per id. A version counts the lives of a slot in four
bits; what refers to a node names its version, so a slot that was taken anew isn't mistaken for its former owner.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.bits import next_version
from ..model import PAYLOAD_BYTES, PENDING_MILLIS
from ..scale import lookup, running


def _numbered(df: DataFrame, row_id: str, out: str) -> DataFrame:
    """Place of each row in order of its id, from 0; no task holds all rows (ids in ranges, see ``running``)."""
    return running(df, [], row_id, F.lit(1), "_n").withColumn(out, F.col("_n") - 1).drop("_n")


def acquire(requests: DataFrame, nodes: DataFrame, row_id: str = "request_id", flat_room: int = 4096) -> DataFrame:
    """(row_id, node_id, version, outcome): slots for requests in order of id, dead nodes first by their id.

    A slot is a DEAD node; the request gets it PENDING with the next version. The flat tier has room for ``flat_room``
    new nodes: the requests after those try the next free slot one after the other and are REJECTED, and each raises
    its version, as its vector was overwritten. Without a free slot a request is REJECTED without one (node_id null).
    Null ids take no part; ids are unique on both sides.
    """
    asked = _numbered(requests.where(F.col(row_id).isNotNull()).select(row_id), row_id, "_r")
    free = _numbered(nodes.where("state = 'DEAD' and node_id is not null").select("node_id", "version"), "node_id", "_f")
    slot = asked.withColumn("_f", F.least(F.col("_r"), F.lit(flat_room)))
    within, beyond = slot.where(F.col("_r") < flat_room), slot.where(F.col("_r") >= flat_room)
    got = within.join(free, "_f", "left").select(row_id, "node_id", next_version(F.col("version")).alias("version"), F.when(F.col("node_id").isNull(), "REJECTED").otherwise("PENDING").alias("outcome"))
    last = free.where(F.col("_f") == flat_room)  # one row at most
    tried = beyond.join(F.broadcast(last), "_f", "left").select(row_id, "node_id", (F.col("version") + F.col("_r") - flat_room + 1).bitwiseAND(F.lit(15)).cast("int").alias("version"), F.lit("REJECTED").alias("outcome"))
    return got.select(row_id, "node_id", F.col("version").cast("int").alias("version"), "outcome").union(tried)


def point_lookup(references: DataFrame, nodes: DataFrame, now_ms: int, life_ms: int = PENDING_MILLIS) -> DataFrame:
    """``references`` (node_id, version, ...) with ``outcome``: HIT for a READY node of that very version, PENDING for a
    pending one not older than ``life_ms``, else MISS (also for unknown and null ids). Hot nodes are split off."""
    by = nodes.where("node_id is not null").select("node_id", F.col("state").alias("_s"), F.col("version").alias("_v"), F.col("created_ms").alias("_c"))
    found = lookup(references, by, "node_id")
    live = (F.col("_v") == F.col("version")) & (F.col("_s") != "DEAD")
    young = F.lit(now_ms) - F.col("_c") <= life_ms
    outcome = F.when(live & (F.col("_s") == "READY"), "HIT").when(live & (F.col("_s") == "PENDING") & young, "PENDING").otherwise("MISS")
    return found.withColumn("outcome", outcome).drop("_s", "_v", "_c")


def walk(candidates: DataFrame, nodes: DataFrame, now_ms: int, life_ms: int = PENDING_MILLIS) -> DataFrame:
    """(query_id, decision, node_id, rnk): the first candidate (query_id, rnk, node_id, version) that isn't a miss decides.

    So a live pending node keeps later ready ones from being used. A query without such a candidate is a MISS.
    """
    judged = point_lookup(candidates.where("query_id is not null").select("query_id", "rnk", "node_id", "version"), nodes, now_ms, life_ms)
    first = judged.groupBy("query_id").agg(F.min(F.when(F.col("outcome") != "MISS", F.struct("rnk", "node_id", "outcome"))).alias("x"))
    return first.select("query_id", F.coalesce("x.outcome", F.lit("MISS")).alias("decision"), F.col("x.node_id").alias("node_id"), F.col("x.rnk").alias("rnk"))


def commit(commits: DataFrame, nodes: DataFrame, row_id: str = "commit_id", most_bytes: int = PAYLOAD_BYTES) -> DataFrame:
    """(row_id, node_id, outcome) of commits (row_id, node_id, version, n_bytes, at).

    READY for the first good one of a node in order of (at, row_id); LATE for further ones. Before that, in this order:
    UNKNOWN node, EMPTY or OVERSIZED payload, STALE version, NOT_PENDING node.
    """
    by = nodes.where("node_id is not null").select("node_id", F.col("state").alias("_s"), F.col("version").alias("_v"))
    c = lookup(commits.where(F.col(row_id).isNotNull()).select(row_id, "node_id", "version", "n_bytes", "at"), by, "node_id")
    n = F.coalesce("n_bytes", F.lit(0))
    bad = F.when(F.col("_s").isNull(), "UNKNOWN").when(n <= 0, "EMPTY").when(n > most_bytes, "OVERSIZED").when(~F.col("_v").eqNullSafe(F.col("version")), "STALE").when(F.col("_s") != "PENDING", "NOT_PENDING")
    c = c.select(row_id, "node_id", "at", bad.alias("_bad"))
    first = c.where("_bad is null").groupBy("node_id").agg(F.min(F.struct("at", row_id)).alias("x")).select("node_id", F.col(f"x.{row_id}").alias(row_id), F.lit(True).alias("_first"))
    out = c.join(first, ["node_id", row_id], "left")  # the row's id in the key spreads hot nodes
    return out.select(row_id, "node_id", F.coalesce("_bad", F.when(F.col("_first"), "READY").otherwise("LATE")).alias("outcome"))


def zombies(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node_id, cluster_id, reason): members (node_id, cluster_id) that don't belong where they are: DEAD or unknown nodes,
    UNOWNED ones (no cluster owns them) and ones that ELSEWHERE own. ``nodes`` has (node_id, state, cluster_of)."""
    by = nodes.where("node_id is not null").select("node_id", F.col("state").alias("_s"), F.col("cluster_of").alias("_o"))
    m = lookup(members.select("node_id", "cluster_id"), by, "node_id")
    reason = F.when(F.coalesce("_s", F.lit("DEAD")) == "DEAD", "DEAD").when(F.col("_o").isNull(), "UNOWNED").when(F.col("_o") != F.col("cluster_id"), "ELSEWHERE")
    return m.select("node_id", "cluster_id", reason.alias("reason")).where("reason is not null")
