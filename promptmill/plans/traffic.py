"""Queries on requests and stored payloads: exact cache, gates, admission, coalescing, commits, placement, eviction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import bits, text
from ..model import EXACT_PAYLOAD_BYTES, PAYLOAD_HEADER_BYTES, PENDING_MILLIS
from ..operators import admission, cache, lifecycle
from ..scale import lookup, running

DAY = 86_400_000
RING = 1 << 20


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def exact_cache_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cache.repeats(_t(spark, sf_dir, "check_requests"), "request_id", "prompt")


def exact_cache_put(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact cache with payloads below 600 bytes only; exact_cache_put_full has the operator's limit."""
    return cache.exact_put(_t(spark, sf_dir, "cache_records"), "prompt", "payload", "loaded_at", "record_id", 600)


def exact_cache_put_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cache.exact_put(_t(spark, sf_dir, "cache_records"), "prompt", "payload", "loaded_at", "record_id", EXACT_PAYLOAD_BYTES)


def exact_cache_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every request with the cached record of its very prompt, if there is one."""
    put = cache.exact_put(_t(spark, sf_dir, "cache_records"), "prompt", "payload", "loaded_at", "record_id")
    got = cache.exact_hits(_t(spark, sf_dir, "check_requests"), put.select("hash", "record_id"), "request_id", "prompt")
    return got.select("request_id", "record_id", F.col("record_id").isNotNull().alias("hit"))


def prompt_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _t(spark, sf_dir, "check_requests")
    p = F.col("prompt")
    return r.select("request_id", F.octet_length(p).alias("n_bytes"), text.token_count(p).alias("n_tokens"), cache.gate(p, 400, 40).alias("gate")).distinct()


def admission_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events").select("event_id", "user_id", text.millis("ts").alias("at"))
    return admission.admit(e, "user_id", "at", "event_id", DAY, 2)


def admission_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests and denials of each client at 30 requests an hour."""
    r = _t(spark, sf_dir, "check_requests").select("request_id", "client_ip", text.millis("ts").alias("at")).distinct()
    got = admission.admit(r, "client_ip", "at", "request_id", 3_600_000, 30)
    return got.groupBy("client_ip").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("admitted")).alias("denied"))


def _clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _t(spark, sf_dir, "check_requests").where("client_ip is not null")
    return r.groupBy("client_ip").agg(F.max(text.millis("ts")).alias("last"), F.count(F.lit(1)).alias("n"))


def admission_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = bits.fnv1a(F.col("client_ip"))
    return _clients(spark, sf_dir).select("client_ip", h.alias("hash"), bits.shard(h).alias("shard"))


def idle_clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clients without a request for a day before the last one of all."""
    c = _clients(spark, sf_dir)
    idle = F.lit(c.agg(F.max("last")).first()[0]).cast("bigint") - F.col("last")
    return c.select("client_ip", idle.alias("idle_ms")).where(F.col("idle_ms") > DAY)


def lfu_victim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of five sampled clients of each shard (by hash) the one with the fewest requests, of equals the one sampled first."""
    c = _clients(spark, sf_dir).withColumn("shard", bits.shard(bits.fnv1a(F.col("client_ip"))))
    w = Window.partitionBy("shard").orderBy(F.md5("client_ip"))
    few = c.withColumn("r", F.row_number().over(w)).where("r <= 5")
    return few.groupBy("shard").agg(F.min(F.struct("n", "r", "client_ip")).alias("x")).select("shard", F.col("x.client_ip"), F.col("x.n"))


def client_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _clients(spark, sf_dir)
    ip = F.col("client_ip")
    none = F.lit(None).cast("string")
    return c.select(ip, text.client_key(F.concat(ip, F.lit(" , 10.9.9.9")), F.lit("1.1.1.1:80")).alias("forwarded"), text.client_key(none, F.concat(ip, F.lit(":8080"))).alias("remote"), text.client_key(F.lit(""), ip).alias("raw"))


def _commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _t(spark, sf_dir, "set_requests").where("node_id is not null")
    return s.select("set_id", "node_id", text.millis("ts").alias("at"), "success", F.octet_length("uncached_payload").alias("n_bytes")).distinct()


def _pioneers(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _t(spark, sf_dir, "check_requests").where("check_state = 'MISS' and node_id is not null")
    return r.groupBy("node_id").agg(F.min(F.struct(text.millis("ts").alias("at"), "request_id")).alias("x")).select("node_id", F.col("x.at").alias("missed_at"), F.col("x.request_id").alias("pioneer_id"))


def coalesced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Followers of a pending node with the pioneer that asked first, and whether they came while its call was in flight."""
    r = _t(spark, sf_dir, "check_requests").where("check_state = 'PENDING' and node_id is not null").select("request_id", "node_id", text.millis("ts").alias("at")).distinct()
    first = _commits(spark, sf_dir).groupBy("node_id").agg(F.min("at").alias("set_at"))
    got = lookup(r, _pioneers(spark, sf_dir).join(first, "node_id", "left"), "node_id")
    flight = (F.col("at") >= F.col("missed_at")) & (F.col("set_at").isNull() | (F.col("at") <= F.col("set_at")))
    return got.select("request_id", "node_id", "pioneer_id", F.coalesce(flight, F.lit(False)).alias("in_flight"))


def coalesce_savings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upstream calls made and saved by waiting (one row)."""
    r = _t(spark, sf_dir, "check_requests").where("node_id is not null and check_state in ('MISS', 'PENDING')").select("request_id", "check_state", "node_id").distinct()
    return r.agg(F.count(F.lit(1)).alias("requests"), F.countDistinct("node_id").alias("calls"), (F.count(F.lit(1)) - F.countDistinct("node_id")).alias("saved"))


def commit_ready(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcome of each commit: READY for the first successful one of a node, STALE after it, FAILED without success or payload."""
    c = _commits(spark, sf_dir).withColumn("ok", F.coalesce("success", F.lit(False)) & (F.coalesce("n_bytes", F.lit(0)) > 0))
    first = c.where("ok").groupBy("node_id").agg(F.min(F.struct("at", "set_id")).alias("x")).select("node_id", F.col("x.set_id").alias("set_id"), F.lit(True).alias("first"))
    out = c.join(first, ["node_id", "set_id"], "left")
    return out.select("set_id", "node_id", F.when(F.col("first"), "READY").when(F.col("ok"), "STALE").otherwise("FAILED").alias("outcome"))


def pending_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes with the time from miss to first commit, and whether they expired before it."""
    first = _commits(spark, sf_dir).groupBy("node_id").agg(F.min("at").alias("set_at"))
    got = _pioneers(spark, sf_dir).join(first, "node_id", "left").withColumn("waited_ms", F.col("set_at") - F.col("missed_at"))
    return got.select("node_id", "waited_ms", (F.col("waited_ms").isNull() | (F.col("waited_ms") > PENDING_MILLIS)).alias("expired"))


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node_id, n_bytes, set_at, hot): stored nodes; hot if one was read after it was set."""
    s = _commits(spark, sf_dir).where("n_bytes > 0").groupBy("node_id").agg(F.min(F.struct("at", "set_id", "n_bytes")).alias("x"))
    s = s.select("node_id", F.col("x.n_bytes").alias("n_bytes"), F.col("x.at").alias("set_at"))
    reads = _t(spark, sf_dir, "check_requests").where("check_state = 'HIT'").groupBy("node_id").agg(F.max(text.millis("ts")).alias("read_at"))
    return s.join(reads, "node_id", "left").select("node_id", "n_bytes", "set_at", F.coalesce(F.col("read_at") > F.col("set_at"), F.lit(False)).alias("hot"))


def clock_one_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entries(spark, sf_dir).select("node_id", F.when(F.col("hot"), "MOVED").otherwise("EVICTED").alias("fate"))


def clock_evict(spark: SparkSession, sf_dir: str, rings: int = 16, capacity: int = 1_000_000) -> DataFrame:
    """Second-chance eviction down to ``capacity`` bytes in all, in ``rings`` rings by hash that have equal parts of it.

    Neither depends on the number of nodes. A ring is one task, so larger tables need more rings.
    """
    e = _entries(spark, sf_dir).select("node_id", "n_bytes", F.lit("READY").alias("state"), "hot")
    return lifecycle.clock(e.withColumn("ring", F.pmod(F.xxhash64("node_id"), F.lit(rings)).cast("int")), "ring", "node_id", capacity // rings).drop("ring")


def _payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _commits(spark, sf_dir).where("n_bytes is not null")


def flat_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes in order of their first commit by id: the first 1000 wait in the flat tier for compaction, oldest first."""
    first = _commits(spark, sf_dir).groupBy("node_id").agg(F.min("set_id").alias("set_id"))
    return lifecycle.fifo(first, "set_id", 1000).select("node_id", "place", "admitted")


def ring_occupancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _t(spark, sf_dir, "set_requests").where("uncached_payload is not null").select("set_id", "upstream", F.octet_length("uncached_payload").alias("n_bytes")).distinct()
    return s.groupBy("upstream").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("n_bytes") + PAYLOAD_HEADER_BYTES).alias("bytes"))


def payload_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = lifecycle.placement(_payloads(spark, sf_dir).select("set_id", "n_bytes"), "set_id", "n_bytes")
    at = F.col("voffset") + PAYLOAD_HEADER_BYTES
    return p.select("set_id", "voffset", bits.ring_index(F.col("voffset"), RING).alias("ring_at"), bits.first_chunk(at, F.col("n_bytes"), RING).cast("bigint").alias("first_chunk"))


def payload_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored payloads and whether their node still points to their offset (it points to its last one's)."""
    p = _payloads(spark, sf_dir).select("set_id", "node_id", "n_bytes")
    p = p.join(lifecycle.placement(p.select("set_id", "n_bytes"), "set_id", "n_bytes").select("set_id", "voffset"), "set_id")
    nodes = p.groupBy("node_id").agg(F.max_by("voffset", "set_id").alias("pointer"))
    return lookup(p, nodes, "node_id").select("set_id", "node_id", (F.col("voffset") == F.col("pointer")).alias("live"))


def _fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events").select(F.col("event_id").alias("e"))
    return e.select("e", (F.col("e") % 3).alias("state"), (F.col("e") % 2).alias("hot"), (F.col("e") % 20).alias("version"), (F.col("e") * 977).alias("length"), (F.col("e") * 7919007).alias("offset"))


def control_block_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _fields(spark, sf_dir)
    return f.select(F.col("e").alias("event_id"), bits.pack(*[F.col(c) for c in ("state", "hot", "version", "length", "offset")]).alias("block"))


def control_block_unpack(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = control_block_pack(spark, sf_dir).withColumn("x", bits.unpack(F.col("block")))
    return b.select("event_id", "x.state", "x.hot", "x.version", "x.length", "x.offset", bits.next_version(F.col("x.version")).alias("next_version"))


def hazard_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events")
    a, n = F.get_json_object("props", "$.k").cast("bigint") * 10, F.floor("value").cast("bigint") * 5
    return e.select("event_id", bits.overlaps(a, n, F.col("event_id") % 97 * 10, F.lit(100)).alias("overlap"))


def shed_breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The commit at which failures first exceed 3 % of at least 100 completed ones (by set_id)."""
    c = _t(spark, sf_dir, "set_requests").select("set_id", "success").distinct()
    run = running(c, [], "set_id", F.lit(1), "completed")
    run = running(run, [], "set_id", F.when(F.coalesce("success", F.lit(False)), 0).otherwise(1), "shed")
    hit = run.where((F.col("completed") >= 100) & (F.col("shed") > 0.03 * F.col("completed")))
    return hit.agg(F.min(F.struct("set_id", "completed", "shed")).alias("x")).select("x.set_id", "x.completed", "x.shed")


def traffic_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _t(spark, sf_dir, "check_requests").select("request_id", "ts", "check_state").distinct()
    return r.groupBy(F.date_trunc("hour", F.col("ts").cast("timestamp_ntz")).cast("timestamp_ntz").alias("hour"), "check_state").agg(F.count(F.lit(1)).alias("n"))


_C = "c AS (SELECT DISTINCT set_id, node_id, (epoch_us(ts) // 1000) AS tm, success, strlen(uncached_payload)::INT AS n_bytes FROM set_requests WHERE node_id IS NOT NULL)"
_P = "p AS (SELECT node_id, min_by(request_id, ((epoch_us(ts) // 1000), request_id)) AS pioneer_id, min((epoch_us(ts) // 1000)) AS missed_at FROM check_requests WHERE check_state = 'MISS' AND node_id IS NOT NULL GROUP BY 1)"
_F = "f AS (SELECT node_id, min(tm) AS set_at FROM c GROUP BY 1)"
_K = "k AS (SELECT client_ip, max((epoch_us(ts) // 1000)) AS last, count(*) AS n FROM check_requests WHERE client_ip IS NOT NULL GROUP BY 1)"
_FNV = "list_reduce(list_prepend(2166136261::BIGINT, list_transform(range(1, length(client_ip) + 1), lambda i: ascii(substr(client_ip, i, 1))::BIGINT)), lambda h, b: (xor(h, b) * 16777619) % 4294967296)"
_PUT = """put AS (SELECT hash, record_id, n_bytes FROM (SELECT sha256(prompt) AS hash, record_id, strlen(payload) AS n_bytes,
  row_number() OVER (PARTITION BY sha256(prompt) ORDER BY coalesce(loaded_at, TIMESTAMP '0001-01-01') DESC, record_id DESC) AS r
  FROM cache_records WHERE prompt IS NOT NULL AND strlen(payload) < {0}) WHERE r = 1)"""
_TOKENS = r"len(regexp_extract_all({0}, '[\p{{L}}\p{{N}}]+|[^\s\p{{L}}\p{{N}}]')) + 2"
_E = """e AS (SELECT s.node_id, coalesce(r.read_at > s.tm, false) AS hot FROM (SELECT node_id, min(tm) AS tm FROM c WHERE n_bytes > 0 GROUP BY 1) s
  LEFT JOIN (SELECT node_id, max((epoch_us(ts) // 1000)) AS read_at FROM check_requests WHERE check_state = 'HIT' GROUP BY 1) r USING (node_id))"""


def _limiter(source: str, key: str, row: str, width: int, limit: int) -> str:
    return f"""s AS (SELECT {row} AS i, {key} AS k, tm AS t, row_number() OVER (PARTITION BY {key} ORDER BY tm, {row}) AS rn FROM ({source}) WHERE {key} IS NOT NULL),
w AS (
  SELECT i, k, rn, t AS ws, 0::BIGINT AS pv, 1::BIGINT AS cu, true AS ok FROM s WHERE rn = 1
  UNION ALL
  SELECT i, k, rn, ws, pv, cu + CASE WHEN ok THEN 1 ELSE 0 END, ok FROM (
    SELECT *, floor(cu + pv * (({width} - (t - ws))::DOUBLE / {width})) < {limit} AS ok FROM (
      SELECT s.i, s.k, s.rn, s.t, w.ws + (s.t - w.ws) // {width} * {width} AS ws,
        CASE (s.t - w.ws) // {width} WHEN 0 THEN w.pv WHEN 1 THEN w.cu ELSE 0 END AS pv, CASE WHEN (s.t - w.ws) // {width} = 0 THEN w.cu ELSE 0 END AS cu
      FROM w JOIN s ON s.k = w.k AND s.rn = w.rn + 1)))"""


ORACLES = {
    "exact_cache_lookup": "SELECT request_id, hash, request_id <> min(request_id) OVER (PARTITION BY hash) AS hit FROM (SELECT DISTINCT request_id, sha256(prompt) AS hash FROM check_requests WHERE prompt IS NOT NULL)",
    "exact_cache_put": f"WITH {_PUT.format(600)} SELECT * FROM put",
    "exact_cache_put_full": f"WITH {_PUT.format(65536)} SELECT * FROM put",
    "exact_cache_hits": f"WITH {_PUT.format(65536)} SELECT request_id, record_id, record_id IS NOT NULL AS hit FROM (SELECT DISTINCT request_id, sha256(prompt) AS hash FROM check_requests WHERE prompt IS NOT NULL) LEFT JOIN put USING (hash)",
    "prompt_gate": f"""SELECT DISTINCT request_id, strlen(prompt)::INT AS n_bytes, ({_TOKENS.format("prompt")})::INT AS n_tokens,
CASE WHEN prompt IS NULL OR prompt = '' THEN 'EMPTY' WHEN strlen(prompt) > 400 THEN 'BYPASS' WHEN {_TOKENS.format("prompt")} > 40 THEN 'OVER_TOKENS' ELSE 'PASS' END AS gate FROM check_requests""",
    "admission_sliding": f"WITH RECURSIVE {_limiter('SELECT event_id, user_id, (epoch_us(ts) // 1000) AS tm FROM events', 'user_id', 'event_id', DAY, 2)} SELECT i AS event_id, k AS user_id, ok AS admitted FROM w",
    "admission_requests": f"WITH RECURSIVE {_limiter('SELECT DISTINCT request_id, client_ip, (epoch_us(ts) // 1000) AS tm FROM check_requests', 'client_ip', 'request_id', 3_600_000, 30)} SELECT k AS client_ip, count(*) AS n, count(*) FILTER (NOT ok) AS denied FROM w GROUP BY 1",
    "admission_shards": f"WITH {_K} SELECT client_ip, {_FNV} AS hash, ({_FNV} & 255)::INT AS shard FROM k",
    "idle_clients": f"WITH {_K} SELECT client_ip, (SELECT max(last) FROM k) - last AS idle_ms FROM k WHERE (SELECT max(last) FROM k) - last > {DAY}",
    "lfu_victim": f"WITH {_K}, s AS (SELECT client_ip, n, ({_FNV} & 255)::INT AS shard, row_number() OVER (PARTITION BY {_FNV} & 255 ORDER BY md5(client_ip)) AS r FROM k) SELECT shard, min_by(client_ip, (n, r)) AS client_ip, min(n) AS n FROM s WHERE r <= 5 GROUP BY shard",
    "client_key": f"WITH {_K} SELECT client_ip, client_ip AS forwarded, client_ip AS remote, client_ip AS raw FROM k",
    "coalesced": f"WITH {_C}, {_P}, {_F} SELECT DISTINCT r.request_id, r.node_id, p.pioneer_id, coalesce(epoch_ms(r.ts) >= p.missed_at AND (f.set_at IS NULL OR epoch_ms(r.ts) <= f.set_at), false) AS in_flight FROM check_requests r LEFT JOIN p USING (node_id) LEFT JOIN f USING (node_id) WHERE r.check_state = 'PENDING' AND r.node_id IS NOT NULL",
    "coalesce_savings": "SELECT count(*) AS requests, count(DISTINCT node_id) AS calls, count(*) - count(DISTINCT node_id) AS saved FROM (SELECT DISTINCT request_id, check_state, node_id FROM check_requests WHERE node_id IS NOT NULL AND check_state IN ('MISS', 'PENDING'))",
    "commit_ready": f"WITH {_C}, o AS (SELECT *, coalesce(success, false) AND coalesce(n_bytes, 0) > 0 AS ok FROM c) SELECT set_id, node_id, CASE WHEN NOT ok THEN 'FAILED' WHEN row_number() OVER (PARTITION BY node_id, ok ORDER BY tm, set_id) = 1 THEN 'READY' ELSE 'STALE' END AS outcome FROM o",
    "pending_sweep": f"WITH {_C}, {_P}, {_F} SELECT node_id, set_at - missed_at AS waited_ms, set_at IS NULL OR set_at - missed_at > {PENDING_MILLIS} AS expired FROM p LEFT JOIN f USING (node_id)",
    "clock_one_pass": f"WITH {_C}, {_E} SELECT node_id, CASE WHEN hot THEN 'MOVED' ELSE 'EVICTED' END AS fate FROM e",
    "flat_tier": f"WITH {_C}, g AS (SELECT node_id, min(set_id) AS set_id FROM c GROUP BY 1) SELECT node_id, row_number() OVER (ORDER BY set_id) AS place, row_number() OVER (ORDER BY set_id) <= 1000 AS admitted FROM g",
    "ring_occupancy": "SELECT upstream, count(*) AS n, sum(b + 12)::BIGINT AS bytes FROM (SELECT DISTINCT set_id, upstream, strlen(uncached_payload) AS b FROM set_requests WHERE uncached_payload IS NOT NULL) GROUP BY 1",
    "payload_placement": f"""WITH {_C}, o AS (SELECT set_id, n_bytes, (sum(n_bytes + 12) OVER (ORDER BY set_id) - n_bytes - 12)::BIGINT AS voffset FROM c WHERE n_bytes IS NOT NULL)
SELECT set_id, voffset, voffset & {RING - 1} AS ring_at, least(n_bytes, {RING} - ((voffset + 12) & {RING - 1})) AS first_chunk FROM o""",
    "payload_orphans": f"WITH {_C} SELECT set_id, node_id, set_id = max(set_id) OVER (PARTITION BY node_id) AS live FROM c WHERE n_bytes IS NOT NULL",
    "control_block_pack": """SELECT event_id, CASE WHEN b >= 9223372036854775808 THEN b - 18446744073709551616 ELSE b END::BIGINT AS block FROM (
SELECT event_id, (event_id % 3 & 3)::HUGEINT * 4611686018427387904 + (event_id % 2)::HUGEINT * 2305843009213693952 + (event_id % 20 & 15)::HUGEINT * 144115188075855872 + (event_id * 977 & 2097151)::HUGEINT * 68719476736 + (event_id * 7919007 & 68719476735)::HUGEINT AS b FROM events)""",
    "control_block_unpack": "SELECT event_id, (event_id % 3)::INT AS state, (event_id % 2)::INT AS hot, (event_id % 20 & 15)::INT AS version, (event_id * 977 & 2097151)::INT AS length, event_id * 7919007 & 68719476735 AS \"offset\", ((event_id % 20 & 15) + 1 & 15)::INT AS next_version FROM events",
    "hazard_overlap": "SELECT event_id, a < b + 100 AND b < a + n AS overlap FROM (SELECT event_id, json_extract_string(props, '$.k')::BIGINT * 10 AS a, floor(value)::BIGINT * 5 AS n, event_id % 97 * 10 AS b FROM events)",
    "shed_breaker": """WITH c AS (SELECT DISTINCT set_id, success FROM set_requests), r AS (SELECT set_id, count(*) OVER (ORDER BY set_id) AS completed, count(*) FILTER (success IS NOT TRUE) OVER (ORDER BY set_id) AS shed FROM c)
SELECT min(set_id) AS set_id, min_by(completed, set_id) AS completed, min_by(shed, set_id) AS shed FROM r WHERE completed >= 100 AND shed > 0.03 * completed""",
    "traffic_windows": "SELECT date_trunc('hour', ts) AS hour, check_state, count(*) AS n FROM (SELECT DISTINCT request_id, ts, check_state FROM check_requests) GROUP BY 1, 2",
}

QUERIES = {
    f.__name__: f
    for f in (
        exact_cache_lookup, exact_cache_put, exact_cache_put_full, exact_cache_hits, prompt_gate, admission_sliding, admission_requests, admission_shards, idle_clients, lfu_victim, client_key, coalesced, coalesce_savings,
        commit_ready, pending_sweep, clock_one_pass, clock_evict, flat_tier, ring_occupancy, payload_placement, payload_orphans, control_block_pack, control_block_unpack, hazard_overlap, shed_breaker, traffic_windows,
    )
}
