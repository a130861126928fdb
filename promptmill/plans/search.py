"""Queries on vectors: exact and clustered search, decisions, k-means. Searches ask with the rows whose id is divisible by 100."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cache, encode, ivf, vectors
from ..scale import running, stage

#: Shares of the clusters that are probed: what reaches a recall of 0.9 on these vectors, which are random and have no
#: clusters of their own. For a lookup the nearest vector counts if it is very near; for the ten nearest all ten count.
LOOKUP_SHARE, TOP_SHARE = (1, 8), (5, 6)
DIMENSIONS = 64
#: Share of the total weight at which the next seed is picked: a pseudo-random number from a hash.
SHARE = int(hashlib.md5(b"seed-1").hexdigest()[:8], 16) / 2**32


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return e.select("vec_id", vectors.doubles(F.col("embedding")).alias("v"))


def _queries(v: DataFrame) -> DataFrame:
    return v.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id")


def _scored(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.round("score", 6))


def topk_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    return _scored(vectors.top_k(_queries(v), v))


def topk_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    return _scored(vectors.top_k(_queries(v), v).where("score >= 0.3"))


def _derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request vector for each stored one: a blend of it with the next, in ten strengths."""
    v = _vectors(spark, sf_dir)
    n = v.count()
    nxt = v.select(F.pmod(F.col("vec_id") - 1, F.lit(n)).alias("vec_id"), F.col("v").alias("w"))
    weight = 0.5 - 0.5 * ((F.col("vec_id") + F.floor(F.col("vec_id") / 100)) % 10) / 9
    return v.join(nxt, "vec_id").select(F.col("vec_id").alias("query_id"), vectors.blend(F.col("v"), F.col("w"), weight).alias("v"))


def _centroids(v: DataFrame) -> DataFrame:
    return ivf.bootstrap(v, ivf.clusters_for(v.count()))


def _probes(centroids: DataFrame, share: tuple[int, int] | None) -> int:
    """How many clusters a share of them is; one if there is no share."""
    return -(-centroids.count() * share[0] // share[1]) if share else 1


def _nearest(spark: SparkSession, sf_dir: str, share: tuple[int, int] | None) -> DataFrame:
    v = _vectors(spark, sf_dir)
    c = _centroids(v)
    return ivf.search(_derived(spark, sf_dir), ivf.assign(v, c).drop("score"), c, k=1, nprobe=_probes(c, share))


def lookup_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HIT or MISS for every request vector, by a probe of the nearest eighth of the clusters (see lookup_recall)."""
    return cache.decide(_nearest(spark, sf_dir, LOOKUP_SHARE))


def lookup_decision_nprobe1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by a probe of the nearest cluster alone: the reference-compatible variant, which misses hits."""
    return cache.decide(_nearest(spark, sf_dir, None))


def lookup_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits that exact search finds for the request vectors, and how many of them the index finds, by clusters probed."""
    v = _vectors(spark, sf_dir)
    exact = stage(vectors.top_k(_derived(spark, sf_dir), v, 1).where("score >= 0.85").select("query_id"), "hits")
    out = None
    for name, share in (("nprobe1", None), ("lookup_decision", LOOKUP_SHARE)):
        got = _nearest(spark, sf_dir, share).where("rnk = 1 and score >= 0.85").select("query_id", F.lit(1).alias("got"))
        part = exact.join(got, "query_id", "left").agg(F.lit(name).alias("search"), F.count(F.lit(1)).alias("hits"), F.count("got").alias("found"))
        out = part if out is None else out.union(part)
    return out.withColumn("recall", F.round(F.col("found") / F.col("hits"), 6))


def lookup_decision_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by exact search, for the stated query set."""
    return cache.decide(vectors.top_k(_derived(spark, sf_dir).where("query_id % 100 = 0"), _vectors(spark, sf_dir), 1))


def lookup_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    return cache.replay(ivf.assign(v, _centroids(v)), 0.3)


def ivf_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _centroids(_vectors(spark, sf_dir)).select("cluster_id", "vec_id")


def ivf_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    return _scored(ivf.assign(v, _centroids(v)).drop("v"))


def ivf_cluster_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    return ivf.assign(v, _centroids(v)).groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"))


def _probed(spark: SparkSession, sf_dir: str, share: tuple[int, int] | None) -> DataFrame:
    v = _vectors(spark, sf_dir)
    c = _centroids(v)
    return _scored(ivf.search(_queries(v), ivf.assign(v, c).drop("score"), c, nprobe=_probes(c, share)))


def ivf_probe_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest in the nearest five sixths of the clusters (see ivf_recall)."""
    return _probed(spark, sf_dir, TOP_SHARE)


def ivf_probe_topk_nprobe1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest in the nearest cluster alone: the reference-compatible variant, of low recall."""
    return _probed(spark, sf_dir, None)


def _two_tiers(spark: SparkSession, sf_dir: str, share: tuple[int, int] | None) -> DataFrame:
    v = _vectors(spark, sf_dir)
    c = _centroids(v)
    flat, rest = v.where("vec_id % 10 = 5"), v.where("vec_id % 10 <> 5")
    found = vectors.top_k(_queries(v), flat).unionByName(ivf.search(_queries(v), ivf.assign(rest, c).drop("score"), c, nprobe=_probes(c, share)))
    return _scored(vectors.merge(found, 10))


def two_tier_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best of a flat tier (every tenth vector) and of five sixths of a clustered tier (the rest) in one list."""
    return _two_tiers(spark, sf_dir, TOP_SHARE)


def two_tier_candidates_nprobe1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the nearest cluster of the clustered tier alone: the reference-compatible variant."""
    return _two_tiers(spark, sf_dir, None)


def ivf_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the exact ten nearest that the index finds, by sixths of the clusters probed (0: one cluster)."""
    v = _vectors(spark, sf_dir)
    c = _centroids(v)
    q = _queries(v)
    exact = stage(vectors.top_k(q, v).select("query_id", "vec_id"), "exact")
    members = stage(ivf.assign(v, c).drop("score"), "members")
    out = None
    for sixths in (0, 1, 3, 5):
        got = ivf.search(q, members, c, nprobe=_probes(c, (sixths, 6) if sixths else None)).select("query_id", "vec_id", F.lit(1).alias("got"))
        part = exact.join(got, ["query_id", "vec_id"], "left").agg(F.lit(sixths).alias("sixths"), F.round(F.count("got") / F.count(F.lit(1)), 6).alias("recall"))
        out = part if out is None else out.union(part)
    return out


def ivf_capacity_overflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    return ivf.capacity_positions(ivf.assign(v, _centroids(v))).where("pos > 20")


def kmeans_lloyd_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    new = ivf.lloyd(ivf.assign(v, _centroids(v)))
    return new.select("cluster_id", F.posexplode("v").alias("dim", "value")).withColumn("value", F.round("value", 6) + 0.0)  # no negative zero


def kmeans_movement(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    old = _centroids(v)
    new = ivf.lloyd(ivf.assign(v, old)).withColumnRenamed("v", "w")
    return old.join(new, "cluster_id").agg(F.round(F.sum(vectors.chord(vectors.dot(F.col("v"), F.col("w")))), 6).alias("movement"))


def ivf_reassign_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors whose nearest centroid changes with a Lloyd step."""
    v = _vectors(spark, sf_dir)
    first = stage(ivf.assign(v, _centroids(v)), "assigned")
    new = stage(ivf.lloyd(first), "centroids")
    then = ivf.assign(v, new).select("vec_id", F.col("cluster_id").alias("new_cluster"))
    return first.select("vec_id", F.col("cluster_id").alias("old_cluster")).join(then, "vec_id").where("old_cluster <> new_cluster")


def kmeanspp_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second seed of k-means++ after vector 0, picked by squared distances."""
    v = _vectors(spark, sf_dir)
    seed = F.array(*[F.lit(float(x)) for x in v.where("vec_id = 0").first()["v"]])
    w = v.select("vec_id", F.greatest(F.lit(0.0), vectors.chord(vectors.dot(F.col("v"), seed))).alias("w"))
    return ivf.weighted_pick(w, SHARE).withColumn("total", F.round("total", 6))


def kmeans_minibatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cluster of every vector by centroids that mini-batches of a bounded sample have moved."""
    v = _vectors(spark, sf_dir)
    return ivf.assign(v, ivf.minibatch(v, ivf.clusters_for(v.count()))).select("vec_id", "cluster_id", F.round("score", 6).alias("score"))


def cluster_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A thousand draws of a cluster and then of one of its vectors."""
    v = _vectors(spark, sf_dir)
    return ivf.cluster_sample(ivf.assign(v, _centroids(v)), 1000)


def recalibration_trigger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Epochs of 1000 ingests each, with their first and last event."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts")
    seq = running(e, [], "event_id", F.lit(1), "seq")
    return seq.groupBy(F.floor((F.col("seq") - 1) / 1000).cast("bigint").alias("epoch")).agg(F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"), F.count(F.lit(1)).alias("n"))


def vector_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length and degeneracy of every vector, and the distance to its halved self made a unit vector."""
    v = _vectors(spark, sf_dir)
    unit = vectors.normalise(F.transform("v", lambda x: x / 2))
    return v.select("vec_id", F.round(F.sqrt(vectors.squared(F.col("v"))), 6).alias("norm"), vectors.is_degenerate(F.col("v")).alias("degenerate"), F.round(F.abs(vectors.chord(vectors.dot(F.col("v"), unit))), 5).alias("distance"))


def semantic_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents like the stated ones (doc_id divisible by 100) by hashed words: the ten best at 0.6 or above.

    Texts over the reference's 1536 bytes for prompts take no part; semantic_near_dups_all has all texts and all partners.
    """
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").where(F.octet_length("text") <= 1536)
    v = stage(encode.encode(d, "doc_id", "text"), "vectors")
    found = vectors.top_k(_queries(v), v, 11).where("query_id <> vec_id")
    return found.where("score >= 0.6").select("query_id", "vec_id", F.round("score", 6).alias("score"))


def semantic_near_dups_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, of any length, like the stated ones (doc_id divisible by 100) at 0.6 or above."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    v = stage(encode.encode(d, "doc_id", "text"), "vectors")
    found = vectors.within(_queries(v), v, 0.6).where("query_id <> vec_id")
    return found.select("query_id", "vec_id", F.round("score", 6).alias("score"))


_V = "v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)"
_C = """kk AS (SELECT least(65536, greatest(16, 4 * ceil(sqrt(count(*)) / 4)))::INT AS k FROM v),
c AS (SELECT (row_number() OVER (ORDER BY vec_id) - 1)::INT AS cluster_id, vec_id, v FROM v QUALIFY row_number() OVER (ORDER BY vec_id) <= (SELECT k FROM kk))"""
_SHARE = "(SELECT (k * {0} + {1} - 1) // {1} FROM kk)"
_NEAR_SHARE, _TEN_SHARE = _SHARE.format(*LOOKUP_SHARE), _SHARE.format(*TOP_SHARE)
_NEAR = "round(list_dot_product({a}, {b}), 12)"


def _assign(name: str, source: str, centroids: str, key: str = "vec_id", n: int | str = 1) -> str:
    return f"""{name} AS (SELECT * FROM (SELECT x.{key}, x.v, c.cluster_id, list_dot_product(x.v, c.v) AS score,
      row_number() OVER (PARTITION BY x.{key} ORDER BY round(list_dot_product(x.v, c.v), 12) DESC, c.cluster_id) AS r FROM {source} x CROSS JOIN {centroids} c) WHERE r <= {n})"""


_TOP = """SELECT query_id, vec_id, rnk::INT AS rnk, round(s, 6) AS score FROM (
  SELECT query_id, vec_id, s, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rnk FROM ({pairs})) WHERE rnk <= {k}"""
_PAIRS = "SELECT q.vec_id AS query_id, v.vec_id, round(list_dot_product(q.v, v.v), 12) AS s FROM v q CROSS JOIN v WHERE q.vec_id % 100 = 0"
_PROBED = "SELECT q.vec_id AS query_id, m.vec_id, round(list_dot_product(q.v, m.v), 12) AS s FROM a q JOIN a m USING (cluster_id) WHERE q.vec_id % 100 = 0"
_PROBED_MORE = "SELECT q.vec_id AS query_id, m.vec_id, round(list_dot_product(q.v, m.v), 12) AS s FROM p q JOIN a m USING (cluster_id) WHERE q.vec_id % 100 = 0"
_DERIVED = """n AS (SELECT count(*) AS n FROM v),
b AS (SELECT a.vec_id, list_transform(list_zip(a.v, b.v), lambda p: (0.5 + 0.5 * ((a.vec_id + a.vec_id // 100) % 10) / 9) * p[1] + (0.5 - 0.5 * ((a.vec_id + a.vec_id // 100) % 10) / 9) * p[2]) AS v
      FROM v a CROSS JOIN n JOIN v b ON b.vec_id = (a.vec_id + 1) % n.n),
d AS (SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM b)"""
_DECIDE = """SELECT query_id, CASE WHEN s >= 0.85 THEN vec_id END AS vec_id, round(s, 6) AS score, CASE WHEN s >= 0.85 THEN 'HIT' ELSE 'MISS' END AS decision FROM (
  SELECT query_id, vec_id, s, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS r FROM ({pairs})) WHERE r = 1"""
_JOINED = "SELECT q.vec_id AS query_id, m.vec_id, round(list_dot_product(q.v, m.v), 12) AS s FROM p q JOIN a m USING (cluster_id)"
_LLOYD = f"""{_assign("a", "v", "c")},
e AS (SELECT cluster_id, unnest(range({DIMENSIONS})) AS dim, unnest(v) AS x FROM a),
m AS (SELECT cluster_id, dim, sum(x) AS x FROM e GROUP BY ALL),
l AS (SELECT cluster_id, dim, x / sqrt(sum(x * x) OVER (PARTITION BY cluster_id)) AS x FROM m),
lv AS (SELECT cluster_id, list(x ORDER BY dim) AS v FROM l GROUP BY cluster_id)"""

ORACLES = {
    "topk_exact": f"WITH {_V} " + _TOP.format(pairs=_PAIRS, k=10),
    "topk_threshold": f"WITH {_V} SELECT * FROM (" + _TOP.format(pairs=_PAIRS, k=10) + ") WHERE score >= 0.3",
    "lookup_decision": f"WITH {_V}, {_C}, {_DERIVED}, {_assign('a', 'v', 'c')}, {_assign('p', 'd', 'c', n=_NEAR_SHARE)} " + _DECIDE.format(pairs=_JOINED),
    "lookup_decision_nprobe1": f"WITH {_V}, {_C}, {_DERIVED}, {_assign('a', 'v', 'c')}, {_assign('p', 'd', 'c')} " + _DECIDE.format(pairs=_JOINED),
    "lookup_recall": f"""WITH {_V}, {_C}, {_DERIVED}, {_assign("a", "v", "c")}, {_assign("p", "d", "c", n=_NEAR_SHARE)},
x AS (SELECT DISTINCT q.vec_id FROM d q CROSS JOIN v WHERE round(list_dot_product(q.v, v.v), 12) >= 0.85),
f AS (SELECT query_id, min(r) AS r FROM (SELECT q.vec_id AS query_id, q.r, round(list_dot_product(q.v, m.v), 12) AS s FROM p q JOIN a m USING (cluster_id)) WHERE s >= 0.85 GROUP BY 1)
SELECT search, count(*) AS hits, count(f.query_id) AS found, round(count(f.query_id) / count(*), 6) AS recall FROM (VALUES ('nprobe1', 1), ('lookup_decision', 1000000)) t(search, n) CROSS JOIN x LEFT JOIN f ON f.query_id = x.vec_id AND f.r <= n GROUP BY 1""",
    "lookup_decision_exact": f"WITH {_V}, {_DERIVED} " + _DECIDE.format(pairs="SELECT q.vec_id AS query_id, v.vec_id, round(list_dot_product(q.v, v.v), 12) AS s FROM d q CROSS JOIN v WHERE q.vec_id % 100 = 0"),
    "lookup_replay": f"""WITH RECURSIVE {_V}, {_C}, {_assign("a", "v", "c")},
g AS (SELECT x.vec_id, x.cluster_id, list({{'s': -s, 'i': y}} ORDER BY s DESC, y) FILTER (y IS NOT NULL) AS near FROM a x
  LEFT JOIN (SELECT p.vec_id AS x, q.vec_id AS y, round(list_dot_product(p.v, q.v), 12) AS s FROM a p JOIN a q ON p.cluster_id = q.cluster_id AND q.vec_id < p.vec_id
    WHERE round(list_dot_product(p.v, q.v), 12) >= 0.3) n ON n.x = x.vec_id GROUP BY ALL),
f AS (
  SELECT 0::BIGINT AS k, []::BIGINT[] AS held, NULL::BIGINT AS vec_id, NULL::INT AS cluster_id, NULL::BIGINT AS matched
  UNION ALL
  SELECT k + 1, CASE WHEN m IS NULL THEN list_append(held, g.vec_id) ELSE held END, g.vec_id, g.cluster_id, m
  FROM f JOIN g ON g.vec_id = k, LATERAL (SELECT list_filter(coalesce(g.near, []), lambda z: list_contains(held, z.i))[1].i AS m))
SELECT vec_id, cluster_id, CASE WHEN matched IS NULL THEN 'MISS' ELSE 'HIT' END AS decision, matched FROM f WHERE vec_id IS NOT NULL""",
    "ivf_bootstrap": f"WITH {_V}, {_C} SELECT cluster_id, vec_id FROM c",
    "ivf_assign": f"WITH {_V}, {_C}, {_assign('a', 'v', 'c')} SELECT vec_id, cluster_id, round(score, 6) AS score FROM a",
    "ivf_cluster_sizes": f"WITH {_V}, {_C}, {_assign('a', 'v', 'c')} SELECT cluster_id, count(*) AS n FROM a GROUP BY 1",
    "ivf_probe_topk_nprobe1": f"WITH {_V}, {_C}, {_assign('a', 'v', 'c')} " + _TOP.format(pairs=_PROBED, k=10),
    "two_tier_candidates_nprobe1": f"WITH {_V}, {_C}, {_assign('a', 'v', 'c')} "
    + _TOP.format(pairs="SELECT * FROM (" + _PROBED + " AND m.vec_id % 10 <> 5) UNION ALL SELECT * FROM (" + _PAIRS + " AND v.vec_id % 10 = 5)", k=10),
    "ivf_probe_topk": f"WITH {_V}, {_C}, {_assign('a', 'v', 'c')}, {_assign('p', 'v', 'c', n=_TEN_SHARE)} " + _TOP.format(pairs=_PROBED_MORE, k=10),
    "two_tier_candidates": f"WITH {_V}, {_C}, {_assign('a', 'v', 'c')}, {_assign('p', 'v', 'c', n=_TEN_SHARE)} "
    + _TOP.format(pairs="SELECT * FROM (" + _PROBED_MORE + " AND m.vec_id % 10 <> 5) UNION ALL SELECT * FROM (" + _PAIRS + " AND v.vec_id % 10 = 5)", k=10),
    "ivf_recall": f"WITH {_V}, {_C}, t AS (SELECT query_id, vec_id FROM (" + _TOP.format(pairs=_PAIRS, k=10) + f""")),
{_assign("a", "v", "c")}, {_assign("p", "v", "c", n="(SELECT k FROM kk)")}, n AS (SELECT sixths, CASE sixths WHEN 0 THEN 1 ELSE (k * sixths + 5) // 6 END AS nprobe FROM kk, (SELECT unnest([0, 1, 3, 5]) AS sixths)),
g AS (SELECT sixths, query_id, vec_id, row_number() OVER (PARTITION BY sixths, query_id ORDER BY s DESC, vec_id) AS rnk FROM (
  SELECT n.sixths, q.vec_id AS query_id, m.vec_id, round(list_dot_product(q.v, m.v), 12) AS s FROM n JOIN p q ON q.r <= n.nprobe JOIN a m USING (cluster_id) WHERE q.vec_id % 100 = 0))
SELECT sixths::INT AS sixths, round(count(g.vec_id) / count(*), 6) AS recall FROM n CROSS JOIN t LEFT JOIN (SELECT * FROM g WHERE rnk <= 10) g USING (sixths, query_id, vec_id) GROUP BY 1""",
    "ivf_capacity_overflow": f"WITH {_V}, {_C}, {_assign('a', 'v', 'c')} SELECT vec_id, cluster_id, pos FROM (SELECT vec_id, cluster_id, row_number() OVER (PARTITION BY cluster_id ORDER BY vec_id) AS pos FROM a) WHERE pos > 20",
    "cluster_sample": f"""WITH {_V}, {_C}, {_assign("a", "v", "c")}, m AS (SELECT vec_id, cluster_id, row_number() OVER (PARTITION BY cluster_id ORDER BY vec_id) - 1 AS pos FROM a),
z AS (SELECT cluster_id, count(*) AS size, row_number() OVER (ORDER BY cluster_id) - 1 AS place FROM a GROUP BY 1),
g AS (SELECT i AS draw, ('0x' || substr(md5(i::VARCHAR), 1, 8))::BIGINT % (SELECT count(*) FROM z) AS place, ('0x' || substr(md5('m' || i), 1, 8))::BIGINT AS k FROM (SELECT unnest(range(1000)) AS i))
SELECT g.draw, z.cluster_id, m.vec_id FROM g JOIN z USING (place) JOIN m ON m.cluster_id = z.cluster_id AND m.pos = g.k % z.size""",
    "kmeans_lloyd_step": f"WITH {_V}, {_C}, {_LLOYD} SELECT cluster_id, dim::INT AS dim, round(x, 6) + 0.0::DOUBLE AS value FROM l",
    "kmeans_movement": f"WITH {_V}, {_C}, {_LLOYD} SELECT round(sum(2 * (1 - list_dot_product(c.v, lv.v))), 6) AS movement FROM c JOIN lv USING (cluster_id)",
    "ivf_reassign_diff": f"WITH {_V}, {_C}, {_LLOYD}, {_assign('z', 'v', 'lv')} SELECT vec_id, a.cluster_id AS old_cluster, z.cluster_id AS new_cluster FROM a JOIN z USING (vec_id) WHERE a.cluster_id <> z.cluster_id",
    "kmeanspp_step": f"""WITH {_V}, w AS (SELECT v.vec_id, greatest(0, 2 * (1 - list_dot_product(v.v, s.v))) AS w FROM v CROSS JOIN (SELECT v FROM v WHERE vec_id = 0) s),
r AS (SELECT vec_id, sum(w) OVER (ORDER BY vec_id) AS run, sum(w) OVER () AS total FROM w)
SELECT min(vec_id) FILTER (run >= {SHARE!r} * total) AS vec_id, round(any_value(total), 6) AS total FROM r""",
    "recalibration_trigger": "SELECT epoch, min(event_id) AS first_id, max(event_id) AS last_id, count(*) AS n FROM (SELECT event_id, (row_number() OVER (ORDER BY event_id) - 1) // 1000 AS epoch FROM events) GROUP BY 1",
    "vector_health": f"""WITH {_V} SELECT vec_id, round(sqrt(list_dot_product(v, v)), 6) AS norm, list_dot_product(v, v) < 1e-9 AS degenerate,
round(abs(2 * (1 - list_dot_product(v, v) / sqrt(list_dot_product(v, v)))), 5) AS distance FROM v""",
    "semantic_near_dups": r"""
WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS w FROM documents WHERE strlen(text) <= 1536),
b AS (SELECT doc_id, ('0x' || substr(md5(w), 1, 4))::INT % 384 AS b, count(*)::DOUBLE AS n FROM w GROUP BY ALL),
e AS (SELECT doc_id, b, n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)) AS x FROM b),
s AS (SELECT q.doc_id AS query_id, d.doc_id AS vec_id, round(sum(q.x * d.x), 12) AS s FROM e q JOIN e d USING (b) WHERE q.doc_id % 100 = 0 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rnk FROM s)
SELECT query_id, vec_id, round(s, 6) AS score FROM r WHERE rnk <= 11 AND query_id <> vec_id AND s >= 0.6""",
    "semantic_near_dups_all": r"""
WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS w FROM documents),
b AS (SELECT doc_id, ('0x' || substr(md5(w), 1, 4))::INT % 384 AS b, count(*)::DOUBLE AS n FROM w GROUP BY ALL),
e AS (SELECT doc_id, b, n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)) AS x FROM b),
s AS (SELECT q.doc_id AS query_id, d.doc_id AS vec_id, round(sum(q.x * d.x), 12) AS s FROM e q JOIN e d USING (b) WHERE q.doc_id % 100 = 0 GROUP BY ALL)
SELECT query_id, vec_id, round(s, 6) AS score FROM s WHERE query_id <> vec_id AND s >= 0.6""",
}

QUERIES = {
    f.__name__: f
    for f in (
        topk_exact, topk_threshold, lookup_decision, lookup_decision_nprobe1, lookup_recall, lookup_decision_exact, lookup_replay, ivf_bootstrap, ivf_assign, ivf_cluster_sizes, ivf_probe_topk, ivf_probe_topk_nprobe1,
        two_tier_candidates, two_tier_candidates_nprobe1, ivf_recall,
        ivf_capacity_overflow, kmeans_lloyd_step, kmeans_movement, ivf_reassign_diff, kmeanspp_step, kmeans_minibatch, cluster_sample, recalibration_trigger, vector_health, semantic_near_dups, semantic_near_dups_all,
    )
}
