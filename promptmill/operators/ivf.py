"""Clustered index: bootstrap, assignment, probing, capacity, Lloyd and mini-batch updates.

Centroids are a bounded table (the number of clusters is a parameter); vectors are assigned by matrix products per
partition. Probing joins chunks of a cluster's queries with chunks of its members, so a cluster that holds a third of
all vectors is many tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import TOP_K
from ..scale import parallel, running, ship, stage
from .vectors import best, best_of, chunked, matrix, merge, normalise

MOST_CLUSTERS = 65_536


def clusters_for(n: int, least: int = 16) -> int:
    """Clusters for ``n`` vectors: about the square root, a multiple of 4, so that assigning and probing cost alike."""
    return min(MOST_CLUSTERS, max(least, 4 * math.ceil(math.sqrt(n) / 4)))


def bootstrap(vectors: DataFrame, clusters: int) -> DataFrame:
    """(cluster_id, vec_id, v): the first vectors by id become the centroids."""
    if not 0 < clusters <= MOST_CLUSTERS:
        raise ValueError(f"clusters must be from 1 to {MOST_CLUSTERS}")
    first = vectors.where("vec_id is not null and v is not null").select("vec_id", "v").orderBy("vec_id").limit(clusters)
    rows = first.collect()  # at most MOST_CLUSTERS
    out = [(i, r["vec_id"], [float(x) for x in r["v"]]) for i, r in enumerate(rows)]
    return vectors.sparkSession.createDataFrame(out, "cluster_id int, vec_id bigint, v array<double>")


def _held(centroids: DataFrame):
    rows = centroids.select("cluster_id", "v").orderBy("cluster_id").limit(MOST_CLUSTERS + 1).collect()
    if len(rows) > MOST_CLUSTERS:
        raise ValueError(f"more than {MOST_CLUSTERS} centroids")
    return np.array([r[0] for r in rows], np.int64), matrix(pd.Series([r[1] for r in rows], dtype=object))


def assign(vectors: DataFrame, centroids: DataFrame, nprobe: int = 1) -> DataFrame:
    """(vec_id, v, cluster_id, score): the nearest centroids of each vector, ties to the lower cluster id."""
    spark = vectors.sparkSession
    ship(spark)
    held = spark.sparkContext.broadcast(_held(centroids))

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, c = held.value
        for b in batches:
            if len(b) and len(ids):
                v = matrix(b["v"])
                scores = v @ c.T
                rows, cols = best(scores, ids, nprobe)
                yield pd.DataFrame({"vec_id": b["vec_id"].to_numpy()[rows], "v": [v[r].tolist() for r in rows], "cluster_id": ids[cols].astype(np.int32), "score": scores[rows, cols]})

    rows = parallel(vectors.where("vec_id is not null and v is not null").select("vec_id", "v"))
    return rows.mapInPandas(near, "vec_id bigint, v array<double>, cluster_id int, score double")


def search(queries: DataFrame, members: DataFrame, centroids: DataFrame, k: int = TOP_K, nprobe: int = 1, chunk: int = 4096) -> DataFrame:
    """(query_id, vec_id, rnk, score): the k best members of the ``nprobe`` clusters nearest to each query.

    ``queries`` has (query_id, v), ``members`` (vec_id, v, cluster_id). Clusters are cut into chunks of about
    ``chunk`` members and ``chunk`` queries; every task scores one chunk against another by a matrix product.
    """
    ship(queries.sparkSession)
    probes = stage(assign(queries.withColumnRenamed("query_id", "vec_id"), centroids, nprobe).select(F.col("vec_id").alias("query_id"), "v", "cluster_id"), "probes")
    return merge(chunked(probes, members, "cluster_id", lambda q, m: best_of(q, m, k), chunk), k)


def lloyd(assigned: DataFrame) -> DataFrame:
    """(cluster_id, v): mean of each cluster's members, made a unit vector. Sums are made per partition first."""
    ship(assigned.sparkSession)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for c, g in b.groupby("cluster_id"):
                s = matrix(g["v"]).sum(0)
                total[c] = total[c] + s if c in total else s
        yield pd.DataFrame([(c, i, x) for c, s in total.items() for i, x in enumerate(s)], columns=["cluster_id", "dim", "x"])

    parts = assigned.select("cluster_id", "v").mapInPandas(sums, "cluster_id int, dim int, x double")
    total = parts.groupBy("cluster_id", "dim").agg(F.sum("x").alias("x"))
    vec = total.groupBy("cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda s: s["x"]).alias("v"))
    return vec.select("cluster_id", normalise(F.col("v")).alias("v"))


def capacity_positions(assigned: DataFrame, width: int = 50_000) -> DataFrame:
    """(vec_id, cluster_id, pos): the place of each vector in its cluster's order of arrival (by id), from 1."""
    return running(assigned.select("vec_id", "cluster_id"), ["cluster_id"], "vec_id", F.lit(1), "pos", width)


def _draw(*parts: Column) -> Column:
    """A pseudo-random whole number below 2 ** 32 from the MD5 of the parts."""
    return F.conv(F.substring(F.md5(F.concat(*parts)), 1, 8), 16, 10).cast("bigint")


def cluster_sample(assigned: DataFrame, n: int, width: int = 50_000) -> DataFrame:
    """(draw, cluster_id, vec_id): ``n`` draws with replacement, first of a cluster, each as likely, then of a member of it.

    So members of small clusters are drawn more often. ``assigned`` has (vec_id, cluster_id); no vectors give no draws.
    """
    sizes = assigned.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"))
    every = [(i, r["cluster_id"], r["size"]) for i, r in enumerate(sizes.orderBy("cluster_id").limit(MOST_CLUSTERS).collect())]
    spark = assigned.sparkSession
    sizes = spark.createDataFrame(every, f"place bigint, cluster_id {dict(assigned.dtypes)['cluster_id']}, size bigint")
    draw = F.col("draw").cast("string")
    drawn = spark.range(n).select(F.col("id").alias("draw")).withColumn("place", _draw(draw) % max(len(every), 1))
    drawn = drawn.join(F.broadcast(sizes), "place").select("draw", "cluster_id", (_draw(F.lit("m"), draw) % F.col("size") + 1).alias("pos"))
    return drawn.join(capacity_positions(assigned, width), ["cluster_id", "pos"]).select("draw", "cluster_id", "vec_id")


def weighted_pick(weights: DataFrame, share: float, width: int = 50_000) -> DataFrame:
    """(vec_id, total): the smallest id at which the running weight reaches ``share`` of the total (one row)."""
    total = weights.agg(F.sum("w")).first()[0] or 0.0
    run = running(weights, [], "vec_id", F.col("w"), "run", width)
    return run.where(F.col("run") >= share * total).agg(F.min("vec_id").alias("vec_id")).withColumn("total", F.lit(total))


def minibatch(vectors: DataFrame, clusters: int, sample: int = 65_536, batch: int = 1024, rounds: int = 16, tolerance: float = 1e-4, seed: int = 11) -> DataFrame:
    """(cluster_id, v): spherical mini-batch k-means on a bounded sample (the ``sample`` vectors of smallest hash).

    Seeded by squared distance, then updated by running means that are normalised after each batch; ends after
    ``rounds`` or when the centroids move less than ``tolerance``. Deterministic for a seed.
    """
    rows = vectors.where("vec_id is not null and v is not null").orderBy(F.xxhash64("vec_id", F.lit(seed)), "vec_id").limit(sample).select("v").collect()
    x = matrix(pd.Series([r[0] for r in rows], dtype=object))
    rng = np.random.default_rng(seed)
    spark = vectors.sparkSession
    if not len(x):
        return spark.createDataFrame([], "cluster_id int, v array<double>")
    chosen = [int(rng.integers(len(x)))]
    d = np.maximum(0, 2 * (1 - x @ x[chosen[0]]))
    while len(chosen) < min(clusters, len(x)):
        p = d / d.sum() if d.sum() > 0 else np.full(len(x), 1 / len(x))
        chosen.append(int(rng.choice(len(x), p=p)))
        d = np.minimum(d, np.maximum(0, 2 * (1 - x @ x[chosen[-1]])))
    c, count = x[chosen].copy(), np.zeros(len(chosen))
    for _ in range(rounds):
        old = c.copy()
        for i in rng.integers(len(x), size=min(batch, len(x))):
            k = int(np.argmax(c @ x[i]))
            count[k] += 1
            m = c[k] + (x[i] - c[k]) / count[k]
            if (n := np.linalg.norm(m)) > 1e-12:
                c[k] = m / n
        if float((2 * (1 - (old * c).sum(1))).sum()) < tolerance:
            break
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(c)], "cluster_id int, v array<double>")
