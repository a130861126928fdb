"""Vector arithmetic and exact search.

Search multiplies blocks: a block of queries, bounded in rows, is broadcast, or chunks of many queries meet chunks of
vectors; each is scored with one matrix product that keeps its own best k, and the partial lists are merged. No pair is
ever a row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import TOP_K
from ..scale import fits, parallel, ship, stage

#: Queries of one block: with 384 dimensions some 12 MB.
QUERY_BLOCK = 4096
#: Scores are compared at so many decimals, so equal vectors tie whatever block they are in; ties go to the smaller id.
DECIMALS = 12


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def squared(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))


def is_degenerate(a: Column, least: float = 1e-9) -> Column:
    return squared(a) < least


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once, even where ``body`` uses it inside a lambda."""
    return F.transform(F.array(value), body)[0]


def normalise(a: Column, least: float = 1e-9) -> Column:
    """Unit vector; null for a degenerate one."""

    def scaled(v: Column) -> Column:
        return let(squared(v), lambda s: F.when(s >= least, let(F.sqrt(s), lambda n: F.transform(v, lambda x: x.cast("double") / n))))

    return let(a, scaled)


def chord(cosine: Column) -> Column:
    """Squared distance of unit vectors."""
    return 2 * (1 - cosine)


def blend(a: Column, b: Column, weight: Column) -> Column:
    """(1 - weight) a + weight b, made a unit vector again."""
    return normalise(F.zip_with(a, b, lambda x, y: (1 - weight) * x.cast("double") + weight * y.cast("double")))


def matrix(vectors: pd.Series) -> np.ndarray:
    return np.array([np.asarray(v, np.float64) for v in vectors]) if len(vectors) else np.empty((0, 0))


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column indices of the k best of each row: greater score first, then smaller id."""
    scores = np.round(scores, DECIMALS)
    order = np.argsort(ids, kind="stable")
    top = order[np.argsort(-scores[:, order], axis=1, kind="stable")[:, :k]]
    return np.repeat(np.arange(len(scores)), top.shape[1]), top.ravel()


def top_k(queries: DataFrame, vectors: DataFrame, k: int = TOP_K, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, vec_id, rnk, score): the k vectors of greatest dot product for each query.

    ``queries`` (query_id, v) is a stated set: at most ``query_block`` of them are broadcast to the vectors, more meet them
    in chunks (see ``chunked``). ``vectors`` has (vec_id, v). Rows with a null id or vector take no part; equal scores
    rank by vec_id. Empty sides give no rows.
    """
    spark = vectors.sparkSession
    ship(spark)
    schema = "query_id bigint, vec_id bigint, score double"
    queries = queries.where("query_id is not null and v is not null").select("query_id", "v")
    vectors = vectors.where("vec_id is not null and v is not null").select("vec_id", "v")
    block = _block(queries, query_block)
    if block is None:
        return merge(_all_chunks(queries, vectors, lambda q, m: best_of(q, m, k), query_block), k)
    if not len(block):
        return spark.createDataFrame([], "query_id bigint, vec_id bigint, rnk int, score double")
    held = spark.sparkContext.broadcast((block["query_id"].to_numpy(np.int64), matrix(block["v"])))
    return merge(parallel(vectors).mapInPandas(_search(held, k), schema), k)


def _block(queries: DataFrame, most: int) -> pd.DataFrame | None:
    """The queries, if there are at most ``most``."""
    got = queries.limit(most + 1).toPandas()
    return got if len(got) <= most else None


def chunked(queries: DataFrame, members: DataFrame, key: str, score: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], chunk: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, vec_id, score) of ``score`` for each chunk of queries (key, query_id, v) against each chunk of members
    (key, vec_id, v) of the same ``key``.

    Keys are cut into chunks of about ``chunk`` rows a side, so a key that holds a third of all rows is many tasks, and a
    vector is shipped once for each ``chunk`` vectors that it is compared with.
    """
    sizes = members.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("mc"))
    asked = queries.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("qc"))
    plan = stage(sizes.join(asked, key), "plan")
    plan = F.broadcast(plan) if fits(plan) else plan
    m = members.join(plan, key).withColumn("mb", F.pmod(F.xxhash64("vec_id"), F.col("mc")).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.col("qc") - 1)))
    q = queries.join(plan, key).withColumn("qb", F.pmod(F.xxhash64("query_id"), F.col("qc")).cast("int")).withColumn("mb", F.explode(F.sequence(F.lit(0), F.col("mc") - 1)))
    on = [key, "mb", "qb"]
    return q.select(*on, "query_id", "v").groupBy(*on).cogroup(m.select(*on, "vec_id", "v").groupBy(*on)).applyInPandas(score, "query_id bigint, vec_id bigint, score double")


def best_of(a: pd.DataFrame, b: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best of a chunk of members for each of a chunk of queries."""
    if not len(a) or not len(b):
        return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
    ids = b["vec_id"].to_numpy(np.int64)
    qv, mv = matrix(a["v"]), matrix(b["v"])
    rows, cols = best(qv @ mv.T, ids, k)
    return pd.DataFrame({"query_id": a["query_id"].to_numpy()[rows], "vec_id": ids[cols], "score": np.round((qv[rows] * mv[cols]).sum(1), DECIMALS)})


def _all_chunks(queries: DataFrame, vectors: DataFrame, score: Callable, chunk: int) -> DataFrame:
    one = F.lit(0).alias("_all")
    return chunked(stage(queries.select(one, "query_id", "v"), "queries"), vectors.select(one, "vec_id", "v"), "_all", score, chunk)


def _search(held, k: int):
    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        query_ids, q = held.value
        kept: pd.DataFrame | None = None
        for b in batches:
            if not len(b):
                continue
            ids = b["vec_id"].to_numpy(np.int64)
            v = matrix(b["v"])
            rows, cols = best(q @ v.T, ids, k)
            scores = np.round((q[rows] * v[cols]).sum(1), DECIMALS)
            new = pd.DataFrame({"query_id": query_ids[rows], "vec_id": ids[cols], "score": scores})
            kept = new if kept is None else pd.concat([kept, new])
            kept = kept.sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True]).groupby("query_id", sort=False).head(k)
        if kept is not None:
            yield kept

    return search


def within(queries: DataFrame, vectors: DataFrame, least: float, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, vec_id, score): all vectors with a dot product of ``least`` or more with each query, however many.

    Sides, blocks and nulls are those of ``top_k``; a pair that comes twice counts once. Pairs leave as they are found.
    """
    spark = vectors.sparkSession
    ship(spark)
    schema = "query_id bigint, vec_id bigint, score double"
    queries = queries.where("query_id is not null and v is not null").select("query_id", "v")
    vectors = vectors.where("vec_id is not null and v is not null").select("vec_id", "v")
    block = _block(queries, query_block)
    if block is None:
        found = _all_chunks(queries, vectors, lambda q, m: _at_least(q, m, least), query_block)
    elif not len(block):
        return spark.createDataFrame([], schema)
    else:
        held = spark.sparkContext.broadcast((block["query_id"].to_numpy(np.int64), matrix(block["v"])))
        found = parallel(vectors).mapInPandas(_within(held, least), schema)
    return found.dropDuplicates(["query_id", "vec_id"])


def _at_least(a: pd.DataFrame, b: pd.DataFrame, least: float) -> pd.DataFrame:
    """All pairs of a chunk of queries and a chunk of members that reach ``least``."""
    if not len(a) or not len(b):
        return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
    q, v = matrix(a["v"]), matrix(b["v"])
    rows, cols = np.nonzero(q @ v.T >= least - 1e-9)
    scores = np.concatenate([np.round((q[rows[k : k + 8192]] * v[cols[k : k + 8192]]).sum(1), DECIMALS) for k in range(0, len(rows), 8192)]) if len(rows) else np.empty(0)
    ok = scores >= least
    return pd.DataFrame({"query_id": a["query_id"].to_numpy()[rows[ok]], "vec_id": b["vec_id"].to_numpy()[cols[ok]], "score": scores[ok]})


def _within(held, least: float, rows_each: int = 1024):
    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        query_ids, q = held.value
        for batch in batches:
            for at in range(0, len(batch), rows_each):
                b = batch.iloc[at : at + rows_each]
                ids, v = b["vec_id"].to_numpy(np.int64), matrix(b["v"])
                rows, cols = np.nonzero(q @ v.T >= least - 1e-9)
                for k in range(0, len(rows), 8192):  # bounds the rows held for the sums, however many pairs there are
                    r, c = rows[k : k + 8192], cols[k : k + 8192]
                    scores = np.round((q[r] * v[c]).sum(1), DECIMALS)
                    ok = scores >= least
                    yield pd.DataFrame({"query_id": query_ids[r[ok]], "vec_id": ids[c[ok]], "score": scores[ok]})

    return search


def merge(partial: DataFrame, k: int) -> DataFrame:
    """Best k per query of partial lists; (query_id, vec_id) that come twice count once."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return partial.dropDuplicates(["query_id", "vec_id"]).withColumn("rnk", F.row_number().over(w)).where(F.col("rnk") <= k).select("query_id", "vec_id", "rnk", "score")
