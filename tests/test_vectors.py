import numpy as np
import pytest
from pyspark.sql import functions as F

from promptmill.operators import cache, encode, ivf, vectors

SCHEMA = "vec_id bigint, v array<double>"


def unit(n, dims, seed=0):
    x = np.random.default_rng(seed).normal(size=(n, dims))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def table(spark, x, parts=3):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], SCHEMA).repartition(parts)


@pytest.mark.parametrize("dims", [64, 384])
def test_dot_cases(spark, dims):
    a = unit(1, dims)[0]
    b = np.zeros(dims)
    b[0], c = 1.0, np.zeros(dims)
    c[1] = 1.0
    df = spark.createDataFrame([(a.tolist(), a.tolist(), 1.0), (a.tolist(), (-a).tolist(), -1.0), (b.tolist(), c.tolist(), 0.0), ([0.0] * dims, a.tolist(), 0.0)], "a array<double>, b array<double>, x double")
    assert df.where(F.abs(vectors.dot(F.col("a"), F.col("b")) - F.col("x")) > 1e-9).count() == 0


def test_normalise_and_degenerate(spark):
    got = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<double>").select(vectors.normalise(F.col("v")).alias("u")).collect()
    assert got[0]["u"] == [0.6, 0.8] and got[1]["u"] is None


@pytest.mark.parametrize("parts", [1, 5])
@pytest.mark.parametrize("block", [4096, 4])
def test_top_k_is_exact_however_it_is_cut(spark, parts, block):
    x, q = unit(200, 16), unit(10, 16, 1)
    x[7] = x[150]  # a tie: the smaller id ranks first
    got = vectors.top_k(table(spark, q).withColumnRenamed("vec_id", "query_id"), table(spark, x, parts), 5, block).collect()
    s = np.round(q @ x.T, vectors.DECIMALS)
    want = {(i, int(j), r + 1) for i in range(10) for r, j in enumerate(sorted(range(200), key=lambda j, i=i: (-s[i, j], j))[:5])}
    assert {(r["query_id"], r["vec_id"], r["rnk"]) for r in got} == want


def test_top_k_nulls_and_empty(spark):
    x = spark.createDataFrame([(1, [1.0, 0.0]), (None, [1.0, 0.0]), (2, None)], SCHEMA)
    q = x.withColumnRenamed("vec_id", "query_id")
    assert [(r["query_id"], r["vec_id"]) for r in vectors.top_k(q, x, 3).collect()] == [(1, 1)]
    assert vectors.top_k(q.where("false"), x, 3).count() == 0
    assert vectors.top_k(q, x.where("false"), 3).count() == 0


def test_probing_all_clusters_is_exact_and_chunks_do_not_matter(spark):
    x, q = unit(300, 8), unit(20, 8, 2)
    t, qs = table(spark, x), table(spark, q).withColumnRenamed("vec_id", "query_id")
    c = ivf.bootstrap(t, 8)
    m = ivf.assign(t, c).drop("score")
    exact = {tuple(r)[:3] for r in vectors.top_k(qs, t, 5).collect()}
    for chunk in (4096, 11):
        assert {tuple(r)[:3] for r in ivf.search(qs, m, c, 5, nprobe=8, chunk=chunk).collect()} == exact
    one = {tuple(r)[:2] for r in ivf.search(qs, m, c, 5, nprobe=1).collect()}
    home = dict(ivf.assign(t, c).select("vec_id", "cluster_id").collect())
    near = {i: int((q[i] @ x[:8].T).argmax()) for i in range(20)}
    assert all(home[v] == near[i] for i, v in one)


def test_first_vectors_are_their_own_centroids(spark):
    x = unit(50, 8)
    c = ivf.bootstrap(table(spark, x), 4)
    home = dict(ivf.assign(table(spark, x), c).select("vec_id", "cluster_id").collect())
    assert [home[i] for i in range(4)] == [0, 1, 2, 3]


def test_lloyd_matches_numpy(spark):
    x = unit(100, 8)
    a = ivf.assign(table(spark, x, 4), ivf.bootstrap(table(spark, x), 4))
    got = {r["cluster_id"]: np.array(r["v"]) for r in ivf.lloyd(a).collect()}
    home = (x @ x[:4].T).argmax(1)
    for k, v in got.items():
        m = x[home == k].mean(0)
        assert np.allclose(v, m / np.linalg.norm(m))


def test_capacity_positions_across_ranges(spark):
    df = spark.createDataFrame([(i, i % 2) for i in range(100)], "vec_id bigint, cluster_id int")
    got = {r["vec_id"]: r["pos"] for r in ivf.capacity_positions(df, width=7).collect()}
    assert got == {i: i // 2 + 1 for i in range(100)}


def test_minibatch_is_deterministic_and_unit(spark):
    t = table(spark, unit(200, 8))
    a, b = (sorted(map(tuple, ((r[0], tuple(r[1])) for r in ivf.minibatch(t, 4).collect()))) for _ in range(2))
    assert a == b and len(a) == 4
    assert all(abs(np.linalg.norm(v) - 1) < 1e-9 for _, v in a)
    assert ivf.minibatch(t.where("false"), 4).count() == 0


def brute_replay(x, home, threshold, capacity):
    held, out = {}, {}
    for i, v in enumerate(x):
        mine = held.setdefault(home[i], [])
        s = [(round(float(x[j] @ v), 12), -j) for j in mine]
        if s and max(s)[0] >= threshold:
            out[i] = ("HIT", -max(s)[1])
        elif len(mine) == capacity:
            out[i] = ("REJECTED", None)
        else:
            mine.append(i)
            out[i] = ("MISS", None)
    return out


@pytest.mark.parametrize("capacity", [1024, 3])
def test_replay(spark, capacity):
    x = unit(200, 4)
    a = ivf.assign(table(spark, x, 4), ivf.bootstrap(table(spark, x), 4))
    home = dict(a.select("vec_id", "cluster_id").collect())
    got = {r["vec_id"]: (r["decision"], r["matched"]) for r in cache.replay(a, 0.8, capacity).collect()}
    assert got == brute_replay(x, home, 0.8, capacity)


def test_encoder_is_the_same_in_every_partition(spark):
    texts = [(i, "one two three") for i in range(40)] + [(99, None), (100, "  "), (101, "!!")]
    df = spark.createDataFrame(texts, "id bigint, t string").repartition(7)
    got = encode.encode(df, "id", "t").collect()
    assert len(got) == 40 and len({tuple(r["v"]) for r in got}) == 1
    assert abs(np.linalg.norm(got[0]["v"]) - 1) < 1e-12


def test_mean_pool(spark):
    df = spark.createDataFrame([(1, [1.0, 3.0]), (1, [3.0, 5.0]), (2, [1.0, 1.0])], "id bigint, v array<double>")
    assert {r["id"]: r["v"] for r in encode.mean_pool(df, "id", "v").collect()} == {1: [2.0, 4.0], 2: [1.0, 1.0]}


def test_cluster_sample_favours_small_clusters(spark):
    df = spark.createDataFrame([(i, 5 if i < 90 else 7) for i in range(93)], "vec_id bigint, cluster_id int")
    got = ivf.cluster_sample(df, 600).collect()
    assert len(got) == 600 == len({r["draw"] for r in got}) and all((r["vec_id"] < 90) == (r["cluster_id"] == 5) for r in got)
    assert 230 < sum(r["cluster_id"] == 7 for r in got) < 370
    assert ivf.cluster_sample(df.where("false"), 10).count() == 0
