"""Queries that do the whole job where the one of the first name keeps a limit of the reference."""

import pytest
from pyspark.sql import functions as F

from promptmill.operators import cache, vectors
from promptmill.plans import catalog, search, traffic

from .conftest import DATA


def pairs(spark, name):
    return {(r["query_id"], r["vec_id"]) for r in catalog.QUERIES[name](spark, DATA).collect()}


def test_registered_index_searches_reach_the_recall(spark):
    exact = pairs(spark, "topk_exact")
    for name in ("ivf_probe_topk", "two_tier_candidates"):
        assert len(pairs(spark, name) & exact) >= 0.9 * len(exact)


def test_registered_lookup_finds_the_hits(spark):
    def hits(df):
        return {r["query_id"] for r in df.where("decision = 'HIT'").collect()}

    exact = hits(cache.decide(vectors.top_k(search._derived(spark, DATA), search._vectors(spark, DATA), 1)))
    got = hits(catalog.QUERIES["lookup_decision"](spark, DATA))
    assert exact and got <= exact and len(got) >= 0.9 * len(exact)


@pytest.mark.parametrize("block", [4096, 1])
def test_within_gives_all_partners(spark, block):
    x = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(30)] + [(40, [0.0, 1.0]), (None, [1.0, 0.0]), (41, None)], "vec_id bigint, v array<double>")
    q = x.where("vec_id in (0, 40)").withColumnRenamed("vec_id", "query_id")
    got = {(r["query_id"], r["vec_id"]) for r in vectors.within(q, x, 0.6, block).collect()}
    assert got == {(0, i) for i in range(30)} | {(40, 40)}
    assert vectors.within(q.where("false"), x, 0.6).count() == 0


def test_near_dups_of_long_texts_and_large_groups(spark, tmp_path):
    long, short = "long guide of many words " * 100, "a short note"
    rows = [(100, long), (101, long + "more")] + [(200 + i, short) for i in range(30)] + [(300, None), (301, "")]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r["query_id"], r["vec_id"]) for r in catalog.QUERIES["semantic_near_dups_all"](spark, str(tmp_path)).collect()}
    assert got == {(100, 101)} | {(200, 200 + i) for i in range(1, 30)}


def test_zero_false_positive_threshold(spark, tmp_path):
    rows = [(1, "word " * 10 + "x" * 500), (2, "a " * 200), (3, "short"), (4, None)]
    for name, some in (("a", rows), ("b", rows[1:2])):
        spark.createDataFrame(some, "request_id bigint, prompt string").write.parquet(f"{tmp_path}/{name}/check_requests.parquet")
    q = catalog.QUERIES["threshold_zero_fp"]
    assert [tuple(r) for r in q(spark, f"{tmp_path}/a").select("threshold", "fp", "fn").collect()] == [(550, 0, 1)]
    assert q(spark, f"{tmp_path}/b").count() == 0


def test_validation_counts_characters(spark, tmp_path):
    lines = [(1, "f", '{"prompt": "\u00e9t\u00e9", "payload": "ab"}'), (2, "f", '{"prompt": "a", "payload": "abcd"}'), (3, "f", "{"), (4, "g", "")]
    spark.createDataFrame(lines, "line_id bigint, local_name string, raw string").write.parquet(f"{tmp_path}/record_lines.parquet")
    got = catalog.QUERIES["validation_lengths"](spark, str(tmp_path)).collect()
    assert {tuple(r) for r in got} == {("f", 1, 3, 2.0, 2, 4, 3.0), ("g", None, None, None, None, None, None)}


def test_exact_cache_holds_payloads_below_the_operators_limit(spark, tmp_path):
    rows = [(1, "a", "x" * 600, None), (2, "b", "x" * 65_535, None), (3, "c", "x" * 65_536, None), (4, "d", "x", None)]
    spark.createDataFrame(rows, "record_id bigint, prompt string, payload string, loaded_at timestamp_ntz").write.parquet(f"{tmp_path}/cache_records.parquet")
    got = catalog.QUERIES["exact_cache_put_full"](spark, str(tmp_path)).collect()
    assert {(r["record_id"], r["n_bytes"]) for r in got} == {(1, 600), (2, 65_535), (4, 1)}


@pytest.mark.parametrize("nodes", [12_000, 25_000])
def test_clock_capacity_does_not_depend_on_the_number_of_nodes(spark, monkeypatch, nodes):
    entries = spark.range(nodes).select(F.col("id").alias("node_id"), F.lit(100).alias("n_bytes"), F.lit(False).alias("hot"))
    monkeypatch.setattr(traffic, "_entries", lambda *_: entries)
    kept = traffic.clock_evict(spark, DATA).where("fate = 'KEPT'").count() * 100
    assert 990_000 <= kept <= 1_000_000
