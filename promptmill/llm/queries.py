"""Queries of the text operators over the test tables, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import formatdup, leakage, nearsets, packing, pairs, splitting, textform, truncation
from .oracles import ORACLES  # noqa: F401 - read by the entry module


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests, records = (_table(spark, sf_dir, t) for t in ("check_requests", "cache_records"))
    return textform.same_looking(requests, records, "request_id", "record_id", "prompt", "prompt")


def p1_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every prompt in its canonical form."""
    requests, records = (_table(spark, sf_dir, t) for t in ("check_requests", "cache_records"))
    a = requests.select(F.lit("check_requests").alias("origin"), F.col("request_id").alias("row_id"), "prompt")
    b = records.select(F.lit("cache_records").alias("origin"), F.col("record_id").alias("row_id"), "prompt")
    return textform.forms(a.union(b), "prompt").select("origin", "row_id", "form").distinct()


def p1_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first request whose prompt looks like that of a request."""
    return textform.looking_like(_table(spark, sf_dir, "check_requests"), "prompt", "request_id")


def p1_decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens with odd characters in all prompts, by what decided their spelling."""
    requests, records = (_table(spark, sf_dir, t).select("prompt") for t in ("check_requests", "cache_records"))
    return textform.decided(requests.union(records), "prompt")


def _values(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = truncation.values_of(_table(spark, sf_dir, "cache_records"), "record_id", "local_name", "payload", "cache_records")
    return a.union(truncation.values_of(_table(spark, sf_dir, "set_requests"), "set_id", "upstream", "uncached_payload", "set_requests"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.cut_rows(_values(spark, sf_dir))


def p2_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of cut values per local_name of cache_records and per upstream of set_requests."""
    return truncation.cut_shares(_values(spark, sf_dir))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defects of the records. What counts as cut is what p2_found finds: one model, fitted on both tables."""
    trained = truncation.train(_values(spark, sf_dir))
    return pairs.defects(_table(spark, sf_dir, "cache_records"), trained=trained, origin="cache_records")


def _p4_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = formatdup.text_records(_table(spark, sf_dir, "check_requests"), "request_id", "prompt", "check_requests")
    return a.union(formatdup.json_records(_table(spark, sf_dir, "record_lines"), "line_id", "raw", "record_lines"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formatdup.copies(_p4_records(spark, sf_dir))


def p4_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each distinct record, with the number of its copies."""
    return formatdup.collapsed(_p4_records(spark, sf_dir))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = nearsets.similar_pairs(_table(spark, sf_dir, "cache_records"), "record_id", ("prompt", "payload"))
    return got.select(F.col("lo").alias("record_lo"), F.col("hi").alias("record_hi"))


def p5_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each record that has near-duplicates, its group and the number of its near-duplicates."""
    return nearsets.groups(_table(spark, sf_dir, "cache_records"), "record_id", ("prompt", "payload"))


def p6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of every document, of 2048 tokens each."""
    return packing.packed(_table(spark, sf_dir, "documents"))


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bins before and after the search, of 2048 and of 256 tokens, and the least that the tokens need."""
    d = _table(spark, sf_dir, "documents")
    return packing.emptied(d).union(packing.emptied(d, capacity=256))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaked(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "heldout_items"))


def p8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of the documents over 256 tokens, each repeating 32 tokens of the one before."""
    return splitting.pieces(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_forms, p1_classes, p1_decided, p2_found, p2_shares, p3_found, p4_found, p4_distinct, p5_found, p5_groups, p6_packing, p6_fill, p7_found, p8_pieces)
}
