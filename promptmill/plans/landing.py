"""Queries that land a table as files in the shared folder and read them back through the engine's sources."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import encode
from ..scale import remove_at_exit, shared_dir
from ..sources import records

#: Elements of one landed JSON array: an array is one value, so a task holds all of it.
ARRAY_ROWS = 1000


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _folder(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/promptmill/{name}-{uuid.uuid4().hex}"
    remove_at_exit(spark, path)
    return path


def _landed_lines(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    """The lines of record_lines in two folders of text files, by odd and even ids."""
    r = _t(spark, sf_dir, "record_lines").where("raw is not null")
    paths = _folder(spark, "odd"), _folder(spark, "even")
    for path, odd in zip(paths, (1, 0), strict=True):
        r.where(F.col("line_id") % 2 == odd).select("raw").write.text(path)
    return paths


def _sizes(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*[F.char_length(n).alias(f"{n}_chars") for n in names]).groupBy(*[f"{n}_chars" for n in names]).agg(F.count(F.lit(1)).alias("n"))


def source_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usable records of the lines of several files, malformed ones skipped, counted by their lengths."""
    return _sizes(records.parsed(records.lines(spark, *_landed_lines(spark, sf_dir))), "prompt", "payload")


def source_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of all files, before they are parsed (one row)."""
    return records.lines(spark, *_landed_lines(spark, sf_dir)).agg(F.count(F.lit(1)).alias("lines"))


def source_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts of all files, also of lines without a payload, counted by length."""
    return _sizes(records.prompts(spark, *_landed_lines(spark, sf_dir)), "prompt")


def source_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects of JSONL files with two text fields, blank and malformed lines left out, counted by their lengths."""
    path, _ = _landed_lines(spark, sf_dir)
    rows = records.jsonl(spark, path, "prompt string, payload string")
    return _sizes(rows.where("prompt is not null and payload is not null"), "prompt", "payload")


def source_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements of files that hold one JSON array each, counted by the length of their name and key."""
    c = _t(spark, sf_dir, "customer")
    buckets = max(1, -(-c.count() // ARRAY_ROWS))
    path = _folder(spark, "arrays")
    item = F.to_json(F.struct(F.col("c_name").alias("name"), F.col("c_custkey").alias("key")))
    arrays = c.groupBy(F.pmod(F.xxhash64("c_custkey"), F.lit(buckets)).alias("_b")).agg(F.collect_list(item).alias("x"))
    arrays.select("_b", F.concat(F.lit("\n ["), F.array_join("x", ", "), F.lit("]")).alias("value")).write.partitionBy("_b").text(path)
    rows = records.json_array(spark, f"{path}/*", "name string, key bigint")
    return rows.groupBy(F.char_length("name").alias("name_chars"), (F.col("key") % 10).alias("last")).agg(F.count(F.lit(1)).alias("n"))


def sink_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of cache_records written as JSON lines and read back, counted by their lengths."""
    r = _t(spark, sf_dir, "cache_records").where("prompt <> '' and payload <> ''")
    path = _folder(spark, "sink")
    records.write_jsonl(r, path)
    return _sizes(records.parsed(records.lines(spark, path)), "prompt", "payload")


def mean_pooling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of the vectors of each label, as the tokens of one text, by dimension."""
    e = _t(spark, sf_dir, "embeddings").select("label", "embedding")
    return encode.mean_pool(e, "label", "embedding").select("label", F.posexplode("v").alias("dim", "value")).withColumn("value", F.round("value", 6) + 0.0)


_L = """l AS (SELECT line_id, unnest(string_split_regex(rtrim(raw, chr(13)), '\\r\\n|\\r|\\n')) AS raw FROM record_lines WHERE raw IS NOT NULL),
j AS (SELECT *, json_extract_string(raw, '$.prompt') AS p, json_extract_string(raw, '$.payload') AS a, json_type(raw) AS kind FROM l WHERE json_valid(raw))"""
_PAIRS = "SELECT length(p)::INT AS prompt_chars, length(a)::INT AS payload_chars, count(*) AS n FROM {0} GROUP BY 1, 2"

ORACLES = {
    "source_lines": f"WITH {_L} " + _PAIRS.format("j WHERE p <> '' AND a <> ''"),
    "source_count": "SELECT sum(len(string_split_regex(rtrim(raw, chr(13)), '\\r\\n|\\r|\\n')))::BIGINT AS lines FROM record_lines WHERE raw IS NOT NULL",
    "source_prompts": f"WITH {_L} SELECT length(p)::INT AS prompt_chars, count(*) AS n FROM j WHERE kind = 'OBJECT' AND p <> '' GROUP BY 1",
    "source_jsonl": f"WITH {_L} " + _PAIRS.format("j WHERE kind = 'OBJECT' AND line_id % 2 = 1 AND p IS NOT NULL AND a IS NOT NULL"),
    "source_array": "SELECT length(c_name)::INT AS name_chars, c_custkey % 10 AS last, count(*) AS n FROM customer GROUP BY 1, 2",
    "sink_jsonl": "SELECT length(prompt)::INT AS prompt_chars, length(payload)::INT AS payload_chars, count(*) AS n FROM cache_records WHERE prompt <> '' AND payload <> '' GROUP BY 1, 2",
    "mean_pooling": """SELECT label, dim::INT AS dim, round(avg(x), 6) + 0.0::DOUBLE AS value FROM (SELECT label, unnest(range(len(embedding))) AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY 1, 2""",
}

QUERIES = {f.__name__: f for f in (source_lines, source_count, source_prompts, source_jsonl, source_array, sink_jsonl, mean_pooling)}
