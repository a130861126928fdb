"""Length profiles of prompts and of the byte gate that stands in for a token limit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import TOKEN, token_count


def lengths(df: DataFrame, text: str) -> DataFrame:
    """(n_bytes, n_tokens) of each row with a text."""
    return df.where(F.col(text).isNotNull()).select(F.octet_length(text).alias("n_bytes"), token_count(F.col(text)).alias("n_tokens"))


def distribution(sizes: DataFrame, most_tokens: int) -> DataFrame:
    """Exact order statistics of the bytes of rows within the token limit (one row)."""
    q = F.percentile("n_bytes", F.array(*[F.lit(x) for x in (0.5, 0.95, 0.99, 0.999)]))
    got = sizes.where(F.col("n_tokens") <= most_tokens).agg(F.count(F.lit(1)).alias("n"), F.min("n_bytes").alias("min_bytes"), F.max("n_bytes").alias("max_bytes"), F.avg("n_bytes").alias("mean"), q.alias("q"))
    names = ("p50", "p95", "p99", "p999")
    return got.select("n", "min_bytes", "max_bytes", F.round("mean", 6).alias("mean_bytes"), *[F.round(F.col("q")[i], 6).alias(n) for i, n in enumerate(names)])


def gate_errors(sizes: DataFrame, thresholds: list[int], most_tokens: int) -> DataFrame:
    """(threshold, fp, fn): valid rows above each byte threshold and over-limit rows at or below it.

    Rows are counted by byte length first, so only a row per length is repeated for each threshold.
    """
    by = sizes.groupBy("n_bytes").agg(F.count_if(F.col("n_tokens") <= most_tokens).alias("valid"), F.count_if(F.col("n_tokens") > most_tokens).alias("over"))
    each = by.withColumn("threshold", F.explode(F.array(*[F.lit(t) for t in thresholds])))
    over = F.col("n_bytes") > F.col("threshold")
    return each.groupBy("threshold").agg(F.sum(F.when(over, F.col("valid")).otherwise(0)).alias("fp"), F.sum(F.when(over, 0).otherwise(F.col("over"))).alias("fn"))


def tokens(df: DataFrame, text: str) -> DataFrame:
    """(token, n, n_bytes): tokens of all rows, counted."""
    each = df.select(F.explode(F.regexp_extract_all(F.col(text), F.lit(TOKEN), F.lit(0))).alias("token"))
    return each.groupBy("token").agg(F.count(F.lit(1)).alias("n")).withColumn("n_bytes", F.octet_length("token"))


def repeatable(word: str, spark: SparkSession, most: int = 256) -> DataFrame:
    """(n, n_tokens): tokens, without the marks, of 1 to ``most`` copies of a word joined by spaces."""
    n = spark.range(1, most + 1).select(F.col("id").cast("int").alias("n"))
    return n.select("n", (token_count(F.trim(F.repeat(F.lit(word + " "), F.col("n")))) - 2).alias("n_tokens"))
