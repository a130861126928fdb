"""Exact cache, gates, semantic decisions, replay, commits and coalescing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import token_count
from ..model import EXACT_PAYLOAD_BYTES, PROMPT_BYTES, PROMPT_TOKENS, THRESHOLD
from ..scale import lookup, ship


def digest(prompt: Column) -> Column:
    return F.sha2(prompt, 256)


def repeats(requests: DataFrame, row_id: str, prompt: str) -> DataFrame:
    """(row_id, hash, hit): whether an earlier row (by id) had the very same prompt. Repeated ids count once.

    The first row of a hash is found by an aggregation; the join back has the id in its key, so a prompt that a third
    of all rows ask is spread over all tasks.
    """
    rows = requests.where(F.col(row_id).isNotNull() & F.col(prompt).isNotNull()).select(F.col(row_id), digest(F.col(prompt)).alias("hash")).distinct()
    first = rows.groupBy("hash").agg(F.min(row_id).alias(row_id)).withColumn("first", F.lit(True))
    return rows.join(first, ["hash", row_id], "left").select(row_id, "hash", F.col("first").isNull().alias("hit"))


def exact_put(records: DataFrame, prompt: str, payload: str, when: str, row_id: str, most_bytes: int = EXACT_PAYLOAD_BYTES) -> DataFrame:
    """(hash, row_id, n_bytes): what the exact cache holds after all records were put: of each prompt the last one whose
    payload is below ``most_bytes``. Records without a time count as the earliest; ties go to the greater id."""
    rows = records.where(F.col(prompt).isNotNull() & F.col(payload).isNotNull() & (F.octet_length(payload) < most_bytes))
    order = F.struct(F.coalesce(F.col(when), F.lit("0001-01-01 00:00:00").cast("timestamp_ntz")).alias("t"), F.col(row_id).alias("i"))
    last = rows.groupBy(digest(F.col(prompt)).alias("hash")).agg(F.max(F.struct(order.alias("o"), F.octet_length(payload).alias("n"))).alias("x"))
    return last.select("hash", F.col("x.o.i").alias(row_id), F.col("x.n").cast("bigint").alias("n_bytes"))


def exact_hits(requests: DataFrame, cache: DataFrame, row_id: str, prompt: str) -> DataFrame:
    """``requests`` (row_id) against a cache with one row per hash: left join that splits hot prompts off."""
    rows = requests.where(F.col(row_id).isNotNull() & F.col(prompt).isNotNull()).select(F.col(row_id), digest(F.col(prompt)).alias("hash")).distinct()
    return lookup(rows, cache, "hash")


def gate(prompt: Column, most_bytes: int = PROMPT_BYTES, most_tokens: int = PROMPT_TOKENS) -> Column:
    """EMPTY, BYPASS (too long for the semantic search), OVER_TOKENS or PASS; the cheapest test first."""
    empty = prompt.isNull() | (prompt == "")
    return F.when(empty, "EMPTY").when(F.octet_length(prompt) > most_bytes, "BYPASS").when(token_count(prompt) > most_tokens, "OVER_TOKENS").otherwise("PASS")


def decide(found: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(query_id, vec_id, score, decision) of the best candidate of each query: HIT at ``threshold`` or above."""
    top = found.where("rnk = 1")
    hit = F.col("score") >= threshold
    return top.select("query_id", F.when(hit, F.col("vec_id")).alias("vec_id"), F.round("score", 6).alias("score"), F.when(hit, "HIT").otherwise("MISS").alias("decision"))


def replay(rows: DataFrame, threshold: float, capacity: int = 1024) -> DataFrame:
    """(vec_id, cluster_id, decision, matched): replay of a cache in order of vec_id, by cluster.

    A row that has an inserted one of its cluster at ``threshold`` or above is a HIT of the best such (ties to the
    smaller id); else a MISS, which is inserted, or REJECTED once the cluster holds ``capacity`` vectors. ``rows`` has
    (vec_id, v, cluster_id). The order makes a cluster sequential: its rows stream through one task, which keeps no
    more than ``capacity`` vectors.
    """
    ship(rows.sparkSession)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, ids, held, n = None, np.empty(0), np.empty(0), 0
        for b in batches:
            out = []
            for i, v, c in zip(b["vec_id"], b["v"], b["cluster_id"], strict=True):
                v = np.asarray(v, np.float64)
                if c != at:
                    at, n, ids, held = c, 0, np.zeros(capacity, np.int64), np.zeros((capacity, len(v)))
                s = np.round(held[:n] @ v, 12)
                if n and s.max() >= threshold:
                    out.append((i, c, "HIT", int(ids[int(s.argmax())])))  # the first of equals has the smallest id
                elif n == capacity:
                    out.append((i, c, "REJECTED", None))
                else:
                    ids[n], held[n] = i, v
                    n += 1
                    out.append((i, c, "MISS", None))
            df = pd.DataFrame(out, columns=["vec_id", "cluster_id", "decision", "matched"])
            yield df.assign(matched=df["matched"].astype("Int64"))

    rows = rows.where("vec_id is not null and v is not null").select("vec_id", "v", "cluster_id").repartition("cluster_id").sortWithinPartitions("cluster_id", "vec_id")
    return rows.mapInPandas(fold, "vec_id bigint, cluster_id int, decision string, matched bigint")
