"""A semantic cache over tables: check requests, commit answers, load records in bulk.

State is two tables in a folder, each written anew as an epoch; the last epoch is read. A batch sees the cache as it
was before it; equal prompts of one batch share one node, whose first request is the pioneer.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .model import PENDING_MILLIS, PROMPT_BYTES, PROMPT_TOKENS, THRESHOLD, TOP_K
from .operators import cache, encode, vectors
from .scale import lookup, ship, stage

NODES = "node_id bigint, hash string, v array<double>, state string, version int, payload string, created_ms bigint"


class SemanticCache:
    """Lookups by exact prompt, then by the nearest stored vectors at ``threshold``."""

    def __init__(self, spark: SparkSession, path: str, encoder: Callable = encode.HashedWords, threshold: float = THRESHOLD, pending_ms: int = PENDING_MILLIS) -> None:
        self.spark, self.path, self.encoder, self.threshold, self.pending_ms = spark, path.rstrip("/"), encoder, threshold, pending_ms
        self._at: str | None = None

    def nodes(self) -> DataFrame:
        return self.spark.read.parquet(self._at) if self._at else self.spark.createDataFrame([], NODES)

    def _publish(self, nodes: DataFrame) -> None:
        at = f"{self.path}/nodes-{uuid.uuid4().hex}"
        nodes.write.parquet(at)
        self._at = at  # readers switch at once

    def check(self, requests: DataFrame, now_ms: int) -> DataFrame:
        """(request_id, state, node_id, payload, reason) of each request (request_id, prompt); misses get pending nodes.

        The best candidates are walked in order of score: a ready one is a HIT; a pending one that hasn't expired is
        PENDING, even if a later one is ready; expired ones are passed over. Over-long prompts go upstream as MISS
        without a node, over-limit and empty ones are REJECTED.
        """
        r = requests.where("request_id is not null").select("request_id", "prompt").dropDuplicates(["request_id"])
        r = stage(r.withColumns({"hash": cache.digest(F.col("prompt")), "gate": cache.gate(F.col("prompt"), PROMPT_BYTES, PROMPT_TOKENS)}), "requests")
        nodes = self.nodes()
        exact = nodes.where("state = 'READY'").groupBy("hash").agg(F.min(F.struct("node_id", "payload")).alias("e"))
        r = stage(lookup(r, exact, "hash"), "exact")
        asked = r.where("e is null and gate = 'PASS'")
        firsts = asked.groupBy("hash").agg(F.min(F.struct("request_id", "prompt")).alias("f")).select(F.col("f.request_id").alias("q"), F.col("f.prompt").alias("prompt"), "hash")
        queries = stage(encode.encode(firsts, "q", "prompt", self.encoder).withColumnRenamed("vec_id", "query_id"), "queries")
        live = nodes.where(f"state = 'READY' or state = 'PENDING' and {now_ms} - created_ms <= {self.pending_ms}")
        found = vectors.top_k(queries, live.select(F.col("node_id").alias("vec_id"), "v"), TOP_K).where(F.col("score") >= self.threshold)
        found = found.join(live.select(F.col("node_id").alias("vec_id"), "state", "payload"), "vec_id").groupBy("query_id").agg(F.min(F.struct("rnk", "vec_id", "state", "payload")).alias("b"))
        near = firsts.select("hash", "q").join(found, F.col("q") == F.col("query_id"), "left").join(queries.select(F.col("query_id").alias("q"), "v"), "q", "left").select("hash", "q", "b", "v")
        top = self.spark.createDataFrame([(0,)], "x int") if self._at is None else nodes.agg(F.coalesce(F.max("node_id") + 1, F.lit(0)).alias("x"))
        base = top.first()[0]
        # New ids: the pioneer's own request id shifted behind the ids in use; unique without a global order.
        near = stage(near.withColumn("new_id", F.when(F.col("b").isNull() & F.col("v").isNotNull(), F.col("q") + base)), "near")
        fresh = near.where("new_id is not null").select(F.col("new_id").alias("node_id"), "hash", "v", F.lit("PENDING").alias("state"), F.lit(1).alias("version"), F.lit(None).cast("string").alias("payload"), F.lit(now_ms).cast("bigint").alias("created_ms"))
        self._publish(nodes.unionByName(fresh))
        got = lookup(r, near.drop("v"), "hash")
        hit = F.col("e").isNotNull()
        pioneer = F.col("request_id") == F.col("q")
        state = (
            F.when(hit, "HIT").when(F.col("gate") == "BYPASS", "MISS").when(F.col("gate") != "PASS", "REJECTED")
            .when(F.col("b.state") == "READY", "HIT").when(F.col("b").isNotNull(), "PENDING").when(F.col("new_id").isNull(), "REJECTED").when(pioneer, "MISS").otherwise("PENDING")
        )
        reason = F.when(state == "REJECTED", F.when(F.col("gate") == "PASS", "DEGENERATE").otherwise(F.col("gate")))
        return got.select("request_id", state.alias("state"), F.coalesce("e.node_id", "b.vec_id", "new_id").alias("node_id"), F.when(state == "HIT", F.coalesce("e.payload", "b.payload")).alias("payload"), reason.alias("reason"))

    def commit(self, answers: DataFrame, now_ms: int) -> DataFrame:
        """(node_id, success) for answers (node_id, payload): only pending nodes within their life take one, the smallest text if several come."""
        nodes = self.nodes()
        a = answers.where("node_id is not null and payload is not null and payload <> ''").groupBy("node_id").agg(F.min("payload").alias("new"))
        joined = nodes.join(a, "node_id", "left")
        ok = F.col("new").isNotNull() & (F.col("state") == "PENDING") & (F.lit(now_ms) - F.col("created_ms") <= self.pending_ms)
        after = stage(joined.withColumn("ok", ok), "commit")
        out = answers.select("node_id").distinct().join(after.where("ok").select("node_id", "ok"), "node_id", "left").select("node_id", F.coalesce("ok", F.lit(False)).alias("success"))
        out = stage(out, "committed")
        done = F.col("ok")
        self._publish(after.select("node_id", "hash", "v", F.when(done, "READY").otherwise(F.col("state")).alias("state"), "version", F.when(done, F.col("new")).otherwise(F.col("payload")).alias("payload"), "created_ms"))
        return out

    def sweep(self, now_ms: int) -> int:
        """Remove pending nodes past their life; returns how many."""
        nodes = self.nodes()
        old = (F.col("state") == "PENDING") & (F.lit(now_ms) - F.col("created_ms") > self.pending_ms)
        n = nodes.where(old).count()
        if n:
            self._publish(nodes.where(~old))
        return n

    def load(self, records: DataFrame, now_ms: int) -> DataFrame:
        """Bulk load of records (record_id, prompt, payload): (outcome, n) of inserted, already cached and skipped ones."""
        r = stage(records.select(F.col("record_id").alias("request_id"), "prompt", "payload"), "load")
        state = stage(self.check(r, now_ms), "checked")
        got = self.commit(state.where("state = 'MISS' and node_id is not null").select("request_id", "node_id").join(r, "request_id").select("node_id", "payload"), now_ms)
        done = state.join(got, "node_id", "left")
        outcome = F.when((F.col("state") == "MISS") & F.coalesce("success", F.lit(False)), "inserted").when(F.col("state").isin("HIT", "PENDING"), "already_cached").otherwise("skipped")
        return done.groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def generate(requests: DataFrame, provider: Callable[[str], str | None]) -> DataFrame:
    """(request_id, payload): answers of an upstream provider, called in the tasks; None or an error gives no payload."""
    ship(requests.sparkSession)

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for p in b["prompt"]:
                try:
                    out.append(provider(p))
                except Exception:  # noqa: BLE001 - any failure of the provider is a miss
                    out.append(None)
            yield pd.DataFrame({"request_id": b["request_id"], "payload": pd.Series(out, dtype=object)})

    return requests.select("request_id", "prompt").mapInPandas(call, "request_id bigint, payload string")
