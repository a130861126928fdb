"""The request front: method, body bound, prompt at a path, and what a cache-only request may get."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import extract
from ..model import BODY_BYTES


def status(method: Column, body: Column, path: str | Sequence[str] = "prompt", most_bytes: int = BODY_BYTES) -> Column:
    """405 for another method than POST, 400 for a body that is missing, over the bound or without a prompt, else 200."""
    return F.when(~F.coalesce(method == "POST", F.lit(False)), 405).when(F.coalesce(F.octet_length(body), F.lit(0)) > most_bytes, 400).when(extract(body, path).isNull(), 400).otherwise(200)


def answer(status: Column, cached: Column, cache_only: Column) -> Column:
    """Where a request's answer comes from: CACHE, UPSTREAM, NOT_FOUND (a cache-only one that isn't cached) or ERROR.

    Cache-only is a header that equals 'true'.
    """
    return F.when(status != 200, "ERROR").when(F.coalesce(cached, F.lit(False)), "CACHE").when(F.coalesce(cache_only == "true", F.lit(False)), "NOT_FOUND").otherwise("UPSTREAM")
