"""Schemas, constants and parameter checks of the cache model."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# Defaults of the model.
THRESHOLD = 0.85
TOP_K = 10
PROMPT_BYTES = 1536
PROMPT_TOKENS = 256
EXACT_PAYLOAD_BYTES = 64 * 1024
PAYLOAD_HEADER_BYTES = 12
PAYLOAD_BYTES = (1 << 21) - 1
BODY_BYTES = 1 << 20
PENDING_MILLIS = 30_000
NODE_STATES = ("DEAD", "PENDING", "READY")
CACHE_STATES = ("UNSPECIFIED", "HIT", "MISS", "PENDING", "REJECTED")

RECORD = T.StructType([T.StructField("prompt", T.StringType()), T.StructField("payload", T.StringType())])
NODE = T.StructType(
    [
        T.StructField("node_id", T.LongType()),
        T.StructField("state", T.StringType()),
        T.StructField("hot", T.BooleanType()),
        T.StructField("version", T.IntegerType()),
        T.StructField("length", T.IntegerType()),
        T.StructField("voffset", T.LongType()),
        T.StructField("created_at", T.TimestampNTZType()),
    ]
)


@dataclass(frozen=True)
class IndexConfig:
    """Sizes of a two-tier index; raises ValueError for sizes the model rules out."""

    clusters: int = 1024
    cluster_capacity: int = 1024
    flat_capacity: int = 4096
    sample: int = 65_536
    top_k: int = TOP_K

    def __post_init__(self) -> None:
        if self.clusters <= 0 or self.clusters % 4:
            raise ValueError("clusters must be a positive multiple of 4")
        if self.flat_capacity <= 0 or self.flat_capacity & (self.flat_capacity - 1):
            raise ValueError("flat_capacity must be a power of 2")
        if self.sample <= 0 or self.sample % 4:
            raise ValueError("sample must be a positive multiple of 4")
        if not 1 <= self.top_k <= 16:
            raise ValueError("top_k must be from 1 to 16")


@dataclass(frozen=True)
class RingConfig:
    """A payload ring; watermarks are shares of its size."""

    slots: int = 524_288
    size: int = 1 << 32
    start: int = 0
    low: float = 0.5
    high: float = 0.875

    def __post_init__(self) -> None:
        if self.slots <= 0 or self.slots % 4:
            raise ValueError("slots must be a positive multiple of 4")
        if self.size <= 0 or self.size & (self.size - 1):
            raise ValueError("size must be a power of 2")
        if not 0 <= self.start < self.size:
            raise ValueError("start must be below size")


def core_list(text: str) -> list[int]:
    """Whole numbers parted by commas, with white space around them; ValueError for others, negative ones and none."""
    cores = [int(x.strip()) for x in text.split(",")]
    if any(c < 0 for c in cores):
        raise ValueError(f"negative core in {text!r}")
    return cores


def required(settings: dict[str, str | None], *names: str) -> None:
    """ValueError if one of the settings is missing or empty."""
    if missing := [n for n in names if not settings.get(n)]:
        raise ValueError(f"settings are missing: {missing}")
