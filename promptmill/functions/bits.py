"""The packed control block, versions, ring addresses and hashes, as whole-number expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bits of the control block, from the top: state 2, hot 1, version 4, length 21, offset 36.
STATE, HOT, VERSION, LENGTH = 62, 61, 57, 36
FNV_START, FNV_PRIME = 2166136261, 16777619


def _part(x: Column, bits: int) -> Column:
    return x.cast("bigint").bitwiseAND(F.lit((1 << bits) - 1))


def pack(state: Column, hot: Column, version: Column, length: Column, offset: Column) -> Column:
    """The control block; what exceeds a field's bits is cut off."""
    parts = (F.shiftleft(_part(state, 2), STATE), F.shiftleft(_part(hot, 1), HOT), F.shiftleft(_part(version, 4), VERSION), F.shiftleft(_part(length, 21), LENGTH))
    out = _part(offset, 36)
    for p in parts:
        out = out.bitwiseOR(p)
    return out


def unpack(block: Column) -> Column:
    """Struct of state, hot, version, length and offset."""

    def part(at: int, bits: int) -> Column:
        return F.shiftrightunsigned(block, at).bitwiseAND(F.lit((1 << bits) - 1))

    return F.struct(part(STATE, 2).cast("int").alias("state"), part(HOT, 1).cast("int").alias("hot"), part(VERSION, 4).cast("int").alias("version"), part(LENGTH, 21).cast("int").alias("length"), part(0, 36).alias("offset"))


def next_version(version: Column) -> Column:
    return (version + 1).bitwiseAND(F.lit(15))


def overlaps(offset_a: Column, length_a: Column, offset_b: Column, length_b: Column) -> Column:
    return (offset_a < offset_b + length_b) & (offset_b < offset_a + length_a)


def ring_index(offset: Column, size: int) -> Column:
    return offset.bitwiseAND(F.lit(size - 1))


def first_chunk(offset: Column, length: Column, size: int) -> Column:
    """Bytes that fit before the ring wraps; the rest starts at its beginning."""
    return F.least(length, F.lit(size) - ring_index(offset, size))


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a of an ASCII text."""
    codes = F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.ascii(F.substring(text, i, F.lit(1))))
    h = F.aggregate(codes, F.lit(FNV_START).cast("bigint"), lambda h, b: F.pmod(h.bitwiseXOR(b.cast("bigint")) * FNV_PRIME, F.lit(1 << 32)))
    return F.when(F.length(text) > 0, h).otherwise(F.lit(FNV_START).cast("bigint"))


def shard(hash_or_id: Column, shards: int = 256) -> Column:
    return hash_or_id.bitwiseAND(F.lit(shards - 1)).cast("int")
