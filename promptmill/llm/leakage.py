"""Held-out passages in a corpus (problem 7): a prefix-filtered join of word shingles with exact verification.

A passage of ``least`` words holds ``least - 4`` shingles of five words in a row, and a document that has the passage
has all of them. Hence the rarest of them (by document frequency over the whole corpus) is a sufficient prefix: items
and documents meet only on it. Position bounds place the item's window, and the shingles around are compared.

The corpus is read once, whatever the number of items: a bitmap of the items' shingles, of bounded size, tells a task
which shingles of a document may be an item's. It keeps runs long enough to hold a passage and counts documents.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scale import fits, lookup, parallel, salted_pairs, ship, stage

WORDS = re.compile(r"[^\W_]+")
SHINGLE = 5
#: Greatest bitmap: 2 ** 29 bits are 64 MB. More items make it denser, so more is looked at, but the result is the same.
MOST_BITS = 29
SEGMENT = 64
_P = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[str]:
    return WORDS.findall(text.lower()) if text else []


class Hashes(dict):
    """64-bit hashes of words, remembered."""

    def __missing__(self, word: str) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "replace"))
        return h

    def shingles(self, text: str | None, least: int) -> np.ndarray:
        """64-bit hashes of the five-word shingles at each position; none for texts of fewer than ``least`` words."""
        ws = words(text)
        if len(ws) < least:
            return np.empty(0, np.uint64)
        if len(self) > 500_000:
            self.clear()
        x = np.fromiter(map(self.__getitem__, ws), np.uint64, len(ws))
        h = x[: len(x) - SHINGLE + 1].copy()
        with np.errstate(over="ignore"):
            for k in range(1, SHINGLE):
                h = (h * _P) ^ x[k : len(x) - SHINGLE + 1 + k]
                h ^= h >> np.uint64(29)
        return h


def _item_shingles(items: DataFrame, parts: int, kind: str, least: int) -> DataFrame:
    """(i, part, t, hs): shingles of each part that has ``least`` words; ``t`` tells texts of one item and part apart."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = Hashes()
        for b in batches:
            out = []
            for k in range(parts):
                for i, text in zip(b["_i"], b[f"_p{k}"], strict=True):
                    if len(h := hashes.shingles(text, least)):
                        out.append((i, k, h.view(np.int64)))
            yield pd.DataFrame(out, columns=["i", "part", "hs"])

    rows = parallel(items).mapInPandas(make, f"i {kind}, part int, hs array<bigint>")
    return rows.select("i", "part", F.xxhash64("hs").alias("t"), "hs").dropDuplicates(["i", "part", "t"])


def _places(h: Column, bits: int) -> Column:
    """Two places of a shingle in the bitmap."""
    mask = F.lit((1 << bits) - 1)
    return F.array(h.bitwiseAND(mask), F.shiftrightunsigned(h, 64 - bits))


def _bitmap(shingles: DataFrame, bits: int) -> np.ndarray:
    """The bitmap: blocks of 32,768 bits, made where the shingles are; the driver gets 2 ** bits bits at most."""
    at = shingles.select(F.explode(_places(F.col("h"), bits)).alias("x"))
    blocks = at.groupBy(F.shiftright("x", 15).alias("b")).agg(F.bitmap_construct_agg(F.col("x").bitwiseAND(F.lit(32767))).alias("m"))
    out = np.zeros(1 << (bits - 3), np.uint8)
    for b, m in blocks.toLocalIterator():
        out[b << 12 : (b << 12) + 4096] = np.frombuffer(m, np.uint8)
    return out


def _document_runs(docs: DataFrame, held, bits: int, kind: str, least: int) -> DataFrame:
    """Of each document the runs of shingles that may be an item's and could hold a passage, in segments (d, first, n,
    run: ``n`` shingles from ``first`` with what stands around them), and how many documents have a shingle (h, n)."""
    wide = least - SHINGLE + 1

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bitmap, hashes, count = held.value, Hashes(), Counter()
        mask, high = np.uint64((1 << bits) - 1), np.uint64(64 - bits)
        names = ["d", "first", "n", "run", "h"]

        def has(x: np.ndarray) -> np.ndarray:
            return (bitmap[x >> np.uint64(3)] >> (x & np.uint64(7)).astype(np.uint8)) & 1

        def counted() -> pd.DataFrame:
            got = pd.DataFrame({"d": None, "first": 0, "n": list(count.values()), "run": None, "h": list(count)}).astype({"h": "int64", "n": "int64"})
            count.clear()
            return got[names]

        for b in batches:
            out = []
            for d, text in zip(b["_d"], b["_t"], strict=True):
                h = hashes.shingles(text, least)
                if not len(h):
                    continue
                at = np.flatnonzero(has(h & mask))
                at = at[has(h[at] >> high) == 1]
                if not len(at):
                    continue
                h = h.view(np.int64)
                count.update(set(h[at].tolist()))
                for run in np.split(at, np.flatnonzero(np.diff(at) != 1) + 1):
                    a, e = int(run[0]), int(run[-1]) + 1
                    if e - a < wide:
                        continue
                    for s in range(a, e, SEGMENT):
                        lo, hi = max(a, s - wide + 1), min(e, s + SEGMENT + wide - 1)
                        out.append((d, s - lo, min(SEGMENT, e - s), h[lo:hi], 0))
                if len(out) > 2000:
                    yield pd.DataFrame(out, columns=names)
                    out = []
            yield pd.DataFrame(out, columns=names)
            if len(count) > 200_000:
                yield counted()
        yield counted()

    return docs.mapInPandas(scan, f"d {kind}, first int, n bigint, run array<bigint>, h bigint")


def _prefixes(ranked: DataFrame, kind: str, least: int) -> DataFrame:
    """(h, i, left, right): for each window of an item its rarest shingle (ties to the smaller hash), with the
    shingles before (nearest first) and after it that a window around it can hold. Windows of which no document has
    some shingle are left out."""
    wide = least - SHINGLE + 1

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, hs, ns in zip(b["i"], b["hs"], b["ns"], strict=True):
                h, n = np.asarray(hs, np.int64), np.asarray(ns, np.int64)
                rank = np.empty(len(h), np.int64)
                rank[np.lexsort((h, n))] = np.arange(len(h))
                at = np.lib.stride_tricks.sliding_window_view(rank, wide).argmin(1) + np.arange(len(h) - wide + 1)
                known = np.lib.stride_tricks.sliding_window_view(n > 0, wide).all(1)
                for p in np.unique(at[known]).tolist():
                    out.append((int(h[p]), i, h[max(0, p - wide + 1) : p][::-1], h[p + 1 : p + wide]))
            yield pd.DataFrame(out, columns=["h", "i", "left", "right"])

    return ranked.mapInPandas(make, f"h bigint, i {kind}, left array<bigint>, right array<bigint>")


def _common(a: str, b: str) -> Column:
    """How many leading values two arrays have in common."""
    differs = F.array_position(F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False))), F.lit(False))
    return F.when(differs == 0, F.size(a)).otherwise(differs - 1)


def leaked(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", parts: tuple[str, ...] = ("prompt", "payload"), least: int = 12, most_bits: int = MOST_BITS) -> DataFrame:
    """(doc_id, item_id): the document holds at least ``least`` consecutive words of one of the item's parts.

    Parts with fewer than ``least`` words, null or empty texts and null ids match nothing; each pair comes out once,
    however often ids or rows repeat; other columns don't matter. Words are compared by 64-bit hashes of shingles, of
    which ``least - 4`` in a row must be equal. ``least`` must be at least 5.
    """
    if least < SHINGLE:
        raise ValueError("least must be at least the shingle's five words")
    spark = documents.sparkSession
    ship(spark)
    wide = least - SHINGLE + 1
    docs = parallel(documents.select(F.col(doc_id).alias("_d"), F.col(text).alias("_t")).where("_d is not null and _t is not null"))
    items = items.select(F.col(item_id).alias("_i"), *[F.col(p).alias(f"_p{k}") for k, p in enumerate(parts)]).where("_i is not null")
    d_type, i_type = (dict(df.dtypes)[c] for df, c in ((docs, "_d"), (items, "_i")))
    of_items = stage(_item_shingles(items, len(parts), i_type, least), "items")
    shingles = of_items.select("i", "part", "t", F.posexplode("hs").alias("pos", "h"))
    total = of_items.agg(F.sum(F.size("hs"))).first()[0] or 0
    bits = min(most_bits, max(20, (32 * total).bit_length()))
    held = spark.sparkContext.broadcast(_bitmap(shingles, bits))
    got = stage(_document_runs(docs, held, bits, d_type, least), "runs")
    counts = got.where("d is null").groupBy("h").agg(F.sum("n").alias("n"))
    ranked = lookup(shingles, counts, "h").groupBy("i", "part", "t").agg(F.array_sort(F.collect_list(F.struct("pos", "h", F.coalesce("n", F.lit(0)).alias("n")))).alias("x"))
    prefixes = stage(_prefixes(ranked.select("i", F.col("x.h").alias("hs"), F.col("x.n").alias("ns")), i_type, least), "prefixes")
    each = got.where("d is not null").select("d", "run", F.explode(F.sequence(F.col("first"), (F.col("first") + F.col("n") - 1).cast("int"))).alias("k"))
    k = F.col("k")
    before = F.reverse(F.slice("run", F.greatest(F.lit(1), k - (wide - 2)), F.least(k, F.lit(wide - 1))))
    each = each.select("d", F.col("run")[k].alias("h"), before.alias("before"), F.slice("run", k + 2, F.lit(wide - 1)).alias("after"))
    wanted = prefixes.select("h").distinct()
    each = stage(each.join(F.broadcast(wanted) if fits(wanted) else wanted, "h", "left_semi"), "places")
    pairs = salted_pairs(each, prefixes, "h")
    room = F.least(F.size("before"), F.size("left")) + F.least(F.size("after"), F.size("right")) + 1
    pairs = pairs.where(room >= wide).where(_common("before", "left") + _common("after", "right") + 1 >= wide)
    return pairs.select(F.col("d").alias(doc_id), F.col("i").alias(item_id)).distinct()
