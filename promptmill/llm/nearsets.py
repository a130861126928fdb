"""Near-duplicate records by a size-aware set join (problem 5).

Records are sets of words; a pair counts if the words in both are at least ``similarity`` of the words in either.
Light sets (few words) enumerate two-word subsets of their prefix and meet on equal subsets; heavy sets scan the
inverted lists of their prefix words. The boundary is chosen by cost, from the lengths of the lists of all prefix
words, so it moves up as lists grow with the data.
The prefix is of the rarest words: two sets with an overlap of at least c share k words among the first n - c + k of
each. Position, size and a 64-bit parity sketch prune matches inside the join; the survivors are verified on words.

Equal sets are one class from the start: its representative (smallest id) is joined, its members are kept apart.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scale import fits, join_bounded, lookup, parallel, salted_pairs, ship, stage

WORDS = re.compile(r"[^\W_]+")
#: Words counted as frequent are at most this many: they get an exact place in the order; rarer ones are ordered by hash.
FREQUENT = 50_000
_ASCII_WORDS = bytes(ord(chr(c).lower()) if c < 128 and chr(c).isalnum() else 32 for c in range(256))  # lower case, or a space
SALTS = 32
#: Copies of one set up to which plain joins expand the pairs; beyond, the joins are salted. The rows are the same.
MANY_COPIES = 1000
#: Cost of a match in the join, where a row that is shuffled, sorted and joined costs 1. Measured on 8 cores with 4 million
#: rows a side: 0.8 microseconds a row, 4.5 nanoseconds a match.
MATCH_COST = 0.006


class Hashes(dict):
    """Signed 64-bit hashes of words, as text or in UTF-8, remembered."""

    def __missing__(self, word: str | bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word if isinstance(word, bytes) else word.encode("utf-8", "replace"))
        h = self[word] = h - (1 << 64) if h >> 63 else h
        return h

    def of(self, text: str) -> np.ndarray:
        """The hashes of the different words of a text, in order."""
        if len(self) > 500_000:
            self.clear()
        words = text.encode().translate(_ASCII_WORDS).split() if text.isascii() else WORDS.findall(text.lower())
        return np.array(sorted(map(self.__getitem__, set(words))), np.int64)


class Bounds:
    """What a similarity of at least ``s`` means for sizes, overlaps and prefixes, in whole numbers."""

    def __init__(self, similarity: float) -> None:
        f = Fraction(similarity).limit_denominator(1000)
        if not 0 < f <= 1:
            raise ValueError("similarity must be above 0 and at most 1")
        self.num, self.den = f.numerator, f.denominator

    def least_overlap(self, a: int, b: int) -> int:
        return -(-self.num * (a + b) // (self.num + self.den))

    def missing_probe(self, n: int) -> int:
        """Words of a set that its partner may lack, if the partner is smaller or equal."""
        return n + (-self.num * n // self.den)

    def missing_index(self, n: int) -> int:
        """The same if the partner is larger or equal."""
        return n - self.least_overlap(n, n)

    # The same as columns.
    def overlap_col(self, a: Column, b: Column) -> Column:
        return F.ceil((a + b) * self.num / (self.num + self.den) - 1e-9).cast("int")

    def probe_col(self, n: Column) -> Column:
        return n - F.ceil(n * self.num / self.den - 1e-9).cast("int")

    def index_col(self, n: Column) -> Column:
        return n - self.overlap_col(n, n)


def _statistics(rows: DataFrame, least_words: int) -> dict[int, int]:
    """Frequent words with their document frequencies.

    Counted over all rows; a task keeps at most some hundred thousand counts before it passes them on.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words: Counter = Counter()
        hashes = Hashes()
        for b in batches:
            for t in b["t"]:
                if len(s := hashes.of(t)) >= least_words:
                    words.update(s.tolist())
            if len(words) > 400_000:
                yield pd.DataFrame({"k": list(words), "n": list(words.values())})
                words.clear()
        yield pd.DataFrame({"k": list(words), "n": list(words.values())})

    words = stage(rows.mapInPandas(count, "k bigint, n bigint").groupBy("k").agg(F.sum("n").alias("n")), "counts")
    total = words.agg(F.sum("n")).first()[0] or 0
    often = max(50, total / FREQUENT)
    return {r[0]: r[1] for r in words.where(F.col("n") >= often).select("k", "n").collect()}


@dataclass
class Matches:
    """Sets of one size, the matches they meet in all as heavy ones, and what they would meet as light ones."""

    sets: int
    heavy: float
    light: float


def boundary(sizes: dict[int, Matches], bounds: Bounds, match_cost: float = MATCH_COST) -> int:
    """The size up to which enumerating two-word subsets costs less than scanning lists (0: for no size)."""
    best, at, saved = 0.0, 0, 0.0
    for n in sorted(sizes):
        i, p, m = bounds.missing_index(n), bounds.missing_probe(n), sizes[n]
        heavy = m.sets * (i + p + 2) + m.heavy * match_cost
        light = m.sets * ((i + 2) * (i + 1) / 2 + (p + 2) * (p + 1) / 2) + m.light * match_cost
        saved += heavy - light
        if saved > best:
            best, at = saved, n
    return at


def _expected(reps: DataFrame, bounds: Bounds) -> dict[int, Matches]:
    """The matches by size of the larger set, counted over the lists of all prefix words. A row for each size that occurs.

    For light sets they follow from those: two words are in one set as often as if they were independent.
    """
    lists = _signatures(reps, bounds, 0, "index").groupBy("sig").agg(F.count(F.lit(1)).alias("c"))
    asked = _signatures(reps, bounds, 0, "probe").groupBy("sig", "n").agg(F.count(F.lit(1)).alias("k"))  # before the join, so no list is long
    heavy = dict(asked.join(lists, "sig").groupBy("n").agg(F.sum(F.col("k").cast("double") * F.col("c"))).collect())
    sizes = dict(reps.groupBy("n").count().collect())
    total, out = sum(sizes.values()), {}
    for n, sets in sizes.items():
        p, h = bounds.missing_probe(n), heavy.get(n, 0.0)
        mean = h / (sets * (p + 1))
        out[n] = Matches(sets, h, sets * (p + 2) * (p + 1) / 2 * mean * mean / total)
    return out


def _prefixes(rows: DataFrame, frequent: dict[int, int], least_words: int, bounds: Bounds) -> DataFrame:
    """(id, n, same, bits, rare, prefix) of each row with enough words; ``same``: a 128-bit hash of the set's 64-bit hashes."""
    held = rows.sparkSession.sparkContext.broadcast(frequent)
    nothing = np.array([np.iinfo(np.int64).max])  # a word to look for beyond all others

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        often, hashes = held.value, Hashes()
        known = np.concatenate([np.sort(np.fromiter(often, np.int64)), nothing])
        for b in batches:
            out = []
            for i, t in zip(b["id"], b["t"], strict=True):
                hs = hashes.of(t)
                n = len(hs)
                if n < least_words:
                    continue
                is_rare = known[np.searchsorted(known, hs)] != hs
                need = bounds.missing_probe(n) + 2
                rare = hs[is_rare]
                first = rare[:need]
                if len(first) < need:
                    more = sorted(hs[~is_rare].tolist(), key=lambda h: (often[h], h))[: need - len(first)]
                    first = np.concatenate([first, np.array(more, np.int64)])
                bits = int(np.bitwise_xor.reduce(np.left_shift(np.uint64(1), hs.view(np.uint64) & np.uint64(63))))
                out.append((i, n, xxhash.xxh3_128_digest(hs), bits - (1 << 64) if bits >> 63 else bits, len(rare), first))
            yield pd.DataFrame(out, columns=["id", "n", "same", "bits", "rare", "prefix"])

    return rows.mapInPandas(make, "id bigint, n int, same binary, bits bigint, rare int, prefix array<bigint>")


def _signatures(reps: DataFrame, bounds: Bounds, light: int, role: str) -> DataFrame:
    """(sig, id, n, bits, pos, freq) of one side of the join: ``index`` for the smaller set of a pair, ``probe`` for the larger."""
    n = F.col("n")
    missing = bounds.index_col(n) if role == "index" else bounds.probe_col(n)
    base = reps.withColumn("m", missing)
    single = base.where(n * bounds.den > light * bounds.num) if role == "index" else base.where(n > light)
    single = single.select("id", "n", "bits", "rare", F.posexplode(F.slice("prefix", F.lit(1), F.col("m") + 1)).alias("pos", "sig"))
    single = single.select("sig", "id", "n", "bits", "pos", (F.col("pos") >= F.col("rare")).alias("freq"))
    if not light:
        return single
    pair = base.where(n <= light).withColumn("prefix", F.slice("prefix", F.lit(1), F.col("m") + 2))
    pair = pair.select("id", "n", "bits", "rare", "prefix", F.posexplode("prefix").alias("pos", "a"))
    pair = pair.where(F.size("prefix") > F.col("pos") + 1).select("id", "n", "bits", "rare", "pos", "a", F.explode(F.slice("prefix", F.col("pos") + 2, F.size("prefix"))).alias("b"))
    # Subsets take no part in the position bound (pos 0), and differ from single words by the hash's further argument.
    pair = pair.select(F.xxhash64(F.lit("two"), "a", "b").alias("sig"), "id", "n", "bits", F.lit(0).alias("pos"), (F.col("pos") >= F.col("rare")).alias("freq"))
    return single.union(pair)


def _candidates(reps: DataFrame, bounds: Bounds, light: int, hot_rows: int = 20_000, most_hot: int = 2000) -> DataFrame:
    """(lo, hi): pairs that pass all bounds; each true pair of representatives is among them."""
    left, right = (_signatures(reps, bounds, light, r) for r in ("index", "probe"))
    counts = stage(right.where("freq").groupBy("sig").count(), "hot")
    limit = max(hot_rows, (counts.agg(F.sum("count")).first()[0] or 0) / most_hot)
    hot = counts.where(F.col("count") > limit).select("sig", F.lit(True).alias("hot"))
    keys = ["sig"]
    if not hot.isEmpty():  # at most most_hot signatures
        salt = F.pmod(F.xxhash64("id"), F.lit(SALTS))
        left = left.join(F.broadcast(hot), "sig", "left").withColumn("salt", F.when(F.col("hot"), salt).otherwise(0).cast("int")).drop("hot")
        every = F.sequence(F.lit(0), F.lit(SALTS - 1))
        right = right.join(F.broadcast(hot), "sig", "left").withColumn("salt", F.explode(F.when(F.col("hot"), every).otherwise(F.array(F.lit(0))))).drop("hot")
        keys.append("salt")
    a = left.drop("freq").select(*keys, *[F.col(c).alias(f"{c}_a") for c in ("id", "n", "bits", "pos")])
    b = right.drop("freq").select(*keys, *[F.col(c).alias(f"{c}_b") for c in ("id", "n", "bits", "pos")])
    na, nb = F.col("n_a"), F.col("n_b")
    c = bounds.overlap_col(na, nb)
    ok = ((na < nb) | ((na == nb) & (F.col("id_a") < F.col("id_b")))) & (na * bounds.den >= nb * bounds.num)
    ok &= F.least(na - F.col("pos_a"), nb - F.col("pos_b")) >= c
    ok &= F.bit_count(F.col("bits_a").bitwiseXOR(F.col("bits_b"))) <= na + nb - 2 * c
    return a.join(b, keys).where(ok).select(F.least("id_a", "id_b").alias("lo"), F.greatest("id_a", "id_b").alias("hi")).distinct()


def _words_column(text: str) -> Column:
    text = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))
    return F.array_distinct(F.split(text, " "))


def _verified(pairs: DataFrame, rows: DataFrame, bounds: Bounds) -> DataFrame:
    """The pairs whose words, read again, reach the similarity."""
    ids = stage(pairs.select(F.col("lo").alias("id")).union(pairs.select("hi")).distinct(), "ids")
    texts = join_bounded(rows, ids, "id", "left_semi").select("id", _words_column("t").alias("w")).dropDuplicates(["id"])
    texts = stage(texts, "words")
    a, b = texts.select(F.col("id").alias("lo"), F.col("w").alias("wa")), texts.select(F.col("id").alias("hi"), F.col("w").alias("wb"))
    both = F.size(F.array_intersect("wa", "wb"))
    return lookup(lookup(pairs, a, "lo"), b, "hi").where(both * (bounds.num + bounds.den) >= (F.size("wa") + F.size("wb")) * bounds.num).select("lo", "hi")


def linked(records: DataFrame, row_id: str, texts: tuple[str, ...], similarity: float = 0.8, least_words: int = 30, light: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(pairs, members): (lo, hi) between representatives of unlike sets, and (id, rep) of sets that several ids have.

    A pair of ids counts if their representatives are a pair, or are one. Rows with fewer than ``least_words``
    distinct words (so also null and empty texts) and rows without an id take no part; repeats of an id count once.
    ``texts`` names the columns; ``light`` overrides the boundary that is chosen by cost.
    """
    spark = records.sparkSession
    ship(spark)
    bounds = Bounds(similarity)
    rows = records.select(F.col(row_id).cast("bigint").alias("id"), F.concat_ws(" ", *texts).alias("t")).where("id is not null")
    rows = rows.where(F.char_length("t") >= 2 * least_words - 1)  # fewer characters can't hold so many words
    spread = parallel(rows)
    frequent = _statistics(spread.select("t"), least_words)
    sets = stage(_prefixes(spread, frequent, least_words, bounds), "sets")
    shared = sets.groupBy("same").agg(F.min("id").alias("rep"), F.max("id").alias("last")).where("rep <> last").select("same", "rep")
    shared = stage(shared, "shared")
    some = sets.select("id", "same")
    some = some.join(F.broadcast(shared), "same") if fits(shared) else lookup(some, shared, "same").where("rep is not null")
    members = stage(some.select("id", "rep").distinct(), "members")
    reps = sets.drop("same")
    others = members.where("id <> rep").select("id")
    reps = join_bounded(reps, others, "id", "left_anti")
    light = boundary(_expected(reps, bounds), bounds) if light is None else light
    pairs = stage(_candidates(reps, bounds, light), "candidates")
    return stage(_verified(pairs, rows, bounds), "pairs"), members


def similar_pairs(records: DataFrame, row_id: str, texts: tuple[str, ...], similarity: float = 0.8, least_words: int = 30, light: int | None = None) -> DataFrame:
    """(lo, hi): every two ids whose sets of words are that similar, copies included. See ``linked`` for what takes part."""
    pairs, members = linked(records, row_id, texts, similarity, least_words, light)
    m1, m2 = (members.select(F.col("rep").alias(side), F.col("id").alias(i)) for side, i in (("lo", "i1"), ("hi", "i2")))
    copies = members.groupBy("rep").count().agg(F.max("count")).first()[0] or 0
    if copies <= MANY_COPIES:  # no class fills a task
        x = pairs.join(m1, "lo", "left").join(m2, "hi", "left").select(F.coalesce("i1", "lo").alias("i1"), F.coalesce("i2", "hi").alias("i2"))
        same = m1.join(m2, F.col("lo") == F.col("hi"))
    else:
        single = pairs.select(F.col("lo").alias("id")).union(pairs.select("hi")).distinct()
        single = join_bounded(single, members.where("id = rep").select("id"), "id", "left_anti")
        every = stage(members.select("id", "rep").union(single.select("id", F.col("id").alias("rep"))), "every")
        x = salted_pairs(pairs, every.select(F.col("rep").alias("lo"), F.col("id").alias("i1")), "lo")
        x = salted_pairs(stage(x, "first"), every.select(F.col("rep").alias("hi"), F.col("id").alias("i2")), "hi")
        same = salted_pairs(m1, m2.withColumnRenamed("hi", "lo"), "lo")
    across = x.select(F.least("i1", "i2").alias("lo"), F.greatest("i1", "i2").alias("hi"))
    return across.union(same.where("i1 < i2").select("i1", "i2"))


def groups(records: DataFrame, row_id: str, texts: tuple[str, ...], similarity: float = 0.8, least_words: int = 30) -> DataFrame:
    """(row_id, group_id, links): each id with a similar other one; its group (connected by pairs, named by the smallest
    id) and the number of similar ids. Copies of one set aren't expanded into pairs."""
    pairs, members = linked(records, row_id, texts, similarity, least_words)
    n = members.groupBy("rep").agg(F.count(F.lit(1)).alias("size"))
    reps = stage(pairs.select(F.col("lo").alias("id")).union(pairs.select("hi")).union(n.select("rep")).distinct(), "linked")
    label = components(reps, pairs)
    sized = stage(reps.join(n, reps["id"] == n["rep"], "left").select("id", F.coalesce("size", F.lit(1)).alias("size")), "sizes")
    both = stage(pairs.union(pairs.select(F.col("hi").alias("lo"), F.col("lo").alias("hi"))), "both")
    partners = lookup(both, sized.withColumnRenamed("id", "hi"), "hi").groupBy("lo").agg(F.sum("size").alias("n"))
    each = label.join(sized, "id").join(partners.withColumnRenamed("lo", "id"), "id", "left")
    each = stage(each.select(F.col("id").alias("rep"), "group_id", (F.coalesce("n", F.lit(0)) + F.col("size") - 1).alias("links"), "size"), "each")
    copies = lookup(members.select("rep", "id"), each.drop("size"), "rep").select(F.col("id").alias(row_id), "group_id", "links")
    return copies.union(each.where("size = 1").select("rep", "group_id", "links"))


def components(nodes: DataFrame, edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(id, group_id): smallest id that each node is connected with. Labels spread to neighbours and are then halved in
    length by pointer jumping, so rounds grow with the logarithm of a chain's length; each round is a staged table."""
    both = stage(edges.select("lo", "hi").union(edges.select(F.col("hi").alias("lo"), F.col("lo").alias("hi"))), "edges")
    label = stage(nodes.select("id", F.col("id").alias("group_id")), "labels")
    for _ in range(most_rounds):
        near = lookup(both, label.select(F.col("id").alias("hi"), "group_id"), "hi").groupBy(F.col("lo").alias("id")).agg(F.min("group_id").alias("g"))
        hop = label.join(near, "id", "left").select("id", F.col("group_id").alias("old"), F.least("group_id", F.coalesce("g", "group_id")).alias("group_id"))
        hop = stage(hop, "hop")
        up = hop.select(F.col("id").alias("group_id"), F.col("group_id").alias("pg"))
        new = stage(lookup(hop, up, "group_id").select("id", "old", F.least("group_id", "pg").alias("group_id")), "labels")  # large groups are split
        if new.where("old <> group_id").isEmpty():
            return new.select("id", "group_id")
        label = new.select("id", "group_id")
    raise RuntimeError(f"not converged after {most_rounds} rounds")
