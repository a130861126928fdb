"""Items of varying length in containers of fixed capacity (problem 6), by swap-based local search.

Items are spread over shards of bounded size by a hash of their id; each shard is packed by itself. Items are laid
into bins as they arrive; then documents are moved, or exchanged one for one, two for one, one for two and two for two,
between underfull bins. Each step raises the sum of squared fills, so full bins get fuller and sparse ones empty.
"""

from __future__ import annotations

import random
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scale import parallel, ship, stage
from . import tokens as tk


@dataclass
class Start:
    """What the search began with: bins in use and the sum of squared fills."""

    bins: int
    squares: int


class Packing:
    """Bins of one shard. ``where`` finds underfull bins by (free room, size of one or two items in them)."""

    def __init__(self, sizes: list[int], capacity: int) -> None:
        self.sizes, self.capacity = sizes, capacity
        self.bins: list[list[int]] = []
        self.fill: list[int] = []
        self.where: dict[tuple[int, int], set[int]] = defaultdict(set)
        self.twos: dict[tuple[int, int], set[int]] = defaultdict(set)
        self.free: dict[int, set[int]] = defaultdict(set)
        self.least = -(-sum(sizes) // capacity)
        self._lay(range(len(sizes)))
        self.used = sum(map(bool, self.bins))
        self.start = Start(self.used, self.squares())

    def squares(self) -> int:
        return sum(f * f for f in self.fill)

    def _lay(self, items: Iterable[int]) -> None:
        """Items in this order, each into the fullest of new bins with room. The bits of ``mask`` are the amounts of room to be had."""
        room: dict[int, list[int]] = defaultdict(list)
        mask, first = 0, len(self.bins)
        for i in items:
            size = self.sizes[i]
            if fits := mask >> size:
                f = size + (fits & -fits).bit_length() - 1
                b = room[f].pop()
                if not room[f]:
                    mask ^= 1 << f
                self.bins[b].append(i)
                self.fill[b] += size
            else:
                b, f = len(self.bins), self.capacity
                self.bins.append([i])
                self.fill.append(size)
            room[f - size].append(b)
            mask |= 1 << (f - size)
        for b in range(first, len(self.bins)):
            self._enter(b)

    def _keys(self, b: int) -> Iterator[tuple[dict, tuple[int, int]]]:
        """The places of an underfull bin in the index."""
        f = self.capacity - self.fill[b]
        if f > 0 and self.bins[b]:
            yield self.free, f
            of = [self.sizes[i] for i in self.bins[b]]
            once = sorted(set(of))
            for k, x in enumerate(once):
                yield self.where, (f, x)
                for y in once[k + (of.count(x) < 2) :]:
                    yield self.twos, (f, x + y)

    def _enter(self, b: int) -> None:
        for index, key in self._keys(b):
            index[key].add(b)

    def _leave(self, b: int) -> None:
        for index, key in self._keys(b):
            if (at := index.get(key)) is not None:
                at.discard(b)
                if not at:
                    del index[key]

    def _trade(self, a: int, give: list[int], b: int, take: list[int]) -> None:
        self._leave(a)
        self._leave(b)
        for x, y, items in ((a, b, give), (b, a, take)):
            for i in items:
                self.bins[x].remove(i)
                self.bins[y].append(i)
                self.fill[x] -= self.sizes[i]
                self.fill[y] += self.sizes[i]
        self.used -= not self.bins[a]
        self._enter(a)
        self._enter(b)

    @staticmethod
    def _other(found: set[int] | None, a: int) -> int | None:
        return next((b for b in found if b != a), None) if found else None

    def _of(self, b: int, size: int) -> list[int]:
        return [next(i for i in self.bins[b] if self.sizes[i] == size)]

    def _two_of(self, b: int, size: int) -> list[int]:
        seen: dict[int, int] = {}
        for i in self.bins[b]:
            if (j := seen.get(size - self.sizes[i])) is not None:
                return [j, i]
            seen[self.sizes[i]] = i
        raise AssertionError("the index names a pair that the bin lacks")

    def _improve(self, a: int) -> bool:
        """One step that takes from bin ``a`` and gives to a bin that ends up fuller than ``a`` was: the one that leaves
        the least room there. Its net size d raises the sum of squares by 2 d (fill of the other + d - fill of a)."""
        items = sorted(self.bins[a], key=lambda i: -self.sizes[i])
        one: dict[int, list[int]] = {}
        two: dict[int, list[int]] = {}
        for k, x in enumerate(items):
            one.setdefault(self.sizes[x], [x])
            for y in items[k + 1 :]:
                two.setdefault(self.sizes[x] + self.sizes[y], [x, y])
        rooms = sorted(self.free)
        for size, give in one.items():  # moves
            for f in rooms:
                if f >= size and self.capacity - f + size > self.fill[a] and (b := self._other(self.free[f], a)) is not None:
                    self._trade(a, give, b, [])
                    return True
        kinds = ((one, self.where, self._of), (two, self.where, self._of), (one, self.twos, self._two_of), (two, self.twos, self._two_of))
        for given, index, pick in kinds:  # exchanges that fill the other bin to the brim
            for size, give in given.items():
                for f in rooms:
                    if f < size and (b := self._other(index.get((f, size - f)), a)) is not None:
                        self._trade(a, give, b, pick(b, size - f))
                        return True
        best, how = None, None
        for given, index, pick in kinds:  # any other that improves
            for (f, taken), found in index.items():
                for size, give in given.items():
                    d = size - taken
                    if 0 < d <= f and (best is None or f - d < best) and self.capacity - f + d > self.fill[a] and (b := self._other(found, a)) is not None:
                        best, how = f - d, (give, b, taken, pick)
        if how is None:
            return False
        give, b, taken, pick = how
        self._trade(a, give, b, pick(b, taken))
        return True

    def climb(self) -> None:
        """Steps from the sparsest bins on, until no bin could be saved any more or no step improves."""
        changed = True
        while changed and self.used > self.least:
            changed = False
            for a in sorted((b for b, f in enumerate(self.fill) if 0 < f < self.capacity), key=lambda b: (self.fill[b], b)):
                while 0 < self.fill[a] < self.capacity and self.used > self.least and self._improve(a):
                    changed = True

    def search(self, kicks: int = 16, seed: int = 3) -> None:
        """Climb; then, up to ``kicks`` times, lay the underfull bins and as many full ones anew, largest items first,
        climb again, and go back if that is no better. Ends early where the items can't be held by fewer bins."""
        self.climb()
        rng = random.Random(seed)
        for _ in range(kicks):
            if self.used <= self.least:
                return
            kept, before = (self.bins, self.fill, self.used), self.squares()
            self.bins, self.fill = [list(x) for x in self.bins if x], [f for f, x in zip(self.fill, self.bins, strict=True) if x]
            under = [b for b, f in enumerate(self.fill) if f < self.capacity]
            full = [b for b, f in enumerate(self.fill) if f == self.capacity and len(self.bins[b]) > 1]
            anew = set(under) | set(rng.sample(full, min(len(full), len(under))))
            items = sorted((i for b in anew for i in self.bins[b]), key=lambda i: (-self.sizes[i], i))
            self.bins, self.fill = [x for b, x in enumerate(self.bins) if b not in anew], [f for b, f in enumerate(self.fill) if b not in anew]
            self._clear()
            self._lay(items)
            self.used = len(self.bins)
            self.climb()
            if (self.used, -self.squares()) > (kept[2], -before):
                self.bins, self.fill, self.used = kept
        self._clear()

    def _clear(self) -> None:
        for index in (self.where, self.twos, self.free):
            index.clear()

    def numbered(self) -> list[int]:
        out = [0] * len(self.sizes)
        for n, items in enumerate(x for x in self.bins if x):
            for i in items:
                out[i] = n
        return out


def pack(sizes: list[int], capacity: int, kicks: int = 16) -> list[int]:
    """The bin of each item; items are at most ``capacity``, bins are numbered from 0 without gaps."""
    p = Packing(sizes, capacity)
    p.search(kicks)
    return p.numbered()


def _parts(documents: DataFrame, doc_id: str, text: str, capacity: int, shard_parts: int, path: str) -> DataFrame:
    """(_d, part, tokens, shard) of the parts to be packed."""
    ship(documents.sparkSession)
    rows = parallel(documents.select(F.col(doc_id).alias("_d"), F.col(text).alias("_t")).where("_d is not null"))

    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc, _ = tk.encoding(path)
        for s in batches:
            yield pd.Series([len(enc.encode_ordinary(t.encode("utf-8", "replace").decode())) if t else 0 for t in s], dtype="int64")

    sized = stage(rows.select("_d", F.pandas_udf(count, "bigint")("_t").alias("n")), "sizes")
    parts = F.greatest(F.lit(1), F.ceil(F.col("n") / capacity)).cast("int")
    total = sized.agg(F.sum(parts)).first()[0] or 0
    shards = max(1, -(-total // shard_parts))
    items = sized.select("_d", "n", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    items = items.select("_d", "part", F.least(F.lit(capacity), F.col("n") - F.col("part") * capacity).cast("int").alias("tokens"))
    return items.withColumn("shard", F.pmod(F.xxhash64("_d", "part"), F.lit(shards)))


def packed(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = 2048, shard_parts: int = 20_000, kicks: int = 16, path: str = tk.TOKENIZER) -> DataFrame:
    """(doc_id, part, bin_id, tokens, token_from): the bin of every document.

    Only a text longer than ``capacity`` is divided: into parts of the capacity and a rest. Null and empty texts have
    0 tokens and lie in some bin too. ids must be unique; rows without an id are left out. Bins of different shards
    differ; a shard has about ``shard_parts`` parts, which bounds a task whatever the sources' sizes. ``kicks``: see
    ``Packing.search``.
    """
    items = _parts(documents, doc_id, text, capacity, shard_parts, path)

    def fill(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_d", "part"], kind="stable")
        bins = pack(pdf["tokens"].tolist(), capacity, kicks)
        base = int(key[0]) << 32
        return pd.DataFrame({doc_id: pdf["_d"], "part": pdf["part"], "bin_id": [base + b for b in bins], "tokens": pdf["tokens"], "token_from": pdf["part"] * capacity})

    kind = dict(items.dtypes)["_d"]
    return items.groupBy("shard").applyInPandas(fill, f"`{doc_id}` {kind}, part int, bin_id bigint, tokens int, token_from int")


def emptied(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = 2048, shard_parts: int = 20_000, kicks: int = 16, path: str = tk.TOKENIZER) -> DataFrame:
    """(capacity, parts, tokens, start_bins, bins, least_bins) of what ``packed`` does (one row): bins before and after
    the search, and how many the tokens of each shard need at least."""
    items = _parts(documents, doc_id, text, capacity, shard_parts, path)

    def measure(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        p = Packing(pdf.sort_values(["_d", "part"], kind="stable")["tokens"].tolist(), capacity)
        p.search(kicks)
        return pd.DataFrame({"parts": [len(pdf)], "tokens": [sum(p.sizes)], "start_bins": [p.start.bins], "bins": [p.used], "least_bins": [p.least]})

    names = ("parts", "tokens", "start_bins", "bins", "least_bins")
    got = items.groupBy("shard").applyInPandas(measure, ", ".join(f"{n} bigint" for n in names))
    return got.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names]).select(F.lit(capacity).alias("capacity"), *names)
