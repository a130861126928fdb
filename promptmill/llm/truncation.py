"""Values cut by a size limit or in transfer (problem 2).

Whole-looking values are cut artificially, at random and at the sources' limits, to get positives; a hashed logistic
regression learns from closing characters, punctuation, open structures and the distance to the source's limit, and then
scores every value. Only the fit uses a bounded sample; closing words, closing lines of code, limits and scores come from
all rows. One pass over the values gives the statistics and the sample, another the scores.
"""

from __future__ import annotations

import json
import math
import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scale import fits, lookup, parallel, ship, stage

BITS = 18
#: Rows that the fit may use at most; the limit is of labelled rows only, as the scoring covers everything.
SAMPLE_ROWS = 12_000
NEAR = 3  # bytes from a limit: a cut inside a character leaves a little less, or more where a mark replaces the rest

_fence = re.compile(r"^\s*(?:```|~~~)", re.M)
_item = re.compile(r"^\s*(?:[-*•+]|\d+[.)])\s", re.M)
_code = re.compile(r"^(?:\s*(?:def|class|func|function|import|from|return|if|for|while|const|let|var|public|SELECT|INSERT|UPDATE|CREATE|WITH)\b.*[\w({:;,*)]$| {4,}\S)", re.M)
_stop = re.compile(r"[.!?。！？…](?:[\"'»”’)\]*_]*)(?=\s|$)")
_final = re.compile(r"[.!?。！？…][\"'»”’)\]*_`]*$")
_word = re.compile(r"[^\W_]+")
_delimiter = re.compile(r"[()\[\]{}“”«»„\"]")
_closes = {")": "(", "]": "[", "}": "{", "”": "“", "»": "«"}
_letters, _digits = re.compile(r"[^\W\d_]+"), re.compile(r"\d+")


def open_delimiters(text: str) -> str:
    """What is begun and not ended, outermost first; a closing mark without an opening one counts for nothing."""
    stack: list[str] = []
    for m in _delimiter.finditer(text):
        c = m[0]
        if c == '"':
            if '"' in stack:
                del stack[len(stack) - 1 - stack[::-1].index('"') :]
            else:
                stack.append(c)
        elif c in _closes:
            if _closes[c] in stack:
                del stack[len(stack) - 1 - stack[::-1].index(_closes[c]) :]
            elif c == "”" and "„" in stack:
                stack.remove("„")
        else:
            stack.append("“" if c == "“" and "„" not in stack else c)
            if c == "“" and "„" in stack:  # closes a low opening quote
                stack.pop()
                stack.remove("„")
    return "".join(stack)


def shape(text: str) -> str:
    s = text.lstrip()
    if _fence.search(text):
        return "fence"
    if s[:1] in ("{", "["):
        return "json"
    if s[:1] == "|":
        return "table"
    if _item.search(text):
        return "list"
    return "code" if _code.search(text) else "prose"


def _json_whole(text: str) -> bool:
    try:
        json.loads(text)
        return True
    except (ValueError, RecursionError):
        return False


def _table_whole(text: str) -> bool:
    rows = [r.strip() for r in text.strip().split("\n")]
    return rows[-1].endswith("|") and rows[-1].count("|") == rows[0].count("|")


@dataclass
class View:
    """What the features and the labelling rule need to know of a text."""

    text: str
    kind: str = ""
    tail: str = ""
    last_line: str = ""
    last: str = ""
    opened: str = ""
    whole_structure: bool = True
    stops: int = 0
    rest: list[str] = field(default_factory=list)

    def __post_init__(self) -> None:
        text = self.text
        self.kind, self.tail = shape(text), text.rstrip()
        self.last_line = self.tail[self.tail.rfind("\n") + 1 :]
        words = _word.findall(self.last_line)
        self.last = words[-1].lower() if words else ""
        self.opened = open_delimiters(text)
        if self.kind == "json":
            self.whole_structure = _json_whole(text)
        elif self.kind == "fence":
            self.whole_structure = len(_fence.findall(text)) % 2 == 0
        elif self.kind == "table":
            self.whole_structure = _table_whole(text)
        stops = [m.end() for m in _stop.finditer(self.tail)]
        self.stops = len(stops)
        self.rest = _word.findall(self.tail[stops[-1] :] if stops else self.tail)


def line_pattern(v: View) -> str:
    """The last line with its words and numbers as one letter each; indentation stays."""
    return _digits.sub("9", _letters.sub("a", v.last_line))


def closing_lines(views: list[View], share: float = 0.02, least: int = 3) -> frozenset[str]:
    """Patterns of the last line that at least ``least`` and a ``share`` of the code values end with.

    Cuts end code in ever other ways, whole code in few. See ``statistics`` for the same over all rows.
    """
    got = Counter(line_pattern(v) for v in views if v.kind == "code" and v.tail == v.text and not v.opened)
    total = sum(got.values())
    return frozenset(p for p, n in got.items() if n >= max(least, share * total))


def looks_whole(v: View, closers: frozenset[str], lines: frozenset[str] = frozenset()) -> bool:
    """The rule that picks intact values for the fit; strict, so that what it picks is intact."""
    if not v.tail or v.tail != v.text or "�" in v.tail[-2:] or not v.whole_structure:
        return False
    if v.kind in ("json", "table"):
        return True
    if v.kind == "fence":
        return bool(_fence.match(v.last_line)) or bool(_final.search(v.tail))
    if v.opened:
        return False
    if _final.search(v.tail) and v.kind != "code":
        return True
    if v.kind == "list":
        return v.last in closers and bool(_item.match(v.last_line))
    if v.kind == "code":
        return line_pattern(v) in lines
    return v.stops == 0 and len(v.rest) <= 5 and "\n" not in v.tail and (v.tail[0].islower() or len(v.rest) <= 2)


def gap(n_bytes: int, n_chars: int, byte_limits: Sequence[int] | None, char_limits: Sequence[int] | None) -> str:
    """How far a length is from the limits of its source: 'at' one, 'below' one, 'over' all, or 'none' if there is none."""
    byte_limits, char_limits = byte_limits or (), char_limits or ()
    if not byte_limits and not char_limits:
        return "none"
    if any(abs(x - n_bytes) <= NEAR for x in byte_limits) or n_chars in char_limits:
        return "at"
    return "below" if any(x > n_bytes for x in byte_limits) or any(x > n_chars for x in char_limits) else "over"


def features(v: View, closers: frozenset[str], near: str) -> list[int]:
    """Indices of the hashed features of a text; ``near``: the ``gap`` of its length."""
    k, tail = v.kind, v.tail
    ends = bool(_final.search(tail))
    end = _digits.sub("9", _letters.sub("a", tail[-12:]))[-4:]
    n = len(v.rest)
    bucket = str(n) if n < 7 else "7-9" if n < 10 else "10-19" if n < 20 else "20+"
    space = len(v.text) > len(tail)
    known = v.last in closers
    item = bool(_item.match(v.last_line))
    f = [
        "bias", k, f"{k}|ends{ends}", f"{k}|end={end}", f"{k}|c={tail[-1:] if not tail[-1:].isalnum() else 'a'}",
        f"{k}|whole{v.whole_structure}", f"{k}|open={v.opened[-2:]}|{ends}", f"{k}|last={v.last}|{ends}",
        f"{k}|known{known}|{ends}|{item}", f"{k}|len{len(v.last)}|{known}|{ends}",
        f"{k}|rest={bucket}|{ends}|{v.stops > 0}", f"{k}|near{near}|{ends}", f"near{near}|{ends}|{v.whole_structure}", f"space{space}|{ends}|{k}",
        f"bad{tail[-1:] == chr(0xFFFD)}",
    ]
    if k == "code":
        f.append("line=" + line_pattern(v))
    if not ends and v.rest:
        f += [f"{k}|upper{tail[:1].isupper()}|{bucket}|{v.stops > 0}", f"{k}|first={v.rest[0].lower()}|{bucket}|{v.stops > 0}", f"{k}|two={' '.join(v.rest[-2:]).lower()}"]
    mask = (1 << BITS) - 1
    return [zlib.crc32(x.encode("utf-8", "replace")) & mask for x in f]


@dataclass
class Model:
    weights: np.ndarray
    closers: frozenset[str]

    def score(self, text: str | None, near: str = "none") -> float | None:
        """Probability that the text was cut; None for null and blank texts."""
        if text is None or not text.strip():
            return None
        z = float(self.weights[features(View(text), self.closers, near)].sum())
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))

    def is_cut(self, text: str | None, near: str = "none") -> bool | None:
        p = self.score(text, near)
        return None if p is None else p > 0.5


@dataclass
class Sample:
    """A text of the fit, with the limits of its source."""

    text: str
    byte_limits: Sequence[int] = ()
    char_limits: Sequence[int] = ()

    def gap(self, text: str) -> str:
        return gap(len(text.encode("utf-8", "replace")), len(text), self.byte_limits, self.char_limits)


def fit(samples: list[Sample], closers: frozenset[str], lines: frozenset[str] | None = None, epochs: int = 80, rate: float = 0.5, ridge: float = 1e-5, seed: int = 7) -> Model:
    """Fit by full-batch Adagrad on intact texts and artificial cuts of them. The same for the same texts in any order.

    A text is cut at random places, with its own source's limits, and at a limit of some source that is shorter than it,
    as a value of that source. ``lines``: patterns that whole code ends with; None takes them from the samples.
    """
    rng = random.Random(seed)
    rows: list[list[int]] = []
    labels: list[int] = []
    samples = sorted(samples, key=lambda s: (s.text, list(s.byte_limits), list(s.char_limits)))
    views = [View(s.text) for s in samples]
    lines = closing_lines(views) if lines is None else lines
    sources = sorted({(tuple(s.byte_limits), tuple(s.char_limits)) for s in samples if len(s.byte_limits) or len(s.char_limits)})
    for s, v in zip(samples, views, strict=True):
        if not looks_whole(v, closers, lines):
            continue
        rows.append(features(v, closers, s.gap(s.text)))
        labels.append(0)
        cuts = [(s, _cut(s.text, rng)) for _ in range(2 if len(s.text) > 40 else 1)]
        if sources:
            of = Sample(s.text, *rng.choice(sources))
            cuts.append((of, _cut_at_limit(of, rng)))
        for of, cut in cuts:
            if cut is not None and not looks_whole(c := View(cut), closers, lines):
                rows.append(features(c, closers, of.gap(cut)))
                labels.append(1)
    w = np.zeros(1 << BITS)
    if not rows or len(set(labels)) < 2:
        return Model(w.astype(np.float32), closers)
    at = np.concatenate([np.array(r) for r in rows])
    of = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    y, past = np.array(labels, float), np.full(len(w), 1e-8)
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    for _ in range(epochs):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(of, w[at], len(rows)), -30, 30)))
        g = np.bincount(at, ((p - y) * weight)[of], len(w)) / len(rows) + ridge * w
        past += g * g
        w -= rate * g / np.sqrt(past)
    return Model(w.astype(np.float32), closers)


def _cut(text: str, rng: random.Random) -> str | None:
    raw = text.encode("utf-8", "replace")
    n = len(raw)
    if n < 12:
        return None
    at = rng.randint(max(6, n // 20), n - 1)
    cut = raw[:at].decode("utf-8", rng.choice(["ignore", "replace"]))
    return cut if cut.strip() else None


def _cut_at_limit(s: Sample, rng: random.Random) -> str | None:
    """The text cut by one of the limits that are below its length."""
    raw = s.text.encode("utf-8", "replace")
    ways = [("b", x) for x in s.byte_limits if x < len(raw)] + [("c", x) for x in s.char_limits if x < len(s.text)]
    if not ways:
        return None
    unit, at = rng.choice(ways)
    cut = s.text[:at] if unit == "c" else raw[:at].decode("utf-8", rng.choice(["ignore", "replace"]))
    return cut if cut.strip() else None


CLOSER, LIST_END, CODE_END, LENGTH, SAMPLE = range(5)
_last_word = re.compile(r"[^\W_]+(?=[\W_]*$)")
_final_word = re.compile(r"[^\W_]+$")


def statistics(values: DataFrame, classes: int) -> DataFrame:
    """Counts over all values, made per task first, and a ``classes``-th of the values, in one pass (a staged table).

    (kind, origin, source, text, b, c, n, marks): words that inner lines end with (which no cut has touched), words that
    lists end with, patterns that code ends with, lengths by source (``marks``: 64 bits, one set by the hash of each
    value, so many different values set many), and sampled values.
    """
    ship(values.sparkSession)
    names = ["kind", "origin", "source", "text", "b", "c", "n", "marks"]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count: Counter = Counter()
        marks: dict[tuple, int] = {}

        def counted() -> pd.DataFrame:
            rows = [(k, None, None, t, None, None, n, 0) for (k, t), n in count.items()]
            rows += [(LENGTH, *key, n, m - (1 << 64) if m >> 63 else m) for key, (n, m) in ((k[:2] + (None,) + k[2:], x) for k, x in marks.items())]
            count.clear()
            marks.clear()
            return pd.DataFrame(rows, columns=names).astype({"b": "Int32", "c": "Int32"})

        for b in batches:
            some = b[b["sampled"]]
            yield pd.DataFrame({"kind": SAMPLE, "origin": some["origin"], "source": some["source"], "text": some["value"], "b": None, "c": None, "n": 1, "marks": 0}).astype({"b": "Int32", "c": "Int32"})
            for o, s, t in zip(b["origin"], b["source"], b["value"], strict=True):
                if not t.strip():
                    continue
                raw = t.encode("utf-8", "replace")
                n, m = marks.get(key := (o, s, len(raw), len(t)), (0, 0))
                marks[key] = (n + 1, m | 1 << (zlib.crc32(raw) & 63))
                if "\n" in t:
                    for line in t.lower().split("\n")[:-1]:
                        if w := _last_word.search(line):
                            count[CLOSER, w[0]] += 1
                if _item.search(t) and (w := _final_word.search(t)):
                    count[LIST_END, w[0].lower()] += 1
                if not t[-1].isspace() and shape(t) == "code" and not (v := View(t)).opened:
                    count[CODE_END, line_pattern(v)] += 1
            if len(count) + len(marks) > 200_000:
                yield counted()
        yield counted()

    sampled = (F.pmod(F.xxhash64("origin", "row_id", "value"), F.lit(classes)) == 0).alias("sampled")
    rows = parallel(values.where("value is not null").select("origin", "source", "row_id", "value")).select("origin", "source", "value", sampled)
    return stage(rows.mapInPandas(scan, "kind int, origin string, source string, text string, b int, c int, n bigint, marks bigint"), "statistics")


def closing_words(counts: DataFrame, least: int = 5, most: int = 50_000, list_share: float = 0.01) -> frozenset[str]:
    """Words that lines end with where nothing was cut, counted over all values.

    Those that end at least ``least`` inner lines and a ``most``-th of all inner lines; and those that end at least 3
    and a ``list_share`` of all lists without a final stop (cuts end in ever other words). So there are at most
    ``most`` plus 1 / ``list_share`` of them.
    """
    return _frequent(counts, CLOSER, least, 1 / most) | _frequent(counts, LIST_END, 3, list_share)


def code_lines(counts: DataFrame, share: float = 0.02, least: int = 3) -> frozenset[str]:
    """Patterns of the last line that at least ``least`` and a ``share`` of the code values end with, counted over all values.

    So there are at most 1 / ``share`` of them.
    """
    return _frequent(counts, CODE_END, least, share)


def _frequent(counts: DataFrame, kind: int, least: int, share: float) -> frozenset[str]:
    of = counts.where(F.col("kind") == kind)
    total = of.agg(F.sum("n")).first()[0] or 0
    few = of.groupBy("text").agg(F.sum("n").alias("n")).where(F.col("n") >= max(least, share * total))
    return frozenset(r[0] for r in few.select("text").collect())


def source_limits(counts: DataFrame, least: int = 5, share: float = 0.005, times: float = 5.0, around: int = 60) -> DataFrame:
    """(origin, source, byte_limits, char_limits): lengths at which the values of a source pile up, in a staged table.

    A limit is a length that at least ``least`` values, a ``share`` of the source's and ``times`` as many as the
    ``around`` lengths below it have on average reach; at most as many values are longer, and they aren't few values
    over and over. A byte limit counts with ``NEAR`` bytes to either side, and is the most frequent of them. Sources
    without limits have no row; there are at most 1 / ``share`` limits of a source.
    """
    lengths = counts.where(F.col("kind") == LENGTH)
    units = F.explode(F.array(F.struct(F.lit("b").alias("unit"), F.col("b").alias("at")), F.struct(F.lit("c").alias("unit"), F.col("c").alias("at")))).alias("x")
    by = lengths.select("origin", "source", "n", "marks", units).groupBy("origin", "source", "x.unit", "x.at").agg(F.sum("n").alias("n"), F.expr("bit_or(marks)").alias("marks"))
    source = Window.partitionBy("origin", "source", "unit")  # a row for each length of a source
    order = source.orderBy("at")
    close = order.rangeBetween(-NEAR, NEAR)
    wide = F.when(F.col("unit") == "b", F.sum("n").over(close)).otherwise(F.col("n"))
    span = F.when(F.col("unit") == "b", 2 * NEAR + 1).otherwise(1)
    below = F.coalesce(F.sum("n").over(order.rangeBetween(-around, -NEAR - 1)), F.lit(0))
    above = F.coalesce(F.sum("n").over(order.rangeBetween(NEAR + 1, Window.unboundedFollowing)), F.lit(0))
    got = by.select(
        "origin", "source", "unit", "at", "n", wide.alias("w"), F.sum("n").over(source).alias("total"), (below * span / (around - NEAR)).alias("usual"), above.alias("above"), F.max("n").over(close).alias("most"),
        F.bit_count(F.when(F.col("unit") == "b", F.expr(f"bit_or(marks) over (partition by origin, source, unit order by at range between {NEAR} preceding and {NEAR} following)")).otherwise(F.col("marks"))).alias("unlike"),
    )
    peak = (F.col("unit") == "c") | (F.col("n") == F.col("most"))
    ok = peak & (F.col("w") >= F.greatest(F.lit(least), F.col("total") * share)) & (F.col("w") >= times * F.col("usual")) & (F.col("above") <= F.col("w")) & (F.col("unlike") >= least)
    limits = got.where(ok).groupBy("origin", "source").agg(*[F.array_sort(F.collect_list(F.when(F.col("unit") == u, F.col("at")))).alias(name) for u, name in (("b", "byte_limits"), ("c", "char_limits"))])
    return stage(limits, "limits")


def with_limits(df: DataFrame, limits: DataFrame) -> DataFrame:
    """``df`` (origin, source, ...) with byte_limits and char_limits of each row's source, null where it has none.

    A bounded table of limits is broadcast; a larger one is joined with its hot sources split off.
    """
    key = F.concat_ws("\x1f", "origin", F.when(F.col("source").isNull(), "-").otherwise(F.concat(F.lit("+"), "source")))
    by = limits.select(key.alias("_source"), "byte_limits", "char_limits")
    rows = df.withColumn("_source", key)
    joined = rows.join(F.broadcast(by), "_source", "left") if fits(by) else lookup(rows, by, "_source")
    return joined.drop("_source")


@dataclass
class Trained:
    """A model and the table of the sources' limits."""

    model: Model
    limits: DataFrame


def train(values: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Trained:
    """A model for ``values`` (origin, source, row_id, value). The fit's sample: about ``sample_rows`` rows, by a hash of the row.

    Rows, not distinct texts, are sampled, so frequent short answers are seen as often as they are given.
    """
    counts = statistics(values, max(1, values.count() // sample_rows))
    limits = source_limits(counts)
    some = with_limits(counts.where(F.col("kind") == SAMPLE).select("origin", "source", "text"), limits).select("text", "byte_limits", "char_limits")
    samples = [Sample(t, b or (), c or ()) for t, b, c in some.limit(sample_rows * 2).collect()]
    return Trained(fit(samples, closing_words(counts), code_lines(counts)), limits)


def values_of(df: DataFrame, row_id: str, source: str, value: str, origin: str) -> DataFrame:
    """(origin, source, row_id, value) of a table, whatever further columns it has."""
    return df.select(F.lit(origin).alias("origin"), F.col(source).cast("string").alias("source"), F.col(row_id).cast("bigint").alias("row_id"), F.col(value).alias("value"))


def near_limit(df: DataFrame, limits: DataFrame, value: str = "value") -> DataFrame:
    """``df`` (origin, source, ``value``, ...) with ``near``: the ``gap`` of each value's length."""
    rows = with_limits(df, limits)
    b, c = F.octet_length(value), F.char_length(value)
    none = F.coalesce(F.size("byte_limits") + F.size("char_limits"), F.lit(0)) == 0
    at = F.exists("byte_limits", lambda x: F.abs(x - b) <= NEAR) | F.array_contains("char_limits", c)
    below = F.exists("byte_limits", lambda x: x > b) | F.exists("char_limits", lambda x: x > c)
    return rows.withColumn("near", F.when(none, "none").when(at, "at").when(below, "below").otherwise("over")).drop("byte_limits", "char_limits")


def scored(values: DataFrame, trained: Trained) -> DataFrame:
    """(origin, source, row_id, cut): every row once; cut is null for null and blank values. Rows without an id are left out."""
    spark = values.sparkSession
    ship(spark)
    held = spark.sparkContext.broadcast(trained.model)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = held.value
        for b in batches:
            cut = [m.is_cut(t, near) for t, near in zip(b["value"], b["near"], strict=True)]
            yield b[["origin", "source", "row_id"]].assign(cut=pd.array(cut, dtype="boolean"))

    rows = near_limit(parallel(values.where("row_id is not null")), trained.limits)
    return rows.mapInPandas(score, "origin string, source string, row_id bigint, cut boolean")


def cut_rows(values: DataFrame, trained: Trained | None = None) -> DataFrame:
    """(origin, row_id) of the values that were cut, each once. Null and blank values never are."""
    return scored(values, trained or train(values)).where("cut").select("origin", "row_id").distinct()


def cut_shares(values: DataFrame, trained: Trained | None = None) -> DataFrame:
    """(origin, source, rows, cut_rows, share): how often each source truncates, of its rows with a value.

    Rows are distinct ids. A null source is a source of its own; a source without values has share null.
    """
    each = scored(values, trained or train(values)).groupBy("origin", "source", "row_id").agg(F.max("cut").alias("cut"))
    got = each.groupBy("origin", "source").agg(F.count("cut").alias("rows"), F.count(F.when(F.col("cut"), 1)).alias("cut_rows"))
    return got.withColumn("share", F.when(F.col("rows") > 0, F.round(F.col("cut_rows") / F.col("rows"), 6)))
