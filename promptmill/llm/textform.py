"""One consistent form for texts that look the same (problem 1).

A token is matched against vocabulary tries by a weighted edit automaton in which look-alike characters and ignorable
ones cost nothing; a second reading of a shape (one stroke is I or l) costs a little, a visible edit 1, over the budget.
The cheapest accepted word of the token's script is its canonical spelling; tokens that match none are normalised by table.

A shape that Latin and Cyrillic share is spelt in the script of its token's other letters, else in that of most tokens
of the text that have letters of one script only, else in Latin. So a text of plain Latin letters is its own form.
"""

from __future__ import annotations

import base64
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scale import lookup, parallel, salted_pairs, ship, stage
from .lookalikes import SHAPES, Looks, data_file, looks

#: Ligatures of letters, drawn as the letters side by side.
JOINED = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "ſt", "ﬆ": "st", "Ǆ": "DŽ", "ǅ": "Dž", "ǆ": "dž", "Ǉ": "LJ", "ǈ": "Lj", "ǉ": "lj", "Ǌ": "NJ", "ǋ": "Nj", "ǌ": "nj", "ĳ": "ij", "Ĳ": "IJ"}
#: Ranges of characters that are never drawn, besides the control characters.
UNSEEN = ((0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xFFF0, 0xFFFB), (0xE0000, 0xE0FFF))
KEPT_CONTROLS = "\t\n\x0b\x0c\r"

_ignorable = "".join(chr(c) for a, b in UNSEEN if b < 0xE0000 for c in range(a, b + 1))
_ignorable += "".join(chr(c) for c in [*range(0x20), *range(0x7F, 0xA0)] if chr(c) not in KEPT_CONTROLS and c != 0x85)
IGNORABLE = frozenset(_ignorable)
_drop = re.compile(f"[{re.escape(_ignorable)}\U000e0000-\U000e0fff]+")
_unseen = rf"\u0300-\u036f\u0483-\u0487\u20d0-\u20f0{re.escape(_ignorable)}\U000e0000-\U000e0fff"
#: A word that has a character outside ASCII, and all of it.
_odd_word = re.compile(rf"[A-Za-z0-9]*(?:(?![\x00-\x7f])[^\W_]|[{_unseen}])(?:[^\W_]|[{_unseen}])*")
#: Text of plain Latin letters, each accent composed, and signs that stand for themselves: its table form is itself.
_latin = re.compile("[\t\n -~\u00a1-\u00ac\u00ae-\u0131\u0134-\u013e\u0141-\u0148\u014a-\u017e\u2012-\u2015\u2018-\u201f\u2026\u20ac]*")
_cyrillic_letter = re.compile("[\u0400-\u04ff]")
_gap = re.compile(r"[^\x00-\x7f\w]+")
_controls = re.compile("[\x00-\x08\x0e-\x1f\x7f\r]")
#: Kinds of compatibility decomposition that leave the shape: width and font. Raised, circled and such are visible.
SAME_SHAPE = ("<wide>", "<narrow>", "<font>", "<noBreak>", "<initial>", "<medial>", "<final>", "<isolated>")
#: Weight of reading a shape the second way. Whole edits cost 1, so a budget below 1 admits no visible difference.
SECOND_COST, BUDGET = 0.25, 0.75
_cyrillic_of = {b: a for x, y in list(SHAPES.items())[:2] for a, b in zip(x, y, strict=True) if "\u0400" <= a <= "\u045f"}
_to_cyrillic = {ord(b): a for b, a in _cyrillic_of.items()}
_wordy = re.compile(rf"(?:[^\W_]|[{_unseen}])+")


class Tries:
    """Vocabulary words in tries (one below each first shape), walked by a weighted edit automaton.

    ``words`` come in order of preference. An edge is a shape, so all look-alike spellings of a word share a path, and
    a leaf holds the spellings that end there. Costs: look-alike 0, ignorable 0, second reading ``SECOND_COST``, other
    insertion, deletion or replacement 1 each. ``tally`` counts the odd tokens that the tries and the table decided.
    """

    def __init__(self, words: Iterable[str] = (), look: Looks | None = None) -> None:
        look = looks(data_file()) if look is None else look
        self.first, self.second = dict(zip(*look.first, strict=True)), dict(zip(*look.second, strict=True))
        self.root: dict = {}
        self.rank: dict[str, int] = {}
        self.shapes: dict[str, str] = {}
        self.memo: dict[tuple[str, bool], str] = {}
        self.tally: Counter = Counter()
        self._votes = Votes(self)
        for w in words:
            if w in self.rank:
                continue
            self.rank[w] = len(self.rank)
            node = self.root
            for unit in self.units(w):
                node = node.setdefault(unit, {})
            node.setdefault("", []).append(w)  # spellings that end here

    def prototype(self, ch: str) -> str:
        """What stands for a character that isn't ignorable: its look-alike, each in decomposed form."""
        if (got := self.shapes.get(ch)) is None:
            if ch in JOINED:
                got = unicodedata.normalize("NFD", JOINED[ch])
            elif unicodedata.category(ch) == "Zs":
                got = " "
            elif (kind := unicodedata.decomposition(ch)).startswith(SAME_SHAPE) or "\u2160" <= ch <= "\u217f" and " " in kind:  # Roman numerals
                got = "".join(self.prototype(chr(int(x, 16))) for x in kind.split()[1:])
            else:
                got = "".join(self.first.get(c, c) for c in unicodedata.normalize("NFD", ch))
            self.shapes[ch] = got
        return got

    def by_table(self, text: str) -> str:
        """The form by table alone: ignorables dropped, each other character replaced by its prototype, composed."""
        text = _drop.sub("", text).replace("\r\n", "\n")
        return unicodedata.normalize("NFC", "".join(map(self.prototype, text)))

    def units(self, token: str) -> list[str]:
        """The shapes of a token: decomposed prototypes without ignorables, accents in canonical order."""
        return list(unicodedata.normalize("NFD", "".join(self.prototype(c) for c in token if not _drop.match(c))))

    def _readings(self, token: str) -> list[tuple[str, str | None]]:
        """(shape, second reading or None) of each unit."""
        second = self.second
        if not any(c in second for c in token):
            return [(u, None) for u in self.units(token)]
        marked = "".join("\ue000" + self.prototype(c) if c in second else self.prototype(c) for c in token if not _drop.match(c))
        out: list[tuple[str, str | None]] = []
        seconds = iter([second[c] for c in token if c in second])
        marks = False
        for u in unicodedata.normalize("NFD", marked):
            if u == "\ue000":
                marks = True
            else:
                out.append((u, next(seconds) if marks else None))
                marks = False
        return out

    def accepted(self, token: str, budget: float = BUDGET) -> list[tuple[float, str]]:
        """(cost, word) of every vocabulary word within ``budget`` of the token, cheapest first, then by rank."""
        units, best = self._readings(token), {}
        layer = [(self.root, 0, 0.0)]
        seen: dict[tuple[int, int], float] = {}
        while layer:
            node, at, cost = layer.pop()
            if seen.get((id(node), at), budget + 1) <= cost:
                continue
            seen[id(node), at] = cost
            if at == len(units):
                for w in node.get("", ()):
                    best[w] = min(cost, best.get(w, cost))
            else:
                shape, other = units[at]
                if (step := node.get(shape)) is not None:
                    layer.append((step, at + 1, cost))
                if other is not None and cost + SECOND_COST <= budget and (step := node.get(other)) is not None:
                    layer.append((step, at + 1, cost + SECOND_COST))
            if cost + 1 <= budget:
                if at < len(units):
                    layer.append((node, at + 1, cost + 1))  # an extra character
                for unit, step in node.items():
                    if unit:
                        layer.append((step, at, cost + 1))  # a missing one
                        if at < len(units) and unit != units[at][0]:
                            layer.append((step, at + 1, cost + 1))  # another one
        return sorted(((c, w) for w, c in best.items()), key=lambda x: (x[0], self.rank[x[1]]))

    @staticmethod
    def _scripts(shapes: str) -> tuple[bool, bool]:
        """Whether decomposed shapes have letters that only Latin has, and ones that only Cyrillic has."""
        latin = any(c.isascii() and c.isalpha() and c not in _cyrillic_of for c in shapes)
        return latin, any("\u0400" <= c <= "\u04ff" for c in shapes)

    def select(self, token: str, cyrillic: bool = False) -> str:
        """The canonical spelling of a token: the cheapest accepted word of its script, of those the one of best rank,
        else the table's form. ``cyrillic``: the script of shapes that both have, if the token doesn't tell."""
        shapes = "".join(self.units(token))
        letters = [c for c in shapes if c.isalpha()]
        has_latin, has_cyrillic = self._scripts(shapes)
        both = not has_latin and not has_cyrillic and any(c in _cyrillic_of for c in letters)
        as_cyrillic = (has_cyrillic or cyrillic and both) and all("\u0400" <= c <= "\u04ff" or c in _cyrillic_of for c in letters)
        kind = "cyrillic" if as_cyrillic else "latin" if all(map(str.isascii, letters)) else None
        kinds = ("cyrillic", "latin") if as_cyrillic and both else (kind,)
        found = self.accepted(token)
        for k in kinds:
            for cost, word in found:
                if k is None or self._kind(word) == k:
                    self.tally["second" if cost else "trie"] += 1
                    return word
        self.tally["table"] += 1
        return unicodedata.normalize("NFC", shapes.translate(_to_cyrillic) if as_cyrillic else shapes)

    @staticmethod
    def _kind(word: str) -> str | None:
        if any("\u0400" <= c <= "\u04ff" for c in word):
            return "cyrillic"
        return "latin" if all(c.isascii() or unicodedata.combining(c) for c in unicodedata.normalize("NFD", word)) else None

    def form(self, text: str | None) -> str | None:
        """The canonical form of a text; None stays None."""
        if text is None:
            return None
        if _controls.search(text):
            text = _drop.sub("", text).replace("\r\n", "\n")
        if text.isascii() or _latin.fullmatch(text):
            return text
        cyrillic = self._is_cyrillic(text)
        # Where Cyrillic prevails, plain Latin letters may be Cyrillic ones in disguise.
        text = (_wordy if cyrillic else _odd_word).sub(lambda m: self._token(m[0], cyrillic), text)
        if _gap.search(text):
            text = _gap.sub(lambda m: self.by_table(m[0]), text)
        return unicodedata.normalize("NFC", text)

    def _is_cyrillic(self, text: str) -> bool:
        """Whether more tokens have letters that only Cyrillic has than have ones that only Latin has: of their looks alone."""
        if not _cyrillic_letter.search(text):
            return False
        return sum(map(self._votes.__getitem__, _wordy.findall(text))) > 0

    def _token(self, token: str, cyrillic: bool) -> str:
        if (got := self.memo.get((token, cyrillic))) is None:
            if len(self.memo) > 200_000:
                self.memo.clear()
            got = self.memo[token, cyrillic] = self.select(token, cyrillic)
        return got


class Votes(dict):
    """Tokens that have letters of Cyrillic alone (1), of Latin alone (-1), of neither or of both (0), remembered."""

    def __init__(self, tries: Tries) -> None:
        self.tries = tries

    def __missing__(self, token: str) -> int:
        if len(self) > 200_000:
            self.clear()
        latin, cyrillic = Tries._scripts(token if token.isascii() else "".join(self.tries.units(token)))
        got = self[token] = cyrillic - latin
        return got


def vocabulary(path: str) -> list[str]:
    """Whole words of a rank file: tokens of two letters or more behind a space, best rank first."""
    words = []
    with open(path, "rb") as f:
        for line in f:
            try:
                word = base64.b64decode(line.split()[0]).decode()
            except (UnicodeDecodeError, IndexError):
                continue
            if word[:1] == " " and len(word) > 2 and word[1:].isalpha():
                words.append(unicodedata.normalize("NFC", word[1:]))
    return words


@lru_cache(maxsize=4)
def tries(path: str | None, look: Looks | None = None) -> Tries:
    """The tries of a rank file, made once in each Python worker; without a file, the table alone."""
    return Tries(vocabulary(path) if path else (), look)


def visible(text: str) -> str:
    """The text without characters that are never drawn."""
    return _drop.sub("", text)


def by_table(text: str) -> str:
    """The form by table alone."""
    return tries(None).by_table(text)


VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"


def canonical(text: Column, vocabulary_path: str | None = VOCABULARY) -> Column:
    """The canonical form of a text column."""
    look = looks(data_file())  # read by the driver, so all workers have the same

    def forms(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        form = tries(vocabulary_path, look).form
        for s in batches:
            yield pd.Series([form(x) for x in s], dtype=object)

    return F.pandas_udf(forms, "string")(text)


def form_key(text: Column, vocabulary_path: str | None = VOCABULARY) -> Column:
    """16 bytes of a hash of the canonical form; null for null and blank texts."""
    look = looks(data_file())

    def keys(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        form = tries(vocabulary_path, look).form
        for s in batches:
            out = []
            for x in s:
                x = form(x)
                out.append(xxhash.xxh3_128_digest(x.encode("utf-8", "surrogatepass")) if x is not None and x.strip() else None)
            yield pd.Series(out, dtype=object)

    return F.pandas_udf(keys, "binary")(text)


def forms(df: DataFrame, text: str, vocabulary_path: str | None = VOCABULARY, out: str = "form") -> DataFrame:
    """``df`` with a column ``out`` of canonical forms. All columns and rows stay; null gives null, blank gives blank.

    Raises ValueError if ``df`` has a column named ``out`` already.
    """
    if out in df.columns:
        raise ValueError(f"column {out} exists")
    ship(df.sparkSession)
    return df.withColumn(out, canonical(df[text], vocabulary_path))


def decided(df: DataFrame, text: str, vocabulary_path: str | None = VOCABULARY) -> DataFrame:
    """(decided_by, tokens): how many occurrences of tokens with odd characters the tries and the table decided.

    'trie': by look-alikes of no cost, 'second': by a second reading, 'table': no word was accepted. Nulls count nothing.
    """
    ship(df.sparkSession)
    look = looks(data_file())

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = Tries(vocabulary(vocabulary_path) if vocabulary_path else (), look)
        t.memo = Forgetful()
        for b in batches:
            for x in b["_t"]:
                t.form(x)
        yield pd.DataFrame({"decided_by": list(t.tally), "tokens": list(t.tally.values())}).astype({"decided_by": object, "tokens": "int64"})

    rows = parallel(df.select(F.col(text).alias("_t")).where("_t is not null"))
    return rows.mapInPandas(count, "decided_by string, tokens bigint").groupBy("decided_by").agg(F.sum("tokens").alias("tokens"))


class Forgetful(dict):
    """Keeps nothing, so that every occurrence is decided anew and counted."""

    def __setitem__(self, key: object, value: object) -> None:
        pass


def looking_like(df: DataFrame, text: str, row_id: str, vocabulary_path: str | None = VOCABULARY) -> DataFrame:
    """(row_id, first_id): the smallest id of the rows that show the same text. Null and blank texts and null ids take no
    part; repeats come out once; a row with several texts once for each. Hot forms are split (see ``lookup``)."""
    ship(df.sparkSession)
    rows = parallel(df.select(F.col(row_id).alias("_i"), F.col(text).alias("_t")).where("_i is not null and _t is not null"))
    keys = stage(rows.select("_i", form_key(F.col("_t"), vocabulary_path).alias("_k")).where("_k is not null"), "forms")
    first = keys.groupBy("_k").agg(F.min("_i").alias("first_id"))
    return lookup(keys, first, "_k").select(F.col("_i").alias(row_id), "first_id").distinct()


def same_looking(left: DataFrame, right: DataFrame, left_id: str, right_id: str, left_text: str, right_text: str, vocabulary_path: str | None = VOCABULARY) -> DataFrame:
    """(left_id, right_id) of rows whose texts aren't the same string but show the same text.

    Rows are distinct ids; exact repeats and extra columns don't matter. Null and blank texts and null ids take no
    part. Empty tables give no rows. Hot forms are salted (see ``salted_pairs``). Forms are compared by 128-bit hashes,
    the strings of rows of one form by 64-bit hashes: of n pairs a share of n / 2 ** 64 may be lost.
    """
    ship(left.sparkSession)

    def keyed(df: DataFrame, i: str, text: str, to: str, raw: str) -> DataFrame:
        df = df.select(F.col(i).alias(to), F.col(text).alias("_t")).where(F.col(to).isNotNull() & F.col("_t").isNotNull())
        return df.select(to, form_key(F.col("_t"), vocabulary_path).alias("_k"), F.xxhash64("_t").alias(raw)).where("_k is not null")

    left, right = parallel(left.select(left_id, left_text)), parallel(right.select(right_id, right_text))
    a = stage(keyed(left, left_id, left_text, "_a", "_ra"), "forms")
    b = stage(keyed(right, right_id, right_text, "_b", "_rb"), "forms")
    pairs = salted_pairs(a.distinct(), b.distinct(), "_k").where("_ra <> _rb")
    return pairs.select(F.col("_a").alias(left_id), F.col("_b").alias(right_id)).distinct()
