"""Texts over a token limit cut into pieces at natural boundaries, with overlap (problem 8).

Each token boundary has a strength. A sparse table answers which cut is strongest in the window of permissible
lengths; of equals the rightmost is taken. The next piece starts ``overlap`` tokens before the cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scale import parallel, ship
from . import tokens as tk

INSIDE, CHARACTER, SYMBOL, WORD, CLAUSE, SENTENCE, LINE, PARAGRAPH = -1, 0, 1, 2, 3, 4, 5, 6
_white = np.zeros(256, bool)
_white[[9, 10, 11, 12, 13, 32]] = True
_kind = np.zeros(256, np.int8)  # 0 other, 1 letter or any byte of a longer character, 2 digit
_kind[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_kind[48:58] = 2
_stop, _clause, _close = (np.isin(np.arange(256), [ord(c) for c in x]) for x in (".!?", ",;:", "\"')]}*_`"))


def strengths(raw: bytes, ends: np.ndarray) -> np.ndarray:
    """The strength of cutting at each byte offset in ``ends`` (each above 0 and below the length)."""
    b = np.frombuffer(raw, np.uint8)
    back = lambda k: np.where(ends >= k, b[np.maximum(ends - k, 0)], 0)
    p1, p2, p3, nxt = back(1), back(2), back(3), b[ends]
    ahead = _white[nxt]
    s = np.where(_kind[p1] != _kind[nxt], SYMBOL, CHARACTER)
    s = np.where(_white[p1] | ahead, WORD, s)
    s = np.where(_clause[p1] & ahead, CLAUSE, s)
    s = np.where((_stop[p1] | _close[p1] & _stop[p2]) & ahead, SENTENCE, s)
    # Marks of three bytes that end a clause or a sentence without a space behind them.
    s = np.where((p3 == 0xE3) & (p2 == 0x80) & (p1 == 0x81) | (p3 == 0xEF) & (p2 == 0xBC) & (p1 == 0x8C), np.maximum(s, CLAUSE), s)
    s = np.where((p3 == 0xE3) & (p2 == 0x80) & (p1 == 0x82) | (p3 == 0xEF) & (p2 == 0xBC) & ((p1 == 0x81) | (p1 == 0x9F)), np.maximum(s, SENTENCE), s)
    s = np.where((p1 == 10) & ~ahead, LINE, s)
    s = np.where((p1 == 10) & (p2 == 10) & (nxt != 10), PARAGRAPH, s)
    return np.where(nxt & 0xC0 == 0x80, INSIDE, s).astype(np.int8)


class SparseTable:
    """Index of the greatest value in a range in constant time; of equals the rightmost.

    Ranges have at most ``widest`` values, so there are no more than log2(widest) + 1 levels, however long the text is.
    """

    def __init__(self, values: np.ndarray, widest: int | None = None) -> None:
        # Keys are unique and grow with value first, then with position, so a plain maximum breaks ties rightward.
        n = len(values)
        self.n = n
        self.levels = [values.astype(np.int64) * (n + 1) + np.arange(n)]
        k = 1
        while 2 * k <= min(n, widest or n):
            a = self.levels[-1]
            self.levels.append(np.maximum(a[:-k], a[k:]))
            k *= 2

    def strongest(self, lo: int, hi: int) -> int:
        """Position of the greatest value in lo..hi, both included."""
        k = (hi - lo + 1).bit_length() - 1
        a = self.levels[k]
        return int(max(a[lo], a[hi - (1 << k) + 1]) % (self.n + 1))


def split(text: str, limit: int, overlap: int, path: str = tk.TOKENIZER) -> list[tuple[int, int, int, int, str]]:
    """(first token, end token, first character, end character, piece) of each piece; one piece if the text fits.

    Every piece has at most ``limit`` tokens, also if encoded by itself. Consecutive pieces share ``overlap`` tokens;
    up to three more where the start would fall inside a character. Cuts fall in the later half of the limit where
    tokens don't merge otherwise at the cut. ValueError for an overlap that isn't below half the limit, or within 8 of it.
    """
    if not 0 <= overlap < limit // 2 or limit - overlap < 8:
        raise ValueError("overlap must be at least 0, below half the limit and 8 below the limit")
    enc, sizes = tk.encoding(path)
    raw = text.encode("utf-8", "replace")
    ids = enc.encode_ordinary(raw.decode())
    n = len(ids)
    if n <= limit:
        return [(0, n, 0, len(text), text)] if n else []
    at = np.concatenate([[0], np.cumsum(sizes[ids])])
    s = np.concatenate([[PARAGRAPH], strengths(raw, at[1:-1]), [PARAGRAPH]])
    table = SparseTable(s, limit)
    out, start, chars = [], 0, 0
    while True:
        # The next piece starts ``overlap`` before the cut, at the start of a character; it must start later than this
        # one. A character has four tokens at most, so such a cut is in reach.
        first = start + 1
        while s[first] == INSIDE:
            first += 1
        least, most, tried = first + overlap, start + limit, 0
        while True:
            end = n if n <= most else table.strongest(max(least, min(start + (most - start) // 2, most - 3)), most)
            piece = raw[at[start] : at[end]].decode("utf-8", "replace")
            over = len(enc.encode_ordinary(piece)) - limit
            if over <= 0:
                break
            if most == tried:
                raise ValueError(f"{limit} tokens can't hold {end - start} tokens of the text encoded by themselves")
            tried = most
            most = max(least + 3, min(most, end) - over)  # tokens merge otherwise at a cut inside a word
        out.append((start, end, chars, chars + len(piece), piece))
        if end == n:
            return out
        new = end - overlap
        while s[new] == INSIDE:
            new -= 1
        chars += len(raw[at[start] : at[new]].decode("utf-8", "replace"))
        start = new


def pieces(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", limit: int = 256, overlap: int = 32, path: str = tk.TOKENIZER, all_documents: bool = False) -> DataFrame:
    """(doc_id, piece, token_from, token_to, char_from, char_to, text): pieces of the texts over ``limit`` tokens, in order.

    ``all_documents`` also gives each text within the limit as one piece. Null and empty texts and null ids give no
    row; repeated ids give their pieces each time. Other columns don't matter.
    """
    spark = documents.sparkSession
    ship(spark)
    rows = parallel(documents.select(F.col(doc_id).alias("_d"), F.col(text).alias("_t")).where("_d is not null and _t <> ''"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for d, t in zip(b["_d"], b["_t"], strict=True):
                got = split(t, limit, overlap, path)
                if all_documents or len(got) > 1:
                    out += [(d, k, *p) for k, p in enumerate(got)]
                if len(out) > 5000:
                    yield pd.DataFrame(out, columns=names)
                    out = []
            yield pd.DataFrame(out, columns=names)

    names = [doc_id, "piece", "token_from", "token_to", "char_from", "char_to", "text"]
    kind = dict(rows.dtypes)["_d"]
    return rows.mapInPandas(cut, f"`{doc_id}` {kind}, piece int, token_from int, token_to int, char_from int, char_to int, text string")
