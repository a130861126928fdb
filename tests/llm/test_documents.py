"""Problems 6, 7 and 8: exact round trips, brute force and bounds."""

import os
import random

import pytest

from promptmill.llm import leakage as L
from promptmill.llm import packing as K
from promptmill.llm import splitting as S
from promptmill.llm import tokens

pytestmark = pytest.mark.skipif(not os.path.exists(tokens.TOKENIZER), reason="no tokenizer file")


def check_packing(sizes, bins, capacity):
    fill = {}
    for s, b in zip(sizes, bins, strict=True):
        fill[b] = fill.get(b, 0) + s
    assert all(f <= capacity for f in fill.values()) and set(fill) == set(range(len(fill)))
    return len(fill)


@pytest.mark.parametrize("seed", range(5))
def test_packing_is_near_the_lower_bound(seed):
    rng = random.Random(seed)
    sizes = [rng.randint(1, 256) for _ in range(800)]
    n = check_packing(sizes, K.pack(sizes, 256), 256)
    assert n <= 1.03 * -(-sum(sizes) // 256) + 1
    p = K.Packing(sizes, 256)
    assert n < p.start.bins


def test_local_search_beats_its_start():
    """Five bins as the items arrive; moves and exchanges find the four full ones."""
    sizes = [20, 20, 36, 20, 41, 13, 36, 14, 12, 44, 31, 27, 24, 23, 20, 19]
    assert sum(sizes) == 400
    p = K.Packing(sizes, 100)
    assert p.start.bins == 5
    p.climb()
    assert p.used == 4 and p.squares() == 4 * 100 * 100 > p.start.squares
    assert check_packing(sizes, p.numbered(), 100) == 4


def test_every_step_raises_the_sum_of_squares():
    rng = random.Random(9)
    kinds = set()
    for _ in range(40):
        sizes = [rng.randint(1, 70) for _ in range(60)]
        p = K.Packing(sizes, 100)
        trade = p._trade
        p._trade = lambda a, give, b, take, trade=trade: (kinds.add((len(give), len(take))), trade(a, give, b, take))
        before, going = p.squares(), True
        while going:
            going = False
            for a in range(len(p.bins)):
                while 0 < p.fill[a] < 100 and p._improve(a):
                    assert p.squares() > before
                    before, going = p.squares(), True
        assert all(f == sum(sizes[i] for i in b) <= 100 for b, f in zip(p.bins, p.fill, strict=True))
        assert sorted(i for b in p.bins for i in b) == list(range(60)) and p.used == sum(map(bool, p.bins))
    assert kinds >= {(1, 0), (1, 1), (2, 1), (1, 2)}


@pytest.mark.parametrize("sizes", [[], [0], [5], [256] * 3, [0, 0, 256], [129] * 9, [1] * 700])
def test_packing_edges(sizes):
    check_packing(sizes, K.pack(sizes, 256), 256) if sizes else None
    assert K.pack([], 256) == []


def test_packed_documents(spark):
    rows = [(1, "word " * 700, "x"), (2, None, "x"), (3, "", "x"), (4, "short text", "x"), (5, "word " * 90, "x"), (None, "lost", "x")] + [(10 + i, f"text number {i} " * (i % 9), "y") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, tokens string")
    enc, _ = tokens.encoding()
    for shard_parts in (20_000, 7):
        got = K.packed(df, capacity=256, shard_parts=shard_parts).collect()
        total, fill = {}, {}
        for r in got:
            total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["tokens"]
            fill[r["bin_id"]] = fill.get(r["bin_id"], 0) + r["tokens"]
        assert total == {i: len(enc.encode_ordinary(t)) if t else 0 for i, t, _ in rows if i is not None}
        assert max(fill.values()) <= 256
        assert sorted(r["part"] for r in got if r["doc_id"] == 1) == list(range(-(-total[1] // 256)))
        assert all(r["part"] == 0 for r in got if total[r["doc_id"]] <= 256)
    assert K.packed(df.where("false")).count() == 0


TEXTS = [
    "One sentence here. " * 200, "a" * 3000, "paragraph one is short.\n\n" * 100, "最初に開き、次に変えてください。結果は一覧に書かれます。" * 60, "x = 1\n    y = [2, 3]\n" * 150, "👩‍👩‍👧 " * 300, "\n" * 900, " " * 2000, "wörd́ " * 500, "The end", "",
]


@pytest.mark.parametrize("k", range(len(TEXTS)))
@pytest.mark.parametrize(("limit", "overlap"), [(256, 32), (40, 0), (40, 15), (16, 7)])
def test_pieces_cover_the_text_within_the_limit(k, limit, overlap):
    text = TEXTS[k]
    enc, _ = tokens.encoding()
    ids = enc.encode_ordinary(text)
    got = S.split(text, limit, overlap)
    assert [text[a:b] for _, _, a, b, _ in got] == [p for *_, p in got]
    assert all(len(enc.encode_ordinary(p)) <= limit for *_, p in got)
    if len(ids) <= limit:
        assert len(got) == (1 if ids else 0)
        return
    assert got[0][0] == 0 and got[-1][1] == len(ids) and got[-1][3] == len(text)
    for x, y in zip(got, got[1:], strict=False):
        assert x[0] < y[0] <= x[1] < y[1]
        assert overlap <= x[1] - y[0] <= overlap + 3
    rebuilt = text[: got[0][3]] + "".join(text[x[3] : y[3]] for x, y in zip(got, got[1:], strict=False))
    assert rebuilt == text


def test_cuts_are_natural_where_there_are_any():
    text = "This is one sentence of the text. " * 120
    assert all(p.rstrip().endswith(".") for *_, p in S.split(text, 64, 8))
    text = ("Short line\n" * 6 + "\n") * 30
    assert all(p.endswith("\n\n") for *_, p in S.split(text, 64, 0)[:-1])


def test_sparse_table_against_brute_force():
    import numpy as np

    rng = random.Random(1)
    v = np.array([rng.randint(-1, 6) for _ in range(70)])
    t = S.SparseTable(v)
    for lo in range(70):
        for hi in range(lo, 70):
            assert t.strongest(lo, hi) == max(range(lo, hi + 1), key=lambda i: (v[i], i))


def test_pieces_of_a_table(spark):
    df = spark.createDataFrame([(1, "word " * 600, 0), (2, None, 0), (3, "short", 0), (None, "word " * 600, 0)], "doc_id bigint, text string, piece int")
    got = S.pieces(df).collect()
    assert {r["doc_id"] for r in got} == {1} and sorted(r["piece"] for r in got) == list(range(len(got)))
    assert {r["doc_id"] for r in S.pieces(df, all_documents=True).collect()} == {1, 3}
    assert S.pieces(df.where("false")).count() == 0
    for limit, bad in ((256, -1), (256, 128), (256, 256), (9, 2)):
        with pytest.raises(ValueError):
            S.split("x", limit, bad)


def brute_leaks(docs, items, least):
    grams = {}
    for i, *parts in items:
        for p in parts:
            w = L.words(p)
            for k in range(len(w) - least + 1):
                grams.setdefault(tuple(w[k : k + least]), set()).add(i)
    out = set()
    for d, t in docs:
        w = L.words(t)
        for k in range(len(w) - least + 1):
            out |= {(d, i) for i in grams.get(tuple(w[k : k + least]), ())}
    return out


@pytest.mark.parametrize("most_bits", [29, 6])
@pytest.mark.parametrize("least", [12, 5])
def test_leaks(spark, most_bits, least):
    """Also with a bitmap so small that nearly every shingle passes it."""
    rng = random.Random(least)
    vocabulary = [f"w{i}" for i in range(30)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.randint(3, 30)), text(rng.randint(3, 40)) if i % 5 else None) for i in range(40)] + [(0, text(20), ""), (1, "repeat " * 30, None)]
    docs = []
    for d in range(150):
        t = text(rng.randint(0, 60))
        if rng.random() < 0.6:
            w = L.words(rng.choice(items)[1])
            a = rng.randint(0, max(0, len(w) - 1))
            t += " -- " + "_, ".join(w[a : a + rng.randint(8, 16)]).upper() + " " + text(5)
        docs.append((d, t))
    docs += [(500, None), (501, ""), (502, "repeat " * 12), (503, "repeat " * 11), (504, "word " * 50_000 + items[0][1])]
    d = spark.createDataFrame([(*x, 0) for x in docs] + [(None, items[0][1], 0)], "doc_id bigint, text string, item_id int").repartition(3)
    i = spark.createDataFrame([(*x, 0) for x in items] + [(None, text(30), None, 0)], "item_id bigint, prompt string, payload string, doc_id int")
    got = [tuple(r) for r in L.leaked(d, i, least=least, most_bits=max(15, most_bits)).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_leaks(docs, items, least) and got


def test_leaks_of_many_items(spark):
    """50,000 items, a third of them with one passage in common, against documents of which a third hold it."""
    import numpy as np

    rng = np.random.default_rng(4)
    draw = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 5000, n))
    shared = draw(14)
    items = [(i, draw(20) + (" " + shared if i % 3 == 0 else ""), None) for i in range(50_000)]
    docs = [(d, draw(30) + " " + items[int(rng.integers(50_000))][1] if d % 3 else draw(9)) for d in range(90)] + [(100 + d, shared) for d in range(3)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    i = spark.createDataFrame(items, "item_id bigint, prompt string, payload string")
    got = L.leaked(d, i).collect()
    assert len(got) == len({tuple(r) for r in got}) and {tuple(r) for r in got} == brute_leaks(docs, items, 12)


def test_leaks_of_nothing(spark):
    d = spark.createDataFrame([(1, "a b c")], "doc_id bigint, text string")
    i = spark.createDataFrame([(1, "a b", None)], "item_id bigint, prompt string, payload string")
    assert L.leaked(d, i).count() == 0 and L.leaked(d.where("false"), i).count() == 0 and L.leaked(d, i.where("false")).count() == 0
    with pytest.raises(ValueError):
        L.leaked(d, i, least=4)
