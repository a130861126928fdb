"""Problems 4 and 5 against brute force, on hand-made and on random rows."""

import json
import random
import re
from collections import defaultdict

import pytest

from promptmill.llm import formatdup as D
from promptmill.llm import nearsets as N

WORD = re.compile(r"[^\W_]+")


def test_copies_and_collapse(spark):
    rows = [(5, "Hello, World", 0), (2, "hello   world!", 0), (9, "HELLO\nWORLD", 0), (9, "HELLO\nWORLD", 0), (3, "hello worlds", 0), (7, "...", 0), (8, None, 0), (None, "hello world", 0), (4, "", 0), (6, "hello_world", 0)]
    df = spark.createDataFrame(rows, "id bigint, t string, key int")
    rec = D.text_records(df, "id", "t", "o")
    assert sorted(map(tuple, D.copies(rec).collect())) == [("o", 2, 5), ("o", 2, 6), ("o", 2, 9)]
    assert sorted(map(tuple, D.collapsed(rec).collect())) == [("o", 2, 4), ("o", 3, 1)]
    assert D.copies(rec.where("false")).count() == 0 and D.collapsed(rec.where("false")).count() == 0


def test_lines(spark):
    lines = [
        '{"prompt": "A b", "payload": "c"}', '{"payload": "C.", "x": 1, "prompt": "a\\tB"}', '{"prompt": "a", "payload": "b c"}', '{"prompt": 1, "payload": "c"}', "[1]", "broken", "", None, '{"prompt": "!!", "payload": "c"}',
        '{"prompt": "\\u0061 B", "payload": "c", "prompt": "a b"}', '{"prompt": "\\ud800 a b", "payload": "c"}', "[" * 100_000,
    ]
    df = spark.createDataFrame(list(enumerate(lines)), "id bigint, raw string")
    assert sorted(map(tuple, D.copies(D.json_records(df, "id", "raw", "o")).collect())) == [("o", 0, 1), ("o", 0, 9), ("o", 0, 10)]


@pytest.mark.parametrize("parts", [1, 7])
def test_runs_over_partition_edges(spark, parts):
    """A third of the rows share a record, so its run crosses partitions, whatever their number."""
    rng = random.Random(parts)
    rows = [(i, "hot one" if rng.random() < 0.34 else f"w{rng.randint(0, 150)}") for i in range(3000)]
    df = spark.createDataFrame(rows, "id bigint, t string").repartition(5)
    groups = defaultdict(list)
    for i, t in rows:
        groups[t].append(i)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        rec = D.text_records(df, "id", "t", "o")
        assert set(map(tuple, D.copies(rec).collect())) == {("o", min(g), i) for g in groups.values() for i in g if i != min(g)}
        got = D.collapsed(rec).collect()
        assert len(got) == len(groups) and {tuple(r) for r in got} == {("o", min(g), len(g)) for g in groups.values()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def brute(rows, similarity=0.8, least=30):
    sets = {i: set(WORD.findall(f"{p or ''} {a or ''}".lower())) for i, p, a in rows if i is not None}
    sets = {i: s for i, s in sets.items() if len(s) >= least}
    ids = sorted(sets)
    return {(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]) - 1e-12}


def records(seed, n=120):
    """Originals, edited copies at similarities around the threshold, exact and reordered copies."""
    rng = random.Random(seed)
    common = [f"c{i}" for i in range(40)]
    rows, words = [], []
    for i in range(n):
        if words and rng.random() < 0.6:
            w = list(rng.choice(words))
            for _ in range(rng.choice([0, 0, 1, 3, 6, 8, 12])):
                x = rng.random()
                if x < 0.4:
                    w[rng.randrange(len(w))] = f"n{rng.randint(0, 400)}"
                elif x < 0.7 and len(w) > 5:
                    w.pop(rng.randrange(len(w)))
                else:
                    w.append(f"n{rng.randint(0, 400)}")
            rng.shuffle(w)
        else:
            w = rng.sample(common, rng.randint(15, 35)) + [f"n{rng.randint(0, 400)}" for _ in range(rng.randint(8, 60))]
        words.append(w)
        k = len(w) // 2
        rows.append((i, " ".join(w[:k]), ", ".join(w[k:]).upper()))
    return rows + rows[:5] + [(1000, None, None), (None, *rows[0][1:]), (1001, "", "short")]


@pytest.mark.parametrize("light", [None, 0, 55, 10_000])
@pytest.mark.parametrize("seed", [1, 2])
def test_similar_pairs(spark, light, seed):
    rows = records(seed)
    df = spark.createDataFrame([(*r, 0) for r in rows], "rid bigint, prompt string, payload string, id int")
    got = [tuple(r) for r in N.similar_pairs(df, "rid", ("prompt", "payload"), light=light).collect()]
    want = brute(rows)
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 20


def test_other_thresholds_and_empty(spark):
    rows = records(3, 80)
    df = spark.createDataFrame(rows, "rid bigint, prompt string, payload string")
    for s in (0.5, 1.0):
        got = {tuple(r) for r in N.similar_pairs(df, "rid", ("prompt", "payload"), s, 10).collect()}
        assert got == brute(rows, s, 10)
    assert N.similar_pairs(df.where("false"), "rid", ("prompt", "payload")).count() == 0
    assert N.groups(df.where("false"), "rid", ("prompt", "payload")).count() == 0
    with pytest.raises(ValueError):
        N.Bounds(0)


def test_groups(spark):
    rows = records(4)
    df = spark.createDataFrame(rows, "rid bigint, prompt string, payload string")
    pairs = brute(rows)
    parent = {i: i for p in pairs for i in p}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in pairs:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    want = {(i, find(i), sum(i in p for p in pairs)) for i in parent}
    assert {tuple(r) for r in N.groups(df, "rid", ("prompt", "payload")).collect()} == want


def test_hot_signatures_are_salted_without_loss(spark):
    rows = [(i, " ".join(f"c{(i + k) % 45}" for k in range(40)), "") for i in range(45)]
    df = spark.createDataFrame(rows, "id bigint, p string, a string")
    bounds = N.Bounds(0.8)
    frequent = {h: 1000 for h in N.Hashes().of(" ".join(f"c{k}" for k in range(45))).tolist()}
    sets = N._prefixes(df.withColumnRenamed("p", "t"), frequent, 30, bounds).drop("same")
    a, b = (set(map(tuple, N._candidates(sets, bounds, 0, hot_rows=h).collect())) for h in (3, 10**6))
    assert a == b and brute(rows) <= a


def test_chain_components(spark):
    n = 300
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)], "lo bigint, hi bigint")
    got = N.components(spark.range(n + 1), edges).collect()
    assert {r["group_id"] for r in got} == {0} and len(got) == n + 1


def test_boundary_follows_cost():
    b = N.Bounds(0.8)

    def at(mean_list, sizes=range(5, 120)):
        k, sets = 1000, 1_000_000
        expect = {}
        for n in sizes:
            p = b.missing_probe(n) + 2
            expect[n] = N.Matches(k, k * p * mean_list, k * p * (p - 1) / 2 * mean_list * mean_list / sets)
        return N.boundary(expect, b)

    assert at(3.0) == 0 and at(3.0, range(30, 120)) == 0
    assert 5 <= at(300.0) < 30 <= at(5000.0) <= at(20_000.0)


def test_both_sides_carry_pairs(spark):
    """Short sets of few different words have long lists: they are light, while the long sets of rare words are heavy."""
    rng = random.Random(8)
    short = [(i, " ".join(f"c{rng.randint(0, 45)}" for _ in range(9)), "") for i in range(6000)]
    long = [r for r in records(6, 60) if r[0] is not None and r[0] < 1000]
    rows = short + [(10_000 + i, f"{p} {' '.join(f'z{i % 50}y{k}' for k in range(30))}", a) for i, p, a in dict.fromkeys(long)]
    df = spark.createDataFrame(rows, "rid bigint, p string, a string")
    least = 5
    frequent = N._statistics(df.selectExpr("concat_ws(' ', p, a) t"), least)
    bounds = N.Bounds(0.8)
    sets = N._prefixes(df.selectExpr("rid id", "concat_ws(' ', p, a) t"), frequent, least, bounds)
    light = N.boundary(N._expected(sets.dropDuplicates(["same"]), bounds), bounds)
    assert 9 <= light < 40
    got = {tuple(r) for r in N.similar_pairs(df, "rid", ("p", "a"), least_words=least).collect()}
    assert got == brute(rows, least=least)
    assert any(hi < 10_000 for _, hi in got) and any(lo >= 10_000 for lo, _ in got)


def test_very_many_words(spark):
    """A record of 200,000 different words, and one that lacks a few of them."""
    words = [f"w{i}" for i in range(200_000)]
    rows = [(1, " ".join(words), None), (2, " ".join(words[7:]), "more"), (3, " ".join(words[:150_000]), None), (4, "few", None)]
    df = spark.createDataFrame(rows, "rid bigint, p string, a string")
    assert [tuple(r) for r in N.similar_pairs(df, "rid", ("p", "a")).collect()] == [(1, 2)]


@pytest.mark.parametrize("many", [1000, 5])
def test_hub_with_many_copies(spark, monkeypatch, many):
    """One set has a third of the rows and is near to many others."""
    monkeypatch.setattr(N, "MANY_COPIES", many)
    hub = [f"h{k}" for k in range(40)]
    rows = [(i, " ".join(hub), None) for i in range(60)] + [(100 + i, " ".join([*hub[1:], f"x{i}"]), None) for i in range(120)]
    df = spark.createDataFrame(rows, "rid bigint, p string, a string")
    want = brute(rows)
    assert {tuple(r) for r in N.similar_pairs(df, "rid", ("p", "a")).collect()} == want
    links = {r["rid"]: (r["group_id"], r["links"]) for r in N.groups(df, "rid", ("p", "a")).collect()}
    assert links == {i: (0, sum(i in p for p in want)) for i, _, _ in rows}


def test_json_is_read_like_python():
    assert json.loads('{"a": 1, "a": 2}')["a"] == 2
