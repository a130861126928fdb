import random

import duckdb
import pytest

from promptmill.llm import truncation as T

from .conftest import DATA


@pytest.fixture(scope="module")
def values():
    q = "SELECT DISTINCT record_id, payload FROM '{}/{}.parquet' WHERE payload IS NOT NULL ORDER BY 1".format("/root/testdata/sf0.01", "cache_records")
    return [r[1] for r in duckdb.connect().execute(q).fetchall()]


def samples(texts, *limits):
    return [T.Sample(t, *limits) for t in texts]


def test_held_out_accuracy(values):
    """Fit on half of the values; cut the whole-looking ones of the other half, at random and at a limit, and score all."""
    closers = frozenset(["garden", "station", "mill", "museum", "again"])
    rng = random.Random(3)
    rng.shuffle(values)
    half = len(values) // 2
    m = T.fit(samples(values[:half], (300,), (200,)), closers)
    views = [T.View(v) for v in values]
    lines = T.closing_lines(views[:half])
    whole = [T.Sample(v.text, (300,), (200,)) for v in views[half:] if T.looks_whole(v, closers, lines)]
    for cutter, least in ((lambda s: T._cut(s.text, rng), 500), (lambda s: T._cut_at_limit(s, rng), 80)):
        cut = [(c, s.gap(c)) for s in whole if (c := cutter(s))]  # also those that look whole
        found = sum(m.is_cut(*c) for c in cut)
        assert len(cut) > least and found > 0.95 * len(cut)
    assert sum(m.is_cut(s.text, s.gap(s.text)) for s in whole) < 0.01 * len(whole)


def test_lengths_at_a_limit_are_learned(values):
    """Of one text, cut after a whole word, the length at its source's limit makes a cut likelier; without limits nothing does."""
    with_limits, without = T.fit(samples(values, (300,), ()), frozenset()), T.fit(samples(values), frozenset())
    text = "The worker keeps its ledger close to the other one while the narrow batch is measured"
    assert with_limits.score(text, "at") > with_limits.score(text, "below")
    assert abs(without.score(text, "at") - without.score(text, "below")) < 0.02  # but for collisions of hashed features


def test_gaps():
    assert T.gap(300, 300, (), None) == "none" and T.gap(302, 299, (300,), ()) == "at" and T.gap(400, 200, (300,), (200,)) == "at"
    assert T.gap(296, 296, (300,), ()) == "below" and T.gap(304, 304, (300,), ()) == "over" and T.gap(304, 304, (300, 900), ()) == "below"


def test_fit_does_not_depend_on_order(values):
    few = samples(values[:400], (200,), ())
    a, b = T.fit(few, frozenset()), T.fit(few[::-1], frozenset())
    assert (a.weights == b.weights).all()


def test_delimiters():
    assert T.open_delimiters('a (b [c] "d"') == "("
    assert T.open_delimiters('{"a": ["b') == '{["'
    assert T.open_delimiters("1) a\n2) b") == ""
    assert T.open_delimiters("«a» “b") == "“"
    assert T.open_delimiters("„a“") == ""


@pytest.mark.parametrize(
    ("text", "kind"), [("a b.", "prose"), ('{"a": 1}', "json"), ("| a |\n|---|", "table"), ("x:\n- a\n- b", "list"), ("```py\nx\n```", "fence"), ("def f(x):\n    return x", "code")]
)
def test_shapes(text, kind):
    assert T.shape(text) == kind


def test_structures():
    assert not T.View('{"a": [1, 2').whole_structure and T.View('{"a": [1, 2]}').whole_structure
    assert not T.View("| a | b |\n|---|---|\n| c |").whole_structure and T.View("| a | b |\n|---|---|\n| c | d |").whole_structure
    assert not T.View("```py\nx = 1").whole_structure


def test_scores_every_row_and_shares(spark):
    rows = [("s", i, t, "x") for i, t in enumerate(["A whole sentence stands here.", "Another one is written and then it is cut in the mid", None, " ", "Yes", "Yes"])]
    rows += [(None, 9, "This is complete.", "x"), ("s", None, "This is complete.", "x"), ("s", 0, "A whole sentence stands here.", "x")]
    df = spark.createDataFrame(rows, "src string, id bigint, v string, origin string")
    values = T.values_of(df, "id", "src", "v", "o")
    texts = ["The worker keeps its ledger close. It is measured slowly, as the handbook explains.", "Visitors reach the mill by the old road. Keep it dry."] * 50 + ["Yes", "No", "the narrow one"] * 10
    model = T.Trained(T.fit(samples(texts), frozenset()), T.source_limits(T.statistics(values, 1)))
    assert sorted(map(tuple, T.cut_rows(values, model).collect())) == [("o", 1)]
    got = {r["source"]: (r["rows"], r["cut_rows"]) for r in T.cut_shares(values, model).collect()}
    assert got == {"s": (4, 1), None: (1, 0)}
    assert T.cut_rows(values.where("false"), model).count() == 0


def test_untrainable_and_empty_tables_do_not_fail(spark):
    empty = spark.createDataFrame([], "origin string, source string, row_id bigint, value string")
    assert T.cut_rows(empty).count() == 0
    assert T.cut_rows(spark.createDataFrame([("o", None, 1, None)], empty.schema)).count() == 0


def table(spark, rows):
    return spark.createDataFrame(rows, "origin string, source string, row_id bigint, value string")


def test_source_limits(spark):
    """Limits of bytes and of characters are found under longer values too; one answer over and over is no limit."""
    text = lambda n, k, c="x": f"{k:03d}" + c * (n - 3)
    rows = [("o", "capped", i, text(100, i)) for i in range(20)] + [("o", "capped", 100 + i, text(i + 3, i)) for i in range(60)] + [("o", "capped", 190, text(500, 1))]
    rows += [("o", "free", 200 + i, text(i + 3, i)) for i in range(90)] + [("o", None, 1, "z")] + [("o", "same", 300 + i, "the very same answer of a source") for i in range(50)]
    rows += [("o", "chars", 400 + i, text(80, i, "é" if i % 2 else "x")) for i in range(20)] + [("o", "chars", 500 + i, text(i + 3, i)) for i in range(60)]
    rows += [("o", None, 600 + i, text(70, i)) for i in range(9)]
    limits = T.source_limits(T.statistics(table(spark, rows), 1))
    got = {r["source"]: (r["byte_limits"], r["char_limits"]) for r in limits.collect()}
    assert got["capped"] == ([100], [100]) and got["chars"][1] == [80] and got[None] == ([70], [70]) and set(got) == {"capped", "chars", None}
    near = T.near_limit(table(spark, rows), limits)
    for r in near.collect():
        b, c = got.get(r["source"], (None, None))
        assert r["near"] == T.gap(len(r["value"].encode()), len(r["value"]), b, c)
    assert near.count() == len(rows)


def test_very_many_sources(spark):
    """200,000 sources, all with limits: none of them is left out."""
    from pyspark.sql import functions as F

    limits = T.stage(spark.range(200_000).select(F.lit("o").alias("origin"), F.concat(F.lit("s"), "id").alias("source"), F.array(F.lit(40)).alias("byte_limits"), F.array().cast("array<int>").alias("char_limits")))
    values = spark.range(200_000).select(F.lit("o").alias("origin"), F.concat(F.lit("s"), "id").alias("source"), F.col("id").alias("row_id"), F.repeat(F.lit("x"), F.lit(40)).alias("value"))
    assert T.near_limit(values, limits).where("near = 'at'").count() == 200_000


def test_statistics_cover_all_rows(spark):
    rows = [("o", "s", i, f"First line {i} mill\nsecond garden\n- one\n- two{i}") for i in range(30)] + [("o", "s", 100 + i, f"def f{i}(x):\n    return x + {i}") for i in range(10)]
    counts = T.statistics(table(spark, rows).repartition(3), 1)
    assert T.closing_words(counts) == frozenset(["mill", "garden", "one", "x"])
    assert T.code_lines(counts) == frozenset(["    a a + 9"])
    assert counts.where("kind = 4").count() == 40


def test_long_text(spark):
    m = T.fit(samples(["A b c d e f."] * 20), frozenset())
    assert m.is_cut("word " * 200_000 + "end.") in (True, False)
    assert T.line_pattern(T.View("x = 1\n" + "a1 " * 50_000)) == ("a9 " * 50_000).strip()


def test_same_query_rows_in_both_partitionings(spark):
    df = spark.read.parquet(f"{DATA}/cache_records.parquet")
    v = T.values_of(df, "record_id", "local_name", "payload", "o")
    m = T.train(v)
    a, b = (sorted(map(tuple, T.cut_rows(x, m).collect())) for x in (v, v.repartition(7)))
    assert a == b and a
