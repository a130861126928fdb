import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from promptmill.functions import bits, text
from promptmill.model import IndexConfig, RingConfig, core_list, required
from promptmill.operators import front
from promptmill.operators.admission import Window


def one(spark, column, **values):
    types = {str: "string", int: "bigint", float: "double", list: "array<double>", bool: "boolean"}
    schema = ", ".join(f"{k} {types.get(type(v), 'string')}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("secret", "shown"), [("", ""), ("abc", "***"), ("1234567", "*******"), ("12345678", "****5678"), (None, None)]
)
def test_redact(spark, secret, shown):
    assert one(spark, text.redact(F.col("s")), s=secret) == shown


@pytest.mark.parametrize(
    ("forwarded", "remote", "key"),
    [("1.2.3.4, 5.6.7.8", "9.9.9.9:1", "1.2.3.4"), ("1.2.3.4", "9.9.9.9:1", "1.2.3.4"), ("", "9.9.9.9:1", "9.9.9.9"), (None, "[::1]:80", "::1"), (None, "local", "local"), (", 5.6.7.8", "9.9.9.9:1", "9.9.9.9")],
)
def test_client_key(spark, forwarded, remote, key):
    assert one(spark, text.client_key(F.col("f"), F.col("r")), f=forwarded, r=remote) == key


def test_render_first_placeholder_only_and_escapes(spark):
    got = one(spark, text.render('{"p": "{{PLACEHOLDER}}", "q": "{{PLACEHOLDER}}"}', F.col("p")), p='a"b\\c\nd')
    assert got == '{"p": "a\\"b\\\\c\\nd", "q": "{{PLACEHOLDER}}"}'
    with pytest.raises(ValueError):
        text.render("none", F.col("p"))


def test_json_path():
    assert text.json_path("a,1,b") == text.json_path(["a", "[1]", "b"]) == "$['a'][1]['b']"
    for bad in ("a,,b", ["a", " "], "it's"):
        with pytest.raises(ValueError):
            text.json_path(bad)


def test_extract(spark):
    assert one(spark, text.extract(F.col("b"), "m,0,t"), b='{"m": [{"t": "x"}]}') == "x"
    assert one(spark, text.extract(F.col("b"), ["a.b", "c d"]), b='{"a.b": {"c d": "x"}}') == "x"
    assert one(spark, text.extract(F.col("b")), b='{"prompt": ""}') is None
    assert one(spark, text.extract(F.col("b")), b="broken") is None


def test_strip_knows_all_white_space(spark):
    white = "".join(c for c in map(chr, range(0x10000)) if c.isspace())
    assert one(spark, text.strip(F.col("s")), s=white + "a" + white + "b" + white) == "a" + white + "b"
    assert one(spark, text.strip(F.col("s")), s=white) == ""
    assert one(spark, text.strip(F.col("s")), s="\u200bx") == "\u200bx"


def test_tokens_of_a_vocabulary(spark):
    for token, special, surface in (("[CLS]", True, "[CLS]"), ("##ing", False, "ing"), ("#", False, ""), ("[a", False, "[a")):
        assert one(spark, text.is_special(F.col("t")), t=token) is special and one(spark, text.surface(F.col("t")), t=token) == surface


def test_settings():
    assert core_list("0, 2,5 ") == [0, 2, 5]
    for bad in ("", "1,,2", "a", "-1"):
        with pytest.raises(ValueError):
            core_list(bad)
    required({"key": "x"}, "key")
    with pytest.raises(ValueError):
        required({"key": ""}, "key")


def test_front(spark):
    body = '{"prompt": "x"}'
    for method, b, want in (("POST", body, 200), ("GET", body, 405), (None, body, 405), ("POST", None, 400), ("POST", "{}", 400), ("POST", body + " " * (1 << 20), 400)):
        assert one(spark, front.status(F.col("m"), F.col("b")), m=method, b=b) == want
    for status, cached, only, want in ((405, True, None, "ERROR"), (200, True, "true", "CACHE"), (200, False, "true", "NOT_FOUND"), (200, False, "1", "UPSTREAM"), (200, None, None, "UPSTREAM")):
        assert one(spark, front.answer(F.lit(status), F.lit(cached).cast("boolean"), F.col("o")), o=only) == want


@pytest.mark.parametrize(("i", "c", "out"), [(" a ", " b ", "a\nb"), ("a", " ", "a"), (None, "b", "\nb"), (None, None, "")])
def test_build_prompt(spark, i, c, out):
    assert one(spark, text.build_prompt(F.col("i"), F.col("c"), "\n"), i=i, c=c) == out


def fnv(s: str) -> int:
    h = 2166136261
    for b in s.encode():
        h = (h ^ b) * 16777619 % 2**32
    return h


def test_fnv(spark):
    for s in ("", "a", "10.0.0.1", "foobar"):
        assert one(spark, bits.fnv1a(F.col("s")), s=s) == fnv(s)


def test_control_block_round_trip_and_truncation(spark):
    cases = [(s, h, v, n, o) for s in (0, 1, 2, 3) for h in (0, 1) for v in (0, 1, 8, 15) for n in (0, 1, 0xFFFFF, 0x1FFFFF) for o in (0, 1, 0x7FFFFFFFF, 0xFFFFFFFFF)]
    names = ["state", "hot", "version", "length", "offset"]
    df = spark.createDataFrame(cases, ", ".join(f"{n} bigint" for n in names))
    back = df.withColumn("u", bits.unpack(bits.pack(*[F.col(n) for n in names])))
    assert back.where(" or ".join(f"u.{n} <> {n}" for n in names)).count() == 0
    over = spark.createDataFrame([(2, 1, 0xFF, 0x3FFFFF, (1 << 39) - 1)], df.schema).select(bits.unpack(bits.pack(*[F.col(n) for n in names])).alias("u")).first()["u"]
    assert tuple(over) == (2, 1, 15, 0x1FFFFF, 0xFFFFFFFFF)


def test_version_wraps(spark):
    assert [one(spark, bits.next_version(F.col("v")), v=v) for v in (0, 14, 15)] == [1, 15, 0]


def test_ring_chunks(spark):
    assert one(spark, bits.ring_index(F.col("o"), 256), o=300) == 44
    assert one(spark, bits.first_chunk(F.col("o"), F.col("n"), 256), o=250, n=20) == 6
    assert one(spark, bits.overlaps(F.col("a"), F.lit(5), F.col("b"), F.lit(5)), a=0, b=5) is False


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 300), min_size=1, max_size=80), st.integers(1, 6))
def test_window_admits_at_most_the_limit_per_width(steps, limit):
    w, now, admitted = Window(100, limit), 0, []
    for s in steps:
        now += s
        if w.admit(now):
            admitted.append(now)
    fixed = {}
    for t in admitted:
        fixed.setdefault((t - steps[0]) // 100, []).append(t)
    assert all(len(x) <= limit for x in fixed.values())


def test_window_denied_do_not_count():
    w = Window(1000, 2)
    assert [w.admit(t) for t in (0, 1, 2, 3)] == [True, True, False, False]
    assert w.current == 2
    assert w.admit(1500)  # 2 * 0.5 = 1 < 2
    assert not w.admit(1500) or math.floor(w.current) <= 2


def test_configs():
    IndexConfig()
    RingConfig()
    for bad in ({"clusters": 6}, {"flat_capacity": 100}, {"sample": 6}, {"top_k": 17}, {"top_k": 0}):
        with pytest.raises(ValueError):
            IndexConfig(**bad)
    for bad in ({"slots": 0}, {"size": 100}, {"start": 1 << 32}):
        with pytest.raises(ValueError):
            RingConfig(**bad)
