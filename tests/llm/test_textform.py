import random
import unicodedata

import pytest

from promptmill.llm import textform as T

SAME = [
    ("Ｈｅｌｌｏ？", "Hello?"), ("cafe\u0301", "café"), ("re\u200bsume", "resume"), ("a\u00a0b\u3000c\u2009d", "a b c d"), ("well\u2010known\u2011x", "well-known-x"), ("ﬁnal ﬂow", "final flow"),
    ("Tеѕt", "Test"), ("\u212aelvin", "Kelvin"), ("Η", "H"), ("а̀ b", "à b"), ("\ufeffx", "x"), ("a\r\nb", "a\nb"), ("ё", "е\u0308"), ("й", "и\u0306"), ("сор", "cop"), ("Ⅳ", "IV"), ("𝐀", "A"),
    ("νex", "vex"), ("ρ", "p"), ("օս", "ou"), ("հոt", "hոt"), ("Ꭺ Ꮃ Ꮯ", "A W C"), ("ꓮ", "A"), ("Ⲟ", "O"), ("ѵ", "v"), ("well\u2043known", "well-known"), ("a\u2024b", "a.b"),
]
DIFFERENT = [("Hello", "hello"), ("cafe", "café"), ("40", "⁴⁰"), ("a.b", "a,b"), ("a b", "ab"), ("l1", "ll"), ("a  b", "a b"), ("a\nb", "a b"), ("è", "é"), ("x²", "x2"), ("½", "1/2"), ("rn", "m"), ("O0", "00"), ("–", "-"), ("г", "r"), ("б", "6"), ("З", "3"), ("Ь", "b"), ("σ", "o"), ("“a”", '"a"')]


@pytest.fixture(scope="module", params=[False, True])
def form(request, vocabulary):
    return T.tries(vocabulary if request.param else None).form


def test_equal_looks_get_one_form(form):
    for a, b in SAME:
        assert form(a) == form(b), (a, b)


def test_visible_differences_stay(form):
    for a, b in DIFFERENT:
        assert form(a) != form(b), (a, b)


def test_form_is_idempotent_and_composed(form):
    for a, b in SAME + DIFFERENT:
        for x in (a, b):
            assert form(form(x)) == form(x) == unicodedata.normalize("NFC", form(x))


def test_null_empty_blank_long(form):
    assert form(None) is None and form("") == "" and form(" ") == " "
    assert form("\u200b" * 1000) == ""
    assert len(form("Ａ" * 200_000)) == 200_000


def test_canonical_spelling_is_of_one_script(vocabulary):
    if vocabulary:
        t = T.tries(vocabulary)
        form = t.form
        assert form("вcе") == "все" and form("Пoчeмy") == "Почему" and form("cооl") == "cool"
        # Latin text stays Latin, also where a Cyrillic word has the same look; what looks like it becomes it.
        assert form("Set ee to 1") == form("Set ее to 1") == "Set ee to 1"
        for w in ("ee", "Bc", "poc", "yc", "cx", "TA", "óv"):
            assert form(w) == w
        # In a Cyrillic text shared shapes are Cyrillic, except where only a Latin word is known.
        assert form("Она взяла ee") == form("Она взяла ее") == "Она взяла ее"
        assert form("Он знает TCP и HTTP") == "Он знает TCP и HTTP"


def test_the_trie_chooses_between_readings(vocabulary):
    if vocabulary:
        t = T.tries(vocabulary)
        assert t.by_table("ӏreland") == "lreland" and t.form("ӏreland") == "Ireland"  # one stroke: l by table, I in the word
        assert t.by_table("Ιike") == "Iike" and t.form("Ιike") == "like"
        assert t.form("ӏike") == "like" and t.form("Cyrӏis") == "Cyrlis"
        assert t.accepted("ӏreland")[0] == (0.25, "Ireland")


def test_what_decided(spark, vocabulary):
    df = spark.createDataFrame([("Ｈello ӏreland Pеpkag",), ("plain",), (None,), ("Ｈello",)], "t string")
    got = dict(map(tuple, T.decided(df, "t", vocabulary).collect()))
    assert got == ({"trie": 2, "second": 1, "table": 1} if vocabulary else {"table": 4})


def test_fixed_table_alone():
    t = T.Tries((), T.looks(None))
    assert t.form("Tеѕt") == "Test" and t.form("Ꭺ") == "Ꭺ"


def test_disguises_never_matter(form):
    rng = random.Random(5)
    words = "Why does Rumküc report a plain width after 58 calls to Pepkág, Сначала проверяет запрос? Größe naïve".split()
    back = {}
    for x, y in T.SHAPES.items():
        for a, b in zip(x, y, strict=True):
            back.setdefault(b, []).append(a)
    for _ in range(300):
        text = " ".join(rng.sample(words, 6))
        out = []
        for c in text:
            c = rng.choice(back[c]) if c in back and rng.random() < 0.3 else c
            if "!" <= c <= "~" and rng.random() < 0.1:
                c = chr(ord(c) + 0xFEE0)
            out.append(c + ("\u200b" if rng.random() < 0.1 else ""))
        disguised = "".join(out)
        if rng.random() < 0.5:
            disguised = unicodedata.normalize("NFD", disguised)
        assert form(disguised) == form(text), (text, disguised)


def test_automaton_costs():
    t = T.Tries(["cool", "coal", "wool"])
    assert t.accepted("сооl") == [(0, "cool")]
    assert t.accepted("c\u200bool", 1) == [(0, "cool"), (1, "coal"), (1, "wool")]
    assert t.accepted("col", 1) == [(1, "cool"), (1, "coal")]
    assert t.accepted("xyz", 1) == []
    assert t.accepted("col") == []


def test_fast_paths_equal_traversal(vocabulary):
    if vocabulary:
        t = T.tries(vocabulary)
        for w in [w for w in t.rank if T._latin.fullmatch(w)][:4000] + ["Bce", "ee", "cop", "größer", "tëst"]:
            assert t.form(w) == t.select(w), w


def test_looking_like(spark, vocabulary):
    df = spark.createDataFrame([(3, "Ａ b"), (1, "A b"), (2, "a b"), (5, None), (6, " "), (None, "A b"), (3, "Ａ b")], "id bigint, t string")
    assert sorted(map(tuple, T.looking_like(df, "t", "id", vocabulary).collect())) == [(1, 1), (2, 2), (3, 1)]


def test_same_looking(spark, vocabulary):
    a = [(1, "Hello there", "x"), (1, "Hello there", "x"), (2, "Ｈello there", "x"), (3, None, "x"), (4, "  ", "x"), (5, "hello there", "x"), (None, "Hello there", "x")]
    b = [(10, "Hello there", 0), (11, "Hеllo\u00a0there", 0), (12, "\u200b", 0), (13, None, 0), (11, "Hеllo\u00a0there", 0)]
    left = spark.createDataFrame(a, "id bigint, prompt string, _k string")
    right = spark.createDataFrame(b, "rid bigint, prompt string, form int")
    got = sorted(map(tuple, T.same_looking(left, right, "id", "rid", "prompt", "prompt", vocabulary).collect()))
    assert got == [(1, 11), (2, 10), (2, 11)]
    assert T.same_looking(left.where("false"), right, "id", "rid", "prompt", "prompt", vocabulary).count() == 0


def test_forms_keeps_rows_and_columns(spark, vocabulary):
    df = spark.createDataFrame([(1, "Ａ"), (1, "Ａ"), (2, None)], "id bigint, t string")
    assert sorted(map(tuple, T.forms(df, "t", vocabulary).collect()), key=str) == [(1, "Ａ", "A"), (1, "Ａ", "A"), (2, None, None)]
    with pytest.raises(ValueError):
        T.forms(df, "t", vocabulary, out="id")
