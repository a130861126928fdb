import pytest
from pyspark.sql import functions as F

from promptmill import scale
from promptmill.operators import cache, lifecycle
from promptmill.service import SemanticCache, generate
from promptmill.sources import records


def test_repeats_ties_nulls_and_repeated_ids(spark):
    df = spark.createDataFrame([(1, "a", 0), (2, "a", 0), (2, "a", 0), (3, None, 0), (None, "a", 0), (4, "", 0), (5, "", 0)], "id bigint, p string, hash int")
    assert {r["id"]: r["hit"] for r in cache.repeats(df, "id", "p").collect()} == {1: False, 2: True, 4: False, 5: True}


def test_lookup_splits_hot_keys(spark):
    left = spark.range(1000).select("id", F.when(F.col("id") < 700, "hot").when(F.col("id") < 750, None).otherwise(F.col("id").cast("string")).alias("k"))
    right = spark.createDataFrame([("hot", 1), ("800", 2)], "k string, x int")
    got = scale.lookup(left, right, "k", hot_rows=100)
    assert got.count() == 1000 and got.where("x = 1").count() == 700 and got.where("x = 2").count() == 1


def test_salted_pairs_is_a_join(spark):
    a = spark.range(300).select("id", (F.col("id") % 3).alias("k"))
    b = spark.range(60).select(F.col("id").alias("j"), F.when(F.col("id") < 50, 0).otherwise(F.col("id") % 5).alias("k"))
    want = sorted(map(tuple, a.join(b, "k").select("k", "id", "j").collect()))
    for each in (10, 10**9):
        assert sorted(map(tuple, scale.salted_pairs(a, b, "k", pairs_each=each).select("k", "id", "j").collect())) == want


def test_running_total(spark):
    df = spark.range(100).select("id", F.lit(1).alias("k"))
    got = {r["id"]: r["t"] for r in scale.running(df, [], "id", F.col("id"), "t", width=9).collect()}
    assert got == {i: i * (i + 1) // 2 for i in range(100)}


def test_stage_reads_back(spark, tmp_path):
    df = scale.stage(spark.range(10), "x")
    assert df.count() == 10 and df.dtypes == spark.range(1).dtypes


def test_clock(spark):
    rows = [("r", 1, 10, "READY", True), ("r", 2, 10, "READY", False), ("r", 3, 10, "PENDING", False), ("r", 4, 10, "DEAD", False), ("r", 5, 10, "READY", False), ("q", 1, 10, "READY", False)]
    df = spark.createDataFrame(rows, "ring string, i bigint, n_bytes bigint, state string, hot boolean")
    got = {(r["ring"], r["i"]): r["fate"] for r in lifecycle.clock(df, "ring", "i", 25).collect()}
    assert got == {("r", 1): "MOVED", ("r", 2): "EVICTED", ("r", 3): "SKIPPED", ("r", 4): "RECLAIMED", ("r", 5): "EVICTED", ("q", 1): "KEPT"}


def test_placement(spark):
    df = spark.createDataFrame([(1, 100), (2, 50), (3, 50)], "i bigint, n bigint")
    assert {r["i"]: r["voffset"] for r in lifecycle.placement(df, "i", "n", width=2).collect()} == {1: 0, 2: 112, 3: 174}


CASES = {
    "   ": "BLANK", "": "BLANK", "{": "INVALID_JSON", "[1]": "NOT_OBJECT", '"x"': "NOT_OBJECT", '{"prompt": "a"}': "MISSING_KEYS", '{"prompt": "a", "payload": "b", "x": 1}': "EXTRA_KEYS",
    '{"prompt": 1, "payload": "b"}': "NOT_STRING", '{"prompt": null, "payload": "b"}': "NOT_STRING", '{"prompt": " ", "payload": "b"}': "WHITESPACE_ONLY", '{"payload": "b", "prompt": "a"}': None,
}


def test_violations(spark):
    df = spark.createDataFrame([(x,) for x in CASES], "raw string")
    assert {r["raw"]: r["v"] for r in df.select("raw", records.violation(F.col("raw")).alias("v")).collect()} == CASES


def test_sources(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"prompt": "p", "payload": "q", "x": 1}\n\nbroken\n{"prompt": "", "payload": "q"}\n')
    (tmp_path / "b.jsonl").write_text('{"prompt": "r", "payload": "s"}\n')
    paths = [str(tmp_path / x) for x in ("a.jsonl", "b.jsonl")]
    df = records.lines(spark, *paths)
    assert records.line_count(spark, *paths) == 5
    assert sorted(r["prompt"] for r in records.parsed(df).collect()) == ["p", "r"]
    with pytest.raises(Exception, match="malformed line"):
        records.parsed(df, strict=True).collect()
    assert records.jsonl(spark, paths[1], "prompt string, payload string").count() == 1
    (tmp_path / "c.json").write_text('[{"instruction": "a", "input": "", "output": "b"}]')
    schema = "instruction string, input string, output string"
    assert records.json_array(spark, str(tmp_path / "c.json"), schema).count() == 1
    (tmp_path / "d.json").write_text('{"instruction": "a"}')
    with pytest.raises(ValueError):
        records.json_array(spark, str(tmp_path / "d.json"), schema)
    records.write_jsonl(records.parsed(df), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2


def test_preprocess_tags(spark):
    df = spark.createDataFrame([("a", "b", "c"), ("a", "", None), (" ", None, "c"), ("w " * 30, "b", "c"), ("a", "w " * 30, "c")], "i string, c string, o string")
    got = records.newline_records(df, "i", "c", "o", 20).collect()
    assert [(r["tag"], r["kept"]) for r in got] == [(None, True), ("EMPTY_OUTPUT", False), ("EMPTY_PROMPT", False), ("OVER_LIMIT", True), ("OVER_LIMIT", True)]
    assert [r["kept"] for r in records.newline_records(df, "i", "c", "o", 20, "drop").collect()] == [True, False, False, False, False]
    got = records.space_records(df, "i", "c", "o", 20).collect()
    assert [(r["tag"], r["prompt"]) for r in got][4] == ("CONTEXT_DROPPED", "a") and got[0]["prompt"] == "a b"


def test_manifest(tmp_path):
    good = {"repo_id": "Own.er/data-set", "revision": "0123456789abcdefABCDEF0123456789abcdef01", "file_path": "x y", "local_name": "n_1"}

    def load(fields, name="m.toml"):
        (tmp_path / name).write_text("\n".join(f'{k} = "{v}"' for k, v in fields.items()))
        return records.load_manifest(str(tmp_path / name))

    assert load(good) == load(good | {"more": "ignored"}) == good
    for key, value in (("repo_id", ".a/b"), ("repo_id", "a/-b"), ("repo_id", "a/b/c"), ("revision", "main"), ("revision", "0" * 39), ("file_path", " "), ("local_name", "-a"), ("local_name", "a.b")):
        with pytest.raises(ValueError):
            load(good | {key: value})
    with pytest.raises(ValueError):
        load({"repo_id": "a/b"})


def test_tables_over_the_bound_are_not_broadcast(spark):
    """Beyond BROADCAST_ROWS keys the joins are shuffled, and the rows are the same."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    old = spark.conf.get(key)
    spark.conf.set(key, -1)
    try:
        for n, broadcast in ((scale.BROADCAST_ROWS + 1000, False), (1000, True)):
            left = spark.range(n).select(F.col("id").alias("k"), F.col("id").alias("x"))
            right = spark.range(n).select(F.col("id").alias("k"), (F.col("id") * 2).alias("y"))
            got = scale.salted_pairs(left, right, "k")
            assert got.where("y = 2 * x").count() == n
            assert ("BroadcastHashJoin" in got._jdf.queryExecution().sparkPlan().toString()) is broadcast
    finally:
        spark.conf.set(key, old)


def test_each_branch_of_validation(spark):
    rows = [
        ("", "BLANK"), ("\u3000\u00a0", "BLANK"), (None, None), ("{", "INVALID_JSON"), ("[1]", "NOT_OBJECT"), ('"x"', "NOT_OBJECT"), ('{"prompt": "a"}', "MISSING_KEYS"), ('{"prompt": 1, "x": 2}', "MISSING_KEYS"),
        ('{"prompt": "a", "payload": "b", "x": 1}', "EXTRA_KEYS"), ('{"prompt": 1, "payload": "b"}', "NOT_STRING"), ('{"prompt": " ", "payload": 1}', "WHITESPACE_ONLY"), ('{"prompt": "a", "payload": null}', "NOT_STRING"),
        ('{"prompt": "\\u3000", "payload": "b"}', "WHITESPACE_ONLY"), ('{"prompt": "a", "payload": "\u2003\u2028"}', "WHITESPACE_ONLY"), ('{"prompt": "a", "payload": "b"}', None),
    ]
    df = spark.createDataFrame([(i, r) for i, (r, _) in enumerate(rows)], "i int, raw string")
    got = {r["i"]: r["v"] for r in df.select("i", records.violation(F.col("raw")).alias("v")).collect()}
    assert {i: v for i, (r, v) in enumerate(rows) if r is not None} == {i: v for i, v in got.items() if rows[i][0] is not None}


def test_preprocessing_keeps_payloads_and_empty_instructions(spark):
    df = spark.createDataFrame([(1, " a ", "\u3000", " x\n"), (2, "", "w " * 30, "y"), (3, "b", "w " * 30, "y"), (4, "b", "c", "\u00a0"), (5, None, None, None), (6, "", " ", "y")], "i int, q string, c string, r string")
    got = {r["i"]: (r["prompt"], r["payload"], r["tag"], r["kept"]) for r in records.PLUGINS["space"](df, "q", "c", "r", 10).collect()}
    assert got[1] == ("a", " x\n", None, True) and got[3] == ("b", "y", "CONTEXT_DROPPED", True) and got[4][2:] == got[5][2:] == ("EMPTY_OUTPUT", False) and got[6] == ("", "y", None, True)
    assert got[2][2:] == ("OVER_LIMIT", True) and got[2][0].endswith(" w")
    got = {r["i"]: (r["prompt"], r["payload"], r["tag"], r["kept"]) for r in records.PLUGINS["newline"](df, "q", "c", "r", 10).collect()}
    assert got[1] == ("a", " x\n", None, True) and got[6] == ("", "y", "EMPTY_PROMPT", False) and got[4][2] == "EMPTY_OUTPUT"


def test_prompts_need_no_payload(spark):
    df = spark.createDataFrame([('{"prompt": "a"}',), ('{"prompt": "", "payload": "b"}',), ("",), ("broken",), (None,), ('["prompt"]',), ('{"payload": "b"}',)], "raw string")
    assert [r["prompt"] for r in records.prompts_of(df).collect()] == ["a"]


def test_service_life(spark, tmp_path):
    c = SemanticCache(spark, str(tmp_path))
    req = lambda *x: spark.createDataFrame(list(x), "request_id bigint, prompt string")
    got = {r["request_id"]: r for r in c.check(req((1, "alpha beta gamma"), (2, "alpha beta gamma"), (3, ""), (4, "x" * 2000), (5, "!!")), 0).collect()}
    assert [got[i]["state"] for i in (1, 2, 3, 4, 5)] == ["MISS", "PENDING", "REJECTED", "MISS", "REJECTED"]
    assert got[1]["node_id"] == got[2]["node_id"] is not None and got[4]["node_id"] is None and got[5]["reason"] == "DEGENERATE"
    node = got[1]["node_id"]
    assert c.check(req((6, "gamma beta alpha")), 1000).first()["state"] == "PENDING"
    answers = spark.createDataFrame([(node, "answer"), (999, "no")], "node_id bigint, payload string")
    assert {r["node_id"]: r["success"] for r in c.commit(answers, 2000).collect()} == {node: True, 999: False}
    assert [r["success"] for r in c.commit(answers.limit(1), 2000).collect()] == [False]  # not pending any more
    hit = {r["request_id"]: r for r in c.check(req((7, "gamma beta alpha"), (8, "alpha beta gamma"), (9, "something else")), 3000).collect()}
    assert [hit[i]["state"] for i in (7, 8, 9)] == ["HIT", "HIT", "MISS"] and hit[7]["payload"] == "answer"
    assert c.sweep(3000) == 0 and c.sweep(40_000) == 1
    late = c.check(req((10, "something else")), 41_000).first()
    assert late["state"] == "MISS"
    assert [r["success"] for r in c.commit(spark.createDataFrame([(late["node_id"], "x")], answers.schema), 99_000).collect()] == [False]  # expired


def test_bulk_load_and_provider(spark, tmp_path):
    c = SemanticCache(spark, str(tmp_path))
    rec = spark.createDataFrame([(1, "a b c", "x"), (2, "a b c", "y"), (3, "d e f", "z"), (4, "", "w")], "record_id bigint, prompt string, payload string")
    assert {r["outcome"]: r["n"] for r in c.load(rec, 0).collect()} == {"inserted": 2, "already_cached": 1, "skipped": 1}
    assert c.nodes().where("state = 'READY'").count() == 2
    got = generate(spark.createDataFrame([(1, "p"), (2, "bad")], "request_id bigint, prompt string"), lambda p: {"p": "ok"}[p])
    assert {r["request_id"]: r["payload"] for r in got.collect()} == {1: "ok", 2: None}
