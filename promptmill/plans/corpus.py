"""Queries on corpora: parsing, validation, preprocessing, profiles, templates and manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import profile
from ..sources import records

TOKENS = 40
FIXED = (50, 80, 100, 120, 150, 200, 250, 300, 400, 600)
TEMPLATE = '{"model": "m", "messages": [{"role": "user", "content": "{{PLACEHOLDER}}"}]}'


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines with what is wrong with them. Exact repeats are still there: they go when only narrow columns are left."""
    return _t(spark, sf_dir, "record_lines").withColumn("violation", records.violation(F.col("raw")))


def corpus_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usable lines with the lengths of their prompt and payload; lines that aren't JSON are skipped."""
    valid = _judged(spark, sf_dir).where(~F.coalesce(F.col("violation").isin("BLANK", "INVALID_JSON", "NOT_OBJECT"), F.lit(False)))
    got = records.parsed(valid)
    return got.select("line_id", F.char_length("prompt").alias("prompt_chars"), F.char_length("payload").alias("payload_chars")).distinct()


def request_prompt_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prompt at a configured path of each event's body, or BAD_REQUEST."""
    e = _t(spark, sf_dir, "events")
    k = text.extract(F.col("props"), "k")
    return e.select("event_id", k.alias("prompt"), F.when(k.isNull(), "BAD_REQUEST").otherwise("OK").alias("status"))


def corpus_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir).select("line_id", "violation").distinct()


def validation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per file: lines, passed, violations, blank, over the limit, and tokens of the passed prompts."""
    j = _judged(spark, sf_dir).withColumn("prompt", F.when(F.col("violation").isNull(), F.get_json_object("raw", "$.prompt")))
    j = j.select("line_id", "local_name", "violation", F.when(F.col("violation").isNull(), text.token_count(F.col("prompt"))).alias("n")).distinct()
    return j.groupBy("local_name").agg(
        F.count_if(F.coalesce(F.col("violation") != "BLANK", F.lit(True))).alias("total"),
        F.count_if(F.col("violation").isNull()).alias("passed"),
        F.count_if(F.col("violation") != "BLANK").alias("violations"),
        F.count_if(F.col("violation") == "BLANK").alias("blank"),
        F.count_if(F.col("n") > TOKENS).alias("over_limit"),
        F.min("n").alias("min_tokens"),
        F.max("n").alias("max_tokens"),
        F.round(F.avg("n"), 6).alias("mean_tokens"),
    )


def validation_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per file: characters of the prompts and payloads of the passed lines; nulls for a file without one."""
    sizes = [F.when(F.col("violation").isNull(), F.char_length(F.get_json_object("raw", f"$.{name}"))).alias(name) for name in ("prompt", "payload")]
    j = _judged(spark, sf_dir).select("line_id", "local_name", *sizes).distinct()
    cols = []
    for name in ("prompt", "payload"):
        n = F.col(name)
        cols += [F.min(n).alias(f"min_{name}_chars"), F.max(n).alias(f"max_{name}_chars"), F.round(F.avg(n), 6).alias(f"mean_{name}_chars")]
    return j.groupBy("local_name").agg(*cols)


def precache_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bulk load per file: lines inserted, cached already (the prompt came in an earlier line) and skipped."""
    j = _judged(spark, sf_dir)
    usable = F.col("violation").isNull() | (F.col("violation") == "EXTRA_KEYS")
    j = j.withColumn("hash", F.when(usable, F.sha2(F.get_json_object("raw", "$.prompt"), 256))).select("line_id", "local_name", "hash").distinct()
    first = j.where("hash is not null").groupBy("hash").agg(F.min("line_id").alias("line_id")).withColumn("first", F.lit(True))
    j = j.join(first, ["hash", "line_id"], "left")
    return j.groupBy("local_name").agg(F.count(F.lit(1)).alias("total"), F.count_if("first").alias("inserted"), F.count_if(F.col("hash").isNotNull() & F.col("first").isNull()).alias("already_cached"), F.count_if(F.col("hash").isNull()).alias("skipped"))


def _raw_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "cache_records").select("record_id", F.col("prompt").alias("ask"), F.col("local_name").alias("context"), F.col("payload").alias("answer"))


def _processed(df: DataFrame) -> DataFrame:
    return df.select("record_id", "tag", "kept", F.octet_length("prompt").alias("prompt_bytes"), F.octet_length("payload").alias("payload_bytes")).distinct()


def corpus_preprocess_newline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _processed(records.PLUGINS["newline"](_raw_records(spark, sf_dir), "ask", "context", "answer", TOKENS))


def corpus_preprocess_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _processed(records.PLUGINS["space"](_raw_records(spark, sf_dir), "ask", "context", "answer", 22))


def corpus_drop_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_preprocess_newline(spark, sf_dir).groupBy("tag", "kept").agg(F.count(F.lit(1)).alias("n"))


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.lengths(_t(spark, sf_dir, "check_requests"), "prompt")


def length_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.distribution(_sizes(spark, sf_dir), TOKENS)


def threshold_fp_fn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of ten fixed byte thresholds."""
    return profile.gate_errors(_sizes(spark, sf_dir), list(FIXED), TOKENS)


def threshold_zero_fp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least byte threshold that rejects no prompt within the token limit, and its errors; no row if there is no such prompt."""
    sizes = _sizes(spark, sf_dir)
    most = sizes.where(F.col("n_tokens") <= TOKENS).agg(F.max("n_bytes")).first()[0]
    return profile.gate_errors(sizes if most is not None else sizes.where("false"), [most or 0], TOKENS)


def fp_fn_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.gate_errors(_sizes(spark, sf_dir), list(range(10, 601, 10)), TOKENS)


def token_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of the shortest and longest token, and the bounds for 254 of them."""
    t = profile.tokens(_t(spark, sf_dir, "check_requests"), "prompt")
    return t.agg(F.count(F.lit(1)).alias("vocabulary"), F.min("n_bytes").alias("shortest"), F.max("n_bytes").alias("longest"), (F.min("n_bytes") * 254).alias("lower"), (F.max("n_bytes") * 254).alias("upper"))


def token_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten shortest and the ten longest tokens."""
    t = profile.tokens(_t(spark, sf_dir, "check_requests"), "prompt").select("token", "n_bytes")
    short = t.orderBy("n_bytes", "token").limit(10).withColumn("side", F.lit("short"))
    return short.union(t.orderBy(F.desc("n_bytes"), "token").limit(10).withColumn("side", F.lit("long")))


def vocabulary_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of the shortest and longest surface of a vocabulary with marks, without special tokens, and the bounds for 254.

    The vocabulary: tokens of letters and digits of the prompts, each as it is and as a continuation, and in brackets.
    """
    t = profile.tokens(_t(spark, sf_dir, "check_requests"), "prompt").where(F.col("token").rlike(r"^[\p{L}\p{N}]")).select("token")
    marked = t.select(F.explode(F.array(F.col("token"), F.concat(F.lit("##"), "token"), F.concat(F.lit("["), "token", F.lit("]")))).alias("token"))
    size = F.octet_length(text.surface(F.col("token")))
    sizes = marked.where(~text.is_special(F.col("token"))).agg(F.count(F.lit(1)).alias("vocabulary"), F.min(size).alias("shortest"), F.max(size).alias("longest"))
    return sizes.select("*", (F.col("shortest") * 254).alias("lower"), (F.col("longest") * 254).alias("upper"))


def length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts in 40 equal bins of byte length; lengths are counted first."""
    by = _sizes(spark, sf_dir).groupBy("n_bytes").agg(F.count(F.lit(1)).alias("n"))
    lo, hi = by.agg(F.min("n_bytes"), F.max("n_bytes")).first()
    if lo is None:
        return by.select(F.lit(0).alias("bin"), "n")
    bin_ = F.least(F.lit(39), F.floor((F.col("n_bytes") - lo) * 40 / max(hi - lo, 1))).cast("int")
    return by.groupBy(bin_.alias("bin")).agg(F.sum("n").alias("n"))


def length_scatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of 5000 prompts sampled by hash (a sampling operator; the plot's data)."""
    r = _t(spark, sf_dir, "check_requests").where("prompt is not null").select("request_id", "prompt").distinct()
    few = r.orderBy(F.md5(F.col("request_id").cast("string")), "request_id").limit(5000)
    return few.select("request_id", F.octet_length("prompt").alias("n_bytes"), text.token_count(F.col("prompt")).alias("n_tokens"))


def repeatability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.repeatable("cache", spark)


def redact_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _t(spark, sf_dir, "customer")
    return c.select("c_custkey", text.redact(F.col("c_name")).alias("name"), text.redact(F.col("c_mktsegment").substr(1, 6)).alias("segment"))


def template_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _t(spark, sf_dir, "cache_records").where("prompt is not null").select("record_id", "prompt").distinct()
    return r.select("record_id", text.render(TEMPLATE, F.col("prompt")).alias("body"))


def core_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = spark.range(1, 65).select(F.col("id").cast("int").alias("n"))
    return n.withColumn("x", text.split_cores(F.col("n"))).select("n", "x.shared", "x.engine", "x.gateway")


def manifest_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _t(spark, sf_dir, "manifests")
    return m.select("local_name", records.manifest_problem(*[F.col(c) for c in ("repo_id", "revision", "file_path", "local_name")]).alias("problem"))


_TOKENS = r"(len(regexp_extract_all({0}, '[\p{{L}}\p{{N}}]+|[^\s\p{{L}}\p{{N}}]')) + 2)"
# White space as Python's str.strip knows it, told apart from the operator's class.
_WHITE = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in map(chr, range(0x10000)) if c.isspace()) + "]"
_STRIP = "regexp_replace({0}, '\\A" + _WHITE.replace("{", "{{").replace("}", "}}") + "+|" + _WHITE.replace("{", "{{").replace("}", "}}") + "+\\z', '', 'g')"
_J = rf"""j AS (SELECT line_id, local_name, raw, CASE WHEN {_STRIP.format("raw")} = '' THEN 'BLANK' WHEN NOT json_valid(raw) THEN 'INVALID_JSON' WHEN json_type(raw) <> 'OBJECT' THEN 'NOT_OBJECT'
  WHEN NOT list_has_all(json_keys(raw), ['prompt', 'payload']) THEN 'MISSING_KEYS' WHEN len(json_keys(raw)) > 2 THEN 'EXTRA_KEYS'
  WHEN json_type(raw, '$.prompt') <> 'VARCHAR' THEN 'NOT_STRING' WHEN {_STRIP.format("json_extract_string(raw, '$.prompt')")} = '' THEN 'WHITESPACE_ONLY'
  WHEN json_type(raw, '$.payload') <> 'VARCHAR' THEN 'NOT_STRING' WHEN {_STRIP.format("json_extract_string(raw, '$.payload')")} = '' THEN 'WHITESPACE_ONLY' END AS violation
  FROM (SELECT DISTINCT * FROM record_lines))"""
_S = f"s AS (SELECT strlen(prompt) AS b, {_TOKENS.format('prompt')} AS t FROM check_requests WHERE prompt IS NOT NULL)"
_R = f"""r AS (SELECT DISTINCT record_id, coalesce({_STRIP.format("prompt")}, '') AS i, {_STRIP.format("local_name")} AS c, coalesce(payload, '') AS a, coalesce({_STRIP.format("payload")}, '') = '' AS blank FROM cache_records)"""
_N = f"""n AS (SELECT record_id, p, a, CASE WHEN blank THEN 'EMPTY_OUTPUT' WHEN p = '' THEN 'EMPTY_PROMPT' WHEN {_TOKENS.format("p")} > {TOKENS} THEN 'OVER_LIMIT' END AS tag
  FROM (SELECT record_id, a, blank, CASE WHEN coalesce(c, '') <> '' THEN i || chr(10) || c ELSE i END AS p FROM r))"""
_K = "coalesce(tag NOT IN ('EMPTY_OUTPUT', 'EMPTY_PROMPT'), true) AS kept"
_W = r"w AS (SELECT token, strlen(token) AS b FROM (SELECT DISTINCT unnest(regexp_extract_all(prompt, '[\p{L}\p{N}]+|[^\s\p{L}\p{N}]')) AS token FROM check_requests))"


def _errors(thresholds: str) -> str:
    return f"WITH {_S}, h AS (SELECT unnest({thresholds})::INT AS threshold) SELECT threshold, count(*) FILTER (t <= {TOKENS} AND b > threshold) AS fp, count(*) FILTER (t > {TOKENS} AND b <= threshold) AS fn FROM h CROSS JOIN s GROUP BY 1"


ORACLES = {
    "corpus_parse": f"""WITH {_J} SELECT line_id, length(p)::INT AS prompt_chars, length(a)::INT AS payload_chars FROM (
SELECT line_id, json_extract_string(raw, '$.prompt') AS p, json_extract_string(raw, '$.payload') AS a FROM j WHERE violation IS NULL OR violation NOT IN ('BLANK', 'INVALID_JSON', 'NOT_OBJECT')) WHERE p <> '' AND a <> ''""",
    "request_prompt_extract": "SELECT event_id, json_extract_string(props, '$.k') AS prompt, CASE WHEN json_extract_string(props, '$.k') IS NULL THEN 'BAD_REQUEST' ELSE 'OK' END AS status FROM events",
    "corpus_validate": f"WITH {_J} SELECT line_id, violation FROM j",
    "validation_summary": f"""WITH {_J}, k AS (SELECT local_name, violation, CASE WHEN violation IS NULL THEN {_TOKENS.format("json_extract_string(raw, '$.prompt')")} END AS n FROM j)
SELECT local_name, count(*) FILTER (violation IS DISTINCT FROM 'BLANK') AS total, count(*) FILTER (violation IS NULL) AS passed, count(*) FILTER (violation <> 'BLANK') AS violations, count(*) FILTER (violation = 'BLANK') AS blank,
count(*) FILTER (n > {TOKENS}) AS over_limit, min(n)::INT AS min_tokens, max(n)::INT AS max_tokens, round(avg(n), 6) AS mean_tokens FROM k GROUP BY 1""",
    "validation_lengths": f"""WITH {_J}, k AS (SELECT local_name, CASE WHEN violation IS NULL THEN length(json_extract_string(raw, '$.prompt')) END AS p, CASE WHEN violation IS NULL THEN length(json_extract_string(raw, '$.payload')) END AS a FROM j)
SELECT local_name, min(p)::INT AS min_prompt_chars, max(p)::INT AS max_prompt_chars, round(avg(p), 6) AS mean_prompt_chars, min(a)::INT AS min_payload_chars, max(a)::INT AS max_payload_chars, round(avg(a), 6) AS mean_payload_chars FROM k GROUP BY 1""",
    "precache_outcomes": f"""WITH {_J}, h AS (SELECT line_id, local_name, CASE WHEN violation IS NULL OR violation = 'EXTRA_KEYS' THEN json_extract_string(raw, '$.prompt') END AS p FROM j),
o AS (SELECT local_name, p, p IS NOT NULL AND line_id = min(line_id) OVER (PARTITION BY p) AS first FROM h)
SELECT local_name, count(*) AS total, count(*) FILTER (first) AS inserted, count(*) FILTER (p IS NOT NULL AND NOT first) AS already_cached, count(*) FILTER (p IS NULL) AS skipped FROM o GROUP BY 1""",
    "corpus_preprocess_newline": f"WITH {_R}, {_N} SELECT record_id, tag, {_K}, strlen(p)::INT AS prompt_bytes, strlen(a)::INT AS payload_bytes FROM n",
    "corpus_preprocess_space": f"""WITH {_R}, f AS (SELECT record_id, i, a, blank, CASE WHEN coalesce(c, '') <> '' THEN i || ' ' || c ELSE i END AS p FROM r),
g AS (SELECT *, CASE WHEN blank THEN 'EMPTY_OUTPUT' WHEN {_TOKENS.format("p")} <= 22 THEN NULL WHEN i <> '' AND {_TOKENS.format("i")} <= 22 THEN 'CONTEXT_DROPPED' ELSE 'OVER_LIMIT' END AS tag FROM f)
SELECT record_id, tag, {_K}, strlen(CASE WHEN tag = 'CONTEXT_DROPPED' THEN i ELSE p END)::INT AS prompt_bytes, strlen(a)::INT AS payload_bytes FROM g""",
    "corpus_drop_reasons": f"WITH {_R}, {_N} SELECT tag, {_K}, count(*) AS n FROM n GROUP BY 1, 2",
    "length_profile": f"""WITH {_S} SELECT count(*) AS n, min(b)::INT AS min_bytes, max(b)::INT AS max_bytes, round(avg(b), 6) AS mean_bytes, round(quantile_cont(b, 0.5), 6) AS p50, round(quantile_cont(b, 0.95), 6) AS p95,
round(quantile_cont(b, 0.99), 6) AS p99, round(quantile_cont(b, 0.999), 6) AS p999 FROM s WHERE t <= {TOKENS}""",
    "threshold_fp_fn": _errors(str(list(FIXED))),
    "threshold_zero_fp": _errors(f"(SELECT [max(b) FILTER (t <= {TOKENS})] FROM s)") + " HAVING threshold IS NOT NULL",
    "fp_fn_curve": _errors("range(10, 601, 10)"),
    "token_bounds": f"WITH {_W} SELECT count(*) AS vocabulary, min(b)::INT AS shortest, max(b)::INT AS longest, (min(b) * 254)::INT AS lower, (max(b) * 254)::INT AS upper FROM w",
    "vocabulary_surface": r"""
WITH t AS (SELECT DISTINCT unnest(regexp_extract_all(prompt, '[\p{L}\p{N}]+|[^\s\p{L}\p{N}]')) AS token FROM check_requests),
m AS (SELECT unnest([token, '##' || token, '[' || token || ']']) AS token FROM t WHERE regexp_matches(token, '^[\p{L}\p{N}]'))
SELECT count(*) AS vocabulary, min(strlen(ltrim(token, '#')))::INT AS shortest, max(strlen(ltrim(token, '#')))::INT AS longest, (min(strlen(ltrim(token, '#'))) * 254)::INT AS lower, (max(strlen(ltrim(token, '#'))) * 254)::INT AS upper
FROM m WHERE NOT (starts_with(token, '[') AND ends_with(token, ']'))""",
    "token_extremes": f"WITH {_W} SELECT token, n_bytes, side FROM (SELECT token, b::INT AS n_bytes, 'short' AS side FROM w ORDER BY b, token LIMIT 10) UNION ALL SELECT * FROM (SELECT token, b::INT, 'long' FROM w ORDER BY b DESC, token LIMIT 10)",
    "length_histogram": f"WITH {_S}, e AS (SELECT min(b) AS lo, max(b) AS hi FROM s) SELECT least(39, (b - lo) * 40 // (hi - lo))::INT AS bin, count(*) AS n FROM s CROSS JOIN e GROUP BY 1",
    "length_scatter": f"SELECT request_id, strlen(prompt)::INT AS n_bytes, {_TOKENS.format('prompt')}::INT AS n_tokens FROM (SELECT DISTINCT request_id, prompt FROM check_requests WHERE prompt IS NOT NULL) ORDER BY md5(request_id::VARCHAR), request_id LIMIT 5000",
    "repeatability": "SELECT unnest(range(1, 257))::INT AS n, unnest(range(1, 257))::INT AS n_tokens",
    "redact_secrets": "SELECT c_custkey, CASE WHEN length(c_name) < 8 THEN repeat('*', length(c_name)) ELSE repeat('*', length(c_name) - 4) || right(c_name, 4) END AS name, repeat('*', length(substr(c_mktsegment, 1, 6))) AS segment FROM customer",
    "template_render": """SELECT record_id, '{"model": "m", "messages": [{"role": "user", "content": ' || to_json(prompt)::VARCHAR || '}]}' AS body FROM (SELECT DISTINCT record_id, prompt FROM cache_records WHERE prompt IS NOT NULL)""",
    "core_split": "SELECT n, n = 1 AS shared, CASE WHEN n = 1 THEN 1 WHEN n <= 8 THEN (n + 1) // 2 ELSE 4 END::INT AS engine, CASE WHEN n = 1 THEN 1 WHEN n <= 8 THEN n // 2 ELSE n - 4 END::INT AS gateway FROM (SELECT unnest(range(1, 65))::INT AS n)",
    "manifest_problems": "SELECT local_name, CASE WHEN NOT regexp_full_match(repo_id, '[A-Za-z0-9][A-Za-z0-9_.-]*/[A-Za-z0-9][A-Za-z0-9_.-]*') THEN 'repo_id' WHEN NOT regexp_full_match(lower(revision), '[0-9a-f]{40}') THEN 'revision' WHEN trim(file_path) = '' THEN 'file_path' WHEN NOT regexp_full_match(local_name, '[A-Za-z0-9][A-Za-z0-9_-]*') THEN 'local_name' END AS problem FROM manifests",
}

QUERIES = {
    f.__name__: f
    for f in (
        corpus_parse, request_prompt_extract, corpus_validate, validation_summary, validation_lengths, precache_outcomes, corpus_preprocess_newline, corpus_preprocess_space, corpus_drop_reasons, length_profile, threshold_fp_fn,
        threshold_zero_fp, fp_fn_curve, token_bounds, token_extremes, vocabulary_surface, length_histogram, length_scatter, repeatability, redact_secrets, template_render, core_split, manifest_problems,
    )
}
