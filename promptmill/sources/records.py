"""JSONL and JSON-array sources, record validation, manifests and sinks."""

from __future__ import annotations

import json
import re
import tomllib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import build_prompt, strip, token_count
from ..model import RECORD

MOST_LINE_BYTES = 10 * 1024 * 1024

# Reasons in the order in which they are looked for.
VIOLATIONS = ("INVALID_JSON", "NOT_OBJECT", "MISSING_KEYS", "EXTRA_KEYS", "NOT_STRING", "WHITESPACE_ONLY")


def lines(spark: SparkSession, *paths: str) -> DataFrame:
    """(raw): the lines of all files."""
    return spark.read.text(list(paths)).withColumnRenamed("value", "raw")


def line_count(spark: SparkSession, *paths: str) -> int:
    return lines(spark, *paths).count()


def is_object(raw: Column) -> Column:
    """Whether a line is a whole JSON object."""
    return F.coalesce(F.schema_of_variant(F.try_parse_json(raw)).startswith("OBJECT"), F.lit(False))


def parsed(df: DataFrame, raw: str = "raw", strict: bool = False) -> DataFrame:
    """``df`` with prompt and payload of each usable line; further keys are ignored.

    A line is usable if it is an object in which both are non-empty. Others are left out, or, if ``strict``, the first
    of them that a task meets fails the job.
    """
    usable = is_object(F.col(raw)) & F.col("prompt").isNotNull() & (F.col("prompt") != "") & F.col("payload").isNotNull() & (F.col("payload") != "")
    short = F.octet_length(F.col(raw)) <= MOST_LINE_BYTES
    text = F.when(short, F.col(raw))
    out = df.withColumns({"prompt": F.get_json_object(text, "$.prompt"), "payload": F.get_json_object(text, "$.payload")})
    if strict:
        fail = F.raise_error(F.concat(F.lit("malformed line: "), F.substring(F.coalesce(F.col(raw), F.lit("null")), 1, 80)))
        return out.withColumn("prompt", F.when(usable, F.col("prompt")).otherwise(fail))
    return out.where(usable)


def json_array(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Rows of a file that holds one JSON array. ValueError if its top level isn't an array.

    One value is one file to Spark, so it is parsed once, as text, and its elements are taken from there.
    """
    text = spark.read.text(path, wholetext=True)
    if text.where(F.substring(strip(F.col("value")), 1, 1) != "[").limit(1).count():
        raise ValueError("top level must be an array")
    each = schema.simpleString() if isinstance(schema, T.StructType) else T._parse_datatype_string(schema).simpleString()
    return text.select(F.explode(F.from_json("value", f"array<{each}>", {"mode": "FAILFAST"})).alias("x")).select("x.*")


def prompts(spark: SparkSession, *paths: str) -> DataFrame:
    """(prompt): the prompts of the lines of all files; blank and malformed lines and ones without a prompt are left out."""
    return prompts_of(lines(spark, *paths))


def prompts_of(df: DataFrame, raw: str = "raw") -> DataFrame:
    """``df`` with the prompt of each line that is an object with one; a payload isn't asked for."""
    found = df.where(is_object(F.col(raw))).withColumn("prompt", F.try_variant_get(F.try_parse_json(F.col(raw)), "$.prompt", "string"))
    return found.where(F.col("prompt").isNotNull() & (F.col("prompt") != ""))


def jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Rows of a JSONL file; blank and malformed lines are left out, fields of another type are null."""
    whole = lines(spark, path).where(is_object(F.col("raw")))
    return whole.select(F.from_json("raw", schema).alias("x")).select("x.*")


def violation(raw: Column) -> Column:
    """Why a line breaks the record schema {prompt, payload}; null for valid lines. Blank lines are BLANK, which isn't a violation.

    The prompt is judged, then the payload: first whether it is a string, then whether it has more than white space.
    """
    v = F.try_parse_json(raw)
    kind = F.schema_of_variant(v)
    keys = F.json_object_keys(raw)
    want = F.array(F.lit("prompt"), F.lit("payload"))
    kinds = [F.schema_of_variant(F.try_variant_get(v, f"$.{k}", "variant")) for k in ("prompt", "payload")]
    texts = [F.try_variant_get(v, f"$.{k}", "string") for k in ("prompt", "payload")]
    return (
        F.when(strip(raw) == "", "BLANK")
        .when(v.isNull(), "INVALID_JSON")
        .when(~kind.startswith("OBJECT"), "NOT_OBJECT")
        .when(F.size(F.array_except(want, keys)) > 0, "MISSING_KEYS")
        .when(F.size(F.array_except(keys, want)) > 0, "EXTRA_KEYS")
        .when(kinds[0] != "STRING", "NOT_STRING")
        .when(strip(texts[0]) == "", "WHITESPACE_ONLY")
        .when(kinds[1] != "STRING", "NOT_STRING")
        .when(strip(texts[1]) == "", "WHITESPACE_ONLY")
    )


def write_jsonl(df: DataFrame, path: str) -> None:
    """Write prompt and payload as JSON lines in UTF-8."""
    df.select(*RECORD.names).write.mode("overwrite").json(path)


# What names in a manifest look like.
REPO_ID, REVISION, LOCAL_NAME = r"[A-Za-z0-9][A-Za-z0-9_.-]*/[A-Za-z0-9][A-Za-z0-9_.-]*", r"[0-9a-fA-F]{40}", r"[A-Za-z0-9][A-Za-z0-9_-]*"


def manifest_problem(repo_id: Column, revision: Column, file_path: Column, local_name: Column) -> Column:
    """The first field of a dataset manifest that isn't well formed, or null."""

    def bad(x: Column, pattern: str) -> Column:
        return x.isNull() | ~x.rlike(rf"\A(?:{pattern})\z")

    return F.when(bad(repo_id, REPO_ID), "repo_id").when(bad(revision, REVISION), "revision").when(file_path.isNull() | (strip(file_path) == ""), "file_path").when(bad(local_name, LOCAL_NAME), "local_name")


def load_manifest(path: str) -> dict[str, str]:
    """The four keys of a manifest in TOML (or JSON, by the file's name); further keys are ignored.

    ValueError if one is missing or not well formed.
    """
    with open(path, "rb") as f:
        got = json.load(f) if path.endswith(".json") else tomllib.load(f)
    want = ("repo_id", "revision", "file_path", "local_name")
    if not isinstance(got, dict) or (missing := [k for k in want if k not in got]):
        raise ValueError(f"a manifest has the keys {list(want)}; missing: {missing if isinstance(got, dict) else list(want)}")
    for key, pattern in zip(want, (REPO_ID, REVISION, r"[\s\S]*\S[\s\S]*", LOCAL_NAME), strict=True):
        if not isinstance(got[key], str) or not re.fullmatch(pattern, got[key]):
            raise ValueError(f"not a valid {key}: {got[key]!r}")
    return {k: got[k] for k in want}


def newline_records(df: DataFrame, instruction: str, context: str, output: str, most_tokens: int = 256, overlimit: str = "flag") -> DataFrame:
    """Adds prompt, payload, tag and kept: instruction and context joined by a newline.

    Tags: EMPTY_OUTPUT and EMPTY_PROMPT are dropped, OVER_LIMIT is kept (or dropped with ``overlimit="drop"``). The
    payload stays as it is, white space included; a null one counts as empty.
    """
    prompt = build_prompt(F.col(instruction), F.col(context), "\n")
    out = df.withColumns({"prompt": prompt, "payload": F.coalesce(F.col(output), F.lit(""))})
    tag = F.when(strip(F.col("payload")) == "", "EMPTY_OUTPUT").when(F.col("prompt") == "", "EMPTY_PROMPT").when(token_count(F.col("prompt")) > most_tokens, "OVER_LIMIT")
    return _kept(out.withColumn("tag", tag), overlimit)


def space_records(df: DataFrame, instruction: str, context: str, output: str, most_tokens: int = 256, overlimit: str = "flag") -> DataFrame:
    """Adds prompt, payload, tag and kept: instruction and context joined by a space, without the context if only the
    instruction is within the limit and isn't empty (tag CONTEXT_DROPPED). The payload stays as it is."""
    full = build_prompt(F.col(instruction), F.col(context), " ")
    alone = F.coalesce(strip(F.col(instruction)), F.lit(""))
    out = df.withColumns({"full": full, "alone": alone, "payload": F.coalesce(F.col(output), F.lit(""))})
    fits, alone_fits = token_count(F.col("full")) <= most_tokens, (F.col("alone") != "") & (token_count(F.col("alone")) <= most_tokens)
    tag = F.when(strip(F.col("payload")) == "", "EMPTY_OUTPUT").when(fits, None).when(alone_fits, "CONTEXT_DROPPED").otherwise("OVER_LIMIT")
    out = out.withColumn("tag", tag).withColumn("prompt", F.when(F.col("tag") == "CONTEXT_DROPPED", F.col("alone")).otherwise(F.col("full")))
    return _kept(out.drop("full", "alone"), overlimit)


def _kept(df: DataFrame, overlimit: str) -> DataFrame:
    if overlimit not in ("flag", "drop"):
        raise ValueError("overlimit is flag or drop")
    gone = ["EMPTY_OUTPUT", "EMPTY_PROMPT"] + (["OVER_LIMIT"] if overlimit == "drop" else [])
    return df.withColumn("kept", F.coalesce(~F.col("tag").isin(gone), F.lit(True)))


#: Dataset plug-ins by name: raw rows to rows with prompt, payload, tag and kept.
PLUGINS: dict[str, Callable[..., DataFrame]] = {"newline": newline_records, "space": space_records}
