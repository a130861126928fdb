"""Scalar functions on text and time, all of them expressions the JVM evaluates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: all white space of Unicode, with the four separator controls, as a class of regular expressions.
WHITE = r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
TOKEN = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"


def token_count(text: Column) -> Column:
    """Tokens of the default tokenizer (runs of letters and digits, single other signs) and two marks."""
    return F.size(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))) + 2


def strip(text: Column) -> Column:
    """Without white space of Unicode at both ends."""
    return F.regexp_replace(text, rf"\A{WHITE}+|{WHITE}+\z", "")


def build_prompt(instruction: Column, context: Column, separator: str) -> Column:
    """Instruction and context without outer white space, joined if there is a context. Nulls count as empty."""
    i, c = (F.coalesce(strip(x), F.lit("")) for x in (instruction, context))
    return F.when(c != "", F.concat(i, F.lit(separator), c)).otherwise(i)


def redact(secret: Column) -> Column:
    """Secrets of fewer than 8 characters become stars; longer ones keep their last four."""
    n = F.length(secret)
    return F.when(n < 8, F.repeat(F.lit("*"), n)).otherwise(F.concat(F.repeat(F.lit("*"), n - 4), F.right(secret, F.lit(4))))


def json_string(text: Column) -> Column:
    """The inside of a JSON string literal."""
    whole = F.to_json(F.struct(text.alias("x")))
    return F.substring(whole, F.lit(7), F.length(whole) - 8)


def render(template: str, text: Column, placeholder: str = "{{PLACEHOLDER}}") -> Column:
    """The template with its first placeholder replaced by the JSON-escaped text. ValueError without a placeholder."""
    head, found, tail = template.partition(placeholder)
    if not found:
        raise ValueError("template has no placeholder")
    return F.concat(F.lit(head), json_string(text), F.lit(tail))


def json_path(path: str | Sequence[str]) -> str:
    """The JSON path of a list of segments, or of ones parted by commas: keys as they are, also with dots, or places in
    arrays (whole numbers, in brackets or not). ValueError for blank segments and for keys with a quote."""
    out = "$"
    for part in path.split(",") if isinstance(path, str) else path:
        if not part.strip():
            raise ValueError(f"blank segment in {path!r}")
        if "'" in part:
            raise ValueError(f"a quote in {part!r}")
        place = part[1:-1] if part[:1] == "[" and part[-1:] == "]" else part
        out += f"[{place}]" if place.isdigit() else f"['{part}']"
    return out


def extract(body: Column, path: str | Sequence[str] = "prompt") -> Column:
    """The string at ``path`` of a JSON body; null if it is missing or empty."""
    x = F.get_json_object(body, json_path(path))
    return F.when(x != "", x)


def is_special(token: Column) -> Column:
    """Whether a token of a vocabulary is a mark in brackets, not text."""
    return token.startswith("[") & token.endswith("]")


def surface(token: Column) -> Column:
    """A token without the marks of continuation before it."""
    return F.regexp_replace(token, "^#+", "")


def client_key(forwarded: Column, remote: Column) -> Column:
    """First address of a forwarding header, else the host of host:port, else the address as it is."""
    first = F.trim(F.substring_index(forwarded, ",", 1))
    host = F.regexp_extract(remote, r"^\[?([^\]]*?)\]?:\d+$", 1)
    return F.when(F.coalesce(first, F.lit("")) != "", first).when(F.coalesce(host, F.lit("")) != "", host).otherwise(remote)


def millis(ts: str) -> Column:
    """Milliseconds since 1970 of the column of this name, a timestamp without zone."""
    return F.expr(f"timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{ts}`)")


def split_cores(n: Column) -> Column:
    """(shared, engine, gateway) cores of ``n``: one is shared by both; up to 8 are halved with an odd one to the engine; of more the engine takes 4."""
    half = F.when(n <= 1, n).when(n <= 8, F.floor((n + 1) / 2)).otherwise(F.lit(4)).cast("int")
    return F.struct((n == 1).alias("shared"), half.alias("engine"), F.when(n <= 1, n).otherwise(n - half).cast("int").alias("gateway"))
