"""SQL that gives the same rows as queries of this package, for those that SQL can express on whole tables.

Problems 2 and 3 (a trained model), 6 and 8 (a tokenizer) have none; tests/llm holds them against brute force,
round trips and held-out accuracy.
"""

from __future__ import annotations

import unicodedata

from .lookalikes import confusables, data_file


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _form(column: str) -> str:
    """The look of a text, from Unicode's own data and by rules apart from the operator's tables.

    Each letter that Unicode confuses with a Latin letter of its case becomes that one; a character with a width, a font
    or a no-break decomposition becomes what it decomposes into; format characters and joiners go.
    """
    data = confusables(data_file())
    latin: dict[tuple[str, bool], str] = {}
    for c in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ":
        latin.setdefault((data.get(c, c), c.islower()), c)
    old, new, gone, longer = [], [], [], []
    for c in map(chr, range(0x80, 0x10000)):
        kind, category, parts = unicodedata.decomposition(c), unicodedata.category(c), unicodedata.normalize("NFKC", c)
        if category == "Cf" or 0xFE00 <= ord(c) <= 0xFE0F:
            gone.append(c)
        elif category == "Zs" or c in "\u2010\u2011":
            old.append(c)
            new.append(" " if category == "Zs" else "-")
        elif kind.startswith(("<wide>", "<narrow>", "<font>", "<noBreak>")) and len(parts) == 1:
            old.append(c)
            new.append(parts)
        elif "LIGATURE" in unicodedata.name(c, "") and kind.startswith("<compat>") and parts.isascii():
            longer.append((c, parts))
        elif category in ("Lu", "Ll"):
            plain = unicodedata.normalize("NFD", c)
            if like := latin.get((data.get(plain[0], plain[0]), plain[0].islower())):
                looks = unicodedata.normalize("NFC", like + plain[1:])
                if len(looks) == 1 and looks != c and not c.isascii():
                    old.append(c)
                    new.append(looks)
    x = column
    for a, b in longer:
        x = f"replace({x}, {_quote(a)}, {_quote(b)})"
    return f"nfc_normalize(translate({x}, {_quote(''.join(old + gone))}, {_quote(''.join(new))}))"


_WORDS = r"array_to_string(regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}]+'), ' ')"
_P4 = f"""
WITH r AS (
  SELECT DISTINCT 'check_requests' AS origin, request_id AS id, {_WORDS.format("prompt")} AS k FROM check_requests
  WHERE request_id IS NOT NULL AND prompt IS NOT NULL
  UNION ALL
  SELECT DISTINCT 'record_lines', line_id, a || chr(10) || b FROM (
    SELECT line_id, {_WORDS.format("json_extract_string(raw, '$.prompt')")} AS a, {_WORDS.format("json_extract_string(raw, '$.payload')")} AS b
    FROM (SELECT * FROM record_lines WHERE json_valid(raw)) v
    WHERE json_type(raw) = 'OBJECT' AND json_type(raw, '$.prompt') = 'VARCHAR' AND json_type(raw, '$.payload') = 'VARCHAR')
  WHERE a <> '' AND b <> ''),
g AS (SELECT origin, id, min(id) OVER (PARTITION BY origin, k) AS first_id, k FROM r WHERE k <> '')
"""

_P5 = r"""
WITH s AS (
  SELECT record_id AS id, list_sort(list_distinct(regexp_extract_all(lower(concat_ws(' ', prompt, payload)), '[\p{L}\p{N}]+'))) AS w
  FROM (SELECT DISTINCT record_id, prompt, payload FROM cache_records)),
t AS (SELECT id, w, len(w) AS n FROM s WHERE len(w) >= 30),
-- Two sets so alike share one of the alphabetically first n - ceil(0.8 n) + 1 words of each.
p AS (SELECT id, w, n, unnest(w[1:n - (4 * n + 4) // 5 + 1]) AS x FROM t),
c AS (SELECT DISTINCT a.id AS i, b.id AS j FROM p a JOIN p b ON a.x = b.x AND a.id < b.id AND a.n * 5 >= b.n * 4 AND b.n * 5 >= a.n * 4)
SELECT c.i AS record_lo, c.j AS record_hi FROM c JOIN t a ON a.id = c.i JOIN t b ON b.id = c.j
WHERE len(list_intersect(a.w, b.w)) * 9 >= (a.n + b.n) * 4
"""

_P5_GROUPS = f"""
WITH RECURSIVE p AS (SELECT * FROM ({_P5})),
e AS (SELECT record_lo AS a, record_hi AS b FROM p UNION ALL SELECT record_hi, record_lo FROM p),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
g AS (SELECT a, min(b) AS b FROM r GROUP BY a)
SELECT a AS record_id, least(a, g.b) AS group_id, (SELECT count(*) FROM e WHERE e.a = g.a) AS links FROM g
"""

_P7 = r"""
WITH i AS (SELECT item_id, unnest([prompt, payload]) AS t FROM heldout_items),
iw AS (SELECT item_id, regexp_extract_all(lower(t), '[\p{L}\p{N}]+') AS w FROM i WHERE t IS NOT NULL),
ig AS (SELECT DISTINCT item_id, array_to_string(w[k:k + 11], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS k FROM iw WHERE len(w) >= 12)),
dw AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
dg AS (SELECT doc_id, array_to_string(w[k:k + 11], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS k FROM dw WHERE len(w) >= 12))
SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)
"""

ORACLES: dict[str, str] = {
    "p4_found": _P4 + "SELECT origin, first_id, id AS copy_id FROM g WHERE id <> first_id",
    "p4_distinct": _P4 + "SELECT origin, first_id, count(*) AS copies FROM g GROUP BY origin, first_id",
    "p5_found": _P5,
    "p5_groups": _P5_GROUPS,
    "p7_found": _P7,
}
if data_file():  # Unicode's data on look-alikes comes with Spark
    _A = f"a AS (SELECT DISTINCT request_id, prompt, {_form('prompt')} AS f FROM check_requests WHERE prompt IS NOT NULL)"
    ORACLES["p1_found"] = f"""
WITH {_A}, b AS (SELECT DISTINCT record_id, prompt, {_form("prompt")} AS f FROM cache_records WHERE prompt IS NOT NULL)
SELECT DISTINCT a.request_id, b.record_id FROM a JOIN b ON a.f = b.f AND a.prompt <> b.prompt WHERE trim(a.f, chr(9) || chr(10) || chr(13) || ' ') <> ''"""
    ORACLES["p1_classes"] = f"""
WITH {_A} SELECT DISTINCT request_id, min(request_id) OVER (PARTITION BY f) AS first_id FROM a WHERE trim(f, chr(9) || chr(10) || chr(13) || ' ') <> ''"""
