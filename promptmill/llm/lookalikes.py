"""Which characters look like which letters: a fixed table, and a rule over Unicode's data on confusable characters.

The data is a parameter: a ``confusables.cfu`` file or an archive that has one. Spark itself carries such an archive
(its collation library). Where there is none, the fixed table stands alone.
"""

from __future__ import annotations

import glob
import os
import struct
import unicodedata
import zipfile
from collections import defaultdict
from dataclasses import dataclass
from functools import lru_cache

import pyspark

# Letters of other scripts and symbols, above each the Latin character of the same shape.
SHAPES = {
    "аеорсухѕіјһԁԛԝҽӏѵ": "aeopcyxsijhdqwelv",
    "АВЕЅІЈКМНОРСТХҮԚԜӀѴ": "ABESIJKMHOPCTXYQWIV",
    "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹϳονρ": "ABEZHIKMNOPTYXCjovp",
    "ɡɑⅼⅽⅾⅿⅰⅴⅹⅠⅤⅩⅬⅭⅮⅯℓ℮": "galcdmivxIVXLCDMle",
    "‐‑⁃﹣－․": "-----.",
}
# Letters that Unicode lists as confusable, though a reader sees the difference.
SEEN_APART = "гѡꙇɩαγισυϱϒϜιͺᴦⲅագզռքցꮁ"
# The scripts, by the first word of their letters' names, of which letters can look Latin.
SCRIPTS = ("GREEK", "COPTIC", "CYRILLIC", "ARMENIAN", "CHEROKEE", "LISU")
#: Letters with a second reading where shapes of two Latin letters coincide: it costs a little, so it is the second choice.
SECOND = {"l": "I", "I": "l"}


def data_file() -> str | None:
    """The archive with Unicode's data that comes with Spark, if it is there."""
    found = sorted(glob.glob(os.path.join(os.path.dirname(pyspark.__file__), "jars", "icu4j-*.jar")))
    return found[-1] if found else None


def confusables(path: str | None) -> dict[str, str]:
    """Character -> what Unicode says it is confusable with, a prototype common to all characters of one look."""
    if path is None or not os.path.exists(path):
        return {}
    if zipfile.is_zipfile(path):
        with zipfile.ZipFile(path) as z:
            raw = z.read(next(n for n in z.namelist() if n.endswith("confusables.cfu")))
    else:
        with open(path, "rb") as f:
            raw = f.read()
    body = raw[struct.unpack(">H", raw[:2])[0] :]  # behind the header, in network byte order
    keys, n_keys, values, n_values, table = struct.unpack(">5I", body[12:32])
    out = {}
    for key, value in zip(struct.unpack(f">{n_keys}I", body[keys : keys + 4 * n_keys]), struct.unpack(f">{n_values}H", body[values : values + 2 * n_values]), strict=True):
        units = (key >> 24) + 1  # one UTF-16 unit is the value itself, more stand in the table of strings
        raw_value = struct.pack(">H", value) if units == 1 else body[table + 2 * value : table + 2 * (value + units)]
        out[chr(key & 0xFFFFFF)] = raw_value.decode("utf-16-be", "surrogatepass")
    return out


@dataclass(frozen=True)
class Looks:
    """``first``: characters and, below each, the Latin one that it looks like; ``second``: another that it may be read as.

    Small and hashable, so it goes to the workers with the code.
    """

    first: tuple[str, str]
    second: tuple[str, str]


@lru_cache(maxsize=4)
def looks(path: str | None) -> Looks:
    """The fixed table, and by rule each letter of ``SCRIPTS`` that Unicode confuses with a Latin letter of its case.

    Letters without case count as capitals.
    """
    first = {a: b for x, y in SHAPES.items() for a, b in zip(x, y, strict=True)}
    data = confusables(path)
    latin = defaultdict(list)
    for c in map(chr, [*range(65, 91), *range(97, 123)]):
        latin[data.get(c, c)].append(c)
    for c, prototype in data.items():
        if c in first or c in SEEN_APART or unicodedata.category(c) not in ("Lu", "Ll", "Lo") or not unicodedata.name(c, "").startswith(SCRIPTS):
            continue
        same = [x for x in latin.get(prototype, ()) if x.islower() == c.islower()]
        if same:
            first[c] = same[0]
    twice = [c for c in sorted(first) if first[c] in SECOND and c != "ℓ"]
    return Looks(("".join(sorted(first)), "".join(first[c] for c in sorted(first))), ("".join(twice), "".join(SECOND[first[c]] for c in twice)))
