"""Arrow functions for what built-in expressions cannot say: compatibility forms and the sequential tagger."""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from tapal.functions.scalar import FIELDS

#: Words that open a span, by field in order of precedence, and the most tokens that a span takes.
OPENERS = {
    "JALAN": ("jalan", "jaln", "jln", "jl", "gang", "gg", "kampung", "kp", "dusun", "dsn"),
    "KELURAHAN": ("kelurahan", "kel", "desa", "ds"),
    "KECAMATAN": ("kecamatan", "kecamatn", "kecamtan", "kecmatan", "kecmatn", "kmctn", "kcmtn", "kec", "kc"),
    "KOTA_KABUPATEN": ("kabupaten", "kabupatan", "kabupatn", "kbupatn", "kabpatn", "kab", "kb", "kota", "kta", "kt"),
    "PROVINSI": ("provinsi", "prov"),
}
MOST = {"JALAN": 5, "KELURAHAN": 4, "KECAMATAN": 4, "KOTA_KABUPATEN": 4, "PROVINSI": 3}
PROVINCE_WORDS = {"jawabarat", "jabar", "dkijakarta"}
PROVINCE_PAIRS = {("jawa", "barat"), ("jawa", "brat"), ("dki", "jakarta")}
BREAKS = {",", ";", "-"}
#: (field, marker with number, marker alone): the numbered fields of the first pass. RT and RW take two full stops, NOMOR one.
NUMBERED = [(f, re.compile(rf"{m}\.{{0,{dots}}}0*\d+[a-z]?"), re.compile(rf"{m}\.{{0,{dots}}}")) for f, m, dots in (("RT", "rt", 2), ("RW", "rw", 2), ("NOMOR", "(?:no|nomor|nomer)", 1))]
NUMBER = re.compile(r"\.{0,2}\d+[a-z]?")


def fold(text: str) -> str:
    """Compatibility decomposition without marks, in caseless form, runs of other characters one space."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return re.sub(r"[^0-9A-Za-z]+", " ", plain).casefold().strip()


@F.pandas_udf(StringType())
def compose(x: pd.Series) -> pd.Series:
    """Compatibility composition with white space collapsed."""
    return x.map(lambda v: None if v is None else " ".join(unicodedata.normalize("NFKC", v).split()))


@F.pandas_udf(StringType())
def compose_fields(x: pd.Series) -> pd.Series:
    """The same for each value of an array in JSON; a null, for rows that need none, stays null."""
    return x.map(lambda row: None if row is None else composed(json.loads(row)))


def composed(values: list[str | None]) -> str:
    return json.dumps([None if v is None else " ".join(unicodedata.normalize("NFKC", v).split()) for v in values], ensure_ascii=False)


@lru_cache(1 << 16)
def opener(token: str) -> str | None:
    word = re.sub(r"[^a-z0-9]", "", token.lower())
    return next((f for f, markers in OPENERS.items() if any(word.startswith(m) for m in markers)), None)


@lru_cache(1 << 16)
def looks(token: str) -> tuple[str, tuple[tuple[str, bool], ...], bool, bool]:
    """A token's letters and digits in lower case, the numbered fields it can open (and whether alone), if it is a postal code, and if a number."""
    low = token.lower()
    opens = tuple((field, bool(glued.fullmatch(low))) for field, glued, alone in NUMBERED if glued.fullmatch(low) or alone.fullmatch(low))
    return re.sub(r"[^a-z0-9]", "", low), opens, re.fullmatch(r"\d{5}", low) is not None, NUMBER.fullmatch(low) is not None


def tag(tokens: list[str]) -> list[str]:
    """BIO labels of an address's tokens, in three passes over what is still free."""
    n = len(tokens)
    seen = [looks(t) for t in tokens]
    words = [x[0] for x in seen]
    labels, taken = ["O"] * n, [False] * n

    def mark(field: str, at: int, size: int) -> None:
        for k in range(at, at + size):
            labels[k], taken[k] = ("B-" if k == at else "I-") + field, True

    for i in range(n):
        if taken[i]:
            continue
        for field, whole in seen[i][1]:
            if whole:
                mark(field, i, 1)
            elif i + 1 < n and seen[i + 1][3]:
                mark(field, i, 2)
            else:
                continue
            break
        else:
            if seen[i][2]:
                mark("KODEPOS", i, 1)
    for i in range(n):
        if taken[i] or i and not taken[i - 1] and opener(tokens[i - 1]) == "PROVINSI":
            continue
        if words[i] in PROVINCE_WORDS:
            mark("PROVINSI", i, 1)
        elif i + 1 < n and not taken[i + 1] and (words[i], words[i + 1]) in PROVINCE_PAIRS:
            mark("PROVINSI", i, 2)
    spans: list[list] = []
    current = None
    for i in range(n):
        if taken[i] or tokens[i] in BREAKS:
            current = None
            continue
        field = opener(tokens[i])
        if field or current is None or current[0] and i - current[1] >= MOST[current[0]]:
            current = [field, i, i + 1]
            spans.append(current)
        current[2] = i + 1
    if spans and not any(s[0] == "JALAN" for s in spans):
        free = next((s for s in spans if s[0] is None), None)
        if free:
            free[0] = "JALAN"
    for field, a, b in spans:
        if field:
            mark(field, a, b - a)
    return labels


@F.pandas_udf(ArrayType(StringType()))
def tag_tokens(tokens: pd.Series) -> pd.Series:
    return tokens.map(lambda x: None if x is None else tag(list(x)))


#: What scalar.tokens() takes out of a text: white space of Unicode, and four marks as tokens of their own.
_SPACES = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
TOKEN = re.compile(rf"[,;/:]|[^,;/:{_SPACES}]+")
_BEGIN = {f"B-{f}": (k, f"I-{f}") for k, f in enumerate(FIELDS)}


def first_spans(tokens: list[str], labels: list[str]) -> list[str | None]:
    """The first span of each field, in canonical order."""
    out: list[str | None] = [None] * len(FIELDS)
    for i, label in enumerate(labels):
        k, inside = _BEGIN.get(label, (0, None))
        if inside and out[k] is None:
            end = i + 1
            while end < len(labels) and labels[end] == inside:
                end += 1
            out[k] = " ".join(tokens[i:end])
    return out


@F.arrow_udf(StructType([StructField(f, StringType()) for f in (*FIELDS, "composed")]))
def tag_fields(texts: pa.Array) -> pa.Array:
    """The fields of whole texts, and, where they go beyond ASCII, their compatibility forms as an array in JSON."""
    rows = []
    for text in texts.to_pylist():
        tokens = TOKEN.findall(text or "")
        rows.append(first_spans(tokens, tag(tokens)))
    forms = [composed(row) if not "".join(filter(None, row)).isascii() else None for row in rows]
    return pa.StructArray.from_arrays([*(pa.array(x, pa.string()) for x in zip(*rows)), pa.array(forms, pa.string())] if rows else [pa.array([], pa.string())] * (len(FIELDS) + 1), [*FIELDS, "composed"])
