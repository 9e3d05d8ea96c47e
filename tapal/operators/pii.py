"""Personal data in address texts: phone numbers and recipients' names, found, redacted and taken out.

Matches are wrapped in marks that no text has, in place; redaction, removal, and the places of what was found all come
from the marked text, so that built-in regular expressions do for all of it.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tapal.functions import scalar as S

# Fixed values, as words in the order of their source; a space stands for an optional full stop and white space.
PHONE_LABELS = ["tel", "telp", "telepon", "phone", "hp", "wa", "whatsapp", "no hp"]
LANDLINE_LABELS = ["tel", "telp", "telepon", "phone"]
IDENTIFIER_LABELS = ["nik", "npsn", "resi", "order", "pesanan", "invoice", "rekening", "kode"]
NAME_LABELS = [r"nama\s+penerima", "penerima", r"a\.?\s*n\.?", r"atas\s+nama"]
NAME_TITLES = ["bapak", "bpk", "ibu", "bu", "sdr", "sdri", "pak"]
#: What an address starts with after a name: beginnings of words, and whole words.
STREET_STARTS = ["jl", "jalan", "jln", "gg", "gang", "kp", "kampung", "dusun", "kel", "kec", "kab"]
STREET_WORDS = ["rt", "rw", "blok", "desa", "kota"]
PHONE, NAME = "[PHONE_REDACTED]", "[NAME_REDACTED]"
DETECTED, NAMES_FAILED = "PII_DETECTED", "RECIPIENT_NAME_EXTRACTION_FAILED"

#: Marks about a phone and about a name: code points that are no characters.
P0, P1, N0, N1 = "﷐", "﷑", "﷒", "﷓"
_FLAGS = "(?iU)"


def _words(words: list[str]) -> str:
    return "|".join(w.replace(" ", r"\.?\s*") for w in words)


_GAP = r"[\s().\-]*"
_PHONE_LABEL = rf"\b(?:{_words(PHONE_LABELS)})\b\s*[:.=\-]?\s*"
_MOBILE = rf"(?:\+?62{_GAP}8|08){_GAP}[1-9](?:{_GAP}[0-9]){{7,10}}(?!\w)"
_VETO = rf"(?<!\b(?:{_words(IDENTIFIER_LABELS)})\s{{0,20}}[:#.=\-]?\s{{0,20}})"
_LANDLINE = r"\(?0[2-79](?:[0-9]\)?(?:[\s.\-]*[0-9]){6,9}|[0-9]{2}\)?(?:[\s.\-]*[0-9]){5,9}|[0-9]{3}\)?(?:[\s.\-]*[0-9]){5,8})(?!\w)"
_LINE_LABEL = rf"\b(?:{_words(LANDLINE_LABELS)})\b\s*[:.=\-]?\s*"
_NAME_LABEL = rf"(?<!\w)(?:{'|'.join(NAME_LABELS)})\s*[:=\-]\s*"
#: White space of a name, in which a phone counts as blank, and where a name ends.
_BLANK = rf"(?:\s|{P0}[^{P1}]*{P1})"
_STREET = rf"(?:(?:{'|'.join(STREET_STARTS)})|(?:{'|'.join(STREET_WORDS)})\b|no\.?\s*[0-9])"
_STOP = rf"(?={_BLANK}*(?:[,;\n\r]|$)|{_BLANK}+{_STREET})"
_TITLE = rf"(?:{'|'.join(NAME_TITLES)})\.*"
_WORD = r"\p{L}+(?:[-']\p{L}+)*\.*"
_NAME = rf"(?!{_TITLE}{_STOP})(?:{_TITLE}{_BLANK}+)?{_WORD}(?:{_BLANK}+{_WORD}){{0,4}}?{_STOP}"


# What a match starts with stands before its look-behinds, which are dear and would else be tried at every place.
_AT_LABEL, _AT_MOBILE, _AT_LINE = "(?=[tphwn])", r"(?=\+|62|08)", "(?=[tp])"


def _without_marks(text: Column) -> Column:
    """Translation is dear; a valid text without marks stays as it is."""
    plain = F.is_valid_utf8(text) & ~(text.contains(P0) | text.contains(P1) | text.contains(N0) | text.contains(N1))
    return F.when(plain, text).otherwise(F.translate(text, P0 + P1 + N0 + N1, "�" * 4))


def _mobiles_marked(text: Column) -> Column:
    """Mobile numbers, labelled or without an identifier's label before them. Most texts have nothing that a number starts with."""
    out = F.regexp_replace(text, rf"{_FLAGS}{_AT_LABEL}({_PHONE_LABEL})(?<![\w+])({_MOBILE})", f"$1{P0}$2{P1}")
    out = F.regexp_replace(out, rf"{_FLAGS}{_AT_MOBILE}(?<![\w+{P0}]){_VETO}({_MOBILE})(?!{P1})", f"{P0}$1{P1}")
    return F.when(text.contains("08") | text.contains("62"), out).otherwise(text)


def _landlines_marked(text: Column) -> Column:
    """Landlines directly after a label."""
    return F.when(text.rlike("(?i)tel|phone"), F.regexp_replace(text, rf"{_FLAGS}{_AT_LINE}({_LINE_LABEL})({_LANDLINE})", f"$1{P0}$2{P1}")).otherwise(text)


def _names_marked(text: Column) -> Column:
    return F.when(text.rlike(r"(?i)(?:penerima|nama|n\.?)\s*[:=\-]"), F.regexp_replace(text, rf"{_FLAGS}({_NAME_LABEL}{_BLANK}*)({_NAME})", f"$1{N0}$2{N1}")).otherwise(text)


def named_by(detector: Callable[[str], list[tuple[int, int]]]) -> Callable[[Column], Column]:
    """A function of the marked text like the built-in one, from a detector of (start, end) of names; where it fails the result is null."""

    @F.pandas_udf(StringType())
    def marked(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> str | None:
            try:
                out, last = [], 0
                for a, b in sorted(detector(text)):
                    if a >= last:
                        out += [text[last:a], N0, text[a:b], N1]
                        last = b
                return "".join([*out, text[last:]])
            except Exception:
                return None

        return texts.map(one)

    return marked


def redact(df: DataFrame, column: str = "text", names: Callable[[Column], Column] | None = None) -> DataFrame:
    """df with redacted_text, address_text, pii_entities, pii_codes and pii_warnings.

    redacted_text has placeholders for mobile numbers, labelled landlines and names after a recipient marker;
    address_text has them taken out with their labels. pii_entities are (type, start, end, redacted_value) by place in
    the text, in code points. A detector of names that fails (see named_by) leaves names in and gives a warning. A null
    text counts as empty; a mark in a text becomes U+FFFD.
    """
    return shown(cleaned(marked(df, column, names))).drop("_marked", "_named")


def marked(df: DataFrame, column: str = "text", names: Callable[[Column], Column] | None = None) -> DataFrame:
    """df with _marked, the text with what was found in marks, and _named, if the detector of names did not fail.

    All that redact() gives comes from these two, so that rows which travel need no more.
    """
    # Each step's text stands once in the plan: planning documents runs out of memory where steps repeat it.
    text = S.once(S.once(S.once(F.coalesce(F.col(column), F.lit("")), _without_marks), _mobiles_marked), _landlines_marked)
    out = df.withColumn("_phones", text)
    out = out.withColumn("_names", (names or _names_marked)(F.col("_phones"))).withColumn("_marked", F.coalesce("_names", "_phones"))
    return out.withColumn("_named", F.col("_names").isNotNull()).drop("_phones", "_names")


def _found() -> Column:
    return F.col("_marked").rlike(f"[{P0}{N0}]")


def cleaned(df: DataFrame) -> DataFrame:
    """df with address_text, from _marked."""
    gone = F.regexp_replace(F.regexp_replace("_marked", rf"{_FLAGS}(?=[pna]){_NAME_LABEL}{_BLANK}*{N0}[^{N1}]*{N1}", " "), rf"{_FLAGS}(?=[tphwn{P0}])(?:{_PHONE_LABEL})?{P0}[^{P1}]*{P1}", " ")
    plain = S.collapse(F.when(_found(), gone).otherwise(F.col("_marked")))
    plain = F.trim(F.regexp_replace(plain, r"^[,;:\-]+\s*|\s*[,;:\-]+$", ""))
    return df.withColumn("address_text", F.regexp_replace(plain, r"(?:,\s*){2,}", ", "))


def shown(df: DataFrame) -> DataFrame:
    """df with redacted_text, pii_entities, pii_codes and pii_warnings, from _marked and _named."""
    found = _found()
    redacted = F.regexp_replace(F.regexp_replace("_marked", f"{N0}[^{N1}]*{N1}", NAME.replace("[", "\\[").replace("]", "\\]")), f"{P0}[^{P1}]*{P1}", PHONE.replace("[", "\\[").replace("]", "\\]"))
    out = df.withColumn("redacted_text", F.when(found, redacted).otherwise(F.col("_marked")))
    out = out.withColumn("pii_entities", F.when(found, _entities()).otherwise(F.array().cast("array<struct<type:string,start:int,end:int,redacted_value:string>>")))
    out = out.withColumn("pii_codes", F.when(found, F.array(F.lit(DETECTED))).otherwise(F.array().cast("array<string>")))
    return out.withColumn("pii_warnings", F.when(~F.col("_named"), F.array(F.lit(NAMES_FAILED))).otherwise(F.array().cast("array<string>")))


def _unmarked(x: Column) -> Column:
    for mark in (P0, P1, N0, N1):
        x = F.replace(x, F.lit(mark))
    return x


def _entities() -> Column:
    """The wrapped parts of the marked text with their places; a phone inside a name is part of it."""
    pieces = F.flatten(F.transform(F.split("_marked", f"(?={N0})|(?<={N1})"), lambda s: F.when(s.startswith(N0), F.array(s)).otherwise(F.split(s, f"(?={P0})|(?<={P1})"))))
    part = F.transform(pieces, lambda s: F.struct(F.substring(s, 1, 1).alias("k"), F.length(_unmarked(s)).alias("n")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<type:string,start:int,end:int,redacted_value:string>>").alias("out"))

    def add(acc: Column, p: Column) -> Column:
        end = acc["at"] + p["n"]
        entity = lambda kind, shown: F.struct(F.lit(kind).alias("type"), acc["at"].alias("start"), end.alias("end"), F.lit(shown).alias("redacted_value"))
        more = F.when(p["k"] == P0, F.array(entity("PHONE", PHONE))).when(p["k"] == N0, F.array(entity("RECIPIENT_NAME", NAME))).otherwise(F.array().cast("array<struct<type:string,start:int,end:int,redacted_value:string>>"))
        return F.struct(end.alias("at"), F.concat(acc["out"], more).alias("out"))

    return F.aggregate(part, start, add, lambda acc: acc["out"])
