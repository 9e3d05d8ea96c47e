"""Column functions: names, codes, tokens, designators and hashes. All are built-in expressions."""

from __future__ import annotations

import json
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The fields of an address in their canonical order.
FIELDS = ["JALAN", "NOMOR", "RT", "RW", "KELURAHAN", "KECAMATAN", "KOTA_KABUPATEN", "PROVINSI", "KODEPOS", "DETAIL_LOKASI"]
ADMIN_FIELDS = ["KELURAHAN", "KECAMATAN", "KOTA_KABUPATEN", "PROVINSI", "KODEPOS"]
CRITICAL_FIELDS = ["JALAN", "NOMOR", *ADMIN_FIELDS]
LABELS = ["O", *[f"{p}-{f}" for f in FIELDS for p in "BI"]]
#: Leading words that tell the kind of an administrative name.
KINDS = {
    "kelurahan": "village", "kel": "village", "desa": "village", "ds": "village",
    "kecamatan": "district", "kec": "district",
    "kabupaten": "kabupaten", "kab": "kabupaten",
    "kota": "kota",
    "provinsi": "province", "prov": "province",
}
#: Fixed values: (field, pattern, replacement), the first that matches wins.
DESIGNATORS = [
    ("JALAN", "jalan|jln|jl", "Jalan "), ("JALAN", "gang|gg", "Gang "), ("JALAN", "kampung|kp", "Kampung "),
    ("NOMOR", "nomor|no", "No. "),
    ("KELURAHAN", "kelurahan|kel", "Kelurahan "), ("KELURAHAN", "desa|ds", "Desa "),
    ("KECAMATAN", "kecamatan|kec", "Kecamatan "),
    ("KOTA_KABUPATEN", "kabupaten|kab", "Kabupaten "), ("KOTA_KABUPATEN", "kota", "Kota "),
    ("PROVINSI", "provinsi|prov", "Provinsi "),
]
TITLE_FIELDS = ["JALAN", "KELURAHAN", "KECAMATAN", "KOTA_KABUPATEN", "PROVINSI", "DETAIL_LOKASI"]


def _decompositions() -> tuple[str, str, str, dict[str, str]]:
    """What compatibility decomposition without marks makes of single characters, from Unicode's own data.

    Characters that become one letter or digit of ASCII, what they become, marks that go, and characters that become
    several characters with a letter or digit of ASCII among them.
    """
    one, plain, marks, many = [], [], [], {}
    for code in [*range(0x80, 0xD800), *range(0xE000, 0x20000)]:
        c = chr(code)
        if unicodedata.combining(c):
            marks.append(c)
            continue
        bare = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if len(bare) == 1 and bare.isascii() and bare.isalnum():
            one.append(c)
            plain.append(bare)
        elif len(bare) > 1 and any(x.isascii() and x.isalnum() for x in bare):
            many[c] = bare
    return "".join(one), "".join(plain), "".join(marks), many


_ONE, _PLAIN, _MARKS, _MANY = _decompositions()
_MANY_JSON = json.dumps(_MANY, ensure_ascii=False)


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def surface(x: Column | str) -> Column:
    """A value without outer white space; null is empty."""
    return F.trim(F.coalesce(col(x), F.lit("")))


def is_ascii(x: Column | str) -> Column:
    return col(x).rlike("^[\\x00-\\x7f]*$")


def once(x: Column | str, body) -> Column:
    """body(x) with x computed once and standing once in the plan, however often body names it."""
    return F.element_at(F.transform(F.array(col(x)), body), 1)


def chosen(choices: list[tuple[Column, Column]]) -> Column:
    """An array of the values, none of them null, whose conditions are true. array_compact() is a loop, and what is given to a loop is not compiled."""
    none = F.expr("array()")
    return F.concat(*[F.when(c, F.array(v)).otherwise(none) for c, v in choices])


def each(df: DataFrame, column: str, name: str, *others: str) -> DataFrame:
    """One row, with others, for each entry that is not null of an array column.

    A plain explode adds a filter on the array, which the optimizer moves below all steps that make it, with their
    expressions put one into the other; one on the entries stays where it is.
    """
    return df.select(*others, F.explode_outer(column).alias(name)).where(F.col(name).isNotNull())


def held(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column as a step of its own: no filter goes below it, so that the value is not computed again for each of its uses there."""
    return df.select("*", F.explode_outer(F.array(value)).alias(name))


def _folded(v: Column) -> Column:
    several = F.from_json(F.lit(_MANY_JSON), "map<string,string>")
    whole = F.when(F.translate(v, "".join(_MANY), "") != v, F.array_join(F.transform(F.split(v, ""), lambda c: F.coalesce(several[c], c)), "")).otherwise(v)
    return F.when(is_ascii(v), v).otherwise(F.translate(whole, _ONE + _MARKS, _PLAIN))


def _hierarchy_form(v: Column) -> Column:
    return F.trim(F.lower(F.regexp_replace(_folded(v), "[^0-9A-Za-z]+", " ")))


def normalize_hierarchy(x: Column | str) -> Column:
    """Names of the hierarchy: in compatibility decomposition without marks, other characters than letters and digits of ASCII one space, lower case."""
    return _hierarchy_form(F.col(x)) if isinstance(x, str) else once(x, _hierarchy_form)


def normalize_workbook(x: Column | str) -> Column:
    """Names of the workbook: as above, but a letter with a mark becomes a space."""
    return F.trim(F.regexp_replace(F.lower(col(x)), "[^0-9a-z]+", " "))


def normalize_pos(x: Column | str) -> Column:
    """Names of the postal search: white space is one space, lower case, punctuation stays."""
    return F.lower(F.trim(F.regexp_replace(col(x), "(?U)\\s+", " ")))


def clean_token(x: Column | str) -> Column:
    return F.regexp_replace(F.lower(col(x)), "[^a-z0-9]", "")


def digits(x: Column | str) -> Column:
    return F.regexp_replace(col(x), "[^0-9]", "")


def clean_postal(x: Column | str) -> Column:
    """Five digits other than 00000, after a trailing .0 is dropped; else empty."""
    v = F.regexp_replace(surface(x), "\\.0$", "")
    return F.when(v.rlike("^[0-9]{5}$") & (v != "00000"), v).otherwise("")


def village_code(x: Column | str) -> Column:
    """PP.CC.DD.VVVV of ten digits; else empty."""
    d = digits(F.coalesce(col(x), F.lit("")))
    return F.when(F.length(d) == 10, F.concat_ws(".", F.substring(d, 1, 2), F.substring(d, 3, 2), F.substring(d, 5, 2), F.substring(d, 7, 4))).otherwise("")


def region_code(x: Column | str, level: str) -> Column:
    """The dotted code of a level, or null if its syntax or length is wrong."""
    n = {"province": 2, "city": 4, "district": 6, "village": 10}[level]
    d = F.regexp_replace(surface(x), "\\.", "")
    parts = [F.substring(d, a, k) for a, k in ((1, 2), (3, 2), (5, 2), (7, 4)) if a <= n]
    return F.when(surface(x).rlike("^[0-9.]+$") & (F.length(d) == n), F.concat_ws(".", *parts))


def parent_code(x: Column | str, parts: int) -> Column:
    return F.substring_index(col(x), ".", parts)


def tokens(x: Column | str) -> Column:
    """Words, with , ; / and : as tokens of their own."""
    return F.filter(F.split(F.coalesce(col(x), F.lit("")), "(?U)\\s+|(?<=[,;/:])|(?=[,;/:])"), lambda t: t != "")


def detokenized(x: Column | str) -> Column:
    return F.regexp_replace(F.array_join(col(x), " "), " (?=[,.;:]( |$))", "")


def _first_word(x: Column) -> Column:
    """The first word of a normalized name."""
    return F.substring_index(x, " ", 1)


def _kind(n: Column) -> Column:
    kinds = F.create_map(*[F.lit(v) for pair in KINDS.items() for v in pair])
    return kinds[_first_word(n)]


def _base(n: Column) -> Column:
    return F.when(_first_word(n).isin(list(KINDS)), F.trim(F.substring(n, F.length(_first_word(n)) + 1, F.length(n)))).otherwise(n)


def name_kind(x: Column | str) -> Column:
    """The kind that a normalized name's first word tells, or null."""
    return _kind(normalize_hierarchy(x))


def name_base(x: Column | str) -> Column:
    """A normalized name without one leading designator."""
    return once(normalize_hierarchy(x), _base)


def name_parts(x: Column | str) -> Column:
    """A name's base and kind, with the name normalized once."""
    return once(normalize_hierarchy(x), parts_of)


def parts_of(n: Column) -> Column:
    """The same of a name that is normalized already."""
    return F.struct(_base(n).alias("base"), _kind(n).alias("kind"))


def clean_values(x: Column | str) -> Column:
    """Trimmed, distinct, sorted values that are not blank."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(col(x), lambda v: F.trim(v)), lambda v: v != "")))


def joined_values(x: Column | str) -> Column:
    return F.array_join(clean_values(x), ";")


def stable_id(prefix: str, *keys: Column | str) -> Column:
    """The prefix and twelve hex digits of the SHA-256 of the keys as a compact JSON array."""
    return F.concat(F.lit(prefix), F.upper(F.substring(F.sha2(F.to_json(F.array(*map(col, keys))), 256), 1, 12)))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null for b = 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def title_word(w: Column) -> Column:
    """The first letter of each run of letters upper, the others lower, as names are written."""
    letters = F.regexp_extract_all(F.lower(w), F.lit("\\p{L}+|[^\\p{L}]+"), F.lit(0))
    return F.array_join(F.transform(letters, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1 << 20))), "")


#: Words of ASCII in which only the first letter of a word is a first letter, none a numeral or a word that stays lower.
_PLAIN_WORD = r"(?:(?!(?:[ivxlcdm]+|dan|ke|dari)[.,]*(?: |\z))[a-z]+[0-9.,/()\-]*|[0-9]+[.,/()\-]*[0-9]*)"
_PLAIN_TITLE = rf"(?i)^{_PLAIN_WORD}(?: {_PLAIN_WORD})*\z"


def smart_title(x: Column | str) -> Column:
    """Title case; roman numerals upper, dan, ke and dari lower unless first. di is a numeral by its letters.

    Values that the built-in function writes the same way go to it: the loop over words takes several times as long.
    """

    def word(w: Column, i: Column) -> Column:
        core = F.regexp_replace(w, "^[.,]+|[.,]+$", "")
        return F.when(core.rlike("(?i)^[ivxlcdm]+$"), F.upper(w)).when((i > 0) & F.lower(core).isin("dan", "di", "ke", "dari"), F.lower(w)).otherwise(title_word(w))

    titled = lambda v: F.when(v.rlike(_PLAIN_TITLE), F.initcap(v)).otherwise(F.array_join(F.transform(F.split(v, " "), word), " "))
    # A column stands for itself: inside a lambda nothing is compiled.
    return titled(F.col(x)) if isinstance(x, str) else once(x, titled)


#: White space of Unicode as a plain class, which is matched much faster than (?U)\\s; and what of it is not one space already.
_OTHER_SPACE = r"\t-\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_NOT_ONE_SPACE = f"[{_OTHER_SPACE}][ {_OTHER_SPACE}]*| [ {_OTHER_SPACE}]+"


def collapse(x: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(col(x), F.lit("")), _NOT_ONE_SPACE, " "))


def designator(field: str, x: Column) -> Column:
    out = x
    for f, pattern, replacement in reversed(DESIGNATORS):
        if f == field:
            whole = f"(?i)^(?:{pattern})\\.?(?:\\s+|$)"
            out = F.when(x.rlike(whole), F.rtrim(F.regexp_replace(x, whole, replacement))).otherwise(out)
    return out


def rt_rw(field: str, x: Column) -> Column:
    pattern = f"(?i)^(?:{field}\\b\\.?\\s*)?0*([0-9]{{1,3}})$"
    return F.when(x.rlike(pattern), F.concat(F.lit(field + " "), F.lpad(F.regexp_extract(x, pattern, 1), 3, "0"))).otherwise(x)


def postcode(x: Column) -> Column:
    return F.regexp_replace(x, "^([0-9]{2})\\s+([0-9]{3})$", "$1$2")


def canonical_hash(*columns: Column | str) -> Column:
    """SHA-256 of the columns as a compact JSON object with sorted keys, nulls kept."""
    return F.sha2(F.to_json(F.struct(*sorted(columns, key=str)), {"ignoreNullFields": "false"}), 256)
