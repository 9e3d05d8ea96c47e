"""Steps that cost each row much for nothing, and that their results stay the same."""

import random
import re

from pyspark.sql import functions as F

from tapal.functions import scalar as S
from tapal.operators import pii as P
from tapal.plans import registry

SF = "/root/testdata/sf0.001"


def title(text):
    """The rule of smart_title for texts of ASCII, word by word."""
    out = []
    for i, w in enumerate(text.split(" ")):
        core = w.strip(".,")
        if re.fullmatch("[ivxlcdm]+", core, re.I):
            out.append(w.upper())
        elif i > 0 and core.lower() in ("dan", "di", "ke", "dari"):
            out.append(w.lower())
        else:
            out.append(re.sub("[a-z]+", lambda m: m[0].capitalize(), w.lower()))
    return " ".join(out)


def test_titles_by_either_way(spark):
    rng = random.Random(5)
    words = ["ii", "Iv", "dan", "Ke", "DI", "jalan", "MAWAR", "W12", "12a", "a12b", "st.maria", "ii.", "ii)", "ke,", ",ke", "a-b", "o'neil", "abc)", "1/2", "a/b", "3.dan", "a1-2", "civic", ""]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(5))) for _ in range(2000)] + ["".join(rng.choice("aivdnkeDK .,-1'/") for _ in range(rng.randrange(8))) for _ in range(6000)]
    df = spark.createDataFrame([(x,) for x in texts], "v string")
    fast = df.where(F.col("v").rlike(S._PLAIN_TITLE)).count()
    assert 500 < fast < len(texts) - 500
    assert [r.t for r in df.select(S.smart_title("v").alias("t")).collect()] == [title(x) for x in texts]


def test_all_white_space_is_collapsed(spark):
    chars = [chr(c) for c in [*range(1, 0xD800), *range(0xE000, 0x10000)]]
    df = spark.createDataFrame([(f"{c}a{c}{c}b {c}c{c} d{c}",) for c in chars], "v string")
    assert df.where(S.collapse("v") != F.trim(F.regexp_replace("v", "(?U)\\s+", " "))).count() == 0
    plan = df.select(S.collapse("v"))._jdf.queryExecution().optimizedPlan().toString()
    assert "(?U)" not in plan


def test_rules_only_where_they_can_change_a_field(spark):
    plan = registry.QUERIES["normalization_changes_by_rule"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    counts = {rule: max(line.count(rule) for line in plan.splitlines()) for rule in ("unicode_whitespace_v1", "designator_dictionary_v1", "rt_rw_three_digit_v1", "postcode_spacing_v1", "component_capitalization_v1")}
    assert list(counts.values()) == [5, 3, 1, 1, 2]


def test_phones_are_searched_only_where_they_can_start(spark):
    """Look-behinds stand behind what a match starts with, so that they are not tried at every place; marks are taken out without translation."""
    for name in ("pii_entities", "pii_views"):
        plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert r"(?iU)(?=\+|62|08)(?<!" in plan and r"(?iU)(?<!" not in plan and r"(?iU)(\b" not in plan, name
        assert plan.count("translate(") <= 1, name


def test_odd_texts_are_redacted_as_before(spark):
    """Marks and broken characters of the text itself, labels in other cases, identifiers, landlines without numbers of mobiles."""
    cases = {
        "Penerima: Budi, hp 0812-3456-7890": ("Penerima: [NAME_REDACTED], hp [PHONE_REDACTED]", "", [("RECIPIENT_NAME", 10, 14), ("PHONE", 19, 33)]),
        "NPSN: 08123456789, x 08123456789": ("NPSN: 08123456789, x [PHONE_REDACTED]", "NPSN: 08123456789, x", [("PHONE", 21, 32)]),
        "TELP. (021) 7777777 é😀": ("TELP. [PHONE_REDACTED] é😀", "é😀", [("PHONE", 6, 19)]),
        "tel 08123456789 tel 08123456789": ("tel [PHONE_REDACTED] tel [PHONE_REDACTED]", "", [("PHONE", 4, 15), ("PHONE", 20, 31)]),
        f"a{P.P0}b{P.N1}c": ("a�b�c", "a�b�c", []),
        "x+62 8 1234567890": ("x+62 8 1234567890", "x+62 8 1234567890", []),
        "x +62 8 1234567890": ("x [PHONE_REDACTED]", "x", [("PHONE", 2, 18)]),
        None: ("", "", []),
    }
    rows = P.redact(spark.createDataFrame([(x,) for x in cases], "text string")).collect()
    assert {r.text: (r.redacted_text, r.address_text, [tuple(e)[:3] for e in r.pii_entities]) for r in rows} == cases
    broken = spark.sql("select cast(concat(x'ff', cast('a ' as binary), x'c3') as string) as text")
    assert P.redact(broken).first().redacted_text == "�a �"
