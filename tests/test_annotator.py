"""The automatic annotator and the matching ratio."""

import difflib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapal.functions import matching
from tapal.functions import scalar as S
from tapal.operators import annotation as N
from tapal.operators import evaluation as E


def test_ratio_equals_matching_blocks():
    rng = random.Random(1)
    pairs = [("", ""), ("a", ""), ("", "a"), ("abcabba", "cbabac"), ("é日😀x", "日😀é"), ("aaaa", "aaa")]
    pairs += [("".join(rng.choices("abc", k=rng.randrange(25))), "".join(rng.choices("abcd", k=rng.randrange(25)))) for _ in range(800)]
    pairs += [("".join(rng.choices("ab", k=300)), "".join(rng.choices("abx", k=250))) for _ in range(3)]
    a, b = [x for x, _ in pairs], [y for _, y in pairs]
    expected = [difflib.SequenceMatcher(None, x, y, autojunk=False).ratio() if x and y else 0 for x, y in pairs]
    assert matching.ratios(a, b) == pytest.approx(expected)
    bound = matching.letter_bound(a, b)
    assert (bound >= np.array(expected) - 1e-12).all()
    assert matching.ratios(a, b, 0.62) == pytest.approx([e if m >= 0.62 else 0 for e, m in zip(expected, bound)])


def test_ratio_in_small_tables(monkeypatch):
    monkeypatch.setattr(matching, "CELLS", 8)
    assert matching.ratios(["abcdef", "xaby", "q"], ["abdef", "ab", "q"]) == pytest.approx([10 / 11, 4 / 6, 1.0])


def test_ratio_columns(spark):
    df = spark.createDataFrame([("ab", "abc", ["ab", None], ["ab", "x"]), (None, "a", None, None), ("", "", [], [])], "a string, b string, x array<string>, y array<string>")
    assert [r[0] for r in df.select(matching.matching_ratio("a", "b")).collect()] == [pytest.approx(0.8), None, 1.0]
    assert [r[0] for r in df.select(matching.matching_ratios(0.5)("x", "y")).collect()] == [[1.0, 0.0], [], []]


def annotate(spark, rows):
    df = spark.createDataFrame(rows, "text string, district string, city string").withColumn("tokens", S.tokens("text"))
    return N.annotated(df, "tokens", "district", "city").withColumn("bio", E.is_bio(F.col("labels"))).collect()


def test_annotator_vectors(spark):
    rows = [
        ("Jl. Gunung Sentul, Kec Ciemas, Kabupaten Sukabumi", "CIEMAS", "KABUPATEN SUKABUMI"),
        ("KP. CIHAURSEAH, KCMTN JAMPANGKULON, KB SUKABUMI", "JAMPANGKULON", "KABUPATEN SUKABUMI"),
        ("Kp. Pajaten Rt 01 Rw. 02, Kecamatan Kertasari, Kabupaten Bandung", "KERTASARI", "KABUPATEN BANDUNG"),
        ("Jl. Mawar rt.03/rw.07, Kec Foo, Kab Bar", "FOO", "KABUPATEN BAR"),
        ("JL. CIPANAS NO.61 RT .02 RW..04, KEC CISARUA, KAB BANDUNG BARAT", "CISARUA", "KABUPATEN BANDUNG BARAT"),
        ("jl.rayaselatan,kecbantarujeg,kbmajalengka", "BANTARUJEG", "KABUPATEN MAJALENGKA"),
        ("dusun passian, kc. tambaksari, kb ciams", "TAMBAKSARI", "KABUPATEN CIAMIS"),
        ("Jl.CimangguPermai1KecTanahSarealKtBogor, Kecamatan Tanah Sareal, Kta Bogor", "TANAH SAREAL", "KOTA BOGOR"),
        ("Jl Mawar rt.03a, Kec. Entah, Kab. Mana, jawa barat 40123, ;x", "FOO", "BAR"),
        ("", "A", "B"), (None, None, None),
    ]
    got = annotate(spark, rows)
    at = [dict(zip(r.tokens or [], r.labels)) for r in got]
    assert got[0].labels == ["B-JALAN", "I-JALAN", "I-JALAN", "O", "B-KECAMATAN", "I-KECAMATAN", "O", "B-KOTA_KABUPATEN", "I-KOTA_KABUPATEN"]
    assert got[1].labels[:2] == ["B-JALAN", "I-JALAN"]
    assert (at[2]["Rt"], at[2]["01"], at[2]["Rw."], at[2]["02"]) == ("B-RT", "I-RT", "B-RW", "I-RW")
    assert (at[3]["rt.03"], at[3]["rw.07"]) == ("B-RT", "B-RW") and (at[4]["RT"], at[4][".02"]) == ("B-RT", "I-RT")
    assert (at[5]["kecbantarujeg"], at[5]["kbmajalengka"]) == ("B-KECAMATAN", "B-KOTA_KABUPATEN")
    assert at[6]["tambaksari"] == "I-KECAMATAN" and at[6]["ciams"] == "I-KOTA_KABUPATEN"
    assert any("needs_review" in f for f in got[7].flags) and all(r.flags == [] for r in got[:7])
    assert got[8].flags == ["rt_token_has_trailing_noise:'rt.03a'", "unmatched_kecamatan_designator:'Kec.Entah'", "unmatched_kabupaten_designator:'Kab.Mana'"]
    assert got[8].labels[-6:] == ["B-PROVINSI", "I-PROVINSI", "B-KODEPOS", "O", "O", "B-DETAIL_LOKASI"]
    assert got[9].labels == got[10].labels == [] and all(r.bio for r in got)


def plain_labels(tokens, district, city):
    """The same told token by token."""
    clean = lambda s: re.sub("[^a-z0-9]", "", s.lower())
    after = lambda s, words: max((s[len(w) :] for w in words if s.startswith(w) and len(s) > len(w)), key=lambda r: -len(r), default=None)
    same = lambda x, y: difflib.SequenceMatcher(None, x, y, autojunk=False).ratio() if x and y else 0
    d, c = clean(district), after(clean(city), ["kabupaten", "kota"]) or clean(city)
    labels, street, at = ["O"] * len(tokens), False, 0
    while at < len(tokens):
        end = at
        while end < len(tokens) and tokens[end] not in ",;-":
            end += 1
        free = []
        for i in range(at, end):
            low, after_low, before = tokens[i].lower(), tokens[i + 1].lower() if i + 1 < end else "", tokens[i - 1].lower() if i > at else ""
            for f, (whole, marker) in N.NUMBERED.items():
                if re.search(whole, low):
                    labels[i] = f"B-{f}"
                elif re.search(marker, low) and re.search(N.NUMBER, after_low):
                    labels[i] = f"B-{f}"
                elif re.search(marker, before) and re.search(N.NUMBER, low):
                    labels[i] = f"I-{f}"
            if labels[i] == "O" and re.search(N.POSTAL, low):
                labels[i] = "B-KODEPOS"
            if labels[i] == "O":
                free.append(i)
        text = clean("".join(tokens[i] for i in free))
        if free:
            x, y = after(text, N.DISTRICT_OPENERS), after(text, N.CITY_OPENERS)
            rx, ry = same(x or text, d), same(y or text, c)
            if text == "jabar" or "jawabarat" in text:
                field = "PROVINSI"
            elif rx >= 0.62 and rx >= ry:
                field = "KECAMATAN"
            elif ry >= 0.62:
                field = "KOTA_KABUPATEN"
            elif x:
                field = "KECAMATAN"
            elif y:
                field = "KOTA_KABUPATEN"
            else:
                field, street = "DETAIL_LOKASI" if street else "JALAN", True
            for i in free:
                labels[i] = ("I-" if i - 1 in free else "B-") + field
        at = end + 1
    return labels


def test_annotator_against_token_by_token(spark):
    rng = random.Random(7)
    words = ["Jl.", "Kec", "kec.", "Kab", "kota", "kb", "Ciemas", "ciemes", "Sukabumi", "sukabmi", "RT", "rt.", "01", ".02", "RW05", "no", "No.7b", "nomer", "12a", "40111", "40111x", ",", ",", ";", "-", "Jabar", "jawa", "barat", "Masjid", "...", "kecciemas", "kabsukabumi", "rw..3"]
    rows = [([rng.choice(words) for _ in range(rng.randrange(1, 18))], rng.choice(["CIEMAS", "Kertasari", ""]), rng.choice(["KABUPATEN SUKABUMI", "Kota Bandung", "kota"])) for _ in range(400)]
    df = spark.createDataFrame(rows, "tokens array<string>, district string, city string")
    got = N.annotated(df, "tokens", "district", "city").collect()
    for r in got:
        assert r.labels == plain_labels(r.tokens, r.district, r.city), (r.tokens, r.district, r.city)
