"""Labelled examples made from a hierarchy: targeted patterns in balance, noisy variants in eight orders, and tasks with known defects.

Patterns and orders are data; one expression reads them for all rows. Every choice hangs on an MD5 hash of seed, purpose
and id, so it is the same on any cluster and in any SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapal.functions import scalar as S
from tapal.operators.ranking import numbered

STREETS = ["Mawar", "Melati", "Kenanga", "Karya Bakti", "Tunas Baru", "Pahlawan", "Bukit Asri", "Sejahtera"]
PLACES = ["dekat Masjid Al-Ikhlas", "belakang Pasar Baru", "sebelah SDN 1", "depan Kantor Desa", "samping Puskesmas"]
#: The patterns, each a list of (what stands before, where the value comes from, field), a bare string being
#: a separator, and the categories beside the pattern's own name. A value with ~ gets a typo, one with = loses its spaces.
PATTERNS: dict[str, tuple[list, list[str]]] = {
    "short_kampung": ([("Kp. ", "street", "JALAN"), ",", ("Kec. ", "district", "KECAMATAN"), ",", ("Kab. ", "city", "KOTA_KABUPATEN")], ["abbreviation"]),
    "short_jalan": ([("Jl. ", "street", "JALAN"), ",", ("Kecamatan ", "district", "KECAMATAN"), ",", ("Kab ", "city", "KOTA_KABUPATEN")], ["abbreviation"]),
    "bare_location": ([("", "street", "JALAN"), ",", ("Kec ", "district", "KECAMATAN"), ",", ("Kb ", "city", "KOTA_KABUPATEN")], ["abbreviation"]),
    "typo_admin": ([("Kp ", "street", "JALAN"), ",", ("Kec ", "district~", "KECAMATAN"), ",", ("Kab ", "city~", "KOTA_KABUPATEN")], ["abbreviation", "typo"]),
    "fused_admin": ([("jl.", "street", "JALAN"), ",", ("kecamatan", "district=", "KECAMATAN"), ",", ("kab", "city=", "KOTA_KABUPATEN")], ["abbreviation", "fused_token"]),
    "rt_rw": ([("Kp. ", "street", "JALAN"), ("RT ", "rt", "RT"), ("RW ", "rw", "RW"), ",", ("Kec. ", "district", "KECAMATAN"), ",", ("Kab. ", "city", "KOTA_KABUPATEN")], ["abbreviation", "rt_rw"]),
    "landmark": ([("Kp. ", "street", "JALAN"), ("", "place", "DETAIL_LOKASI"), ",", ("Kec ", "district", "KECAMATAN"), ",", ("Kab ", "city", "KOTA_KABUPATEN")], ["abbreviation", "landmark"]),
    "district_only": ([("Kp ", "street", "JALAN"), ",", ("Kec ", "district", "KECAMATAN")], ["abbreviation", "missing_city"]),
}
#: The eight orders of a noisy variant's slots.
ORDERS = [
    ["JALAN", "NOMOR", "RT_RW", "KELURAHAN", "KECAMATAN", "KOTA", "PROVINSI", "KODEPOS"],
    ["JALAN", "NOMOR", "DETAIL", "RT_RW", "LANDMARK", "KELURAHAN", "KECAMATAN", "KOTA", "KODEPOS", "PROVINSI"],
    ["LANDMARK", "JALAN", "NOMOR", "KELURAHAN", "KECAMATAN", "KOTA", "PROVINSI", "KODEPOS"],
    ["DETAIL", "JALAN", "NOMOR", "RT_RW", "KELURAHAN", "KECAMATAN", "KOTA", "KODEPOS"],
    ["JALAN", "NOMOR", "LANDMARK", "RT_RW", "KELURAHAN", "KECAMATAN", "KOTA", "PROVINSI"],
    ["RT_RW", "JALAN", "NOMOR", "KELURAHAN", "KECAMATAN", "KOTA", "PROVINSI", "KODEPOS"],
    ["JALAN", "RT_RW", "NOMOR", "DETAIL", "KELURAHAN", "KECAMATAN", "KOTA", "PROVINSI", "KODEPOS"],
    ["NOMOR", "JALAN", "LANDMARK", "KELURAHAN", "KECAMATAN", "KOTA", "KODEPOS", "PROVINSI"],
]
#: Slots before which a comma may stand, and their fields where the name differs.
COMMA_SLOTS = ["KELURAHAN", "KECAMATAN", "KOTA"]
#: The categories that a reviewer is expected to notice.
SCORED_DEFECTS = ["typo", "missing_provinsi", "missing_kodepos", "missing_rt_rw", "missing_city", "prefix_junk", "fused_admin", "fused_token", "bare_location", "district_only", "other_surface_form"]
_TOKENS = "array<struct<t:string,l:string>>"


def chosen(seed: int, purpose: str, n: int, *keys: Column | str) -> Column:
    """A number from 0 to n - 1 that hangs on seed, purpose and keys alone."""
    text = F.concat_ws("|", F.lit(str(seed)), F.lit(purpose), *[S.col(k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("long") % n


def one_of(values: list[str], place: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), place.cast("int"))


def labelled(text: Column, field: str) -> Column:
    """The words of a text with the BIO labels of a field, or O."""
    own = F.filter(F.split(text, "\\s+"), lambda w: w != "")
    return F.transform(own, lambda w, i: F.struct(w.alias("t"), (F.lit("O") if field == "O" else F.concat(F.when(i == 0, "B-").otherwise("I-"), F.lit(field))).alias("l")))


def misspelled(text: Column, seed: int, purpose: str, key: Column | str) -> Column:
    """A text of which one word of five letters or more has an inner letter dropped, or two swapped; unchanged if it has none."""
    words = F.split(text, " ")
    long = F.filter(F.transform(words, lambda w, i: F.when(F.length(w) >= 5, i)), lambda i: i.isNotNull())
    which = F.get(long, (chosen(seed, f"{purpose} word", 1 << 20, key) % F.greatest(F.size(long), F.lit(1))).cast("int"))
    word = F.get(words, which)
    at = (chosen(seed, f"{purpose} place", 1 << 20, key) % F.greatest(F.length(word) - 2, F.lit(1)) + 1).cast("int")  # of the letters from the second to the last but one
    cut = lambda a, n: F.substring(word, a, n)
    dropped = F.concat(cut(F.lit(1), at), cut(at + 2, F.length(word)))
    swapped = F.concat(cut(F.lit(1), at), cut(at + 2, F.lit(1)), cut(at + 1, F.lit(1)), cut(at + 3, F.length(word)))
    new = F.when(chosen(seed, f"{purpose} kind", 2, key) == 0, dropped).otherwise(swapped)
    return F.when(which.isNull(), text).otherwise(F.array_join(F.transform(words, lambda w, i: F.when(i == which, new).otherwise(w)), " "))


def city_words(city: Column) -> Column:
    """(marker, name) of a city's name: Kota or Kabupaten if it begins with KOTA, KAB. or KABUPATEN, else empty."""
    opens = "(?i)^(KAB\\.|KABUPATEN|KOTA)\\s+"
    word = F.upper(F.regexp_extract(city, opens, 1))
    return F.struct(F.when(word == "KOTA", "Kota").when(word != "", "Kabupaten").otherwise("").alias("marker"), F.initcap(F.regexp_replace(city, opens, "")).alias("name"))


def with_chains(ids: DataFrame, key: str, chains: DataFrame, seed: int) -> DataFrame:
    """ids with the columns of one chain each, chosen by hash; chains are numbered by village_code."""
    placed = numbered(chains, [F.col("village_code")], "_place")
    total = placed.count()
    if not total:
        raise ValueError("there are no chains")
    return ids.withColumn("_place", chosen(seed, "chain", total, key) + 1).join(placed, "_place").drop("_place")


def targeted(chains: DataFrame, n: int, seed: int, first: int = 0) -> DataFrame:
    """(id, village_code, pattern, categories, tokens, labels): n examples of the patterns, each as often as any other but for one.

    chains has village_code, district_name and city_name. Which example has which pattern is a shuffle by hash; the
    numbers in that order are dealt to the patterns in turn, which makes the quotas exact.
    """
    ids = chains.sparkSession.range(first, first + n).withColumn("_h", chosen(seed, "shuffle", 1 << 40, "id"))
    turn = numbered(ids, [F.col("_h"), F.col("id")], "_turn").withColumn("pattern", one_of(list(PATTERNS), (F.col("_turn") - 1) % len(PATTERNS)))
    df = with_chains(turn.drop("_h", "_turn"), "id", chains, seed)
    district, city = F.initcap("district_name"), city_words(F.col("city_name"))["name"]
    sources = {"street": one_of(STREETS, chosen(seed, "street", len(STREETS), "id")), "district": district, "city": city, "district~": misspelled(district, seed, "district", "id"), "city~": misspelled(city, seed, "city", "id"), "district=": F.replace(district, F.lit(" "), F.lit("")), "city=": F.replace(city, F.lit(" "), F.lit("")),
               "rt": F.lpad((chosen(seed, "rt", 15, "id") + 1).cast("string"), 2, "0"), "rw": F.lpad((chosen(seed, "rw", 15, "id") + 1).cast("string"), 2, "0"), "place": one_of(PLACES, chosen(seed, "place", len(PLACES), "id"))}
    rendered, names = F, F
    for pattern, (parts, categories) in PATTERNS.items():
        tokens = F.concat(*[labelled(F.lit(x), "O") if isinstance(x, str) else labelled(F.concat(F.lit(x[0]), sources[x[1]]), x[2]) for x in parts])
        rendered, names = rendered.when(F.col("pattern") == pattern, tokens), names.when(F.col("pattern") == pattern, F.array(*map(F.lit, ["sparse_address", pattern, *categories])))
    case = one_of(["", "lower", "upper"], chosen(seed, "case", 3, "id"))
    df = df.withColumn("_x", rendered).withColumn("_case", case)
    cased = F.transform("_x", lambda x: F.when(F.col("_case") == "lower", F.lower(x["t"])).when(F.col("_case") == "upper", F.upper(x["t"])).otherwise(x["t"]))
    every = F.array_sort(F.array_distinct(F.concat(names, F.when(F.col("_case") != "", F.array(F.concat(F.lit("case_"), "_case"))).otherwise(F.array().cast("array<string>")))))
    return df.select(F.format_string("TGT-%07d", F.col("id")).alias("id"), "village_code", "pattern", every.alias("categories"), cased.alias("tokens"), F.transform("_x", lambda x: x["l"]).alias("labels"))


#: What stands near an address: directions, and kinds of places with their names; a kind without a word is in the name.
DIRECTIONS = ["depan", "belakang", "dekat", "samping", "seberang"]
LANDMARKS = [("Masjid", ["Al-Ikhlas", "An-Nur", "Baiturrahman"]), ("Gereja", ["Santo Yusuf", "Immanuel"]), ("", ["SDN 1", "Kantor Pos", "Puskesmas"]), ("Pasar", ["Baru", "Minggu"]), ("Taman", ["Kota", "Lansia"])]
#: Texts of a place inside a building or an estate; {name}, {letter}, {floor} and {unit} are chosen.
DETAILS = ["Blok {letter}{unit}", "Apartemen {name} Tower {letter} Lantai {floor} Unit {unit}", "Perumahan {name} Blok {letter}{unit}", "Komplek {name} Blok {letter} No. {unit}"]
ESTATES = ["Griya Asri", "Bumi Indah", "Sentra Timur", "Puri Cipageran"]


def landmark(seed: int, key: str) -> Column:
    """A direction, a kind of place and one of its names."""
    kind = chosen(seed, "landmark kind", len(LANDMARKS), key)
    names = F
    for i, (word, each) in enumerate(LANDMARKS):
        names = names.when(kind == i, F.concat(F.lit(f"{word} " if word else ""), one_of(each, chosen(seed, "landmark name", len(each), key))))
    return F.concat_ws(" ", one_of(DIRECTIONS, chosen(seed, "landmark direction", len(DIRECTIONS), key)), names)


def detail(seed: int, key: str) -> Column:
    """One of DETAILS with its places filled."""
    out = one_of(DETAILS, chosen(seed, "detail", len(DETAILS), key))
    values = {"name": one_of(ESTATES, chosen(seed, "detail name", len(ESTATES), key)), "letter": one_of(list("ABCDEFGH"), chosen(seed, "detail letter", 8, key)), "floor": (chosen(seed, "detail floor", 20, key) + 1).cast("string"), "unit": F.lpad((chosen(seed, "detail unit", 20, key) + 1).cast("string"), 2, "0")}
    for name, value in values.items():
        out = F.replace(out, F.lit(f"{{{name}}}"), value)
    return out


def bases(chains: DataFrame, n: int, seed: int) -> DataFrame:
    """n addresses before any noise, for varied(): the columns of a chain and base_id, street, number, rt, rw, place, detail, admin_conflict.

    A part of them has no rt and rw (30 of 100), a landmark (25), a detail (20), a letter behind the number (20), or a
    postal code of which the last two digits are wrong (8), which admin_conflict says.
    """
    df = with_chains(chains.sparkSession.range(n).withColumnRenamed("id", "base_id"), "base_id", chains, seed)
    flip = lambda purpose, percent: chosen(seed, purpose, 100, "base_id") < percent
    letter = F.when(flip("letter", 20), one_of(["A", "B", "C"], chosen(seed, "letter of number", 3, "base_id"))).otherwise("")
    two = lambda purpose: F.when(~flip("no rt", 30), F.lpad((chosen(seed, purpose, 15, "base_id") + 1).cast("string"), 2, "0"))
    conflict = flip("conflict", 8)
    wrong = lambda at, purpose: ((F.substring("postal_code", at, 1).cast("int") + chosen(seed, purpose, 8, "base_id") + 1) % 10).cast("string")
    code = F.when(conflict, F.concat(F.substring("postal_code", 1, 3), wrong(4, "fourth digit"), wrong(5, "fifth digit"))).otherwise(F.col("postal_code"))
    return df.withColumns({
        "street": one_of(STREETS, chosen(seed, "street", len(STREETS), "base_id")), "number": F.concat((chosen(seed, "number", 250, "base_id") + 1).cast("string"), letter), "rt": two("rt"), "rw": two("rw"),
        "place": F.when(flip("has landmark", 25), landmark(seed, "base_id")), "detail": F.when(flip("has detail", 20), detail(seed, "base_id")), "admin_conflict": conflict, "postal_code": code,
    })


def varied(bases: DataFrame, variants: int, seed: int) -> DataFrame:
    """(base_id, variant, village_code, order_number, tokens, labels, categories): noisy forms of addresses.

    bases has base_id, village_code, the names of the chain, postal_code, street, number, and rt, rw, place and detail,
    null where an address has none. Order, commas, abbreviations, typos, case and what is left out hang on the hash of
    base_id and variant. A slot without a value is passed over.
    """
    df = bases.select("*", F.explode(F.sequence(F.lit(1), F.lit(variants))).alias("variant")).withColumn("_k", F.concat_ws("-", "base_id", "variant"))
    flip = lambda purpose, percent: chosen(seed, purpose, 100, "_k") < percent
    none = F.array().cast(_TOKENS)
    df = df.withColumns({"_short": flip("short", 40), "_typo": flip("typo", 15), "_order": chosen(seed, "order", len(ORDERS), "_k"), "_case": one_of(["upper", "lower", "title", ""], chosen(seed, "case", 4, "_k")), "_p": flip("province", 50), "_z": flip("postal", 60), "_junk": flip("junk", 15), "_note": flip("note", 10)})
    village = F.when(F.col("_typo"), misspelled(F.initcap("village_name"), seed, "village", "_k")).otherwise(F.initcap("village_name"))
    word = lambda full, short: F.when(F.col("_short"), short).otherwise(full)
    city = city_words(F.col("city_name"))
    given = lambda value, text, field: F.when(F.col(value).isNotNull(), labelled(text, field)).otherwise(none)
    slots = {
        "JALAN": labelled(F.concat(word("Jalan ", "Jln. "), "street"), "JALAN"), "NOMOR": labelled(F.concat(F.lit("No. "), "number"), "NOMOR"),
        "RT_RW": F.concat(given("rt", F.concat(F.lit("RT "), "rt"), "RT"), given("rt", F.concat(F.lit("RW "), "rw"), "RW")), "LANDMARK": given("place", F.col("place"), "DETAIL_LOKASI"), "DETAIL": given("detail", F.col("detail"), "DETAIL_LOKASI"),
        "KELURAHAN": labelled(F.concat(word("Kelurahan ", "Kel. "), village), "KELURAHAN"), "KECAMATAN": labelled(F.concat(word("Kecamatan ", "Kec. "), F.initcap("district_name")), "KECAMATAN"), "KOTA": labelled(F.concat_ws(" ", city["marker"], city["name"]), "KOTA_KABUPATEN"),
        "PROVINSI": F.when(F.col("_p"), labelled(F.initcap("province_name"), "PROVINSI")).otherwise(none), "KODEPOS": F.when(F.col("_z"), labelled(F.col("postal_code"), "KODEPOS")).otherwise(none),
    }
    df = df.withColumn("_slots", F.create_map(*[x for k, v in slots.items() for x in (F.lit(k), v)]))
    program = F.get(F.array(*[F.array(*map(F.lit, o)) for o in ORDERS]), F.col("_order").cast("int"))
    comma = lambda s: F.when(s.isin(COMMA_SLOTS) & (chosen(seed, "comma", 2, "_k", s) == 0), labelled(F.lit(","), "O")).otherwise(none)
    body = F.flatten(F.transform(program, lambda s: F.concat(comma(s), F.col("_slots")[s])))
    tokens = F.concat(F.when(F.col("_junk"), labelled(F.lit("Kirim ke:"), "O")).otherwise(none), body, F.when(F.col("_note"), labelled(F.lit("hubungi dulu sebelum sampai"), "O")).otherwise(none))
    df = df.withColumn("_x", tokens)
    cased = lambda t: F.when(F.col("_case") == "upper", F.upper(t)).when(F.col("_case") == "lower", F.lower(t)).when(F.col("_case") == "title", F.initcap(t)).otherwise(t)
    has = {"abbreviation": F.col("_short"), "typo": F.col("_typo"), "prefix_junk": F.col("_junk"), "instruksi": F.col("_note"), "missing_provinsi": ~F.col("_p"), "missing_kodepos": ~F.col("_z"), "missing_rt_rw": F.col("rt").isNull(), "separator": F.exists("_x", lambda x: x["t"] == ",")}
    names = F.array_compact(F.array(*[F.when(v, F.lit(k)) for k, v in has.items()], F.when(F.col("_case") != "", F.concat(F.lit("case_"), "_case"))))
    return df.select("base_id", "variant", "village_code", F.col("_order").cast("int").alias("order_number"), F.transform("_x", lambda x: cased(x["t"])).alias("tokens"), F.transform("_x", lambda x: x["l"]).alias("labels"), F.array_sort(names).alias("categories"))


def joined(training: DataFrame, targeted_examples: DataFrame) -> DataFrame:
    """Training examples and targeted ones in one table with their origin; ValueError if an id is in both. Columns of one side only are null on the other."""
    both = training.select("id").join(targeted_examples.select("id"), "id", "left_semi").head()
    if both is not None:
        raise ValueError(f"id {both['id']} is in both sets")
    return training.withColumn("origin", F.lit("training")).unionByName(targeted_examples.withColumn("origin", F.lit("targeted")), allowMissingColumns=True)


def study_tasks(examples: DataFrame, key: str = "id") -> DataFrame:
    """(task_id, address_text, components, noise_categories, expected_defects, defect_count): what a participant is shown and what is known of it.

    Components are the first span of each type, as the decoder takes them. Categories that are merely cosmetic are no defects.
    """
    starts = F.filter(F.transform("labels", lambda l, i: F.when(l.startswith("B-"), F.struct(F.substring(l, 3, 99).alias("field"), i.alias("at")))), lambda s: s.isNotNull())
    ends = lambda s: F.array_position(F.transform(F.slice("labels", s["at"] + 2, F.size("labels")), lambda l: l != F.concat(F.lit("I-"), s["field"])), True)
    size = lambda s: F.when(ends(s) > 0, ends(s)).otherwise(F.size("labels") - s["at"]).cast("int")
    first = F.filter(starts, lambda s: ~F.exists(starts, lambda o: (o["field"] == s["field"]) & (o["at"] < s["at"])))
    components = F.map_from_entries(F.transform(first, lambda s: F.struct(s["field"], F.array_join(F.slice("tokens", s["at"] + 1, size(s)), " "))))
    defects = F.array_sort(F.array_intersect("categories", F.array(*map(F.lit, SCORED_DEFECTS))))
    return examples.select(F.col(key).alias("task_id"), S.detokenized("tokens").alias("address_text"), components.alias("components"), F.col("categories").alias("noise_categories"), defects.alias("expected_defects"), F.size(defects).cast("long").alias("defect_count"))
