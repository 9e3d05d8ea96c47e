"""Annotation work: span lists, agreement of two annotators, adjudication, gold assembly, and the automatic annotator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapal.functions import scalar as S
from tapal.functions.matching import matching_ratio, matching_ratios
from tapal.operators import evaluation as E

#: Words that an administrative value may hold beside its name, by field.
PREFIXES = {"KECAMATAN": ["kec", "kecamatan", "kecmtn", "kcmtn"], "KOTA_KABUPATEN": ["kab", "kabupaten", "kb", "kota"]}
#: Tokens that make an error case one of abbreviations, or of landmarks.
ABBREVIATIONS = ["jl", "jln", "kp", "kpg", "gg", "no", "ds", "kel", "kec", "kecmtn", "kcmtn", "kab", "kb", "kota", "rt", "rw"]
LANDMARKS = ["dekat", "sebelah", "depan", "belakang", "samping", "masjid", "gereja", "pasar", "sekolah", "kantor", "jembatan", "gang", "gg"]
#: What a segment's district, city and province begin with or are, and from which ratio on it is a known name.
DISTRICT_OPENERS = ["kecamatan", "kecmatan", "kmctn", "kcmtn", "kecamatn", "kecamtan", "kec", "kc"]
CITY_OPENERS = ["kabupaten", "kabupatn", "kbupatn", "kabpatn", "kabupatan", "kab", "kb", "kota", "kta", "kt"]
PROVINCE = "jawabarat"
PROVINCE_SHORT = "jabar"
MATCH = 0.62
#: A numbered field's token with its number, its marker alone, and a number that may follow one.
NUMBERED = {"RT": ("^rt\\.{0,2}[0-9]+[a-z]?$", "^rt\\.{0,2}$"), "RW": ("^rw\\.{0,2}[0-9]+[a-z]?$", "^rw\\.{0,2}$"), "NOMOR": ("^(?:no|nomor|nomer)\\.?[0-9]+[a-z]?$", "^(?:no|nomor|nomer)\\.?$")}
NUMBER, POSTAL = "^\\.{0,2}[0-9]+[a-z]?$", "^[0-9]{5}$"
#: Letters of a segment without a known name from which it has to be looked at.
LONG_SEGMENT = 25


def indexed_tokens(tokens: str) -> Column:
    """Tokens with their places, "0:a 1:b"."""
    return F.array_join(F.transform(tokens, lambda t, i: F.concat(i.cast("string"), F.lit(":"), t)), " ")


def parsed_spans(text: str, n_tokens: Column) -> Column:
    """(labels, problem) of a list TYPE:start-end;...: BIO labels of that many tokens, or what is wrong with the list.

    Of overlapping spans the later one in the list holds the tokens.
    """
    chunks = F.filter(F.transform(F.split(F.coalesce(F.col(text), F.lit("")), ";"), lambda c: F.trim(c)), lambda c: c != "")
    form = "^([A-Z_]+):([0-9]+)-([0-9]+)$"
    spans = F.transform(chunks, lambda c: F.struct(F.regexp_extract(c, form, 1).alias("type"), F.regexp_extract(c, form, 2).try_cast("int").alias("a"), F.regexp_extract(c, form, 3).try_cast("int").alias("b")))
    bad = F.when(F.exists(chunks, lambda c: ~c.rlike(form)), "unparseable").when(F.exists(spans, lambda s: ~s["type"].isin(S.FIELDS)), "unknown_type").when(F.exists(spans, lambda s: (s["a"] >= s["b"]) | (s["b"] > n_tokens)), "out_of_range")
    empty = F.array_repeat(F.lit("O"), n_tokens.cast("int"))
    put = lambda labels, s: F.transform(labels, lambda l, i: F.when((i >= s["a"]) & (i < s["b"]), F.concat(F.when(i == s["a"], "B-").otherwise("I-"), s["type"])).otherwise(l))
    return F.struct(F.when(bad.isNull(), F.aggregate(spans, empty, put)).alias("labels"), bad.alias("problem"))


def reviewed(candidates: DataFrame, worksheet: DataFrame, key: str) -> DataFrame:
    """(key, tokens, automated, human, annotator_id, problem) for each row of a worksheet (key, spans, annotator_id).

    problem: not_in_pool, not_reviewed, no_annotator, or what is wrong with the list of spans; null if there is none.
    """
    out = worksheet.select(key, "spans", F.trim(F.coalesce("annotator_id", F.lit(""))).alias("annotator_id")).join(candidates.select(key, "tokens", F.col("labels").alias("automated")), key, "left")
    out = out.withColumn("_p", parsed_spans("spans", F.coalesce(F.size("tokens"), F.lit(0))))
    blank = S.surface("spans") == ""
    problem = F.when(F.col("tokens").isNull(), "not_in_pool").when(blank & (F.col("annotator_id") == ""), "not_reviewed").when(F.col("annotator_id") == "", "no_annotator").otherwise(F.col("_p.problem"))
    return out.select(key, "tokens", "automated", F.col("_p.labels").alias("human"), "annotator_id", problem.alias("problem"))


def disagreements(rows: DataFrame, key: str) -> DataFrame:
    """(key, start, end, span_text, automated_label, human_label): spans that only one of the two has."""
    human, automated = E.spans(rows, key, "human"), E.spans(rows, key, "automated")
    on = [key, "type", "start", "end"]
    one = human.join(automated, on, "left_anti").select(*on, F.lit("O").alias("automated_label"), F.col("type").alias("human_label"))
    two = automated.join(human, on, "left_anti").select(*on, F.col("type").alias("automated_label"), F.lit("O").alias("human_label"))
    texts = rows.select(key, "tokens")
    span_text = F.array_join(F.slice("tokens", (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int")), " ")
    return one.unionByName(two).join(texts, key).select(key, "start", "end", span_text.alias("span_text"), "automated_label", "human_label")


def agreement(rows: DataFrame, key: str) -> DataFrame:
    """One row: reviewed, exact_match and disagreeing examples, and the metrics of automated spans against human ones."""
    differ = disagreements(rows, key).agg(F.countDistinct(key).alias("disagreeing"))
    n = rows.agg(F.count(F.lit(1)).alias("reviewed"))
    metrics = E.span_metrics(E.spans(rows, key, "human"), E.spans(rows, key, "automated"), key)
    return n.crossJoin(differ).crossJoin(metrics).withColumn("exact_match", F.col("reviewed") - F.col("disagreeing"))  # one row each


def assembled(candidates: DataFrame, human: DataFrame, decisions: DataFrame, key: str) -> DataFrame:
    """(key, tokens, labels, provenance, annotator_id, problem): gold labels of all candidates.

    human (key, human, annotator_id) has the sampled ones, decisions (key, start, end, adjudicated_label) their settled
    disagreements: a label is written over the human's tokens, O leaves them. Others keep their automated labels.
    problem names undecided or unknown labels and sequences that are no BIO.
    """
    own = decisions.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("start", "end", F.trim("adjudicated_label").alias("label")))).alias("d"))
    out = candidates.select(key, "tokens", "labels").join(human.select(key, "human", "annotator_id"), key, "left").join(own, key, "left")
    put = lambda labels, d: F.when(d["label"] == "O", labels).otherwise(F.transform(labels, lambda l, i: F.when((i >= d["start"]) & (i < d["end"]), F.concat(F.when(i == d["start"], "B-").otherwise("I-"), d["label"])).otherwise(l)))
    sampled = F.col("human").isNotNull()
    labels = F.when(sampled, F.aggregate(F.coalesce("d", F.array().cast(out.schema["d"].dataType)), F.col("human"), put)).otherwise(F.col("labels"))
    provenance = F.when(sampled & F.col("d").isNotNull(), "double_annotated_adjudicated").when(sampled, "double_annotated_agreed").otherwise("automated_accepted")
    out = out.withColumn("gold", labels).withColumn("provenance", provenance)
    wrong = F.exists(F.coalesce("d", F.array().cast(out.schema["d"].dataType)), lambda d: ~d["label"].isin(["O", *S.FIELDS]))
    undecided = F.exists(F.coalesce("d", F.array().cast(out.schema["d"].dataType)), lambda d: d["label"] == "")
    problem = F.when(undecided, "undecided").when(wrong, "unknown_label").when(~E.is_bio(F.col("gold")), "invalid_bio")
    return out.select(key, "tokens", F.col("gold").alias("labels"), "provenance", F.when(sampled, F.col("annotator_id")).otherwise("automated").alias("annotator_id"), problem.alias("problem"))


def value_key(x: Column | str, field: str | None = None) -> Column:
    """The letters and digits of a value without the administrative words of its field."""
    words = F.filter(F.transform(F.split(S.surface(x), "\\s+"), S.clean_token), lambda w: (w != "") & ~w.isin(PREFIXES.get(field, [""])))
    return F.array_join(words, "")


def entity_values(tokens: str, labels: str, field: str) -> Column:
    """The texts of a row's spans of one type."""
    starts = F.filter(F.transform(labels, lambda l, i: F.when(l == f"B-{field}", i)), lambda i: i.isNotNull())
    ends = lambda i: F.array_position(F.transform(F.slice(labels, i + 2, F.size(labels)), lambda l: l != f"I-{field}"), True)
    return F.transform(starts, lambda i: F.array_join(F.slice(tokens, i + 1, F.when(ends(i) > 0, ends(i)).otherwise(F.size(labels) - i).cast("int")), " "))


def error_cases(df: DataFrame, key: str) -> DataFrame:
    """(key, repaired, n_repairs, categories, components, critical_failed, severity) of examples that are not predicted exactly.

    df has tokens, gold, predicted and, from the governed source, street, district and city (blank if unknown).
    Categories come from tokens, gold labels and source alone. typo and conflict compare gold values with the source's.
    """
    out = df.withColumn("repaired", E.repaired("predicted")).withColumn("n_repairs", F.size(F.filter(F.zip_with("predicted", E.repaired("predicted"), lambda a, b: a != b), lambda x: x)))
    keys = F.transform("tokens", S.clean_token)
    has = lambda f: F.array_contains("gold", f"B-{f}")
    any_of = lambda words: F.arrays_overlap(keys, F.array(*map(F.lit, words)))
    sources = {"KECAMATAN": "district", "KOTA_KABUPATEN": "city"}
    for f, c in sources.items():
        out = out.withColumn(f"_k{f}", F.transform(entity_values("tokens", "gold", f), _keyed(f))).withColumn(f"_r{f}", value_key(c, f))
    pairs = None
    for f in sources:
        one = out.select(key, F.lit(f).alias("field"), F.explode(f"_k{f}").alias("k"), F.col(f"_r{f}").alias("r")).where("k <> '' and r <> ''")
        pairs = one if pairs is None else pairs.unionByName(one)
    top = pairs.withColumn("m", matching_ratio("k", "r")).groupBy(key, "field").agg(F.max("m").alias("m")).groupBy(key).agg(F.max(((F.col("m") >= 0.65) & (F.col("m") < 0.95)).cast("int")).alias("_typo"), F.max((F.col("m") < 0.65).cast("int")).alias("_conflict"))
    out = out.join(top, key, "left")
    missing = ((S.surface("street") != "") & ~has("JALAN")) | ((S.surface("district") != "") & ~has("KECAMATAN")) | ((S.surface("city") != "") & ~has("KOTA_KABUPATEN"))
    several = F.lit(False)
    for f in sources:
        several = several | (F.size(F.array_distinct(F.filter(f"_k{f}", lambda k: k != ""))) > 1)
    flags = {
        "typo": F.col("_typo") == 1, "abbreviation": any_of(ABBREVIATIONS), "rt_rw": has("RT") | has("RW") | any_of(["rt", "rw"]), "landmark": has("DETAIL_LOKASI") | any_of(LANDMARKS),
        "missing_field": missing, "conflict": F.col("_conflict") == 1, "ambiguous_region": several,
    }
    found = F.array_compact(F.array(*[F.when(F.coalesce(v, F.lit(False)), F.lit(k)) for k, v in flags.items()]))
    out = out.withColumn("_found", found).withColumn("categories", F.when(F.size("_found") > 0, F.col("_found")).otherwise(F.array(F.lit("other_surface_form"))))
    critical = lambda labels: F.sort_array(E.span_structs(labels, S.CRITICAL_FIELDS))
    out = out.withColumn("critical_failed", critical("gold") != critical("repaired"))
    generator = F.arrays_overlap("categories", F.array(*map(F.lit, ["typo", "abbreviation", "rt_rw", "landmark", "missing_field"])))
    parts = F.array_compact(F.array(F.when(F.col("gold") != F.col("repaired"), F.lit("model")), F.when(F.col("n_repairs") > 0, F.lit("validator")), F.when(generator, F.lit("generator"))))
    out = out.where((F.col("gold") != F.col("repaired")) | (F.col("n_repairs") > 0))
    return out.select(key, "repaired", "n_repairs", "categories", parts.alias("components"), "critical_failed", F.when(F.col("critical_failed"), "P0").otherwise("P1").alias("severity"))


def _keyed(field: str):
    return lambda v: value_key(v, field)


def alignment_form(x: Column | str) -> Column:
    """Lower case, with . , ; : and / as spaces and white space collapsed."""
    return S.collapse(F.regexp_replace(F.lower(S.col(x)), "[.,;:/]+", " "))


def strip_prefix(x: Column | str, words: list[str]) -> Column:
    """A token without the longest of the words that it begins with, if something is left."""
    longest = "|".join(sorted(words, key=lambda w: (-len(w), w)))
    return F.regexp_replace(S.col(x), f"^(?:{longest})(?=.)", "")


def _first_span(forms: Column, wanted: Column) -> Column:
    """(start, end) of the first run of token forms that joined are the wanted form; null if there is none or nothing is wanted.

    The forms stand in one text behind marks, so that one search tells the run: words of the wanted form may be parted
    by a space inside a token or by marks, and a run begins and ends at a mark. Time and memory grow with the row.
    """
    words = F.transform(F.split(wanted, " "), lambda w: F.regexp_replace(w, "([^\\p{L}\\p{N}])", "\\\\$1"))
    pattern = F.concat(F.lit("\x01+"), F.array_join(words, "[ \x01]+"), F.lit("(?=\x01)"))
    marks = lambda x: F.length(x) - F.length(F.replace(x, F.lit("\x01"), F.lit("")))

    def told(text: Column) -> Column:
        hit = S.once(F.regexp_substr(text, pattern), lambda run: F.struct(run.alias("run"), F.instr(text, F.concat(run, F.lit("\x01"))).alias("at")))
        return S.once(hit, lambda h: F.when(h["run"].isNotNull(), S.once(marks(F.substring(text, F.lit(1), h["at"] - 1)), lambda start: F.struct(start.alias("start"), (start + marks(h["run"])).alias("end")))))

    text = F.concat(F.lit("\x01"), F.array_join(forms, "\x01"), F.lit("\x01"))
    return F.when(F.coalesce(wanted, F.lit("")) != "", S.once(text, told))


def component_span(tokens: str, component: str) -> Column:
    """(start, end) of the first run of tokens whose alignment form is the component's; null if there is none."""
    return _first_span(F.transform(tokens, alignment_form), alignment_form(component))


def component_spans(tokens: str, components: str) -> Column:
    """(label, start, end) of each of a row's components (label, value) in their order: the first run of tokens that none
    before it took. A component that is nowhere, or only where tokens are taken, has none."""
    held = "array<struct<label:string,start:int,end:int>>"
    free = F.transform(tokens, alignment_form)

    def place(state: Column, c: Column) -> Column:
        def put(span: Column) -> Column:
            taken = F.transform(state["forms"], lambda f, i: F.when((i >= span["start"]) & (i < span["end"]), F.lit("\x02")).otherwise(f))
            found = F.array(F.struct(c["label"].alias("label"), span["start"].cast("int").alias("start"), span["end"].cast("int").alias("end")))
            return F.when(span.isNull(), state).otherwise(F.struct(taken.alias("forms"), F.concat(state["found"], found).alias("found")))

        return S.once(_first_span(state["forms"], alignment_form(c["value"])), put)

    start = F.struct(free.alias("forms"), F.array().cast(held).alias("found"))
    return F.aggregate(components, start, place, lambda s: s["found"])


def segments(df: DataFrame, key: str, tokens: str) -> DataFrame:
    """(key, segment, start, end): runs of tokens between the break tokens , ; and -."""
    cuts = F.filter(F.transform(tokens, lambda t, i: F.when(t.isin(",", ";", "-"), i)), lambda i: i.isNotNull())
    edges = F.concat(F.array(F.lit(-1)), cuts, F.array(F.size(tokens)))
    spans = F.filter(F.transform(F.slice(edges, 1, F.size(edges) - 1), lambda a, i: F.struct((a + 1).alias("start"), F.get(edges, i + 1).alias("end"))), lambda s: s["start"] < s["end"])
    return df.select(key, F.posexplode(spans).alias("segment", "s")).select(key, F.col("segment").cast("long"), F.col("s.start").cast("long").alias("start"), F.col("s.end").cast("long").alias("end"))


def worksheet_problems(df: DataFrame, key: str, original: str, noised: str) -> DataFrame:
    """(key, problem) of a completed worksheet: repeated keys, blank texts, texts like the original but for case and white space, and runs of seven digits or more."""
    form = lambda c: F.lower(S.collapse(c))
    checks = {"blank": S.surface(noised) == "", "identical": (S.surface(noised) != "") & (form(original) == form(noised)), "long_digit_run": F.col(noised).rlike("[0-9]{7}")}
    found = df.select(key, F.explode(F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in checks.items()]))).alias("problem"))
    return found.unionByName(df.groupBy(key).count().where("count > 1").select(key, F.lit("repeated").alias("problem")))


def _opened(x: Column, words: list[str]) -> Column:
    """What follows the longest of the words that x begins with, null if none or nothing does."""
    return F.when(x.rlike("^(?:" + "|".join(words) + ")."), strip_prefix(x, words))


def _quoted(x: Column) -> Column:
    """A text in quotes: single ones, or double ones if it has single ones only."""
    plain = F.replace(x, F.lit("\\"), F.lit("\\\\"))
    single = F.when(x.contains("'") & ~x.contains('"'), F.concat(F.lit('"'), plain, F.lit('"')))
    return F.coalesce(single, F.concat(F.lit("'"), F.replace(plain, F.lit("'"), F.lit("\\'")), F.lit("'")))


def _token_label(token: Column, before: Column, behind: Column) -> Column:
    """The label of a token of a numbered field or a postal code, given its neighbours in the segment, all in lower case; else empty."""
    low, last, following = (F.coalesce(x, F.lit("")) for x in (token, before, behind))
    out = F
    for field, (whole, _) in NUMBERED.items():
        out = out.when(low.rlike(whole), f"B-{field}")
    for field, (_, marker) in NUMBERED.items():
        out = out.when(low.rlike(marker) & following.rlike(NUMBER), f"B-{field}").when(last.rlike(marker) & low.rlike(NUMBER), f"I-{field}")
    return out.when(low.rlike(POSTAL), "B-KODEPOS").otherwise("")


def annotated(df: DataFrame, tokens: str, district: str, city: str) -> DataFrame:
    """df with labels and flags: BIO labels told from the tokens and the district and city that the address is known to be in.

    Segments between break tokens lose their numbered fields and postal code first. What is left of one is the
    province, the district or the city if it is a known name, spelled exactly or alike (a ratio of MATCH or more) and
    with or without an opening word; the first of the others is the street, later ones are details. Spans begin anew
    behind every gap. flags says what stays open, as kind:'text': a number with letters behind it, an opening word
    with an unknown name, and a long segment without a known name. Null or empty tokens have no labels.
    All is done within the row, and only pairs whose letters can reach MATCH are compared.
    """
    names = set(df.columns)
    known_city = F.coalesce(_opened(S.clean_token(F.coalesce(F.col(city), F.lit(""))), ["kabupaten", "kota"]), S.clean_token(F.coalesce(F.col(city), F.lit(""))))
    out = df.withColumn("_t", F.coalesce(F.col(tokens), F.array().cast("array<string>")))
    cuts = F.filter(F.transform("_t", lambda t, i: F.when(t.isin(",", ";", "-"), i)), lambda i: i.isNotNull())
    out = out.withColumn("_edges", F.concat(F.array(F.lit(-1)), cuts, F.array(F.size("_t"))))
    runs = F.transform(F.slice("_edges", F.lit(1), F.size("_edges") - 1), lambda a, k: F.slice("_t", a + 2, F.get("_edges", k + 1) - a - 1))
    out = out.withColumn("_runs", runs)
    kinds = F.transform("_runs", lambda run: S.once(F.transform(run, lambda t: F.lower(t)), lambda low: F.transform(low, lambda t, i: _token_label(t, F.get(low, i - 1), F.get(low, i + 1)))))
    out = out.withColumn("_kinds", kinds)
    # What is left of each segment: its tokens as they are, and their letters and digits.
    left = F.zip_with("_runs", "_kinds", lambda run, kind: F.filter(F.zip_with(run, kind, lambda t, k: F.when(k == "", t)), lambda t: t.isNotNull()))
    out = out.withColumn("_left", F.transform(left, lambda x: F.struct(F.size(x).alias("n"), F.array_join(x, "").alias("text"), S.clean_token(F.array_join(x, "")).alias("letters"))))
    own = F.transform("_left", lambda s: F.struct(s["n"].alias("n"), s["text"].alias("text"), s["letters"].alias("letters"), _opened(s["letters"], DISTRICT_OPENERS).alias("d"), _opened(s["letters"], CITY_OPENERS).alias("c")))
    out = out.withColumn("_left", own)
    said = F.flatten(F.transform("_left", lambda s: F.array(F.coalesce(s["d"], s["letters"]), F.coalesce(s["c"], s["letters"]))))
    known = F.flatten(F.array_repeat(F.array(S.clean_token(F.coalesce(F.col(district), F.lit(""))), known_city), F.size("_left")))
    out = out.withColumn("_ratios", matching_ratios(MATCH)(said, known))

    def told(s: Column, k: Column) -> Column:
        as_district, as_city = F.get("_ratios", 2 * k), F.get("_ratios", 2 * k + 1)
        first = F.when(s["n"] == 0, "").when((s["letters"] == PROVINCE_SHORT) | s["letters"].contains(PROVINCE), "PROVINSI")
        return first.when((as_district >= MATCH) & (as_district >= as_city), "KECAMATAN").when(as_city >= MATCH, "KOTA_KABUPATEN").when(s["d"].isNotNull(), "?KECAMATAN").when(s["c"].isNotNull(), "?KOTA_KABUPATEN").otherwise("PLACE")

    out = out.withColumn("_told", F.transform("_left", told)).withColumn("_street", F.array_position("_told", "PLACE"))
    field = F.transform("_told", lambda x, k: F.when(x == "PLACE", F.when(k + 1 == F.col("_street"), "JALAN").otherwise("DETAIL_LOKASI")).otherwise(F.replace(x, F.lit("?"), F.lit(""))))
    # Asked for within a loop over tokens, it would be made again for each of them if it were no step of its own.
    out = S.held(out, "_field", field)
    spans = lambda kind, name: F.transform(kind, lambda x, i: F.when(x != "", x).otherwise(F.concat(F.when((i == 0) | (F.get(kind, i - 1) != ""), "B-").otherwise("I-"), name)))
    labels = F.flatten(F.transform("_kinds", lambda kind, k: F.concat(F.when(k == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("O"))), spans(kind, F.get("_field", k)))))
    noisy = lambda run, kind: F.filter(F.zip_with(run, kind, lambda t, k: F.when(k.isin("B-RT", "B-RW") & F.lower(t).rlike("[0-9][a-z]$"), F.concat(F.lower(F.substring(k, 3, 2)), F.lit("_token_has_trailing_noise:"), _quoted(t)))), lambda x: x.isNotNull())
    opens = lambda x, s: F.when(x == "?KECAMATAN", F.lit("unmatched_kecamatan_designator:")).when(x == "?KOTA_KABUPATEN", F.lit("unmatched_kabupaten_designator:")).when((x == "PLACE") & (F.length(s["letters"]) > LONG_SEGMENT), F.lit("long_unmatched_segment_needs_review:"))
    segment = lambda k: F.array_compact(F.array(F.concat(opens(F.get("_told", k), F.get("_left", k)), _quoted(F.get("_left", k)["text"]))))
    flags = F.flatten(F.transform("_runs", lambda run, k: F.concat(noisy(run, F.get("_kinds", k)), segment(k))))
    out = out.withColumn("labels", F.when(F.size("_t") > 0, labels).otherwise(F.array().cast("array<string>"))).withColumn("flags", flags)
    return out.drop(*{"_t", "_edges", "_runs", "_kinds", "_left", "_ratios", "_told", "_street", "_field"} - names)


#: The columns of a worksheet that an annotator fills in.
EDITABLE = ["rewritten_address", "annotator_id", "notes"]


def worksheet_template(candidates: DataFrame, columns: list[str]) -> DataFrame:
    """The candidates' columns and blank EDITABLE ones; ValueError without candidates."""
    if candidates.isEmpty():
        raise ValueError("there are no candidates")
    return candidates.select(*[S.surface(c).alias(c) for c in columns], *[F.lit("").alias(c) for c in EDITABLE])


def assembled_benchmark(worksheet: DataFrame, key: str, original: str, level: str) -> tuple[DataFrame, DataFrame]:
    """(examples, counts) of a completed worksheet; ValueError with the first problem if it has any.

    counts (kind, name, n) says how many examples there are in all, by annotator and by level, in one pass.
    """
    own = worksheet.select(*[S.surface(c).alias(c) for c in worksheet.columns])
    problems = worksheet_problems(own, key, original, "rewritten_address").unionByName(own.where((F.col("annotator_id") == "") & (F.col("rewritten_address") != "")).select(key, F.lit("no_annotator").alias("problem")))
    first = problems.orderBy(key, "problem").head()
    if first is not None:
        raise ValueError(f"{first[0]}: {first[1]}")
    examples = own.withColumnRenamed("rewritten_address", "text").drop(original)
    a, b = F.col("annotator_id"), F.col(level)
    kind = F.when(F.grouping("annotator_id") == 0, "annotator").when(F.grouping(level) == 0, "level").otherwise("all")
    counts = own.groupingSets([[], [a], [b]], a, b).agg(F.count(F.lit(1)).alias("n"), kind.alias("kind"))
    return examples, counts.select("kind", F.coalesce(a, b, F.lit("all")).alias("name"), "n")


def case_records(df: DataFrame, key: str) -> DataFrame:
    """error_cases with what a reader needs: case_id, provenance, tokens, all three label lists, both lists of spans
    (type, start, end, text) in order, and each repair (index, before, after). df as in error_cases, with provenance."""
    cases = error_cases(df, key)
    out = df.select(key, "tokens", "gold", "predicted", "provenance").join(cases, key)
    text = lambda s: F.array_join(F.slice("tokens", s["start"] + 1, s["end"] - s["start"]), " ")
    spans = lambda labels: F.transform(E.sorted_spans(E.span_structs(labels, S.FIELDS)), lambda s: F.struct(s["type"].alias("type"), s["start"].alias("start"), s["end"].alias("end"), text(s).alias("text")))
    repairs = F.filter(F.transform("predicted", lambda x, i: F.struct(i.alias("index"), x.alias("before"), F.get("repaired", i).alias("after"))), lambda r: r["before"] != r["after"])
    return out.withColumns({"case_id": F.concat(F.lit("RD-"), F.col(key).cast("string")), "gold_spans": spans("gold"), "predicted_spans": spans("repaired"), "repairs": repairs, "generator_is_hypothesis": F.array_contains("components", "generator")})
