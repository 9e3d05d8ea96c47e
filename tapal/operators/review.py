"""What a reviewer sees of a contract document: components with their pending corrections, issues, editable text, safe errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tapal.functions import scalar as S

#: How fields are called, the short titles of reason codes, and where a value comes from as it is shown.
FIELD_LABELS = {"JALAN": "Jalan", "NOMOR": "Nomor", "RT": "RT", "RW": "RW", "KELURAHAN": "Kelurahan", "KECAMATAN": "Kecamatan", "KOTA_KABUPATEN": "Kota/Kabupaten", "PROVINSI": "Provinsi", "KODEPOS": "Kode pos", "DETAIL_LOKASI": "Detail lokasi"}
REASON_TITLES = {
    "KODEPOS_TIDAK_COCOK": "Kode pos tidak cocok", "KELURAHAN_TIDAK_DITEMUKAN": "Kelurahan tidak ditemukan", "ADMINISTRATIVE_CONFLICT": "Komponen wilayah bertentangan",
    "MISSING_ADMINISTRATIVE_FIELDS": "Komponen wilayah belum lengkap", "AMBIGUOUS_ADMINISTRATIVE_CANDIDATES": "Wilayah ambigu", "CORRECTION_REQUIRES_CONFIRMATION": "Koreksi menunggu konfirmasi",
}
SHOWN_SOURCES = {"user_input": "user", "confirmed_by_user": "user", "extracted_by_model": "parser", "rule_extracted": "parser", "inferred_from_hierarchy": "reference", "normalized_by_dictionary": "reference", "returned_by_geocoder": "reference"}
#: What stands before a value in an editable text.
EDIT_PREFIXES = {"NOMOR": "No. ", "RT": "RT ", "RW": "RW "}
EDIT_ORDER = ["RT", "RW", "KELURAHAN", "KECAMATAN", "KOTA_KABUPATEN", "PROVINSI", "KODEPOS", "DETAIL_LOKASI"]


def _mapped(values: dict[str, str], x: Column, other: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(y) for pair in values.items() for y in pair])[x], other)


def shown_source(source: Column) -> Column:
    """Whether a value came from the user, the parser or the reference; input for any other source."""
    return _mapped(SHOWN_SOURCES, source, F.lit("input"))


def _pending(correction: Column) -> Column:
    return (correction["decision"] == "requires_confirmation") & ~correction["applied"]


def components_with_corrections(df: DataFrame, components: str = "components", corrections: str = "corrections") -> Column:
    """A row's components in their order, each with the first pending correction of its field, and after them the pending
    corrections of fields that no component has, in theirs: (field, label, value, previous_value, suggestion, source, state, model_score).

    The merge is within the row. state is suggested with a pending correction, else confirmed, user-edited if there is a
    previous value, or original. Several components of a field each get the correction; several corrections of a field
    without component each become one. Null arrays count as empty.
    """
    parts = {c: df.select(c).schema[0].dataType for c in (components, corrections)}
    result = parts[components].elementType["result"].dataType
    before = (lambda r: r["previous_value"]["value"]) if isinstance(result["previous_value"].dataType, StructType) else (lambda r: r["previous_value"])
    own, fixes = (F.coalesce(F.col(c), F.array().cast(kind)) for c, kind in parts.items())
    waiting = F.filter(fixes, _pending)

    def shown(field: Column, value: Column, previous: Column, suggestion: Column, source: Column, state: Column, score: Column) -> Column:
        return F.struct(field.alias("field"), _mapped(FIELD_LABELS, field, field).alias("label"), value.alias("value"), previous.alias("previous_value"), suggestion.alias("suggestion"), shown_source(source).alias("source"), state.alias("state"), score.cast("double").alias("model_score"))

    def merged(entry: Column) -> Column:
        r, fix = entry["result"], F.get(F.filter(waiting, lambda c: c["field"] == entry["field"]), F.lit(0))
        known = F.coalesce(r["confirmed"], F.lit(False)) | (r["source"] == "confirmed_by_user")
        state = F.when(fix.isNotNull(), "suggested").when(known, "confirmed").when(F.coalesce(before(r), F.lit("")) != "", "user-edited").otherwise("original")
        return shown(entry["field"], r["value"], F.coalesce(before(r), fix["previous_value"]["value"]), fix["proposed_value"]["value"], r["source"], state, r["model_score"])

    fields = F.transform(own, lambda c: c["field"])
    orphans = F.filter(waiting, lambda c: ~F.array_contains(fields, c["field"]))
    added = F.transform(orphans, lambda c: shown(c["field"], c["previous_value"]["value"], F.nullif(c["previous_value"]["value"], F.lit("")), c["proposed_value"]["value"], c["previous_value"]["source"], F.lit("suggested"), F.lit(None)))
    return F.concat(F.transform(own, merged), added)


def titled_issues(issues: str | Column) -> Column:
    """Issues with an id of reason code and place and a short title; a code without one is its own title."""
    col = F.col(issues) if isinstance(issues, str) else issues
    return F.transform(col, lambda x, i: F.struct(F.concat(x["reason_code"], F.lit("-"), i.cast("string")).alias("id"), x["severity"].alias("severity"), _mapped(REASON_TITLES, x["reason_code"], x["reason_code"]).alias("title"), x["message"].alias("message"), x["reason_code"].alias("reason_code"), x["affected_fields"].alias("affected_fields"), x["clarification_question"].alias("question")))


def editable_text(components: Column) -> Column:
    """An address line of components (field, value), to be edited and sent again: of each field the first value, trimmed."""
    value = lambda f: F.trim(F.coalesce(F.get(F.filter(components, lambda c: c["field"] == f), F.lit(0))["value"], F.lit("")))
    given = lambda f: F.when(value(f) != "", F.concat(F.lit(EDIT_PREFIXES.get(f, "")), value(f)))
    street = F.nullif(F.concat_ws(" ", given("JALAN"), given("NOMOR")), F.lit(""))
    return F.concat_ws(", ", street, *[given(f) for f in EDIT_ORDER])


def review(df: DataFrame, key: str = "address_id", body: str = "body") -> DataFrame:
    """(key, status, redacted_input, components, normalized_address, is_final, issues) of documents as structs (address.document_body).

    The raw text is never taken. is_final says that the gate found nothing left to settle.
    """
    flat = df.select(key, F.col(f"{body}.components").alias("components"), F.col(f"{body}.corrections").alias("corrections"), F.col(f"{body}.quality_gate").alias("gate"), F.col(f"{body}.pii.redacted_text.value").alias("redacted_input"), F.col(f"{body}.normalized_address.value").alias("normalized_address"))
    return flat.select(
        key, F.col("gate.status").alias("status"), "redacted_input", components_with_corrections(flat).alias("components"), "normalized_address",
        (F.col("gate.status") == "SIAP_DIPROSES").alias("is_final"), titled_issues("gate.issues").alias("issues"),
    )


def safe_detail(detail: Column, code: str = "INVALID_REQUEST", message: str = "The request is not valid.") -> Column:
    """(field, code, message) of an error's detail struct that may be given out: blank texts become the fallbacks, a blank field null."""
    text = lambda name: F.when(F.trim(F.coalesce(detail[name], F.lit(""))) != "", detail[name])
    return F.struct(text("field").alias("field"), F.coalesce(text("code"), F.lit(code)).alias("code"), F.coalesce(text("message"), F.lit(message)).alias("message"))


def unknown_fields(values: str | Column) -> Column:
    """The sorted keys of a map of values that are no fields of an address, null if all are."""
    found = F.array_sort(F.array_except(F.map_keys(S.col(values)), F.array(*map(F.lit, S.FIELDS))))
    return F.when(F.size(found) > 0, found)
