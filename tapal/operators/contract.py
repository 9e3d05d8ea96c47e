"""Checks of contract documents against a JSON schema and the rules that a schema cannot say.

A schema is compiled once, on the driver, to one expression over the parsed document (a VARIANT); documents are then
checked row by row without Python. Each function gives the rows that break a rule, with the place and the rule's name.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapal.functions import scalar as S

# --- the contract's schema, version 1.0.0: fixed values -------------------------------------------------------------

#: Where a value can come from.
SOURCES = ["user_input", "rule_extracted", "extracted_by_model", "normalized_by_dictionary", "inferred_from_hierarchy", "returned_by_geocoder", "confirmed_by_user"]


def _object(**properties: dict) -> dict:
    """An object that has all of these properties and no others."""
    return {"type": "object", "required": list(properties), "properties": properties, "additionalProperties": False}


def _list(item: dict, **more) -> dict:
    return {"type": "array", "items": item, **more}


def _or_null(node: dict) -> dict:
    return {"oneOf": [{"type": "null"}, node]}


def _text(**more) -> dict:
    return {"type": "string", **more}


_FLAG, _REQUEST_ID = {"type": "boolean"}, _text(pattern="^[A-Za-z0-9][A-Za-z0-9_-]{7,63}$")
_SOURCE, _FIELD, _SOME, _PLACE = {"enum": SOURCES}, {"enum": S.FIELDS}, _text(minLength=1), {"type": "integer", "minimum": 0}
_BASIC = _object(value=_text(), source=_SOURCE, confirmed=_FLAG)
_RESULT = _object(value=_text(), source=_SOURCE, confirmed=_FLAG, model_score={"type": ["number", "null"], "minimum": 0, "maximum": 1}, previous_value=_or_null(_BASIC))
_INPUT = _object(address_text=_SOME, geocoding_consent=_FLAG)
_STATUS = {"enum": ["SIAP_DIPROSES", "PERLU_KONFIRMASI", "TIDAK_VALID"]}
_COMPONENT = _object(field=_FIELD, result=_RESULT)
_AUDIT_VALUE = _object(field=_FIELD, value=_text(), source=_SOURCE, confirmed=_FLAG)
_COORDINATE = _object(value={"type": "number"}, source={"const": "returned_by_geocoder"})
_MAYBE_TEXT = {"type": ["string", "null"]}
_ISSUE = _object(
    reason_code={"enum": ["KODEPOS_TIDAK_COCOK", "KELURAHAN_TIDAK_DITEMUKAN", "ADMINISTRATIVE_CONFLICT", "MISSING_ADMINISTRATIVE_FIELDS", "AMBIGUOUS_ADMINISTRATIVE_CANDIDATES", "CORRECTION_REQUIRES_CONFIRMATION"]},
    severity={"enum": ["high", "medium"]}, message=_SOME, affected_fields=_list(_FIELD, minItems=1), clarification_question=_text(pattern="[?]$"), source_reason_code=_SOME,
)
_CORRECTION = _object(
    correction_id=_SOME, field=_FIELD, previous_value=_BASIC, proposed_value=_BASIC, rule_id=_SOME, decision={"enum": ["requires_confirmation", "confirmed", "rejected"]}, applied=_FLAG,
    user_confirmation=_or_null(_object(confirmed={"const": True}, source={"const": "confirmed_by_user"}, confirmed_at=_SOME)),
)
_EVENT = _object(
    sequence={"type": "integer", "minimum": 1}, stage={"enum": ["pii", "model", "normalizer", "validator", "quality_gate", "correction", "geocoding"]}, action=_SOME,
    actor={"enum": ["system", "user", "external_service"]}, rule_id=_MAYBE_TEXT, previous_values=_list(_AUDIT_VALUE), resulting_values=_list(_AUDIT_VALUE),
)
_HEAD = {"schema_version": {"const": "1.0.0"}, "request_id": _REQUEST_ID}
SCHEMA = {
    "$schema": "https://json-schema.org/draft/2020-12/schema",
    "$id": "urn:address-api:v1",
    "oneOf": [{"$ref": "#/$defs/request"}, {"$ref": "#/$defs/batchRequest"}, {"$ref": "#/$defs/response"}, {"$ref": "#/$defs/errorResponse"}],
    "$defs": {
        "request": _object(document_type={"const": "address_parse_request"}, **_HEAD, input=_INPUT),
        "batchRequest": _object(document_type={"const": "address_batch_request"}, **_HEAD, items=_list(_INPUT, minItems=1, maxItems=100)),
        "response": _object(
            document_type={"const": "address_parse_response"}, **_HEAD,
            versions=_object(contract={"const": "1.0.0"}, model=_SOME, normalizer=_SOME, validator=_SOME, reference_data=_SOME, quality_gate={"const": "quality-gate-v1"}),
            pii=_object(address_text=_BASIC, redacted_text=_BASIC, entities=_list(_object(type={"enum": ["PHONE", "RECIPIENT_NAME"]}, start=_PLACE, end=_PLACE, redacted_value={"enum": ["[PHONE_REDACTED]", "[NAME_REDACTED]"]})), reason_codes=_list(_text()), warnings=_list(_text())),
            components=_list(_COMPONENT), normalized_address=_RESULT,
            quality_gate=_object(status=_STATUS, issues=_list(_ISSUE), rules=_object(version={"const": "quality-gate-v1"}, precedence=_list(_object(status=_STATUS, when=_SOME), minItems=3))),
            corrections=_list(_CORRECTION),
            geocoding=_object(status={"enum": ["NOT_REQUESTED", "SUCCESS", "AMBIGUOUS", "EXTERNAL_FAILURE"]}, consent=_FLAG, provider=_MAYBE_TEXT, precision=_MAYBE_TEXT, latitude=_or_null(_COORDINATE), longitude=_or_null(_COORDINATE), components=_list(_COMPONENT), error_code=_MAYBE_TEXT),
            audit_trail=_list(_EVENT),
        ),
        "errorResponse": _object(document_type={"const": "api_error"}, schema_version=_HEAD["schema_version"], request_id=_or_null(_REQUEST_ID), error=_object(code=_SOME, message=_SOME, retryable=_FLAG, details=_list(_object(field=_MAYBE_TEXT, code=_SOME, message=_SOME)))),
    },
}


# --- schemas ---------------------------------------------------------------------------------------------------------


def resolved(node: dict, schema: dict) -> dict:
    """The node that a $ref of the same schema document stands for; KeyError if there is none."""
    while "$ref" in node:
        if not node["$ref"].startswith("#/"):
            raise KeyError(f"not a reference into this document: {node['$ref']}")
        node = reduce(lambda at, k: at[k], node["$ref"][2:].split("/"), schema)
    return node


def schema_problems(schema: dict) -> list[str]:
    """What is wrong with a schema document itself: its draft, its id, references to nowhere."""
    out = [] if str(schema.get("$schema", "")).endswith("/draft/2020-12/schema") else ["draft"]
    out += [] if schema.get("$id") else ["id"]

    def walk(node: object) -> None:
        if isinstance(node, dict):
            if "$ref" in node:
                try:
                    resolved(node, schema)
                except (KeyError, TypeError):
                    out.append(f"reference {node['$ref']}")
            for x in node.values():
                walk(x)
        elif isinstance(node, list):
            for x in node:
                walk(x)

    walk(schema)
    return out


_FOUND = "array<struct<path:string,rule:string>>"


def _none() -> Column:
    return F.array().cast(_FOUND)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once."""
    return F.flatten(F.transform(F.array(value), body))


def _broken(path: Column, rule: str) -> Column:
    return F.array(F.struct(path.alias("path"), F.lit(rule).alias("rule")))


def _unless(ok: Column, path: Column, rule: str) -> Column:
    return F.when(F.coalesce(ok, F.lit(False)), _none()).otherwise(_broken(path, rule))


def compiled(node: dict, schema: dict, v: Column, path: Column) -> Column:
    """The places and rules that the VARIANT v breaks under a schema node, as an array of (path, rule)."""
    node = resolved(node, schema)
    options = [resolved(x, schema) for x in node.get("oneOf", [])]
    if any(x.get("type") == "null" for x in options):
        (other,) = (x for x in options if x.get("type") != "null")
        return F.when(F.is_variant_null(v), _none()).otherwise(compiled(other, schema, v, path))
    if options:
        return _one_of(options, schema, v, path)
    kinds = node.get("type")
    if isinstance(kinds, list):
        (kind,) = (k for k in kinds if k != "null")
        return F.when(F.is_variant_null(v), _none()).otherwise(compiled({**node, "type": kind}, schema, v, path))
    if kinds == "object":
        return _let(F.try_variant_get(v, "$", "map<string,variant>"), lambda m: F.when(m.isNull(), _broken(path, "type")).otherwise(_properties(node, schema, m, path)))
    if kinds == "array":
        return _let(F.try_variant_get(v, "$", "array<variant>"), lambda a: F.when(a.isNull(), _broken(path, "type")).otherwise(_items(node, schema, a, path)))
    return _scalar(node, v, path)


def _one_of(options: list[dict], schema: dict, v: Column, path: Column) -> Column:
    """Exactly one of several objects: the one whose constant document_type the document has."""
    kind = F.try_variant_get(v, "$.document_type", "string")
    out = _broken(path, "oneOf")
    for x in options:
        out = F.when(kind == x["properties"]["document_type"]["const"], compiled(x, schema, v, path)).otherwise(out)
    return out


def _properties(node: dict, schema: dict, m: Column, path: Column) -> Column:
    own = node.get("properties", {})
    names = lambda x: F.array(*map(F.lit, x)).cast("array<string>")
    told = lambda keys, rule: F.transform(keys, lambda k: F.struct(F.concat(path, F.lit("."), k).alias("path"), F.lit(rule).alias("rule")))
    found = [told(F.array_except(names(node.get("required", [])), F.map_keys(m)), "required")]
    if node.get("additionalProperties") is False:
        found.append(told(F.array_except(F.map_keys(m), names(own)), "additionalProperties"))
    for k, child in own.items():
        found.append(F.when(F.map_contains_key(m, k), _let(m[k], _child(child, schema, F.concat(path, F.lit("." + k))))).otherwise(_none()))
    if {"value", "source", "confirmed"} <= set(own):
        found.append(_unless(F.try_variant_get(m["confirmed"], "$", "boolean") == (F.try_variant_get(m["source"], "$", "string") == "confirmed_by_user"), path, "confirmed_by_user"))
    if {"model_score", "source"} <= set(own):
        found.append(_unless(F.is_variant_null(m["model_score"]) == (F.try_variant_get(m["source"], "$", "string") != "extracted_by_model"), path, "model_score"))
    return F.concat(*found)


def _child(node: dict, schema: dict, path: Column) -> Callable[[Column], Column]:
    return lambda x: compiled(node, schema, x, path)


def _items(node: dict, schema: dict, a: Column, path: Column) -> Column:
    found = [F.flatten(F.transform(a, lambda x, i: compiled(node["items"], schema, x, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")))))]
    if "minItems" in node:
        found.append(_unless(F.size(a) >= node["minItems"], path, "minItems"))
    if "maxItems" in node:
        found.append(_unless(F.size(a) <= node["maxItems"], path, "maxItems"))
    return F.concat(*found)


def _scalar(node: dict, v: Column, path: Column) -> Column:
    kind, text, number = F.schema_of_variant(v), F.try_variant_get(v, "$", "string"), F.try_variant_get(v, "$", "double")
    if "const" in node or "enum" in node:
        values = node.get("enum", [node.get("const")])
        rule, same = ("const" if "const" in node else "enum"), "BOOLEAN" if isinstance(values[0], bool) else "STRING"
        return _unless((kind == same) & text.isin([str(x).lower() if isinstance(x, bool) else x for x in values]), path, rule)
    whole, any_number = "^(BIGINT|DECIMAL\\([0-9]+,0\\))$", "^(BIGINT|DECIMAL|DOUBLE|FLOAT)"
    right = {"string": kind == "STRING", "boolean": kind == "BOOLEAN", "integer": kind.rlike(whole), "number": kind.rlike(any_number), "null": kind == "VOID"}[node["type"]]
    rules = [(k, ok) for k, ok in (("minLength", F.length(text) >= node.get("minLength", 0)), ("pattern", text.rlike(node.get("pattern", ""))), ("minimum", number >= node.get("minimum", 0)), ("maximum", number <= node.get("maximum", 0))) if k in node]
    return F.when(~right, _broken(path, "type")).otherwise(F.concat(_none(), *[_unless(ok, path, k) for k, ok in rules]))


# --- documents that are plainly right ---------------------------------------------------------------------------------


def _inner(node: dict, schema: dict) -> tuple[dict, bool]:
    """The node without the null that it may allow, and if it does."""
    node = resolved(node, schema)
    if "oneOf" in node:
        options = [resolved(x, schema) for x in node["oneOf"]]
        (other,) = (x for x in options if x.get("type") != "null")
        return other, len(options) > 1
    kinds = node.get("type")
    if isinstance(kinds, list):
        return {**node, "type": next(k for k in kinds if k != "null")}, True
    return node, False


def typed(node: dict, schema: dict) -> str:
    """The Spark type of what keeps to a schema node, with the keys in the schema's order."""
    node, _ = _inner(node, schema)
    if node.get("type") == "object":
        return "struct<" + ",".join(f"`{k}`:{typed(x, schema)}" for k, x in node["properties"].items()) + ">"
    if node.get("type") == "array":
        return f"array<{typed(node['items'], schema)}>"
    values = node.get("enum", [node.get("const")])
    return {"boolean": "boolean", "integer": "bigint", "number": "double"}.get(node.get("type"), "boolean" if isinstance(values[0], bool) else "string")


def _keeps(node: dict, schema: dict, c: Column) -> Column:
    """If a value of the node's type keeps its rules; null where that is not told."""
    node, nullable = _inner(node, schema)
    if node.get("type") == "object":
        own = node["properties"]
        rules = [_keeps(x, schema, c[k]) for k, x in own.items()]
        if {"value", "source", "confirmed"} <= set(own):
            rules.append(c["confirmed"] == (c["source"] == "confirmed_by_user"))
        if {"model_score", "source"} <= set(own):
            rules.append(c["model_score"].isNull() == (c["source"] != "extracted_by_model"))
    elif node.get("type") == "array":
        rules = [F.forall(c, lambda x: _keeps(node["items"], schema, x))]
        rules += [F.size(c) >= node["minItems"]] if "minItems" in node else []
        rules += [F.size(c) <= node["maxItems"]] if "maxItems" in node else []
    elif "const" in node or "enum" in node:
        rules = [c.isin(node.get("enum", [node.get("const")]))]
    else:
        told = {"minLength": lambda x: F.length(c) >= x, "pattern": c.rlike, "minimum": lambda x: c >= x, "maximum": lambda x: c <= x}
        rules = [rule(node[k]) for k, rule in told.items() if k in node]
    rules = [c.isNotNull(), *rules]
    while len(rules) > 1:  # in halves, so that the expression is not deep
        rules = [rules[k] & rules[k + 1] if k + 1 < len(rules) else rules[k] for k in range(0, len(rules), 2)]
    (ok,) = rules
    return c.isNull() | ok if nullable else ok


def _typed_whole(node: dict) -> bool:
    """If typed() can tell all that the node says: objects with all of their keys and no others."""
    if node.get("type") == "object" and (node.get("additionalProperties") is not False or set(node.get("required", [])) != set(node["properties"])):
        return False
    return all(_typed_whole(x) for x in [*node.get("properties", {}).values(), *node.get("oneOf", []), *([node["items"]] if "items" in node else [])])


def sound(schema: dict, raw: Column) -> Column:
    """True for documents that break no rule of the schema, told fast; false for others and for those not told.

    A text that comes back the same when it is read by the schema's type and written again has just the schema's keys, in
    its order, with values of their types, so only the values are left to look at. Any other goes the long way.
    """
    out = F.lit(False)
    for x in (resolved(y, schema) for y in schema.get("oneOf", [])):
        kind = x.get("properties", {}).get("document_type", {}).get("const")
        if kind is not None and _typed_whole(x):
            same = lambda d: F.to_json(d, {"ignoreNullFields": "false"}) == raw
            told = S.once(F.from_json(raw, typed(x, schema)), lambda d: F.coalesce(same(d) & _keeps(x, schema, d), F.lit(False)))
            out = F.when(raw.startswith(f'{{"document_type":"{kind}"'), told).otherwise(out)
    return F.coalesce(out, F.lit(False))


# --- what the schema cannot say ---------------------------------------------------------------------------------------

_READ = (
    "document_type string, quality_gate struct<status:string,issues:array<struct<severity:string,affected_fields:array<string>>>>, "
    "corrections array<struct<decision:string,applied:boolean,proposed_value:struct<source:string>,user_confirmation:struct<source:string>>>, audit_trail array<struct<sequence:int>>, "
    "geocoding struct<status:string,consent:boolean,provider:string,precision:string,latitude:struct<value:double>,longitude:struct<value:double>,components:array<struct<field:string>>,error_code:string>"
)


def semantics(d: Column) -> Column:
    """The rules of a response that has the right shape: what it breaks as an array of (path, rule)."""
    issues, geo = d["quality_gate"]["issues"], d["geocoding"]
    severe = F.exists(issues, lambda x: x["severity"] == "high")
    status = F.when(severe, "TIDAK_VALID").when(F.size(issues) > 0, "PERLU_KONFIRMASI").otherwise("SIAP_DIPROSES")
    administrative = F.array(*map(F.lit, S.ADMIN_FIELDS))
    critical = F.forall(issues, lambda x: (x["severity"] != "high") | (F.size(F.array_except(x["affected_fields"], administrative)) == 0))
    decided = F.forall(d["corrections"], lambda c: F.when(c["decision"] == "confirmed", c["user_confirmation"].isNotNull() & c["applied"] & (c["proposed_value"]["source"] == "confirmed_by_user")).otherwise(c["user_confirmation"].isNull() & ~c["applied"]))
    trail = F.transform(d["audit_trail"], lambda a: a["sequence"])
    contiguous = F.forall(F.transform(trail, lambda s, i: s == i + 1), lambda x: x)
    given = lambda *names: [geo[n].isNotNull() for n in names]
    none_of = lambda *names: ~reduce(lambda a, b: a | b, given(*names))
    filled = lambda n: F.coalesce(geo[n], F.lit("")) != ""
    bare = F.size(geo["components"]) == 0
    state = (
        F.when(geo["status"] == "NOT_REQUESTED", ~geo["consent"] & none_of("provider", "precision", "latitude", "longitude", "error_code") & bare)
        .when(geo["status"] == "EXTERNAL_FAILURE", geo["consent"] & filled("provider") & filled("error_code") & none_of("latitude", "longitude") & bare)
        .when(geo["status"] == "SUCCESS", geo["consent"] & filled("provider") & geo["latitude"].isNotNull() & geo["longitude"].isNotNull() & geo["error_code"].isNull())
        .otherwise(geo["consent"] & geo["error_code"].isNull())
    )
    rules = [("$.quality_gate.status", "status_agrees", d["quality_gate"]["status"] == status), ("$.quality_gate.issues", "high_is_administrative", critical), ("$.corrections", "correction_state", decided), ("$.audit_trail", "contiguous_sequence", contiguous), ("$.geocoding", "geocoding_state", state)]
    return F.concat(*[_unless(ok, F.lit(path), rule) for path, rule, ok in rules])


def violations(documents: DataFrame, key: str = "address_id", column: str = "document", schema: dict = SCHEMA) -> DataFrame:
    """(key, path, rule) for each rule that a document breaks.

    Text that is no JSON breaks json alone; a key confidence anywhere is forbidden; a response's further rules are
    looked at where its shape is right. Null documents are no JSON.
    """
    df = documents.select(key, F.col(column).alias("_raw")).withColumn("_sound", sound(schema, F.col("_raw")))
    df = df.withColumn("_v", F.when(~F.col("_sound"), F.try_parse_json("_raw")))
    df = df.withColumn("_shape", F.when(F.col("_sound"), _none()).when(F.col("_v").isNull(), _broken(F.lit("$"), "json")).otherwise(compiled(schema, schema, F.col("_v"), F.lit("$"))))
    # Quotes inside a string are escaped, so this finds keys alone.
    forbidden = F.when(F.col("_raw").rlike('(?<!\\\\)"confidence"\\s*:'), _broken(F.lit("$"), "forbidden_key")).otherwise(_none())
    response = F.when(F.col("_sound"), F.col("_raw").startswith('{"document_type":"address_parse_response"')).otherwise(F.try_variant_get("_v", "$.document_type", "string") == "address_parse_response")
    meaning = F.when((F.size("_shape") == 0) & response, _let(F.from_json("_raw", _READ), semantics)).otherwise(_none())
    return df.select(key, F.explode(F.concat("_shape", forbidden, meaning)).alias("b")).select(key, "b.path", "b.rule")
