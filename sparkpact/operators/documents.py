"""Contracts over JSON text: validation and repair of documents that typed columns can't hold."""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.hashing import at_pointer, canonical_json, unescape_pointer
from ..functions.lineage import spread
from ..plans.validator import Validator

ERRORS = "array<struct<keyword:string,schema_path:string,instance_path:string>>"
_PA_ERRORS = pa.list_(pa.struct([("keyword", pa.string()), ("schema_path", pa.string()), ("instance_path", pa.string())]))


def _fields(df: DataFrame, keys: list[str]) -> str:
    return ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)


def parsed(text: str | None):
    """The document, and whether there is one: not where the text is null, malformed or too deep to parse."""
    try:
        return (json.loads(text), True) if text is not None else (None, False)
    except (ValueError, RecursionError):
        return None, False


def _one(keyword: str) -> list[dict]:
    return [{"keyword": keyword, "schema_path": "#", "instance_path": ""}]


def checked(validator: Validator, text: str | None) -> list[dict]:
    """The errors of a text: `parse` where there is no document, `depth` where document and contract nest too deeply."""
    value, ok = parsed(text)
    if not ok:
        return _one("parse")
    try:
        return [vars(e) for e in validator.errors(value)]
    except RecursionError:
        return _one("depth")


def validate_documents(df: DataFrame, schema, keys: list[str], column: str = "doc", formats: bool = False, registry: dict | None = None) -> DataFrame:
    """keys, valid and errors of each JSON text. A null or malformed text has one error, `parse`; one too deep `depth`."""

    def run(batches):
        validator = Validator(schema, formats, dict(registry or {}))
        for b in batches:
            found = [checked(validator, text) for text in b.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), pa.array([not f for f in found]), pa.array(found, _PA_ERRORS)], [*keys, "valid", "errors"])

    return spread(df.select(*dict.fromkeys([*keys, column]))).mapInArrow(run, f"{_fields(df, keys)}, valid boolean, errors {ERRORS}")


MINIMAL = {"string": "", "integer": 0, "number": 0, "boolean": False, "object": {}, "array": [], "null": None}


def witness(schema):
    """The least value to put in a place: default, const, first enum, else the minimal one of the type."""
    if not isinstance(schema, dict):
        return None
    for key in ("default", "const"):
        if key in schema:
            return schema[key]
    if schema.get("enum"):
        return schema["enum"][0]
    kind = schema.get("type", "null")
    return json.loads(json.dumps(MINIMAL[kind if isinstance(kind, str) else kind[0]]))


def rename_candidates(rules: dict, offending: str, parent: dict) -> list[str]:
    """Names of a closed enumeration that an offending property may take, in order.

    None for a property that others depend on or that is required; under a closed object only names that it admits.
    """
    names = rules.get("propertyNames")
    options = names.get("enum", []) if isinstance(names, dict) else []
    tied = {*rules.get("required", []), *rules.get("dependentRequired", {}), *rules.get("dependentSchemas", {}), *(n for v in rules.get("dependentRequired", {}).values() for n in v)}
    if offending in tied:
        return []
    closed = rules.get("additionalProperties") is False or rules.get("unevaluatedProperties") is False
    admitted = lambda n: n in rules.get("properties", {}) or any(re.search(p, n) for p in rules.get("patternProperties", {}))
    return sorted(n for n in options if isinstance(n, str) and n not in parent and (not closed or admitted(n)))


def rename_holds(validator: Validator, document, place: str, old: str, new: str) -> bool:
    """Whether a rename brings no new failure of dependencies at or below the object, and none of oneOf at the object."""
    draft = json.loads(json.dumps(document))
    parent = at_pointer(draft, place)
    if not isinstance(parent, dict) or old not in parent:
        return False
    parent[new] = parent.pop(old)
    own = place.removeprefix("#")
    before = set(validator.errors(document))
    fresh = [e for e in validator.errors(draft) if e not in before]
    tied = [e for e in fresh if (e.keyword.startswith("dependent") or "/dependentSchemas/" in e.schema_path) and f"{e.instance_path}/".startswith(f"{own}/")]
    return not tied and not any(e.keyword == "oneOf" and e.instance_path == own for e in fresh)


def _fix(validator: Validator, document, e) -> tuple[object, str] | None:
    """One error's action on a document, in place where it can be."""
    tokens = [unescape_pointer(t) for t in e.instance_path.split("/")[1:]]
    where = e.schema_path.split("/")
    owner_path = "/".join(where[:-2] if e.keyword in ("dependentRequired",) else where[:-1])
    try:
        rules = validator.root if owner_path == "#" else at_pointer(validator.root, owner_path)
        value = at_pointer(document, "#" + e.instance_path) if e.keyword != "required" else None
    except KeyError:
        return None

    def put(new):
        nonlocal document
        if not tokens:
            return new
        parent = at_pointer(document, "#" + e.instance_path.rsplit("/", 1)[0])
        parent[int(tokens[-1]) if isinstance(parent, list) else tokens[-1]] = new
        return document

    k = e.keyword
    if k in ("type", "enum", "const"):
        return put(witness({x: rules[x] for x in ("const", "enum", "type") if x in rules})), {"type": "replaceType", "enum": "replaceEnum", "const": "replaceConst"}[k]
    if k == "required":
        return put(witness(rules.get("properties", {}).get(tokens[-1], {"type": "null"}))), "addRequiredDefault"
    if k in ("additionalProperties", "unevaluatedProperties", "propertyNames"):
        place = "#" + e.instance_path.rsplit("/", 1)[0]
        parent = at_pointer(document, place)
        for name in rename_candidates(rules, tokens[-1], parent):
            if rename_holds(validator, document, place, tokens[-1], name):
                parent[name] = parent.pop(tokens[-1])
                return document, "renameProperty"
        del parent[tokens[-1]]
        return document, "removeAdditionalProperty"
    if k == "minLength":
        return put(value + "a" * (rules[k] - len(value))), "stringPadTruncate"
    if k == "maxLength":
        return put(value[: rules[k]]), "stringPadTruncate"
    if k in ("minimum", "maximum"):
        return put(rules[k]), "numericClamp"
    if k in ("exclusiveMinimum", "exclusiveMaximum"):
        import math

        up, bound = k == "exclusiveMinimum", rules[k]
        whole = rules.get("type") == "integer"
        return put((math.floor(bound) + 1 if up else math.ceil(bound) - 1) if whole else bound + (1e-12 if up else -1e-12)), "numericNudge"
    if k == "pattern":
        from ..plans.compose import pattern_witness

        found = pattern_witness(rules[k])
        return None if found is None else (put(found), "replacePattern")
    if k == "multipleOf":
        return put(round(value / rules[k]) * rules[k]), "multipleOfSnap"
    if k == "uniqueItems":
        return put(list({canonical_json(x): x for x in reversed(value)}.values())[::-1]), "uniqueItemsDedup"
    if k == "maxItems":
        return put(value[: rules[k]]), "maxItemsTrim"
    if k == "minItems":
        return put(value + [witness(rules.get("items", {})) for _ in range(rules[k] - len(value))]), "minItemsGrow"
    if k == "contains":
        n = sum(validator.is_valid(x, rules["contains"]) for x in value)
        least, most = rules.get("minContains", 1), rules.get("maxContains")
        if n < least:
            return put(value + [witness(rules["contains"]) for _ in range(least - n)]), "containsAdjust"
        keep, out = most, []
        for x in value:
            fits = validator.is_valid(x, rules["contains"])
            if not fits or keep:
                out.append(x)
                keep -= fits
        return put(out), "containsAdjust"
    return None


#: Fixed order of a cycle's passes.
PASSES = ("type", "enum", "const", "required", "minLength", "maxLength", "uniqueItems", "maxItems", "minItems", "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "contains", "pattern", "multipleOf", "propertyNames", "additionalProperties", "unevaluatedProperties")


def repair_document(validator: Validator, document, attempts: int = 5) -> tuple[object, list[tuple[str, str, str]]]:
    """Bounded cycles of error-driven actions; each cycle goes back if the distinct errors don't become fewer."""
    actions: list[tuple[str, str, str]] = []
    errors = validator.errors(document)
    for _ in range(max(1, min(5, attempts))):
        if not errors:
            break
        draft, taken = json.loads(json.dumps(document)), []
        for e in sorted(errors, key=lambda e: PASSES.index(e.keyword) if e.keyword in PASSES else len(PASSES)):
            try:
                done = _fix(validator, draft, e)
            except (KeyError, IndexError, TypeError):  # an earlier action has moved or removed the place
                continue
            if done:
                draft = done[0]
                taken.append((done[1], e.keyword, e.instance_path))
        now = validator.errors(draft)
        if not taken or len(set(now)) >= len(set(errors)):
            break
        document, errors = draft, now
        actions += taken
    return document, actions


def repair_documents(df: DataFrame, schema, keys: list[str], column: str = "doc", attempts: int = 5) -> DataFrame:
    """keys, the repaired text, valid, and the audit rows of each JSON text. Malformed and too deep texts stay as they are."""

    def run(batches):
        validator = Validator(schema)
        for b in batches:
            texts, valid, audit = [], [], []
            for text in b.column(column).to_pylist():
                value, ok = parsed(text)
                try:
                    done, actions = repair_document(validator, value, attempts) if ok else (None, [])
                    good = ok and validator.is_valid(done)
                except RecursionError:
                    actions, good = [], False
                texts.append(canonical_json(done) if actions else text)
                valid.append(good)
                audit.append([dict(zip(("keyword", "schema_path", "instance_path"), (k, a, p))) for a, k, p in actions])
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), pa.array(texts, pa.string()), pa.array(valid), pa.array(audit, _PA_ERRORS)], [*keys, column, "valid", "actions"])

    return spread(df.select(*dict.fromkeys([*keys, column]))).mapInArrow(run, f"{_fields(df, keys)}, {column} string, valid boolean, actions {ERRORS}")
