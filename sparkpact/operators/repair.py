"""Repair of typed rows: each violated keyword rewrites its column, in bounded passes, with audit rows and a revert rule.

Pass order: shape (type, enum, const), required defaults, string length, arrays, numeric bounds, contains, pattern,
multipleOf and names of maps. All rewrites are Column expressions, so a pass is one projection. Nested structs are
repaired field by field.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashing import escape_pointer
from .predicates import EPSILON, Compiler, _reserve, errors_column, json_type, row_rules, score

MINIMAL = {"string": "", "integer": 0, "number": 0.0, "boolean": False}
#: Fixed tiers: 1 changes a value within its shape, 2 changes structure.
TIERS = {"type": 1, "enum": 1, "const": 1, "minLength": 1, "maxLength": 1, "minimum": 1, "maximum": 1, "exclusiveMinimum": 1, "exclusiveMaximum": 1, "multipleOf": 1, "pattern": 1, "uniqueItems": 1, "minItems": 2, "maxItems": 2, "contains": 2, "required": 2, "additionalProperties": 2, "propertyNames": 2}


@dataclass(frozen=True)
class Rewrite:
    """One keyword's action on a column: when it applies, and the new value."""

    action: str
    keyword: str
    when: Column
    value: Column


def clamp(v: Column, schema: dict, whole: bool) -> Column:
    out = v
    if "minimum" in schema:
        out = F.greatest(out, F.lit(schema["minimum"]).cast("double"))
    if "maximum" in schema:
        out = F.least(out, F.lit(schema["maximum"]).cast("double"))
    return F.floor(out) if whole and schema.get("minimum", 0) == int(schema.get("minimum", 0)) else out


def nudge(v: Column, schema: dict, whole: bool) -> Column:
    out = v
    if "exclusiveMinimum" in schema:
        m = schema["exclusiveMinimum"]
        out = F.when(out <= m, F.floor(F.lit(m)) + 1 if whole else F.lit(float(m)) + EPSILON).otherwise(out)
    if "exclusiveMaximum" in schema:
        m = schema["exclusiveMaximum"]
        out = F.when(out >= m, F.ceil(F.lit(m)) - 1 if whole else F.lit(float(m)) - EPSILON).otherwise(out)
    return out


def snap(v: Column, step: float) -> Column:
    """The nearest multiple."""
    return F.round(v / F.lit(float(step))) * F.lit(float(step))


def pad_or_cut(v: Column, schema: dict) -> Column:
    out = v
    if "minLength" in schema:
        out = F.when(F.char_length(out) < schema["minLength"], F.rpad(out, schema["minLength"], "a")).otherwise(out)
    if "maxLength" in schema:
        out = F.substring(out, 1, schema["maxLength"])
    return out


def first_occurrences(v: Column) -> Column:
    return F.array_distinct(v)


def grow(v: Column, least: int, filler: Column) -> Column:
    return F.when(F.size(v) < least, F.concat(v, F.array_repeat(filler, F.greatest(F.lit(least) - F.size(v), F.lit(0))))).otherwise(v)


def filler_of(schema) -> object:
    """The value to add where one is missing: default, const, first enum value, then the least of the type."""
    if not isinstance(schema, dict):
        return None
    for key in ("default", "const"):
        if key in schema:
            return schema[key]
    if schema.get("enum"):
        return schema["enum"][0]
    kind = schema.get("type", "string")
    return MINIMAL.get(kind if isinstance(kind, str) else kind[0], "")


def rewrites(schema: dict, v: Column, kind: T.DataType, witness: str | None = None) -> list[Rewrite]:
    """The actions on one column in pass order; each reads the value that the one before left."""
    compiler, own, out = Compiler(), json_type(kind), []
    whole = own == "integer"

    def bad(keyword: str, value: Column) -> Column:
        keep = {k: schema[k] for k in ([keyword, "minContains", "maxContains"] if keyword == "contains" else [keyword]) if k in schema}
        return ~compiler.ok(keep, value, kind)

    def add(action: str, keyword: str, value) -> None:
        nonlocal v
        r = Rewrite(action, keyword, bad(keyword, v), value(v).cast(kind))
        out.append(r)
        v = F.when(r.when, r.value).otherwise(v)

    if "type" in schema and own == "number":  # the one mismatch that a typed column's values can have
        add("replaceType", "type", lambda x: F.lit(filler_of({"type": schema["type"]})))
    if "enum" in schema:
        add("replaceEnum", "enum", lambda x: F.lit(schema["enum"][0]))
    if "const" in schema:
        add("replaceConst", "const", lambda x: F.lit(schema["const"]))
    if own == "string":
        for key in ("minLength", "maxLength"):
            if key in schema:
                add("stringPadTruncate", key, lambda x, key=key: pad_or_cut(x, {key: schema[key]}))
        if "pattern" in schema and witness is not None:
            add("replacePattern", "pattern", lambda x: F.lit(witness))
    elif own == "array":
        if schema.get("uniqueItems"):
            add("uniqueItemsDedup", "uniqueItems", first_occurrences)
        if "maxItems" in schema:
            add("maxItemsTrim", "maxItems", lambda x: F.slice(x, 1, schema["maxItems"]))
        if "minItems" in schema:
            add("minItemsGrow", "minItems", lambda x: grow(x, schema["minItems"], F.lit(filler_of(schema.get("items", {}))).cast(kind.elementType)))
        if "contains" in schema:
            least = schema.get("minContains", 1)
            fits = lambda x: F.filter(x, lambda e: compiler.ok(schema["contains"], e, kind.elementType))
            missing = lambda x: F.greatest(F.lit(least) - F.size(fits(x)), F.lit(0))
            more = lambda x: F.concat(x, F.array_repeat(F.lit(filler_of(schema["contains"])).cast(kind.elementType), missing(x)))
            if "maxContains" in schema:
                fewer = lambda x: _first_matching(x, schema["maxContains"], lambda e: compiler.ok(schema["contains"], e, kind.elementType))
                add("containsAdjust", "contains", lambda x: F.when(F.size(fits(x)) > schema["maxContains"], fewer(x)).otherwise(more(x)))
            else:
                add("containsAdjust", "contains", more)
    elif own in ("integer", "number"):
        for key in ("minimum", "maximum"):
            if key in schema:
                add("numericClamp", key, lambda x, key=key: clamp(x, {key: schema[key]}, whole))
        for key in ("exclusiveMinimum", "exclusiveMaximum"):
            if key in schema:
                add("numericNudge", key, lambda x, key=key: nudge(x, {key: schema[key]}, whole))
        if "multipleOf" in schema:
            add("multipleOfSnap", "multipleOf", lambda x: snap(x, schema["multipleOf"]))
    elif isinstance(kind, T.MapType):
        for key in ("propertyNames", "additionalProperties"):
            if key == "propertyNames" and key in schema:
                add("removeAdditionalProperty", key, lambda x: F.map_filter(x, lambda k, _: compiler.ok(schema["propertyNames"], k, T.StringType())))
            elif key == "additionalProperties" and schema.get(key) is False:
                own_keys = {k: schema[k] for k in ("properties", "patternProperties") if k in schema}
                add("removeAdditionalProperty", key, lambda x: F.map_filter(x, lambda k, _: _known(own_keys, k)))
    return out


def _known(schema: dict, name: Column) -> Column:
    out = name.isin(*schema["properties"]) if schema.get("properties") else F.lit(False)
    for p in schema.get("patternProperties", {}):
        out = out | name.rlike(p)
    return out


def _first_matching(v: Column, most: int, fits) -> Column:
    """An array without the matching items after the first `most`."""
    start = F.struct(F.lit(0).alias("n"), F.slice(v, 1, 0).alias("kept"))

    def step(acc, x):
        hit = fits(x).cast("int")
        stays = (hit == 0) | (acc["n"] < most)
        return F.struct((acc["n"] + hit).alias("n"), F.when(stays, F.concat(acc["kept"], F.array(x))).otherwise(acc["kept"]).alias("kept"))

    return F.aggregate(v, start, step, lambda acc: acc["kept"])


def nested(schema: dict, v: Column, kind: T.StructType, path: str, max_tier: int, witnesses: dict[str, str]) -> tuple[Column, list[tuple[Column, str, str, str]]]:
    """A struct with its fields repaired, and (when, action, keyword, instance path) of each action."""
    fields, actions = [], []
    for f in kind:
        s, x = schema.get("properties", {}).get(f.name), v[f.name]
        if isinstance(s, dict):
            x, own = repaired(s, x, f.dataType, f"{path}/{escape_pointer(f.name)}", f.name in schema.get("required", []), max_tier, witnesses)
            actions += [(v.isNotNull() & w, *rest) for w, *rest in own]
        fields.append(x.alias(f.name))
    return (F.when(v.isNotNull(), F.struct(*fields)) if actions else v), actions


def repaired(schema: dict, v: Column, kind: T.DataType, path: str, required: bool, max_tier: int, witnesses: dict[str, str]) -> tuple[Column, list[tuple[Column, str, str, str]]]:
    """One value with all its rewrites, and its actions. witnesses: texts for patterns, by instance path without the first slash."""
    actions: list[tuple[Column, str, str, str]] = []
    if required and allowed("required", max_tier) and not isinstance(kind, (T.StructType, T.MapType, T.ArrayType)):
        actions.append((v.isNull(), "addRequiredDefault", "required", path))
        v = F.coalesce(v, F.lit(filler_of(schema)).cast(kind))
    if isinstance(kind, T.StructType):
        v, inner = nested(schema, v, kind, path, max_tier, witnesses)
        return v, actions + inner
    for r in rewrites(schema, v, kind, witnesses.get(path[1:])):
        if allowed(r.keyword, max_tier):
            v = F.when(r.when, r.value).otherwise(v)
            actions.append((r.when, r.action, r.keyword, path))
    return v, actions


ACTION = "struct<action:string,keyword:string,instance_path:string>"


def allowed(keyword: str, max_tier: int = 2, in_valid_motif: bool = False, structural: bool = False) -> bool:
    """The tier policy: structure stays where the motif generates valid rows, unless asked otherwise."""
    tier = TIERS.get(keyword, 2)
    return tier <= max_tier and not (in_valid_motif and tier == 2 and not structural)


def repair(df: DataFrame, schema: dict, attempts: int = 1, max_tier: int = 2, witnesses: dict[str, str] | None = None) -> DataFrame:
    """df with its columns repaired, and `actions`, `score_before`, `score_after`, `reverted`; ValueError if df has these.

    A row whose distinct errors don't become strictly fewer goes back to what it was. Valid rows aren't touched.
    attempts: passes, 1 to 5.
    """
    _reserve(df, "actions", "score_before", "score_after", "reverted", "_original", "_audit")
    properties = {k: s for k, s in schema.get("properties", {}).items() if k in df.columns and isinstance(s, dict)}
    kinds = {f.name: f.dataType for f in df.schema}
    original = F.struct(*[F.col(f"`{c}`") for c in properties]) if properties else F.lit(None)
    out = df.withColumn("_original", original).withColumn("score_before", score(errors_column(row_rules(df, schema))))
    out = out.withColumn("actions", F.array().cast(f"array<{ACTION}>"))
    for _ in range(max(1, min(5, attempts))):
        found, actions = {}, []
        for name, s in properties.items():
            v, own = repaired(s, F.col(f"`{name}`"), kinds[name], f"/{escape_pointer(name)}", name in schema.get("required", []), max_tier, witnesses or {})
            actions += own
            if own:
                found[name] = F.when(F.col("score_before") > 0, v).otherwise(F.col(f"`{name}`"))
        audit = F.array_compact(F.array(*[F.when((F.col("score_before") > 0) & w, F.struct(F.lit(a).alias("action"), F.lit(k).alias("keyword"), F.lit(p).alias("instance_path"))) for w, a, k, p in actions])) if actions else F.array().cast(f"array<{ACTION}>")
        out = out.withColumns({"_audit": audit, **{f"_new_{k}": v for k, v in found.items()}})
        out = out.withColumns({k: F.col(f"`_new_{k}`") for k in found} | {"actions": F.concat("actions", "_audit")}).drop("_audit", *[f"_new_{k}" for k in found])
    out = out.withColumn("score_after", score(errors_column(row_rules(out.select(*[f"`{c}`" for c in df.columns]), schema))))
    worse = (F.col("score_before") > 0) & (F.col("score_after") >= F.col("score_before"))
    back = {k: F.when(worse, F.col(f"_original.`{k}`")).otherwise(F.col(f"`{k}`")) for k in properties}
    return out.withColumns(back | {"reverted": worse}).drop("_original")


def nudge_detail(whole: bool, up: bool, digits: int = 12) -> dict:
    """What an audit row says of a nudge: by one, or by an epsilon of 1 to 12 digits."""
    return {"delta": 1 if up else -1} if whole else {"epsilon": f"1e-{digits}"}


def budget_exhausted(repaired_: DataFrame, attempts: int) -> DataFrame:
    """A diagnostic for each row that is still invalid though every pass was used: the row's columns with code, phase, cycles, last_errors."""
    left = repaired_.where((F.col("score_before") > 0) & (F.col("score_after") > 0))
    return left.withColumns({"code": F.lit("UNSAT_BUDGET_EXHAUSTED"), "phase": F.lit("repair"), "cycles": F.lit(max(1, min(5, attempts))), "last_errors": F.col("score_after")})


def usage(repaired: DataFrame, motif: Column) -> DataFrame:
    """Items, items with a repair, and actions by motif."""
    n = F.size("actions").cast("long")
    return repaired.groupBy(motif.alias("motif")).agg(F.count("*").alias("items"), F.count_if(n > 0).alias("items_with_repair"), F.sum(n).alias("actions"))
