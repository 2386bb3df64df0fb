"""Contracts over typed columns: every keyword as a Catalyst predicate, violations as rows.

A contract is a JSON Schema whose root describes a row. It is compiled once; nothing of the data comes to the driver.
NULL in a typed column is a missing property: `required` fails on it and every other keyword passes.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashing import escape_pointer

EPSILON = 1e-12
# Fixed patterns of the named formats.
FORMATS = {
    "email": r"^[^\s@]+@[^\s@]+\.[^\s@]+$",
    "uri": r"^[A-Za-z][A-Za-z0-9+.-]*:[^\s]+$",
    "uuid": r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    "date-time": r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})?$",
    "date": r"^\d{4}-\d{2}-\d{2}$",
    "ipv4": r"^((25[0-5]|2[0-4]\d|1?\d?\d)(\.|$)){4}$",
}


@dataclass(frozen=True)
class Rule:
    """One keyword at one place: true where the row passes.

    Below array items and map entries one rule can fail at many places: `places` then gives all of them, and
    `instance_path` only names them together.
    """

    keyword: str
    schema_path: str
    instance_path: str
    passes: Column
    places: Column | None = None

    def failures(self) -> Column:
        return (~self.passes).cast("long") if self.places is None else F.size(self.places).cast("long")


class Unsupported(ValueError):
    """A keyword that needs the generic validator."""


_NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def json_type(kind: T.DataType) -> str:
    if isinstance(kind, (T.StructType, T.MapType)):
        return "object"
    if isinstance(kind, T.ArrayType):
        return "array"
    if isinstance(kind, T.BooleanType):
        return "boolean"
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "integer"
    return "number" if isinstance(kind, _NUMBERS) else "string"


def _literal(value):
    if isinstance(value, list):
        return F.array(*[_literal(v) for v in value])
    return F.lit(value)


def _all(parts: list[Column]) -> Column:
    out = F.lit(True)
    for p in parts:
        out = out & p
    return out


class Compiler:
    def __init__(self, formats: bool = True):
        self.formats = formats

    def ok(self, schema, value: Column, kind: T.DataType) -> Column:
        """Whether a value passes a whole schema; never null."""
        return _all([r.passes for r in self.rules(schema, value, kind, "#", "")])

    def rules(self, schema, value: Column, kind: T.DataType, at: str = "#", path: str = "", present: Column | None = None) -> list[Rule]:
        if schema is True or schema == {}:
            return []
        out: list[Rule] = []
        there = value.isNotNull() if present is None else present

        def add(keyword: str, passes: Column, where: str | None = None):
            out.append(Rule(keyword, f"{at}/{where or keyword}", path, F.coalesce(~there | passes, F.lit(True))))

        if schema is False:
            out.append(Rule("false schema", at, path, ~there))
            return out
        own = json_type(kind)
        for key in ("$ref", "$dynamicRef", "$recursiveRef", "unevaluatedProperties", "unevaluatedItems"):
            if key in schema:
                raise Unsupported(key)
        if "type" in schema:
            allowed = [schema["type"]] if isinstance(schema["type"], str) else schema["type"]
            if own in allowed or own == "integer" and "number" in allowed:
                pass
            elif own == "number" and "integer" in allowed:
                add("type", value == F.floor(value))
            else:
                add("type", F.lit(False))
        if "enum" in schema:
            add("enum", self._among(value, own, schema["enum"]))
        if "const" in schema:
            add("const", self._among(value, own, [schema["const"]]))
        if own in ("integer", "number"):
            self._numeric(schema, value, add)
        elif own == "string":
            self._text(schema, value if isinstance(kind, T.StringType) else value.cast("string"), add)
        elif own == "array":
            out += self._array(schema, value, kind, at, path, add)
        elif own == "object":
            out += self._object(schema, value, kind, at, path, add, there)
        return out + self._composed(schema, value, kind, at, path, add, there)

    @staticmethod
    def _among(value: Column, own: str, options: list) -> Column:
        fits = {"string": str, "boolean": bool, "integer": (int, float), "number": (int, float), "array": list}.get(own)
        same = [v for v in options if fits and isinstance(v, fits) and (own == "boolean" or not isinstance(v, bool))]
        if not same:
            return F.lit(False)
        if own == "array":
            found = F.lit(False)
            for v in same:
                found = found | (value == _literal(v))
            return found
        return value.isin(*same)

    @staticmethod
    def _numeric(schema, v: Column, add) -> None:
        if "minimum" in schema:
            add("minimum", v >= schema["minimum"])
        if "maximum" in schema:
            add("maximum", v <= schema["maximum"])
        if "exclusiveMinimum" in schema:
            add("exclusiveMinimum", v > schema["exclusiveMinimum"])
        if "exclusiveMaximum" in schema:
            add("exclusiveMaximum", v < schema["exclusiveMaximum"])
        if "multipleOf" in schema:
            ratio = v.cast("double") / F.lit(float(schema["multipleOf"]))
            add("multipleOf", F.abs(ratio - F.round(ratio)) < EPSILON)

    def _text(self, schema, v: Column, add) -> None:
        if "minLength" in schema:
            add("minLength", F.char_length(v) >= schema["minLength"])
        if "maxLength" in schema:
            add("maxLength", F.char_length(v) <= schema["maxLength"])
        if "pattern" in schema:
            add("pattern", v.rlike(schema["pattern"]))
        if self.formats and schema.get("format") in FORMATS:
            add("format", v.rlike(FORMATS[schema["format"]]))

    def _array(self, schema, v: Column, kind, at, path, add) -> list[Rule]:
        element = kind.elementType
        prefix = schema.get("prefixItems", [])
        each = lambda s: lambda x: self.ok(s, x, element)
        if "minItems" in schema:
            add("minItems", F.size(v) >= schema["minItems"])
        if "maxItems" in schema:
            add("maxItems", F.size(v) <= schema["maxItems"])
        if schema.get("uniqueItems"):
            add("uniqueItems", F.size(F.array_distinct(v)) == F.size(v))
        if "contains" in schema:
            n = F.size(F.filter(v, each(schema["contains"])))
            least, most = schema.get("minContains", 1), schema.get("maxContains")
            add("contains", n >= least if most is None else (n >= least) & (n <= most))
        out: list[Rule] = []
        for k, s in enumerate(prefix):
            there = F.coalesce(F.size(v) > k, F.lit(False))
            out += self.rules(s, F.get(v, k), element, f"{at}/prefixItems/{k}", f"{path}/{k}", present=there)
        if "items" in schema:
            n, sub = len(prefix), schema["items"]
            rest = F.slice(v, n + 1, F.greatest(F.size(v), F.lit(1))) if n else v
            entry = lambda x, i: F.struct((i + n).cast("string").alias("name"), x.alias("value"))
            passes = F.size(v) <= n if sub is False else F.forall(rest, each(sub))
            out += self._below(sub, F.transform(rest, entry), element, f"{at}/items", path, passes)
        return out

    def _below(self, schema, entries: Column, kind, at: str, path: str, passes: Column) -> list[Rule]:
        """The rules of a schema that every entry (name, value) is under: each with all the places at which it fails.

        Whether a row passes is decided by `passes`, without building places, in the first of these rules.
        """
        place = lambda e: F.concat(F.lit(path + "/"), escaped(e["name"]))
        rules = lambda e: self.rules(schema, e["value"], kind, at, "", present=F.lit(True))
        out = []

        def failing(k: int) -> Callable[[Column], Column]:
            def at_entry(e):
                r = rules(e)[k]
                if r.places is not None:
                    return F.transform(r.places, lambda deeper: F.concat(place(e), deeper))
                return F.when(~r.passes, F.array(F.concat(place(e), F.lit(r.instance_path)))).otherwise(F.array().cast("array<string>"))

            return at_entry

        for k, shape in enumerate(rules(F.struct(F.lit("").alias("name"), F.lit(None).cast(kind).alias("value")))):
            places = F.coalesce(F.flatten(F.transform(entries, failing(k))), F.array().cast("array<string>"))
            out.append(Rule(shape.keyword, shape.schema_path, f"{path}/*{shape.instance_path}", F.lit(True) if k else F.coalesce(passes, F.lit(True)), places))
        return out

    def _object(self, schema, v: Column, kind, at, path, add, there) -> list[Rule]:
        out: list[Rule] = []
        properties, patterns = schema.get("properties", {}), schema.get("patternProperties", {})
        if isinstance(kind, T.MapType):
            keys, has, get = F.map_keys(v), lambda k: F.array_contains(F.map_keys(v), k), lambda k: v[k]
            field_type = lambda k: kind.valueType
        else:
            names = kind.fieldNames()
            get = lambda k: v[k] if k in names else F.lit(None)
            has = lambda k: get(k).isNotNull() if k in names else F.lit(False)
            field_type = lambda k: kind[k].dataType if k in names else T.StringType()
            keys = F.array_compact(F.array(*[F.when(v[k].isNotNull(), F.lit(k)) for k in names]))
        for k in schema.get("required", []):
            out.append(Rule("required", f"{at}/required", f"{path}/{escape_pointer(k)}", F.coalesce(~there | has(k), F.lit(True))))
        for k, s in properties.items():
            if isinstance(kind, T.MapType) or k in kind.fieldNames():
                out += self.rules(s, get(k), field_type(k), f"{at}/properties/{escape_pointer(k)}", f"{path}/{escape_pointer(k)}", present=F.coalesce(there & has(k), F.lit(False)))
        if "minProperties" in schema:
            add("minProperties", F.size(keys) >= schema["minProperties"])
        if "maxProperties" in schema:
            add("maxProperties", F.size(keys) <= schema["maxProperties"])
        none = F.array().cast("array<string>")

        def named(keyword: str, fits: Callable[[Column], Column]) -> None:
            """A rule on the names themselves: it fails at each name that doesn't fit."""
            places = F.transform(F.filter(keys, lambda k: ~fits(k)), lambda k: F.concat(F.lit(path + "/"), escaped(k)))
            out.append(Rule(keyword, f"{at}/{keyword}", f"{path}/*", F.coalesce(~there | F.forall(keys, fits), F.lit(True)), F.coalesce(F.when(there, places), none)))

        if "propertyNames" in schema:
            named("propertyNames", lambda k: self.ok(schema["propertyNames"], k, T.StringType()))
        known = lambda k: _any([k.isin(*properties) if properties else F.lit(False), *[k.rlike(p) for p in patterns]])
        rest = schema.get("additionalProperties", True)
        if isinstance(kind, T.MapType):
            of = {f"patternProperties/{escape_pointer(p)}": (s, lambda k, p=p: k.rlike(p)) for p, s in patterns.items()}
            if rest is not True and rest is not False:
                of["additionalProperties"] = (rest, lambda k: ~known(k))
            for where, (s, applies) in of.items():
                own = F.filter(F.map_entries(v), lambda e: applies(e["key"]))
                passes = F.forall(own, lambda e: self.ok(s, e["value"], kind.valueType))
                entries = F.transform(own, lambda e: F.struct(e["key"].alias("name"), e["value"].alias("value")))
                out += self._below(s, F.when(there, entries), kind.valueType, f"{at}/{where}", path, ~there | passes)
        else:
            for k in kind.fieldNames():
                of = {f"patternProperties/{escape_pointer(p)}": s for p, s in patterns.items() if re.search(p, k)}
                if rest is not True and rest is not False and not of and k not in properties:
                    of["additionalProperties"] = rest
                for where, s in of.items():
                    out += self.rules(s, v[k], field_type(k), f"{at}/{where}", f"{path}/{escape_pointer(k)}", present=F.coalesce(there & has(k), F.lit(False)))
        if rest is False:
            named("additionalProperties", known)
        for k, needed in schema.get("dependentRequired", {}).items():
            add("dependentRequired", ~has(k) | _all([has(n) for n in needed]), f"dependentRequired/{escape_pointer(k)}")
        for k, s in schema.get("dependentSchemas", {}).items():
            out += _only(F.coalesce(there & has(k), F.lit(False)), self.rules(s, v, kind, f"{at}/dependentSchemas/{escape_pointer(k)}", path, present=there))
        return out

    def _composed(self, schema, v: Column, kind, at, path, add, there) -> list[Rule]:
        ok = lambda s: self.ok(s, v, kind)
        out: list[Rule] = []
        for k, s in enumerate(schema.get("allOf", [])):
            out += self.rules(s, v, kind, f"{at}/allOf/{k}", path, present=there)
        if "anyOf" in schema:
            add("anyOf", _any([ok(s) for s in schema["anyOf"]]))
        if "oneOf" in schema:
            n = F.lit(0)
            for s in schema["oneOf"]:
                n = n + ok(s).cast("int")
            add("oneOf", n == 1)
        if "not" in schema:
            add("not", ~ok(schema["not"]))
        if "if" in schema and ("then" in schema or "else" in schema):
            held = ok(schema["if"])
            for branch, applies in (("then", held), ("else", ~held)):
                if branch in schema:
                    out += _only(applies, self.rules(schema[branch], v, kind, f"{at}/{branch}", path, present=there))
            add("if", F.when(held, ok(schema.get("then", True))).otherwise(ok(schema.get("else", True))))
        return out


def _only(applies: Column, rules: list[Rule]) -> list[Rule]:
    """Rules that count only where a condition holds."""
    none = F.array().cast("array<string>")
    return [Rule(r.keyword, r.schema_path, r.instance_path, ~applies | r.passes, None if r.places is None else F.when(applies, r.places).otherwise(none)) for r in rules]


def escaped(token: Column) -> Column:
    """A name as a pointer's token."""
    return F.replace(F.replace(token, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def _any(parts: list[Column]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | p
    return out


def row_rules(df: DataFrame, schema, formats: bool = True) -> list[Rule]:
    """The rules of a contract whose root is the row of df.

    Only the columns that the contract names are read, unless it speaks of all properties that are there.
    """
    compiler = Compiler(formats)
    named = _named(schema)
    kind = T.StructType([f for f in df.schema if f.name in named or _speaks_of_all(schema)])
    row = F.struct(*[F.col(f"`{f.name}`") for f in kind]) if len(kind) else F.struct(F.lit(1).alias("_"))
    return compiler.rules(schema, row, kind, present=F.lit(True))


def _in_place(schema) -> list:
    """The schemas that apply to the same value as this one."""
    out = [s for key in ("allOf", "anyOf", "oneOf") for s in schema.get(key, [])]
    return [s for s in (*out, *(schema.get(k) for k in ("not", "if", "then", "else")), *schema.get("dependentSchemas", {}).values()) if isinstance(s, dict)]


def _named(schema) -> set[str]:
    """Property names anywhere in a row's contract."""
    if not isinstance(schema, dict):
        return set()
    out = {*schema.get("properties", {}), *schema.get("required", []), *schema.get("dependentRequired", {}), *schema.get("dependentSchemas", {})}
    out |= {n for v in schema.get("dependentRequired", {}).values() for n in v}
    return out.union(*map(_named, _in_place(schema)))


def _speaks_of_all(schema) -> bool:
    """Whether a row's contract says something of properties that it doesn't name."""
    if not isinstance(schema, dict):
        return False
    own = any(k in schema for k in ("patternProperties", "propertyNames", "minProperties", "maxProperties")) or schema.get("additionalProperties", True) is not True
    return own or any(map(_speaks_of_all, _in_place(schema)))


ERROR = "struct<keyword:string,schema_path:string,instance_path:string>"


def errors_column(rules: list[Rule], first_only: bool = False) -> Column:
    """The violations of a row, in the contract's order."""
    if not rules:
        return F.array().cast(f"array<{ERROR}>")

    def error(r: Rule) -> Callable[[Column], Column]:
        return lambda place: F.struct(F.lit(r.keyword).alias("keyword"), F.lit(r.schema_path).alias("schema_path"), place.alias("instance_path"))

    if all(r.places is None for r in rules):
        found = F.array_compact(F.array(*[F.when(~r.passes, error(r)(F.lit(r.instance_path))) for r in rules]))
    else:
        none = F.array().cast(f"array<{ERROR}>")
        found = F.flatten(F.array(*[F.when(~r.passes, F.array(error(r)(F.lit(r.instance_path)))).otherwise(none) if r.places is None else F.transform(r.places, error(r)) for r in rules]))
    return F.slice(found, 1, 1) if first_only else found


def _reserve(df: DataFrame, *names: str) -> None:
    """The columns an operator adds must not be there already: they would be overwritten."""
    if taken := {n.lower() for n in names} & {c.lower() for c in df.columns}:
        raise ValueError(f"columns {sorted(taken)} are taken: rename them first")


def validate(df: DataFrame, schema, formats: bool = True, first_only: bool = False) -> DataFrame:
    """df with `errors` and `valid`: one projection. ValueError if df has columns of these names."""
    _reserve(df, "errors", "valid")
    return df.withColumn("errors", errors_column(row_rules(df, schema, formats), first_only)).withColumn("valid", F.size("errors") == 0)


def violations(df: DataFrame, schema, keys: list[str], formats: bool = True) -> DataFrame:
    """A row for each violation: keys, keyword, schema_path, instance_path."""
    found = df.select(*keys, F.explode(errors_column(row_rules(df, schema, formats))).alias("e"))
    return found.select(*keys, "e.keyword", "e.schema_path", "e.instance_path")


def counts(df: DataFrame, schema, formats: bool = True) -> DataFrame:
    """Violations by rule, in one aggregation without exploding: keyword, schema_path, instance_path, n."""
    rules = row_rules(df, schema, formats)
    totals = df.agg(*[F.coalesce(F.sum(r.failures()), F.lit(0)).cast("long").alias(f"n{k}") for k, r in enumerate(rules)])
    rows = F.array(*[F.struct(F.lit(r.keyword).alias("keyword"), F.lit(r.schema_path).alias("schema_path"), F.lit(r.instance_path).alias("instance_path"), F.col(f"n{k}").alias("n")) for k, r in enumerate(rules)])
    return totals.select(F.inline(rows))


def signature(errors: Column) -> Column:
    """What distinguishes errors: the distinct (keyword, path) of a row."""
    return F.array_distinct(F.transform(errors, lambda e: F.concat_ws("|", e.keyword, e.schema_path, e.instance_path)))


def score(errors: Column) -> Column:
    return F.size(signature(errors))
