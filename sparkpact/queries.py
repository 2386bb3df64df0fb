"""The engine's own queries over the tables of one folder, each beside SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import hashing as H
from .functions import numbers as N
from .operators import coverage as C
from .operators import hints as HI
from .operators import predicates as P
from .operators import repair as R
from .operators import reports as RP
from .plans import motifs as M

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None):
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def _keyword(name: str, source: str, keys: str, schema: dict, bad: list[tuple[str, str, str, str]], prepare=None, sql_source: str | None = None, formats: bool = True) -> None:
    """A query for the violations of a contract. bad: (keyword, schema path, instance path, SQL condition)."""
    names = [k.strip() for k in keys.split(",")]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = table(spark, sf_dir, source)
        return P.violations(prepare(df) if prepare else df, schema, names, formats)

    QUERIES[name] = run
    SQL[name] = " UNION ALL ".join(f"SELECT {keys}, '{k}' AS keyword, '{s}' AS schema_path, '{i}' AS instance_path FROM {sql_source or source} WHERE {c}" for k, s, i, c in bad)


# --- contracts ---------------------------------------------------------------------------------------------------

ORDERS = {
    "type": "object",
    "required": ["o_orderkey", "o_orderstatus"],
    "properties": {
        "o_orderkey": {"type": "integer", "minimum": 1},
        "o_totalprice": {"type": "number", "minimum": 2000, "maximum": 400000},
        "o_orderstatus": {"enum": ["F", "O"]},
        "o_orderpriority": {"type": "string", "pattern": "^[1-3]-"},
    },
}
LINES = {
    "type": "object",
    "properties": {
        "l_quantity": {"type": "number", "minimum": 5, "exclusiveMaximum": 50, "multipleOf": 5},
        "l_discount": {"type": "number", "minimum": 0.01, "maximum": 0.08},
        "l_returnflag": {"enum": ["A", "N", "R"]},
        "l_linestatus": {"const": "O"},
        "l_linenumber": {"type": "integer", "exclusiveMinimum": 1, "maximum": 6},
    },
}
EVENTS = {
    "type": "object",
    "required": ["event_id", "event_type"],
    "properties": {
        "event_id": {"type": "integer"},
        "event_type": {"enum": ["click", "view", "purchase", "refund"]},
        "value": {"type": "number", "minimum": 1, "maximum": 400},
        "user_id": {"type": "integer", "anyOf": [{"maximum": 50}, {"minimum": 100}]},
    },
    "if": {"properties": {"event_type": {"const": "purchase"}}},
    "then": {"properties": {"value": {"minimum": 10}}},
    "else": {"properties": {"value": {"maximum": 490}}},
}

_ORDER_RULES = [
    ("minimum", "#/properties/o_orderkey/minimum", "/o_orderkey", "o_orderkey < 1"),
    ("minimum", "#/properties/o_totalprice/minimum", "/o_totalprice", "o_totalprice < 2000"),
    ("maximum", "#/properties/o_totalprice/maximum", "/o_totalprice", "o_totalprice > 400000"),
    ("enum", "#/properties/o_orderstatus/enum", "/o_orderstatus", "o_orderstatus NOT IN ('F', 'O')"),
    ("pattern", "#/properties/o_orderpriority/pattern", "/o_orderpriority", "NOT regexp_matches(o_orderpriority, '^[1-3]-')"),
]
_REQUIRED = [("required", "#/required", f"/{c}", f"{c} IS NULL") for c in ORDERS["required"]]


@query(
    "validate_orders_counts",
    " UNION ALL ".join(f"SELECT '{k}' AS keyword, '{s}' AS schema_path, '{i}' AS instance_path, count(*) FILTER (WHERE {c}) AS n FROM orders" for k, s, i, c in [*_REQUIRED, *_ORDER_RULES]),
)
def validate_orders_counts(spark, sf_dir):
    return P.counts(table(spark, sf_dir, "orders"), ORDERS)


# --- keywords ----------------------------------------------------------------------------------------------------


def _one(column: str, schema: dict, required=()) -> dict:
    return {"type": "object", "required": list(required), "properties": {column: schema}}


def _simple(name: str, source: str, keys: str, column: str, schema: dict, keyword: str, bad: str, **more) -> None:
    _keyword(name, source, keys, _one(column, schema), [(keyword, f"#/properties/{column}/{keyword}", f"/{column}", bad)], **more)


_LINE = "l_orderkey, l_linenumber"
_simple("kw_minimum", "lineitem", _LINE, "l_quantity", {"minimum": 5}, "minimum", "l_quantity < 5")
_simple("kw_maximum", "lineitem", _LINE, "l_extendedprice", {"maximum": 90000}, "maximum", "l_extendedprice > 90000")
_simple("kw_exclusive_minimum", "customer", "c_custkey", "c_acctbal", {"exclusiveMinimum": 0}, "exclusiveMinimum", "c_acctbal <= 0")
_simple("kw_exclusive_maximum", "customer", "c_custkey", "c_acctbal", {"exclusiveMaximum": 9000}, "exclusiveMaximum", "c_acctbal >= 9000")
_simple("kw_multiple_of", "lineitem", _LINE, "l_extendedprice", {"multipleOf": 0.25}, "multipleOf", "NOT abs(l_extendedprice / 0.25::DOUBLE - round(l_extendedprice / 0.25::DOUBLE)) < 1e-12")
_simple("kw_min_length", "documents", "doc_id", "text", {"minLength": 200}, "minLength", "length(text) < 200")
_simple("kw_max_length", "documents", "doc_id", "text", {"maxLength": 5000}, "maxLength", "length(text) > 5000")
_simple("kw_pattern", "part", "p_partkey", "p_brand", {"pattern": "^Brand#[1-3]"}, "pattern", "NOT regexp_matches(p_brand, '^Brand#[1-3]')")
_MAIL = "CASE WHEN c_nationkey > 12 THEN c_name || '@example.test' ELSE c_name END"
_simple("kw_format_email", "customer", "c_custkey", "mail", {"format": "email"}, "format", f"NOT regexp_matches({_MAIL}, '^[^\\s@]+@[^\\s@]+\\.[^\\s@]+$')", prepare=lambda d: d.withColumn("mail", F.expr(_MAIL)))
_LINK = "CASE WHEN length(url) > 40 THEN url ELSE replace(url, ':', ' ') END"
_simple("kw_format_uri", "pages", "page_id", "link", {"format": "uri"}, "format", f"NOT regexp_matches({_LINK}, '^[A-Za-z][A-Za-z0-9+.-]*:[^\\s]+$')", prepare=lambda d: d.withColumn("link", F.expr(_LINK)))
_STAMP = "CASE WHEN value > 250 THEN substring(CAST(ts AS {t}), 1, 10) ELSE CAST(ts AS {t}) END"
_simple("kw_format_datetime", "events", "event_id", "stamp", {"format": "date-time"}, "format", f"NOT regexp_matches({_STAMP.format(t='VARCHAR')}, '^\\d{{4}}-\\d{{2}}-\\d{{2}}[Tt ]\\d{{2}}:\\d{{2}}:\\d{{2}}(\\.\\d+)?([Zz]|[+-]\\d{{2}}:\\d{{2}})?$')", prepare=lambda d: d.withColumn("stamp", F.expr(_STAMP.format(t="STRING"))))
_simple("kw_enum", "orders", "o_orderkey", "o_orderstatus", {"enum": ["F", "O"]}, "enum", "o_orderstatus NOT IN ('F', 'O')")
_simple("kw_const", "lineitem", _LINE, "l_linestatus", {"const": "O"}, "const", "l_linestatus <> 'O'")
_simple("kw_type_integer", "lineitem", _LINE, "l_extendedprice", {"type": "integer"}, "type", "l_extendedprice <> floor(l_extendedprice)")
_keyword("kw_all_of", "lineitem", _LINE, _one("l_quantity", {"allOf": [{"minimum": 5}, {"maximum": 45}]}), [("minimum", "#/properties/l_quantity/allOf/0/minimum", "/l_quantity", "l_quantity < 5"), ("maximum", "#/properties/l_quantity/allOf/1/maximum", "/l_quantity", "l_quantity > 45")])
_simple("kw_any_of", "lineitem", _LINE, "l_quantity", {"anyOf": [{"maximum": 5}, {"minimum": 45}]}, "anyOf", "NOT (l_quantity <= 5 OR l_quantity >= 45)")
_simple("kw_one_of", "lineitem", _LINE, "l_quantity", {"oneOf": [{"maximum": 30}, {"minimum": 20}]}, "oneOf", "(l_quantity <= 30)::INT + (l_quantity >= 20)::INT <> 1")
_simple("kw_not", "lineitem", _LINE, "l_quantity", {"not": {"minimum": 45}}, "not", "l_quantity >= 45")
_POSITIVE = "len(list_filter(embedding, lambda x: x > 0))"
_positive = lambda d: d.withColumn("positive", F.filter("embedding", lambda x: x > 0))
_simple("kw_min_items", "embeddings", "vec_id", "positive", {"minItems": 30}, "minItems", f"{_POSITIVE} < 30", prepare=_positive)
_simple("kw_max_items", "embeddings", "vec_id", "positive", {"maxItems": 35}, "maxItems", f"{_POSITIVE} > 35", prepare=_positive)
_simple("kw_unique_items", "embeddings", "vec_id", "doubled", {"uniqueItems": True}, "uniqueItems", "embedding[1] > 0 OR len(list_distinct(embedding)) <> len(embedding)", prepare=lambda d: d.withColumn("doubled", F.when(F.get("embedding", 0) > 0, F.concat("embedding", F.slice("embedding", 1, 1))).otherwise(F.col("embedding"))))
_simple("kw_contains_bag", "embeddings", "vec_id", "embedding", {"contains": {"minimum": 0.25}, "minContains": 2, "maxContains": 4}, "contains", "len(list_filter(embedding, lambda x: x >= 0.25)) NOT BETWEEN 2 AND 4")


def _below(name: str, schema: dict, rows: list[tuple[str, str, str, str]], prefix: int = 0) -> None:
    """A query for violations at array items. rows: (keyword, schema path, instance path as SQL of i from 0, condition on x and i)."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return P.violations(table(spark, sf_dir, "embeddings"), _one("embedding", schema), ["vec_id"])

    QUERIES[name] = run
    source = "(SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)"
    SQL[name] = " UNION ALL ".join(f"SELECT vec_id, '{k}' AS keyword, '#/properties/embedding/{p}' AS schema_path, '/embedding/' || i AS instance_path FROM {source} WHERE {c}" for k, p, _, c in rows)


_below("kw_items", {"items": {"maximum": 0.3, "not": {"maximum": -0.3}}}, [("maximum", "items/maximum", "i", "x > 0.3"), ("not", "items/not", "i", "x <= -0.3")])
_below("kw_prefix_items", {"prefixItems": [{"minimum": 0}, {"maximum": 0.1}], "items": {"maximum": 0.35}}, [("minimum", "prefixItems/0/minimum", "i", "i = 0 AND x < 0"), ("maximum", "prefixItems/1/maximum", "i", "i = 1 AND x > 0.1"), ("maximum", "items/maximum", "i", "i > 1 AND x > 0.35")])


# An event as a map: `kind` always, `amount` where the value is high, `x_user` where the user's number is.
_HIGH, _USER = "value > 250", "user_id > 6"


def _props(df: DataFrame) -> DataFrame:
    entry = lambda k, v: F.struct(F.lit(k).alias("key"), v.cast("string").alias("value"))
    entries = F.array(entry("kind", F.col("event_type")), F.when(F.expr(_HIGH), entry("amount", F.lit("high"))), F.when(F.expr(_USER), entry("x_user", F.col("user_id"))))
    return df.withColumn("props", F.map_from_entries(F.array_compact(entries)))


def _event_row(df: DataFrame) -> DataFrame:
    """The same as a row: what isn't there is null."""
    return df.select("event_id", F.col("event_type").alias("kind"), F.when(F.expr(_HIGH), F.col("value")).alias("amount"), F.when(F.expr(_USER), F.col("user_id")).alias("x_user"))


_HIGH_BAD, _USER_BAD = f"({_HIGH})", f"({_USER})"
_keyword("kw_property_names", "events", "event_id", _one("props", {"propertyNames": {"pattern": "^[ak]"}}), [("propertyNames", "#/properties/props/propertyNames", "/props/x_user", _USER_BAD)], prepare=_props)
_keyword("kw_additional_properties", "events", "event_id", _one("props", {"properties": {"kind": {}}, "patternProperties": {"^x_": {"pattern": "^[0-8]"}}, "additionalProperties": False}), [("pattern", "#/properties/props/patternProperties/^x_/pattern", "/props/x_user", f"{_USER_BAD} AND user_id::VARCHAR LIKE '9%'"), ("additionalProperties", "#/properties/props/additionalProperties", "/props/amount", _HIGH_BAD)], prepare=_props)
_keyword("kw_additional_schema", "events", "event_id", _one("props", {"properties": {"kind": {}}, "additionalProperties": {"minLength": 2}}), [("minLength", "#/properties/props/additionalProperties/minLength", "/props/x_user", f"{_USER_BAD} AND length(user_id::VARCHAR) < 2")], prepare=_props)
_N_PROPS = f"1 + {_HIGH_BAD}::INT + {_USER_BAD}::INT"
_simple("kw_min_properties", "events", "event_id", "props", {"minProperties": 2}, "minProperties", f"{_N_PROPS} < 2", prepare=_props)
_simple("kw_max_properties", "events", "event_id", "props", {"maxProperties": 2}, "maxProperties", f"{_N_PROPS} > 2", prepare=_props)
_keyword("kw_required", "events", "event_id", _one("props", {"required": ["kind", "x_user"]}), [("required", "#/properties/props/required", "/props/x_user", f"NOT {_USER_BAD}")], prepare=_props)
_keyword(
    "kw_root_properties",
    "events",
    "event_id",
    {"minProperties": 3, "maxProperties": 3, "propertyNames": {"maxLength": 8, "pattern": "^[eak]"}, "properties": {"event_id": {}, "kind": {}}, "patternProperties": {"^am": {"maximum": 400}}, "additionalProperties": False},
    [
        ("minProperties", "#/minProperties", "", f"1 + {_N_PROPS} < 3"),
        ("maxProperties", "#/maxProperties", "", f"1 + {_N_PROPS} > 3"),
        ("propertyNames", "#/propertyNames", "/x_user", _USER_BAD),
        ("maximum", "#/patternProperties/^am/maximum", "/amount", "value > 400"),
        ("additionalProperties", "#/additionalProperties", "/x_user", _USER_BAD),
    ],
    prepare=_event_row,
)
_keyword(
    "kw_if_then_else",
    "events",
    "event_id",
    {k: EVENTS[k] for k in ("type", "if", "then", "else")},
    [
        ("minimum", "#/then/properties/value/minimum", "/value", "event_type = 'purchase' AND value < 10"),
        ("maximum", "#/else/properties/value/maximum", "/value", "event_type <> 'purchase' AND value > 490"),
        ("if", "#/if", "", "CASE WHEN event_type = 'purchase' THEN value < 10 ELSE value > 490 END"),
    ],
)
_keyword(
    "kw_dependent_required",
    "events",
    "event_id",
    {"dependentRequired": {"amount": ["note"]}},
    [("dependentRequired", "#/dependentRequired/amount", "", "value > 100 AND event_type <> 'view'")],
    prepare=lambda d: d.select("event_id", F.when(F.col("value") > 100, F.col("value")).alias("amount"), F.when(F.col("event_type") == "view", F.lit("x")).alias("note")),
)
_keyword(
    "kw_dependent_schemas",
    "events",
    "event_id",
    {"dependentSchemas": {"amount": {"properties": {"user_id": {"maximum": 7}}}}},
    [("maximum", "#/dependentSchemas/amount/properties/user_id/maximum", "/user_id", "value > 100 AND user_id > 7")],
    prepare=lambda d: d.select("event_id", "user_id", F.when(F.col("value") > 100, F.col("value")).alias("amount")),
)

# --- validity, signatures ----------------------------------------------------------------------------------------

_LINE_BAD = {
    "minimum": "l_quantity < 5",
    "exclusiveMaximum": "l_quantity >= 50",
    "multipleOf": "NOT abs(l_quantity / 5.0 - round(l_quantity / 5.0)) < 1e-12",
    "minimum2": "l_discount < 0.01",
    "maximum": "l_discount > 0.08",
    "const": "l_linestatus <> 'O'",
    "exclusiveMinimum": "l_linenumber <= 1",
    "maximum2": "l_linenumber > 6",
}
_LINE_SCORE = " + ".join(f"({c})::INT" for c in _LINE_BAD.values())


@query("error_signature_score", f"SELECT score, count(*) AS n FROM (SELECT {_LINE_SCORE} AS score FROM lineitem) GROUP BY score")
def error_signature_score(spark, sf_dir):
    df = P.validate(table(spark, sf_dir, "lineitem"), LINES)
    return df.groupBy(P.score(F.col("errors")).alias("score")).agg(F.count("*").alias("n"))


@query("valid_split", f"SELECT {_LINE_SCORE.join(['(', ')'])} = 0 AS valid, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem GROUP BY 1")
def valid_split(spark, sf_dir):
    df = P.validate(table(spark, sf_dir, "lineitem"), LINES)
    return df.groupBy("valid").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))


@query("violations_topk", f"SELECT * FROM ({' UNION ALL '.join(f'SELECT o_orderkey, {chr(39)}{k}{chr(39)} AS keyword, {chr(39)}{s}{chr(39)} AS schema_path FROM orders WHERE {c}' for k, s, _, c in _ORDER_RULES)}) ORDER BY o_orderkey, schema_path LIMIT 100")
def violations_topk(spark, sf_dir):
    return P.violations(table(spark, sf_dir, "orders"), ORDERS, ["o_orderkey"]).select("o_orderkey", "keyword", "schema_path").orderBy("o_orderkey", "schema_path").limit(100)


#: Contracts for which the compiled predicates must find what the generic validator finds, on rows of `_event_row` with tags and a place.
PARITY = [
    EVENTS,
    {"additionalProperties": False, "properties": {"event_id": {}, "kind": {}, "tags": {}, "place": {}}},
    {"maxProperties": 4, "minProperties": 4},
    {"propertyNames": {"enum": ["event_id", "kind", "amount", "tags", "place"]}},
    {"patternProperties": {"^[ax]": {"exclusiveMaximum": 300}}, "additionalProperties": {"not": {"const": "click"}}, "properties": {"event_id": {}}},
    {"allOf": [{"properties": {"amount": {"maximum": 300}}}, {"required": ["amount", "x_user"]}]},
    {"anyOf": [{"required": ["amount"]}, {"required": ["x_user"]}], "oneOf": [{"required": ["amount"]}, {"properties": {"kind": {"enum": ["view", "click"]}}}]},
    {"properties": {"tags": {"items": {"minLength": 5, "enum": ["click", "view", "refund", "5", "50"]}, "maxItems": 2, "uniqueItems": True}}},
    {"properties": {"tags": {"prefixItems": [{"const": "view"}, {"pattern": "^[0-4]"}], "items": False, "contains": {"maxLength": 1}}}},
    {"properties": {"place": {"required": ["user"], "properties": {"user": {"multipleOf": 3}}, "additionalProperties": {"maxLength": 5}}}},
    {"dependentRequired": {"amount": ["x_user"]}, "dependentSchemas": {"x_user": {"properties": {"kind": {"enum": ["view"]}}, "required": ["amount"]}}},
    {"if": {"required": ["amount"]}, "then": {"properties": {"amount": {"multipleOf": 1}}, "maxProperties": 4}, "else": {"allOf": [{"properties": {"tags": {"items": {"maxLength": 5}}}}]}},
    {"not": {"properties": {"kind": {"const": "view"}}}, "properties": {"amount": {"type": "integer"}, "x_user": {"type": ["string", "integer"], "maximum": 80}, "kind": {"type": "string", "maxLength": 4}}},
]


@query("oracle_harness", " UNION ALL ".join(f"SELECT {k}::BIGINT AS contract, 0::BIGINT AS disagreements, count(*) AS n FROM events" for k in range(len(PARITY))))
def oracle_harness(spark, sf_dir):
    """Compiled predicates against the generic validator: the whole sets of errors of each row, contract by contract."""
    from .operators.documents import validate_documents

    e = table(spark, sf_dir, "events")
    plain = e.select("event_id", "event_type", "value", "user_id")
    parts = _event_row(e).join(e.select("event_id", F.when(F.expr("value < 480"), F.array("event_type", F.col("user_id").cast("string"), "event_type")).otherwise(F.array("event_type")).alias("tags"), F.struct(F.when(F.expr("user_id < 90"), F.col("user_id")).alias("user"), F.col("event_type").alias("what")).alias("place")), "event_id")
    out = None
    for k, contract in enumerate(PARITY):
        df = plain if contract is EVENTS else parts
        docs = df.select("event_id", F.to_json(F.struct("*")).alias("doc"))
        a = P.validate(df, contract).select("event_id", F.array_sort(F.array_distinct("errors")).alias("a"), F.col("valid").alias("va"))
        b = validate_documents(docs, contract, ["event_id"], formats=True).select("event_id", F.array_sort(F.array_distinct("errors")).alias("b"), F.col("valid").alias("vb"))
        one = a.join(b, "event_id").agg(F.count_if((F.col("a") != F.col("b")) | (F.col("va") != F.col("vb"))).alias("disagreements"), F.count("*").alias("n"))
        one = one.select(F.lit(k).cast("long").alias("contract"), "disagreements", "n")
        out = one if out is None else out.unionAll(one)
    return out


# --- repair ------------------------------------------------------------------------------------------------------


def _repair(name: str, source: str, keys: str, column: str, schema: dict, sql_value: str, prepare=None, extra: str = "") -> None:
    def run(spark, sf_dir):
        df = table(spark, sf_dir, source)
        df = prepare(df) if prepare else df
        names = [k.strip() for k in keys.split(",")]
        return R.repair(df.select(*names, column), _one(column, schema)).select(*names, F.col(column).alias("repaired"))

    QUERIES[name] = run
    SQL[name] = f"SELECT {keys}, {sql_value} AS repaired FROM {source}{extra}"


_repair("repair_numeric_clamp", "lineitem", _LINE, "l_quantity", {"minimum": 5, "maximum": 40}, "greatest(least(l_quantity, 40.0::DOUBLE), 5.0::DOUBLE)")
_repair("repair_numeric_nudge", "lineitem", _LINE, "l_quantity", {"exclusiveMinimum": 5, "exclusiveMaximum": 40}, "CASE WHEN l_quantity <= 5 THEN 5.0::DOUBLE + 1e-12::DOUBLE WHEN l_quantity >= 40 THEN 40.0::DOUBLE - 1e-12::DOUBLE ELSE l_quantity END")
_repair("repair_integer_nudge", "part", "p_partkey", "p_size", {"exclusiveMinimum": 5, "exclusiveMaximum": 40}, "CASE WHEN p_size <= 5 THEN 6 WHEN p_size >= 40 THEN 39 ELSE p_size END")
_repair("repair_multiple_of_snap", "lineitem", _LINE, "l_quantity", {"multipleOf": 4}, "round(l_quantity / 4.0::DOUBLE) * 4.0::DOUBLE")
_repair("repair_string_pad_truncate", "part", "p_partkey", "p_name", {"minLength": 9, "maxLength": 10}, "substring(CASE WHEN length(p_name) < 9 THEN rpad(p_name, 9, 'a') ELSE p_name END, 1, 10)")
_repair("repair_enum_first", "orders", "o_orderkey", "o_orderstatus", {"enum": ["O", "F"]}, "CASE WHEN o_orderstatus IN ('O', 'F') THEN o_orderstatus ELSE 'O' END")
_repair("repair_const", "orders", "o_orderkey", "o_orderstatus", {"const": "O"}, "'O'")
_repair("repair_max_items", "embeddings", "vec_id", "embedding", {"maxItems": 8}, "list_slice(embedding, 1, 8)")
_repair("repair_min_items", "embeddings", "vec_id", "embedding", {"minItems": 66, "items": {"default": 1}}, "list_concat(embedding, [1.0::FLOAT, 1.0::FLOAT])")
_repair("repair_required_default", "events", "event_id", "note", {"type": "string", "default": "none"}, "CASE WHEN event_type = 'view' THEN 'x' ELSE 'none' END", prepare=lambda d: d.withColumn("note", F.when(F.col("event_type") == "view", F.lit("x"))))


def _required_default(spark, sf_dir):
    df = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_type") == "view", F.lit("x")).alias("note"))
    return R.repair(df, _one("note", {"type": "string", "default": "none"}, ["note"])).select("event_id", F.col("note").alias("repaired"))


QUERIES["repair_required_default"] = _required_default


@query("repair_unique_items", "SELECT o_orderkey, list_sort(list_distinct(list(l_quantity))) AS repaired FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey")
def repair_unique_items(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity")
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    bags = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_orderkey").agg(F.sort_array(F.collect_list("l_quantity")).alias("q"))
    return R.repair(bags, _one("q", {"uniqueItems": True})).select("o_orderkey", F.col("q").alias("repaired"))


@query("repair_remove_additional", f"SELECT event_id, ['kind'] || CASE WHEN {_USER_BAD} THEN ['x_user'] ELSE [] END AS kept, {_HIGH_BAD}::BIGINT AS actions FROM events")
def repair_remove_additional(spark, sf_dir):
    out = R.repair(_props(table(spark, sf_dir, "events")).select("event_id", "props"), _one("props", {"properties": {"kind": {}}, "patternProperties": {"^x_": {}}, "additionalProperties": False}))
    return out.select("event_id", F.sort_array(F.map_keys("props")).alias("kept"), F.size("actions").cast("long").alias("actions"))


_repair("repair_type", "lineitem", _LINE, "l_discount", {"type": "integer"}, "CASE WHEN l_discount = floor(l_discount) THEN l_discount ELSE 0 END")
_repair("repair_max_contains", "embeddings", "vec_id", "embedding", {"contains": {"minimum": 0.1}, "minContains": 0, "maxContains": 3}, "list_filter(embedding, lambda x, i: NOT x >= 0.1 OR len(list_filter(embedding[1:i], lambda y: y >= 0.1)) <= 3)")


@query("repair_nested", "SELECT event_id, least(value, 100) AS value, CASE WHEN event_type IN ('click', 'view') THEN event_type ELSE 'click' END AS kind, (value > 100)::BIGINT + (event_type NOT IN ('click', 'view'))::BIGINT AS actions FROM events")
def repair_nested(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.struct("value", F.struct(F.col("event_type").alias("kind")).alias("what")).alias("body"))
    contract = _one("body", {"properties": {"value": {"maximum": 100}, "what": {"properties": {"kind": {"enum": ["click", "view"]}}}}})
    return R.repair(e, contract).select("event_id", "body.value", "body.what.kind", F.size("actions").cast("long").alias("actions"))


_REPAIRED = {"type": "object", "properties": {"l_quantity": {"minimum": 5, "exclusiveMaximum": 50}, "l_discount": {"maximum": 0.08}}}


@query("repair_revert_rule", "SELECT (l_quantity < 5)::INT + (l_quantity >= 50)::INT + (l_discount > 0.08)::INT AS score_before, 0 AS score_after, false AS reverted, count(*) AS n FROM lineitem GROUP BY 1")
def repair_revert_rule(spark, sf_dir):
    df = R.repair(table(spark, sf_dir, "lineitem").select("l_quantity", "l_discount"), _REPAIRED)
    return df.groupBy("score_before", "score_after", "reverted").agg(F.count("*").alias("n"))


@query(
    "repair_usage_by_motif",
    """SELECT l_returnflag AS motif, count(*) AS items, count(*) FILTER (WHERE a > 0) AS items_with_repair, CAST(sum(a) AS BIGINT) AS actions
       FROM (SELECT l_returnflag, (l_quantity < 5)::INT + (l_quantity >= 50)::INT + (l_discount > 0.08)::INT AS a FROM lineitem) GROUP BY 1""",
)
def repair_usage_by_motif(spark, sf_dir):
    df = R.repair(table(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity", "l_discount"), _REPAIRED)
    return R.usage(df, F.col("l_returnflag"))


@query("repair_tier_policy", "SELECT * FROM (VALUES ('minimum', 1::BIGINT), ('required', 0::BIGINT), ('minItems', 0::BIGINT), ('enum', 1::BIGINT)) t(keyword, allowed)")
def repair_tier_policy(spark, sf_dir):
    return spark.createDataFrame([(k, int(R.allowed(k, 1))) for k in ("minimum", "required", "minItems", "enum")], "keyword string, allowed long")


# --- coverage ----------------------------------------------------------------------------------------------------

COVERED = {
    "type": "object",
    "required": ["event_id"],
    "properties": {
        "event_id": {"type": "integer", "minimum": 0},
        "event_type": {"enum": ["click", "view", "purchase", "refund"]},
        "user_id": {"anyOf": [{"maximum": 50}, {"minimum": 1000}]},
    },
}


#: The targets of COVERED, written out: dimension, kind, path, parameters as canonical JSON, and the rows that hit them.
_TARGETS = [
    ("structure", "SCHEMA_NODE", "#", "", "true"),
    ("structure", "SCHEMA_NODE", "#/properties/event_id", "", "event_id IS NOT NULL"),
    ("boundaries", "NUMERIC_MIN_HIT", "#/properties/event_id", '{"boundaryKind":"minimum","boundaryValue":0}', "event_id = 0"),
    ("structure", "PROPERTY_PRESENT", "#/properties/event_type", '{"propertyName":"event_type"}', "event_type IS NOT NULL"),
    ("structure", "SCHEMA_NODE", "#/properties/event_type", "", "event_type IS NOT NULL"),
    ("enum", "ENUM_VALUE_HIT", "#/properties/event_type", '{"enumIndex":0,"enumValue":"click"}', "event_type = 'click'"),
    ("enum", "ENUM_VALUE_HIT", "#/properties/event_type", '{"enumIndex":1,"enumValue":"view"}', "event_type = 'view'"),
    ("enum", "ENUM_VALUE_HIT", "#/properties/event_type", '{"enumIndex":2,"enumValue":"purchase"}', "event_type = 'purchase'"),
    ("enum", "ENUM_VALUE_HIT", "#/properties/event_type", '{"enumIndex":3,"enumValue":"refund"}', "event_type = 'refund'"),
    ("structure", "PROPERTY_PRESENT", "#/properties/user_id", '{"propertyName":"user_id"}', "user_id IS NOT NULL"),
    ("structure", "SCHEMA_NODE", "#/properties/user_id", "", "user_id IS NOT NULL"),
    ("branches", "ANYOF_BRANCH", "#/properties/user_id/anyOf/0", '{"index":0}', "user_id <= 50"),
    ("structure", "SCHEMA_NODE", "#/properties/user_id/anyOf/0", "", "false"),
    ("boundaries", "NUMERIC_MAX_HIT", "#/properties/user_id/anyOf/0", '{"boundaryKind":"maximum","boundaryValue":50}', "false"),
    ("branches", "ANYOF_BRANCH", "#/properties/user_id/anyOf/1", '{"index":1}', "user_id >= 1000"),
    ("structure", "SCHEMA_NODE", "#/properties/user_id/anyOf/1", "", "false"),
    ("boundaries", "NUMERIC_MIN_HIT", "#/properties/user_id/anyOf/1", '{"boundaryKind":"minimum","boundaryValue":1000}', "false"),
]
_ID = """'cov:0:1:' || sha256('{"canonPath":"' || canon_path || '","dimension":"' || dimension || '","engineMajor":0,"kind":"' || kind || '","operationKey":null,"params":' || CASE WHEN params_key = '' THEN 'null' ELSE params_key END || ',"reportMajor":1,"v":1}')"""


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _targets_sql(written: list[tuple[str, str, str, str, str]] = _TARGETS) -> str:
    rows = ", ".join(f"({', '.join(map(_text, t[:4]))}, 'active', 1.0::DOUBLE)" for t in written)
    return f"(SELECT {_ID} AS id, * FROM (VALUES {rows}) t(dimension, kind, canon_path, params_key, status, weight))"


def _hits_sql(where: str = "true", written: list[tuple[str, str, str, str, str]] = _TARGETS) -> str:
    rows = " UNION ALL ".join(f"SELECT {', '.join(f'{_text(v)} AS {c}' for v, c in zip(t, ('dimension', 'kind', 'canon_path', 'params_key')))}, count(*) FILTER (WHERE ({where}) AND ({t[4]})) AS n FROM events" for t in written)
    return f"SELECT {_ID} AS id, n FROM ({rows})"


def _covered_sql(where: str = "true") -> str:
    return f"(SELECT t.*, coalesce(h.n, 0) > 0 AS hit FROM {_targets_sql()} t LEFT JOIN ({_hits_sql(where)}) h USING (id))"


def _covered(spark, sf_dir, where=None) -> DataFrame:
    df = table(spark, sf_dir, "events").select("event_id", "event_type", "user_id")
    return C.covered(C.targets(spark, COVERED), C.hits(df, COVERED, where))


@query("coverage_targets", f"SELECT * FROM {_targets_sql()}")
def coverage_targets(spark, sf_dir):
    return C.targets(spark, COVERED).drop("op_key")


@query("coverage_hits", f"SELECT * FROM ({_hits_sql()}) WHERE n > 0")
def coverage_hits(spark, sf_dir):
    return C.hits(table(spark, sf_dir, "events").select("event_id", "event_type", "user_id"), COVERED)


@query("coverage_by_dimension", f"SELECT dimension, count(*) AS total, count(*) FILTER (WHERE hit) AS hit, count(*) FILTER (WHERE hit)::DOUBLE / count(*) AS ratio FROM {_covered_sql()} GROUP BY dimension")
def coverage_by_dimension(spark, sf_dir):
    return C.by_dimension(_covered(spark, sf_dir))


@query("coverage_overall", f"SELECT count(*) AS total, count(*) FILTER (WHERE hit) AS hit, count(*) FILTER (WHERE hit)::DOUBLE / count(*) AS ratio, CASE WHEN count(*) FILTER (WHERE hit)::DOUBLE / count(*) >= 0.8 THEN 'ok' ELSE 'minCoverageNotMet' END AS status FROM {_covered_sql()}")
def coverage_overall(spark, sf_dir):
    return C.overall(_covered(spark, sf_dir))


@query("coverage_status", f"SELECT status, hit, count(*) AS n FROM {_covered_sql()} GROUP BY 1, 2")
def coverage_status(spark, sf_dir):
    return _covered(spark, sf_dir).groupBy("status", "hit").agg(F.count("*").alias("n"))


_OPS = "CASE WHEN dimension = 'enum' THEN ['listEvents', 'POST /events'] WHEN dimension = 'branches' THEN ['listEvents'] ELSE NULL END"


def _with_ops(t: DataFrame) -> DataFrame:
    none = F.lit(None).cast("array<string>")
    return t.withColumn("op_keys", F.when(F.col("dimension") == "enum", F.array(F.lit("listEvents"), F.lit("POST /events"))).when(F.col("dimension") == "branches", F.array(F.lit("listEvents"))).otherwise(none))


@query("coverage_by_operation", f"SELECT operation, count(*) AS total, count(*) FILTER (WHERE hit) AS hit, count(*) FILTER (WHERE hit)::DOUBLE / count(*) AS ratio FROM (SELECT unnest({_OPS}) AS operation, hit FROM {_covered_sql()}) GROUP BY operation")
def coverage_by_operation(spark, sf_dir):
    return C.by_operation(_with_ops(_covered(spark, sf_dir)))


@query("coverage_uncovered_topk", f"SELECT id, dimension, kind, canon_path FROM {_covered_sql()} WHERE NOT hit ORDER BY dimension, weight DESC, kind, canon_path, id LIMIT 200")
def coverage_uncovered_topk(spark, sf_dir):
    return C.uncovered(_covered(spark, sf_dir)).select("id", "dimension", "kind", "canon_path")


_POSITION = "row_number() OVER (ORDER BY CASE dimension WHEN 'branches' THEN 0 WHEN 'enum' THEN 1 WHEN 'structure' THEN 2 WHEN 'boundaries' THEN 3 ELSE 4 END, weight DESC, canon_path, id)"


@query("coverage_planner_caps", f"SELECT id, dimension, position FROM (SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY position) AS k FROM (SELECT *, {_POSITION} AS position FROM {_targets_sql()})) WHERE k <= 2")
def coverage_planner_caps(spark, sf_dir):
    return C.dimension_cap(C.targets(spark, COVERED), 2).select("id", "dimension", "position")


_UNIT = f"SELECT *, list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split('tu-' || (position - 1) || '|' || canon_path, ''), lambda c: ascii(c)::BIGINT)), lambda h, c: (xor(h, c) * 16777619) % 4294967296) AS f FROM (SELECT *, {_POSITION} AS position FROM {_targets_sql()}) WHERE position <= 8"


@query(
    "coverage_plan_units",
    f"""SELECT position - 1 AS unit, id, dimension, kind, canon_path, CASE WHEN kind = 'PROPERTY_PRESENT' THEN 'ensurePropertyPresence' WHEN kind LIKE '%\\_BRANCH' ESCAPE '\\' THEN 'preferBranch' WHEN kind = 'ENUM_VALUE_HIT' THEN 'coverEnumValue' END AS hint,
        xor(b, (b << 5) & 4294967295) AS seed FROM (SELECT *, xor(a, a >> 17) AS b FROM (SELECT *, xor(x, (x << 13) & 4294967295) AS a FROM (SELECT *, xor(f, 424242) AS x FROM ({_UNIT}))))""",
)
def coverage_plan_units(spark, sf_dir):
    return C.plan_units(C.targets(spark, COVERED), 8, 424242)


_HALVES = ("event_id % 2 = 0 AND user_id > 50", "event_id % 2 = 1 AND event_type <> 'click'")


def _halves(spark, sf_dir):
    return tuple(_covered(spark, sf_dir, F.expr(w)) for w in _HALVES)


@query(
    "coverage_diff_targets",
    f"""SELECT a.id, CASE WHEN a.hit = b.hit THEN 'unchanged' ELSE 'statusChanged' END AS change, a.hit AS hit_a, b.hit AS hit_b
        FROM {_covered_sql(_HALVES[0])} a JOIN {_covered_sql(_HALVES[1])} b USING (id)""",
)
def coverage_diff_targets(spark, sf_dir):
    return C.diff(*_halves(spark, sf_dir))


@query("coverage_newly_uncovered", f"SELECT b.id, b.kind FROM {_covered_sql(_HALVES[0])} a JOIN {_covered_sql(_HALVES[1])} b USING (id) WHERE a.hit AND NOT b.hit")
def coverage_newly_uncovered(spark, sf_dir):
    return C.newly_uncovered(*_halves(spark, sf_dir)).select("id", "kind")


def _by_op_sql(where: str) -> str:
    return f"(SELECT operation, count(*) FILTER (WHERE hit)::DOUBLE / count(*) AS ratio FROM (SELECT unnest({_OPS}) AS operation, hit FROM {_covered_sql(where)}) GROUP BY operation)"


@query("coverage_diff_ops", f"SELECT operation, a.ratio AS ratio_a, b.ratio AS ratio_b, b.ratio - a.ratio AS delta FROM {_by_op_sql(_HALVES[0])} a FULL JOIN {_by_op_sql(_HALVES[1])} b USING (operation)")
def coverage_diff_ops(spark, sf_dir):
    return C.operation_deltas(*[_with_ops(t) for t in _halves(spark, sf_dir)])


@query("unsat_prefix_unreachable", f"SELECT id, CASE WHEN canon_path = '#/properties/user_id' OR starts_with(canon_path, '#/properties/user_id/') THEN 'unreachable' ELSE status END AS status FROM {_targets_sql()}")
def unsat_prefix_unreachable(spark, sf_dir):
    paths = spark.createDataFrame([("#/properties/user_id",)], "path string")
    return C.mark_unreachable(C.targets(spark, COVERED), paths).select("id", "status")


_EDGES = "SELECT DISTINCT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst FROM nation UNION SELECT DISTINCT 'n' || c_nationkey, 's' || c_mktsegment FROM customer"
_ROOTS = "SELECT r_name AS operation, 'r' || r_regionkey AS node FROM region"
_REACH = f"WITH RECURSIVE e AS ({_EDGES}), reach AS (SELECT operation, node FROM ({_ROOTS}) UNION SELECT r.operation, e.dst FROM reach r JOIN e ON r.node = e.src)"


def _reach(spark, sf_dir):
    n, c, r = (table(spark, sf_dir, x) for x in ("nation", "customer", "region"))
    edges = n.select(F.concat(F.lit("r"), "n_regionkey").alias("src"), F.concat(F.lit("n"), "n_nationkey").alias("dst")).union(
        c.select(F.concat(F.lit("n"), "c_nationkey"), F.concat(F.lit("s"), "c_mktsegment"))
    )
    return C.reachability(edges.distinct(), r.select(F.col("r_name").alias("operation"), F.concat(F.lit("r"), "r_regionkey").alias("node")))


@query("op_reachability", f"{_REACH} SELECT operation, node FROM reach")
def op_reachability(spark, sf_dir):
    return _reach(spark, sf_dir)


@query("schema_reuse", f"{_REACH} SELECT node, count(DISTINCT operation) AS operations FROM reach GROUP BY node HAVING count(DISTINCT operation) > 1")
def schema_reuse(spark, sf_dir):
    return C.reused(_reach(spark, sf_dir))


# --- functions ---------------------------------------------------------------------------------------------------

_FNV = "list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(c_name, ''), lambda c: ascii(c)::BIGINT)), lambda h, c: (xor(h, c) * 16777619) % 4294967296)"


@query("rng_fnv1a", f"SELECT c_custkey, {_FNV} AS h FROM customer")
def rng_fnv1a(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", H.fnv1a32_col(F.col("c_name")).alias("h"))


@query(
    "rng_xorshift",
    """WITH a AS (SELECT c_custkey, xor(c_custkey, 123456789) AS x FROM customer),
            b AS (SELECT c_custkey, xor(x, (x << 13) & 4294967295) AS x FROM a),
            c AS (SELECT c_custkey, xor(x, x >> 17) AS x FROM b)
       SELECT c_custkey, xor(x, (x << 5) & 4294967295) AS x FROM c""",
)
def rng_xorshift(spark, sf_dir):
    start = F.col("c_custkey").bitwiseXOR(F.lit(H.DEFAULT_SEED).cast("long"))
    return table(spark, sf_dir, "customer").select("c_custkey", H.xorshift_col(start).alias("x"))


def _states(kind: str, rows: str, key: str, seed: int = H.DEFAULT_SEED) -> str:
    """CTEs: s(key, x0 to x4), a generator's first states for each row's index."""
    h = f"list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split('format:{kind}:' || {key}, ''), lambda c: ascii(c)::BIGINT)), lambda h, c: (xor(h, c) * 16777619) % 4294967296)"
    out = f"WITH s0 AS (SELECT {key}, xor({h}, {seed}::BIGINT) AS x0 FROM {rows})"
    for k in range(4):
        had, x = "".join(f", x{i}" for i in range(k + 1)), f"x{k}"
        out += f", a{k} AS (SELECT {key}{had}, xor({x}, ({x} << 13) & 4294967295) AS y FROM s{k}), b{k} AS (SELECT {key}{had}, xor(y, y >> 17) AS y FROM a{k}), s{k + 1} AS (SELECT {key}{had}, xor(y, (y << 5) & 4294967295) AS x{k + 1} FROM b{k})"
    return out


_B36 = "(CASE WHEN x1 >= 2176782336 THEN substr('0123456789abcdefghijklmnopqrstuvwxyz', 1 + (x1 // 2176782336)::INT, 1) ELSE '' END || list_aggregate(list_transform(range(5, -1, -1), lambda i: substr('0123456789abcdefghijklmnopqrstuvwxyz', 1 + (x1 // (36 ** i)::BIGINT % 36)::BIGINT, 1)), 'string_agg', ''))"
_HEX = "list_aggregate(list_transform([x1, x2, x3, x4], lambda x: substr(format('{:08x}', x), 7, 2) || substr(format('{:08x}', x), 5, 2) || substr(format('{:08x}', x), 3, 2) || substr(format('{:08x}', x), 1, 2)), 'string_agg', '')"
_UUID = "substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-4' || substr(h, 14, 3) || '-' || substr('89ab', 1 + (instr('0123456789abcdef', substr(h, 17, 1)) - 1) % 4, 1) || substr(h, 18, 3) || '-' || substr(h, 21)"


def _format(name: str, kind: str, column: str, value: str, source: str = "s4") -> None:
    def run(spark, sf_dir):
        return table(spark, sf_dir, "customer").select("c_custkey", H.format_col(kind, F.col("c_custkey"), H.DEFAULT_SEED).alias(column))

    QUERIES[name] = run
    SQL[name] = f"{_states(kind, 'customer', 'c_custkey')} SELECT c_custkey, {value} AS {column} FROM {source}"


_format("generate_email", "email", "email", f"'user.' || {_B36} || '@example.test'")
_format("generate_uri", "uri", "uri", f"'https://example.test/resource/' || {_B36}")
_format("generate_datetime", "date-time", "stamp", "strftime(to_timestamp(1704067200 + (x1 % 365) * 86400 + x2 % 86400) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S') || '.000Z'")
_format("generate_uuid", "uuid", "uuid", _UUID, f"(SELECT c_custkey, {_HEX} AS h FROM s4)")


@query("structural_hash", "SELECT c_custkey, sha256('{\"name\":\"' || c_name || '\",\"nation\":' || c_nationkey || ',\"segment\":\"' || c_mktsegment || '\"}') AS h FROM customer")
def structural_hash(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", H.structural_hash_col(segment=F.col("c_mktsegment"), nation=F.col("c_nationkey"), name=F.col("c_name")).alias("h"))


# --- planning, reports -------------------------------------------------------------------------------------------


@query(
    "branch_score_choice",
    """SELECT o_custkey, o_orderkey AS branch, score FROM (
         SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY score DESC, o_orderkey) AS k FROM (
           SELECT o_custkey, o_orderkey, (o_orderstatus = 'F')::INT * 1000 + (o_orderpriority LIKE '1%')::INT * 200
                  + least(o_orderkey % 7, 4)::INT * 120 - (o_totalprice > 250000)::INT * 5 AS score FROM orders)) WHERE k = 1""",
)
def branch_score_choice(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    features = {"tags": (F.col("o_orderstatus") == "F").cast("int"), "const_keys": F.col("o_orderpriority").like("1%").cast("int"), "unique_required": (F.col("o_orderkey") % 7).cast("int"), "unsafe": (F.col("o_totalprice") > 250000).cast("int")}
    return RP.choose_branch(o.select("o_custkey", F.col("o_orderkey").alias("branch"), RP.branch_score(features).alias("score")), "o_custkey")


@query("diag_dedupe", "SELECT event_type AS code, user_id AS path, min(event_id) AS first FROM events GROUP BY 1, 2")
def diag_dedupe(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("code"), F.col("user_id").alias("path"), F.col("event_id").alias("first"))
    return RP.dedupe(e, ["code", "path"], "first")


_PHASE = "CASE event_type WHEN 'error' THEN 'validate' WHEN 'purchase' THEN 'repair' ELSE 'generate' END"


@query("diag_by_phase", f"SELECT {_PHASE} AS phase, event_type AS code, count(*) AS n FROM events GROUP BY 1, 2")
def diag_by_phase(spark, sf_dir):
    return RP.by_phase(table(spark, sf_dir, "events").withColumnRenamed("event_type", "code"), {"error": "validate", "purchase": "repair"}, "generate")


@query("corpus_summary", "SELECT count(*) AS schemas, count(*) FILTER (WHERE v > 480) AS failed, CAST(sum(n) AS BIGINT) AS instances, CAST(sum(e) AS BIGINT) AS invalid FROM (SELECT user_id, count(*) AS n, max(value) AS v, count(*) FILTER (WHERE event_type = 'error') AS e FROM events GROUP BY 1)")
def corpus_summary(spark, sf_dir):
    return RP.corpus_summary(_runs(spark, sf_dir))


def _runs(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.col("user_id").alias("schema_id")).agg(F.count("*").alias("instances"), (F.max("value") > 480).alias("failed"), F.count_if(F.col("event_type") == "error").alias("invalid"))


@query("corpus_failure_category", "SELECT CASE WHEN v > 480 THEN 'failed' WHEN 2 * e > n THEN 'blocked' WHEN e > 0 THEN 'limited' ELSE 'ok' END AS category, count(*) AS n FROM (SELECT user_id, count(*) AS n, max(value) AS v, count(*) FILTER (WHERE event_type = 'error') AS e FROM events GROUP BY 1) GROUP BY 1")
def corpus_failure_category(spark, sf_dir):
    return RP.failure_categories(_runs(spark, sf_dir))


@query("bench_percentiles", "SELECT l_returnflag AS profile, quantile_disc(l_extendedprice, 0.5) AS p50, quantile_disc(l_extendedprice, 0.95) AS p95, max(l_extendedprice) AS top FROM lineitem GROUP BY 1")
def bench_percentiles(spark, sf_dir):
    return RP.percentiles(table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("profile"), F.col("l_extendedprice").alias("ms")))


@query("bench_gate", "SELECT max(p95) AS worst_p95, max(p95) <= 95000 AS passed FROM (SELECT quantile_disc(l_extendedprice, 0.95) AS p95 FROM lineitem GROUP BY l_returnflag)")
def bench_gate(spark, sf_dir):
    return RP.gate(bench_percentiles(spark, sf_dir), 95000)


@query("bench_level", "SELECT l_returnflag AS profile, CASE WHEN quantile_disc(l_extendedprice, 0.95) > 95000 THEN 'blocked' WHEN quantile_disc(l_extendedprice, 0.5) > 35000 THEN 'limited' ELSE 'ok' END AS level FROM lineitem GROUP BY 1")
def bench_level(spark, sf_dir):
    return RP.levels(bench_percentiles(spark, sf_dir), 35000, 95000)


@query("bench_summary_diff", "SELECT coalesce(a.p, b.p) AS profile, a.m AS before, b.m AS after, b.m - a.m AS delta FROM (SELECT l_returnflag AS p, max(l_quantity) AS m FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1) a FULL JOIN (SELECT l_returnflag AS p, max(l_quantity) AS m FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1) b ON a.p = b.p")
def bench_summary_diff(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    side = lambda s: l.where(F.col("l_linestatus") == s).groupBy(F.col("l_returnflag").alias("profile")).agg(F.max("l_quantity").alias("value"))
    return RP.summary_diff(side("F"), side("O"))


@query("report_outcome_summary", f"SELECT CASE WHEN s = 0 THEN 'valid' ELSE 'repaired' END AS outcome, count(*) AS n FROM (SELECT (l_quantity < 5)::INT + (l_quantity >= 50)::INT + (l_discount > 0.08)::INT AS s FROM lineitem) GROUP BY 1")
def report_outcome_summary(spark, sf_dir):
    return RP.outcomes(R.repair(table(spark, sf_dir, "lineitem").select("l_quantity", "l_discount"), _REPAIRED))


@query("operator_levels", "SELECT user_id AS schema_id, CASE WHEN 2 * e > n THEN 2 WHEN e > 0 THEN 1 ELSE 0 END AS reliability, CASE WHEN v > 480 THEN 2 WHEN v > 300 THEN 1 ELSE 0 END AS performance, greatest(CASE WHEN 2 * e > n THEN 2 WHEN e > 0 THEN 1 ELSE 0 END, CASE WHEN v > 480 THEN 2 WHEN v > 300 THEN 1 ELSE 0 END) AS overall FROM (SELECT user_id, count(*) AS n, max(value) AS v, count(*) FILTER (WHERE event_type = 'error') AS e FROM events GROUP BY 1)")
def operator_levels(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("schema_id")).agg(F.count("*").alias("instances"), F.max("value").alias("ms"), F.count_if(F.col("event_type") == "error").alias("invalid"))
    return RP.operator_levels(e, 300, 480)


# --- documents, generation, streams ------------------------------------------------------------------------------

_EVENT_BAD = {
    "enum": "event_type NOT IN ('click', 'view', 'purchase', 'refund')",
    "minimum": "value < 1",
    "maximum": "value > 400",
    "anyOf": "NOT (user_id <= 50 OR user_id >= 100)",
    "if": "CASE WHEN event_type = 'purchase' THEN value < 10 ELSE value > 490 END",
}


def _event_docs(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.to_json(F.struct("event_id", "event_type", "value", "user_id")).alias("doc"))


@query("validate_documents", f"SELECT event_id, {' OR '.join(f'({c})' for c in _EVENT_BAD.values())} AS bad FROM events")
def validate_documents_query(spark, sf_dir):
    """The generic validator over JSON texts."""
    from .operators.documents import validate_documents

    return validate_documents(_event_docs(spark, sf_dir), EVENTS, ["event_id"]).select("event_id", (~F.col("valid")).alias("bad"))


_DOC_REPAIR = {"type": "object", "required": ["event_id", "note"], "properties": {"event_id": {}, "event_type": {"enum": ["click", "view"]}, "value": {"type": "number", "minimum": 10, "maximum": 100}, "note": {"type": "string", "default": "none"}}, "additionalProperties": False}


@query("repair_documents", "SELECT event_id, true AS valid, CASE WHEN event_type IN ('click', 'view') THEN event_type ELSE 'click' END AS event_type, least(greatest(value, 10), 100)::DOUBLE AS value, 'none' AS note FROM events")
def repair_documents_query(spark, sf_dir):
    from .operators.documents import repair_documents

    out = repair_documents(_event_docs(spark, sf_dir), _DOC_REPAIR, ["event_id"])
    d = F.from_json("doc", "event_type string, value double, note string")
    return out.select("event_id", "valid", d.event_type.alias("event_type"), d.value.alias("value"), d.note.alias("note"))


GENERATED = {"type": "object", "required": ["mail", "size"], "properties": {"mail": {"type": "string", "format": "email"}, "size": {"type": "integer", "minimum": 3, "multipleOf": 5}, "kind": {"enum": ["b", "a"]}}, "minProperties": 3}


@query("generate_instances", f"{_states('email', '(SELECT i FROM range(1000) t(i))', 'i')} SELECT i AS instance_id, '{{\"mail\":\"user.' || {_B36} || '@example.test\",\"size\":5,\"kind\":\"b\"}}' AS doc FROM s4")
def generate_instances(spark, sf_dir):
    from .operators.generate import generate

    return generate(spark, GENERATED, 1000)


@query("generate_valid_rate", "SELECT 100::BIGINT AS n, 100::BIGINT AS valid")
def generate_valid_rate(spark, sf_dir):
    """What is generated is valid under the contract it came from."""
    from .operators.documents import validate_documents
    from .operators.generate import generate

    v = validate_documents(generate(spark, GENERATED, 100), GENERATED, ["instance_id"], formats=True)
    return v.agg(F.count("*").alias("n"), F.count_if("valid").alias("valid"))


_VALID_EVENT = " AND ".join(f"NOT ({c})" for c in _EVENT_BAD.values())
#: The targets of EVENTS that rows can hit, written out as those of COVERED are.
_EVENT_TARGETS = [
    ("structure", "SCHEMA_NODE", "#", "", "true"),
    ("structure", "SCHEMA_NODE", "#/properties/event_id", "", "event_id IS NOT NULL"),
    ("structure", "SCHEMA_NODE", "#/properties/event_type", "", "event_type IS NOT NULL"),
    *[("enum", "ENUM_VALUE_HIT", "#/properties/event_type", f'{{"enumIndex":{i},"enumValue":"{v}"}}', f"event_type = '{v}'") for i, v in enumerate(("click", "view", "purchase", "refund"))],
    ("structure", "PROPERTY_PRESENT", "#/properties/value", '{"propertyName":"value"}', "value IS NOT NULL"),
    ("structure", "SCHEMA_NODE", "#/properties/value", "", "value IS NOT NULL"),
    ("boundaries", "NUMERIC_MIN_HIT", "#/properties/value", '{"boundaryKind":"minimum","boundaryValue":1}', "value = 1"),
    ("boundaries", "NUMERIC_MAX_HIT", "#/properties/value", '{"boundaryKind":"maximum","boundaryValue":400}', "value = 400"),
    ("structure", "PROPERTY_PRESENT", "#/properties/user_id", '{"propertyName":"user_id"}', "user_id IS NOT NULL"),
    ("structure", "SCHEMA_NODE", "#/properties/user_id", "", "user_id IS NOT NULL"),
    ("branches", "ANYOF_BRANCH", "#/properties/user_id/anyOf/0", '{"index":0}', "user_id <= 50"),
    ("branches", "ANYOF_BRANCH", "#/properties/user_id/anyOf/1", '{"index":1}', "user_id >= 100"),
    ("branches", "CONDITIONAL_PATH", "#", '{"pathKind":"IF_THEN"}', "event_type = 'purchase'"),
    ("branches", "CONDITIONAL_PATH", "#", '{"pathKind":"IF_ELSE"}', "event_type <> 'purchase'"),
]


@query("stream_coverage", f"SELECT * FROM ({_hits_sql(_VALID_EVENT, _EVENT_TARGETS)}) WHERE n > 0")
def stream_coverage(spark, sf_dir):
    """Hits of valid rows, accumulated by a Structured Streaming query over the events' file."""
    import uuid

    from .functions.lineage import shared_path
    from .streaming.accumulate import hits_stream

    name = f"coverage_{uuid.uuid4().hex}"
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet" if not sf_dir.endswith("/") else "*").parquet(f"{sf_dir}/event[s].parquet")
    found = hits_stream(stream.select("event_id", "event_type", "value", "user_id"), EVENTS)
    q = found.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", shared_path(spark, "stream")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


# --- planning over a corpus of contracts -------------------------------------------------------------------------

CORPUS = [
    ("bounds", {"type": "integer", "minimum": 3, "maximum": 2}),
    ("closed", {"type": "object", "required": ["b"], "properties": {"a": {}}, "additionalProperties": False}),
    ("fine", {"type": "object", "properties": {"a": {"nullable": True, "type": "string"}}}),
    ("names", {"type": "object", "propertyNames": {"enum": ["a"]}, "minProperties": 2}),
    ("bag", {"type": "array", "maxItems": 2, "allOf": [{"contains": {"const": 1}, "minContains": 2}, {"contains": {"const": 2}}]}),
]


@query("compose_proofs", "SELECT * FROM (VALUES ('bounds', 'UNSAT_NUMERIC_BOUNDS', '#'), ('closed', 'UNSAT_REQUIRED_AP_FALSE', '#'), ('names', 'UNSAT_MINPROPS_PNAMES', '#'), ('bag', 'UNSAT_CONTAINS_BAG', '#')) t(contract_id, code, path)")
def compose_proofs(spark, sf_dir):
    """Contracts planned in parallel, a row for each proof."""
    import json

    from .plans.corpus import plan_contracts

    df = spark.createDataFrame([(k, json.dumps(s)) for k, s in CORPUS], "contract_id string, text string")
    return plan_contracts(df).where(F.col("code").startswith("UNSAT_")).select("contract_id", "code", "path")


@query("normalize_schema", "SELECT * FROM (VALUES ('items', '{\"$defs\":{\"x\":true},\"items\":false,\"prefixItems\":[{\"const\":1}]}'), ('nullable', '{\"type\":[\"string\",\"null\"]}')) t(contract_id, canonical)")
def normalize_schema(spark, sf_dir):
    import json

    from .plans.corpus import canonical_contracts

    cases = [("items", {"definitions": {"x": True}, "items": [{"enum": [1]}], "additionalItems": False}), ("nullable", {"type": "string", "nullable": True})]
    return canonical_contracts(spark.createDataFrame([(k, json.dumps(s)) for k, s in cases], "contract_id string, text string"))


@query(
    "corpus_harness",
    """SELECT * FROM (VALUES ('bounds', 0::BIGINT, 0::BIGINT, 0::BIGINT, true, NULL), ('bag', 0::BIGINT, 0::BIGINT, 0::BIGINT, true, NULL), ('broken', 0::BIGINT, 0::BIGINT, 0::BIGINT, false, 'CONTRACT_PARSE'), ('closed', 0::BIGINT, 0::BIGINT, 0::BIGINT, true, NULL),
       ('fine', 20::BIGINT, 20::BIGINT, 0::BIGINT, false, NULL), ('mail', 20::BIGINT, 20::BIGINT, 0::BIGINT, false, NULL), ('names', 0::BIGINT, 0::BIGINT, 0::BIGINT, true, NULL)) t(contract_id, instances, valid, invalid, unsat, failed)""",
)
def corpus_harness(spark, sf_dir):
    """Contracts generated, repaired and validated in parallel."""
    import json

    from .plans.corpus import run_corpus

    texts = [*((k, json.dumps(c)) for k, c in CORPUS), ("mail", json.dumps(GENERATED)), ("broken", "{")]
    return run_corpus(spark.createDataFrame(texts, "contract_id string, text string"), 20).select("contract_id", "instances", "valid", "invalid", "unsat", "failed")


# --- motifs, hints, operations -----------------------------------------------------------------------------------

MIXED = {
    "type": "object",
    "properties": {
        "open": {"type": "object", "properties": {"a": {"type": "string"}}},
        "closed": {"type": "object", "properties": {"a": {}}, "additionalProperties": False},
        "bag": {"type": "array", "items": {"type": "integer"}, "contains": {"const": 1}},
        "set": {"type": "array", "contains": {"const": 1}, "uniqueItems": True},
        "pick": {"anyOf": [{"properties": {"b": {}}}, {"not": {"required": ["c"]}, "properties": {"c": {}}}], "enum": ["x", "y"]},
        "sealed": {"unevaluatedProperties": False, "properties": {"d": {"properties": {"e": {}}}}},
    },
}


@query(
    "motif_classes",
    """SELECT '#' || p AS canon_path, m AS motif, m IN ('simpleObjectRequired', 'arrayItemsContainsSimple') AS generates_valid FROM (VALUES
        ('', 'simpleObjectRequired'), ('/properties/open', 'simpleObjectRequired'), ('/properties/open/properties/a', 'none'), ('/properties/closed', 'apFalseMustCover'), ('/properties/closed/properties/a', 'none'),
        ('/properties/bag', 'arrayItemsContainsSimple'), ('/properties/bag/items', 'none'), ('/properties/bag/contains', 'none'), ('/properties/set', 'none'), ('/properties/set/contains', 'none'),
        ('/properties/pick', 'none'), ('/properties/pick/anyOf/0', 'simpleObjectRequired'), ('/properties/pick/anyOf/0/properties/b', 'none'), ('/properties/pick/anyOf/1', 'none'), ('/properties/pick/anyOf/1/properties/c', 'none'),
        ('/properties/sealed', 'none'), ('/properties/sealed/properties/d', 'none'), ('/properties/sealed/properties/d/properties/e', 'none')) t(p, m)""",
)
def motif_classes(spark, sf_dir):
    rows = [(p, m, M.generates_valid(m)) for p, m in M.motifs(MIXED, {"#/properties/closed"}).items()]
    return spark.createDataFrame(rows, "canon_path string, motif string, generates_valid boolean")


_HINTS = [
    ("ensurePropertyPresence", "#", "open", True, None, None, None, None),
    ("ensurePropertyPresence", "#/properties/closed", "b", True, None, None, "CONFLICTING_CONSTRAINTS", "CoverageIndex forbids property 'b' under #/properties/closed (AP:false)."),
    ("ensurePropertyPresence", "#/properties/pick/anyOf/1", "c", True, None, None, "CONFLICTING_CONSTRAINTS", "Property 'c' is forbidden by not/required at #/properties/pick/anyOf/1."),
    ("ensurePropertyPresence", "#/properties/sealed", "d", True, None, None, "CONFLICTING_CONSTRAINTS", "Property 'd' at #/properties/sealed/properties/d is blocked by Compose diagnostics"),
    ("preferBranch", "#/properties/pick/anyOf", None, None, 0, None, "UNREACHABLE_BRANCH", "Branch 0 at #/properties/pick/anyOf/0 is unreachable via Compose UNSAT signals."),
    ("preferBranch", "#/properties/pick/anyOf", None, None, 1, None, None, None),
    ("coverEnumValue", "#/properties/pick", None, None, None, 1, None, None),
    ("coverEnumValue", "#/properties/pick", None, None, None, 2, "CONFLICTING_CONSTRAINTS", "Enum at #/properties/pick contains 2 values, index 2 is out of range."),
    ("preferBranch", "#", None, None, None, None, None, None),
]


def _value(v) -> str:
    return "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else _text(v)


@query("coverage_conflicts", "SELECT kind, canon_path, property_name, branch_index::INT AS branch_index, value_index::INT AS value_index, reason_code, reason_detail, kind <> 'preferBranch' OR branch_index IS NOT NULL AS well_formed FROM (VALUES " + ", ".join(f"({', '.join(_value(v) for v in (*h[:3], *h[4:]))})" for h in _HINTS) + ") t(kind, canon_path, property_name, branch_index, value_index, reason_code, reason_detail)")
def coverage_conflicts(spark, sf_dir):
    hints = spark.createDataFrame([h[:6] for h in _HINTS], HI.HINT)
    nodes = HI.places(spark, MIXED, {"#/properties/closed": {"a"}})
    found = HI.conflicts(hints, nodes, ["#/properties/sealed/properties/d", "#/properties/pick/anyOf/0"])
    return found.withColumn("well_formed", HI.is_hint()).drop("target_id", "present")


_PLACES = "(SELECT DISTINCT 's' || c_mktsegment AS canon_path FROM customer UNION SELECT DISTINCT 'n' || n_nationkey FROM nation UNION SELECT 'unused')"


@query("coverage_operation_keys", f"{_REACH} SELECT p.canon_path, list_sort(list(DISTINCT operation) FILTER (WHERE operation IS NOT NULL)) AS op_keys FROM {_PLACES} p LEFT JOIN reach ON node = canon_path GROUP BY 1")
def coverage_operation_keys(spark, sf_dir):
    places = table(spark, sf_dir, "customer").select(F.concat(F.lit("s"), "c_mktsegment").alias("canon_path")).union(table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey"))).union(spark.createDataFrame([("unused",)], "canon_path string")).distinct()
    return C.attach_operations(places, _reach(spark, sf_dir))


@query("schema_reused_targets", f"""{_REACH} SELECT 'cov:0:1:' || sha256('{{"canonPath":"' || node || '","dimension":"operations","engineMajor":0,"kind":"SCHEMA_REUSED_COVERED","operationKey":null,"params":null,"reportMajor":1,"v":1}}') AS id, 'operations' AS dimension, 'SCHEMA_REUSED_COVERED' AS kind, node AS canon_path, 'deprecated' AS status, list_sort(list(DISTINCT operation)) AS op_keys FROM reach GROUP BY node HAVING count(DISTINCT operation) > 1""")
def schema_reused_targets(spark, sf_dir):
    return C.reused_targets(_reach(spark, sf_dir))


_RATIO_LINE = "string_agg(dimension || '=' || printf('%.3f', ratio), ', ' ORDER BY dimension)"


@query(
    "coverage_summary_line",
    f"""WITH c AS (SELECT * FROM {_covered_sql()}), d AS (SELECT dimension, count(*) FILTER (WHERE hit)::DOUBLE / count(*) AS ratio FROM c GROUP BY 1),
        o AS (SELECT operation, count(*) FILTER (WHERE hit)::DOUBLE / count(*) AS ratio FROM (SELECT unnest({_OPS}) AS operation, hit FROM c) GROUP BY 1)
        SELECT 'coverage by dimension: ' || (SELECT {_RATIO_LINE} FROM d) || ' | coverage by operation: ' || (SELECT string_agg(operation || '=' || printf('%.3f', ratio), ', ' ORDER BY ratio, operation) FROM o)
            || ' | coverage overall: ' || printf('%.3f', (SELECT count(*) FILTER (WHERE hit)::DOUBLE / count(*) FROM c)) || ' | targets by status: active=' || (SELECT count(*) FROM c) || ' | planner caps: 0, unsatisfied hints: 0' AS line""",
)
def coverage_summary_line(spark, sf_dir):
    return C.summary_line(_with_ops(_covered(spark, sf_dir)))


@query("coverage_target_keys", f"SELECT id || '|' || dimension || '|' || kind || '|' || canon_path || '|' AS key FROM {_targets_sql()}")
def coverage_target_keys(spark, sf_dir):
    return C.targets(spark, COVERED).select(C.target_key().alias("key"))


# --- numbers -----------------------------------------------------------------------------------------------------

_SCALED = "(l_extendedprice * 10.0::DOUBLE)"


def _quantized(v: str, factor: str) -> str:
    """Half to even at a decimal factor, with ties within 1e-12."""
    part, low = f"({v} * {factor} - floor({v} * {factor}))", f"floor({v} * {factor})"
    return f"(CASE WHEN {part} > 0.5::DOUBLE + 1e-12::DOUBLE THEN {low} + 1 WHEN {part} < 0.5::DOUBLE - 1e-12::DOUBLE THEN {low} WHEN {low} % 2 = 0 THEN {low} ELSE {low} + 1 END / {factor})"


@query("num_quantize", f"SELECT l_orderkey, l_linenumber, {_quantized('l_extendedprice', '10.0::DOUBLE')} AS tenth, {_quantized('(l_quantity / 2.0::DOUBLE)', '1.0::DOUBLE')} AS half FROM lineitem")
def num_quantize(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", N.quantize(F.col("l_extendedprice"), 1).alias("tenth"), N.quantize(F.col("l_quantity") / 2, 0).alias("half"))


@query("num_multiple", f"SELECT l_orderkey, l_linenumber, abs(l_extendedprice / 0.25::DOUBLE - floor(l_extendedprice / 0.25::DOUBLE + 0.5::DOUBLE)) < 1e-12 AS plain, abs({_quantized('l_extendedprice', '1.0::DOUBLE')} / 3.0::DOUBLE - floor({_quantized('l_extendedprice', '1.0::DOUBLE')} / 3.0::DOUBLE + 0.5::DOUBLE)) < 1 AS quantized FROM lineitem")
def num_multiple(spark, sf_dir):
    v = F.col("l_extendedprice")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", N.is_multiple(v, F.lit(0.25)).alias("plain"), N.is_multiple_quantized(v, F.lit(3.0), 0).alias("quantized"))


@query("num_align", "SELECT c_custkey, CASE WHEN c_acctbal % 50.0::DOUBLE = 0 THEN c_acctbal ELSE c_acctbal + (50.0::DOUBLE - c_acctbal % 50.0::DOUBLE) END AS aligned, c_acctbal AS same FROM customer")
def num_align(spark, sf_dir):
    v = F.col("c_acctbal")
    return table(spark, sf_dir, "customer").select("c_custkey", N.align_up(v, F.lit(50.0)).alias("aligned"), N.align_up(v, F.lit(0.0)).alias("same"))


# --- more reports ------------------------------------------------------------------------------------------------

_CODE = "CASE event_type WHEN 'click' THEN 'REGEX_COMPLEXITY_CAPPED' WHEN 'view' THEN 'SOLVER_TIMEOUT' WHEN 'refund' THEN 'NAME_AUTOMATON_COMPLEXITY_CAPPED' ELSE 'OTHER' END"
_KIND = "CASE event_type WHEN 'click' THEN 'compose_warn' WHEN 'view' THEN 'compose_run_level' WHEN 'refund' THEN 'compose_fatal' ELSE 'validate_errors' END"


def _diagnostics(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("schema_id"), F.expr(_CODE).alias("code"), F.expr(_KIND).alias("kind"), F.concat(F.lit("#/u/"), "user_id").alias("canon_path"), F.to_json(F.struct(F.col("event_type").alias("Type"))).alias("details"))


@query("corpus_caps", f"SELECT user_id AS schema_id, count(*) FILTER (WHERE {_CODE} = 'REGEX_COMPLEXITY_CAPPED') AS regex_capped, count(*) FILTER (WHERE {_CODE} = 'NAME_AUTOMATON_COMPLEXITY_CAPPED') AS name_automaton_capped, count(*) FILTER (WHERE {_CODE} = 'SOLVER_TIMEOUT') AS smt_timeouts FROM events GROUP BY 1")
def corpus_caps(spark, sf_dir):
    return RP.caps(_diagnostics(spark, sf_dir), "schema_id")


def _bench_runs(spark, sf_dir) -> DataFrame:
    kinds = [F.count_if(F.col("kind") == k).alias(k) for k in RP.COUNTED]
    return _diagnostics(spark, sf_dir).groupBy("schema_id").agg(F.count("*").alias("instances"), F.count_if(F.col("code") == "OTHER").alias("invalid"), *kinds)


@query("bench_totals", f"SELECT count(DISTINCT user_id) AS schemas, count(*) AS instances, {', '.join(f'count(*) FILTER (WHERE {_KIND} = {_text(k)}) AS {k}' for k in RP.COUNTED)}, count(*) FILTER (WHERE {_CODE} = 'OTHER') AS invalid FROM events")
def bench_totals(spark, sf_dir):
    return RP.totals(_bench_runs(spark, sf_dir))


@query("bench_worst_first", "SELECT schema_id, level, row_number() OVER (ORDER BY CASE level WHEN 'blocked' THEN 1 WHEN 'limited' THEN 2 ELSE 3 END, schema_id)::BIGINT AS place FROM (SELECT user_id AS schema_id, CASE WHEN count(*) FILTER (WHERE event_type = 'refund') > 8 THEN 'blocked' WHEN count(*) FILTER (WHERE event_type = 'view') > 20 THEN 'limited' ELSE 'ok' END AS level FROM events GROUP BY 1)")
def bench_worst_first(spark, sf_dir):
    """Contracts, as many as the corpus has, by level and id."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("schema_id")).agg(F.count_if(F.col("event_type") == "refund").alias("f"), F.count_if(F.col("event_type") == "view").alias("v"))
    level = F.when(F.col("f") > 8, "blocked").when(F.col("v") > 20, "limited").otherwise("ok")
    return e.select("schema_id", level.alias("level")).withColumn("place", F.row_number().over(Window.orderBy(*RP.worst_first())).cast("long"))


@query("diag_filter", f"SELECT event_id, {_CODE} AS code FROM events WHERE {_KIND} IN ('compose_warn', 'validate_errors') AND contains(lower({_CODE} || ' #/u/' || user_id || ' {{\"Type\":\"' || event_type || '\"}}'), 'click')")
def diag_filter(spark, sf_dir):
    return RP.filtered(_diagnostics(spark, sf_dir), ("compose_warn", "validate_errors"), " Click ").select("event_id", "code")


_FIX = {"low": "l_quantity < 5", "high": "l_quantity >= 50", "rate": "l_discount > 0.08"}
_N_FIX = " + ".join(f"({c})::INT" for c in _FIX.values())


def _repaired_lines(spark, sf_dir) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("instance_id"), "l_quantity", "l_discount")
    return R.repair(lines, _REPAIRED)


@query("report_build", f"SELECT l_orderkey || '-' || l_linenumber AS instance_id, CASE WHEN {_N_FIX} = 0 THEN 'valid' ELSE 'repaired' END AS outcome, ({_N_FIX})::BIGINT AS n_actions, list_concat(list_concat(CASE WHEN {_FIX['high']} THEN ['exclusiveMaximum'] ELSE [] END, CASE WHEN {_FIX['rate']} THEN ['maximum'] ELSE [] END), CASE WHEN {_FIX['low']} THEN ['minimum'] ELSE [] END) AS keywords FROM lineitem")
def report_build(spark, sf_dir):
    return RP.build_report(_repaired_lines(spark, sf_dir), "instance_id")


@query("report_summary", f"SELECT * FROM (SELECT count(*) AS instances, count(*) FILTER (WHERE {_N_FIX} = 0) AS valid, count(*) FILTER (WHERE {_N_FIX} > 0) AS repaired, 0::BIGINT AS invalid, sum({_N_FIX})::BIGINT AS actions FROM lineitem), (SELECT {', '.join(f'count(*) FILTER (WHERE {_KIND} = {_text(k)}) AS {k}' for k in RP.COUNTED)} FROM events)")
def report_summary(spark, sf_dir):
    return RP.report_summary(RP.build_report(_repaired_lines(spark, sf_dir), "instance_id"), _diagnostics(spark, sf_dir))


@query("report_actions", f"SELECT l_orderkey || '-' || l_linenumber AS instance_id, sum({_N_FIX})::BIGINT AS n FROM lineitem GROUP BY 1 HAVING sum({_N_FIX}) > 0")
def report_actions(spark, sf_dir):
    actions = _repaired_lines(spark, sf_dir).select("instance_id", F.inline("actions"))
    return RP.actions_by_instance(actions).select("instance_id", F.size("actions").cast("long").alias("n"))


@query("repair_budget", "SELECT l_orderkey, l_linenumber, 'UNSAT_BUDGET_EXHAUSTED' AS code, 1::BIGINT AS last_errors FROM lineitem WHERE l_quantity < 10")
def repair_budget(spark, sf_dir):
    """A contract that no value meets: the clamp to 10 and the one to 5 undo each other, and the row goes back."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity").where("l_quantity < 10 or l_quantity > 40")
    out = R.repair(lines, _one("l_quantity", {"minimum": 10, "not": {"maximum": 10}}), attempts=2)
    return R.budget_exhausted(out, 2).select("l_orderkey", "l_linenumber", "code", F.col("last_errors").cast("long").alias("last_errors"))


@query(
    "diag_envelope",
    f"""SELECT event_id, CASE WHEN event_type = 'click' AND value > 300 THEN 'phase' WHEN event_type = 'refund' THEN 'forbidden key' WHEN event_type = 'view' AND value > 100 THEN 'not of this phase' WHEN event_type = 'click' THEN 'context' END AS fault
        FROM events WHERE event_type IN ('click', 'refund') OR event_type = 'view' AND value > 100""",
)
def diag_envelope(spark, sf_dir):
    """Diagnostics that break the envelope's rules or come from a phase that may not raise them."""
    from .operators.diagnostics import faults

    d = _diagnostics(spark, sf_dir).join(table(spark, sf_dir, "events").select("event_id", "value", "event_type"), "event_id")
    phase = F.when((F.col("event_type") == "click") & (F.col("value") > 300), "later").when((F.col("event_type") == "view") & (F.col("value") > 100), "repair").otherwise("compose")
    details = F.when(F.col("event_type") == "refund", F.lit('{"a":[{"canonPath":"#"}]}')).otherwise(F.col("details"))
    return faults(d.withColumns({"phase": phase, "details": details}), {"SOLVER_TIMEOUT": ("compose",)}).select("event_id", "fault")


@query("repair_rename", "SELECT event_id, CASE WHEN event_type = 'click' THEN ['a', 'b'] WHEN event_type = 'view' THEN ['a', 'c'] ELSE ['a'] END AS names FROM events")
def repair_rename(spark, sf_dir):
    """Names that a closed enumeration forbids take its first free name; where a dependency would break the next one; else they go."""
    from .operators.documents import repair_documents

    e = table(spark, sf_dir, "events")
    doc = F.when(F.col("event_type") == "click", F.lit('{"a":1,"x":2}')).when(F.col("event_type") == "view", F.lit('{"a":"tied","x":2}')).otherwise(F.lit('{"a":1,"b":2,"c":3,"x":2}'))
    doc = F.when(F.col("event_type").isin("click", "view"), doc).otherwise(F.lit('{"a":1,"needed":2}'))
    contract = {"propertyNames": {"enum": ["a", "b", "c"]}, "dependentSchemas": {"b": {"properties": {"a": {"type": "integer"}}}}, "dependentRequired": {"needed": ["a"]}}
    out = repair_documents(e.select("event_id", doc.alias("doc")), contract, ["event_id"])
    return out.select("event_id", F.sort_array(F.map_keys(F.from_json("doc", "map<string,string>"))).alias("names"))


# --- planning, case by case: what is expected is written out -------------------------------------------------------

_DRAFT4 = "http://json-schema.org/draft-04/schema#"
RULES = [
    ("all_false", {"allOf": [{"minimum": 1}, False]}, "false"),
    ("all_true", {"allOf": [True, {"minimum": 1}]}, '{"allOf":[{"minimum":1}]}'),
    ("any_false", {"anyOf": [False, {"minimum": 1}]}, '{"anyOf":[{"minimum":1}]}'),
    ("any_true", {"anyOf": [{"minimum": 1}, True]}, "{}"),
    ("definitions", {"definitions": {"a": {"type": "string"}}, "$ref": "#/definitions/a"}, '{"$defs":{"a":{"type":"string"}},"$ref":"#/$defs/a"}'),
    ("exclusive", {"$schema": _DRAFT4, "id": "http://x/a", "minimum": 1, "exclusiveMinimum": True}, f'{{"$id":"http://x/a","$schema":"{_DRAFT4}","exclusiveMinimum":1}}'),
    ("inclusive", {"$schema": _DRAFT4, "maximum": 5, "exclusiveMaximum": False}, f'{{"$schema":"{_DRAFT4}","maximum":5}}'),
    ("names", {"type": "object", "propertyNames": {"enum": ["a", "b"]}}, '{"additionalProperties":false,"patternProperties":{"^(?:a|b)$":true},"propertyNames":{"enum":["a","b"]},"type":"object"}'),
    ("nullable", {"properties": {"a": {"type": "integer", "nullable": True}}}, '{"properties":{"a":{"type":["integer","null"]}}}'),
    ("one_false", {"oneOf": [False, {"minimum": 1}]}, '{"allOf":[{"minimum":1}]}'),
    ("one_value", {"enum": ["x"]}, '{"const":"x"}'),
    ("tuple", {"items": [{"type": "string"}, {}], "additionalItems": {"type": "integer"}}, '{"items":{"type":"integer"},"prefixItems":[{"type":"string"},{}]}'),
]


def _cases(values: list[tuple], names: str) -> str:
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(_text, v)) + ')' for v in values)}) t({names})"


@query("normalize_rules", _cases([(k, want) for k, _, want in RULES], "contract_id, canonical"))
def normalize_rules(spark, sf_dir):
    import json

    from .plans.corpus import canonical_contracts

    return canonical_contracts(spark.createDataFrame([(k, json.dumps(c)) for k, c, _ in RULES], "contract_id string, text string"))


#: Contracts with the code of planning that each must raise, and where.
PROOFS = [
    ("bag_bounds", {"type": "array", "contains": {"type": "integer"}, "minContains": 3, "maxContains": 2}, "UNSAT_CONTAINS_BAG", "#"),
    ("bag_need", {"type": "array", "contains": {"const": 1}, "minContains": 3, "maxItems": 2}, "UNSAT_CONTAINS_BAG", "#"),
    ("bag_sum", {"type": "array", "maxItems": 3, "allOf": [{"contains": {"const": 1}, "minContains": 2}, {"contains": {"const": 2}, "minContains": 2}]}, "UNSAT_CONTAINS_BAG", "#"),
    ("bag_within", {"type": "array", "maxItems": 2, "allOf": [{"contains": {"type": "integer"}}, {"contains": {"const": 2}, "minContains": 2}]}, None, None),
    ("both_closed", {"allOf": [{"properties": {"a": {}}, "additionalProperties": False}, {"properties": {"b": {}}, "additionalProperties": False}], "required": ["a"]}, "UNSAT_REQUIRED_AP_FALSE", "#"),
    ("no_integer", {"type": "integer", "exclusiveMinimum": 3, "exclusiveMaximum": 4}, "UNSAT_NUMERIC_BOUNDS", "#"),
    ("a_number", {"type": "number", "exclusiveMinimum": 3, "exclusiveMaximum": 4}, None, None),
    ("no_pattern", {"properties": {"a": {"pattern": "("}}}, "REGEX_COMPILE_ERROR", "#/properties/a"),
    ("overlap", {"properties": {}, "patternProperties": {"^a[bc]$": {}, "^ab$": {}}, "additionalProperties": False}, "AP_FALSE_PATTERN_OVERLAP", "#"),
    ("apart", {"properties": {}, "patternProperties": {"^a[bc]$": {}, "^ad$": {}}, "additionalProperties": False}, None, None),
]


@query("compose_diagnostics", _cases([(k, code, at) for k, _, code, at in PROOFS if code], "contract_id, code, path"))
def compose_diagnostics(spark, sf_dir):
    """Every diagnostic of composition, not proofs alone."""
    import json

    from .plans.corpus import plan_contracts

    df = spark.createDataFrame([(k, json.dumps(c)) for k, c, _, _ in PROOFS], "contract_id string, text string")
    return plan_contracts(df).where("phase = 'compose'").select("contract_id", "code", "path")


#: Contracts with the instance that generation must give.
INSTANCES = [
    ("align", {"type": "integer", "minimum": 4, "multipleOf": 6}, "6"),
    ("bag", {"type": "array", "contains": {"const": 7}, "minContains": 2, "items": {"type": "integer"}}, "[7,7]"),
    ("common_multiple", {"allOf": [{"multipleOf": 4}, {"multipleOf": 6}], "type": "integer", "minimum": 1}, "12"),
    ("const", {"const": {"k": [1]}}, '{"k":[1]}'),
    ("dependent", {"type": "object", "required": ["a"], "properties": {"a": {"type": "boolean"}, "b": {"type": "string"}}, "dependentRequired": {"a": ["b"]}}, '{"a":false,"b":""}'),
    ("length", {"type": "string", "minLength": 3}, '"aaa"'),
    ("merged", {"allOf": [{"minimum": 3}, {"maximum": 3}, {"type": "integer"}]}, "3"),
    ("pattern", {"type": "string", "pattern": "^ab+c$"}, '"abc"'),
    ("ref", {"$ref": "#/$defs/n", "$defs": {"n": {"enum": [5, 6]}}}, "5"),
    ("then", {"type": "object", "if": {"required": ["a"]}, "then": {"required": ["b"], "properties": {"b": {"const": 2}}}, "required": ["a"], "properties": {"a": {"const": 1}}}, '{"a":1,"b":2}'),
    ("tuple", {"type": "array", "prefixItems": [{"const": 1}, {"const": "x"}], "minItems": 2}, '[1,"x"]'),
    ("unique", {"type": "array", "items": {"type": "integer"}, "minItems": 2, "uniqueItems": True}, "[0,1]"),
]


@query("generate_cases", _cases([(k, doc) for k, _, doc in INSTANCES], "contract_id, doc"))
def generate_cases(spark, sf_dir):
    from .operators.generate import generate

    out = None
    for k, c, _ in INSTANCES:
        one = generate(spark, c, 1, 7).select(F.lit(k).alias("contract_id"), "doc")
        out = one if out is None else out.unionAll(one)
    return out


_API = {
    "paths": {
        "/x": {"get": {"responses": {"404": {}, "201": {"content": {"text/plain": {"schema": {"const": "t"}}, "application/json": {"schema": {"const": 1}, "example": 1}}}}}},
        "/y": {"post": {"operationId": "make", "responses": {"default": {"content": {"application/problem+json": {"schema": {"const": 2}}}}, "5XX": {"content": {"text/plain": {"schema": {"const": 3}}}}}}},
    }
}


@query("openapi_operations", _cases([("GET /x", "201", '{"const":1}'), ("make", "default", '{"const":2}')], "operation, status, contract"))
def openapi_operations(spark, sf_dir):
    """The response that is chosen for each operation of an OpenAPI document."""
    from .sources.files import operations, select_response

    rows = []
    for o in operations(_API):
        found = select_response(_API, o["key"])
        rows.append((o["key"], found["status"], H.canonical_json(found["schema"])))
    return spark.createDataFrame(rows, "operation string, status string, contract string")


@query("unevaluated_documents", "SELECT event_id, event_type = 'view' AND value <= 250 OR event_type = 'click' AND user_id <= 6 AS valid FROM events")
def unevaluated_documents(spark, sf_dir):
    """Keywords that only the text path has: references and what applicators leave unevaluated."""
    from .operators.documents import validate_documents

    docs = _event_row(table(spark, sf_dir, "events")).select("event_id", F.to_json(F.struct("*")).alias("doc"))
    kind = lambda v, **more: {"properties": {"kind": {"const": v}, **more}, "required": ["kind"]}
    contract = {"$defs": {"view": kind("view", x_user={"$ref": "#/$defs/n"}), "n": {"type": "integer"}}, "properties": {"event_id": True}, "anyOf": [{"$ref": "#/$defs/view"}, kind("click", amount={"$ref": "#/$defs/any"})], "unevaluatedProperties": False}
    contract["$defs"]["any"] = {"type": "number"}
    return validate_documents(docs, contract, ["event_id"]).select("event_id", "valid")
