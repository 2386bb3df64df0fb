"""Hints of coverage planning: which are well formed, and which contradict the contract, as joins on its places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import escape_pointer

HINT = "kind string, canon_path string, property_name string, present boolean, branch_index int, value_index int"
NODE = "canon_path string, forbidden array<string>, allowed array<string>, n_any int, n_one int, n_branches int, n_enum int"
_BELOW = ("anyOf", "oneOf", "allOf", "prefixItems")


def is_hint() -> Column:
    """Whether a row of HINT has what its kind needs."""
    own = (
        F.when(F.col("kind") == "preferBranch", F.col("branch_index").isNotNull())
        .when(F.col("kind") == "ensurePropertyPresence", F.col("property_name").isNotNull() & F.col("present").isNotNull())
        .when(F.col("kind") == "coverEnumValue", F.col("value_index").isNotNull())
        .otherwise(F.lit(False))
    )
    return F.coalesce(own & (F.length("canon_path") > 0), F.lit(False))


def places(spark: SparkSession, schema, index: dict[str, set[str]] | None = None) -> DataFrame:
    """A row of NODE for each place of a contract. index: the names that closed objects admit, by path."""
    rows, todo = [], [(schema, "#")]
    while todo:
        node, path = todo.pop()
        if isinstance(node, list):  # the branches of a union are a place of their own
            rows.append((path, None, None, None, None, len(node), None))
            todo += [(s, f"{path}/{i}") for i, s in enumerate(node)]
            continue
        if not isinstance(node, dict):
            continue
        banned = node["not"].get("required") if isinstance(node.get("not"), dict) else None
        size = {k: len(node[k]) if isinstance(node.get(k), list) else None for k in ("anyOf", "oneOf", "enum")}
        names = (index or {}).get(path)
        rows.append((path, [x for x in banned or () if isinstance(x, str)], None if names is None else sorted(names), size["anyOf"], size["oneOf"], None, size["enum"]))
        for key, value in node.items():
            if key in ("properties", "patternProperties", "$defs") and isinstance(value, dict):
                todo += [(s, f"{path}/{key}/{escape_pointer(k)}") for k, s in value.items()]
            elif key in _BELOW and isinstance(value, list) or key in ("items", "contains", "not", "if", "then", "else", "additionalProperties", "propertyNames") and isinstance(value, dict):
                todo.append((value, f"{path}/{key}"))
    return spark.createDataFrame(rows, NODE)


def _under(path: Column, unsat: Column) -> Column:
    """Whether a path is one of the unsatisfiable ones, or below one."""
    return F.coalesce(F.exists(unsat, lambda u: (path == u) | path.startswith(F.concat(u, F.lit("/")))), F.lit(False))


def conflicts(hints: DataFrame, nodes: DataFrame, unsat_paths: list[str], targets: DataFrame | None = None) -> DataFrame:
    """The hints with `reason_code` and `reason_detail`, both null where nothing is in the way.

    targets (optional): target_id, target_kind, dimension, status, reason (nullable) of what hints with a target_id are for. In order: the
    target is unreachable, its path is proven unsatisfiable, the contract forbids it, a closed object doesn't admit it,
    an index is out of range. Contract-sized tables, joined by path.
    """
    h = hints if "target_id" in hints.columns else hints.withColumn("target_id", F.lit(None).cast("string"))
    if targets is None:
        targets = hints.sparkSession.createDataFrame([], "target_id string, target_kind string, dimension string, status string, reason string")
    joined = h.join(nodes, "canon_path", "left").join(targets, "target_id", "left")
    path, name = F.col("canon_path"), F.col("property_name")
    unsat = F.array(*[F.lit(p) for p in unsat_paths]).cast("array<string>")
    token = F.replace(F.replace(name, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))
    own_path, branch_path = F.concat(path, F.lit("/properties/"), token), F.concat(F.regexp_replace(path, "/$", ""), F.lit("/"), F.col("branch_index").cast("string"))
    count = F.when(F.col("target_kind") == "ONEOF_BRANCH", F.coalesce("n_branches", "n_one")).when(F.col("target_kind") == "ANYOF_BRANCH", F.coalesce("n_branches", "n_any")).otherwise(F.when(F.col("target_id").isNotNull(), F.col("n_branches")))
    is_property, is_branch, is_value = (F.col("kind") == k for k in ("ensurePropertyPresence", "preferBranch", "coverEnumValue"))
    usable = is_hint() | is_property & name.isNotNull()
    marked = usable & (F.col("status") == "unreachable") & (F.coalesce("branch_index", "value_index", F.lit(0)) >= 0)
    blocked, text = "CONFLICTING_CONSTRAINTS", F.format_string
    cases = [
        (marked, F.when((F.col("dimension") == "branches") | F.col("target_kind").isin("ONEOF_BRANCH", "ANYOF_BRANCH"), "UNREACHABLE_BRANCH").otherwise(blocked), F.coalesce("reason", text("Target %s is unreachable", path))),
        (is_property & name.isNotNull() & (_under(own_path, unsat) | _under(path, unsat)), blocked, text("Property '%s' at %s is blocked by Compose diagnostics", name, own_path)),
        (is_property & F.array_contains("forbidden", name), blocked, text("Property '%s' is forbidden by not/required at %s.", name, path)),
        (is_property & ~F.array_contains("allowed", name), blocked, text("CoverageIndex forbids property '%s' under %s (AP:false).", name, path)),
        (is_branch & (F.col("branch_index") >= 0) & F.array_contains(unsat, branch_path), "UNREACHABLE_BRANCH", text("Branch %d at %s is unreachable via Compose UNSAT signals.", F.col("branch_index"), branch_path)),
        (is_branch & (F.col("branch_index") >= 0) & _under(path, unsat), "UNREACHABLE_BRANCH", text("Branch %d at %s is unreachable via Compose UNSAT signals.", F.col("branch_index"), path)),
        (is_branch & (F.col("branch_index") >= count), blocked, text("Branch index %d exceeds available branches (%d) at %s.", F.col("branch_index"), count, branch_path)),
        (is_value & (F.col("value_index") >= F.col("n_enum")), blocked, text("Enum at %s contains %d values, index %d is out of range.", path, F.col("n_enum"), F.col("value_index"))),
    ]
    code, detail = F.lit(None).cast("string"), F.lit(None).cast("string")
    for when, c, d in reversed(cases):
        when = F.coalesce(when, F.lit(False))
        code, detail = F.when(when, c if isinstance(c, Column) else F.lit(c)).otherwise(code), F.when(when, d).otherwise(detail)
    return joined.select(*h.columns, code.alias("reason_code"), detail.alias("reason_detail"))


def priority_order(enabled: list[str], wanted: list[str] | None, default: tuple[str, ...]) -> list[str]:
    """The enabled dimensions: those of the wanted order (or the default one) first, then the rest as they come."""
    return list(dict.fromkeys([*(d for d in (wanted or default) if d in enabled), *enabled]))
