"""Coverage: targets of a contract, hits of rows, ratios, planner caps and units, and diffs between runs.

Targets come from the contract on the driver (there are as many as the contract has places); whatever touches rows or
reports is joins and aggregates.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.hashing import XorShift32, canonical_json, escape_pointer
from ..functions.lineage import cut
from .predicates import Compiler

ENGINE_MAJOR, REPORT_MAJOR = 0, 1
DIMENSIONS = ("structure", "branches", "enum", "boundaries", "operations")
#: Fixed order in which the planner prefers dimensions.
PRIORITY = ("branches", "enum", "structure", "boundaries")
DIAGNOSTIC_KINDS = ("SCHEMA_REUSED_COVERED",)
TARGET = "id string, dimension string, kind string, canon_path string, op_key string, params_key string, status string, weight double"


def target_id(dimension: str, kind: str, path: str, op_key: str | None, params) -> str:
    body = {"v": 1, "engineMajor": ENGINE_MAJOR, "reportMajor": REPORT_MAJOR, "dimension": dimension, "kind": kind, "canonPath": path, "operationKey": op_key, "params": params}
    return f"cov:{ENGINE_MAJOR}:{REPORT_MAJOR}:{hashlib.sha256(canonical_json(body).encode()).hexdigest()}"


def analyze(schema, dimensions=DIMENSIONS) -> list[dict]:
    """The targets of a contract, in the order of its walk. Neither allOf nor not, patternProperties, $defs or $ref are descended into."""
    out: list[dict] = []

    def add(dimension, kind, path, params=None, weight=1.0):
        if dimension in dimensions:
            key = "" if params is None else canonical_json(params)
            out.append({"id": target_id(dimension, kind, path, None, params), "dimension": dimension, "kind": kind, "canon_path": path, "op_key": None, "params_key": key, "status": "active", "weight": weight, "params": params})

    def walk(node, path):
        if isinstance(node, bool):
            return
        add("structure", "SCHEMA_NODE", path)
        required = set(node.get("required", []))
        for k, s in node.get("properties", {}).items():
            here = f"{path}/properties/{escape_pointer(k)}"
            if k not in required:
                add("structure", "PROPERTY_PRESENT", here, {"propertyName": k})
            walk(s, here)
        for key in ("anyOf", "oneOf"):
            for i, s in enumerate(node.get(key, [])):
                add("branches", f"{key.upper()}_BRANCH", f"{path}/{key}/{i}", {"index": i})
                walk(s, f"{path}/{key}/{i}")
        if "if" in node:
            for key, kind in (("then", "IF_THEN"), ("else", "IF_ELSE")):
                if key in node:
                    add("branches", "CONDITIONAL_PATH", path, {"pathKind": kind})
            for key in ("if", "then", "else"):
                if key in node:
                    walk(node[key], f"{path}/{key}")
        for i, v in enumerate(node.get("enum", [])):
            add("enum", "ENUM_VALUE_HIT", path, {"enumIndex": i, "enumValue": v})
        for low, high, kind in (("minimum", "maximum", "NUMERIC"), ("exclusiveMinimum", "exclusiveMaximum", "NUMERIC"), ("minLength", "maxLength", "STRING"), ("minItems", "maxItems", "ARRAY")):
            for key in (low, high):
                if key in node:
                    name = {"NUMERIC": "NUMERIC_{}_HIT", "STRING": "STRING_{}_LENGTH_HIT", "ARRAY": "ARRAY_{}_ITEMS_HIT"}[kind]
                    add("boundaries", name.format("MIN" if key == low else "MAX"), path, {"boundaryKind": key, "boundaryValue": node[key]})
        for key in ("items", "contains", "additionalProperties", "unevaluatedProperties", "unevaluatedItems", "propertyNames"):
            if isinstance(node.get(key), dict):
                walk(node[key], f"{path}/{key}")
        for i, s in enumerate(node.get("prefixItems", [])):
            walk(s, f"{path}/prefixItems/{i}")

    walk(schema, "#")
    return out


def targets(spark: SparkSession, schema, dimensions=DIMENSIONS) -> DataFrame:
    return spark.createDataFrame([{k: v for k, v in t.items() if k != "params"} for t in analyze(schema, dimensions)], TARGET)


def hit_columns(df: DataFrame, schema) -> list[tuple[dict, Column]]:
    """For each target of a contract over typed columns: whether a row hits it."""
    compiler, kinds, out = Compiler(), {f.name: f.dataType for f in df.schema}, []
    for t in analyze(schema):
        path = t["canon_path"].split("/")
        if t["kind"] == "SCHEMA_NODE" and len(path) == 1:
            out.append((t, F.lit(True)))
            continue
        if len(path) < 3 or path[1] != "properties" or path[2] not in kinds:
            if t["kind"] == "CONDITIONAL_PATH" and len(path) == 1:
                row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
                held = compiler.ok(schema["if"], row, df.schema)
                out.append((t, held if t["params"]["pathKind"] == "IF_THEN" else ~held))
            elif len(path) >= 3 and path[1] in ("anyOf", "oneOf"):
                row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
                if len(path) == 3:
                    out.append((t, compiler.ok(schema[path[1]][int(path[2])], row, df.schema)))
            continue
        v, kind, node = F.col(f"`{path[2]}`"), kinds[path[2]], schema["properties"][path[2]]
        there = v.isNotNull()
        if t["kind"] in ("SCHEMA_NODE", "PROPERTY_PRESENT") and len(path) == 3:
            out.append((t, there))
        elif t["kind"].endswith("_BRANCH") and len(path) == 5:
            out.append((t, there & compiler.ok(node[path[3]][int(path[4])], v, kind)))
        elif t["kind"] == "ENUM_VALUE_HIT" and len(path) == 3:
            out.append((t, there & compiler.ok({"const": t["params"]["enumValue"]}, v, kind)))
        elif t["dimension"] == "boundaries" and len(path) == 3:
            key, bound = t["params"]["boundaryKind"], t["params"]["boundaryValue"]
            size = F.char_length(v) if "Length" in key else F.size(v) if "Items" in key else v
            test = size > bound if key == "exclusiveMinimum" else size < bound if key == "exclusiveMaximum" else size == bound
            out.append((t, there & test))
    return out


def hits(df: DataFrame, schema, valid: Column | None = None) -> DataFrame:
    """id and n, the rows that hit each target: one aggregation over the rows, valid ones only if a predicate is given."""
    found = hit_columns(df, schema)
    if valid is not None:
        df = df.where(valid)
    totals = df.agg(*[F.count_if(c).alias(f"n{k}") for k, (_, c) in enumerate(found)])
    return totals.select(F.inline(F.array(*[F.struct(F.lit(t["id"]).alias("id"), F.col(f"n{k}").alias("n")) for k, (t, _) in enumerate(found)]))).where("n > 0")


def covered(all_targets: DataFrame, found: DataFrame) -> DataFrame:
    """Targets with `hit`. Hits are one row a target at most, so the join is small on either side."""
    return all_targets.join(found.select("id", F.lit(True).alias("_hit")).distinct(), "id", "left").withColumn("hit", F.col("_hit").isNotNull()).drop("_hit")


def ratio(hit: Column, total: Column) -> Column:
    """1 where there is nothing to hit."""
    return F.when(total <= 0, F.lit(1.0)).otherwise(hit.cast("double") / total)


def counted(t: DataFrame, dimensions=DIMENSIONS, exclude_unreachable: bool = True) -> DataFrame:
    """What a denominator includes: enabled dimensions, no diagnostic kinds, active (or unreachable) targets."""
    status = ["active"] if exclude_unreachable else ["active", "unreachable"]
    return t.where(F.col("dimension").isin(*dimensions) & ~F.col("kind").isin(*DIAGNOSTIC_KINDS) & F.col("status").isin(*status))


def by_dimension(t: DataFrame, **options) -> DataFrame:
    g = counted(t, **options).groupBy("dimension").agg(F.count("*").alias("total"), F.count_if("hit").alias("hit"))
    return g.select("dimension", "total", "hit", ratio(F.col("hit"), F.col("total")).alias("ratio"))


def overall(t: DataFrame, threshold: float = 0.8, **options) -> DataFrame:
    g = counted(t, **options).agg(F.count("*").alias("total"), F.count_if("hit").alias("hit"))
    r = ratio(F.col("hit"), F.col("total"))
    return g.select("total", "hit", r.alias("ratio"), F.when(r >= threshold, "ok").otherwise("minCoverageNotMet").alias("status"))


def by_operation(t: DataFrame, **options) -> DataFrame:
    """Targets with `op_keys`, or an op_key of their own, by operation."""
    keys = F.coalesce(F.when(F.col("op_key").isNotNull(), F.array("op_key")), F.col("op_keys"))
    g = counted(t, **options).withColumn("operation", F.explode(keys)).groupBy("operation").agg(F.count("*").alias("total"), F.count_if("hit").alias("hit"))
    return g.select("operation", "total", "hit", ratio(F.col("hit"), F.col("total")).alias("ratio"))


def uncovered(t: DataFrame, most: int = 200) -> DataFrame:
    """The report's top-k: by dimension, weight, kind, path, operation, id."""
    return t.where(~F.col("hit") & (F.col("status") == "active")).orderBy("dimension", F.desc("weight"), "kind", "canon_path", F.asc_nulls_first("op_key"), "id").limit(most)


def mark_unreachable(t: DataFrame, unsat_paths: DataFrame) -> DataFrame:
    """Targets at or under a path that can't be satisfied. unsat_paths(path): as many as the contract proves."""
    p = unsat_paths.select("path").distinct()
    under = (F.col("canon_path") == F.col("path")) | F.col("canon_path").startswith(F.concat("path", F.lit("/")))
    hit = t.join(p, under, "left_semi").select("id").distinct().withColumn("_u", F.lit(True))
    return t.join(hit, "id", "left").withColumn("status", F.when(F.col("_u"), "unreachable").otherwise(F.col("status"))).drop("_u")


def rank_of(dimension: Column) -> Column:
    order = [*PRIORITY, *[d for d in DIMENSIONS if d not in PRIORITY]]
    out = F.lit(len(order))
    for k, d in enumerate(order):
        out = F.when(dimension == d, k).otherwise(out)
    return out


def planned_order(t: DataFrame) -> DataFrame:
    """Active targets with `position`: with an operation first, then dimension, weight, path, id. As small as the contract."""
    w = Window.orderBy(F.col("op_key").isNull(), rank_of(F.col("dimension")), F.desc("weight"), "canon_path", "id")
    return t.where("status = 'active'").withColumn("position", F.row_number().over(w).cast("long"))


def caps(t: list[dict], per_dimension: dict[str, int] | None = None, per_path: int | None = None, per_operation: int | None = None) -> list[dict]:
    """Targets that fit under all of their scopes' caps, in input order: the three counters move together."""
    seen: dict[tuple, int] = {}
    out = []
    for x in t:
        scopes = [(("d", x["dimension"]), (per_dimension or {}).get(x["dimension"])), (("p", x["canon_path"]), per_path), (("o", x["op_key"]), per_operation if x["op_key"] else None)]
        if all(most is None or seen.get(k, 0) < most for k, most in scopes):
            for k, _ in scopes:
                seen[k] = seen.get(k, 0) + 1
            out.append(x)
    return out


def dimension_cap(t: DataFrame, most: int) -> DataFrame:
    """The first `most` targets of each dimension: what `caps` does where one scope binds."""
    w = Window.partitionBy("dimension").orderBy("position")
    return planned_order(t).withColumn("n", F.row_number().over(w)).where(F.col("n") <= most).drop("n")


def plan_units(t: DataFrame, instances: int, seed: int) -> DataFrame:
    """One unit a target until the instances are used up: unit, id, hint; each with a seed of its own."""
    hint = (
        F.when(F.col("kind") == "PROPERTY_PRESENT", "ensurePropertyPresence")
        .when(F.col("kind").endswith("_BRANCH"), "preferBranch")
        .when(F.col("kind") == "ENUM_VALUE_HIT", "coverEnumValue")
    )
    picked = planned_order(t).where(F.col("position") <= instances)
    scope = F.concat(F.lit("tu-"), (F.col("position") - 1).cast("string"), F.lit("|"), F.col("canon_path"))
    from ..functions.hashing import fnv1a32_col, normalize_seed, xorshift_col

    start = F.lit(normalize_seed(seed)).cast("long").bitwiseXOR(fnv1a32_col(scope))
    return picked.select((F.col("position") - 1).alias("unit"), "id", "dimension", "kind", "canon_path", hint.alias("hint"), xorshift_col(F.when(start == 0, 1).otherwise(start)).alias("seed"))


def unit_seed(seed: int, unit: int, path: str) -> int:
    return XorShift32(seed, f"tu-{unit}|{path}").next()


def resolve_hints(hints: DataFrame) -> DataFrame:
    """Of hints (kind, canon_path, param, position) for one thing the first wins."""
    w = Window.partitionBy("kind", "canon_path", "param").orderBy("position")
    return hints.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def first_by_id(t: DataFrame, order: str = "position") -> DataFrame:
    w = Window.partitionBy("id").orderBy(order)
    return t.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Full outer comparison by id of targets (id, kind, canon_path, status, hit): change is unchanged, statusChanged, added, removed, or both of the last for a reshaped id."""
    x = a.select("id", *[F.col(c).alias(f"{c}_a") for c in ("kind", "canon_path", "status", "hit")])
    y = b.select("id", *[F.col(c).alias(f"{c}_b") for c in ("kind", "canon_path", "status", "hit")])
    j = x.join(y, "id", "full")
    same = (F.col("kind_a") == F.col("kind_b")) & (F.col("canon_path_a") == F.col("canon_path_b"))
    changes = (
        F.when(F.col("kind_a").isNull(), F.array(F.lit("added")))
        .when(F.col("kind_b").isNull(), F.array(F.lit("removed")))
        .when(~same, F.array(F.lit("removed"), F.lit("added")))
        .when((F.col("status_a") != F.col("status_b")) | (F.col("hit_a") != F.col("hit_b")), F.array(F.lit("statusChanged")))
        .otherwise(F.array(F.lit("unchanged")))
    )
    return j.select("id", F.explode(changes).alias("change"), F.coalesce("hit_a", F.lit(False)).alias("hit_a"), F.coalesce("hit_b", F.lit(False)).alias("hit_b"))


def newly_uncovered(a: DataFrame, b: DataFrame) -> DataFrame:
    """Targets, whatever their status, that the second run doesn't hit and the first hit, or didn't have, or had in another shape."""
    before = a.where(~F.col("hit")).select("id", F.col("kind").alias("_kind"), F.col("canon_path").alias("_path"))
    same = (b["id"] == before["id"]) & b["kind"].eqNullSafe(before["_kind"]) & b["canon_path"].eqNullSafe(before["_path"])
    return b.where(~F.col("hit")).join(before, same, "left_anti")


def operation_deltas(a: DataFrame, b: DataFrame) -> DataFrame:
    """Ratios by operation in both runs; an operation of one run only has no delta."""
    x, y = by_operation(a).select("operation", F.col("ratio").alias("ratio_a")), by_operation(b).select("operation", F.col("ratio").alias("ratio_b"))
    return x.join(y, "operation", "full").withColumn("delta", F.col("ratio_b") - F.col("ratio_a"))


def reachability(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Of edges (src, dst) and roots (operation, node): every (operation, node) reached, step by step until nothing is new."""
    edges = edges.select("src", F.col("dst").alias("_dst"))
    edges = cut(edges.distinct())
    reach = fresh = cut(roots.select("operation", "node").distinct())
    while True:
        seen = reach.select(F.col("operation").alias("_operation"), F.col("node").alias("_node"))
        step = fresh.join(edges, F.col("node") == F.col("src")).select("operation", F.col("_dst").alias("node")).distinct()
        fresh = cut(step.join(seen, F.col("operation").eqNullSafe(F.col("_operation")) & F.col("node").eqNullSafe(F.col("_node")), "left_anti"))
        if fresh.isEmpty():
            return reach
        reach = cut(reach.unionAll(fresh))


def reused(reach: DataFrame) -> DataFrame:
    """Nodes that more than one operation reaches."""
    return reach.groupBy("node").agg(F.count_distinct("operation").alias("operations")).where("operations > 1")


def attach_operations(t: DataFrame, reach: DataFrame) -> DataFrame:
    """Targets with `op_keys`, the sorted operations that reach their place; null where none does. reach: operation, node."""
    by_place = reach.groupBy(F.col("node").alias("canon_path")).agg(F.sort_array(F.collect_set("operation")).alias("op_keys"))
    return t.join(by_place, "canon_path", "left")


def reused_targets(reach: DataFrame) -> DataFrame:
    """A deprecated diagnostic target for each place that more than one operation reaches, with its operations."""
    shared = reach.groupBy(F.col("node").alias("canon_path")).agg(F.sort_array(F.collect_set("operation")).alias("op_keys")).where(F.size("op_keys") > 1)
    body = F.concat(F.lit('{"canonPath":'), F.to_json(F.struct(F.col("canon_path").alias("p"))).substr(F.lit(6), F.length(F.to_json(F.struct(F.col("canon_path").alias("p")))) - 6), F.lit(f',"dimension":"operations","engineMajor":{ENGINE_MAJOR},"kind":"SCHEMA_REUSED_COVERED","operationKey":null,"params":null,"reportMajor":{REPORT_MAJOR},"v":1}}'))
    identity = F.concat(F.lit(f"cov:{ENGINE_MAJOR}:{REPORT_MAJOR}:"), F.sha2(body, 256))
    return shared.select(identity.alias("id"), F.lit("operations").alias("dimension"), F.lit("SCHEMA_REUSED_COVERED").alias("kind"), "canon_path", F.lit("deprecated").alias("status"), "op_keys")


def target_key(prefix: str = "") -> Column:
    """What makes two reports' targets the same in shape."""
    c = lambda name: F.col(prefix + name)
    return F.concat_ws("|", c("id"), c("dimension"), c("kind"), c("canon_path"), F.coalesce(c("op_key"), F.lit("")))


def common_dimensions(a: Column, b: Column) -> Column:
    """The dimensions of both lists, in the first one's order."""
    return F.array_intersect(a, b)


def summary_line(t: DataFrame, caps: int = 0, unsatisfied: int = 0, **options) -> DataFrame:
    """One row, `line`: ratios by dimension and operation, the overall one, targets by status, caps and hints."""
    three = lambda c: F.format_string("%.3f", c)
    d = by_dimension(t, **options).agg(F.concat_ws(", ", F.transform(F.array_sort(F.collect_list(F.struct("dimension", "ratio"))), lambda x: F.concat(x["dimension"], F.lit("="), three(x["ratio"])))).alias("d"))
    o = overall(t, **options).select(three(F.col("ratio")).alias("o"))
    s = t.groupBy("status").agg(F.count("*").alias("n")).agg(F.concat_ws(", ", F.transform(F.array_sort(F.collect_list(F.struct("status", "n"))), lambda x: F.concat(x["status"], F.lit("="), x["n"].cast("string")))).alias("s"))
    parts = [d.select(F.lit(1).alias("k"), "d"), o.select(F.lit(1).alias("k"), "o"), s.select(F.lit(1).alias("k"), "s")]  # a row each
    whole = parts[0].join(parts[1], "k").join(parts[2], "k")
    if "op_keys" in t.columns:
        ops = by_operation(t, **options).agg(F.concat_ws(", ", F.transform(F.array_sort(F.collect_list(F.struct("ratio", "operation"))), lambda x: F.concat(x["operation"], F.lit("="), three(x["ratio"])))).alias("p"))
        whole = whole.join(ops.select(F.lit(1).alias("k"), "p"), "k")
    else:
        whole = whole.withColumn("p", F.lit(""))
    line = [F.when(F.col("d") != "", F.concat(F.lit("coverage by dimension: "), "d")), F.when(F.col("p") != "", F.concat(F.lit("coverage by operation: "), "p")), F.concat(F.lit("coverage overall: "), "o"), F.when(F.col("s") != "", F.concat(F.lit("targets by status: "), "s")), F.lit(f"planner caps: {caps}, unsatisfied hints: {unsatisfied}")]
    return whole.select(F.concat_ws(" | ", *line).alias("line"))


def diff_summary(overall_: tuple[float, float], operations: list[tuple[str, float | None, float | None]], lost: list[dict], status: list[tuple[dict, str, str]]) -> str:
    """A diff of two reports as text: ratios, operations (of one run only: a ratio is None), newly uncovered targets, changes of status."""
    line = lambda name, a, b: f"{name}: from={a:.3f} to={b:.3f} delta={b - a:.3f}"
    what = lambda t: f"[{t['dimension']}]{' ' + t['op_key'] if t.get('op_key') else ''} {t['kind']} at {t['canon_path']} (id={t['id']})"
    both = [o for o in operations if o[1] is not None and o[2] is not None]
    only = [("only-in-baseline", [o[0] for o in operations if o[2] is None]), ("only-in-comparison", [o[0] for o in operations if o[1] is None])]
    parts = {
        "per-operation": [line(*o) for o in both],
        "regressions": [line(*o) for o in both if o[2] < o[1]],
        "improvements": [line(*o) for o in both if o[2] > o[1]],
        "operations-changed": [f"{k}: {', '.join(v)}" for k, v in only if v],
        "newly-uncovered-targets": [what(t) for t in lost],
        "status-changes": [f"{what(t)}: {a} -> {b}" for t, a, b in status],
    }
    out = ["coverage diff:", f"  {line('overall', *overall_)}"]
    for title, rows in parts.items():
        out += [f"  {title}:", *(f"    {r}" for r in rows)] if rows else []
    return "\n".join(out)
