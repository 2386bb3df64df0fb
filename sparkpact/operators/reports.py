"""Diagnostics, corpus, bench and report aggregates over runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed branch score weights by feature.
BRANCH_WEIGHTS = {"tags": 1000, "const_keys": 200, "unique_type": 10, "pattern_disjoint": 50, "unsafe": -5, "unique_required": 120, "const_props": 80, "min_properties": 15, "min_items": 10, "min_contains": 10, "min_length": 5}
BRANCH_CAPS = {"unique_required": 4, "const_props": 5}


def branch_score(features: dict[str, Column]) -> Column:
    out = F.lit(0)
    for k, v in features.items():
        capped = F.least(v, F.lit(BRANCH_CAPS[k])) if k in BRANCH_CAPS else v
        out = out + capped * BRANCH_WEIGHTS[k]
    return out.cast("int")


def choose_branch(scored: DataFrame, group: str) -> DataFrame:
    """The best branch of each group: score descending, then index. A max over structs, which sums up before the shuffle."""
    best = F.max(F.struct("score", (-F.col("branch")).alias("at")))
    return scored.groupBy(group).agg(best.alias("b")).select(group, (-F.col("b.at")).alias("branch"), F.col("b.score").alias("score"))


def dedupe(diagnostics: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first diagnostic of each key."""
    return diagnostics.groupBy(*keys).agg(F.min(order).alias(order))


def is_unsat_or_fail_fast(code: Column) -> Column:
    return code.startswith("UNSAT_") | code.isin("EXTERNAL_REF_UNRESOLVED", "REGEX_COMPLEXITY_CAPPED")


def by_phase(diagnostics: DataFrame, phases: dict[str, str], otherwise: str) -> DataFrame:
    phase = F.lit(otherwise)
    for code, p in phases.items():
        phase = F.when(F.col("code") == code, p).otherwise(phase)
    return diagnostics.groupBy(phase.alias("phase"), "code").agg(F.count("*").alias("n"))


def corpus_summary(runs: DataFrame) -> DataFrame:
    return runs.agg(F.count("*").alias("schemas"), F.count_if("failed").alias("failed"), F.sum("instances").alias("instances"), F.sum("invalid").alias("invalid"))


def _reliability(invalid: Column, n: Column) -> Column:
    return F.when(2 * invalid > n, 2).when(invalid > 0, 1).otherwise(0)


def failure_categories(runs: DataFrame) -> DataFrame:
    r = _reliability(F.col("invalid"), F.col("instances"))
    category = F.when(F.col("failed"), "failed").when(r == 2, "blocked").when(r == 1, "limited").otherwise("ok")
    return runs.groupBy(category.alias("category")).agg(F.count("*").alias("n"))


def percentiles(timings: DataFrame, ranks: tuple[tuple[str, float], ...] = (("p50", 0.5), ("p95", 0.95))) -> DataFrame:
    """Nearest-rank p50 and p95 and the maximum by profile.

    Equal values are counted first; then a few thousand ranges of values a profile are summed to find which one holds a
    rank, and only that range's values are put in order. No task holds a profile's values. Nulls are left out.
    """
    times = timings.where("ms is not null").groupBy("profile", "ms").agg(F.count("*").alias("n"))
    # ranges that grow with the value: sixteen to each doubling, on either side of zero
    size = F.log2(F.abs(F.col("ms").cast("double")) + 1) * 16
    times = times.withColumn("part", (F.signum(F.col("ms").cast("double")) * F.ceil(size)).cast("long"))
    parts = times.groupBy("profile", "part").agg(F.sum("n").alias("n"), F.max("ms").alias("top"))
    w = Window.partitionBy("profile").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy("profile")
    ends = parts.select("profile", "part", (F.sum("n").over(w) - F.col("n")).alias("before"), F.sum("n").over(w).alias("upto"), F.sum("n").over(whole).alias("total"), F.max("top").over(whole).alias("top"))
    rank = lambda q: F.greatest(F.ceil(F.col("total") * q), F.lit(1))
    wanted = ends.withColumn("q", F.explode(F.array(*[F.struct(F.lit(k).alias("name"), rank(q).alias("rank")) for k, q in ranks])))
    wanted = wanted.where((F.col("q.rank") > F.col("before")) & (F.col("q.rank") <= F.col("upto"))).select("profile", "part", "before", "top", "q.name", "q.rank")
    order = Window.partitionBy("profile", "name").orderBy("ms").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = times.join(wanted, ["profile", "part"]).withColumn("at", F.col("before") + F.sum("n").over(order)).where(F.col("at") >= F.col("rank"))
    return found.groupBy("profile").agg(*[F.min(F.when(F.col("name") == k, F.col("ms"))).alias(k) for k, _ in ranks], F.max("top").alias("top"))


def gate(summary: DataFrame, most: float) -> DataFrame:
    return summary.agg(F.max("p95").alias("worst_p95"), (F.max("p95") <= most).alias("passed"))


def levels(summary: DataFrame, p50: float, p95: float) -> DataFrame:
    return summary.select("profile", F.when(F.col("p95") > p95, "blocked").when(F.col("p50") > p50, "limited").otherwise("ok").alias("level"))


def summary_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    j = a.withColumnRenamed("value", "before").join(b.withColumnRenamed("value", "after"), "profile", "full")
    return j.withColumn("delta", F.col("after") - F.col("before"))


def outcomes(repaired: DataFrame) -> DataFrame:
    return repaired.groupBy(outcome().alias("outcome")).agg(F.count("*").alias("n"))


def operator_levels(runs: DataFrame, slow: float, too_slow: float) -> DataFrame:
    """0 fine, 1 limited, 2 blocked; overall is the worst."""
    r, p = _reliability(F.col("invalid"), F.col("instances")), F.when(F.col("ms") > too_slow, 2).when(F.col("ms") > slow, 1).otherwise(0)
    return runs.select("schema_id", r.alias("reliability"), p.alias("performance"), F.greatest(r, p).alias("overall"))


def top_codes(diagnostics: DataFrame, most: int = 5) -> DataFrame:
    w = Window.partitionBy("schema_id").orderBy(F.desc("n"), "code")
    return diagnostics.groupBy("schema_id", "code").agg(F.count("*").alias("n")).withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= most).drop("_k")


def caps(diagnostics: DataFrame, group: str) -> DataFrame:
    """How often each of the three limits was hit, by group."""
    of = {"regex_capped": "REGEX_COMPLEXITY_CAPPED", "name_automaton_capped": "NAME_AUTOMATON_COMPLEXITY_CAPPED", "smt_timeouts": "SOLVER_TIMEOUT"}
    return diagnostics.groupBy(group).agg(*[F.count_if(F.col("code") == code).alias(name) for name, code in of.items()])


#: Diagnostic counts of a run's summary.
COUNTED = ("compose_fatal", "compose_warn", "compose_run_level", "validate_errors")


def totals(summaries: DataFrame) -> DataFrame:
    """A bench's totals over its runs' summaries (instances, invalid and COUNTED)."""
    return summaries.agg(F.count("*").alias("schemas"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("instances", *COUNTED, "invalid")])


def actions_by_instance(actions: DataFrame) -> DataFrame:
    """Audit rows (instance_id, action, keyword, instance_path) as one ordered list an instance."""
    return actions.groupBy("instance_id").agg(F.sort_array(F.collect_list(F.struct("instance_path", "keyword", "action"))).alias("actions"))


def outcome() -> Column:
    return F.when(F.col("score_before") == 0, "valid").when(F.col("score_after") == 0, "repaired").otherwise("invalid")


def build_report(repaired: DataFrame, key: str) -> DataFrame:
    """A report's instance rows from a repaired table: the key, outcome, number of actions, and the distinct keywords repaired, in order."""
    return repaired.select(key, outcome().alias("outcome"), F.size("actions").cast("long").alias("n_actions"), F.array_sort(F.array_distinct(F.transform("actions", lambda a: a["keyword"]))).alias("keywords"))


def report_summary(instances: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """One row: instances by outcome, actions, and diagnostics by phase and severity (kind)."""
    kinds = [F.count_if(F.col("kind") == k).alias(k) for k in COUNTED]
    a = instances.agg(F.count("*").alias("instances"), *[F.count_if(F.col("outcome") == o).alias(o) for o in ("valid", "repaired", "invalid")], F.coalesce(F.sum("n_actions"), F.lit(0)).alias("actions"), F.lit(1).alias("_k"))
    return a.join(diagnostics.agg(*kinds, F.lit(1).alias("_k")), "_k").drop("_k")


def filtered(diagnostics: DataFrame, kinds: tuple[str, ...], query: str = "", path: str | None = None) -> DataFrame:
    """Diagnostics (kind, code, canon_path, details) of some kinds, at a path if one is given, that contain a text in any case."""
    out = diagnostics.where(F.col("kind").isin(*kinds))
    if path:
        out = out.where(F.col("canon_path").eqNullSafe(path))
    words = F.lower(F.concat_ws(" ", F.coalesce("code", F.lit("")), F.coalesce("canon_path", F.lit("")), F.coalesce("details", F.lit(""))))
    return out.where(F.contains(words, F.lit(query.strip().lower()))) if query.strip() else out


def worst_first() -> list[Column]:
    """The order of a bench's contracts: blocked, limited, ok, then by id."""
    return [F.array_position(F.array(F.lit("blocked"), F.lit("limited"), F.lit("ok")), F.col("level")), F.col("schema_id")]


def markdown(summary: dict, outcome: dict[str, int], coverage: dict[str, float] | None = None) -> str:
    """A report's summary as text."""
    lines = [f"# {summary.get('title', 'Report')}", ""]
    lines += [f"- {k}: {v}" for k, v in summary.items() if k != "title"]
    lines += ["", "| outcome | rows |", "|-|-|", *[f"| {k} | {v} |" for k, v in sorted(outcome.items())]]
    if coverage:
        lines += ["", "| dimension | ratio |", "|-|-|", *[f"| {k} | {v:.3f} |" for k, v in sorted(coverage.items())]]
    return "\n".join(lines) + "\n"


def html(summary: dict, outcome: dict[str, int], coverage: dict[str, float] | None = None) -> str:
    from html import escape

    def rows(d):
        return "".join(f"<tr><td>{escape(str(k))}</td><td>{escape(str(v))}</td></tr>" for k, v in sorted(d.items()))

    return f"<!doctype html><title>{escape(str(summary.get('title', 'Report')))}</title><table>{rows({k: v for k, v in summary.items() if k != 'title'})}</table><table>{rows(outcome)}</table><table>{rows(coverage or {})}</table>"
