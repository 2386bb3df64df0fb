"""Checks of diagnostic rows: their envelope, and which codes a phase may raise."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed names of the phases.
PHASES = ("normalize", "compose", "generate", "repair", "validate")
#: Keys that details must not repeat, at any depth.
FORBIDDEN = ("canonPath", "canonPtr")
# Fixed contexts that the two codes on patterns must give, by phase.
CONTEXTS = {
    ("REGEX_COMPLEXITY_CAPPED", "compose"): ("coverage",),
    ("REGEX_COMPILE_ERROR", "compose"): ("coverage", "preflight"),
    ("REGEX_COMPLEXITY_CAPPED", "normalize"): ("rewrite",),
    ("REGEX_COMPILE_ERROR", "normalize"): ("rewrite",),
}


def faults(diagnostics: DataFrame, allowed: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """The rows (code, canon_path, phase, details as JSON text or null) that break a rule, with the first such as `fault`.

    allowed: the phases that a code may come from; codes that it doesn't name may come from any.
    """
    code, phase, details = F.col("code"), F.col("phase"), F.col("details")
    keys = F.regexp_extract_all(details, F.lit(r'"((?:[^"\\]|\\.)*)"\s*:'), F.lit(1))
    wrong_phase, context = F.lit(False), F.lit(False)
    for c, phases in (allowed or {}).items():
        wrong_phase = wrong_phase | ((code == c) & ~phase.isin(*phases))
    for (c, p), values in CONTEXTS.items():
        found = F.get_json_object(details, "$.context")
        context = context | ((code == c) & (phase == p) & details.isNotNull() & ~F.coalesce(found.isin(*values), F.lit(False)))
    fault = (
        F.when(code.isNull(), "code")
        .when(F.col("canon_path").isNull(), "canonPath")
        .when(phase.isNull() | ~phase.isin(*PHASES), "phase")
        .when(F.coalesce(F.arrays_overlap(keys, F.array(*[F.lit(k) for k in FORBIDDEN])), F.lit(False)), "forbidden key")
        .when(wrong_phase, "not of this phase")
        .when(context, "context")
    )
    return diagnostics.withColumn("fault", fault).where("fault is not null")


def require(diagnostics: DataFrame, allowed: dict[str, tuple[str, ...]] | None = None) -> None:
    """ValueError that shows the first few faults, if there are any."""
    if found := faults(diagnostics, allowed).limit(5).collect():
        raise ValueError("; ".join(f"{r.code} at {r.canon_path}: {r.fault}" for r in found))
