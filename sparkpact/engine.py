"""The engine's facade: normalize, compose, generate, validate, repair, coverage and the whole run."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from .operators import coverage as cov
from .operators.documents import repair_documents, validate_documents
from .operators.generate import generate, guided
from .plans.compose import Composed, compose
from .plans.normalize import Normalized, normalize

#: Fixed exit codes by failure.
EXIT_CODES = {"ok": 0, "invalid": 1, "minCoverageNotMet": 70}
#: Fixed coverage profiles: instances.
PROFILES = {"quick": 75, "balanced": 350, "thorough": 1000}


def with_profile(options: dict, profile: str | None) -> dict:
    """Command-line options under a validity profile: strict turns `gvalid` on, relaxed also structural repair; given flags win."""
    out = dict(options)
    if profile in ("strict", "relaxed"):
        if not isinstance(out.get("gvalid"), bool):
            out["gvalid"] = True
        if profile == "relaxed" and out.get("gvalid_relax_repair") is None:
            out["gvalid_relax_repair"] = True
    return out


@dataclass(frozen=True)
class Options:
    """The knobs of a run, with their defaults."""

    instances: int = 1
    seed: int = 424242
    attempts: int = 1
    conditionals: str = "never"
    formats: bool = True
    dimensions: tuple[str, ...] = ("structure", "branches", "enum")
    threshold: float = 0.8
    exclude_unreachable: bool = True

    def __post_init__(self):
        if self.conditionals not in ("never", "safe"):
            raise ValueError(f"conditionals: {self.conditionals}")
        if self.instances < 0 or not 0 <= self.threshold <= 1:
            raise ValueError("instances and threshold must not be negative, the threshold at most 1")


@dataclass
class Result:
    """Artifacts of a run; the DataFrames are lazy."""

    normalized: Normalized
    composed: Composed
    items: DataFrame
    repaired: DataFrame
    validated: DataFrame
    diagnostics: list[dict] = field(default_factory=list)

    @property
    def unsatisfiable(self) -> bool:
        return any(d["code"].startswith("UNSAT_") and d["canonPath"] == "#" for d in self.diagnostics)


def run(spark: SparkSession, contract, options: Options = Options(), stages: dict[str, Callable] | None = None) -> Result:
    """Normalize, compose, generate, repair, validate, in this order. stages: callables in place of generate, repair or validate."""
    own = stages or {}
    normal = normalize(contract, options.conditionals)
    composed = compose(normal.schema, options.seed)
    items = own.get("generate", lambda: generate(spark, contract, options.instances, options.seed))()
    repaired = own.get("repair", lambda d: repair_documents(d, contract, ["instance_id"], attempts=options.attempts))(items)
    validated = own.get("validate", lambda d: validate_documents(d, contract, ["instance_id"], formats=options.formats))(repaired)
    return Result(normal, composed, items, repaired, validated, [*normal.notes, *composed.diagnostics])


def contract_targets(spark: SparkSession, contract, options: Options = Options()) -> DataFrame:
    """The contract's targets, those under proven contradictions unreachable."""
    normal = normalize(contract, options.conditionals)
    composed = compose(normal.schema, options.seed)
    t = cov.targets(spark, normal.schema, options.dimensions)
    paths = composed.unsat_paths
    return cov.mark_unreachable(t, spark.createDataFrame([(p,) for p in paths], "path string")) if paths else t


def guided_units(contract, options: Options = Options()) -> list[dict[str, int]]:
    """Branch choices for one instance each, so that every branch is taken by one."""
    normal = normalize(contract, options.conditionals)
    out: list[dict[str, int]] = []
    for t in cov.analyze(normal.schema, ("branches",)):
        if t["kind"].endswith("_BRANCH"):
            place, index = t["canon_path"].rsplit("/", 1)
            out.append({place: int(index)})
    return out[: options.instances] if options.instances > 1 else out


def generate_guided(spark: SparkSession, contract, options: Options = Options()) -> DataFrame:
    return guided(spark, contract, guided_units(contract, options), options.seed)
