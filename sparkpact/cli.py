"""Command line: generate, openapi, contracts, coverage diff.

    python -m sparkpact.cli generate schema.json --count 5 --seed 1 --out json
    python -m sparkpact.cli contracts schema.json --count 50 --min-coverage 0.8 --report report/
    python -m sparkpact.cli openapi api.json --operation listUsers --status 200
    python -m sparkpact.cli coverage diff a/ b/
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import engine
from .functions.lineage import cut
from .operators import coverage as cov
from .sources import files

DEFAULT_SEED = 424242


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sparkpact")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("generate", "openapi", "contracts"):
        c = sub.add_parser(name)
        c.add_argument("schema")
        c.add_argument("-n", "--count", "--rows", type=int, default=1)
        c.add_argument("--seed", type=int, default=DEFAULT_SEED)
        c.add_argument("--out", choices=("json", "ndjson"), default="ndjson" if name == "contracts" else "json")
        c.add_argument("--rewrite-conditionals", choices=("never", "safe"), default="never")
        c.add_argument("--coverage", choices=("off", "measure", "guided"), default="measure" if name == "contracts" else "off")
        c.add_argument("--profile", choices=tuple(engine.PROFILES))
        c.add_argument("--min-coverage", type=float)
        c.add_argument("--report")
        if name == "openapi":
            c.add_argument("--operation", required=True)
            c.add_argument("--status")
            c.add_argument("--content-type")
            c.add_argument("--prefer-examples", action="store_true")
    d = sub.add_parser("coverage").add_subparsers(dest="action", required=True).add_parser("diff")
    d.add_argument("a")
    d.add_argument("b")
    return p


def show(rows: DataFrame, form: str, out) -> None:
    """Prints the documents in order; the driver holds one partition at a time."""
    first = True
    if form == "json":
        print("[", end="", file=out)
    for r in rows.select("instance_id", "doc").orderBy("instance_id").toLocalIterator():
        print(("" if first else ", ") + json.dumps(json.loads(r.doc)) if form == "json" else json.dumps(json.loads(r.doc)), end="" if form == "json" else "\n", file=out)
        first = False
    if form == "json":
        print("]", file=out)


def measure(spark: SparkSession, contract, rows: DataFrame, options: engine.Options) -> dict:
    """A coverage report of instances (doc): by the typed hits of their JSON, read with the contract's own shape."""
    from .plans.normalize import normalize

    # the first instance has the generated shape, which format strings alone vary
    some = rows.head(1)
    head = json.loads(some[0].doc) if some else None
    shape = spark.range(1).select(F.schema_of_json(F.lit(json.dumps(head)))).first()[0] if isinstance(head, dict) and head else None
    t = engine.contract_targets(spark, contract, options)
    if shape:
        typed = rows.select(F.from_json("doc", shape).alias("d")).select("d.*")
        t = cov.covered(t, cov.hits(typed, normalize(contract).schema))
    else:
        t = cov.covered(t, spark.createDataFrame([], "id string"))
    whole = cov.overall(t, options.threshold, dimensions=options.dimensions).first()
    return {"engineMajor": cov.ENGINE_MAJOR, "operationsScope": "all", "overall": whole.ratio, "status": whole.status, "byDimension": {r.dimension: r.ratio for r in cov.by_dimension(t, dimensions=options.dimensions).collect()}, "targets": [r.asDict() for r in t.select("id", "kind", "canon_path", "status", "hit", "dimension").orderBy("id").collect()]}


def main(argv: list[str] | None = None, spark: SparkSession | None = None, out=sys.stdout) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("sparkpact").getOrCreate()
    if args.command == "coverage":
        a, b = files.read_report(spark, args.a), files.read_report(spark, args.b)
        files.compatible(a, b)
        schema = "id string, kind string, canon_path string, status string, hit boolean, dimension string"
        x, y = (spark.createDataFrame(r["targets"], schema) for r in (a, b))
        changes = {r.change: r["count"] for r in cov.diff(x, y).groupBy("change").count().collect()}
        lost = cov.newly_uncovered(x, y).count()
        delta = b["overall"] - a["overall"]
        print(json.dumps({"delta": delta, "changes": changes, "newlyUncovered": lost}), file=out)
        return engine.EXIT_CODES["invalid"] if delta < 0 or lost else 0
    contract = json.loads(spark.read.option("wholetext", True).text(args.schema).first()[0])
    if args.command == "openapi":
        found = files.select_response(contract, args.operation, args.status, args.content_type)
        contract = {**found["schema"], **({"components": contract["components"]} if "components" in contract else {})}
        if args.prefer_examples and found["example"] is not None:
            print(json.dumps(found["example"]), file=out)
            return 0
    count = engine.PROFILES[args.profile] if args.profile else args.count
    options = engine.Options(instances=max(1, count), seed=args.seed, conditionals=args.rewrite_conditionals, threshold=args.min_coverage if args.min_coverage is not None else 0.0)
    stages = {"generate": lambda: engine.generate_guided(spark, contract, options)} if args.coverage == "guided" and engine.guided_units(contract, options) else None
    result = engine.run(spark, contract, options, stages)
    rows = cut(result.validated.select("instance_id", "valid").join(result.repaired.select("instance_id", "doc"), "instance_id"))  # one run serves all that follows
    show(rows, args.out, out)
    code = engine.EXIT_CODES["invalid"] if rows.where("not valid").head(1) else 0
    if args.coverage != "off":
        report = measure(spark, contract, rows.select("doc"), options)
        if args.report:
            files.write_report(spark, report, args.report)
        print(json.dumps({k: report[k] for k in ("overall", "status", "byDimension")}), file=sys.stderr)
        code = code or engine.EXIT_CODES[report["status"]]
    return code


if __name__ == "__main__":
    sys.exit(main())
