"""Sources and sinks: contract corpora, registries, OpenAPI documents, item and report files."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import canonical_json, stable_hash, structural_hash
from ..plans.normalize import detect_dialect

REPORT_VERSION = "coverage-report/v1"


class Incompatible(ValueError):
    """A report or a pair of reports that can't be compared."""


def read_contracts(spark: SparkSession, folder: str) -> DataFrame:
    """contract_id (relative path), text of all *.json files below a folder, by one distributed scan."""
    raw = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.[jJ][sS][oO][nN]").text(folder)
    base = folder.split("://")[-1].rstrip("/") + "/"
    return raw.select(F.element_at(F.split(F.col("_metadata.file_path"), base), -1).alias("contract_id"), F.col("value").alias("text"))


def registry(spark: SparkSession, entries: list[tuple[str, object]]) -> DataFrame:
    """uri, text, content_hash, dialect; the first document of a uri wins."""
    seen: dict[str, object] = {}
    for uri, doc in entries:
        seen.setdefault(uri, doc)
    return spark.createDataFrame([(u, canonical_json(d), structural_hash(d), detect_dialect(d)) for u, d in seen.items()], "uri string, text string, content_hash string, dialect string")


def registry_fingerprint(reg: DataFrame) -> DataFrame:
    return reg.agg(F.sha2(F.array_join(F.sort_array(F.collect_list(F.concat_ws(" ", "uri", "content_hash"))), "\n"), 256).alias("fingerprint"))


def write_cache(reg: DataFrame, path: str) -> None:
    reg.write.mode("append").parquet(path)


def read_cache(spark: SparkSession, path: str, uris: list[str]) -> DataFrame:
    return spark.read.parquet(path).where(F.col("uri").isin(*uris)).dropDuplicates(["uri"])


def write_items(df: DataFrame, path: str, form: str = "ndjson", column: str = "doc") -> None:
    """One JSON text a line, or one array of all: its files, in order of their names, read as one text in order of instance_id."""
    if form == "ndjson":
        df.select(F.col(column).alias("value")).write.mode("overwrite").text(path)
    elif form == "json":
        ends = df.agg(F.min("instance_id").alias("low"), F.max("instance_id").alias("high")).first()
        if ends.low is None:
            df.sparkSession.createDataFrame([("[]",)], "value string").coalesce(1).write.mode("overwrite").text(path)
            return
        at = F.col("instance_id")
        line = F.concat(F.when(at == ends.low, "[").otherwise(","), F.col(column), F.when(at == ends.high, "]").otherwise(""))
        df.orderBy("instance_id").select(line.alias("value")).write.mode("overwrite").text(path)
    else:
        raise ValueError(f"{form}: json or ndjson")


def write_report(spark: SparkSession, report: dict, path: str) -> None:
    spark.createDataFrame([(json.dumps({"version": REPORT_VERSION, **report}),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_report(spark: SparkSession, path: str) -> dict:
    report = json.loads(spark.read.option("wholetext", True).text(path).first()[0])
    if report.get("version") != REPORT_VERSION:
        raise Incompatible(f"version {report.get('version')}")
    return report


def compatible(a: dict, b: dict) -> None:
    """Both reports have the same version, engine major and scope of operations."""
    for key in ("version", "engineMajor", "operationsScope"):
        if a.get(key) != b.get(key):
            raise Incompatible(f"{key}: {a.get(key)} and {b.get(key)}")


# --- OpenAPI ----------------------------------------------------------------------------------------------------

METHODS = ("get", "put", "post", "delete", "options", "head", "patch", "trace")


def operations(doc: dict) -> list[dict]:
    """operation key (operationId, else METHOD path), method, path of each operation, with its request and response schemas."""
    out = []
    for path, item in doc.get("paths", {}).items():
        for method in METHODS:
            op = item.get(method)
            if op is None:
                continue
            key = (op.get("operationId") or "").strip() or f"{method.upper()} {path}"
            base = f"#/paths/{path.replace('~', '~0').replace('/', '~1')}/{method}"
            request = [(t, m.get("schema"), f"{base}/requestBody/content/{t.replace('/', '~1')}/schema") for t, m in op.get("requestBody", {}).get("content", {}).items()]
            response = [(status, t, m.get("schema"), f"{base}/responses/{status}/content/{t.replace('/', '~1')}/schema") for status, r in op.get("responses", {}).items() for t, m in r.get("content", {}).items()]
            out.append({"key": key, "method": method, "path": path, "request": request, "response": response})
    return out


def operation_edges(doc: dict) -> tuple[list[tuple[str, str]], list[tuple[str, str]]]:
    """Edges (src, dst) between schema nodes, by structure and $ref, and roots (operation, node): input of reachability."""
    from ..plans.normalize import walk

    roots, edges = [], []
    places = [(o["key"], s, at) for o in operations(doc) for _, s, at in [(t, s, at) for t, s, at in o["request"]] + [(t, s, at) for _, t, s, at in o["response"]] if s is not None]
    for key, s, at in places:
        roots.append((key, at))
    named = [(s, f"#/components/schemas/{name}") for name, s in doc.get("components", {}).get("schemas", {}).items()]
    for s, base in [*[(s, at) for _, s, at in places], *named]:
        for at, node in walk(s, base):
            if at != base:
                edges.append((at.rsplit("/", 2)[0] if at.rsplit("/", 2)[0].startswith(base) else base, at))
            if isinstance(node, dict) and "$ref" in node:
                edges.append((at, node["$ref"]))
    return sorted(set(edges)), sorted(set(roots))


def select_response(doc: dict, operation: str, status: str | None = None, content_type: str | None = None, example: str | None = None) -> dict:
    """Schema, example and where they were found. Status: asked for, 200, 201, default, first; content: asked for, JSON, first."""
    for path, item in doc.get("paths", {}).items():
        for method, op in item.items():
            if method in METHODS and operation in (op.get("operationId"), f"{method.upper()} {path}"):
                responses = op.get("responses", {})
                chosen = next((k for k in (status, "200", "201", "default", *responses) if k in responses), None)
                if chosen is None:
                    raise KeyError(f"{operation}: no response")
                content = responses[chosen].get("content", {})
                kind = next((k for k in (content_type, "application/json", *content) if k in content), None)
                media = content.get(kind, {}) if kind else {}
                schema = media.get("schema", {})
                named = media.get("examples", {})
                found = [media.get("example"), named.get(example, {}).get("value") if example else None, named.get("default", {}).get("value"), next((e.get("value") for e in named.values()), None), schema.get("example"), next(iter(schema.get("examples", [])), None)]
                return {"schema": schema, "example": next((x for x in found if x is not None), None), "status": chosen, "content_type": kind, "operation": operation}
    raise KeyError(operation)


SNAPSHOT = "uri string, text string, content_hash string, dialect string, fingerprint string, fault string"


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """A row of SNAPSHOT for each line of a JSON-lines bundle: an entry, the declared fingerprint, or why the line is none.

    An entry has a uri and a body (or schema); a content hash that isn't given is the body's structural hash. Blank lines
    are skipped. Faults are parse-error, invalid-entry and hash-failed.
    """

    def row(line: str):
        none = (None,) * 6
        try:
            entry = json.loads(line)
        except (ValueError, RecursionError):
            return (*none[:5], "parse-error")
        if not isinstance(entry, dict):
            return (*none[:5], "invalid-entry")
        if isinstance(entry.get("fingerprint"), str) and not entry.get("uri"):
            return (*none[:4], entry["fingerprint"], None)
        body = entry["body"] if "body" in entry else entry.get("schema")
        if not isinstance(entry.get("uri"), str) or not entry["uri"] or body is None and "body" not in entry:
            return (*none[:5], "invalid-entry")
        given = {k: entry[k].strip() for k in ("contentHash", "dialect") if isinstance(entry.get(k), str) and entry[k].strip()}
        digest = given.get("contentHash") or stable_hash(body)
        if not digest:
            return (entry["uri"], *none[:4], "hash-failed")
        return (entry["uri"], canonical_json(body), digest, given.get("dialect"), None, None)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            rows = [row(line) for line in b.column("value").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(6)], [x.split()[0] for x in SNAPSHOT.split(", ")])

    lines = spark.read.text(path).select(F.trim(F.regexp_replace("value", "\r", "")).alias("value")).where("value <> ''")
    return lines.mapInArrow(run, SNAPSHOT)
