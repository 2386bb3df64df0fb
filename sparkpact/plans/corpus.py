"""Planning of many contracts at once: each row's contract is normalised and composed where it lies."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.hashing import canonical_json
from .compose import compose
from .normalize import normalize


def plan_contracts(contracts: DataFrame) -> DataFrame:
    """contract_id, code, phase, path, details of every note and diagnostic. A malformed text has one, CONTRACT_PARSE."""

    def run(batches):
        for b in batches:
            rows = []
            for name, text in zip(b.column("contract_id").to_pylist(), b.column("text").to_pylist()):
                try:
                    normal = normalize(json.loads(text))
                    found = [*normal.notes, *compose(normal.schema).diagnostics]
                except (ValueError, TypeError):
                    found = [{"code": "CONTRACT_PARSE", "phase": "normalize", "canonPath": "#", "details": {}}]
                rows += [(name, d["code"], d["phase"], d["canonPath"], canonical_json(d["details"])) for d in found]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(5)], ["contract_id", "code", "phase", "path", "details"])

    return contracts.select("contract_id", "text").mapInArrow(run, "contract_id string, code string, phase string, path string, details string")


def canonical_contracts(contracts: DataFrame) -> DataFrame:
    """contract_id and the canonical form's text."""

    def run(batches):
        for b in batches:
            texts = [canonical_json(normalize(json.loads(t)).schema) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("contract_id"), pa.array(texts, pa.string())], ["contract_id", "canonical"])

    return contracts.select("contract_id", "text").mapInArrow(run, "contract_id string, canonical string")


HARNESS = "contract_id string, instances long, valid long, repaired long, invalid long, actions long, unsat boolean, failed string, codes array<string>"


def run_corpus(contracts: DataFrame, instances: int = 10, seed: int | None = None, attempts: int = 5) -> DataFrame:
    """Each contract generated, repaired and validated where it lies: one row of HARNESS.

    An instance counts as valid, repaired or invalid. What a contract raises ends up in `failed`, and the others go on;
    codes are the distinct diagnostics of planning. A malformed or null text has failed with CONTRACT_PARSE.
    """

    def run(batches):
        from ..operators.documents import repair_document
        from ..operators.generate import instances_of
        from .validator import Validator

        for b in batches:
            rows = []
            for name, text in zip(b.column("contract_id").to_pylist(), b.column("text").to_pylist()):
                try:
                    contract = json.loads(text)
                except (ValueError, TypeError, RecursionError):
                    rows.append((name, 0, 0, 0, 0, 0, False, "CONTRACT_PARSE", []))
                    continue
                valid = mended = bad = actions = 0
                codes, unsat, failed = [], False, None
                try:
                    normal = normalize(contract)
                    found = [*normal.notes, *compose(normal.schema, seed).diagnostics]
                    codes = sorted({d["code"] for d in found})
                    unsat = any(d["code"].startswith("UNSAT_") and d["canonPath"] == "#" for d in found)
                    validator = Validator(contract)
                    for document in instances_of(contract, instances, seed) if not unsat else ():
                        if validator.is_valid(document):
                            valid += 1
                            continue
                        done, taken = repair_document(validator, document, attempts)
                        actions += len(taken)
                        mended, bad = (mended + 1, bad) if validator.is_valid(done) else (mended, bad + 1)
                except (ValueError, KeyError, TypeError, RecursionError) as e:
                    failed = type(e).__name__
                rows.append((name, valid + mended + bad, valid, mended, bad, actions, unsat, failed, codes))
            kinds = [pa.string(), *[pa.int64()] * 5, pa.bool_(), pa.string(), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], [x.split()[0] for x in HARNESS.split(", ")])

    return contracts.select("contract_id", "text").mapInArrow(run, HARNESS)
