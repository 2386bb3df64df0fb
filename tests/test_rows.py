"""Typed rows against the generic validator and the Python generators, beyond the tables' values."""

import json

import pytest
from pyspark.sql import functions as F

from sparkpact.functions import hashing as H
from sparkpact.operators import coverage as C
from sparkpact.operators import predicates as P
from sparkpact.operators import repair as R
from sparkpact.operators.documents import repair_documents, validate_documents
from sparkpact.operators.generate import generate


@pytest.mark.parametrize(
    "contract",
    [
        {"additionalProperties": False},
        {"maxProperties": 1},
        {"propertyNames": {"maxLength": 0}},
        {"patternProperties": {"^a": {"minimum": 5}}, "additionalProperties": {"type": "integer"}},
        {"properties": {"m": {"additionalProperties": {"items": {"maximum": 1}}}}},
        {"properties": {"m": {"patternProperties": {"~": {"prefixItems": [{"const": 9}], "items": {"enum": [1]}}}}}},
    ],
)
def test_rows_and_texts_have_the_same_errors(spark, contract):
    df = spark.createDataFrame([(1, 2, {"x": [1, 2, 3], "a/~b": [0, 1]}), (7, None, {}), (None, None, None)], "a int, b int, m map<string,array<int>>")
    typed = sorted((sorted(map(tuple, r.errors)) for r in P.validate(df, contract).collect()), key=repr)
    docs = df.select(F.to_json(F.struct("*")).alias("doc"))
    texts = sorted((sorted(map(tuple, r.errors)) for r in validate_documents(docs, contract, ["doc"]).collect()), key=repr)
    assert typed == texts and any(typed)


def test_counts_below_items(spark):
    df = spark.createDataFrame([([1, 5, 9],), ([9],), ([],), (None,)], "v array<int>")
    rows = P.counts(df, {"properties": {"v": {"items": {"maximum": 4}}}}).collect()
    assert [(r.keyword, r.instance_path, r.n) for r in rows] == [("maximum", "/v/*", 3)]
    assert P.counts(df.where("false"), {"properties": {"v": {"minItems": 1}}}).collect()[0].n == 0


def test_reserved_columns_are_refused(spark):
    df = spark.createDataFrame([(1, 2)], "errors int, score_before int")
    with pytest.raises(ValueError):
        P.validate(df, {})
    with pytest.raises(ValueError):
        R.repair(df, {"properties": {"score_before": {"minimum": 3}}})


def test_formats_draw_from_the_seed(spark):
    rows = spark.range(3000)
    for kind in ("email", "uri", "uuid", "date-time"):
        a, b = (rows.select(H.format_col(kind, F.col("id"), seed).alias("v")) for seed in (1, 2))
        assert a.distinct().count() > 2980 and a.intersect(b).count() < 20
    got = rows.limit(50).select("id", H.format_col("uri", F.col("id"), 7).alias("v")).collect()
    for r in got:
        n, digits = H.XorShift32(7, f"format:uri:{r.id}").next(), ""
        while n:
            n, d = divmod(n, 36)
            digits = "0123456789abcdefghijklmnopqrstuvwxyz"[d] + digits
        assert r.v == f"https://example.test/resource/{digits.zfill(6)}"
    assert generate(spark, {"type": "string", "format": "uri"}, 100).select("doc").distinct().count() == 100


def test_repair_of_nested_and_crowded(spark):
    df = spark.createDataFrame([(1, (200, "x"), [1, 1, 1, 2]), (2, None, [2])], "id int, body struct<n:int,k:string>, bag array<int>")
    contract = {"properties": {"body": {"required": ["k"], "properties": {"n": {"maximum": 9}, "k": {"minLength": 3}}}, "bag": {"contains": {"const": 1}, "minContains": 0, "maxContains": 2}}}
    out = sorted(R.repair(df, contract).collect())
    assert [(r.body and tuple(r.body), r.bag, r.reverted) for r in out] == [((9, "xaa"), [1, 1, 2], False), (None, [2], False)]
    assert [a.instance_path for a in out[0].actions] == ["/body/n", "/body/k", "/bag"]


def test_deep_documents_do_not_end_the_job(spark):
    deep = "[" * 100_000 + "]" * 100_000
    nested = json.dumps({"a": None})
    for _ in range(150):
        nested = f'{{"a":{nested}}}'
    contract = {"properties": {"a": {"$ref": "#"}}}
    df = spark.createDataFrame([(1, deep), (2, nested), (3, "{}"), (4, None)], "k int, doc string")
    rows = {r.k: r for r in validate_documents(df, contract, ["k"]).collect()}
    assert rows[1].errors[0].keyword in ("parse", "depth") and rows[2].errors[0].keyword == "depth" and rows[3].valid and rows[4].errors[0].keyword == "parse"
    assert sorted((r.k, r.valid) for r in repair_documents(df, contract, ["k"]).collect()) == [(1, False), (2, False), (3, True), (4, False)]


def test_newly_uncovered_goes_by_shape(spark):
    kind = "id string, kind string, canon_path string, status string, hit boolean"
    a = spark.createDataFrame([("1", "K", "#", "active", True), ("2", "K", "#", "active", False), ("3", "K", "#", "active", False), ("4", "K", "#", "active", True)], kind)
    b = spark.createDataFrame([("1", "K", "#", "unreachable", False), ("2", "K", "#", "active", False), ("3", "L", "#", "active", False), ("4", "K", "#", "active", True), ("5", "K", "#", "active", False)], kind)
    assert sorted(r.id for r in C.newly_uncovered(a, b).collect()) == ["1", "3", "5"]


def test_format_values_match_their_columns(spark):
    rows = spark.range(40).select("id", *[H.format_col(k, F.col("id"), 99).alias(k) for k in ("email", "uri", "uuid", "date-time")]).collect()
    for r in rows:
        assert all(r[k] == H.format_value(k, r.id, 99) for k in ("email", "uri", "uuid", "date-time"))


def test_percentiles_by_nearest_rank(spark):
    import math
    import random

    from sparkpact.operators.reports import percentiles

    r = random.Random(3)
    data = {k: [f(r) for _ in range(n)] for k, n, f in (("a", 1000, lambda r: r.random()), ("b", 1, lambda r: -4.5), ("c", 777, lambda r: float(r.randrange(-3, 3))), ("d", 500, lambda r: r.choice((1e-9, 1e12, -1e12, 0.0))))}
    df = spark.createDataFrame([(k, v) for k, vs in data.items() for v in vs] + [("a", None)], "profile string, ms double")
    for row in percentiles(df).collect():
        vs = sorted(data[row.profile])
        assert (row.p50, row.p95, row.top) == (vs[math.ceil(0.5 * len(vs)) - 1], vs[math.ceil(0.95 * len(vs)) - 1], vs[-1])


def test_unreachable_targets_conflict(spark):
    from sparkpact.operators import hints as HI

    h = spark.createDataFrame([("preferBranch", "#/oneOf", None, None, 0, None, "t1"), ("preferBranch", "#/oneOf", None, None, 5, None, "t2"), ("ensurePropertyPresence", "#", "a", True, None, None, "t3")], HI.HINT + ", target_id string")
    t = spark.createDataFrame([("t1", "ONEOF_BRANCH", "branches", "unreachable", "UNSAT_X at #"), ("t2", "ONEOF_BRANCH", "branches", "active", None), ("t3", "PROPERTY_PRESENT", "structure", "unreachable", None)], "target_id string, target_kind string, dimension string, status string, reason string")
    got = {r.target_id: (r.reason_code, r.reason_detail) for r in HI.conflicts(h, HI.places(spark, {"oneOf": [{}, {}]}), [], t).collect()}
    assert got == {"t1": ("UNREACHABLE_BRANCH", "UNSAT_X at #"), "t2": ("CONFLICTING_CONSTRAINTS", "Branch index 5 exceeds available branches (2) at #/oneOf/5."), "t3": ("CONFLICTING_CONSTRAINTS", "Target # is unreachable")}
    assert HI.priority_order(["enum", "branches", "structure"], ["structure", "operations", "structure"], C.PRIORITY) == ["structure", "enum", "branches"]


def test_snapshot_bundle(spark, tmp_path):
    from sparkpact.sources.files import read_snapshot

    lines = ['{"fingerprint":"f1"}', "", '{"uri":"u1","body":{"b":1,"a":2.0}}', '{"uri":"u2","schema":true,"contentHash":" h ","dialect":"2020-12"}', '{"uri":"u3"}', "{", "[]", '{"uri":7,"body":1}']
    (tmp_path / "s.ndjson").write_text("\r\n".join(lines))
    rows = read_snapshot(spark, str(tmp_path / "s.ndjson")).collect()
    assert [(r.uri, r.text, r.content_hash, r.dialect) for r in rows if r.uri] == [("u1", '{"a":2,"b":1}', H.structural_hash({"a": 2, "b": 1}), None), ("u2", "true", "h", "2020-12")]
    assert [r.fingerprint for r in rows if r.fingerprint] == ["f1"] and [r.fault for r in rows if r.fault] == ["invalid-entry", "parse-error", "invalid-entry", "invalid-entry"]


def test_external_references():
    from sparkpact.plans.normalize import external_refs, may_skip

    c = {"properties": {"a": {"$ref": "http://x/y#/b"}, "b": {"$ref": "#/properties/a"}, "c": {"const": {"$ref": "z"}}}, "allOf": [{"$ref": "other.json"}]}
    probe, refs = external_refs(c)
    assert refs == ["http://x/y", "other.json"] and probe["properties"] == {"a": {}, "b": {"$ref": "#/properties/a"}, "c": {"const": {"$ref": "z"}}}
    ok = lambda s: True
    assert may_skip(c, ["other.json"], False, ok) == (True, None)
    assert [may_skip(*a)[1] for a in ((c, [], False, ok), ({}, ["x"], False, ok), (c, ["other.json"], True, ok), (c, [None], False, ok), (c, ["q"], False, ok), (c, ["other.json"], False, lambda s: False))] == ["no-compile-errors", "no-external-refs", "non-ref-error", "missing-ref-value", "failing-ref-mismatch", "probe-failed"]


def test_diff_summary_as_text():
    t = {"dimension": "enum", "kind": "ENUM_VALUE_HIT", "canon_path": "#/a", "id": "i", "op_key": "get"}
    got = C.diff_summary((0.5, 0.75), [("get", 0.5, 0.25), ("put", None, 1.0)], [t], [(t, "active", "unreachable")]).split("\n")
    assert got[1] == "  overall: from=0.500 to=0.750 delta=0.250" and "    get: from=0.500 to=0.250 delta=-0.250" in got
    assert got[got.index("  operations-changed:") + 1] == "    only-in-comparison: put" and got[-1] == "    [enum] get ENUM_VALUE_HIT at #/a (id=i): active -> unreachable" and "  improvements:" not in got


def test_faults_of_diagnostics(spark):
    from sparkpact.operators.diagnostics import faults, require

    rows = [("A", "#", "compose", '{"context":"coverage"}'), (None, "#", "compose", None), ("A", None, "compose", None), ("A", "#", "x", None), ("REGEX_COMPILE_ERROR", "#", "normalize", '{"context":"coverage"}'), ("A", "#", "repair", '{"x":{"canonPtr":1}}')]
    d = spark.createDataFrame(rows, "code string, canon_path string, phase string, details string")
    assert sorted(r.fault for r in faults(d).collect()) == ["canonPath", "code", "context", "forbidden key", "phase"]
    require(d.limit(1), {"A": ("compose",)})
    with pytest.raises(ValueError, match="not of this phase"):
        require(d.limit(1), {"A": ("repair",)})
