"""Planners, the generic validator, repair of documents, sources."""

import json

import pytest

from sparkpact import engine
from sparkpact.functions import hashing as H
from sparkpact.operators import coverage as C
from sparkpact.operators.documents import repair_document, repair_documents, validate_documents
from sparkpact.operators.generate import generate, merged, number, plan
from sparkpact.plans.compose import CoverageEntry, choose_branch, compose, literal_alternatives, numeric_proof, pattern_witness, regex_facts
from sparkpact.plans.normalize import detect_dialect, normalize
from sparkpact.plans.validator import Validator
from sparkpact.sources import files


def keywords(schema, value, **options):
    return [e.keyword for e in Validator(schema, **options).errors(value)]


@pytest.mark.parametrize(
    "schema, good, bad",
    [
        ({"type": "integer"}, 1.0, 1.5),
        ({"enum": [1, "a"]}, 1.0, True),
        ({"const": {"a": 1}}, {"a": 1.0}, {"a": 2}),
        ({"multipleOf": 0.1}, 0.3, 0.35),
        ({"minLength": 2}, "é😀", "😀"),
        ({"uniqueItems": True}, [1, True], [1, 1.0]),
        ({"contains": {"const": 1}, "minContains": 2, "maxContains": 3}, [1, 1], [1]),
        ({"prefixItems": [{"type": "string"}], "items": False}, ["a"], ["a", 1]),
        ({"items": [{"type": "string"}], "additionalItems": False}, ["a"], ["a", 1]),
        ({"required": ["a"]}, {"a": None}, {}),
        ({"properties": {"a": {}}, "patternProperties": {"^x": {}}, "additionalProperties": False}, {"a": 1, "x1": 2}, {"b": 1}),
        ({"propertyNames": {"maxLength": 1}}, {"a": 1}, {"ab": 1}),
        ({"dependentRequired": {"a": ["b"]}}, {"a": 1, "b": 2}, {"a": 1}),
        ({"dependentSchemas": {"a": {"required": ["b"]}}}, {"c": 1}, {"a": 1}),
        ({"oneOf": [{"minimum": 2}, {"maximum": 3}]}, 5, 2.5),
        ({"not": {"type": "null"}}, 1, None),
        ({"if": {"const": 1}, "then": False, "else": {"minimum": 0}}, 2, 1),
        ({"allOf": [{"properties": {"a": {}}}], "unevaluatedProperties": False}, {"a": 1}, {"b": 1}),
        ({"prefixItems": [{}], "unevaluatedItems": False}, [1], [1, 2]),
        ({"$defs": {"n": {"properties": {"next": {"$ref": "#/$defs/n"}}, "required": ["v"]}}, "$ref": "#/$defs/n"}, {"v": 1, "next": {"v": 2}}, {"v": 1, "next": {}}),
        ({"minimum": 1, "exclusiveMinimum": True}, 2, 1),
    ],
)
def test_validator(schema, good, bad):
    assert not keywords(schema, good)
    assert keywords(schema, bad)


def test_normalize():
    n = normalize({"definitions": {"a": {"type": "string", "nullable": True}}, "properties": {"x": {"$ref": "#/definitions/a"}, "y": {"minimum": 1, "exclusiveMinimum": True}, "z": {"enum": [3]}}, "allOf": [True, {}]})
    assert n.schema["properties"] == {"x": {"$ref": "#/$defs/a"}, "y": {"exclusiveMinimum": 1}, "z": {"const": 3}}
    assert "allOf" not in n.schema and n.schema["$defs"]["a"]["type"] == ["string", "null"]
    assert n.original("#/$defs/a") == "#/definitions/a"
    assert normalize({"anyOf": [False, False]}).schema is False
    assert normalize({"oneOf": [False, {"type": "string"}]}).schema == {"allOf": [{"type": "string"}]}
    assert normalize({"propertyNames": {"enum": ["b", "a"]}}).schema["patternProperties"] == {"^(?:a|b)$": True}
    assert detect_dialect({"$schema": "http://json-schema.org/draft-07/schema#"}) == "draft-07"


def test_compose():
    assert numeric_proof({"type": "integer", "exclusiveMinimum": 1, "exclusiveMaximum": 2}) and not numeric_proof({"type": "number", "minimum": 1, "maximum": 1})
    assert literal_alternatives("^(?:a|b\\.c)$") == {"a", "b.c"} and literal_alternatives("^a+$") is None
    assert CoverageEntry([(frozenset("ab"), ()), (frozenset(), ("^(?:b|c)$",))]).enumerate() == ["b"]
    assert not regex_facts("^(?=a)$")["safe"] and regex_facts("^[a-z]{2}$")["safe"]
    for p in ("^[A-Z]{2}-\\d{3}$", "^(foo|ba)$", "x+y", "^\\w+@\\w+\\.com$"):
        import re

        assert re.search(p, pattern_witness(p))
    picked = choose_branch([{"properties": {"k": {"const": 1}}, "required": ["k"]}, {"properties": {"k": {"const": 2}}, "required": ["k"]}, {}], "#/oneOf", 1)
    assert picked["scores"][0] == picked["scores"][1] > picked["scores"][2] and picked["ties"] == 2
    assert compose({"type": "integer", "minimum": 2, "maximum": 1}).unsat_paths == ["#"]


def test_numbers_and_rng():
    assert number({"minimum": 3, "multipleOf": 5}, True) == 5 and number({"maximum": -1}, True) == -1 and number({"exclusiveMinimum": 2.5}, True) == 3
    assert merged([{"multipleOf": 4, "minimum": 1}, {"multipleOf": 6, "minimum": 2}]) == {"multipleOf": 12, "minimum": 2}
    assert H.fnv1a32("") == 2166136261 and H.fnv1a32("a") == 0xE40C292C
    assert H.canonical_json({"b": 1.0, "a": -0.0}) == '{"a":0,"b":1}'


def test_generated_rows_are_valid(spark):
    contracts = [
        {"type": "object", "required": ["id", "when"], "properties": {"id": {"type": "string", "format": "uuid"}, "when": {"format": "date-time", "type": "string"}, "tags": {"type": "array", "items": {"type": "string"}, "minItems": 2, "uniqueItems": True}}, "minProperties": 3, "additionalProperties": False},
        {"type": "array", "contains": {"const": 3}, "minContains": 2, "items": {"type": "integer"}},
        {"oneOf": [{"type": "integer", "minimum": 5}, {"type": "integer", "multipleOf": 5}]},
        {"type": "object", "properties": {"a": {"const": 1}}, "required": ["a"], "if": {"properties": {"a": {"const": 1}}}, "then": {"required": ["b"], "properties": {"b": {"minimum": 4, "type": "number"}}}},
        {"type": "string", "pattern": "^[a-f]{3}\\d$"},
        {"allOf": [{"type": "integer", "minimum": 3}, {"multipleOf": 7}]},
    ]
    for c in contracts:
        rows = validate_documents(generate(spark, c, 5, 7), c, ["instance_id"], formats=True).collect()
        assert len(rows) == 5 and all(r.valid for r in rows), (c, plan(c)[0])
    docs = [json.loads(r.doc)["id"] for r in generate(spark, contracts[0], 20, 7).collect()]
    assert len(set(docs)) == 20 and all(d[14] == "4" and d[19] in "89ab" for d in docs)


def test_repair_documents(spark):
    schema = {"type": "object", "required": ["a", "b"], "properties": {"a": {"type": "integer", "minimum": 3}, "b": {"type": "string", "minLength": 2}, "c": {"type": "array", "uniqueItems": True, "maxItems": 2}}, "additionalProperties": False}
    v = Validator(schema)
    fixed, actions = repair_document(v, {"a": 1, "c": [1, 1, 2, 3], "x": 0})
    assert v.is_valid(fixed) and fixed == {"a": 3, "b": "aa", "c": [1, 2]} and {a for a, _, _ in actions} >= {"numericClamp", "addRequiredDefault", "removeAdditionalProperty"}
    df = spark.createDataFrame([(1, '{"a":5,"b":"xx"}'), (2, "{"), (3, None)], "id long, doc string")
    got = {r.id: (r.doc, r.valid) for r in repair_documents(df, schema, ["id"]).collect()}
    assert got == {1: ('{"a":5,"b":"xx"}', True), 2: ("{", False), 3: (None, False)}


def test_coverage_plan():
    t = [{"dimension": "enum", "canon_path": "#/a", "op_key": "x"}, {"dimension": "enum", "canon_path": "#/a", "op_key": "y"}, {"dimension": "enum", "canon_path": "#/b", "op_key": "x"}]
    assert C.caps(t, per_operation=1) == t[:2] and C.caps(t, {"enum": 2}, per_path=1) == [t[0], t[2]]
    assert C.unit_seed(1, 0, "#") == H.XorShift32(1, "tu-0|#").next()


def test_engine_run(spark):
    r = engine.run(spark, {"type": "object", "required": ["a"], "properties": {"a": {"anyOf": [{"type": "string"}, {"type": "integer"}]}}}, engine.Options(instances=3))
    assert [x.valid for x in r.validated.collect()] == [True] * 3 and not r.unsatisfiable
    g = engine.generate_guided(spark, {"anyOf": [{"type": "string"}, {"type": "integer"}]}, engine.Options(instances=2))
    assert [x.doc for x in g.orderBy("instance_id").collect()] == ['""', "0"]
    with pytest.raises(ValueError):
        engine.Options(conditionals="always")


def test_sources(spark, tmp_path):
    (tmp_path / "c" / "d").mkdir(parents=True)
    (tmp_path / "c" / "d" / "x.json").write_text('{"type": "string"}')
    (tmp_path / "c" / "y.txt").write_text("no")
    assert [r.contract_id for r in files.read_contracts(spark, str(tmp_path / "c")).collect()] == ["d/x.json"]
    reg = files.registry(spark, [("u", {"a": 1}), ("u", {"a": 2})])
    files.write_cache(reg, str(tmp_path / "cache"))
    assert files.read_cache(spark, str(tmp_path / "cache"), ["u"]).first().text == '{"a":1}' and len(files.registry_fingerprint(reg).first()[0]) == 64
    files.write_report(spark, {"engineMajor": 0}, str(tmp_path / "r"))
    assert files.read_report(spark, str(tmp_path / "r"))["engineMajor"] == 0
    with pytest.raises(files.Incompatible):
        files.compatible({"version": 1}, {"version": 2})
    for n, want in ((2, [1, 1]), (500, [1] * 500)):
        files.write_items(generate(spark, {"const": 1}, n), str(tmp_path / "i"), "json")
        assert json.loads("".join(f.read_text() for f in sorted((tmp_path / "i").glob("part-*")))) == want
    files.write_items(generate(spark, {"const": 1}, 2).where("false"), str(tmp_path / "i"), "json")
    assert json.loads("".join(f.read_text() for f in sorted((tmp_path / "i").glob("part-*")))) == []
    doc = {"paths": {"/x": {"get": {"responses": {"201": {"content": {"text/plain": {"schema": {"$ref": "#/components/schemas/A"}}}}, "404": {}}}, "post": {"operationId": "make", "requestBody": {"content": {"application/json": {"schema": {"$ref": "#/components/schemas/A"}}}}}}}, "components": {"schemas": {"A": {"properties": {"b": {}}}}}}
    assert [o["key"] for o in files.operations(doc)] == ["GET /x", "make"]
    assert files.select_response(doc, "GET /x")["status"] == "201"
    edges, roots = files.operation_edges(doc)
    e = spark.createDataFrame(edges, "src string, dst string")
    reach = C.reachability(e, spark.createDataFrame(roots, "operation string, node string"))
    assert {r.node for r in C.reused(reach).collect()} >= {"#/components/schemas/A"}


def test_automata():
    import itertools
    import re

    from sparkpact.plans import automata as A

    patterns = ["^a(b|c)*$", "^x", "b$", "^[a-c]{2,3}$", "^(?:ab|cd)$", "^\\d+-?$", "a.c", "^[^a]$", "^a?b+$"]
    words = ["".join(w) for n in range(5) for w in itertools.product("abcx1-", repeat=n)]
    for p in patterns:
        d = A.from_pattern(p)
        assert all(d.accepts(w) == bool(re.search(p, w)) for w in words), p
    assert A.from_pattern("^(?:b|aa|a)$").words() == ["a", "b", "aa"] and A.from_pattern("^[ab]{2}$").finite and not A.from_pattern("^a+$").finite
    both = A.product([A.from_pattern("^[a-c]+$"), A.from_names(["ab", "zz", "c"])])
    assert both.words() == ["c", "ab"] and both.finite
    assert A.overlap("^a", "b$") and A.overlap("^a$", "^b$") is False and A.overlap("(?=a)", "b") is None
    assert CoverageEntry([(frozenset(), ("^[ab]{1,2}$",)), (frozenset(["ab", "q"]), ("^a",))]).enumerate() == ["a", "aa", "ab"]
    got = [d["code"] for d in compose({"patternProperties": {"^a": {}, "b$": {}}, "additionalProperties": False}).diagnostics]
    assert got == ["AP_FALSE_PATTERN_OVERLAP"]


def test_command_line(spark, tmp_path):
    import io

    from sparkpact import cli

    path = tmp_path / "s.json"
    path.write_text(json.dumps({"type": "object", "required": ["a", "b"], "properties": {"a": {"enum": ["x", "y"]}, "b": {"type": "integer", "minimum": 2}}}))
    out = io.StringIO()
    assert cli.main(["generate", str(path), "-n", "2"], spark, out) == 0
    assert json.loads(out.getvalue()) == [{"a": "x", "b": 2}] * 2
    assert cli.main(["contracts", str(path), "--report", str(tmp_path / "r")], spark, io.StringIO()) == 0
    assert cli.main(["contracts", str(path), "--min-coverage", "1"], spark, io.StringIO()) == 70
    report = files.read_report(spark, str(tmp_path / "r"))
    assert report["byDimension"]["enum"] == 0.5
    assert cli.main(["coverage", "diff", str(tmp_path / "r"), str(tmp_path / "r")], spark, io.StringIO()) == 0
    api = tmp_path / "api.json"
    api.write_text(json.dumps({"paths": {"/x": {"get": {"responses": {"200": {"content": {"application/json": {"schema": {"$ref": "#/components/schemas/A"}}}}}}}}, "components": {"schemas": {"A": {"type": "integer", "minimum": 4}}}}))
    out = io.StringIO()
    assert cli.main(["openapi", str(api), "--operation", "GET /x"], spark, out) == 0 and json.loads(out.getvalue()) == [4]
