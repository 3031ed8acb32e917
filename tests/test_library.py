"""Operators on hand-written documents, each with a clean control."""

import json
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusward.functions import markdown, pointers, text
from corpusward.functions.severity import findings
from corpusward.jobs import corpora
from corpusward.operators import bundle_hygiene, bundles, conformance, execution, hygiene, references, registry, report
from corpusward.schemas import FINDINGS
from corpusward.sources import documents
from corpusward.sources import bundles as bundle_files
from corpusward.sources.bundles import read_bundles
from corpusward.sources.findings import write_findings
from corpusward.sources.registries import read_registries


def nodes_of(spark, texts: dict):
    return documents.to_nodes(spark.createDataFrame(list(texts.items()), "doc_id string, text string"))


def codes(found):
    return sorted((r.doc_id, r.code, r.pointer) for r in found.collect())


# ---------------------------------------------------------------- parsing


def test_yaml_keeps_strings_and_kinds(spark):
    n = nodes_of(spark, {"a": "date: 2024-01-02\nyes: on\nn: 12\nx: 1.5\nz: 010\nb: true\nq: '1'\ne: {}\nl: [1, a/b]\n'a/b~': null"})
    got = {r.pointer: (r.kind, r.sval, r.nval, r.n_children) for r in n.collect()}
    assert got["/date"][:2] == ("string", "2024-01-02") and got["/yes"][:2] == ("string", "on") and got["/z"][0] == "string"
    assert got["/n"][0] == "integer" and got["/x"] == ("number", "1.5", 1.5, 0) and got["/b"][:2] == ("boolean", "true")
    assert got["/e"][3] == 0 and got["/l"][3] == 2 and got["/a~1b~0"][0] == "null" and got["/l/1"][1] == "a/b"


def test_unparseable_empty_and_duplicate_keys(spark):
    n = nodes_of(spark, {"bad": "a: [", "dup": "a: 1\na: 2", "dupjson": '{"a": 1, "a": 2}', "none": None, "blank": " \n# only a comment\n", "null": "null", "ok": "{a: b}", "flow": '{"a": 1}'})
    kinds = {r.doc_id: r.kind for r in n.where("depth = 0").collect()}
    assert kinds == {"bad": "error", "dup": "error", "dupjson": "error", "none": "empty", "blank": "empty", "null": "null", "ok": "object", "flow": "object"}
    found = documents.parse_findings(n, "odcs")
    assert [(r.code, r.line) for r in found.where("doc_id = 'bad'").collect()] == [("ODCS001", 2)]
    assert documents.parsed(n).where("doc_id in ('bad', 'none')").count() == 0


def test_texts_without_a_json_value_are_error_rows(spark):
    bomb = "a: &a [x,x,x,x,x,x,x,x,x]\n" + "".join(f"{y}: &{y} [{','.join(['*' + x] * 9)}]\n" for x, y in zip("abcdefg", "bcdefgh", strict=False))
    texts = {
        "binary": "a: !!binary aGVsbG8=", "time": "a: !!timestamp 2024-01-01", "set": "a: !!set {x, y}", "own": "a: !own 1", "bool": "a: !!bool z", "surrogate": '{"a": "\\ud800"}', "nan": '{"a": NaN}', "infinite": '{"a": 1e999}', "yaml infinite": "a: [1e999]",
        "bomb": bomb, "ring": "&a [*a]", "deep": "- " * 100_000, "deep json": "[" * 100_000,
    }
    good = {"good": '{"a": "\\ud83d\\ude00", "n": -1.5}', "alias": "a: &x [1, 2]\nb: *x", "long": json.dumps([{"k": "v" * 50}] * 3000)}
    got = nodes_of(spark, texts | good)
    assert {r.doc_id for r in got.where("kind = 'error'").collect()} == set(texts)
    assert {(r.doc_id, r.n) for r in got.where("kind <> 'error'").groupBy("doc_id").agg(F.count("*").alias("n")).collect()} == {("good", 3), ("alias", 7), ("long", 6001)}
    assert len(documents.parse_findings(got, "odcs").where("code = 'ODCS001' and line is not null").collect()) == len(texts)


def test_documents_longer_than_a_batch_keep_their_order(spark):
    value = [{"k": [i, {}, []], "": None} for i in range(30_000)]
    got = nodes_of(spark, {"a": "b: 1", "long": json.dumps(value), "z": "[]"}).where("doc_id = 'long'").orderBy("seq").toPandas()
    assert got.seq.tolist() == list(range(1 + 30_000 * 6)) and got.pointer.is_unique
    assert got.pointer[6:13].tolist() == ["/0/", "/1", "/1/k", "/1/k/0", "/1/k/1", "/1/k/2", "/1/"] and got.rule_path[9] == "/*/k/*"


def test_few_partitions_are_dealt_over_tasks(spark):
    docs = spark.range(500, numPartitions=1).selectExpr("'d' as doc_id", "concat('a: ', id) as text")
    nodes = documents.to_nodes(documents.dealt(docs)).withColumn("task", F.spark_partition_id())
    assert nodes.agg(F.count_distinct("task")).first()[0] > 8 and nodes.count() == 1000


def test_rule_paths_generalise_indexes_and_names(spark):
    n = nodes_of(spark, {"a": json.dumps({"models": {"fields": {"fields": {"items": {"items": {"type": "x"}}}}}, "servers": [{"id": 1}]})})
    paths = {r.pointer: r.rule_path for r in n.collect()}
    assert paths["/models/fields/fields/items/items/type"] == "/models/*/fields/*/items/type" and paths["/servers/0/id"] == "/servers/*/id"


def test_discovery(spark, tmp_path):
    for name in ("a.yaml", "sub/B.YML", "c.txt", ".hidden/d.json", "target/e.json", "kb/index.md", "kb/x.yaml", "kb/deep/y.json", "f.json"):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("a: 1")
    got = {r.doc_id[len(str(tmp_path)) + 1 :] for r in documents.read_documents(spark, [str(tmp_path)]).collect()}
    assert got == {"a.yaml", "sub/B.YML", "f.json"}
    assert documents.read_documents(spark, [f"{tmp_path}/c.txt"]).count() == 1


def test_discovery_at_any_depth(spark, tmp_path):
    for levels in (31, 32, 60):
        path = tmp_path / "/".join("d" * levels) / f"{levels}.yaml"
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("a: 1")
    assert {r.doc_id.rsplit("/", 1)[1] for r in documents.read_documents(spark, [str(tmp_path)]).collect()} == {"31.yaml", "32.yaml", "60.yaml"}


def test_routing(spark):
    texts = {"c": "kind: DataContract", "p": "kind: DataProduct\ndataContractSpecification: 1", "l": "dataContractSpecification: 1.1.0", "x": "kind: Other", "n": "kind: 3\ndataContractSpecification: 1", "u": "a: 1"}
    docs = spark.createDataFrame([(k,) for k in texts], "doc_id string")
    routed = documents.route_documents(docs, nodes_of(spark, texts))
    assert {r.doc_id: r.standard for r in routed.collect()} == {"c": "odcs", "p": "odps", "l": "odcl", "x": None, "n": "odcl", "u": None}
    assert codes(documents.routing_problems(routed)) == [("u", "CLI002", None), ("x", "CLI002", None)]
    assert [r.code for r in documents.routing_problems(routed.limit(0)).collect()] == ["CLI003"]


# ---------------------------------------------------------------- report algebra


def some_findings(spark):
    rows = spark.createDataFrame([("a", 0), ("a", 1), ("b", 2)], "doc_id string, seq long")
    return report.merge_reports(*(findings(rows.where(F.col("seq") == i), spec_id="s", severity=s, code=s, message="m", pointer="/p", seq=F.col("seq")) for i, s in enumerate(("error", "warning", "info"))))


def test_report_algebra(spark):
    f = some_findings(spark)
    assert f.schema.simpleString() == spark.createDataFrame([], FINDINGS).schema.simpleString()
    assert [r.severity for r in report.sort_findings(f).collect()] == ["error", "warning", "info"]
    assert report.merge_reports(f, f).count() == 2 * f.count()
    gates = [report.gate(f, p).first() for p in report.POLICIES]
    assert [g.exit_code for g in gates] == [0, 1, 1, 1]
    assert report.gate(f, "never", unusable=True).first().exit_code == 2
    none = report.gate(f.limit(0), "info").first()
    assert (none.worst, none.gated, none.exit_code) == (None, False, 0)
    with pytest.raises(ValueError):
        report.gate(f, "fatal")
    summary = report.run_summary(spark.createDataFrame([], "doc_id string"), f.limit(0)).first()
    assert (summary.outcome, summary.exit_code, summary.total) == ("not-performed", 2, 0)
    assert f.select(report.render_finding()).first()[0] == "error[error] a (/p): m"


def test_findings_do_not_depend_on_partitions(spark):
    texts = {f"d{i}": json.dumps({"apiVersion": "v1", "servers": [{"id": "x"}, {"id": "x"}], "schema": []}) for i in range(20)}
    n = nodes_of(spark, texts)
    facts = hygiene.Facts("3.1.0")
    assert codes(hygiene.hygiene(n, facts, "odcs")) == codes(hygiene.hygiene(n.repartition(7), facts, "odcs"))


def test_written_findings_read_back(spark, tmp_path):
    write_findings(some_findings(spark), f"{tmp_path}/f")
    assert spark.read.parquet(f"{tmp_path}/f").count() == 3


# ---------------------------------------------------------------- schema conformance

SCHEMA = {
    "type": "object",
    "required": ["id", "kind"],
    "additionalProperties": False,
    "properties": {
        "id": {"type": "string", "minLength": 2, "pattern": "^[a-z]+$"},
        "kind": {"const": 3},
        "flags": {"type": "array", "uniqueItems": True, "maxItems": 3},
        "mail": {"type": "string", "format": "email"},
        "when": {"type": "string", "format": "date-time"},
        "n": {"type": "integer", "exclusiveMinimum": 0, "multipleOf": 5},
        "one": {"oneOf": [{"type": "string"}, {"type": "object", "required": ["x"]}]},
        "any": {"anyOf": [{"enum": ["a", 1]}, {"type": "array", "items": {"type": "string"}}]},
        "never": {"not": {"type": "boolean"}},
        "child": {"$ref": "#/$defs/Node"},
    },
    "$defs": {"Node": {"type": "object", "properties": {"child": {"$ref": "#/$defs/Node"}, "v": {"type": ["number", "null"]}}}},
}
CLEAN = {"id": "ab", "kind": 3.0, "flags": [{"a": 1}, {"a": 2}, 1], "mail": "a@b", "when": "2024-02-29T00:00:00Z", "n": 10.0, "one": {"x": 1}, "any": ["s"], "never": 1, "child": {"child": {"v": None}, "v": 1}}


def test_schema_violations(spark):
    bad = {"id": "A", "zz": 1, "yy": 2, "flags": [{"a": 1, "b": [2]}, {"b": [2], "a": 1.0}, 3, 4], "mail": "ab", "when": "2023-02-29T00:00:00Z", "n": -3, "one": {"y": 1}, "any": [1], "never": True, "child": {"child": {"v": "s"}}}
    n = nodes_of(spark, {"clean": json.dumps(CLEAN), "bad": json.dumps(bad), "kinds": json.dumps({"id": 5, "kind": 4, "any": 1.0, "one": "s"})})
    found = conformance.schema_findings(n, conformance.rule_table(spark, SCHEMA), "cads")
    assert codes(found) == sorted(
        [("bad", "CADS101", ""), ("bad", "CADS102", ""), ("bad", "CADS105", "/id"), ("bad", "CADS107", "/id"), ("bad", "CADS106", "/flags"), ("bad", "CADS106", "/flags"), ("bad", "CADS105", "/mail"), ("bad", "CADS105", "/when"), ("bad", "CADS107", "/n"), ("bad", "CADS107", "/n"), ("bad", "CADS108", "/one")]
        + [("bad", "CADS108", "/any"), ("bad", "CADS108", "/never"), ("bad", "CADS104", "/child/child/v"), ("kinds", "CADS104", "/id"), ("kinds", "CADS103", "/kind")]
    )
    assert found.where("code = 'CADS102'").first().message == "unknown keys: zz, yy"


def _at(n, inner):
    """``inner`` below ``n`` keys."""
    return inner if n == 0 else {"a": _at(n - 1, inner)}


def test_rules_below_the_eighth_level(spark):
    schema = {"type": "string"}
    for _ in range(14):
        schema = {"properties": {"a": schema}}
    n = nodes_of(spark, {"bad": json.dumps(_at(14, 1)), "clean": json.dumps(_at(14, "s"))})
    assert codes(conformance.schema_findings(n, conformance.rule_table(spark, schema), "cads")) == [("bad", "CADS104", "/a" * 14)]


def test_recursive_schemas_go_as_deep_as_documents(spark):
    node = {"type": "object", "properties": {"a": {"$ref": "#/$defs/N"}, "v": {"type": "integer"}, "w": {"oneOf": [{"type": "string"}, {"$ref": "#/$defs/N"}]}}}
    rules = conformance.rule_table(spark, {"$ref": "#/$defs/N", "$defs": {"N": node}})
    n = nodes_of(spark, {"bad": json.dumps(_at(13, {"v": "s", "w": 1})), "clean": json.dumps(_at(13, {"v": 1, "w": {"v": 2}})), "branch": json.dumps(_at(6, {"w": _at(6, {"v": "s"})}))})
    found = conformance.schema_findings(n, rules, "cads")
    assert codes(found) == [("bad", "CADS104", "/a" * 13 + "/v"), ("bad", "CADS108", "/a" * 13 + "/w"), ("branch", "CADS108", "/a" * 6 + "/w")]
    assert [r.pointer for r in conformance.wrong_type(n, rules).collect()] == ["/a" * 13 + "/v"]


def test_members_that_arrays_must_contain(spark):
    schema = {"properties": {"l": {"contains": {"type": "object", "required": ["x"]}, "maxContains": 2}, "never": {"contains": False}, "m": {"items": {"contains": {"const": 1}}}, "one": {"oneOf": [{"contains": {"type": "string"}}, {"type": "string"}]}}}
    texts = {"clean": {"l": [{"x": 1}, 2], "m": [[1, 2], [1]], "one": ["s", 1]}, "bad": {"l": [{"y": 1}, {"y": {"x": 1}}], "m": [[1], [2, 3], []], "one": [1]}, "many": {"l": [{"x": 1}] * 3}, "empty": {"l": []}, "never": {"never": [1]}, "other": {"l": "s"}}
    n = nodes_of(spark, {k: json.dumps(v) for k, v in texts.items()})
    rules = conformance.rule_table(spark, schema)
    assert codes(conformance.schema_findings(n, rules, "cads")) == [("bad", "CADS106", "/l"), ("bad", "CADS106", "/m/1"), ("bad", "CADS106", "/m/2"), ("bad", "CADS108", "/one"), ("empty", "CADS106", "/l"), ("many", "CADS106", "/l"), ("never", "CADS106", "/never")]
    assert conformance.flatten_schema({"contains": {}}) == [("", "contains", "1:  contains ", 1.0, None, None)]
    assert {r.message for r in conformance.bad_cardinality(n, rules).where("doc_id = 'many' and branch is null").collect()} == {"maxContains is not met"}


KEYWORDS = {
    "if": {"properties": {"kind": {"const": "a"}}, "required": ["kind"]},
    "then": {"required": ["x"], "properties": {"y": {"oneOf": [{"type": "string"}, {"anyOf": [{"minimum": 5}, {"not": {"type": "number"}}]}]}}},
    "else": {"properties": {"x": False}},
    "dependentSchemas": {"dep": {"required": ["other"]}},
    "patternProperties": {"^p": {"type": "integer"}, "q$": {"minimum": 3}},
    "additionalProperties": {"type": ["string", "number", "object", "array"], "maxLength": 3},
    "properties": {"kind": {}, "x": {}, "y": {}, "dep": {}, "other": {}, "pk": {"maximum": 9}, "map": {"propertyNames": {"maxLength": 2, "pattern": "^[a-z]"}, "additionalProperties": {"$ref": "#/$defs/T"}}},
    "$defs": {"T": {"type": "object", "required": ["t"], "additionalProperties": {"$ref": "#/$defs/T"}, "properties": {"t": {"allOf": [{"minimum": 1}, {"multipleOf": 2}]}}}},
}


def test_keywords_that_take_schemas(spark):
    cases = [
        ({"kind": "a", "x": 1, "y": "s"}, [("108", "/y")]),
        ({"kind": "a", "y": 3}, [("101", ""), ("108", "/y")]),
        ({"kind": "a", "x": 1, "y": 7}, []),
        ({"kind": "b", "x": 1, "y": 3}, [("108", "/x")]),
        ({"x": 1}, [("108", "/x")]),
        ({"dep": 1}, [("101", "")]),
        ({"dep": 1, "other": 1}, []),
        ({"p1": "s", "pq": 2, "q": 2.5, "zq": 3}, [("104", "/p1"), ("107", "/pq"), ("107", "/q")]),
        ({"pk": 10.5}, [("104", "/pk"), ("107", "/pk")]),
        ({"z": "long", "zz": True, "a/b": "long", "zo": "abc"}, [("107", "/z"), ("104", "/zz"), ("107", "/a~1b")]),
        ({"map": {"ab": {"t": 2}, "ABC": {"t": 3}}}, [("102", "/map"), ("107", "/map/ABC/t")]),
        ({"map": {"ab": {"t": 2, "more": {"t": 0, "deep": {"x": {}}}}}}, [("107", "/map/ab/more/t"), ("101", "/map/ab/more/deep"), ("101", "/map/ab/more/deep/x")]),
        ([1], []),
    ]
    n = nodes_of(spark, {str(i): json.dumps(value) for i, (value, _) in enumerate(cases)})
    found = codes(conformance.schema_findings(n, conformance.rule_table(spark, KEYWORDS), "cads"))
    assert found == sorted((str(i), f"CADS{code}", place) for i, (_, want) in enumerate(cases) for code, place in want)


def test_keywords_that_are_not_checked_are_reported(spark):
    rules = conformance.rule_table(spark, {"properties": {"a": {"prefixItems": [{}], "title": "t", "enum": [[1]]}, "b": {"$ref": "other.json"}}})
    found = conformance.schema_findings(nodes_of(spark, {"d": '{"a": [2], "b": 1}'}), rules, "cads")
    assert sorted((r.doc_id, r.code, r.pointer, r.message) for r in found.collect()) == [("d", "CADS103", "/a", "this array is not permitted"), ("schema", "CADS100", "/a", "not checked: prefixItems"), ("schema", "CADS100", "/b", "not checked: $ref other.json")]


# ---------------------------------------------------------------- hygiene and references


def test_stable_ids_in_nested_arrays(spark):
    doc = {"servers": [{"id": "a"}, {"id": "b"}, {"id": "a"}, {"id": 1}, {"id": 1}], "schema": [{"id": "a", "properties": [{"id": "p", "properties": [{"id": "p"}, {"id": "p"}]}, {"id": "q", "items": {"properties": [{"id": "r"}, {"id": "r"}]}}, {"id": "p"}]}]}
    found = hygiene.duplicate_stable_ids(nodes_of(spark, {"d": json.dumps(doc)}))
    assert [c[2] for c in codes(found)] == ["/schema/0/properties/0/properties/1/id", "/schema/0/properties/1/items/properties/1/id", "/schema/0/properties/2/id", "/servers/2/id"]


def test_absent_or_empty(spark):
    n = nodes_of(spark, {"d": "servers: []\nteam: '  '\nschema: false\ndescription: 0", "list": "[1]"})
    assert codes(hygiene.absent_sections(n, hygiene.Facts("1"), "odcs")) == [("d", "ODCS202", "/servers"), ("d", "ODCS203", "/team")]


def test_three_ways_to_resolve_contracts(spark):
    refs = spark.createDataFrame([("p", "/x", "k", c, i) for i, c in enumerate(("a", "b", "zz"))], "doc_id string, pointer string, key string, contract_id string, seq int")
    contracts = lambda rows: spark.createDataFrame(rows, "doc_id string, contract_id string")
    states = lambda rows: [(r.state, r.reason) for r in references.resolve_contracts(refs, contracts(rows)).orderBy("seq").collect()]
    assert states([("2", "a"), ("1", "a"), ("3", "b")]) == [("resolved", None), ("resolved", None), ("does-not-exist", None)]
    assert states([("1", "a"), ("2", None)]) == [("resolved", None), ("not-inspected", "inspection-failed"), ("not-inspected", "inspection-failed")]
    assert set(states([])) == {("not-inspected", "outside-document-set")}
    resolved = references.resolve_contracts(refs, contracts([("2", "a"), ("1", "a")]))
    assert resolved.where("contract_id = 'a'").first().target == ["1", "2"]
    assert references.contract_findings(resolved).count() == 3
    collisions = references.contract_id_collisions(contracts([("1", "a"), ("2", "a"), ("3", "a"), ("4", "b"), ("4", "b")])).collect()
    assert {r.doc_id: r.message for r in collisions} == {"1": "id a is also declared by 2 and 3", "2": "id a is also declared by 1 and 3", "3": "id a is also declared by 1 and 2"}


# ---------------------------------------------------------------- provenance


def test_registry_problems(spark):
    good = ("a", "n", None, None, None, None, None, "v1", "p", "0" * 64, "2024-01-01", None, None, 0)
    for entries, version, code in ((None, 1, "REG100"), ([good[:3]], 1, "REG101"), ([good], 2, "REG102")):
        table, problems = registry.registry_frame(spark, entries, version)
        assert table.count() == 0 and [r.code for r in problems.collect()] == [code]
    table, problems = registry.registry_frame(spark, [good, good[:7] + ("  MAIN ",) + good[8:13] + (1,)])
    assert problems.count() == 0
    assert sorted(r.code for r in report.merge_reports(registry.pin_rules(table), registry.duplicate_entry_ids(table), registry.registry_field_rules(table)).collect()) == ["REG001", "REG005"]
    artefacts = spark.createDataFrame([("p", None)], "path string, content binary")
    assert {r.status for r in registry.verify_digests(table, artefacts).collect()} == {"unreadable"}


# ---------------------------------------------------------------- bundles


def a_bundle(spark, files: dict):
    concepts, index = read_bundles(spark.createDataFrame(list(files.items()), "doc_id string, text string"))
    blocks = markdown.fenced_code_blocks(concepts.select("bundle", "concept_id", "body"))
    return concepts, index, blocks, markdown.text_lines(concepts, blocks)


def test_bundles_nest_under_the_outermost_index(spark):
    concepts, index, _, _ = a_bundle(spark, {"k/index.md": "", "k/a/index.md": "", "k/a/c.md": "---\ntype: x\n---\nb", "k/log.md": "", "other/d.md": "x", "k/bad.md": "---\na: [\n---\n"})
    assert {(r.bundle, r.concept_id) for r in concepts.collect()} == {("k", "a/c"), ("k", "bad")}
    assert index.count() == 2 and [r.code for r in bundles.parse_problems(concepts).collect()] == ["OKF001"]


def test_headings_and_computation_blocks(spark):
    body = "## First\n\n### Sub\ntext\n## Empty\n \n## Code\n```\nx\n```\n# Computation\n```\nselect 1\n```\n~~~json\n{\n~~~\n```open\n# not closed"
    concepts, _, blocks, lines = a_bundle(spark, {"k/index.md": "", "k/c.md": body})
    found = bundle_hygiene.heading_structure(concepts, lines).collect()
    assert sorted((r.code, r.seq) for r in found) == [("OKFL03", 19), ("OKFL04", 5), ("OKFL04", 19)]
    assert [r.seq for r in bundle_hygiene.untagged_computation(concepts, blocks, lines).collect()] == [12]
    assert [r.code for r in bundle_hygiene.code_block_syntax(concepts, blocks).collect()] == ["OKF007"]


def test_broken_computation_block_is_a_warning_once(spark):
    broken = "```json\n{\n```\n"
    files = {"k/index.md": "", "k/a.md": f"# Code\n{broken}# Computation\ntext\n{broken}```yaml\na: [\n```\n", "k/b.md": f"# Code\n{broken}", "k/c.md": "# Computation\n```json\n{}\n```\n" + broken}
    concepts, _, blocks, _ = a_bundle(spark, files)
    found = bundle_hygiene.code_block_syntax(concepts, blocks).collect()
    assert sorted((r.pointer, r.code, r.severity, r.seq) for r in found) == [("a", "OKF007", "info", 10), ("a", "OKF310", "warning", 7), ("b", "OKF007", "info", 2), ("c", "OKF007", "info", 5)]


def test_verdicts_have_both_outcomes(spark):
    verdicts = lambda text: spark.createDataFrame([(str(i), {"o": "ok", "e": "err"}[x]) for i, x in enumerate(text)], "doc_id string, verdict string")
    got = {r.side: (r.passes, r.fails, r.discriminates) for r in registry.verdict_balance(verdicts("ooee"), verdicts("oooe")).collect()}
    assert got == {"recorded": (2, 2, True), "computed": (3, 1, False)}
    assert [r.discriminates for r in registry.verdict_balance(verdicts(""), verdicts("")).collect()] == [False, False]


def test_overlapping_rings_are_findings_of_their_own(spark):
    def concept(*targets):
        return "---\nsources: [" + ", ".join(f'{{"resource": "{t}.md"}}' for t in targets) + "]\n---\nb"

    files = {"k/index.md": "", "k/a.md": concept("b", "c"), "k/b.md": concept("a"), "k/c.md": concept("a"), "k/d.md": concept("a"), "k/e.md": concept("f"), "k/f.md": concept("https://x/e"), "k/g.md": concept("g")}
    found = bundles.circular_derivation(a_bundle(spark, files)[0]).collect()
    assert {(r.pointer, r.message) for r in found} == {("a", "derives from itself: a -> b"), ("a", "derives from itself: a -> c"), ("g", "derives from itself: g")}


def test_paths_links_and_hostile_text(spark):
    rows = spark.createDataFrame([("/a/b",), ("a/../b",), ("mailto:x",), ("x:y",), ("//",), ("a\\.\\b",), (None,)], "p string")
    assert [r[0] for r in rows.select(text.bundle_relative(F.col("p"))).collect()] == ["a/b", None, None, None, None, None, None]
    links = rows.limit(1).select(text.link_targets(F.lit("[a](../x.md#h) [b](/y.md) ![i](i.png 't') [m](mailto:a) [f](#h)"), F.lit("d/e/f.md"))).first()[0]
    assert [(x.target, x.anchor) for x in links] == [("d/x.md", "h"), ("y.md", None), ("d/e/i.png", None), (None, None), (None, "h")]
    hostile = rows.limit(1).select(text.neutralise_for_terminal(F.lit("a​b\x1b")), text.neutralise_for_html(F.lit("<­\n'"))).first()
    assert tuple(hostile) == ("a<U+200B>b<U+001B>", "&lt;&lt;U+00AD&gt;\n&#39;")
    escaped = rows.limit(1).select(pointers.pointer_escape(F.lit("~1/")), pointers.pointer_unescape(F.lit("~01~1"))).first()
    assert tuple(escaped) == ("~01~1", "~1/")


# ---------------------------------------------------------------- execution


def test_constraints_and_relationships_with_nulls(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c"), (None, None)], "k int, v string")
    out = {(r.property, r.rule): r.violations for r in execution.check_constraints(df, [{"name": "k", "unique": True, "primaryKey": True}, {"name": "v", "required": True, "logicalTypeOptions": {"minLength": 2}}], "t").collect()}
    assert out == {("v", "required"): 1, ("v", "minLength"): 3, ("k", "unique"): 1, ("k", "primaryKey"): 3}
    other = spark.createDataFrame([(2,)], "k int")
    r = execution.check_relationships({"a": df, "b": other}, [{"from": "a.k", "to": "b.k"}]).first()
    assert r.orphans == 2 and r.sample == "{1}"
    with pytest.raises(ValueError):
        execution.check_relationships({"a": df, "b": other}, [{"from": ["a.k", "a.v"], "to": "b.k"}])


# ---------------------------------------------------------------- groups of any size


def test_rings_equal_brute_force(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(40), rng.randrange(40)) for _ in range(45)] + [(100 + i, 100 + (i + 1) % 30) for i in range(30)] + [(5, 100), (100, 200), (200, 201), (201, 202), (202, 201), (300, 300)]
    name = "n{:03d}".format
    after = {}
    for a, b in edges:
        after.setdefault(a, set()).add(b)
    reach = {}
    for start in {v for e in edges for v in e}:
        todo, seen = list(after.get(start, ())), set()
        while todo:
            if (v := todo.pop()) not in seen:
                seen.add(v)
                todo += after.get(v, ())
        reach[start] = seen
    want = {(name(v), name(min(u for u in reach[v] if v in reach[u]))) for v in reach if v in reach[v]}
    rows = spark.createDataFrame([("b", name(a), name(b)) for a, b in edges], "bundle string, a string, b string")
    assert {(r.v, r.ring) for r in bundles.derivation_rings(rows).collect()} == want
    assert {(r.v, r.ring) for r in bundles._rings_over_tasks(rows).collect()} == want
    assert bundles.derivation_rings(rows.limit(0)).count() == 0 and bundles.derivation_walks(rows.limit(0)).count() == 0


@pytest.mark.parametrize("steps", [1, 20_000_000])
def test_walks_of_rings(spark, steps, monkeypatch):
    monkeypatch.setattr(bundles, "STEPS", steps)
    rng = random.Random(11)
    edges = sorted({(f"n{rng.randrange(9)}", f"n{rng.randrange(9)}") for _ in range(30)})
    got = {(r.start, tuple(r.walk)) for r in bundles.derivation_walks(spark.createDataFrame([("b", *e) for e in edges], "bundle string, a string, b string")).collect()}
    # every walk is one, starts at its smallest-found concept, and no two have the same members
    for start, walk in got:
        assert walk[0] == start and all(e in edges for e in zip(walk, [*walk[1:], start], strict=True)) and len(set(walk)) == len(walk)
    assert len({frozenset(w) for _, w in got}) == len(got)
    want, seen = set(), set()
    for start in sorted({a for a, _ in edges}):
        stack, met = [(start, (start,))], set()
        while stack:
            node, trail = stack.pop()
            for b in [y for x, y in edges if x == node]:
                if b == start:
                    if frozenset(trail) not in seen:
                        seen.add(frozenset(trail))
                        want.add((start, trail))
                elif b not in met:
                    met.add(b)
                    stack.append((b, (*trail, b)))
    assert got == want and len(want) > 5


def test_messages_name_a_few_of_many(spark):
    contracts = spark.createDataFrame([(f"d{i:03d}", "same") for i in range(200)] + [("x", "pair"), ("y", "pair"), ("z", None)], "doc_id string, contract_id string")
    found = {r.doc_id: r.message for r in references.contract_id_collisions(contracts, 3).collect()}
    assert len(found) == 202 and found["x"] == "id pair is also declared by y"
    assert found["d001"] == "id same is also declared by d000, d002, d003 and 196 more" and found["d150"] == "id same is also declared by d000, d001, d002 and 196 more"


def test_registries(spark):
    entry = '[[spec]]\nid = "a"\nname = "n"\nvendored_path = "p"\nsha256 = "s"\nfetched_at = "d"\n'
    texts = {"ok": f"schema_version = 1\n{entry}poll = {{endpoint = 'e'}}\n{entry}", "none": "schema_version = 1", "old": "schema_version = 2\n" + entry, "more": "schema_version = 1\n" + entry + "x = 1", "less": 'schema_version = 1\n[[spec]]\nid = "a"', "kind": "schema_version = 1\n" + entry.replace('"a"', "1"), "toml": "schema_version = 1\na =\n", "null": None}
    entries, found = read_registries(spark.createDataFrame(list(texts.items()), "doc_id string, text string"))
    assert [(r.doc_id, r.idx, r.poll is None) for r in entries.orderBy("idx").collect()] == [("ok", 0, False), ("ok", 1, True)]
    assert {(r.doc_id, r.code, r.line) for r in found.collect()} == {("old", "REG102", None), ("more", "REG101", None), ("less", "REG101", None), ("kind", "REG101", None), ("toml", "REG101", 2), ("null", "REG100", None)}


def test_places_are_asked_once_for_each_path():
    """Not once for each node: what is known of a collection's members is kept, and of no more than MOST of them."""

    class Counted(documents.Places):
        asked, MOST = 0, 50

        def __getitem__(self, path):
            self.asked += 1
            return super().__getitem__(path)

    places = Counted(r"/a/\*/(b|x~1y)", r"|/a|/a/\*|/names(/.*)?")
    value = {"a": [{"b": v, "c": 1, "x/y": [v]} for v in (None, True, 0, -1.5, 10**30, "s") * 100], "names": {f"n{k}": k for k in range(500)}}
    out = documents._Columns()
    assert list(out.chosen("d", {"a": value["a"]}, places)) == [] and places.asked == 6
    rows = out.batch().to_pylist()
    assert [r["sval"] for r in rows[:12:2]] == [v if isinstance(v, str) else json.dumps(v) for v in (None, True, 0, -1.5, 10**30, "s")]
    assert rows[3]["pointer"] == "/a/1/x~1y" and rows[3]["n_children"] == 1 and [r["seq"] for r in rows] == list(range(1200))
    assert list(out.chosen("d", value, places)) == [] and out.batch().to_pylist() == rows and sum(map(len, places.tables.values())) <= 50


def test_nodes_at_some_places_are_those_among_all(spark):
    texts = ['{"a": [{"id": 1, "x": [1, 2.5]}, {"id": "s"}], "fields": {"a/b": {"id": null}, "id": {"fields": {}}}, "id": {"z": true}}', "[1, [2]]", "{", "", "7", '{"~/": {"id": ""}, "e": {}}']
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    columns = [c for c in documents.to_nodes(docs).columns if c != "seq"]
    everything = documents.to_nodes(docs).orderBy("doc_id", "seq").collect()
    for kept, through in (("/id", ""), (".*/id", ".*"), (".*", ".*"), ("|/a/\\*/id|/fields/\\*", "|/a(/\\*)?|/fields"), ("/none", "")):
        got = documents.to_nodes(docs, documents.Places(kept, through)).orderBy("doc_id", "seq").select(*columns).collect()
        want = [r for r in everything if r.kind in ("error", "empty") or re.fullmatch(kept, r.rule_path)]
        assert [tuple(r) for r in got] == [tuple(r[c] for c in columns) for r in want]


def test_rows_of_documents_are_not_broadcast(spark):
    nodes = documents.to_nodes(spark.createDataFrame([("d", '{"a": 1}')], "doc_id string, text string"))
    rules = conformance.rule_table(spark, {"required": ["b"], "properties": {"a": {"oneOf": [{"type": "string"}, {"type": "array"}]}}})
    plans = [conformance.required_missing(nodes, rules), conformance.no_matching_alternative(nodes, rules)]
    for plan in (f._jdf.queryExecution().executedPlan().toString() for f in plans):
        assert "SortMergeJoin" in plan and not re.search(r"BroadcastHashJoin \[[^\]]*doc_id", plan)


def test_large_concepts_are_split_a_few_at_a_time():
    texts = [None, "", "x" * 600_000, "---\na: 1\n---\nb", "y" * 600_000, "z" * 3_000_000, "é" * 10, None]
    batch = pa.RecordBatch.from_arrays([pa.array(["b"] * 8), pa.array([f"{i}.md" for i in range(8)]), pa.array(texts, pa.string())], ["bundle", "path", "text"])
    out = list(bundle_files._split([batch, batch.slice(0, 0)]))
    assert [b.num_rows for b in out] == [4, 1, 1, 2, 0]
    assert [x for b in out for x in b.column(5).to_pylist()] == ["", "", texts[2], "b", *texts[4:7], ""]


def test_absent_sections_join_nothing(spark):
    nodes = documents.to_nodes(spark.createDataFrame([("a", '{"team": {}, "schema": [1], "servers": [2]}'), ("b", "[1]"), ("c", '{"schema": " ", "team": 0, "servers": false, "description": "x"}')], "doc_id string, text string"))
    found = hygiene.absent_sections(nodes, hygiene.Facts("3.1.0"), "odcs")
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.doc_id, r.code, r.pointer, r.seq) for r in found.collect()) == [("a", "ODCS203", "/team", 2), ("a", "ODCS204", "/description", 3), ("c", "ODCS201", "/schema", 0)]


def test_rows_are_dealt_before_they_become_texts(spark):
    for corpus in corpora.DEALT:
        docs = corpus(spark, "/root/testdata/sf0.001")
        assert docs.rdd.getNumPartitions() >= 3 * spark.sparkContext.defaultParallelism  # no shuffle of texts is needed


def test_index_files_are_read_without_the_texts_of_others(spark):
    name, fails = F.element_at(F.split("doc_id", "/"), -1), F.raise_error(F.lit("the text of a concept was made")).cast("string")
    docs = spark.createDataFrame([("b/index.md", "own"), ("b/c.md", ""), ("b/in/index.md", "inner"), ("d.md", "")], "doc_id string, text string")
    _, index = read_bundles(docs.select("doc_id", F.when(name == "index.md", F.col("text")).otherwise(fails).alias("text")))
    assert {tuple(r) for r in index.collect()} == {("b", "index.md", "own"), ("b", "in/index.md", "inner")}


def test_bundles_hold_the_documents_words(spark, tmp_path):
    texts = [None, "", " \n", "a", "..a-b  c9!", "é x ö", "_A_\u0000b", "\U0001f600z", "1,000.5\r\n"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    docs = corpora.bundles(spark, str(tmp_path))
    got = {r.doc_id: [line for line in r.text.split("\n") if line.startswith("> ")] for r in docs.where("doc_id not like '%index.md'").collect()}
    words = [re.sub("[^A-Za-z0-9]+", " ", t or "").strip(" ") for t in texts]
    assert got == {f"b0/n/{k}.md": [f"> {w}"] if w else [] for k, w in enumerate(words)}
    assert "regexp_replace" not in docs._jdf.queryExecution().optimizedPlan().toString()  # slower than finding the words
