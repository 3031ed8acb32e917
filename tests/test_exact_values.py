"""Enums, constants, equal members and bounds over exact JSON values, against Python; patterns that nothing reads."""

import json
import random
from fractions import Fraction

import pytest

from corpusward.operators import conformance
from corpusward.sources import documents


def nodes_of(spark, docs):
    return documents.to_nodes(spark.createDataFrame(list(docs.items()), "doc_id string, text string"))


def equal(a, b):
    """Equality of JSON values: numbers by value, true is not 1."""
    number = lambda x: isinstance(x, (int, float)) and not isinstance(x, bool)
    if number(a) and number(b):
        return Fraction(repr(a)) == Fraction(repr(b)) if "inf" not in repr(a) + repr(b) else a == b
    if type(a) is not type(b):
        return False
    if isinstance(a, dict):
        return a.keys() == b.keys() and all(equal(a[k], b[k]) for k in a)
    if isinstance(a, list):
        return len(a) == len(b) and all(map(equal, a, b))
    return a == b


SCALARS = [0, 1, 1.0, -0.0, True, False, None, "1", "", "a/b~c", 0.1, 1e16, 10**16, 10**16 + 1, 9007199254740993, 9007199254740992.0, 1e23, 10**23, 1.5e300, 10**320, -(10**320), 1e-7, "\u0000", [], {}]


def some(rng, depth=3):
    kind = rng.random()
    if depth == 0 or kind < 0.5:
        return rng.choice(SCALARS)
    if kind < 0.75:
        return [some(rng, depth - 1) for _ in range(rng.randrange(3))]
    return {k: some(rng, depth - 1) for k in rng.sample(["a", "b", "a/b", "~", "0", ""], rng.randrange(3))}


def shuffled(rng, v):
    if isinstance(v, dict):
        return {k: shuffled(rng, v[k]) for k in rng.sample(list(v), len(v))}
    return [shuffled(rng, x) for x in v] if isinstance(v, list) else v


def test_enums_of_any_values(spark):
    rng = random.Random(5)
    values = [some(rng) for _ in range(60)] + SCALARS
    allowed = [shuffled(rng, v) for v in rng.sample(values, 25)]
    docs = {str(i): json.dumps({"v": v}) for i, v in enumerate(values)}
    bad = conformance.value_not_permitted(nodes_of(spark, docs), conformance.rule_table(spark, {"properties": {"v": {"enum": allowed}}}))
    assert {int(r.doc_id) for r in bad.collect()} == {i for i, v in enumerate(values) if not any(equal(v, a) for a in allowed)}


def test_equal_members(spark):
    rng = random.Random(6)
    arrays = [[some(rng, 2) for _ in range(rng.randrange(1, 5))] for _ in range(40)]
    arrays += [[a, shuffled(rng, b)] for a in SCALARS for b in SCALARS] + [[{"a": [1, {}]}, {"a": [1, []]}], [{"x": 1, "y": 2}, {"y": 2.0, "x": 1.0}], [[[]], [{}]]]
    docs = {str(i): json.dumps({"deep": [{"v": v}]}) for i, v in enumerate(arrays)}
    rules = conformance.rule_table(spark, {"properties": {"deep": {"items": {"properties": {"v": {"uniqueItems": True}}}}}})
    bad = conformance.bad_cardinality(nodes_of(spark, docs), rules).collect()
    assert {int(r.doc_id) for r in bad} == {i for i, v in enumerate(arrays) if any(equal(v[j], v[k]) for j in range(len(v)) for k in range(j))}
    assert {r.pointer for r in bad} == {"/deep/0/v"}


@pytest.mark.parametrize("bound", [10, -3.5, 9007199254740993, 10**320, -(10**319), 0.1, 2**53 + 0.0])
def test_bounds(spark, bound):
    values = [0, 10, 11, 9, -3, -4, -3.5, 9007199254740992, 9007199254740993, 9007199254740994, 10**320, 10**320 + 1, 10**320 - 1, -(10**319), -(10**319) - 1, 0.1, 0.10000000000000002, 1e300, -1e300, int("9" * 330)]
    keys = {"minimum": lambda x, b: x < b, "maximum": lambda x, b: x > b, "exclusiveMinimum": lambda x, b: x <= b, "exclusiveMaximum": lambda x, b: x >= b}
    docs = {str(i): json.dumps(v) for i, v in enumerate(values)}
    exact = lambda x: Fraction(repr(x))
    found = conformance.out_of_range(nodes_of(spark, docs), conformance.rule_table(spark, dict.fromkeys(keys, bound))).collect()
    assert {(int(r.doc_id), r.message.split()[0]) for r in found} == {(i, k) for i, v in enumerate(values) for k, breaks in keys.items() if breaks(exact(v), exact(bound))}


def test_multiples_of_any_length(spark):
    values = [0, 7, -14, 15, 10**330 - 10**330 % 7, 10**330 - 10**330 % 7 + 1, 9007199254740993, 21.0, 7.5]
    docs = {str(i): json.dumps(v) for i, v in enumerate(values)}
    found = conformance.out_of_range(nodes_of(spark, docs), conformance.rule_table(spark, {"multipleOf": 7}))
    assert {int(r.doc_id) for r in found.collect()} == {i for i, v in enumerate(values) if Fraction(repr(v)) % 7}


def test_patterns_that_do_not_compile_are_reported(spark):
    schema = {"pattern": "[", "properties": {"a": {"pattern": "(?<=a+)b"}, "b": {"pattern": "^x$"}}, "patternProperties": {"(": {}, "^n": {"type": "string"}}}
    found = conformance.schema_findings(nodes_of(spark, {"d": '{"a": "b", "b": "y", "n1": 3}'}), conformance.rule_table(spark, schema), "cads").collect()
    assert sorted((r.code, r.pointer) for r in found if r.doc_id == "d") == [("CADS104", "/n1"), ("CADS105", "/b")]
    assert sorted(r.message for r in found if r.doc_id == "schema") == ["not checked: pattern that does not compile: (", "not checked: pattern that does not compile: (?<=a+)b", "not checked: pattern that does not compile: ["]


def test_many_patterns_do_not_multiply(spark):
    schema = {"patternProperties": {f"^p{i}": {"type": "string"} for i in range(30)}, "additionalProperties": {"type": "integer"}}
    assert len(conformance.flatten_schema(schema)) < 100
    found = conformance.schema_findings(nodes_of(spark, {"d": '{"p1": 3, "other": "x"}'}), conformance.rule_table(spark, schema), "cads").collect()
    assert sorted((r.doc_id, r.code, r.pointer) for r in found) == [("d", "CADS104", "/other"), ("schema", "CADS100", "")]
