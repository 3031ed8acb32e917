"""Nodes that say what is in them, so that nothing below has to be a row."""

import json
import random

import pytest
from pyspark.sql import functions as F
from test_exact_values import SCALARS, equal, shuffled, some
from test_queries import test_query_equals_its_sql as equals_its_sql

from corpusward.functions.values import n_distinct
from corpusward.jobs import catalog
from corpusward.operators import conformance
from corpusward.sources import documents


def nested(value, depth: int):
    for _ in range(depth):
        value = [value]
    return value


def test_distinct_members_of_any_values(spark):
    rng = random.Random(7)
    arrays = [[some(rng, 2) for _ in range(rng.randrange(1, 5))] for _ in range(200)]
    arrays += [[a, shuffled(rng, b)] for a in SCALARS for b in SCALARS] + [[{"a": [1, {}]}, {"a": [1, []]}], [{"x": 1, "y": 2}, {"y": 2.0, "x": 1.0}], [[[]], [{}]], [], ["1.0", 1.0, "1", 1], [10**23, 1e23], [-0.0, 0]]
    assert [n_distinct(v) for v in arrays] == [sum(not any(equal(x, y) for y in v[:i]) for i, x in enumerate(v)) for v in arrays]
    docs = spark.createDataFrame([(str(i), json.dumps({"deep": [{"v": v}], "o": v and v[0]})) for i, v in enumerate(arrays)] + [("bad", "{"), ("none", "")], "doc_id string, text string")
    nodes = documents.to_nodes(docs, documents.Places(r"/deep/\*/v|/o", r"|/deep|/deep/\*", ("n_distinct",)))
    assert {r.doc_id for r in nodes.where("(kind = 'array') <> (n_distinct is not null)").collect()} == set() and nodes.where("kind in ('error', 'empty')").count() == 2
    rules = conformance.rule_table(spark, {"properties": {"deep": {"items": {"properties": {"v": {"uniqueItems": True, "minItems": 1}}}}}})
    bad = conformance.bad_cardinality(nodes, rules)
    assert sorted(map(repr, bad.drop("seq").collect())) == sorted(map(repr, conformance.bad_cardinality(documents.to_nodes(docs), rules).drop("seq").collect()))


@pytest.mark.parametrize("depth", [10, 900, 3_000])
def test_distinct_members_that_nest_deep(depth):
    assert n_distinct([nested(1, depth), nested(1.0, depth), nested(2, depth), nested(1, depth - 1)]) == 3


def test_equal_members_are_found_where_arrays_are_read(spark):
    """One row for each array of lines: members are no rows, and only rules are joined after the parsing."""
    equals_its_sql(spark, "v7_equal_members")
    found = catalog.queries()["v7_equal_members"](spark, "/root/testdata/sf0.001")
    assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()
    nodes, _ = catalog._exact(spark, "/root/testdata/sf0.001", "lines", documents.Places("/lines", "", ("n_distinct",)))
    assert nodes.agg(F.count_distinct("rule_path")).first()[0] == 1 and nodes.count() == spark.read.parquet("/root/testdata/sf0.001/orders.parquet").count()
