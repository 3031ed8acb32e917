"""Typed models from chosen nodes, against plain Python."""

import json

import pytest
from test_queries import FOLDER
from test_queries import test_query_equals_its_sql as equals_its_sql

from corpusward.jobs import catalog
from corpusward.operators import models
from corpusward.sources import documents

ODD = [
    {"id": "a", "status": 1, "version": None, "name": "n", "extra": {"x": 1}, "id\n": "no id", "a/b~c": "e", "*": [1], "": True, "schema": [{"name": "t", "properties": [{"name": "p"}, {"name": 1}, 3]}, {"properties": {"*": {}, "k": {}}}, []]},
    {"schema": {"*": {"name": "s", "properties": []}, "k": {"name": "no"}}, "domain": "d", "tags": [1]},
    [{"name": "x"}],
    {},
    {"schema": [{"name": "b"}, {"name": "a"}], "unknown": 1.50, "servers": {"s": {"name": "t"}}},
]


def docs_of(spark, values):
    texts = [(str(i), json.dumps(v)) for i, v in enumerate(values)] + [("bad", "{"), ("none", "")]
    return spark.createDataFrame(texts, "doc_id string, text string")


def test_catalogue_of_chosen_nodes_is_that_of_all(spark):
    docs = docs_of(spark, ODD)
    rows = lambda places: sorted(map(repr, models.contract_catalogue(documents.parsed(documents.to_nodes(docs, places))).collect()))
    assert rows(catalog.CATALOGUE) == rows(None) and len(rows(None)) == len(ODD)


def test_catalogue_asks_for_few_nodes(spark):
    """Of a contract's nodes, at most a row for each property and eight others."""
    nodes = catalog._contract_nodes(spark, "/root/testdata/sf0.001", catalog.CATALOGUE)
    assert nodes.where("not rule_path like '/schema/*/properties%'").groupBy("doc_id").count().agg({"count": "max"}).first()[0] <= 8
    assert nodes.where("rule_path like '%/name' and depth > 3").isEmpty()


PROPERTIES = [
    {"schema": [{"name": "t", "properties": [{"name": "a/b", "properties": [{"name": "c~"}, {"items": {"name": "gone", "properties": [{"name": "d"}], "items": {"items": 1}}}]}, {"name": ["x"]}, 7, {"name": "items", "items": [{"name": "no"}]}]}, {"properties": [{"name": ""}]}, {"name": "e", "items": {"name": "y"}}]},
    {"schema": {"*": {"name": "s", "properties": {"*": {"name": "p", "properties": None}, "k": {"name": "no"}}}, "k": {"properties": [{"name": "no"}]}}},
    {"properties": [{"name": "no"}], "schema": []},
    [1],
]


def properties_of(value):
    """(pointer, path, is_object, is_array) of each property, by recursion."""

    def members(v, pointer):
        both = enumerate(v) if isinstance(v, list) else v.items() if isinstance(v, dict) else ()
        return [(f"{pointer}/{k}", x) for k, x in both if (isinstance(v, list) or k == "*") and isinstance(x, dict)]

    def name(v):
        return v["name"] if isinstance(v.get("name"), str) else "?"

    def below(v, pointer, path):
        inner = [(p, x, f"{path}.{name(x)}") for p, x in members(v.get("properties"), f"{pointer}/properties")]
        inner += [(f"{pointer}/items", v["items"], f"{path}.[]")] if isinstance(v.get("items"), dict) else []
        for p, x, called in inner:
            yield p, called, "properties" in x, "items" in x
            yield from below(x, p, called)

    schema = value.get("schema") if isinstance(value, dict) else None
    return [r for p, x in members(schema, "/schema") for r in below(x, p, name(x))]


def test_properties_are_flattened_as_by_recursion(spark):
    nodes = documents.to_nodes(docs_of(spark, PROPERTIES), models.PROPERTIES)
    got = [(int(r.doc_id), r.pointer, r.path, r.is_object, r.is_array) for r in models.flatten_properties(nodes).collect()]
    assert sorted(got) == sorted((i, *r) for i, v in enumerate(PROPERTIES) for r in properties_of(v)) and len(got) == 11


@pytest.mark.parametrize("name", ["m1_contract_catalogue", "m2_flatten_properties"])
def test_models_equal_their_sql(spark, name):
    equals_its_sql(spark, name)


def test_properties_are_flattened_without_a_shuffle(spark):
    plan = catalog.queries()["m2_flatten_properties"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
