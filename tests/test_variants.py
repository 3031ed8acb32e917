"""Nodes from VARIANT are those of the parser, and no Python runs for them."""

import json
import random

from corpusward.sources import documents, variants

COLUMNS = ["doc_id", "pointer", "parent", "key", "idx", "depth", "kind", "sval", "nval", "n_children", "rule_path"]


def rows_of(nodes):
    return sorted((tuple(r) for r in nodes.select(*COLUMNS).collect()), key=repr)


def compare(spark, texts):
    docs = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "doc_id string, text string")
    nodes, rest = variants.json_nodes(docs)
    left = {int(r.doc_id) for r in rest.collect()}
    want = documents.to_nodes(docs)
    assert rows_of(variants.nodes_of(docs)) == rows_of(want)
    assert rows_of(nodes) == rows_of(want.where(~want.doc_id.isin([str(i) for i in left])))
    return left


HARD = [
    '{"a":1} x', '{"a":1} {"b":2}', '{"a":1}] [}', '{"a":1}, "b":2', '{"a":1},"\x7fend\x7f":0} junk', '{"a":1}}', "[1,2", '{"a":1,"a":2}', '{"a":NaN}', '"x"', "3", "", None, "a: 1", '{"a":"\\ud800"}', '{"a":"\t"}', "{'a':1}",
    '{"a":1} // c', '{"big":1e400}', '{"a":1e3}', '{"a":0.00001}', '{"a":-0.0}', '{"a":[-0]}', '{"a":12345678901234567890}', '{"a":0.1234567890123456789}', '{"a":1.00000000000000000}', "{}{}", "{a: 1}", "[1] [2]", "﻿{}",
]
PLAIN = [
    '{"a":1}', "[]", "{}", '[1]\n  ', ' \n{"a": {"b": [1, {"c": null}]}}', '{"a/b~c": {"": [[], {}]}}', '{"a":1.0,"b":1.50,"c":-2.25,"d":0.0,"e":123456789012345,"f":9223372036854775807,"g":-9223372036854775808}', '{"t":true,"f":false,"n":null,"s":"","u":"x\\u00e9\\n","e":"\U0001f600"}',
    json.dumps({"models": {"fields": {"fields": {"items": {"items": {"type": "x"}}}}}, "servers": [{"id": 1}], "definitions": {"servers": {"a": {"fields": {"b": 1}}}}}), '{"a": "-0, 1e5 }"}',
]


def test_hard_and_plain_texts(spark):
    left = compare(spark, HARD + PLAIN)
    assert left >= {i for i, t in enumerate(HARD) if t != '{"a":1.00000000000000000}'}
    # a string that looks like a number costs a detour, nothing else
    assert left - set(range(len(HARD))) <= {len(HARD) + len(PLAIN) - 1}


def test_random_documents(spark):
    rng = random.Random(4)

    def value(depth):
        if depth == 0 or rng.random() < 0.4:
            return rng.choice([0, 1, -7, 2**53 + 1, 1.5, 0.25, 1000000.0, True, None, "", "a", "é/~", [], {}])
        if rng.random() < 0.5:
            return [value(depth - 1) for _ in range(rng.randrange(4))]
        return {rng.choice(["a", "b", "fields", "models", "servers", "x/y", "~0", ""]): value(depth - 1) for _ in range(rng.randrange(4))}

    texts = [json.dumps({"v": value(5)}) for _ in range(80)]
    assert len(compare(spark, texts + texts[:5])) == 0


def test_no_python_runs_for_json(spark):
    nodes, _ = variants.json_nodes(spark.createDataFrame([("1", '{"a": [1, {"b": 2.5}]}')], "doc_id string, text string"))
    plan = nodes._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "MapInArrow", "MapInPandas", "ArrowEval")) and nodes.count() == 5


def test_no_documents(spark):
    nodes, rest = variants.json_nodes(spark.createDataFrame([], "doc_id string, text string"))
    assert nodes.count() == 0 and rest.count() == 0 and nodes.columns == documents.to_nodes(rest).columns
