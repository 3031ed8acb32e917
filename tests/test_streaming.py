"""Findings of a stream equal those of the same documents as a table."""

import json

from corpusward.operators.hygiene import Facts
from corpusward.streaming.audit import audit_stream, document_audit


def test_stream_equals_table(spark, tmp_path):
    texts = [(f"d{i}", "a: [" if i == 3 else json.dumps({"apiVersion": "v1" if i % 2 else "v3.1.0", "servers": []})) for i in range(12)]
    docs = spark.createDataFrame(texts, "doc_id string, text string")
    docs.repartition(4).write.parquet(f"{tmp_path}/in")
    audit = document_audit(Facts("3.1.0"), "odcs")
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/in")
    audit_stream(stream, audit, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination(120)
    key = ("doc_id", "code", "pointer")
    got = spark.read.parquet(f"{tmp_path}/out")
    assert got.select("epoch").distinct().count() >= 2
    assert sorted(map(tuple, got.select(*key).collect())) == sorted(map(tuple, audit(docs).select(*key).collect()))
