"""Order of merged findings, runs that are whole or not seen, verdicts that are kept, names of large groups."""

import random

import pytest
from pyspark.sql import functions as F

from corpusward.functions.order import positions
from corpusward.functions.severity import findings
from corpusward.operators import references, registry, report
from corpusward.sources import findings as files


def report_of(spark, rows):
    frame = spark.createDataFrame(rows, "doc_id string, severity string, code string, seq long")
    parts = [findings(frame.where(F.col("severity") == s), spec_id="odcs", severity=s, code=F.col("code"), message="m", seq=F.col("seq")) for s in ("info", "warning", "error")]
    return report.merge_reports(*parts)


def test_merged_findings_keep_their_order_and_sort_stably(spark):
    rng = random.Random(2)
    reports = [[(rng.choice(["a", "b", None]), rng.choice(["info", "warning", "error"]), f"C{rng.randrange(3)}", rng.randrange(9)) for _ in range(n)] for n in (40, 0, 25, 1)]
    merged = report.merge_in_order(*(report_of(spark, r).repartition(5) for r in reports))
    key = lambda r: (r[0] is not None, r[0] or "", r[3], ("info", "warning", "error").index(r[1]), r[2])
    level = {"info": 0, "warning": 1, "error": 2}
    want = [row for r in reports for row in sorted(r, key=lambda r: (r[0] is not None, r[0] or "", r[3], r[1], level[r[1]], r[2]))]
    got = merged.orderBy("position").collect()
    assert [r.position for r in got] == list(range(66)) and [(r.doc_id, r.severity, r.code, r.seq) for r in got] == want
    ranked = report.sort_by_severity(merged).orderBy("rank").collect()
    assert [(r.doc_id, r.severity, r.code, r.seq) for r in ranked] == sorted(want, key=lambda r: -level[r[1]]) and key(want[0])


def test_positions_over_many_partitions(spark):
    values = [random.Random(1).randrange(50) for _ in range(500)]
    rows = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "v long, i long").repartition(13)
    got = sorted((r.position, r.v, r.i) for r in positions(rows, [F.col("v").desc(), F.col("i")]).collect())
    assert got == [(p, v, i) for p, (v, i) in enumerate(sorted(((v, i) for i, v in enumerate(values)), key=lambda x: (-x[0], x[1])))]
    assert positions(rows.limit(0), [F.col("v")]).count() == 0


def test_a_run_is_seen_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    found = report_of(spark, [("a", "error", "C", 1), ("b", "info", "D", 2)])
    docs = spark.createDataFrame([("a",), ("b",), ("c",)], "doc_id string")
    assert files.read_runs(spark, str(tmp_path), "run").collect() == [] and files.published_runs(spark, str(tmp_path)) == []
    files.publish_run(docs, found, str(tmp_path), run="one")
    real = report.diagnostic_json
    monkeypatch.setattr(files, "diagnostic_json", lambda f: 1 / 0)
    with pytest.raises(ZeroDivisionError):  # after two of the three tables
        files.publish_run(docs, found, str(tmp_path), run="two")
    assert (tmp_path / "runs/two/documents").exists() and files.published_runs(spark, str(tmp_path)) == ["one"]
    assert {r.run for part in files.PARTS for r in files.read_runs(spark, str(tmp_path), part).collect()} == {"one"}
    monkeypatch.setattr(files, "diagnostic_json", real)
    third = files.publish_run(docs, found, str(tmp_path))
    assert files.read_runs(spark, str(tmp_path), "documents").groupBy("run").count().count() == 2 and third in files.published_runs(spark, str(tmp_path))
    for bad in ("../x", "", "a/b", ".hidden"):
        with pytest.raises(ValueError):
            files.publish_run(docs, found, str(tmp_path), run=bad or " ")
    with pytest.raises(Exception, match="already exists"):
        files.publish_run(docs, found, str(tmp_path), run="one")
    with pytest.raises(ValueError):
        files.read_runs(spark, str(tmp_path), "nothing")


def test_only_changed_texts_are_validated_again(spark, tmp_path):
    asked = []

    def validate(docs):
        asked.append(sorted(r.text for r in docs.collect()))
        return findings(docs.where("text like 'bad%'"), spec_id="odcs", severity="error", code="C", message="m")

    docs = lambda *rows: spark.createDataFrame(list(rows), "doc_id string, text string")
    verdicts = lambda d, rules="r1": {r.doc_id: (r.verdict, r.validated) for r in registry.own_verdicts(d, validate, rules, f"{tmp_path}/v").collect()}
    assert verdicts(docs(("a", "good"), ("b", "bad"), ("c", "good"), ("d", None))) == {"a": ("ok", True), "b": ("err", True), "c": ("ok", True), "d": ("ok", True)}
    assert verdicts(docs(("a", "good"), ("b", "bad 2"), ("e", "bad"))) == {"a": ("ok", False), "b": ("err", True), "e": ("err", False)}
    assert verdicts(docs(("a", "good"))) == {"a": ("ok", False)} and verdicts(docs(("a", "good")), "r2") == {"a": ("ok", True)}
    assert asked == [["", "bad", "good"], ["bad 2"], [], ["good"]]
    assert verdicts(docs(("a", "x")).limit(0)) == {}


def test_a_popular_contract_is_named_by_ten_documents(spark):
    contracts = spark.createDataFrame([(f"d{i:03d}", "c1") for i in range(300)] + [("d1", "c2"), ("d1", "c2")], "doc_id string, contract_id string")
    refs = spark.createDataFrame([(f"p{i}", "/x", "contractId", "c1", i) for i in range(300)] + [("q", "/x", "contractId", "c2", 1)], "doc_id string, pointer string, key string, contract_id string, seq long")
    resolved = references.resolve_contracts(refs, contracts)
    rows = references.contract_findings(resolved).collect()
    assert len(rows) == 301 and max(len(r.message) for r in rows) < 120
    assert {r.message for r in rows if r.doc_id == "p0"} == {"c1 is declared by " + ", ".join(f"d{i:03d}" for i in range(10)) + " and 290 more"}
    assert {r.message for r in rows if r.doc_id == "q"} == {"c2 is declared by d1"}
    assert references.declarations(contracts).count() == 301


def test_a_popular_contract_is_resolved_to_every_document(spark):
    contracts = spark.createDataFrame([(f"d{i:03d}", "c1") for i in range(300)] + [("d000", "c1")], "doc_id string, contract_id string")
    refs = spark.createDataFrame([("p", "/x", "contractId", "c1", 1)], "doc_id string, pointer string, key string, contract_id string, seq long")
    row = references.resolve_contracts(refs, contracts).first()
    assert row.target == [f"d{i:03d}" for i in range(300)] and row.declaring == 300
