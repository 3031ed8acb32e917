"""Registered queries against their SQL on the smallest tables."""

import os

import duckdb
import pytest

from corpusward.jobs import catalog

FOLDER = "/root/testdata/sf0.001"
SOME = ["r2_severity_counts", "r7_run_envelope", "h2_absent_sections", "h4_duplicate_stable_ids", "v_schema_findings", "x4_incomplete_corpus", "x5_contract_id_collisions", "p1_registry_field_rules", "p5_verify_digests", "k12_link_targets", "k16_circular_derivation", "l1_heading_structure", "m3_primary_keys", "e2_windowed_measures", "e4_check_constraints"]


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the tables are not here")
@pytest.mark.parametrize("name", SOME)
def test_query_equals_its_sql(spark, name):
    db = duckdb.connect()
    for file in os.listdir(FOLDER):
        db.sql(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{file}'")
    want = db.sql(catalog.oracle_sql()[name])
    columns = sorted(want.columns)
    got = catalog.queries()[name](spark, FOLDER)
    assert sorted(got.columns) == columns
    assert sorted(map(repr, (tuple(r) for r in got.select(*columns).collect()))) == sorted(map(repr, want.select(*columns).fetchall()))


def test_every_query_has_sql():
    assert set(catalog.oracle_sql()) == set(catalog.queries())
    assert catalog.FLAGSHIP in catalog.queries()


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the tables are not here")
@pytest.mark.parametrize("name", ["t1_pointer_escape_whole", "t2_neutralise_whole_for_terminal", "t3_neutralise_whole_for_html"])
def test_text_queries_take_whole_texts(spark, name):
    test_query_equals_its_sql(spark, name)


def test_hostile_characters_are_found_after_any_prefix(spark, tmp_path):
    turn = "a" * 500 + "‮/~\n\U0001f600<" + "b" * 500
    spark.createDataFrame([(3, 0, turn)], "conv_id long, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    spark.createDataFrame([(1, turn)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [catalog.queries()[name](spark, str(tmp_path)).first() for name in ("t1_pointer_escape_whole", "t2_neutralise_whole_for_terminal", "t3_neutralise_whole_for_html")]
    assert (got[0].escaped, got[0].round_trip) == ("~01~1" + turn.replace("~", "~0").replace("/", "~1"), True)
    assert got[1].shown == "<&>" + turn.replace("‮", "<U+202E>").replace("\n", "<U+000A>")
    assert got[2].shown == "&lt;&amp;&gt;" + turn.replace("<", "&lt;").replace("‮", "&lt;U+202E&gt;")
