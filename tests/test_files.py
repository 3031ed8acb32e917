"""Files that cannot be read are rows; unwanted ones are never opened; artefacts of any size are hashed."""

import hashlib
import socket

import pytest
from pyspark.sql import functions as F

from corpusward.operators import registry
from corpusward.schemas import REGISTRY
from corpusward.sources import documents, files


def put(root, **contents):
    for name, data in contents.items():
        path = root / name.replace("__", "/")
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)


def names(rows, root):
    return {r.doc_id.replace(str(root), "", 1).lstrip("/"): r for r in rows}


def test_bad_bytes_and_odd_files_are_problems(spark, tmp_path):
    put(tmp_path, **{"good.yaml": b"a: \xc3\xa9", "bad.yaml": b"abc\xff", "cut.json": b"{}\xe2\x82", "empty.yml": b"", "_under.json": b"1", "x.txt": b"no"})
    plug = socket.socket(socket.AF_UNIX)
    plug.bind(str(tmp_path / "s.yaml"))
    read = documents.read_documents(spark, [str(tmp_path), f"{tmp_path}/none", f"{tmp_path}/x.txt"]).collect()
    plug.close()
    rows = names(read, tmp_path)
    assert {k: r.text for k, r in rows.items() if r.problem is None} == {"good.yaml": "a: é", "empty.yml": "", "_under.json": "1", "x.txt": "no"}
    assert rows["bad.yaml"].problem == "not UTF-8 at byte 3" and rows["cut.json"].problem == "not UTF-8 at byte 2"
    assert rows["none"].problem == "no such file or folder" and rows["s.yaml"].problem
    found = documents.path_problems(spark.createDataFrame(read)).collect()
    assert {r.code for r in found} == {"CLI001"} and len(found) == 4


def test_a_character_across_two_pieces(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "PIECE", 3)
    put(tmp_path, **{"a": "aé€𐍈b".encode() * 5, "b": "€€".encode() + b"\xff", "c": b"ab\xe2\x82"})
    assert files._text(f"{tmp_path}/a", None)[0] == "aé€𐍈b" * 5
    assert files._text(f"{tmp_path}/b", None)[2] == "not UTF-8 at byte 6" and files._text(f"{tmp_path}/c", None)[2] == "not UTF-8 at byte 2"
    monkeypatch.setattr(files, "MOST_TEXT", 4)
    assert files._text(f"{tmp_path}/a", 55)[2] == "longer than 4 bytes"


def test_unwanted_files_are_never_opened(spark, tmp_path):
    put(tmp_path, **{"a.yaml": b"1", "target__b.yaml": b"1", ".git__c.yaml": b"1", "kb__index.md": b"1", "kb__deep__d.yaml": b"1", "e.bin": b"1"})
    found = files.find_files(spark, [str(tmp_path)]).collect()
    assert {(r.path[len(str(tmp_path)) :], r.kind) for r in found} == {("/a.yaml", "document"), ("/kb", "bundle")}


def test_folders_are_dealt_over_rounds(spark, tmp_path):
    # more entries than a task lists: what is left is another round's
    put(tmp_path, **{f"d{i}__e{j}__f.yaml": b"1" for i in range(4) for j in range(3)})
    whole = {r.path for r in files.find_files(spark, [str(tmp_path)]).collect()}
    rows = list(files._listed(str(tmp_path), "given"))
    assert {r[0] for r in rows} == whole and len(whole) == 12
    old, files.LISTED = files.LISTED, 2
    try:
        todo, seen, folders = [(str(tmp_path), "given")], set(), 0
        while todo:
            for path, kind, *_ in files._listed(*todo.pop()):
                todo += [(path, kind)] if kind == "folder" else []
                folders += kind == "folder"
                seen |= {path} if kind == "document" else set()
    finally:
        files.LISTED = old
    assert seen == whole and folders > 4


def entries(spark, *rows):
    blank = [None] * len(spark.createDataFrame([], REGISTRY).columns)
    at = {c: i for i, c in enumerate(spark.createDataFrame([], REGISTRY).columns)}
    out = []
    for i, (path, digest) in enumerate(rows):
        row = list(blank)
        row[at["id"]], row[at["idx"]], row[at["vendored_path"]], row[at["sha256"]] = f"e{i}", i, path, digest
        out.append(tuple(row))
    return spark.createDataFrame(out, REGISTRY)


def test_artefacts_are_hashed_as_they_are_read(spark, tmp_path):
    big = tmp_path / "big.bin"
    with open(big, "wb") as f:
        f.truncate((2 << 30) + 5)  # more than one row can hold
    put(tmp_path, **{"a": b"abc", "folder__b": b""})
    zeros, left = hashlib.sha256(), (2 << 30) + 5
    while left:
        zeros.update(bytes(n := min(left, 1 << 24)))
        left -= n
    table = entries(spark, ("big.bin", zeros.hexdigest()), ("a", f" {hashlib.sha256(b'abc').hexdigest()} "), ("a", "0" * 64), ("gone", None), ("folder", None), (None, None), (f"{tmp_path}/folder/b", hashlib.sha256(b"").hexdigest()), ("nul\0l", None))
    got = {r.idx: r for r in registry.verify_files(table, str(tmp_path)).collect()}
    assert [got[i].status for i in range(8)] == ["matched", "matched", "drifted", "missing", "unreadable", "missing", "matched", "unreadable"]
    assert got[0].bytes == (2 << 30) + 5
    codes = {r.doc_id: r.code for r in registry.digest_findings(registry.verify_files(table, str(tmp_path))).collect()}
    assert codes["e0"] == "REG023" and codes["e4"] == "REG021" and codes["e3"] == "REG020" and codes["e2"] == "REG022"


def test_written_files_stay_in_their_folder(spark, tmp_path):
    rows = spark.createDataFrame([("x/y.json", bytearray(b"1"))], "path string, content binary")
    assert files.write_files(rows, str(tmp_path)).first().bytes == 1 and (tmp_path / "x/y.json").read_bytes() == b"1"
    with pytest.raises(Exception, match="leaves its folder"):
        files.write_files(rows.withColumn("path", F.lit("../y")), str(tmp_path)).count()
