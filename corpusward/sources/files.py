"""Files of a corpus: found by walking folders, opened and read in pieces by the tasks.

Nothing is opened but what is wanted, a file that cannot be read is a row with a problem
and stops no other, and no file has to fit one row to be hashed.  Paths may be of any
file system that pyarrow opens (local and mounted folders, hdfs, s3, gs, abfs).
"""

from __future__ import annotations

import codecs
import hashlib
import re
import uuid
from collections.abc import Iterator
from functools import cache, reduce

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusward.functions.lineage import stored

#: Bytes that are read at once, and of the longest file that is read as a text.
PIECE, MOST_TEXT = 8 << 20, 512 << 20
#: Entries that a task lists below one folder before it hands the rest on to others.
LISTED = 20_000
#: Bytes of texts in one batch.
BATCH = 16 << 20
#: Extensions of documents, the file that makes a folder a bundle, folders that are passed over.
EXTENSIONS, BUNDLE, PASSED = (".yaml", ".yml", ".json"), "index.md", ("target",)
_FOUND = "path string, kind string, bytes long, problem string"


@cache
def _system(root: str) -> fs.FileSystem:
    return fs.FileSystem.from_uri(root)[0]


def _place(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of ``path``, and its path there."""
    path = re.sub(r"^file:/*", "/", path)
    if m := re.match(r"([a-z][a-z0-9+.-]*)://([^/]*)", path):
        inner = path[m.end() :]
        return _system(m[0] + "/"), f"{m[2]}{inner}" if m[1] in ("s3", "gs", "gcs", "abfs", "abfss") else inner
    return _system("file:///"), path


def _reason(e: OSError) -> str:
    return re.sub(r"\s+", " ", str(e.strerror or e)).split(" Detail:")[0][:200]


def pieces(path: str) -> Iterator[bytes]:
    """The bytes of a file, PIECE at a time; raises OSError."""
    system, inner = _place(path)
    if system.get_file_info(inner).type == fs.FileType.Directory:
        raise IsADirectoryError(21, "is a folder")
    with system.open_input_stream(inner) as f:
        while data := f.read(PIECE):
            yield bytes(data)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    names, types = zip(*(c.split() for c in schema.split(", ")), strict=True)
    columns = zip(*rows, strict=True) if rows else ([] for _ in names)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(columns, types, strict=True)], list(names))


def _listed(path: str, kind: str) -> Iterator[tuple]:
    """Rows of _FOUND below a given path or a folder; kind ``folder`` is still to be listed."""
    system, inner = _place(path)
    shown = lambda x: path + x.path[len(inner) :]
    if kind == "given":
        try:
            info = system.get_file_info(inner)
        except OSError as e:
            yield path, "problem", None, _reason(e)
            return
        if info.type == fs.FileType.NotFound:
            yield path, "problem", None, "no such file or folder"
            return
        if info.type == fs.FileType.File:
            yield path, "document", info.size, None
            return
    todo, seen = [inner], 0
    while todo:
        folder = todo.pop()
        try:
            entries = system.get_file_info(fs.FileSelector(folder))
        except OSError as e:
            yield path + folder[len(inner) :], "problem", None, _reason(e)
            continue
        seen += len(entries)
        if any(x.base_name == BUNDLE and x.type == fs.FileType.File for x in entries):
            yield path + folder[len(inner) :], "bundle", None, None
            continue
        for x in entries:
            if x.base_name.startswith(".") or x.base_name in PASSED:
                continue
            if x.type == fs.FileType.Directory:
                if seen < LISTED:
                    todo.append(x.path)
                else:
                    yield shown(x), "folder", None, None
            elif x.base_name.lower().endswith(EXTENSIONS):
                yield shown(x), "document", x.size, None


def find_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, kind (document, bundle, problem), bytes and problem of what lies under ``paths``.

    Names that start with a dot and ``target`` folders are passed over, and what lies
    below a folder with an ``index.md`` is not listed.  A path to one file is a document
    whatever its name; one to nothing is a problem, as is a folder that cannot be listed.
    A task lists a folder with what is below it; folders beyond LISTED entries are
    dealt over tasks in the next round.
    """

    def task(batches):
        for batch in batches:
            for path, kind in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = []
                for row in _listed(path, kind):
                    rows.append(row)
                    if len(rows) >= 10_000:
                        yield _batch(rows, _FOUND)
                        rows = []
                yield _batch(rows, _FOUND)

    given = [re.sub(r"^file:/*", "/", p).rstrip("/") or "/" for p in dict.fromkeys(paths)]
    open_ = spark.createDataFrame([(p, "given") for p in given], "path string, kind string")
    rounds = []
    while True:
        found = stored(open_.repartition("path").mapInArrow(task, _FOUND))
        rounds.append(found.where("kind <> 'folder'"))
        open_ = found.where("kind = 'folder'").select("path", "kind")
        if open_.isEmpty():
            return reduce(DataFrame.unionByName, rounds).dropDuplicates(["path", "kind"])


_TEXTS = "doc_id string, text string, bytes long, problem string"


def _text(path: str, size: int | None) -> tuple[str | None, int | None, str | None]:
    if size is not None and size > MOST_TEXT:
        return None, size, f"longer than {MOST_TEXT} bytes"
    decoder, parts, n, held = codecs.getincrementaldecoder("utf-8")(), [], 0, 0
    try:
        for piece in pieces(path):
            held = len(decoder.getstate()[0])
            parts.append(decoder.decode(piece))
            n += len(piece)
        held = len(decoder.getstate()[0])
        decoder.decode(b"", True)
    except UnicodeDecodeError as e:
        return None, size, f"not UTF-8 at byte {n - held + e.start}"
    except OSError as e:
        return None, size, _reason(e)
    return "".join(parts), n, None


def read_files(found: DataFrame) -> DataFrame:
    """doc_id (path), text, bytes and problem of ``find_files``' documents and problems.

    A file that cannot be opened or that is not UTF-8 has a null text and a problem, as have
    those of more than MOST_TEXT bytes.  Files are dealt over tasks, which hold BATCH bytes and
    one file.
    """

    def task(batches):
        for batch in batches:
            rows, size = [], 0
            for path, kind, n, problem in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                rows.append((path, None, n, problem) if kind == "problem" else (path, *_text(path, n)))
                size += len(rows[-1][1] or "")
                if size > BATCH:
                    yield _batch(rows, _TEXTS)
                    rows, size = [], 0
            yield _batch(rows, _TEXTS)

    return _dealt(found.where("kind <> 'bundle'").select("path", "kind", "bytes", "problem")).mapInArrow(task, _TEXTS)


def _dealt(files: DataFrame) -> DataFrame:
    spark = files.sparkSession
    return files.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism), "path")


_DIGESTS = "path string, bytes long, actual string, there boolean"


def file_digests(paths: DataFrame, root: str = "") -> DataFrame:
    """path, bytes, actual (SHA-256; null: unreadable) and there of each distinct ``path``, under ``root`` where it is relative.

    Files are hashed PIECE bytes at a time, whatever their size.
    """

    def one(path: str) -> tuple[int | None, str | None, bool]:
        place = path if path.startswith("/") or "://" in path else f"{root.rstrip('/')}/{path}"
        hashed, n = hashlib.sha256(), 0
        try:
            system, inner = _place(place)
            if system.get_file_info(inner).type == fs.FileType.NotFound:
                return None, None, False
            for piece in pieces(place):
                hashed.update(piece)
                n += len(piece)
        except FileNotFoundError:
            return None, None, False
        except (OSError, ValueError):  # a path that no file can have
            return None, None, True
        return n, hashed.hexdigest(), True

    def task(batches):
        for batch in batches:
            rows = [(p, *one(p)) for p in batch.column(0).to_pylist()]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.bool_()), strict=True)], ["path", "bytes", "actual", "there"])

    return _dealt(paths.select("path").where("path is not null").distinct()).mapInArrow(task, _DIGESTS)


def write_files(rows: DataFrame, folder: str) -> DataFrame:
    """Writes ``content`` (binary) of each row to ``folder``/``path``; returns path and bytes, one row for each file.

    A file appears whole or not at all, and a task that runs again writes the same files.
    Paths must be distinct and stay below ``folder``.
    """

    def task(batches):
        for batch in batches:
            out = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if path.startswith("/") or ".." in path.split("/"):
                    raise ValueError(f"a path that leaves its folder: {path}")
                system, inner = _place(f"{folder}/{path}")
                system.create_dir(inner.rpartition("/")[0], recursive=True)
                part = f"{inner.rpartition('/')[0]}/.{uuid.uuid4().hex}"
                with system.open_output_stream(part) as f:
                    f.write(content)
                system.move(part, inner)
                out.append((path, len(content)))
            yield _batch(out, "path string, bytes long")

    return stored(rows.select("path", "content").mapInArrow(task, "path string, bytes long"))
