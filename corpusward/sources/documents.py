"""Documents: discovery, parsing into nodes, routing to a standard."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusward.functions.severity import findings
from corpusward.functions.values import n_distinct
from corpusward.operators.report import merge_reports
from corpusward.schemas import NODES
from corpusward.sources.files import find_files, read_files

#: Keys whose object values are maps: their children's keys are names, not keywords.
MAPS = frozenset(("models", "fields", "definitions", "servers"))


def read_documents(spark: SparkSession, paths: list[str]) -> DataFrame:
    """doc_id (path), text, bytes and problem of every .yaml, .yml and .json file under ``paths``.

    Hidden names and ``target`` folders are skipped, as is what lies below a folder with
    an ``index.md`` (a bundle).  Folders may be nested to any depth.  A path to one file
    is read whatever its extension.  What cannot be read (a path to nothing, a folder or
    file without permission, bytes that are not UTF-8) is a row with a null text and a
    problem; ``path_problems`` makes findings of these.
    """
    return read_files(find_files(spark, paths))


def path_problems(docs: DataFrame) -> DataFrame:
    """CLI001 [error] for each path of ``read_documents`` that could not be read."""
    return findings(docs.where("problem is not null"), spec_id=None, severity="error", code="CLI001", message=F.concat(F.lit("cannot be read: "), "problem"))


class _Refused(ValueError):
    """A text that has no one JSON value."""


def _pairs(pairs: list[tuple]) -> dict:
    out = dict(pairs)
    if len(out) < len(pairs):
        raise _Refused("a key occurs twice")
    return out


def _finite(text: str) -> float:
    value = float(text)
    if not math.isfinite(value):
        raise _Refused("a number is not finite")
    return value


class _Loader(yaml.CSafeLoader):
    """YAML with the values of JSON: dates, yes and no, octal and base-60 numbers stay strings, other tags are refused."""


_Loader.yaml_implicit_resolvers = {}
_Loader.add_implicit_resolver("tag:yaml.org,2002:bool", re.compile(r"^(?:true|True|TRUE|false|False|FALSE)$"), list("tTfF"))
_Loader.add_implicit_resolver("tag:yaml.org,2002:null", re.compile(r"^(?:~|null|Null|NULL|)$"), ["~", "n", "N", ""])
_Loader.add_implicit_resolver("tag:yaml.org,2002:int", re.compile(r"^[-+]?(?:0|[1-9][0-9]*)$"), list("-+0123456789"))
_Loader.add_implicit_resolver("tag:yaml.org,2002:float", re.compile(r"^[-+]?(?:(?:\.[0-9]+|[0-9]+\.[0-9]*)(?:[eE][-+]?[0-9]+)?|[0-9]+[eE][-+]?[0-9]+)$"), list("-+.0123456789"))


def _mapping(loader, node):
    if not isinstance(node, yaml.MappingNode):
        raise _Refused("a mapping's tag on something else")
    pairs = [(loader.construct_object(k, deep=True), loader.construct_object(v, deep=True)) for k, v in node.value]
    return _pairs([(k if isinstance(k, str) else json.dumps(k), v) for k, v in pairs])


_JSON_TAGS = ("null", "bool", "int", "str", "seq")
_Loader.yaml_constructors = {t: f for t, f in yaml.CSafeLoader.yaml_constructors.items() if t is None or t.rpartition(":")[2] in _JSON_TAGS}
_Loader.add_constructor("tag:yaml.org,2002:map", _mapping)
_Loader.add_constructor("tag:yaml.org,2002:float", lambda loader, node: _finite(loader.construct_scalar(node).replace("_", "")))

#: How deep YAML may nest: its reader in C has no guard of its own.
DEEPEST = 1_000
#: Nodes that aliases may make of a YAML text, for each of its characters; texts without aliases have at most one.
MOST_NODES = 8


def _depth(text: str) -> int:
    """How deep the collections of a YAML text nest."""
    depth = most = 0
    for event in yaml.parse(text, Loader=yaml.CSafeLoader):
        if isinstance(event, yaml.CollectionStartEvent):
            depth += 1
            most = max(most, depth)
            if most > DEEPEST:
                return most
        elif isinstance(event, yaml.CollectionEndEvent):
            depth -= 1
    return most


def _at_most(value, budget: int) -> bool:
    """Whether a value, its shared parts counted wherever they stand, has no more nodes than ``budget``."""
    todo, n = [value], 1
    while todo:
        v = todo.pop()
        if isinstance(v, (dict, list)):
            n += len(v)
            todo += [x for x in (v.values() if isinstance(v, dict) else v) if isinstance(x, (dict, list))]
        if n > budget:
            return False
    return True


#: What ``parse`` raises; the last three by tags on values that they do not fit.
PROBLEMS = (ValueError, RecursionError, yaml.YAMLError, KeyError, TypeError, AttributeError)


#: One for all texts: json.loads makes another for each call.
_JSON = json.JSONDecoder(object_pairs_hook=_pairs, parse_float=_finite, parse_constant=_finite)


def parse(text: str):
    """The JSON value of a YAML or JSON text; raises one of ``PROBLEMS``.

    Refused are keys that occur twice, numbers that are not finite, YAML tags that JSON
    has no value for, lone surrogates, YAML that nests deeper than ``DEEPEST``, and
    aliases that make more than ``MOST_NODES`` nodes of each character.
    """
    value, read = None, False
    if text.lstrip()[:1] in ("{", "["):
        try:
            value, read = _JSON.decode(text), True
        except json.JSONDecodeError:
            pass  # flow YAML starts alike
    if not read:
        # A level takes a bracket, a line or an indicator before a blank.
        if text.count("[") + text.count("{") + text.count("- ") + text.count("? ") + text.count("\n") > DEEPEST and _depth(text) > DEEPEST:
            raise _Refused("nests too deep")
        value = yaml.load(text, Loader=_Loader)  # noqa: S506  a safe loader
        if "&" in text and "*" in text and not _at_most(value, MOST_NODES * len(text)):
            raise _Refused("aliases make too much of it")
    if "\\" in text:
        json.dumps(value, ensure_ascii=False).encode()  # a lone surrogate is no character
    return value


_KINDS = {type(None): "null", bool: "boolean", int: "integer", float: "number", str: "string", list: "array", dict: "object"}
_FIELDS = [pa.field(c.split()[0], {"string": pa.string(), "int": pa.int32(), "double": pa.float64()}[c.split()[1]]) for c in NODES.split(", ")]
_BATCH = 50_000

#: What a chosen node can say besides, so that nothing above or below it has to be a row; ``Places`` asks for it by name.  Each takes a value, its way and the keys wanted.
FACTS = {
    "n_distinct": ("int", pa.int32(), lambda v, way, wanted: n_distinct(v) if type(v) is list else None),
    "keys": ("array<string>", pa.list_(pa.string()), lambda v, way, wanted: [k for k in wanted if k in v] if type(v) is dict else None),
    "way": ("string", pa.string(), lambda v, way, wanted: way),
}


class Places(dict):
    """Which nodes are kept, and which collections are gone through, by rule path: two patterns that match whole paths.

    A path is (kept, gone through), worked out once in a task.  ``facts`` names columns of
    FACTS that the nodes have besides: ``n_distinct``, how many different members an array has;
    ``keys``, which of the keys ``wanted`` an object has; ``way``, the rule path with the name
    (a string at ``name``) of what is there for each ``*``, ``?`` for what has no name.
    """

    MOST = 100_000

    def __init__(self, kept: str, through: str, facts: tuple[str, ...] = (), wanted: tuple[str, ...] = ()):
        self.patterns, self.facts, self.wanted = (kept, through), facts, wanted
        self.tables, self.known = {}, 0

    def __reduce__(self):
        return Places, (*self.patterns, self.facts, self.wanted)

    def __missing__(self, path: str) -> tuple[bool, bool]:
        if len(self) >= self.MOST:
            self.clear()
        self[path] = out = tuple(re.fullmatch(p, path, re.DOTALL) is not None for p in self.patterns)
        return out

    def members(self, path: str, names: bool | None) -> _Members:
        """What is known of the members of a collection at ``path``: an array (names is None), or an object."""
        if (path, names) not in self.tables:
            self.tables[path, names] = _Members(self, path, names)
        return self.tables[path, names]


class _Members(dict):
    """By key: kept, gone through, path, pointer's token and whether the keys below are names; None where neither kept nor gone through."""

    def __init__(self, places: Places, path: str, names: bool | None):
        self.places, self.path, self.names = places, path, names

    def __missing__(self, key: str | None) -> tuple | None:
        places = self.places
        places.known += 1
        if places.known > places.MOST:
            places.tables.clear()
            places.known = 0
            self.clear()
        token = key and key.replace("~", "~0").replace("/", "~1")
        there = f"{self.path}/*" if key is None or self.names else f"{self.path}/{token}"
        kept, through = places[there]
        self[key] = out = (kept, through, there, token, key in MAPS and not self.names) if kept or through else None
        return out


class _Columns:
    """Rows of NODES, and of FACTS by name, as columns, document by document."""

    def __init__(self, facts: tuple[str, ...] = ()):
        self.fields = [*_FIELDS, *(pa.field(f, FACTS[f][1]) for f in facts)]
        self.start()

    def start(self) -> None:
        self.ids, self.counts = [], []
        self.rows = [[] for _ in self.fields[1:]]
        self.chosen_rows = []  # not yet in columns

    def __len__(self) -> int:
        return len(self.rows[0]) + len(self.chosen_rows)

    def _settle(self) -> None:
        for column, part in zip(self.rows, zip(*self.chosen_rows)):  # no rows: no parts
            column.extend(part)
        self.chosen_rows = []

    def batch(self) -> pa.RecordBatch:
        self._settle()
        ids = pa.array(self.ids, pa.string()).take(pa.array(np.repeat(np.arange(len(self.ids)), self.counts)))
        out = pa.RecordBatch.from_arrays([ids, *(pa.array(c, f.type) for c, f in zip(self.rows, self.fields[1:], strict=True))], schema=pa.schema(self.fields))
        self.start()
        return out

    def single(self, doc_id: str, kind: str, sval: str | None) -> None:
        """A document of one row that is no JSON value."""
        self._settle()
        self.ids.append(doc_id)
        self.counts.append(1)
        for column, value in zip(self.rows, (0, "", None, None, None, 0, kind, sval, None, 0, "", *[None] * (len(self.rows) + 1 - len(_FIELDS))), strict=True):
            column.append(value)

    def document(self, doc_id: str, value) -> Iterator[pa.RecordBatch]:
        """All nodes in document order, without recursion; full batches are handed on."""
        seqs, pointers, parents, keys, indexes, depths, kinds, svals, nvals, sizes, paths = (c.append for c in self.rows)
        began, seq = len(self), 0
        # Members still to come of each open collection: (key or index, value), the collection's pointer, its path, whether keys are names.
        open_ = [(iter([(None, value)]), "", "", None)]
        while open_:
            members, pointer, path, names = open_[-1]
            for at, v in members:
                kind = _KINDS[type(v)]
                if names is None:
                    here, there, key = "", "", None
                    parents(None), keys(None), indexes(None)
                elif type(at) is int:
                    here, there, key = f"{pointer}/{at}", f"{path}/*", None
                    parents(pointer), keys(None), indexes(at)
                else:
                    token = at.replace("~", "~0").replace("/", "~1") if "~" in at or "/" in at else at
                    here, there, key = f"{pointer}/{token}", f"{path}/*" if names else f"{path}/{token}", at
                    parents(pointer), keys(at), indexes(None)
                seqs(seq), pointers(here), depths(len(open_) - 1), kinds(kind), paths(there)
                seq += 1
                if kind == "string":
                    svals(v), nvals(None), sizes(0)
                elif kind == "object" or kind == "array":
                    svals(None), nvals(None), sizes(len(v))
                    if v:
                        open_.append((iter(v.items()), here, there, key in MAPS and not names) if kind == "object" else (enumerate(v), here, there, False))
                        break
                else:
                    svals(_written(v)), nvals(float(v) if kind in ("integer", "number") and abs(v) < 1e308 else None), sizes(0)
            else:
                open_.pop()
            if len(self) >= _BATCH:
                self.ids.append(doc_id)
                self.counts.append(len(self) - began)
                yield self.batch()
                seqs, pointers, parents, keys, indexes, depths, kinds, svals, nvals, sizes, paths = (c.append for c in self.rows)
                began = 0
        self.ids.append(doc_id)
        self.counts.append(len(self) - began)


    def chosen(self, doc_id: str, value, places: Places) -> Iterator[pa.RecordBatch]:
        """As ``document``, the nodes at ``places`` alone; seq numbers these."""
        rows, seq, began = self.chosen_rows, 0, len(self.chosen_rows)
        facts, ways, wanted = [FACTS[f][2] for f in places.facts], "way" in places.facts, places.wanted
        kept, through = places[""]
        if kept:
            rows.append((0, "", None, None, None, 0, *_measured(value), "", *[f(value, "", wanted) for f in facts]))
            seq = 1
        # Members still to come of each open collection, its pointer, what is known of its members (one entry for all of an array's), and its way.
        open_ = []
        if through and value and type(value) in (dict, list):
            open_.append((*_opened(value, "", "", False, places), ""))
        while open_:
            members, pointer, table, every, above = open_[-1]
            for at, v in members:
                entry = every or table[at]
                if entry is None:
                    continue
                kept, through, there, token, names = entry
                here = f"{pointer}/{at if token is None else token}"
                way = f"{above}/{_called(v) if there.endswith('/*') else token}" if ways else None
                if kept:
                    row = (seq, here, pointer, None, at, len(open_), *_measured(v), there) if token is None else (seq, here, pointer, at, None, len(open_), *_measured(v), there)
                    rows.append((*row, *[f(v, way, wanted) for f in facts]) if facts else row)
                    seq += 1
                if through and v and type(v) in (dict, list):
                    open_.append((*_opened(v, here, there, names, places), way))
                    break
            else:
                open_.pop()
            if len(self) >= _BATCH:
                self.ids.append(doc_id)
                self.counts.append(len(rows) - began)
                yield self.batch()
                rows, began = self.chosen_rows, 0
        self.ids.append(doc_id)
        self.counts.append(len(rows) - began)


def _written(v) -> str:
    """The JSON of null, a boolean or a finite number."""
    return "null" if v is None else "true" if v is True else "false" if v is False else repr(v)


def _called(v) -> str:
    """The name that an object has, as a pointer's token."""
    name = v.get("name") if type(v) is dict else None
    return name.replace("~", "~0").replace("/", "~1") if type(name) is str else "?"


def _measured(v) -> tuple:
    """kind, sval, nval and n_children of a value."""
    kind = _KINDS[type(v)]
    if kind == "string":
        return kind, v, None, 0
    if kind == "object" or kind == "array":
        return kind, None, None, len(v)
    return kind, _written(v), float(v) if kind in ("integer", "number") and abs(v) < 1e308 else None, 0


def _opened(value, pointer: str, path: str, names: bool, places: Places) -> tuple:
    """A collection to go through, for ``chosen``; ``names`` says that an object's keys are names."""
    if type(value) is list:
        every = places.members(path, None)[None]
        return (enumerate(value) if every else iter(()), pointer, None, every)
    return iter(value.items()), pointer, places.members(path, names), None


def dealt(docs: DataFrame, *keys: str) -> DataFrame:
    """``docs`` (doc_id, text) dealt evenly over tasks, for texts that come in few partitions.

    As many as ``spark.sql.shuffle.partitions``, three for each core at least.  Texts that
    lie in few files would else be parsed by few tasks; a scan of many files needs no
    dealing.  Rows that texts are yet to be built from are dealt by their own ``keys``.
    """
    spark = docs.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)
    return docs.repartition(n, *(keys or [F.xxhash64("doc_id", "text")]))


def to_nodes(docs: DataFrame, places: Places | None = None) -> DataFrame:
    """One row for each JSON node of ``docs`` (doc_id, text), in document order.

    Texts are read and checked whole; of their nodes, those at ``places`` are rows, all
    if none are given: most of the time goes into rows.  A text that is an error or
    empty is a row whatever the places.  Columns of FACTS come after those of NODES.

    A text that ``parse`` refuses gives one row of kind ``error`` (sval ``line:column
    reason``), an empty one (null, blank or comments) one row of kind ``empty``; neither
    keeps the other documents from being read.  Documents are parsed where they lie; see
    ``dealt``.
    """

    facts = () if places is None else places.facts

    def task(batches):
        out = _Columns(facts)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py() or ""
                try:
                    value = parse(text)
                except PROBLEMS as e:
                    mark = getattr(e, "problem_mark", None)
                    place = f"{mark.line + 1}:{mark.column + 1}" if mark else f"{getattr(e, 'lineno', 1)}:{getattr(e, 'colno', 1)}"
                    out.single(doc_id, "error", f"{place} {e if isinstance(e, _Refused) else type(e).__name__}")
                    continue
                if value is None and not text.strip().startswith(("null", "~")):
                    out.single(doc_id, "empty", None)
                else:
                    yield from out.document(doc_id, value) if places is None else out.chosen(doc_id, value, places)
            yield out.batch()

    return docs.select(F.col("doc_id").cast("string"), F.col("text").cast("string")).mapInArrow(task, ", ".join([NODES, *(f"{f} {FACTS[f][0]}" for f in facts)]))


def parsed(nodes: DataFrame) -> DataFrame:
    """Nodes of documents that have content."""
    return nodes.where(~F.col("kind").isin("error", "empty"))


def parse_findings(nodes: DataFrame, standard: str) -> DataFrame:
    """Unparseable documents (001) and empty ones (002), both errors."""
    prefix = standard.upper()
    place = F.split(F.split("sval", " ")[0], ":")
    bad = findings(nodes.where("kind = 'error'"), spec_id=standard, severity="error", code=f"{prefix}001", message=F.concat(F.lit("does not parse: "), "sval"), line=place[0], column=place[1], pointer="")
    return merge_reports(bad, findings(nodes.where("kind = 'empty'"), spec_id=standard, severity="error", code=f"{prefix}002", message="is empty", pointer=""))


def route_documents(docs: DataFrame, nodes: DataFrame, forced: str | None = None) -> DataFrame:
    """``docs`` (doc_id, ...) with ``standard`` (null if none) and ``kind_found``.

    A string ``kind`` decides; else the root key dataContractSpecification does.
    """
    root = nodes.where("depth = 1 and key in ('kind', 'dataContractSpecification')").groupBy("doc_id").agg(
        F.max(F.when((F.col("key") == "kind") & (F.col("kind") == "string"), F.col("sval"))).alias("kind_found"), F.count_if(F.col("key") == "dataContractSpecification").alias("old")
    )
    kind = F.when(F.col("kind_found") == "DataContract", "odcs").when(F.col("kind_found") == "DataProduct", "odps").when(F.col("kind_found").isNull() & (F.col("old") > 0), "odcl")
    return docs.join(root, "doc_id", "left").withColumn("standard", F.lit(forced) if forced else kind).drop("old")


def routing_problems(routed: DataFrame) -> DataFrame:
    """CLI002 for each document of no known kind, CLI003 if there are no documents."""
    unknown = findings(routed.where(F.col("standard").isNull()), spec_id=None, severity="warning", code="CLI002", message=F.concat(F.lit("not a kind of document that is known: "), F.coalesce("kind_found", F.lit("no kind"))))
    none = routed.agg(F.count(F.lit(1)).alias("n")).where("n = 0")
    return merge_reports(unknown, findings(none, doc_id=F.lit(None), spec_id=None, severity="error", code="CLI003", message="there are no documents"))
