"""Schema conformance: keywords of a JSON Schema as rule tables that meet the nodes in joins.

A schema is flattened on the driver to rows (rule_path, keyword, argument); a rule table
has a few hundred rows, bounded by the schema, and is broadcast.  All violations of a
document are reported, not the first alone.

Each operator named after a class of violations judges the rules outside of alternatives;
``schema_findings`` judges all of them: alternatives (oneOf, anyOf, not), conditions (if,
dependentSchemas, dependentRequired), contains and propertyNames, nested in any way.
A keyword that is not checked is a row ``unsupported`` of the rule table, and a finding.
"""

from __future__ import annotations

import json
import math
import re
from decimal import MAX_EMAX, ROUND_CEILING, ROUND_FLOOR, Decimal, localcontext
from functools import reduce, wraps

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusward.functions.lineage import cut, stored
from corpusward.functions.severity import findings
from corpusward.functions.values import HEX as _HEX
from corpusward.functions.values import typed as _typed
from corpusward.sources.documents import MAPS

RULES = "rule_path string, keyword string, text string, num double, kinds array<string>, branch string"

#: What a keyword's violation is numbered.
CODES = {
    "required": "101",  # dependentRequired too
    "additionalProperties": "102",
    "propertyNames": "102",
    "enum": "103",
    "const": "103",
    "type": "104",
    "pattern": "105",
    "format": "105",
    "minItems": "106",
    "maxItems": "106",
    "minProperties": "106",
    "maxProperties": "106",
    "uniqueItems": "106",
    "contains": "106",
    "minimum": "107",
    "maximum": "107",
    "exclusiveMinimum": "107",
    "exclusiveMaximum": "107",
    "multipleOf": "107",
    "minLength": "107",
    "maxLength": "107",
    "oneOf": "108",
    "anyOf": "108",
    "not": "108",
    "false": "108",
}
_NUMBERS = [k for k, c in CODES.items() if c in ("106", "107") and k not in ("uniqueItems", "contains")]
#: Keywords that say nothing of a value, or are read along with another one.
SILENT = frozenset(
    "$schema $id $anchor $comment $defs $vocabulary definitions title description default examples deprecated deprecationMessage readOnly writeOnly minContains maxContains then else properties".split()
)
#: Keywords whose branches are judged before they are.
CHOICES = ("oneOf", "anyOf", "not", "contains", "if", "propertyNames")
#: Segments of rule paths that no key has: names of an object, keys of a pattern, other keys.
_NAME, _PATTERN, _OTHER = "\x01", "\x02", "\x03"


def number_text(kind: str = "kind", text: str = "sval") -> Column:
    """A number as a text that is equal for equal numbers: whole ones as all their digits, whatever they are written like."""
    c = F.col(text)
    scientific = r"^(-?)(\d)(?:\.(\d+))?e\+(\d+)$"
    digits = F.concat(F.regexp_extract(c, scientific, 2), F.regexp_extract(c, scientific, 3))
    spread = F.concat(F.regexp_extract(c, scientific, 1), F.rpad(digits, F.regexp_extract(c, scientific, 4).cast("int") + 1, F.lit("0")))
    return F.when(F.col(kind) == "integer", c).when(c == "-0.0", "0").when(c.rlike(r"^-?\d+\.0$"), F.regexp_replace(c, r"\.0$", "")).when(c.rlike(scientific), spread).otherwise(c)


def _scalar() -> tuple[Column, Column]:
    """The class and the text of a node that has no members, as in ``_typed``."""
    kind = F.when(F.col("kind").isin("integer", "number"), "number").when(F.col("kind").isin("null", "boolean"), "literal").otherwise(F.col("kind"))
    return kind, F.when(kind == "number", number_text()).otherwise(F.col("sval"))


def subtree_digests(nodes: DataFrame, tops: DataFrame) -> DataFrame:
    """doc_id, pointer and digest of the values at the rule paths ``tops`` (above).

    A value is the set of what lies in it: each node's place below its top, kind and
    value.  Their hashes are combined by exclusive or, so that sums of parts merge before the
    shuffle and no value has to fit one row; order of keys does not count, 1 and 1.0 are
    equal, and integers of any length differ where they differ.
    """
    kind, text = _scalar()
    path = F.split("rule_path", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(path)), lambda i: F.array_join(F.slice(path, F.lit(1), i), "/"))
    levels = tops.select("above").distinct().withColumn("level", F.size(F.split("above", "/")))
    below = nodes.select("doc_id", "pointer", kind.alias("class"), text.alias("value"), F.explode(prefixes).alias("above")).join(F.broadcast(levels), "above")
    parts = F.split("pointer", "/")
    inner = F.slice(parts, F.col("level") + 1, F.greatest(F.size(parts) - F.col("level"), F.lit(0)))
    fact = F.sha2(F.concat_ws("\0", F.array_join(F.transform(inner, lambda x: F.concat(F.lit("/"), x)), ""), "class", F.when(F.col("class").isin("object", "array"), "").otherwise(F.coalesce("value", F.lit("")))), 256)
    rows = below.select("doc_id", _upto(F.col("level")).alias("pointer"), "level", fact.alias("f"))
    longs = [F.bit_xor(F.conv(F.substring("f", 1 + i * _HEX, _HEX), 16, 10).cast("long")).alias(f"x{i}") for i in range(4)]
    one = rows.groupBy("doc_id", "pointer", "level").agg(F.count(F.lit(1)).alias("n"), *longs)
    return one.select("doc_id", "pointer", F.concat_ws(":", *(F.col(c).cast("string") for c in ("n", "x0", "x1", "x2", "x3"))).alias("digest"))


def _double(value) -> float:
    try:
        return float(value)
    except OverflowError:
        return math.inf if value > 0 else -math.inf


def _whole_bound(keyword: str, value) -> str:
    """The whole number that a whole number is to be compared with, exact at any length."""
    exact = Decimal(repr(value))
    with localcontext(prec=max(50, len(str(value)) + 5), Emax=MAX_EMAX):
        return str(int(exact.to_integral_value(ROUND_CEILING if keyword in ("minimum", "exclusiveMaximum") else ROUND_FLOOR))) if keyword != "multipleOf" or exact == exact.to_integral_value() else ""


def _token(key: str) -> str:
    return key.replace("~", "~0").replace("/", "~1")


#: Patterns of one object whose keys are looked into.
PATTERNS = 4


def _compiles(pattern: str) -> bool:
    """Whether Python and the JVM of this session (if there is one) both read a pattern."""
    try:
        re.compile(pattern)
        context = SparkContext._active_spark_context
        if context is not None:
            context._jvm.java.util.regex.Pattern.compile(pattern)
        return True
    except (re.error, Py4JJavaError, OverflowError, RecursionError):
        return False


def flatten_schema(schema: dict, starts: list[tuple] = (("", None, None),)) -> list[tuple]:
    """Rows of RULES for a schema; local ``$ref`` are followed.

    Where a ``$ref`` recurs below itself, a row ``again`` holds it and the schema;
    ``unrolled`` puts rules in its place.  Branches of alternatives are rules of their own,
    told apart by ``branch``: how many branches it lies in, a colon, and a name.  ``starts``
    has (path, ref, branch) to begin at.
    """
    out: list[tuple] = []

    def target(ref: str) -> dict:
        s = schema
        for t in ref.removeprefix("#").split("/")[1:]:
            s = s[int(t)] if isinstance(s, list) else s[t.replace("~1", "/").replace("~0", "~")]
        return s

    def walk(s, path: str, branch: str | None, refs: dict[str, str]) -> None:
        add = lambda keyword, text=None, num=None, kinds=None: out.append((path, keyword, text, num, kinds, branch))
        if s is False:
            add("false")
        if not isinstance(s, dict):
            return
        if "$ref" in s:
            ref, beside = s["$ref"], {k: v for k, v in s.items() if k != "$ref"}
            if not ref.startswith("#"):
                add("unsupported", f"$ref {ref}")
            elif ref not in refs:
                walk(target(ref), path, branch, refs | {ref: path})
            elif refs[ref] != path:  # at the same path it says nothing more
                add("again", json.dumps([ref, schema]))
            walk(beside, path, branch, refs)
            return
        level = int(branch.partition(":")[0]) if branch else 0

        def choice(keyword: str, parts: dict, at: str = path, num: float | None = None, kinds: list | None = None) -> None:
            """A rule that is judged by its branches; its text is what their names start with."""
            own = f"{level + 1}:{branch or ''} {path} {keyword} "
            while any(row[1] == keyword and row[2] == own for row in out):
                own += "+"
            add(keyword, own, float(len(parts)) if num is None else num, kinds)
            for name, part in parts.items():
                walk(part, at, f"{own}{name}", refs)

        for key in s.get("required", ()):
            add("required", key)
        named, patterns, others = s.get("properties", {}), s.get("patternProperties", {}), s.get("additionalProperties", True)
        for p in [p for p in patterns if not _compiles(p)]:
            add("unsupported", f"pattern that does not compile: {p}")
            patterns = {q: v for q, v in patterns.items() if q != p}
        if others is False:
            add("closed", "|".join(f"(?:{p})" for p in patterns) or None)
            for key in named:
                add("allowed", key)
        if "const" in s or "enum" in s:
            values = s["enum"] if "enum" in s else [s["const"]]
            add("values", "whole" if any(isinstance(v, (dict, list)) for v in values) else None)
            for v in values:
                kind, text = _typed(v)
                add("value", text, None, [kind])
        if "type" in s:
            add("type", None, None, [s["type"]] if isinstance(s["type"], str) else list(s["type"]))
        if "format" in s:
            add("format", s["format"])
        if "pattern" in s:
            add(*(("pattern", s["pattern"]) if _compiles(s["pattern"]) else ("unsupported", f"pattern that does not compile: {s['pattern']}")))
        for k in _NUMBERS:
            if k in s:
                add(k, _whole_bound(k, s[k]), _double(s[k]))
        if s.get("uniqueItems"):
            add("uniqueItems")
        for part in s.get("allOf", ()):
            walk(part, path, branch, refs)
        for k in ("oneOf", "anyOf"):
            if k in s:
                choice(k, dict(enumerate(s[k])))
        if "not" in s:
            choice("not", {0: s["not"]})
        if "if" in s:
            choice("if", {"if": s["if"], "then": s.get("then", True), "else": s.get("else", True)})
        for key, part in (*s.get("dependentSchemas", {}).items(), *((k, {"required": needed}) for k, needed in s.get("dependentRequired", {}).items())):
            choice("if", {"if": {"type": "object", "required": [key]}, "then": part, "else": True})
        if "contains" in s:
            choice("contains", {0: s["contains"]}, f"{path}/*", float(s.get("minContains", 1)), [str(s["maxContains"])] if "maxContains" in s else None)
        if "propertyNames" in s:
            choice("propertyNames", {0: s["propertyNames"]}, f"{path}/{_NAME}")
        for key, child in named.items():
            walk(child, f"{path}/{_token(key)}", branch, refs)
            for p, part in patterns.items():
                if re.search(p, key):
                    walk(part, f"{path}/{_token(key)}", branch, refs)
        if patterns or isinstance(others, dict):
            if len(patterns) > PATTERNS:  # their subsets would be too many: keys that match a pattern are not looked into
                add("unsupported", f"more than {PATTERNS} patternProperties")
                patterns = {"|".join(f"(?:{p})" for p in patterns): True}
            add("patterned", json.dumps([sorted(named), list(patterns), isinstance(others, dict)]))
            for mask in range(1, 1 << len(patterns)):
                for i, part in enumerate(patterns.values()):
                    if mask >> i & 1:
                        walk(part, f"{path}/{_PATTERN}{mask}", branch, refs)
            walk(others, f"{path}/{_OTHER}", branch, refs)
            if isinstance(others, dict) and not patterns and path.rpartition("/")[2] in MAPS:
                walk(others, f"{path}/*", branch, refs)  # nodes say ``*`` for the names of such maps
        if "items" in s:
            walk(s["items"], f"{path}/*", branch, refs)
        for k in s:
            if k not in CODES and k not in SILENT and k not in ("if", "items", "allOf", "patternProperties", "dependentSchemas", "dependentRequired") and not k.startswith("x-"):
                add("unsupported", k)

    for path, ref, branch in starts:
        walk(schema if ref is None else {"$ref": ref}, path, branch, {"#": path} if ref is None else {})
    return out


def rule_table(spark: SparkSession, schema: dict) -> DataFrame:
    return spark.createDataFrame(flatten_schema(schema), RULES)


def unsupported_keywords(rules: DataFrame, standard: str) -> DataFrame:
    """What of a schema is not checked: ``*100`` [warning] for each place, with the schema as the document."""
    rows = rules.where("keyword = 'unsupported'").distinct()
    return findings(rows, doc_id=F.lit("schema"), spec_id=standard, severity="warning", code=f"{standard.upper()}100", message=F.concat(F.lit("not checked: "), "text"), pointer=F.col("rule_path"))


def _generalised(nodes: DataFrame, patterned: list[tuple]) -> DataFrame:
    """``nodes`` whose paths say which patterns of an object, or none, their keys match; ``patterned`` has (path, text) of such rules."""
    if not patterned:
        return nodes
    rules = [(path, *json.loads(text)) for path, text in sorted(set(patterned), key=lambda r: r[0].count("/"))]

    def moved(path: str) -> str:
        for above, named, patterns, others in rules:
            if path.startswith(f"{above}/"):
                token, slash, below = path[len(above) + 1 :].partition("/")
                key = token.replace("~1", "/").replace("~0", "~")
                if key not in named and token not in ("*", _NAME):
                    mask = sum(1 << i for i, p in enumerate(patterns) if re.search(p, key))
                    path = f"{above}/{_PATTERN + str(mask) if mask else _OTHER if others else token}{slash}{below}"
        return path

    @F.pandas_udf("string")
    def rewrite(paths: pd.Series) -> pd.Series:
        # Paths repeat: each is worked out once in a batch.
        return paths.map({p: moved(p) for p in paths.unique()})

    return nodes.withColumn("rule_path", rewrite("rule_path"))


def _names(nodes: DataFrame, rules: list[tuple]) -> DataFrame:
    """``nodes`` and, for objects whose names have rules (``rules``: path), each name as a string below them."""
    paths = sorted({r[0] for r in rules})
    if not paths:
        return nodes
    above = F.regexp_replace("rule_path", "/[^/]*$", "")
    names = nodes.where(F.col("key").isNotNull() & above.isin(paths))
    token = F.element_at(F.split("pointer", "/"), -1)
    made = {"pointer": F.concat("parent", F.lit(f"/{_NAME}"), token), "parent": F.lit(None), "key": F.lit(None), "kind": F.lit("string"), "sval": F.col("key"), "nval": F.lit(None), "n_children": F.lit(0), "rule_path": F.concat(above, F.lit(f"/{_NAME}"))}
    return nodes.unionByName(names.select(*((made[c].cast(t) if c in made else F.col(c)).alias(c) for c, t in nodes.dtypes)))


def unrolled(nodes: DataFrame, rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``nodes`` with the paths that ``rules`` speak of, and ``rules`` of a recursive schema as deep as they go.

    Rules meet nodes of their path only, so recursion ends at paths without a node.
    Rules are chosen by branch after this, since recursion can add branches.
    """
    special = rules.where(F.col("keyword").isin("again", "patterned", "propertyNames")).collect()
    pick = lambda keyword: [(r["rule_path"], r["text"]) for r in special if r["keyword"] == keyword]
    patterned, named = pick("patterned"), pick("propertyNames")
    todo = [(r["rule_path"], *json.loads(r["text"]), r["branch"]) for r in special if r["keyword"] == "again"]
    spark, more = nodes.sparkSession, []
    while todo:
        asked = spark.createDataFrame(sorted({(path,) for path, *_ in todo}), "rule_path string")
        there = {r[0] for r in _names(_generalised(nodes, patterned), named).select("rule_path").join(F.broadcast(asked), "rule_path", "left_semi").distinct().collect()}
        rows = [row for path, ref, schema, branch in todo if path in there for row in flatten_schema(schema, [(path, ref, branch)])]
        more += [row for row in rows if row[1] != "again"]
        patterned += [row[0::2][:2] for row in rows if row[1] == "patterned"]
        named += [row[0::2][:2] for row in rows if row[1] == "propertyNames"]
        todo = [(row[0], *json.loads(row[2]), row[5]) for row in rows if row[1] == "again"]
    if any(r["keyword"] == "again" for r in special):
        rules = rules.where("keyword <> 'again'").unionByName(spark.createDataFrame(more, RULES))
    if patterned or named:
        nodes = stored(_names(_generalised(nodes, patterned), named))
    return nodes, rules


def _unrolling(op):
    """``op`` on rules outside of alternatives that go as deep as its nodes."""

    @wraps(op)
    def whole(nodes: DataFrame, rules: DataFrame) -> DataFrame:
        nodes, rules = unrolled(nodes, rules)
        return op(nodes, rules.where("branch is null"))

    return whole


def _met(nodes: DataFrame, rules: DataFrame, *keywords: str) -> DataFrame:
    """Nodes with each rule of their path: broadcast, a schema has few rules."""
    return nodes.join(F.broadcast(rules.where(F.col("keyword").isin(list(keywords)))), "rule_path")


def _apart(rows: DataFrame) -> DataFrame:
    """``rows`` of documents, for a join: never broadcast, however small they seem once compressed; the driver would hold them."""
    return rows.hint("merge")


def _met_at(nodes: DataFrame, rules: DataFrame) -> DataFrame:
    return nodes.join(F.broadcast(rules), "rule_path")


def _violation(rows: DataFrame, pointer: str, code, message) -> DataFrame:
    code = code if isinstance(code, Column) else F.lit(code)
    return rows.select("doc_id", F.col(pointer).alias("pointer"), "seq", code.alias("code"), message.alias("message"), "branch")


def _upto(level: Column, pointer: str = "pointer") -> Column:
    """The first ``level`` segments of a pointer."""
    return F.array_join(F.slice(F.split(pointer, "/"), F.lit(1), level), "/")


@_unrolling
def required_missing(nodes: DataFrame, rules: DataFrame) -> DataFrame:
    """An object lacks a required key: one row for each key, at the object."""
    asked = _met(nodes.where("kind = 'object'").select("doc_id", "pointer", "seq", "rule_path"), rules, "required")
    there = nodes.where("key is not null").select("doc_id", F.col("parent").alias("pointer"), F.col("key").alias("text"))
    return _violation(asked.join(_apart(there), ["doc_id", "pointer", "text"], "left_anti"), "pointer", "101", F.concat(F.lit("lacks "), "text"))


@_unrolling
def unknown_property(nodes: DataFrame, rules: DataFrame) -> DataFrame:
    """A closed object has keys that are not listed: one row for each object, naming them in order."""
    parents = nodes.where("kind = 'object'").select("doc_id", F.col("pointer").alias("parent"), "rule_path", F.col("seq").alias("object_seq"))
    closed = _met(parents, rules, "closed").select("doc_id", "parent", "rule_path", "object_seq", "branch", F.col("text").alias("patterns"))
    children = nodes.where("key is not null").select("doc_id", "parent", "key", "seq")
    allowed = rules.where("keyword = 'allowed'").select("rule_path", F.col("text").alias("key"), F.col("branch").alias("_branch"))
    open_ = children.join(_apart(closed), ["doc_id", "parent"]).where(F.col("patterns").isNull() | ~F.regexp("key", "patterns"))
    bad = open_.join(F.broadcast(allowed), (open_["rule_path"] == allowed["rule_path"]) & (open_["key"] == allowed["key"]) & open_["branch"].eqNullSafe(allowed["_branch"]), "left_anti")
    keys = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "key"))), lambda x: x["key"]), ", ")
    grouped = bad.groupBy("doc_id", "parent", "branch").agg(keys.alias("keys"), F.min("object_seq").alias("seq"))
    return _violation(grouped, "parent", "102", F.concat(F.lit("unknown keys: "), "keys"))


@_unrolling
def value_not_permitted(nodes: DataFrame, rules: DataFrame) -> DataFrame:
    """A value is none of an enum's or not the constant; values are compared as JSON, not as text."""
    kind, text = _scalar()
    asked = _met(nodes.select("doc_id", "pointer", "seq", "rule_path", kind.alias("class"), text.alias("value")), rules, "values").select("doc_id", "pointer", "seq", "rule_path", "class", "value", "branch")
    value = F.col("text")
    whole = rules.where("keyword = 'values' and text = 'whole'").select(F.col("rule_path").alias("above"))
    if not whole.isEmpty():
        digests = subtree_digests(nodes, whole)
        asked = asked.join(_apart(digests), ["doc_id", "pointer"], "left").withColumn("value", F.when(F.col("class").isin("object", "array"), F.col("digest")).otherwise(F.col("value"))).drop("digest")
    allowed = rules.where("keyword = 'value'").select(F.col("rule_path").alias("_path"), F.col("kinds")[0].alias("_class"), value.alias("_value"), F.col("branch").alias("_branch"))
    same = (F.col("rule_path") == F.col("_path")) & (F.col("class") == F.col("_class")) & (F.col("value") == F.col("_value")) & F.col("branch").eqNullSafe(F.col("_branch"))
    return _violation(asked.join(F.broadcast(allowed), same, "left_anti"), "pointer", "103", F.concat(F.when(F.col("class").isin("object", "array"), F.concat(F.lit("this "), "class")).otherwise(F.coalesce("value", F.col("class"))), F.lit(" is not permitted")))


@_unrolling
def wrong_type(nodes: DataFrame, rules: DataFrame) -> DataFrame:
    """A node is of none of the types; integers are numbers, whole numbers are integers."""
    rows = _met(nodes, rules, "type")
    has = lambda k: F.array_contains("kinds", k)
    ok = F.array_contains("kinds", F.col("kind")) | ((F.col("kind") == "integer") & has("number")) | ((F.col("kind") == "number") & has("integer") & (F.col("nval") == F.floor("nval")))
    return _violation(rows.where(~ok), "pointer", "104", F.concat(F.lit("is "), "kind", F.lit(", not "), F.array_join("kinds", " or ")))


#: What a string of each asserted format looks like.
FORMATS = {
    "date": r"^\d{4}-\d{2}-\d{2}$",
    "date-time": r"^\d{4}-\d{2}-\d{2}[Tt]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$",
    "uri": r"^[A-Za-z][A-Za-z0-9+.-]*:[^\s<>\"{}|\\^`]*$",
    "uuid": r"^[0-9A-Fa-f]{8}-([0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}$",
    "email": r"^[^@\s]+@[^@\s]+$",
}


@_unrolling
def malformed_value(nodes: DataFrame, rules: DataFrame) -> DataFrame:
    """A string misses its pattern or format; dates must be days of the calendar."""
    rows = _met(nodes.where("kind = 'string'"), rules, "pattern", "format")
    looks = reduce(lambda c, k: c.when(F.col("text") == k, F.col("sval").rlike(FORMATS[k])), FORMATS, F.when(F.lit(False), F.lit(True))).otherwise(F.lit(True))
    day = F.when(F.col("text").isin("date", "date-time"), F.try_to_date(F.substring("sval", 1, 10), "yyyy-MM-dd").isNotNull()).otherwise(F.lit(True))
    ok = F.when(F.col("keyword") == "pattern", F.regexp(F.col("sval"), F.col("text"))).otherwise(looks & day)
    return _violation(rows.where(~ok), "pointer", "105", F.concat("sval", F.lit(" does not match "), "text"))


def bad_cardinality(nodes: DataFrame, rules: DataFrame) -> DataFrame:
    """Too few or too many members, also of those that contains asks for, or members of an array that are equal as JSON values."""
    nodes, rules = unrolled(nodes, rules)
    if rules.where("keyword = 'contains'").isEmpty():
        return _counted(nodes, rules.where("branch is null"))
    return _all(nodes, rules).where("branch is null and code = '106'")


def _counted(nodes: DataFrame, rules: DataFrame) -> DataFrame:
    """Arrays that say how many different members they have (``n_distinct``) need no rows of what lies in them."""
    n, k = F.col("n_children"), F.col("keyword")
    rows = _met(nodes.where("kind in ('array', 'object')"), rules, "minItems", "maxItems", "minProperties", "maxProperties")
    fits = (F.col("kind") == "array") == k.endswith("Items")
    bad = fits & F.when(k.startswith("min"), n < F.col("num")).otherwise(n > F.col("num"))
    counted = _violation(rows.where(bad), "pointer", "106", F.concat("keyword", F.lit(" is not met")))
    unique = rules.where("keyword = 'uniqueItems'").select("rule_path", "branch").distinct()
    if unique.isEmpty():
        return counted
    if "n_distinct" in nodes.columns:
        return counted.unionByName(_violation(_met_at(nodes.where("kind = 'array' and n_distinct < n_children"), unique), "pointer", "106", F.lit("members are equal")))
    arrays = _met_at(nodes.where("kind = 'array'"), unique).select("doc_id", "pointer", "branch")
    digests = subtree_digests(nodes, unique.select(F.concat("rule_path", F.lit("/*")).alias("above")))
    members = digests.select("doc_id", F.regexp_replace("pointer", "/[^/]*$", "").alias("pointer"), "digest")
    same = members.groupBy("doc_id", "pointer", "digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id", "pointer").distinct()
    twice = arrays.join(_apart(same), ["doc_id", "pointer"])
    equal = nodes.where("kind = 'array'").select("doc_id", "pointer", "seq").join(_apart(twice), ["doc_id", "pointer"])
    return counted.unionByName(_violation(equal, "pointer", "106", F.lit("members are equal")))


def _less(a: str, b: str) -> Column:
    """Whether a whole number, as a text of any length, is less than another."""
    size = lambda c: F.regexp_replace(F.col(c), "^-", "")
    below = lambda x, y: (F.length(x) < F.length(y)) | ((F.length(x) == F.length(y)) & (x < y))
    minus = lambda c: F.col(c).startswith("-")
    return F.when(minus(a) != minus(b), minus(a)).when(minus(a), below(size(b), size(a))).otherwise(below(size(a), size(b)))


def _remainder(a: str, b: str) -> Column:
    """The remainder of a whole number of any length by one of up to nine digits, nine digits a step."""
    digits = F.regexp_replace(F.col(a), "^-", "")
    padded = F.lpad(digits, F.ceil(F.length(digits) / 9).cast("int") * 9, F.lit("0"))
    steps = F.transform(F.sequence(F.lit(1), F.length(padded), F.lit(9)), lambda i: F.substring(padded, i, F.lit(9)).cast("long"))
    return F.aggregate(steps, F.lit(0).cast("long"), lambda x, y: (x * 1_000_000_000 + y) % F.abs(F.col(b).cast("long")))


@_unrolling
def out_of_range(nodes: DataFrame, rules: DataFrame) -> DataFrame:
    """A number beyond its bounds or no multiple, or a string too short or too long (code points)."""
    rows = _met(nodes.where("kind in ('integer', 'number', 'string')"), rules, "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "multipleOf", "minLength", "maxLength")
    rows = rows.withColumn("exact", F.when(F.col("kind") != "string", number_text()))
    v, n, k, num, whole = F.col("nval"), F.char_length("sval"), F.col("keyword"), F.col("num"), F.col("exact").rlike(r"^-?\d+$")
    number, string = F.col("kind") != "string", F.col("kind") == "string"
    less, more = (F.when(whole, _less(a, b)).otherwise(c) for a, b, c in (("exact", "text", v < num), ("text", "exact", v > num)))
    multiple = F.when(whole & (F.length("text").between(1, 9)), _remainder("exact", "text") != 0).otherwise(F.abs(v / num - F.round(v / num)) > 1e-9)
    bad = (
        F.when(k == "minimum", number & less)
        .when(k == "maximum", number & more)
        .when(k == "exclusiveMinimum", number & ~more)
        .when(k == "exclusiveMaximum", number & ~less)
        .when(k == "multipleOf", number & multiple)
        .when(k == "minLength", string & (n < num))
        .otherwise(string & (n > num))
    )
    return _violation(rows.where(bad), "pointer", "107", F.concat("keyword", F.lit(" is not met")))


def _false(nodes: DataFrame, rules: DataFrame) -> DataFrame:
    return _violation(_met(nodes, rules, "false"), "pointer", "108", F.lit("nothing is permitted here"))


def _simple(nodes: DataFrame, rules: DataFrame) -> DataFrame:
    """Violations that need no other rule's judgement, of all branches."""
    ops = (required_missing, unknown_property, value_not_permitted, wrong_type, malformed_value, out_of_range)
    return reduce(DataFrame.unionByName, [op.__wrapped__(nodes, rules) for op in ops], _counted(nodes, rules).unionByName(_false(nodes, rules)))


def _judged(nodes: DataFrame, choices: DataFrame, found: DataFrame) -> DataFrame:
    """Violations of the rules ``choices`` of one level, whose branches' violations are among ``found``.

    A branch's violations lie at the rule's node or below it; the first segments of their
    pointers tell at which one, so everything meets by equal keys.
    """
    kinds = {r["keyword"] for r in choices.select("keyword").distinct().collect()}
    parts = F.transform(F.sequence(F.lit(0), F.greatest(F.col("num").cast("int"), F.lit(1)) - 1), lambda i: i.cast("string"))
    names = F.when(F.col("keyword") == "if", F.array(F.lit("if"), F.lit("then"), F.lit("else"))).when(F.col("keyword") == "contains", F.array(F.lit("0"))).otherwise(parts)
    branches = choices.select("text", F.size(F.split("rule_path", "/")).alias("level"), F.col("branch").alias("_around"), F.explode(names).alias("part")).withColumn("branch", F.concat("text", "part")).distinct()
    inside = found.join(F.broadcast(branches), "branch").withColumn("place", _upto(F.col("level")))
    broken = inside.groupBy("doc_id", "text", "part", F.col("place").alias("pointer")).agg(F.count_distinct(_upto(F.col("level") + 1)).alias("members"))
    places = _met(nodes.select("doc_id", "pointer", "seq", "kind", "n_children", "rule_path"), choices, *CHOICES)
    out = []
    if kinds & {"oneOf", "anyOf", "not", "propertyNames"}:
        n = broken.groupBy("doc_id", "text", "pointer").agg(F.count(F.lit(1)).alias("broken"))
        asked = places.where(F.col("keyword").isin("oneOf", "anyOf", "not") | ((F.col("keyword") == "propertyNames") & (F.col("kind") == "object")))
        held = F.col("num").cast("int") - F.coalesce("broken", F.lit(0))
        k = F.col("keyword")
        bad = F.when(k == "oneOf", held != 1).when(k == "anyOf", held == 0).when(k == "not", held > 0).otherwise(held == 0)
        message = F.when(k == "propertyNames", "a name is not permitted").otherwise(F.concat("keyword", F.lit(": branches that match: "), held.cast("string")))
        out.append(_violation(asked.join(_apart(n), ["doc_id", "text", "pointer"], "left").where(bad), "pointer", F.when(k == "propertyNames", "102").otherwise("108"), message))
    if "contains" in kinds:
        asked = places.where("keyword = 'contains' and kind = 'array'").join(_apart(broken.select("doc_id", "text", "pointer", "members")), ["doc_id", "text", "pointer"], "left")
        n = F.col("n_children") - F.coalesce("members", F.lit(0))
        few, many = n < F.col("num"), F.coalesce(n > F.get("kinds", F.lit(0)).cast("double"), F.lit(False))
        out.append(_violation(asked.where(few | many), "pointer", "106", F.when(few, "contains is not met").otherwise("maxContains is not met")))
    if "if" in kinds:
        unmet = broken.where("part = 'if'").select("doc_id", "text", F.col("pointer").alias("place")).withColumn("unmet", F.lit(True))
        rows = inside.where("part in ('then', 'else')").join(_apart(unmet), ["doc_id", "text", "place"], "left")
        rows = rows.where(F.coalesce("unmet", F.lit(False)) == (F.col("part") == "else")).withColumn("branch", F.col("_around"))
        out.append(rows.select("doc_id", "pointer", "seq", "code", "message", "branch"))
    return reduce(DataFrame.unionByName, out)


def _all(nodes: DataFrame, rules: DataFrame) -> DataFrame:
    """All violations, those in branches too: the innermost alternatives are judged first."""
    found = _simple(nodes, rules)
    level = F.coalesce(F.split("branch", ":")[0].cast("int"), F.lit(0)).alias("level")
    levels = sorted((r["level"] for r in rules.where(F.col("keyword").isin(list(CHOICES))).select(level).distinct().collect()), reverse=True)
    for at in levels:
        judged = _judged(nodes, rules.where(F.col("keyword").isin(list(CHOICES)) & (level == at)), found)
        found = found.unionByName(judged)
        if at:
            found = cut(found)  # used twice on the next level
    return found


def no_matching_alternative(nodes: DataFrame, rules: DataFrame) -> DataFrame:
    """oneOf without exactly one, anyOf without one, not with a branch that has no violation, or a value where nothing is permitted."""
    return _all(*unrolled(nodes, rules)).where("branch is null and code = '108'")


def schema_findings(nodes: DataFrame, rules: DataFrame, standard: str) -> DataFrame:
    """All schema violations of one standard's documents, as errors, and the keywords that are not checked."""
    found = _all(*unrolled(nodes, rules)).where("branch is null")
    # Fixed value: the older contracts count a name that is not permitted as malformed.
    code = F.when((F.col("message") == "a name is not permitted") & F.lit(standard == "odcl"), "105").otherwise(F.col("code"))
    errors = findings(found, spec_id=standard, severity="error", code=F.concat(F.lit(standard.upper()), code), message=F.col("message"), pointer=F.col("pointer"), seq=F.col("seq"))
    return errors.unionByName(unsupported_keywords(rules, standard))
