"""Nodes of JSON documents without Python: texts are parsed to VARIANT and opened level by level."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusward.functions.lineage import cut, stored
from corpusward.functions.pointers import pointer_escape
from corpusward.schemas import NODES
from corpusward.sources.documents import MAPS, dealt, to_nodes

#: A key that stands after a text, to tell that the text is one value and no more.
_END = "\x7fend\x7f"
#: Digits of decimals that doubles write as they are read.
_DIGITS = 15


def _root(text: Column) -> Column:
    """The VARIANT of a text that is one JSON array or object; null for any other, also where only ``documents.parse`` may tell."""
    plain = text.rlike(r"^[ \t\r\n]*[{\[]") & ~text.contains(_END) & ~text.rlike(r"\\u[dD][89a-fA-F]") & ~text.rlike(r"-0(\.0*)?[,\]}\s]")
    around = F.try_parse_json(F.when(plain, F.concat(F.lit('{"r":'), text, F.lit(f',"{_END}":0}}'))))
    whole = F.size(F.try_variant_get(around, "$", "map<string,variant>")) == 2
    return F.when(whole & F.try_variant_get(around, f"$['{_END}']", "int").isNotNull(), F.variant_get(around, "$.r", "variant"))


def _measured(rows: DataFrame) -> DataFrame:
    """``rows`` with kind, sval, nval, n_children, and whether the value is a number that must be read by ``documents.parse``."""
    members, items = F.try_variant_get("v", "$", "map<string,variant>"), F.try_variant_get("v", "$", "array<variant>")
    rows = rows.withColumn("kind", F.when(F.is_variant_null("v"), "null").when(items.isNotNull(), "array").when(members.isNotNull(), "object").otherwise(F.schema_of_variant("v")))
    decimal = F.regexp_extract("kind", r"^DECIMAL\((\d+),", 1)
    text = F.variant_get("v", "$", "string")
    number = F.when(text.contains("."), text).otherwise(F.concat(text, F.lit(".0")))
    value = F.try_variant_get("v", "$", "double")
    odd = (F.col("kind") == "DOUBLE") | ((decimal != "") & ((decimal.cast("int") > _DIGITS) | ((F.abs(value) < 1e-4) & (value != 0))))
    kind = F.when(F.col("kind") == "BIGINT", "integer").when(decimal != "", "number").when(F.col("kind") == "BOOLEAN", "boolean").when(F.col("kind") == "STRING", "string").otherwise(F.col("kind"))
    inner = F.col("kind").isin("array", "object")
    sval = F.when(inner, F.lit(None)).when(F.col("kind") == "null", "null").when(decimal != "", number).otherwise(text)
    n = F.when(F.col("kind") == "array", F.size(items)).when(F.col("kind") == "object", F.size(members)).otherwise(0)
    nval = F.when((F.col("kind") == "BIGINT") | (decimal != ""), value)
    return rows.select("doc_id", "row", "pointer", "parent", "key", "idx", "depth", "rule_path", "names", kind.alias("kind"), sval.alias("sval"), nval.alias("nval"), n.alias("n_children"), odd.alias("odd"), F.when(inner, F.col("v")).alias("v"))


def _below(level: DataFrame) -> DataFrame:
    """The members of a level's arrays and objects."""
    entry = lambda key, idx, v: F.struct(key.cast("string").alias("key"), idx.cast("int").alias("idx"), v.alias("v"))
    null = F.lit(None)
    members = F.transform(F.map_entries(F.try_variant_get("v", "$", "map<string,variant>")), lambda e: entry(e["key"], null, e["value"]))
    items = F.transform(F.try_variant_get("v", "$", "array<variant>"), lambda x, i: entry(null, i, x))
    open_ = level.where("n_children > 0").select("doc_id", "row", "pointer", "depth", "rule_path", "names", F.explode(F.when(F.col("kind") == "object", members).otherwise(items)).alias("m"))
    key = F.col("m.key")
    token = pointer_escape(key)
    return open_.select(
        "doc_id", "row", F.concat("pointer", F.lit("/"), F.coalesce(token, F.col("m.idx").cast("string"))).alias("pointer"), F.col("pointer").alias("parent"), key.alias("key"), F.col("m.idx").alias("idx"), (F.col("depth") + 1).alias("depth"),
        F.concat("rule_path", F.lit("/"), F.when(key.isNull() | F.col("names"), "*").otherwise(token)).alias("rule_path"), (F.coalesce(key.isin(sorted(MAPS)), F.lit(False)) & ~F.col("names")).alias("names"), F.col("m.v").alias("v"),
    )


def json_nodes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes of the JSON documents of ``docs`` (doc_id, text), and the documents that ``to_nodes`` has to read.

    The same rows as ``to_nodes`` gives, but for ``seq``, which is 0: objects of VARIANT do not
    keep the order of their keys.  Left over are texts in YAML, without a value, that are
    refused, or with a number that is not the same as a double and as a decimal (exponents, more
    than 15 digits).  Levels are written one after the other, so a document's depth is the
    number of rounds; a value is opened in the JVM, a level of it at a time.
    """
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("row", F.monotonically_increasing_id())
    read = stored(rows.withColumn("v", _root(F.col("text"))))
    start = {"pointer": F.lit(""), "parent": F.lit(None).cast("string"), "key": F.lit(None).cast("string"), "idx": F.lit(None).cast("int"), "depth": F.lit(0), "rule_path": F.lit(""), "names": F.lit(False)}
    level = read.where("v is not null").select("doc_id", "row", *(c.alias(n) for n, c in start.items()), "v")
    levels = []
    while True:
        levels.append(stored(_measured(level)))
        if levels[-1].where("n_children > 0").isEmpty():
            break
        level = _below(levels[-1])
    found = reduce(DataFrame.unionByName, (x.drop("v") for x in levels))
    odd = cut(found.where("odd").select("row").distinct())
    kinds = dict(c.split() for c in NODES.split(", "))
    nodes = found.join(odd, "row", "left_anti").withColumn("seq", F.lit(0))
    rest = read.where("v is null").select("doc_id", "text").unionByName(read.where("v is not null").join(odd, "row", "left_semi").select("doc_id", "text"))
    return nodes.select(*(F.col(c).cast(t).alias(c) for c, t in kinds.items())), rest


def nodes_of(docs: DataFrame) -> DataFrame:
    """All nodes of ``docs``: JSON by ``json_nodes``, what is left by ``to_nodes``.

    For rules that do not need the order of a document's nodes.
    """
    nodes, rest = json_nodes(docs)
    return nodes.unionByName(to_nodes(dealt(rest)))
