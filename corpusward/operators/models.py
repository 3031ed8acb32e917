"""Questions that the typed models answer, as projections over nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusward.functions.pointers import pointer_unescape
from corpusward.sources.documents import Places

#: Root keys of a contract that have a column of their own.
CONTRACT_KEYS = ("version", "apiVersion", "kind", "id", "status", "name", "domain", "dataProduct", "tenant", "description", "schema", "servers", "team", "support", "roles", "slaProperties", "tags")
_PROPERTY = r"^/schema/\*/(properties/\*/|items/)*(properties/\*|items)$"
#: The nodes that ``flatten_properties`` takes.
PROPERTIES = Places(r"/schema/\*(/properties/\*|/items)+", r"|/schema(/\*(/properties/\*|/items)*(/properties)?)?", ("way", "keys"), ("properties", "items"))


def contract_catalogue(nodes: DataFrame) -> DataFrame:
    """One row for each document: identity columns, schema names and counts, property count, keys outside the model."""
    one = lambda key: F.max(F.when((F.col("depth") == 1) & (F.col("key") == key) & (F.col("kind") == "string"), F.col("sval"))).alias(key)
    name = F.when((F.col("rule_path") == "/schema/*/name") & (F.col("kind") == "string"), F.struct("seq", "sval"))
    other = F.when((F.col("depth") == 1) & ~F.col("key").isin(list(CONTRACT_KEYS)), F.struct("key", F.coalesce("sval", F.col("kind")).alias("value")))
    rows = nodes.groupBy("doc_id").agg(
        *(one(k) for k in ("id", "name", "version", "status", "domain")),
        F.count_if(F.col("rule_path") == "/schema/*").alias("schema_count"),
        F.count_if(F.col("rule_path").rlike(r"^/schema/\*/properties/\*$")).alias("property_count"),
        F.transform(F.sort_array(F.collect_list(name)), lambda x: x["sval"]).alias("schema_names"),
        F.map_from_entries(F.array_sort(F.collect_list(other))).alias("extra"),
    )
    return rows.withColumn("is_multi_table", F.col("schema_count") > 1)


def flatten_properties(nodes: DataFrame) -> DataFrame:
    """Every property of every schema object, nested ones too: doc_id, pointer, path, flags.

    The path starts with the schema object's name; array items are ``[]``.  ``nodes`` are
    those at PROPERTIES: a property says what it and those above it are called, and whether
    it has others, so nothing is joined.
    """
    own = nodes.where((F.col("kind") == "object") & F.col("rule_path").rlike(_PROPERTY))
    said, rule = F.split("way", "/"), F.split("rule_path", "/")
    step = lambda way, token: F.when(token == "*", pointer_unescape(way)).when(token == "items", "[]")
    steps = F.filter(F.zip_with(said, rule, step), lambda s: s.isNotNull())
    has = lambda key: F.array_contains("keys", key)
    return own.select("doc_id", "pointer", "seq", F.array_join(steps, ".").alias("path"), has("properties").alias("is_object"), has("items").alias("is_array"), (has("properties") | has("items")).alias("has_nested"))


def primary_keys(nodes: DataFrame) -> DataFrame:
    """Primary-key properties of each schema object by position, those without one last in document order."""
    props = nodes.where(F.col("rule_path").rlike(r"^/schema/\*/properties/\*/(name|primaryKey|primaryKeyPosition)$"))
    each = props.groupBy("doc_id", F.col("parent").alias("pointer")).agg(
        F.max(F.when(F.col("key") == "name", F.col("sval"))).alias("name"), F.max(F.when((F.col("key") == "primaryKey") & (F.col("kind") == "boolean"), F.col("sval"))).alias("pk"), F.max(F.when(F.col("key") == "primaryKeyPosition", F.col("nval"))).alias("position"), F.min("seq").alias("seq")
    )
    order = F.struct(F.coalesce("position", F.lit(float("inf"))).alias("p"), "seq", "name")
    grouped = each.where("pk = 'true'").groupBy("doc_id", F.regexp_replace("pointer", r"/properties/\d+$", "").alias("schema")).agg(F.sort_array(F.collect_list(order)).alias("k"))
    return grouped.select("doc_id", "schema", F.transform("k", lambda x: x["name"]).alias("keys"))


def metric_view_sources(nodes: DataFrame) -> DataFrame:
    """Source tables of every metric view, its own first, joins depth-first: doc_id, position, source."""
    rows = nodes.where(F.col("rule_path").rlike(r"^/metricViews/\*/(joins/\*/)*source$") & (F.col("kind") == "string"))
    listed = rows.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("seq", "sval"))).alias("s"))
    return listed.select("doc_id", F.posexplode(F.transform("s", lambda x: x["sval"])).alias("position", "source"))


def high_risk(nodes: DataFrame) -> DataFrame:
    """Assets whose risk is classified high."""
    return nodes.where("pointer = '/risk/classification' and sval = 'high'").select("doc_id")


def compliance_by_framework(nodes: DataFrame) -> DataFrame:
    """For each framework, how many assets name it and how many do not comply."""
    parts = nodes.where(F.col("rule_path").isin("/compliance/frameworks/*/name", "/compliance/frameworks/*/status")).groupBy("doc_id", "parent").agg(F.max(F.when(F.col("key") == "name", F.col("sval"))).alias("framework"), F.max(F.when(F.col("key") == "status", F.col("sval"))).alias("status"))
    return parts.groupBy("framework").agg(F.count_distinct("doc_id").alias("assets"), F.count_distinct(F.when(F.col("status") == "non_compliant", F.col("doc_id"))).alias("non_compliant"))
