"""Hygiene beyond the schema: what a valid document should still not do."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusward.functions.pointers import is_absent_or_empty
from corpusward.functions.severity import findings
from corpusward.operators.report import merge_reports

#: Fixed values.
STATUSES = ("proposed", "draft", "active", "deprecated", "retired")
#: Fixed values: (standard, pointer, code) of the sections that a document should have.
SECTIONS = [
    ("odcs", "/schema", "ODCS201"),
    ("odcs", "/servers", "ODCS202"),
    ("odcs", "/team", "ODCS203"),
    ("odcs", "/description", "ODCS204"),
    ("odps", "/outputPorts", "ODPS201"),
    ("odps", "/inputPorts", "ODPS202"),
    ("odps", "/team", "ODPS203"),
    ("odps", "/description", "ODPS204"),
    ("odps", "/version", "ODPS206"),
    ("odcl", "/models", "ODCL201"),
    ("odcl", "/servers", "ODCL202"),
    ("odcl", "/info/owner", "ODCL203"),
    ("odcl", "/info/description", "ODCL204"),
]
#: Keys that tell a field's shape.
SHAPES = ("type", "$ref", "fields", "items", "keys", "values", "enum")


@dataclass(frozen=True)
class Facts:
    """What a standard's schema says, read from it as data."""

    version: str
    root_keys: tuple[str, ...] = ()
    statuses: tuple[str, ...] | None = None  # None: STATUSES, but for odcl, whose schema has to list them
    deprecations: tuple[tuple[str, str], ...] = field(default=())  # (key, message)
    server_types: tuple[str, ...] = ()
    inert_dispatch: bool = False


def version_behind(nodes: DataFrame, facts: Facts, standard: str) -> DataFrame:
    """The declared version, where it is a string, differs from the carried one (200)."""
    key, want = ("dataContractSpecification", facts.version) if standard == "odcl" else ("apiVersion", f"v{facts.version}")
    rows = nodes.where((F.col("pointer") == f"/{key}") & (F.col("kind") == "string") & (F.col("sval") != want))
    return findings(rows, spec_id=standard, severity="warning", code=f"{standard.upper()}200", message=F.concat(F.lit("declares version "), "sval", F.lit(f", not {want}")), pointer=F.col("pointer"), seq=F.col("seq"))


def absent_sections(nodes: DataFrame, facts: Facts, standard: str) -> DataFrame:
    """Sections that are absent or empty (201 to 206), each at its pointer, also if it is absent."""
    rules = [(p, c) for s, p, c in SECTIONS if s == standard]
    # One row a document from the start: its sections are columns, and nothing is joined.
    filled = [F.max((F.col("pointer") == p) & ~F.coalesce(is_absent_or_empty(F.col("kind"), F.col("sval"), F.col("n_children")), F.lit(False))).alias(c) for p, c in rules]
    roots = nodes.where((F.col("depth") == 0) | F.col("pointer").isin([p for p, _ in rules])).groupBy("doc_id").agg(F.max((F.col("depth") == 0) & (F.col("kind") == "object")).alias("root"), *filled).where("root")
    lacking = F.array(*(F.when(~F.col(c), F.struct(F.lit(p).alias("section_pointer"), F.lit(c).alias("code"), F.lit(i).alias("order"))) for i, (p, c) in enumerate(rules)))
    rows = roots.select("doc_id", F.explode(F.filter(lacking, lambda w: w.isNotNull())).alias("w")).select("doc_id", "w.*")
    return findings(rows, spec_id=standard, severity="warning", code=F.col("code"), message=F.concat("section_pointer", F.lit(" is absent or empty")), pointer=F.col("section_pointer"), seq=F.col("order"))


def unconventional_status(nodes: DataFrame, facts: Facts, standard: str) -> DataFrame:
    """A string status outside the conventional ones (205); silent if the schema names none."""
    pointer = "/info/status" if standard == "odcl" else "/status"
    statuses = list(facts.statuses if facts.statuses is not None else () if standard == "odcl" else STATUSES)
    rows = nodes.where((F.col("pointer") == pointer) & (F.col("kind") == "string") & ~F.col("sval").isin(statuses) & F.lit(bool(statuses)))
    return findings(rows, spec_id=standard, severity="warning", code=f"{standard.upper()}205", message=F.concat(F.lit("status "), "sval", F.lit(" is not conventional")), pointer=F.col("pointer"), seq=F.col("seq"))


def duplicate_stable_ids(nodes: DataFrame, standard: str = "odcs") -> DataFrame:
    """A string id that an earlier member of the same array has (206), one finding for each repeat.

    Arrays: /servers, /schema, and every ``properties`` reached through properties and items.
    """
    array_path = r"^/(servers|schema|schema/\*/(properties/\*/|items/)*properties)$"
    ids = nodes.where("key = 'id' and kind = 'string'").select("doc_id", F.col("parent").alias("member"), F.col("sval").alias("id"), "seq")
    members = nodes.where(F.col("idx").isNotNull() & F.regexp_replace("rule_path", r"/\*$", "").rlike(array_path)).select("doc_id", F.col("pointer").alias("member"), F.col("parent").alias("array"), "idx")
    same = Window.partitionBy("doc_id", "array", "id").orderBy("idx")
    rows = members.join(ids, ["doc_id", "member"]).select("*", F.row_number().over(same).alias("n"), F.first("idx").over(same).alias("first")).where("n > 1")
    message = F.concat(F.lit("id "), "id", F.lit(" is that of member "), F.col("first").cast("string"))
    return findings(rows, spec_id=standard, severity="warning", code=f"{standard.upper()}206", message=message, pointer=F.concat("member", F.lit("/id")), seq=F.col("seq"))


def unknown_root_keys(nodes: DataFrame, facts: Facts) -> DataFrame:
    """Root keys that the schema does not list (ODCL206); silent if it lists none."""
    rows = nodes.where((F.col("depth") == 1) & F.col("key").isNotNull() & ~F.col("key").isin(list(facts.root_keys)) & F.lit(bool(facts.root_keys)))
    return findings(rows, spec_id="odcl", severity="warning", code="ODCL206", message=F.concat(F.lit("unknown key "), "key"), pointer=F.col("pointer"), seq=F.col("seq"))


_FIELD = r"^/models/\*/fields/\*((/fields/\*)|(/items)|(/keys)|(/values))*$"


def field_nodes(nodes: DataFrame) -> DataFrame:
    """Objects that are fields of models, nested ones included."""
    return nodes.where((F.col("kind") == "object") & F.col("rule_path").rlike(_FIELD))


def untyped_fields(nodes: DataFrame) -> DataFrame:
    """Fields that say nothing of their shape (ODCL207)."""
    shaped = nodes.where(F.col("key").isin(list(SHAPES))).select("doc_id", F.col("parent").alias("pointer"))
    rows = field_nodes(nodes).join(shaped, ["doc_id", "pointer"], "left_anti")
    return findings(rows, spec_id="odcl", severity="warning", code="ODCL207", message="the field has no type", pointer=F.col("pointer"), seq=F.col("seq"))


def deprecated_keywords(nodes: DataFrame, facts: Facts) -> DataFrame:
    """Keys that the schema calls deprecated, in fields and definitions (ODCL208)."""
    if not facts.deprecations:
        return findings(nodes.where(F.lit(False)), spec_id="odcl", severity="warning", code="ODCL208", message="")
    places = nodes.where((F.col("kind") == "object") & F.col("rule_path").rlike(_FIELD + r"|^/definitions/\*$")).select("doc_id", F.col("pointer").alias("parent"))
    message = F.coalesce(*(F.when(F.col("key") == k, F.lit(m)) for k, m in facts.deprecations))
    used = nodes.where(F.col("key").isin([k for k, _ in facts.deprecations]))
    rows = used.join(places, ["doc_id", "parent"], "left_semi")
    return findings(rows, spec_id="odcl", severity="warning", code="ODCL208", message=message, pointer=F.col("pointer"), seq=F.col("seq"))


def uninspected_servers(nodes: DataFrame, facts: Facts) -> DataFrame:
    """Servers whose type the schema dispatches on without effect (ODCL304, info)."""
    rows = nodes.where(F.lit(facts.inert_dispatch) & (F.col("rule_path") == "/servers/*/type") & (F.col("kind") == "string") & F.col("sval").isin(list(facts.server_types)))
    return findings(rows, spec_id="odcl", severity="info", code="ODCL304", message=F.concat(F.lit("server type "), "sval", F.lit(" is not inspected")), pointer=F.col("parent"), seq=F.col("seq"))


def hygiene(nodes: DataFrame, facts: Facts, standard: str) -> DataFrame:
    """All hygiene findings of one standard's documents."""
    found = [version_behind(nodes, facts, standard), absent_sections(nodes, facts, standard), unconventional_status(nodes, facts, standard)]
    if standard == "odcs":
        found.append(duplicate_stable_ids(nodes))
    if standard == "odcl":
        found += [unknown_root_keys(nodes, facts), untyped_fields(nodes), deprecated_keywords(nodes, facts), uninspected_servers(nodes, facts)]
    return merge_reports(*found)
