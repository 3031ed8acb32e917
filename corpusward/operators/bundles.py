"""Conformance of knowledge bundles: rules on frontmatter, links, titles and derivation."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusward.functions.groups import MOST_NAMES, others_named, sharing
from corpusward.functions.lineage import cut, stored
from corpusward.functions.severity import findings
from corpusward.functions.text import bundle_relative, concept_id, link_targets
from corpusward.operators.report import merge_reports
from corpusward.sources.bundles import RESERVED, front

#: Fixed values, parameters of the format.
RECOMMENDED = ("title", "description", "tags")
LIFECYCLE = ("draft", "stable", "deprecated")
VERSION = "0.2"
_ISO = r"^\d{4}-\d{2}-\d{2}([Tt ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?([Zz]|[+-]\d{2}:?\d{2})?)?$"


def found(rows: DataFrame, code: str | Column, severity: str, message, seq=0) -> DataFrame:
    return findings(rows, doc_id=F.concat("bundle", F.lit("/"), "path"), spec_id="okf", severity=severity, code=code, message=message, pointer=F.col("concept_id"), seq=seq)


def _kind(path: str) -> Column:
    """The JSON type of a frontmatter value, null where it is absent."""
    return F.schema_of_variant(F.try_variant_get(F.try_parse_json("frontmatter_json"), f"$.{path}", "variant"))


def _blank(c: Column) -> Column:
    return c.isNull() | ~c.rlike(r"\S")


def iso_date(c: Column) -> Column:
    """Whether a string is an ISO-8601 date or date-time of the calendar."""
    return c.rlike(_ISO) & F.try_to_date(F.substring(c, 1, 10), "yyyy-MM-dd").isNotNull()


def parse_problems(concepts: DataFrame) -> DataFrame:
    """OKF001: the frontmatter does not parse."""
    return found(concepts.where("problem is not null"), "OKF001", "error", F.concat(F.lit("frontmatter does not parse: "), "problem"))


def bundle_problems(unreadable: DataFrame) -> DataFrame:
    """OKF900 for each bundle (``unreadable``: bundle, files) that could not be read whole."""
    return findings(unreadable, doc_id="bundle", spec_id="okf", severity="error", code="OKF900", message=F.concat("files", F.lit(" files cannot be read")))


def concept_type(concepts: DataFrame) -> DataFrame:
    """OKF002 [error] without a type, OKF003 [info] for white space around it."""
    t = front("type")
    return merge_reports(found(concepts.where(_blank(t)), "OKF002", "error", "has no type"), found(concepts.where(~_blank(t) & (F.trim(t) != t)), "OKF003", "info", "white space around the type"))


def recommended_keys(concepts: DataFrame, recommended: tuple[str, ...] = RECOMMENDED) -> DataFrame:
    """OKF004 for each recommended key that is absent."""
    missing = F.array_except(F.array(*map(F.lit, recommended)), F.coalesce("keys", F.array().cast("array<string>")))
    return found(concepts.select("*", F.posexplode(missing).alias("at", "missing")), "OKF004", "warning", F.concat(F.lit("lacks "), "missing"), F.col("at"))


def empty_bodies(concepts: DataFrame) -> DataFrame:
    """OKF005: a blank body."""
    return found(concepts.where(_blank(F.col("body"))), "OKF005", "warning", "the body is empty")


def tags_shape(concepts: DataFrame) -> DataFrame:
    """OKF006: tags are a string, a list with something else than strings, or another kind."""
    kind = _kind("tags")
    return found(concepts.where(kind.isNotNull() & ~kind.isin("ARRAY<STRING>", "ARRAY<VOID>", "VOID")), "OKF006", "warning", "tags are no list of strings")


def trust_events(concepts: DataFrame) -> DataFrame:
    """OKF101 to 103 for ``generated``; OKF104 for an empty ``verified``, 105 to 107 for each event of it."""
    there = F.array_contains("keys", "generated")
    event = F.array(*(F.struct(F.lit(c).alias("code"), b.alias("bad")) for c, b in (("OKF101", _blank(front("generated.by"))), ("OKF102", _blank(front("generated.at"))), ("OKF103", ~_blank(front("generated.at")) & ~iso_date(front("generated.at"))))))
    one = concepts.where(there).select("*", F.inline(event)).where("bad")
    events = F.from_json(front("verified"), "array<struct<by:string,at:string>>")
    listed = concepts.where(F.array_contains("keys", "verified")).withColumn("events", F.coalesce(events, F.array().cast("array<struct<by:string,at:string>>")))
    each = listed.select("*", F.posexplode("events").alias("at_", "e"))
    codes = F.array(*(F.struct(F.lit(c).alias("code"), b.alias("bad")) for c, b in (("OKF105", _blank(F.col("e.by"))), ("OKF106", _blank(F.col("e.at"))), ("OKF107", ~_blank(F.col("e.at")) & ~iso_date(F.col("e.at"))))))
    return merge_reports(found(one, F.col("code"), "warning", "generated is not complete"), found(listed.where(F.size("events") == 0), "OKF104", "warning", "verified is empty"), found(each.select("*", F.inline(codes)).where("bad"), F.col("code"), "warning", "an event is not complete", F.col("at_")))


def lifecycle(concepts: DataFrame) -> DataFrame:
    """OKF108 [info] for an unknown status, OKF109 for a stale_after that is no date; the clock is never asked."""
    status, stale = front("status"), front("stale_after")
    return merge_reports(found(concepts.where(status.isNotNull() & ~status.isin(list(LIFECYCLE))), "OKF108", "info", F.concat(F.lit("unknown status "), status)), found(concepts.where(stale.isNotNull() & ~iso_date(stale)), "OKF109", "warning", "stale_after is no date"))


def usage_window(concepts: DataFrame) -> DataFrame:
    """OKF110: a usage window without sources."""
    return found(concepts.where(F.array_contains("keys", "usage_window") & ~F.array_contains("keys", "sources")), "OKF110", "warning", "usage_window without sources")


_SOURCE = "id string, resource string, title string, author string, last_modified string"


def sources(concepts: DataFrame) -> DataFrame:
    """bundle, concept_id, path, at and the fields of each entry of ``sources``."""
    return concepts.select("bundle", "concept_id", "path", F.posexplode(F.from_json(front("sources"), f"array<struct<{_SOURCE.replace(' string', ':string')}>>")).alias("at", "s")).select("bundle", "concept_id", "path", "at", "s.*")


def footnotes(prose: DataFrame) -> DataFrame:
    """Distinct footnote labels of each concept, from references and definitions."""
    return prose.select("bundle", "concept_id", "path", F.explode(F.array_distinct(F.regexp_extract_all("prose", F.lit(r"\[\^([^\]\s]+)\]"), 1))).alias("id"))


def footnote_attribution(entries: DataFrame, notes: DataFrame) -> DataFrame:
    """OKF111: a footnote without a source; OKFL05: a source that no footnote cites."""
    keys = ["bundle", "concept_id", "id"]
    named = entries.where("id is not null")
    return merge_reports(found(notes.join(named, keys, "left_anti"), "OKF111", "warning", F.concat(F.lit("no source "), "id")), found(named.join(notes, keys, "left_anti"), "OKFL05", "warning", F.concat("id", F.lit(" is never cited")), F.col("at")))


def legacy_keys(concepts: DataFrame, lines: DataFrame) -> DataFrame:
    """OKF201: a ``timestamp`` key; OKF202: a top-level ``Citations`` section."""
    cited = lines.where((F.col("level") == 1) & F.col("text").rlike(r"^ {0,3}#\s+Citations\s*$")).select("bundle", "concept_id").distinct()
    return merge_reports(found(concepts.where(F.array_contains("keys", "timestamp")), "OKF201", "warning", "timestamp is a legacy key"), found(concepts.join(cited, ["bundle", "concept_id"], "left_semi"), "OKF202", "warning", "Citations is a legacy section"))


def attested_computations(concepts: DataFrame, lines: DataFrame) -> DataFrame:
    """OKF301 to 309 for concepts of type Attested Computation."""
    own = concepts.where(front("type") == "Attested Computation")
    inline = lines.where(F.col("text").rlike(r"^ {0,3}#\s+Computation\s*$")).select("bundle", "concept_id").distinct().withColumn("inline", F.lit(True))
    rows = own.join(inline, ["bundle", "concept_id"], "left")
    has = lambda k: F.array_contains("keys", k)
    block, path = F.coalesce("inline", F.lit(False)), ~_blank(front("computation"))
    checks = [
        ("OKF301", _blank(front("runtime"))), ("OKF304", ~has("executor")), ("OKF305", has("executor") & _blank(front("executor.resource"))),
        ("OKF306", ~has("attester")), ("OKF307", has("attester") & _blank(front("attester.resource"))), ("OKF308", ~block & ~path), ("OKF309", block & path),
    ]
    broken = rows.select("*", F.inline(F.array(*(F.struct(F.lit(c).alias("code"), b.alias("bad")) for c, b in checks)))).where("bad")
    parameters = rows.select("*", F.posexplode(F.from_json(front("parameters"), "array<struct<name:string,type:string>>")).alias("at", "p"))
    each = parameters.select("*", F.inline(F.array(F.struct(F.lit("OKF302").alias("code"), _blank(F.col("p.name")).alias("bad")), F.struct(F.lit("OKF303").alias("code"), _blank(F.col("p.type")).alias("bad"))))).where("bad")
    return merge_reports(found(broken, F.col("code"), "warning", "the computation is not complete"), found(each, F.col("code"), "warning", "a parameter is not complete", F.col("at")))


def resolve_resources(concepts: DataFrame, files: DataFrame) -> DataFrame:
    """OKF401: a bundle-relative resource that the bundle (``files``: bundle, path) lacks; others are not inspected."""
    named = F.concat(F.array(front("resource"), front("executor.resource"), front("attester.resource"), front("computation")), F.coalesce(F.transform(F.from_json(front("sources"), "array<struct<resource:string>>"), lambda s: s["resource"]), F.array().cast("array<string>")))
    asked = concepts.select("bundle", "concept_id", "path", F.posexplode(F.transform(named, bundle_relative)).alias("at", "target")).where("target is not null")
    there = files.select("bundle", F.col("path").alias("target"))
    return found(asked.join(there, ["bundle", "target"], "left_anti"), "OKF401", "warning", F.concat("target", F.lit(" is not in the bundle")), F.col("at"))


def links(prose: DataFrame) -> DataFrame:
    """bundle, concept_id, path, at, raw, target of each markdown link outside code."""
    return prose.select("bundle", "concept_id", "path", F.posexplode(link_targets(F.col("prose"), F.col("path"))).alias("at", "l")).select("bundle", "concept_id", "path", "at", "l.raw", "l.target")


def link_targets_findings(linked: DataFrame, concepts: DataFrame, files: DataFrame) -> DataFrame:
    """OKF402 [info] for each link to a concept that is not there, OKF403 once for each deprecated target, OKFL10 once for a link to itself.

    Distinct targets meet the concepts, so a page that all others link to is one row.
    """
    inside = linked.where("target is not null")
    there = files.select("bundle", F.col("path").alias("target"))
    pages = inside.where(F.col("target").endswith(".md"))
    missing = pages.select("bundle", "target").distinct().join(there, ["bundle", "target"], "left_anti")
    old = concepts.where(front("status") == "deprecated").select("bundle", F.col("path").alias("target"))
    once = pages.select("bundle", "concept_id", "path", "target").distinct()
    return merge_reports(
        found(pages.join(missing, ["bundle", "target"], "left_semi"), "OKF402", "info", F.concat("target", F.lit(" is not there")), F.col("at")),
        found(once.join(old, ["bundle", "target"], "left_semi"), "OKF403", "warning", F.concat("target", F.lit(" is deprecated"))),
        found(once.where(concept_id(F.col("target")) == F.col("concept_id")), "OKFL10", "warning", "links to itself"),
    )


def reserved_filenames(concepts: DataFrame, reserved: tuple[str, ...] = RESERVED) -> DataFrame:
    """OKF404: a concept in a reserved file."""
    return found(concepts.where(F.regexp_extract("path", "[^/]+$", 0).isin(list(reserved))), "OKF404", "error", "the file name is reserved")


def declared_versions(index: DataFrame, version: str = VERSION) -> DataFrame:
    """OKF405 [info]: a bundle whose own index.md declares another version in its frontmatter."""
    head = F.regexp_extract("body", r"(?sm)\A\ufeff?---[ \t]*\r?\n(.*?)^---[ \t]*\r?$", 1)
    declared = F.regexp_extract(head, r"(?m)^okf_version:[ \t]*['\"]?([^'\"\s#]+)", 1)
    rows = index.where((F.col("path") == "index.md") & (declared != "") & (declared != version)).withColumn("concept_id", F.lit(None).cast("string"))
    return found(rows, "OKF405", "info", F.concat(F.lit("declares version "), declared))


def display_title() -> Column:
    """The title, else the last segment of the id."""
    return F.coalesce(F.when(~_blank(front("title")), F.trim(front("title"))), F.regexp_extract("concept_id", "[^/]+$", 0))


def duplicate_titles(concepts: DataFrame, most_names: int = MOST_NAMES) -> DataFrame:
    """OKF406 on each concept whose title others of its bundle have, naming up to ``most_names`` of them and counting the rest."""
    own = concepts.select("bundle", "concept_id", "path", display_title().alias("title"))
    shared = own.join(sharing(own, ["bundle", "title"], "concept_id", most_names), ["bundle", "title"])
    return found(shared, "OKF406", "warning", F.concat(F.lit("shares its title with "), others_named(F.col("concept_id"), most_names)))


def derivation_edges(concepts: DataFrame) -> DataFrame:
    """bundle, a, b: concept ``a`` derives from the existing concept ``b`` of its bundle."""
    named = sources(concepts).select("bundle", F.col("concept_id").alias("a"), concept_id(bundle_relative(F.col("resource"))).alias("b")).where("b is not null").distinct()
    return named.join(concepts.select("bundle", F.col("concept_id").alias("b")), ["bundle", "b"], "left_semi").select("bundle", "a", "b")


def _peeled(edges: DataFrame) -> tuple[DataFrame, int]:
    """``edges`` without concepts that have no way in or no way out, taken off until none is left, and their number."""
    n = edges.count()
    while n:
        inner = edges.join(edges.select("bundle", F.col("a").alias("b")).distinct(), ["bundle", "b"], "left_semi").join(edges.select("bundle", F.col("b").alias("a")).distinct(), ["bundle", "a"], "left_semi")
        edges = cut(inner.select("bundle", "a", "b"))
        n, before = edges.count(), n
        if n == before:
            break
    return edges, n


def _smallest_before(edges: DataFrame, name: str) -> DataFrame:
    """bundle, v and, as ``name``, the smallest concept from which v is reached (itself included).

    Labels also take over the label of their label, which lies before them too, so long
    ways take few rounds.
    """
    labels = stored(edges.select("bundle", F.explode(F.array("a", "b")).alias("v")).distinct().withColumn("label", F.col("v")))
    while True:
        along = edges.select("bundle", F.col("a").alias("v"), F.col("b").alias("to")).join(labels, ["bundle", "v"]).select("bundle", F.col("to").alias("v"), "label", F.lit(None).cast("string").alias("own"))
        jumped = labels.select("bundle", F.col("label").alias("via"), "v").join(labels.select("bundle", F.col("v").alias("via"), "label"), ["bundle", "via"]).select("bundle", "v", "label", F.lit(None).cast("string").alias("own"))
        new = labels.withColumn("own", F.col("label")).unionByName(along).unionByName(jumped).groupBy("bundle", "v").agg(F.min("label").alias("label"), F.min("own").alias("own"))
        new = stored(new)  # a checkpoint would carry the rounds' constraints along, which grow
        labels = new.drop("own")
        if new.where("label < own").isEmpty():
            return labels.withColumnRenamed("label", name)


#: Edges of a bundle up to which its rings are found by one task, and steps of walks that one task takes.
IN_ONE_TASK, STEPS = 200_000, 20_000_000


def _reaching(edges: pd.DataFrame) -> pd.DataFrame:
    """v and ring of one bundle: the sets of concepts that reach each other, by one walk in depth without recursion."""
    after: dict[str, list[str]] = {}
    for a, b in zip(edges["a"], edges["b"], strict=True):
        after.setdefault(a, []).append(b)
    order, low, stack, held, out = {}, {}, [], set(), []
    for root in after:
        if root in order:
            continue
        order[root] = low[root] = len(order)
        stack.append(root)
        held.add(root)
        open_ = [(root, iter(after[root]))]
        while open_:
            v, rest = open_[-1]
            for w in rest:
                if w not in order:
                    order[w] = low[w] = len(order)
                    stack.append(w)
                    held.add(w)
                    open_.append((w, iter(after.get(w, ()))))
                    break
                if w in held:
                    low[v] = min(low[v], order[w])
            else:
                open_.pop()
                if open_:
                    low[open_[-1][0]] = min(low[open_[-1][0]], low[v])
                if low[v] == order[v]:
                    part = []
                    while True:
                        w = stack.pop()
                        held.discard(w)
                        part.append(w)
                        if w == v:
                            break
                    if len(part) > 1 or v in after.get(v, ()):
                        out += [(x, min(part)) for x in part]
    return pd.DataFrame(out, columns=["v", "ring"])


def derivation_rings(edges: DataFrame) -> DataFrame:
    """bundle, v, ring: each concept that derives from itself, and the smallest concept of its ring.

    A ring is a set of concepts that all reach each other.  No edge leaves a bundle, so
    bundles of up to IN_ONE_TASK edges are a task each; larger ones are dealt over tasks.
    """
    edges = cut(edges.select("bundle", "a", "b"))
    sizes = edges.groupBy("bundle").agg(F.count(F.lit(1)).alias("n"))
    small = edges.join(sizes.where(F.col("n") <= IN_ONE_TASK), "bundle", "left_semi")

    def task(key, rows: pd.DataFrame) -> pd.DataFrame:
        found = _reaching(rows)
        found.insert(0, "bundle", key[0])
        return found

    rings = small.groupBy("bundle").applyInPandas(task, "bundle string, v string, ring string")
    large = sizes.where(F.col("n") > IN_ONE_TASK)
    return rings if large.isEmpty() else rings.unionByName(_rings_over_tasks(edges.join(large, "bundle", "left_semi")))


def _rings_over_tasks(edges: DataFrame) -> DataFrame:
    """``derivation_rings`` of bundles of any size.

    A concept whose smallest concept before it and after it (``edges``: bundle, a, b) are
    the same lies in that one's ring; edges between concepts that differ in either lie in
    no ring.  What is left goes round again, each time without at least the smallest concept of each part.
    """
    edges, n = _peeled(cut(edges.select("bundle", "a", "b")))
    rings = edges.select("bundle", F.col("a").alias("v"), F.col("a").alias("ring")).limit(0)
    while n:
        marks = _smallest_before(edges, "before").join(_smallest_before(edges.select("bundle", F.col("b").alias("a"), F.col("a").alias("b")), "after"), ["bundle", "v"])
        marks = cut(marks)
        both = edges.join(marks.toDF("bundle", "a", "a1", "a2"), ["bundle", "a"]).join(marks.toDF("bundle", "b", "b1", "b2"), ["bundle", "b"]).where("a1 = b1 and a2 = b2")
        both = cut(both.select("bundle", "a", "b", "a1", "a2"))
        # A concept between two rings is alone and has no edge inside.
        rings = rings.unionByName(both.where("a1 = a2").select("bundle", F.explode(F.array("a", "b")).alias("v"), F.col("a1").alias("ring")).distinct())
        edges, n = _peeled(cut(both.where("a1 <> a2").select("bundle", "a", "b")))
    return rings


def _walks(after: dict[str, list[str]], start: str) -> list[list[str]]:
    """Walks from ``start`` back to it, one for each concept found that ``start`` comes after.

    Each concept is met once, by the walk that met it first: the concept put aside last
    is gone on from, and its successors are taken in order.
    """
    came, out, open_ = {}, [], [start]

    def way(v: str) -> list[str]:
        trail = [v]
        while v in came:
            v = came[v]
            trail.append(v)
        return trail[::-1]

    while open_:
        v = open_.pop()
        for w in after.get(v, ()):
            if w == start:
                out.append(way(v))
            elif w not in came:
                came[w] = v
                open_.append(w)
    return out


def derivation_walks(edges: DataFrame) -> DataFrame:
    """bundle, start, walk: every ring of derivation as the walk from its first concept back to it, one for each set of members.

    Walks stay within a set of concepts that reach each other.  Such a set's starts are dealt
    over tasks by STEPS; each task holds the edges of the set, and the members of one
    start's walks.
    """
    edges = edges.select("bundle", "a", "b").distinct()
    rings = cut(derivation_rings(edges))
    inner = edges.join(rings.toDF("bundle", "a", "ring"), ["bundle", "a"]).join(rings.toDF("bundle", "b", "ring"), ["bundle", "b", "ring"])
    sizes = inner.groupBy("bundle", "ring").agg(F.ceil(F.count(F.lit(1)) * F.count_distinct("a") / STEPS).cast("int").alias("parts"))
    dealt = inner.join(sizes, ["bundle", "ring"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("own", F.pmod(F.xxhash64("a"), "parts") == F.col("part"))

    def task(key, rows: pd.DataFrame) -> pd.DataFrame:
        after: dict[str, list[str]] = {}
        for a, b in sorted(zip(rows["a"], rows["b"], strict=True)):
            after.setdefault(a, []).append(b)
        seen, out = set(), []
        for start in sorted(set(rows.loc[rows["own"], "a"])):
            for walk in _walks(after, start):
                if (members := frozenset(walk)) not in seen:
                    seen.add(members)
                    out.append((key[0], start, len(out), walk))
        return pd.DataFrame(out, columns=["bundle", "start", "at", "walk"])

    found = dealt.select("bundle", "ring", "part", "a", "b", "own").groupBy("bundle", "ring", "part").applyInPandas(task, "bundle string, start string, at long, walk array<string>")
    members = F.sha2(F.to_json(F.array_sort("walk")), 256)
    return found.groupBy("bundle", members.alias("members")).agg(F.min(F.struct("start", "at", "walk")).alias("r")).select("bundle", "r.start", "r.walk")


def circular_derivation(concepts: DataFrame, most_names: int = MOST_NAMES) -> DataFrame:
    """OKF112 for each ring of derivation, located at the concept its walk starts from and naming up to ``most_names`` members in the order of the walk, then their number.

    Rings with the same members are one; ``derivation_walks`` lists all members.
    """
    walks = derivation_walks(derivation_edges(concepts))
    rows = walks.withColumnRenamed("start", "concept_id").join(concepts.select("bundle", "concept_id", "path"), ["bundle", "concept_id"])
    n = F.size("walk")
    more = F.when(n > most_names, F.concat(F.lit(" -> "), (n - most_names).cast("string"), F.lit(" more"))).otherwise("")
    return found(rows, "OKF112", "error", F.concat(F.lit("derives from itself: "), F.array_join(F.slice("walk", 1, most_names), " -> "), more))


def index_listings(index: DataFrame, concepts: DataFrame, files: DataFrame) -> DataFrame:
    """OKF407: an index names a file that is not there; OKFL09: no index names a concept."""
    listed = index.select("bundle", "path", F.posexplode(link_targets(F.col("body"), F.col("path"))).alias("at", "l")).select("bundle", "path", "at", F.col("l.target").alias("target")).where(F.col("target").endswith(".md"))
    there = files.select("bundle", F.col("path").alias("target"))
    stale = listed.join(there, ["bundle", "target"], "left_anti").withColumn("concept_id", F.lit(None).cast("string"))
    unnamed = concepts.join(listed.select("bundle", F.col("target").alias("path")).distinct(), ["bundle", "path"], "left_anti")
    return merge_reports(found(stale, "OKF407", "warning", F.concat("target", F.lit(" is not there")), F.col("at")), found(unnamed, "OKFL09", "warning", "no index names it"))
