"""Corpora of metadata documents derived from the star-schema tables.

Orders become data contracts, customers become data products, parts become registry
entries and events become findings; the documents are JSON texts that go the whole way
through parsing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusward.sources.documents import dealt
from corpusward.sources.tables import table


def event_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A finding for each event: purchases and clicks warn, errors are errors."""
    e = table(spark, sf_dir, "events")
    severity = F.when(F.col("event_type") == "error", "error").when(F.col("event_type").isin("purchase", "click"), "warning").otherwise("info")
    spec = F.element_at(F.array(*map(F.lit, ("odcs", "odps", "odcl", "okf"))), (F.col("event_id") % 4 + 1).cast("int"))
    rank = F.when(severity == "error", 2).when(severity == "warning", 1).otherwise(0)
    n = F.lit(None)
    return e.select(
        F.concat(F.lit("u-"), F.col("user_id").cast("string")).alias("doc_id"), spec.alias("spec_id"), severity.alias("severity"), rank.alias("severity_rank"), F.col("event_type").alias("code"), F.concat(F.lit("value "), F.floor("value").cast("string")).alias("message"),
        F.when(F.col("event_id") % 3 == 0, F.col("event_id") % 100).cast("int").alias("line"), F.when(F.col("event_id") % 6 == 0, F.col("event_id") % 10).cast("int").alias("column"), F.concat(F.lit("/spec/"), (F.col("event_id") % 7).cast("string"), F.lit("/x")).alias("pointer"),
        n.cast("string").alias("help"), F.when(F.col("event_id") % 5 == 0, "1.0").alias("spec_version"), F.when(F.col("event_id") % 10 == 0, "s").alias("section"), F.col("event_id").alias("seq"),
    )


def _json(**parts: Column) -> Column:
    """Members that are not null, as the inside of a JSON object."""
    return F.array_join(F.filter(F.array(*(F.concat(F.lit(f'"{k}":'), v) for k, v in parts.items())), lambda x: x.isNotNull()), ",")


def _text(c) -> Column:
    return F.concat(F.lit('"'), c if isinstance(c, Column) else F.lit(c), F.lit('"'))


def _choice(n: Column, *values: str | None) -> Column:
    out = F.lit(values[-1])
    for i, v in enumerate(values[:-1]):
        out = F.when(n == i, F.lit(v)).otherwise(out)
    return out


def contract_id(k: Column) -> Column:
    """Mostly its own key; every tenth that of another, some hundreds the same."""
    return F.concat(F.lit("c-"), F.when(k % 10 == 3, k - 1).when(k % 10 == 9, k - k % 1000).otherwise(k).cast("string"))


def contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and text of a data contract for each order; rows are dealt before they become texts, which are several times as large."""
    o = dealt(table(spark, sf_dir, "orders"), "o_orderkey")
    li = dealt(table(spark, sf_dir, "lineitem"), "l_orderkey").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice").alias("x"))
    items = li.groupBy("l_orderkey").agg(F.sort_array(F.collect_list("x")).alias("items"))
    rows = o.join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    k = F.col("o_orderkey")
    each = lambda f: F.concat(F.lit("["), F.array_join(F.transform(F.coalesce("items", F.array()), f), ","), F.lit("]"))
    servers = each(lambda x: F.concat(F.lit('{"id":"s'), (x["l_suppkey"] % 5).cast("string"), F.lit('","server":"x","type":"t"}')))
    properties = each(lambda x: F.concat(F.lit('{"id":"p'), (x["l_partkey"] % 50).cast("string"), F.lit('","name":"c'), x["l_linenumber"].cast("string"), F.lit('","logicalType":"integer","primaryKey":'), F.when(x["l_suppkey"] % 3 == 0, "true").otherwise("false"), F.lit(',"primaryKeyPosition":'), (x["l_partkey"] % 3 + 1).cast("string"), F.lit("}")))
    body = _json(
        apiVersion=F.when(F.col("o_orderpriority") == "1-URGENT", _text("v3.0.2")).otherwise(_text("v3.1.0")),
        kind=_text("DataContract"),
        id=F.when(k % 89 != 0, _text(contract_id(k))),
        status=_text(_choice(F.array_position(F.array(F.lit("F"), F.lit("O")), F.col("o_orderstatus")), "in-review", "retired", "active")),
        team=_choice(F.col("o_custkey") % 5, None, "null", '""', "{}", '{"name":"t"}'),
        description=_choice(k % 5, None, "null", '" "', "[]", '{"purpose":"p"}'),
        servers=servers,
        schema=F.concat(F.lit('[{"name":"t","properties":'), properties, F.lit("}]")),
    )
    text = F.concat(F.lit("{"), body, F.lit("}"))
    return rows.select(F.concat(F.lit("contracts/"), k.cast("string")).alias("doc_id"), F.when(k % 97 == 0, F.substring(text, F.lit(1), F.char_length(text) - 5)).otherwise(text).alias("text"))


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and text of a data product for each customer; planted faults by the customer's key."""
    c = dealt(table(spark, sf_dir, "customer"), "c_custkey")
    o = dealt(table(spark, sf_dir, "orders"), "o_custkey").groupBy("o_custkey").agg(F.sort_array(F.collect_list("o_orderkey")).alias("orders"))
    rows = c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left").withColumn("orders", F.coalesce("orders", F.array().cast("array<bigint>")))
    k = F.col("c_custkey")
    join = lambda a, f: F.concat(F.lit("["), F.array_join(F.transform(a, f), ","), F.lit("]"))
    inputs = join(F.col("orders"), lambda x: F.concat(F.lit('{"name":"i'), x.cast("string"), F.lit('","version":"1","contractId":"c-'), x.cast("string"), F.lit('"}')))
    nested = join(F.slice("orders", 1, 2), lambda x: F.concat(F.lit('{"id":"c-'), x.cast("string"), F.lit('","version":"1"}')))
    output = F.concat(F.lit('[{"name":"o"'), F.when(k % 6 != 0, ',"version":"1"').otherwise(""), F.coalesce(F.concat(F.lit(',"contractId":"c-'), F.get("orders", F.lit(0)).cast("string"), F.lit('"')), F.lit("")), F.lit(',"inputContracts":'), nested, F.lit("}]"))
    body = _json(
        apiVersion=F.when(k % 11 == 0, _text("v9.9.9")).otherwise(_text("v1.0.0")),
        kind=_text("DataProduct"),
        id=F.when(k % 13 == 0, k.cast("string")).otherwise(_text(F.concat(F.lit("p-"), k.cast("string")))),
        status=_text("active"),
        inputPorts=inputs,
        outputPorts=output,
        colour=F.when(k % 7 == 0, _text("red")),
        team=F.concat(F.lit('{"members":[{"username":"u","dateIn":"'), F.when(k % 17 == 0, "2024-13-45").otherwise("2024-01-02"), F.lit('"}]}')),
    )
    return rows.select(F.concat(F.lit("products/"), k.cast("string")).alias("doc_id"), F.concat(F.lit("{"), body, F.lit("}")).alias("text"))


def registry(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Registry entries from parts, artefacts (path, content) from documents."""
    docs = table(spark, sf_dir, "documents").where("doc_id is not null")
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    digests = docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("d")).groupBy("doc_id").agg(F.min("d").alias("d"))
    rows = p.join(digests, k == F.col("doc_id"), "left")
    digest = F.coalesce("d", F.sha2(k.cast("string"), 256))
    flipped = F.concat(F.when(digest.startswith("0"), "1").otherwise("0"), F.substring(digest, F.lit(2), F.lit(63)))
    null = F.lit(None).cast("string")
    entry = rows.select(
        F.concat(F.lit("r-"), F.when(k % 50 == 0, k - 1).otherwise(k).cast("string")).alias("id"), F.when(k % 31 != 0, F.concat(F.lit("n"), k.cast("string"))).alias("name"), F.when(k % 4 == 0, " 1.0 ").alias("version"),
        F.when(k % 7 != 0, F.when(k % 5 == 0, "http://h.org").otherwise("https://h.org")).alias("homepage"), F.when(k % 3 != 0, F.concat(F.lit("https://r.org/"), k.cast("string"))).alias("repository"), F.when(k % 6 != 0, "s").alias("steward"), F.when(k % 9 != 0, "l").otherwise(" ").alias("licence"),
        F.when(F.col("p_type").startswith("PROMO"), " Latest ").when(F.col("p_type").startswith("SMALL"), null).when(F.col("p_type").startswith("LARGE"), "").otherwise(F.concat(F.lit("v"), F.col("p_size").cast("string"))).alias("pinned_ref"),
        F.concat(F.when(k % 23 == 0, "/abs/").when(k % 29 == 0, "a/../").otherwise("docs/"), k.cast("string")).alias("vendored_path"), F.when(k % 11 == 0, flipped).when(k % 37 == 0, "xyz").otherwise(digest).alias("sha256"), F.when(k % 41 == 0, "2024-1-1").otherwise("2024-01-01").alias("fetched_at"),
        F.when(k % 2 == 0, "why").otherwise(" ").alias("notes"), F.when(k % 8 == 0, F.struct(F.when(k % 16 == 0, "ftp://p").otherwise("https://p").alias("endpoint"), F.lit("GET").alias("method"), null.alias("field"), null.alias("cadence"))).alias("poll"), k.cast("int").alias("idx"),
    )
    artefacts = docs.groupBy("doc_id").agg(F.min_by("text", F.sha2(F.coalesce("text", F.lit("")), 256)).alias("text")).select(F.concat(F.lit("docs/"), F.col("doc_id").cast("string")).alias("path"), F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    return entry, artefacts


def lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and text of an older contract for each customer; references of all kinds by the customer's key."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    reference = _choice(k % 6, "orders.id", "orders.missing", "orders.tags.x", "orders", "orders.nested.x", "other.id")
    ref = _choice(k % 5, "#/definitions/d", "#/definitions/p/q", "other.yaml#/x", "#", "#/definitions/no")
    fields = F.concat(
        F.lit('{"id":{"type":"text"},"tags":{"type":"array","items":{"type":"string"}},"nested":{"fields":{"x":{"type":"int"}}},"f1":{"type":"text","references":'), _text(reference), F.when(k % 8 == 0, ',"pii":true').otherwise(""), F.lit('},"f2":{"$ref":'), _text(ref), F.lit("}"), F.when(k % 3 == 0, ',"f3":{"description":"d"}').otherwise(""), F.lit("}"),
    )
    body = _json(
        dataContractSpecification=F.when(k % 4 == 0, _text("0.9.3")).otherwise(_text("1.2.1")),
        id=_text(F.concat(F.lit("l-"), k.cast("string"))),
        info=F.concat(F.lit('{"title":"t"'), F.when(k % 10 == 0, ',"status":"odd"').otherwise(',"status":"active"'), F.when(k % 9 == 0, "").otherwise(',"owner":"o"'), F.lit(',"description":"d"}')),
        servers=F.concat(F.lit('{"s":{"type":'), F.when(k % 2 == 0, _text("kafka")).otherwise(_text("files")), F.lit("}}")),
        models=F.concat(F.lit('{"orders":{"type":"table","fields":'), fields, F.lit("}}")),
        definitions=F.lit('{"d":{"type":"x"},"p/q":{"type":"y"}}'),
        zzz=F.when(k % 7 == 0, F.lit("1")),
    )
    return c.select(F.concat(F.lit("lexicon/"), k.cast("string")).alias("doc_id"), F.concat(F.lit("{"), body, F.lit("}")).alias("text"))


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and text of a compute asset for each supplier."""
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    frameworks = F.concat(F.lit('[{"name":"gdpr","status":"'), _choice(k % 3, "compliant", "non_compliant", "assessed"), F.lit('"},{"name":"sox","status":"'), _choice(k % 4, "non_compliant", "assessed", "compliant", "compliant"), F.lit('"}]'))
    body = _json(id=_text(F.concat(F.lit("a-"), k.cast("string"))), kind=_text("Application"), risk=F.concat(F.lit('{"classification":"'), _choice(k % 4, "high", "low", "medium", "minimal"), F.lit('"}')), compliance=F.concat(F.lit('{"frameworks":'), frameworks, F.lit("}")))
    return s.select(F.concat(F.lit("assets/"), k.cast("string")).alias("doc_id"), F.concat(F.lit("{"), body, F.lit("}")).alias("text"))


def views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and text of a metric-view document for each nation: views with nested joins."""
    n = table(spark, sf_dir, "nation")
    k = F.col("n_nationkey")
    inner = F.when(k % 2 == 0, ',"joins":[{"name":"j2","source":"region"}]').otherwise("")
    body = F.concat(F.lit('{"apiVersion":"v1","metricViews":[{"name":"v","source":"orders","joins":[{"name":"j1","source":"customer"'), inner, F.lit('},{"name":"j3","source":"part"}]},{"name":"w","source":"orders"}]}'))
    return n.select(F.concat(F.lit("views/"), k.cast("string")).alias("doc_id"), body.alias("text"))


def bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id (path) and text of knowledge bundles of up to a hundred concepts, one for each document, and their index files.

    Bundle b{doc_id div 100}, concept n/{k} with k = doc_id % 100; faults by k.  The
    documents' own words stand in the bodies as one line without markup.
    """
    docs = table(spark, sf_dir, "documents").where("doc_id is not null").groupBy("doc_id").agg(F.max("text").alias("own")).withColumn("k", F.expr("doc_id % 100"))
    # A column, since it is read twice; runs of letters and digits are found faster than what is between them is replaced.
    docs, words = docs.withColumn("words", F.array_join(F.regexp_extract_all("own", F.lit("[A-Za-z0-9]+"), 0), " ")), F.col("words")
    k = F.col("k")
    s = lambda c: c.cast("string")
    line = lambda test, text: F.when(test, text if isinstance(text, Column) else F.lit(text))
    derived = F.when((F.expr("k div 3") % 4 == 0) & (k % 3 == 2), k - 2).otherwise(k + 1)
    source = F.concat(F.lit('sources: [{"id": "s1", "resource": "n/'), s(derived), F.lit('.md", "author": "'), F.when(k % 6 == 0, "team:x").otherwise("human:a"), F.lit('"}]\n'))
    generated = _choice(k % 4, 'generated: {"by": "x"}\n', 'generated: {"by": "x", "at": "bad"}\n', 'generated: {"at": "2024-01-01T00:00:00Z"}\n', 'generated: {"by": "x", "at": "2024-01-01"}\n')
    head = F.concat_ws(
        "", F.lit("---\n"), line(k % 29 == 0, "status: stable\n"), F.when(k % 11 == 0, "").when(k % 13 == 0, 'type: " Note "\n').otherwise("type: Note\n"), F.concat(F.lit("title: t"), s(k % 30), F.lit("\n")), line(k % 7 != 0, "description: d\n"), F.concat(F.lit("tags: "), _choice(k % 5, "x", "[a, 1]", "{a: 1}", "[a, b]", "[a]"), F.lit("\n")),
        line(k % 29 != 0, F.concat(F.lit("status: "), F.when(k % 12 == 5, "deprecated").when(k % 12 == 6, "draft").when(k % 12 == 7, "odd").otherwise("stable"), F.lit("\n"))), F.concat(F.lit("stale_after: "), F.when(k % 17 == 0, "soon").otherwise("2024-01-01"), F.lit("\n")), generated, line(k % 14 == 0, "verified: []\n"), line(k % 14 == 1, 'verified: [{"by": "y"}, {"by": "z", "at": "2024-02-30"}]\n'),
        line(k % 10 != 9, source), line(k % 20 == 9, "usage_window: w\n"), line(k % 23 == 0, "timestamp: now\n"), F.lit("---\n"),
    )
    body = F.concat_ws(
        "", F.when(k % 8 == 3, "text\n").otherwise("# Top\ntext\n"), line(k % 16 == 4, "# Again\nmore\n"), line(k % 9 == 4, "### Deep\nx\n"), line(k % 10 == 6, "## Empty\n\n"), F.lit("see [next](/n/"), s(k + 1), F.lit(".md#a)"), line(k % 10 == 0, F.concat(F.lit(" [me]("), s(k), F.lit(".md)"))), line(k % 9 == 0, " [no](missing.md) [web](https://x.org/a.md)"),
        F.lit("\n"), line(k % 4 != 1, "cited[^s1]\n"), line(k % 15 == 2, "note[^zz]\n"), line(k % 6 == 1, "tail  \nok\ntail\t\n"), line(k % 5 == 2, "```json\n{\"a\": 1}\n```\n"), line(k % 5 == 3, "```json title\n{\"a\": }\n```\n"), line(k % 5 == 4, "~~~\n# not a heading [x](/nowhere.md)\n~~~\n"), line(k % 24 == 7, "# Citations\nc\n"),
        F.when(words != "", F.concat(F.lit("> "), words, F.lit("\n"))),
    )
    body = F.when(k % 40 == 39, " \n").otherwise(body)
    folder = F.concat(F.lit("b"), s(F.expr("doc_id div 100")))
    concepts = docs.select(F.concat(folder, F.lit("/n/"), s(k), F.when(k % 25 == 24, " x").otherwise(""), F.lit(".md")).alias("doc_id"), F.concat(head, body).alias("text"))
    entries = docs.where("k % 8 <> 0 and k % 25 <> 24").groupBy(folder.alias("b")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("k")), lambda x: F.concat(F.lit("- [c](n/"), x.cast("string"), F.lit(".md)"))), "\n").alias("t"))
    index = entries.select(F.concat("b", F.lit("/index.md")).alias("doc_id"), F.concat(F.lit("---\n"), F.when(F.col("b").endswith("3"), "okf_version: 0.1\n").otherwise("okf_version: \"0.2\"\n"), F.lit("---\n"), "t", F.lit("\n- [gone](/gone.md)\n")).alias("text"))
    return concepts.unionByName(index)


def workshops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id (path) and text of bundles of up to a hundred computations, one for each customer, an index and a log.

    Bundle w{k div 100}, concept c{k}; faults by the customer's key k.  Some texts are
    null, some have broken frontmatter, some lines end with a carriage return.
    """
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(k)
    line = lambda test, text: F.when(test, F.lit(text)).otherwise("")
    half = F.expr("c_custkey div 6 % 5")
    block = F.concat(F.lit("# Computation\n```"), _choice(half, "", "JSON", "json", "py", "sh"), F.lit("\n"), _choice(half, "x", "{}", "{", "x = 1", 'echo "'), F.lit("\n```\n"))
    other = F.expr("c_custkey div 4 % 4")
    more = F.concat(F.lit("# Other\n~~~"), _choice(other, "node", "yaml", "bash", "mermaid"), F.lit("\n"), _choice(other, "x", "a: [", "ls", "x"), F.lit("\n~~~\n"))
    text = F.concat(
        F.lit("---\n"), line(k % 50 == 9, "x: [\n"), F.lit("type: Attested Computation\n"), line(k % 2 == 0, "runtime: r\n"), line(k % 3 == 0, "executor: {resource: x}\n"), line(k % 3 == 1, "executor: {}\n"), line(k % 5 != 0, "attester: {resource: x}\n"), line(k % 7 == 0, "computation: c.sql\n"),
        line(k % 4 == 0, "parameters: [{name: a}, {type: t}]\n"), F.lit("---\n"), F.when(k % 6 == 0, block).otherwise("# Top\nplain\n"), F.when(k % 4 == 0, more).otherwise(""),
    )
    text = F.when(k % 100 == 57, F.lit(None)).when(k % 10 == 4, F.replace(text, F.lit("\n"), F.lit("\r\n"))).otherwise(text)
    folder = F.concat(F.lit("w"), F.expr("c_custkey div 100").cast("string"))
    concepts = rows.select(F.concat(folder, F.lit("/c"), k.cast("string"), F.lit(".md")).alias("doc_id"), text.alias("text"))
    own = rows.select(folder.alias("w"), F.expr("c_custkey div 100").alias("m")).distinct()
    index = own.select(F.concat("w", F.lit("/index.md")).alias("doc_id"), F.lit("# All\nokf_version: 9\n").alias("text"))
    log = own.select(F.concat("w", F.lit("/log.md")).alias("doc_id"), F.when(F.col("m") % 2 == 0, "---\ntype: Note\n---\nas a concept\n").otherwise("a log\n").alias("text"))
    return concepts.unionByName(index).unionByName(log)


def registries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and TOML text of registries of up to a hundred entries, one for each part; some unreadable, malformed or of another version."""
    k = F.col("p_partkey")
    entry = F.concat(F.lit('[[spec]]\nid = "r-'), k.cast("string"), F.lit('"\nname = "n"\nvendored_path = "p"\nsha256 = "'), F.sha2(k.cast("string"), 256), F.lit('"\nfetched_at = "2024-01-01"\n'), F.when(k % 3 == 0, 'poll = {endpoint = "https://p"}\n').otherwise(""), F.when(k % 700 == 0, "colour = 1\n").otherwise(""))
    rows = table(spark, sf_dir, "part").select(F.expr("p_partkey div 100").alias("m"), F.struct(k.alias("k"), entry.alias("t")).alias("e")).groupBy("m").agg(F.sort_array(F.collect_list("e")).alias("e"))
    m = F.col("m")
    text = F.concat(F.lit("schema_version = "), F.when(m % 5 == 3, "2").otherwise("1"), F.lit("\n"), F.when(m % 7 == 4, "name = \n").otherwise(""), F.array_join(F.transform("e", lambda x: x["t"]), ""))
    return rows.select(F.concat(F.lit("registries/"), m.cast("string")).alias("doc_id"), F.when(m % 11 == 5, F.lit(None)).otherwise(text).alias("text"))


def services(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and text of a whole compute asset for each part; faults against its schema by the part's key."""
    k = F.col("p_partkey")
    own = F.when(k % 2 == 0, F.concat(F.lit('{"role":"r","name":"n"}'))).otherwise('{"role":"r"}')
    body = _json(
        apiVersion=F.when(k % 5 == 0, _text("1.0")).otherwise(_text("v1.0")),
        kind=F.when(k % 7 == 0, _text("Robot")).otherwise(_text("AIModel")),
        id=_text(F.concat(F.lit("s-"), k.cast("string"))),
        name=F.when(k % 11 == 0, _text("ab")).otherwise(_text("name")),
        version=F.when(k % 3 != 0, _text("1")),
        status=_text("draft"),
        domainId=F.when(k % 13 == 0, _text("no uuid")).otherwise(_text("01234567-89ab-cdef-0123-456789abcdef")),
        sla=F.concat(F.lit('{"properties":[{"element":"e","unit":"u","value":'), F.when(k % 17 == 0, "true").when(k % 2 == 0, "1.5").otherwise('"x"'), F.lit("}]}")),
        team=F.concat(F.lit("["), own, F.lit("]")),
        createdAt=F.when(k % 19 == 0, _text("2024-02-30T00:00:00Z")).otherwise(_text("2024-02-28T00:00:00Z")),
        customProperties=F.lit('{"any":[1,{}]}'),
    )
    return dealt(table(spark, sf_dir, "part"), "p_partkey").select(F.concat(F.lit("services/"), k.cast("string")).alias("doc_id"), F.concat(F.lit("{"), body, F.lit("}")).alias("text"))


def orders_as_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and text: every order with a tag that holds a number beyond doubles' whole ones, its lines, and a number of 300 digits and more; dealt as ``contracts`` are."""
    o, k = dealt(table(spark, sf_dir, "orders"), "o_orderkey"), F.col("o_orderkey")
    line = F.format_string('{"b": [%d, {}], "a": %d}', F.col("l_partkey") % 2, F.col("l_suppkey") % 3)
    lines = dealt(table(spark, sf_dir, "lineitem"), "l_orderkey").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", line.alias("x")))), lambda x: x["x"]), ", ").alias("lines"))
    big = F.lit(9007199254740990) + k % 5
    tag = F.when(k % 2 == 0, F.format_string('{"big": %d, "kind": "%s"}', big, F.col("o_orderstatus"))).otherwise(F.format_string('{"kind": "%s", "big": %d}', F.col("o_orderstatus"), big))
    huge = F.concat(F.when(k % 7 == 0, "-").otherwise(""), F.lit("1"), F.repeat(F.lit("0"), F.lit(300) + (k % 40).cast("int")), F.when(k % 3 == 0, "7").otherwise("0"))
    return o.join(lines, "o_orderkey", "left").select(F.concat(F.lit("orders/"), k.cast("string")).alias("doc_id"), F.concat(F.lit('{"tag": '), tag, F.lit(', "lines": ['), F.coalesce("lines", F.lit("")), F.lit('], "huge": '), huge, F.lit("}")).alias("text"))


def events_as_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and JSON text of every event."""
    e = table(spark, sf_dir, "events").where("event_id is not null")
    s = lambda c: F.col(c).cast("string")
    user = F.concat(F.lit('"user": {"id": '), F.coalesce(s("user_id"), F.lit("null")), F.lit(', "tags/x": ["a", "'), F.coalesce("event_type", F.lit("")), F.lit('", []]}'))
    text = F.concat(F.lit('{"id": '), s("event_id"), F.lit(", "), user, F.lit(', "value": '), (F.col("event_id") % 1000).cast("string"), F.lit('.250, "even": '), F.when(F.col("event_id") % 2 == 0, "true").otherwise("false"), F.lit(', "servers": {"s'), (F.col("event_id") % 3).cast("string"), F.lit('": 1.0}}'))
    return e.select(F.concat(F.lit("events/"), s("event_id")).alias("doc_id"), text.alias("text"))


#: Corpora whose rows are dealt before they become texts.
DEALT = (contracts, products, services, orders_as_documents)
