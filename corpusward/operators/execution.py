"""Running what documents declare over tables: metric views, constraints, quality rules, relationships."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusward.functions.lineage import stored
from corpusward.operators.measures import Lattice, aggregates, windowed


def _joined(tables: dict[str, DataFrame], view: dict) -> DataFrame:
    """Source, filter, then left joins, depth-first; ``on`` is an expression over names and aliases."""
    df = tables[view["source"]].alias("source")
    if view.get("filter"):
        df = df.where(view["filter"])

    def join(df: DataFrame, joins: list[dict]) -> DataFrame:
        for j in joins:
            right = tables[j["source"]].alias(j["name"])
            df = df.join(right, F.expr(j["on"]) if "on" in j else j["using"], "left")
            df = join(df, j.get("joins", []))
        return df

    return join(df, view.get("joins", []))


def _expressions(items: list[dict], names: list[str] | None = None) -> list[Column]:
    by = {i["name"]: i for i in items}
    return [F.expr(by[n]["expr"]).alias(n) for n in (names if names is not None else by)]


def evaluate_metric_view(tables: dict[str, DataFrame], view: dict, dims: list[str], measures: list[str]) -> DataFrame:
    """The chosen measures of a metric view, grouped by the chosen dimensions.

    Joins are left joins; Spark picks their kind by the size of the tables.
    """
    windowed = {m["name"] for m in view["measures"] if m.get("window")}
    if windowed & set(measures):
        return windowed_measures(tables, view, dims, measures)
    df = _joined(tables, view)
    return df.groupBy(*_expressions(view["dimensions"], dims)).agg(*_expressions(view["measures"], measures))


def windowed_measures(tables: dict[str, DataFrame], view: dict, dims: list[str], measures: list[str]) -> DataFrame:
    """Measures with a window: ``order`` (a dimension), ``range`` cumulative (also if absent) or unbounded, ``semiadditive`` last (also if absent) or first.

    The rows are aggregated once, to states of the dimensions and the order, and windows
    merge these (``measures.windowed``); measures without a window cover the rows of
    their own group.  Aggregates that cannot be merged are refused with ValueError.
    """
    spec = {m["name"]: (m.get("window") or [None])[0] for m in view["measures"]}
    exprs = {m["name"]: m["expr"] for m in view["measures"]}
    orders = {w["order"] for m in measures if (w := spec[m])}
    if len(orders) > 1:
        raise ValueError("windowed measures of one query share their order")
    if any(w and (w.get("range") or "cumulative") not in ("cumulative", "unbounded") for w in map(spec.get, measures)):
        raise ValueError("a window is cumulative or unbounded")
    if any(w and (w.get("semiadditive") or "last") not in ("last", "first") for w in map(spec.get, measures)):
        raise ValueError("a semiadditive window takes the last or the first value")
    order = orders.pop()
    lattice = Lattice(_joined(tables, view), {d["name"]: d["expr"] for d in view["dimensions"]}, {m: exprs[m] for m in measures}, [(*(d for d in dims if d != order), order)])
    return windowed(lattice, dims, measures, spec, order)


def materialize_views(tables: dict[str, DataFrame], view: dict) -> dict[str, DataFrame]:
    """Each declared materialisation: aggregated (dimensions and measures) or unaggregated (joined, filtered rows).

    The rows are read once for all aggregated views: states of the largest grains are
    written in the shared folder, and every view merges these.  Views with windows or with
    aggregates that cannot be merged are computed from the rows.
    """
    views = view.get("materialization", {}).get("materialized_views", [])
    exprs = {m["name"]: m["expr"] for m in view["measures"]}
    moving = {m["name"] for m in view["measures"] if m.get("window")}
    rows = _joined(tables, view)

    def merges(m: str) -> bool:
        try:
            return m not in moving and bool(aggregates(rows.sparkSession, exprs[m]))
        except ValueError:
            return False

    shared = [v for v in views if v["type"] == "aggregated" and all(map(merges, v["measures"]))]
    out = {}
    if shared:
        used = dict.fromkeys(m for v in shared for m in v["measures"])
        lattice = Lattice(rows, {d["name"]: d["expr"] for d in view["dimensions"]}, {m: exprs[m] for m in used}, [tuple(v["dimensions"]) for v in shared], stored)
        out = {v["name"]: lattice.view(v["dimensions"], v["measures"]) for v in shared}
    for v in views:
        if v["name"] not in out:
            out[v["name"]] = evaluate_metric_view(tables, view, v["dimensions"], v["measures"]) if v["type"] == "aggregated" else rows
    return out


def write_views(tables: dict[str, DataFrame], view: dict, folder: str, mode: str = "errorifexists") -> dict[str, DataFrame]:
    """``materialize_views``, written as Parquet tables ``folder``/name and read back."""
    out = {}
    for name, rows in materialize_views(tables, view).items():
        rows.write.mode(mode).parquet(f"{folder}/{name}")
        out[name] = rows.sparkSession.read.parquet(f"{folder}/{name}")
    return out


_BOUNDS = {"minimum": "<", "maximum": ">", "exclusiveMinimum": "<=", "exclusiveMaximum": ">="}


def _breaks(column: str, rule: str, value) -> Column:
    c = F.col(column)
    if rule == "required":
        return c.isNull()
    if rule == "pattern":
        return ~c.cast("string").rlike(value)
    if rule in ("minLength", "maxLength"):
        n = F.char_length(c.cast("string"))
        return n < value if rule == "minLength" else n > value
    return F.expr(f"`{column}` {_BOUNDS[rule]} {value!r}")


def check_constraints(df: DataFrame, properties: list[dict], name: str) -> DataFrame:
    """One row for each property and rule: object, property, rule, violations.

    Properties have name and any of required, unique, primaryKey with
    primaryKeyPosition, and logicalTypeOptions (minLength, maxLength, pattern, minimum,
    maximum, exclusive bounds).  Row rules are counted in one pass over the data; unique
    and the (composite) primary key count the rows beyond the first of each key, nulls
    left out for unique and counted as violations for the key.
    """
    rules = [(p["name"], r, v) for p in properties for r, v in ({"required": True} if p.get("required") else {}).items()]
    rules += [(p["name"], r, v) for p in properties for r, v in p.get("logicalTypeOptions", {}).items() if r in (*_BOUNDS, "pattern", "minLength", "maxLength")]
    found = []
    if rules:
        counts = df.agg(*(F.count_if(_breaks(*r)).alias(f"c{i}") for i, r in enumerate(rules)))
        rows = F.array(*(F.struct(F.lit(c).alias("property"), F.lit(r).alias("rule"), F.col(f"c{i}").alias("violations")) for i, (c, r, _) in enumerate(rules)))
        found.append(counts.select(F.inline(rows)))
    keys = [([p["name"]], "unique") for p in properties if p.get("unique")]
    composite = [p["name"] for p in sorted((p for p in properties if p.get("primaryKey")), key=lambda p: p.get("primaryKeyPosition", 1 << 31))]
    keys += [(composite, "primaryKey")] if composite else []
    for columns, rule in keys:
        full = reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in columns))
        groups = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n"))
        beyond = F.sum(F.when(full, F.col("_n") - 1).otherwise(F.col("_n") if rule == "primaryKey" else F.lit(0)))
        found.append(groups.agg(F.coalesce(beyond, F.lit(0)).cast("long").alias("violations")).select(F.lit(",".join(columns)).alias("property"), F.lit(rule).alias("rule"), "violations"))
    if not found:
        return df.sparkSession.createDataFrame([], "object string, property string, rule string, violations long")
    out = reduce(DataFrame.unionByName, found)
    return out.select(F.lit(name).alias("object"), "property", "rule", "violations")


_METRICS = {
    "rowCount": lambda r: F.count(F.lit(1)),
    "nullValues": lambda r: F.count_if(F.col(r["column"]).isNull()),
    "duplicateValues": lambda r: F.count(r["column"]) - F.count_distinct(r["column"]),
    "sql": lambda r: F.expr(r["query"]),
}


def _holds(value: Column, rule: dict) -> Column:
    checks = {
        "mustBe": lambda x: value == x,
        "mustNotBe": lambda x: value != x,
        "mustBeGreaterThan": lambda x: value > x,
        "mustBeGreaterOrEqualTo": lambda x: value >= x,
        "mustBeLessThan": lambda x: value < x,
        "mustBeLessOrEqualTo": lambda x: value <= x,
        "mustBeBetween": lambda x: (value >= x[0]) & (value <= x[1]),
        "mustNotBeBetween": lambda x: (value < x[0]) | (value > x[1]),
        "mustBeIn": lambda x: value.isin(list(x)),
        "mustNotBeIn": lambda x: ~value.isin(list(x)),
    }
    aliases = {"mustBeGreaterThanOrEqualTo": "mustBeGreaterOrEqualTo", "mustBeLessThanOrEqualTo": "mustBeLessOrEqualTo"}
    found = [checks[aliases.get(k, k)](v) for k, v in rule.items() if aliases.get(k, k) in checks]
    if not found:
        raise ValueError(f"quality rule {rule.get('name')} has no comparator")
    return reduce(lambda a, b: a & b, found)


def check_quality_rules(df: DataFrame, rules: list[dict]) -> DataFrame:
    """name, metric, value and passed of each rule, all measured in one aggregation.

    A rule has name, metric (rowCount, nullValues, duplicateValues, sql), column or query
    (an aggregate expression), and comparators, all of which must hold.
    """
    if not rules:
        return df.sparkSession.createDataFrame([], "name string, metric string, value double, passed boolean")
    counts = df.agg(*(_METRICS[r["metric"]](r).cast("double").alias(f"v{i}") for i, r in enumerate(rules)))
    rows = F.array(*(F.struct(F.lit(r["name"]).alias("name"), F.lit(r["metric"]).alias("metric"), F.col(f"v{i}").alias("value"), _holds(F.col(f"v{i}"), r).alias("passed")) for i, r in enumerate(rules)))
    return counts.select(F.inline(rows))


def check_relationships(tables: dict[str, DataFrame], relationships: list[dict], samples: int = 3) -> DataFrame:
    """Foreign keys: relationship, orphans (rows), sample (up to ``samples`` smallest keys, a report).

    ``from`` and ``to`` are ``table.column`` or lists of them, as many on both sides.  Keys
    with a null are left out.  Keys are counted before the join, so a hot key is one row.
    """
    out = []
    for r in relationships:
        left, right = ([x] if isinstance(x, str) else list(x) for x in (r["from"], r["to"]))
        if len(left) != len(right):
            raise ValueError("both sides of a relationship have as many columns")
        (t1, t2), a, b = (left[0].split(".")[0], right[0].split(".")[0]), [x.split(".")[1] for x in left], [x.split(".")[1] for x in right]
        keys = [f"_k{i}" for i in range(len(a))]
        from_ = tables[t1].select(*(F.col(c).alias(k) for c, k in zip(a, keys, strict=True))).dropna().groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        to = tables[t2].select(*(F.col(c).alias(k) for c, k in zip(b, keys, strict=True)))
        orphans = from_.join(to, keys, "left_anti")
        # Keys are distinct here, so buckets are even; each hands on its sum and its smallest keys.
        bucket = Window.partitionBy(F.pmod(F.xxhash64(*keys), F.lit(int(tables[t1].sparkSession.conf.get("spark.sql.shuffle.partitions")))))
        few = orphans.select(F.struct(*keys).alias("k"), F.row_number().over(bucket.orderBy(*keys)).alias("r"), F.sum("_n").over(bucket).alias("n")).where(F.col("r") <= max(samples, 1))
        smallest = F.slice(F.array_sort(F.collect_list("k")), 1, samples)
        out.append(few.agg(F.coalesce(F.sum(F.when(F.col("r") == 1, F.col("n"))), F.lit(0)).alias("orphans"), F.array_join(F.transform(smallest, lambda k: k.cast("string")), ";").alias("sample")).select(F.lit(f"{','.join(left)} -> {','.join(right)}").alias("relationship"), "orphans", "sample"))
    return reduce(DataFrame.unionByName, out)
