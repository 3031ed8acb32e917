"""Windowed measures and views against brute force over random rows, with nulls and ties."""

import random
from fractions import Fraction

import pytest

from corpusward.operators import execution, measures

ROWS = "g string, h string, month long, v long, w long, d decimal(12,2)"
AGGREGATES = {
    "count": ("count(v)", lambda rows: sum(r["v"] is not None for r in rows)),
    "rows": ("count(*)", len),
    "sum": ("sum(v)", lambda rows: _sum(r["v"] for r in rows)),
    "mean": ("avg(v)", lambda rows: _mean([r["v"] for r in rows])),
    "least": ("min(w)", lambda rows: min((r["w"] for r in rows if r["w"] is not None), default=None)),
    "most": ("max(w)", lambda rows: max((r["w"] for r in rows if r["w"] is not None), default=None)),
    "values": ("count(DISTINCT v)", lambda rows: len({r["v"] for r in rows} - {None})),
    "pairs": ("count(DISTINCT v, w)", lambda rows: len({(r["v"], r["w"]) for r in rows if None not in (r["v"], r["w"])})),
    "sum_values": ("sum(DISTINCT w)", lambda rows: _sum({r["w"] for r in rows})),
    "mean_values": ("avg(DISTINCT w)", lambda rows: _mean({r["w"] for r in rows})),
    "some": ("count(*) FILTER (WHERE v > 2 AND ')' <> '{0}')", lambda rows: sum(r["v"] is not None and r["v"] > 2 for r in rows)),
    "some_values": ("sum(DISTINCT v) FILTER (WHERE w = 1)", lambda rows: _sum({r["v"] for r in rows if r["w"] == 1})),
    "money": ("sum(d) * 2", lambda rows: None if (x := _sum(r["d"] for r in rows)) is None else 2 * x),
    "mixed": ("sum(v) + count(DISTINCT w) * 10", lambda rows: None if (x := _sum(r["v"] for r in rows)) is None else x + 10 * len({r["w"] for r in rows} - {None})),
    "if": ("count_if(w = 1)", lambda rows: sum(r["w"] == 1 for r in rows)),
    "every": ("bool_and(v >= 0)", lambda rows: None if all(r["v"] is None for r in rows) else all(r["v"] >= 0 for r in rows if r["v"] is not None)),
}


def _sum(values):
    values = [x for x in values if x is not None]
    return sum(values) if values else None


def _mean(values):
    values = [x for x in values if x is not None]
    return float(Fraction(sum(values), len(values))) if values else None


def some_rows(seed, n=60):
    from decimal import Decimal

    rng = random.Random(seed)
    pick = lambda *xs: rng.choice(xs)
    return [{"g": pick("a", "b", None), "h": pick("x", "y"), "month": pick(1, 2, 3, None), "v": pick(0, 1, 2, 3, 4, None), "w": pick(1, 2, None), "d": pick(Decimal("1.25"), Decimal("-3.10"), None)} for _ in range(n)]


def view_of(windows):
    return {
        "source": "t",
        "dimensions": [{"name": "g", "expr": "g"}, {"name": "h", "expr": "h"}, {"name": "at", "expr": "month"}],
        "measures": [{"name": n, "expr": e} | ({"window": [w]} if (w := windows.get(n)) else {}) for n, (e, _) in AGGREGATES.items()],
    }


def brute(rows, dims, windows):
    at = lambda r: (r["month"] is not None, r["month"] or 0)
    key = lambda r, ds: tuple(r["month"] if d == "at" else r[d] for d in ds)
    others = [d for d in dims if d != "at"]
    out = []
    for group in {key(r, dims) for r in rows}:
        row = []
        mine = [r for r in rows if key(r, dims) == group]
        whole = [r for r in rows if key(r, others) == key(mine[0], others)]
        for n, (_, f) in AGGREGATES.items():
            w = windows.get(n)
            if not w:
                used = mine
            elif w.get("range") == "unbounded":
                used = whole
            else:
                end = at(mine[0]) if "at" in dims else (min if w.get("semiadditive") == "first" else max)(map(at, whole))
                used = [r for r in whole if at(r) <= end]
            row.append(f(used))
        out.append((*group, *row))
    return out


def same(found, wanted):
    key = lambda r: tuple((x is None, str(x)) for x in r[:3])
    tidy = lambda x: round(x, 9) if isinstance(x, float) else x
    assert sorted((tuple(map(tidy, r)) for r in found), key=key) == sorted((tuple(map(tidy, r)) for r in wanted), key=key)


@pytest.mark.parametrize("dims", [["g", "at"], ["g"], ["at", "h", "g"], ["at"], []])
def test_random_windows(spark, dims):
    rng = random.Random(str(dims))
    rows = some_rows(len(dims))
    windows = {n: {"order": "at"} | rng.choice([{}, {"range": "cumulative"}, {"range": "unbounded"}]) | rng.choice([{}, {"semiadditive": "first"}, {"semiadditive": "last"}]) for n in AGGREGATES if rng.random() < 0.7}
    windows["values"] = {"order": "at"}
    found = execution.windowed_measures({"t": spark.createDataFrame([tuple(r.values()) for r in rows], ROWS)}, view_of(windows), dims, list(AGGREGATES))
    same(found.collect(), brute(rows, dims, windows))


def test_views_of_one_pass_are_those_of_their_own(spark):
    rows = some_rows(9, 80)
    views = [("all", []), ("g", ["g"]), ("gh", ["h", "g"]), ("at", ["at"])]
    view = view_of({}) | {"materialization": {"materialized_views": [{"name": n, "type": "aggregated", "dimensions": d, "measures": list(AGGREGATES)} for n, d in views]}}
    found = execution.materialize_views({"t": spark.createDataFrame([tuple(r.values()) for r in rows], ROWS)}, view)
    for name, dims in views:
        same(found[name].collect(), brute(rows, dims, {}))


def test_views_of_no_rows(spark):
    view = view_of({}) | {"materialization": {"materialized_views": [{"name": n, "type": "aggregated", "dimensions": d, "measures": ["rows", "sum", "values"]} for n, d in [("all", []), ("g", ["g"])]]}}
    found = execution.materialize_views({"t": spark.createDataFrame([], ROWS)}, view)
    assert [tuple(r) for r in found["all"].collect()] == [(0, None, 0)] and found["g"].collect() == []


def test_written_views(spark, tmp_path):
    view = view_of({}) | {"materialization": {"materialized_views": [{"name": "g", "type": "aggregated", "dimensions": ["g"], "measures": ["rows"]}, {"name": "rows", "type": "unaggregated"}]}}
    tables = {"t": spark.createDataFrame([tuple(r.values()) for r in some_rows(4)], ROWS)}
    execution.write_views(tables, view, str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/rows").count() == 60 and spark.read.parquet(f"{tmp_path}/g").agg({"rows": "sum"}).first()[0] == 60
    assert execution.write_views(tables, view, str(tmp_path), "overwrite")["rows"].count() == 60


@pytest.mark.parametrize("expr, name", [("stddev(v)", "stddev"), ("1 + percentile(v, 0.5)", "percentile"), ("sum(v) OVER ()", "OVER"), ("row_number()", "row_number"), ("approx_count_distinct(v)", "approx_count_distinct")])
def test_what_cannot_be_merged_is_refused_by_name(spark, expr, name):
    with pytest.raises(ValueError, match=name):
        measures.aggregates(spark, expr)


def test_expressions_are_read_by_the_parser(spark):
    template, calls = measures.aggregates(spark, "concat('sum(x', '{}') || COUNT( /* sum(y) */ *) / max(coalesce(`a)b`, greatest(1, 2))) FILTER (WHERE c = ')')")
    assert template.format("N", "M") == "concat('sum(x', '{}') || N / M"
    assert [(c.function, c.arguments, c.where) for c in calls] == [("count", ("1",), None), ("max", ("coalesce(`a)b`, greatest(1, 2))",), "c = ')'")]


def test_no_rules_no_rows_and_no_comparator_is_named(spark):
    df = spark.range(3)
    assert execution.check_constraints(df, [], "t").collect() == [] and execution.check_quality_rules(df, []).collect() == []
    with pytest.raises(ValueError, match="r1"):
        execution.check_quality_rules(df, [{"name": "r1", "metric": "rowCount"}])
