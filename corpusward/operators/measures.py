"""A lattice of mergeable states: every view and window of a metric view from one pass over its rows.

An aggregate is kept as states that can be merged: sums, counts, extremes, and the exact
set of values that a DISTINCT aggregate has seen.  One aggregation over the joined rows makes
``cells``, a row for each group of every grain that is needed and, for each DISTINCT
aggregate, for each of its values there.  Coarser groups and running windows merge cells;
the rows are not read again.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: How the states of an aggregate are made, merged and finished; other aggregates are refused.
_STATES = {
    "sum": (("sum", "sum"),),
    "count": (("count", "sum"),),
    "count_if": (("count_if", "sum"),),
    "min": (("min", "min"),),
    "max": (("max", "max"),),
    "avg": (("sum", "sum"), ("count", "sum")),
    "bool_and": (("bool_and", "min"),),
    "bool_or": (("bool_or", "max"),),
}
_SAME = {"mean": "avg", "every": "bool_and", "some": "bool_or", "any": "bool_or"}
_MERGE = {"sum": F.sum, "min": F.min, "max": F.max}


@dataclass(frozen=True)
class Aggregate:
    """One aggregate call: its function, arguments, and the condition of its FILTER clause."""

    function: str
    arguments: tuple[str, ...]
    distinct: bool
    where: str | None

    def sql(self, function: str | None = None, extra: str | None = None) -> str:
        conditions = [f"({c})" for c in (extra, self.where) if c]
        return f"{function or self.function}({', '.join(self.arguments)})" + (f" FILTER (WHERE {' AND '.join(conditions)})" if conditions else "")


def aggregates(spark: SparkSession, expr: str) -> tuple[str, list[Aggregate]]:
    """``expr`` with ``{i}`` in place of each aggregate call, and the calls.

    The expression is read by Spark's own parser, so literals, comments and nested calls are
    what they are in Spark.  An aggregate or window whose states cannot be merged raises
    ValueError with its name.
    """
    session = spark._jsparkSession.sessionState()
    text = lambda node: expr[node.origin().startIndex().get() : node.origin().stopIndex().get() + 1]
    found: list[tuple[int, int, Aggregate]] = []

    def each(children):
        for i in range(children.size()):
            yield children.apply(i)

    def walk(node) -> None:
        kind = node.getClass().getSimpleName()
        if kind.startswith("Window") or kind == "UnresolvedWindowExpression":
            raise ValueError("a measure's expression has a window of its own: OVER")
        if kind == "UnresolvedFunction":
            parts = [p.lower() for p in each(node.nameParts())]
            name = _SAME.get(parts[-1], parts[-1])
            if name in _STATES:
                where = node.filter().get() if node.filter().isDefined() else None
                start = node.origin().startIndex().get()
                # the parser puts arguments of its own, such as the 1 of count(*), where the call starts
                one = Aggregate(name, tuple(text(a) if a.origin().startIndex().get() > start else a.sql() for a in each(node.arguments())), bool(node.isDistinct()), None if where is None else text(where))
                if one.distinct and name in ("min", "max", "bool_and", "bool_or"):
                    one = Aggregate(name, one.arguments, False, one.where)
                if one.distinct and name == "count_if":
                    raise ValueError("an aggregate whose states cannot be merged: count_if(DISTINCT)")
                found.append((start, node.origin().stopIndex().get() + 1, one))
                return
            info = session.functionRegistry().lookupFunction(session.sqlParser().parseFunctionIdentifier(parts[-1]))
            if info.isDefined() and info.get().getGroup() in ("agg_funcs", "window_funcs"):
                raise ValueError(f"an aggregate whose states cannot be merged: {parts[-1]}")
        for child in each(node.children()):
            walk(child)

    walk(session.sqlParser().parseExpression(expr))
    out, at = "", 0
    for i, (start, end, _) in enumerate(sorted(found, key=lambda f: f[0])):
        out += expr[at:start].replace("{", "{{").replace("}", "}}") + f"{{{i}}}"
        at = end
    return out + expr[at:].replace("{", "{{").replace("}", "}}"), [a for _, _, a in sorted(found, key=lambda f: f[0])]


class Lattice:
    """The cells of some measures over some grains (tuples of dimensions) of joined rows.

    Grains that another one holds are rolled up from it, so cells have the largest grains
    alone.  ``cells`` is made by one aggregation; give ``kept`` to write it once where
    several results are taken from it.
    """

    def __init__(self, rows: DataFrame, dimensions: dict[str, str], measures: dict[str, str], grains: list[tuple[str, ...]], kept=lambda df: df):
        spark = rows.sparkSession
        self.parsed = {m: aggregates(spark, e) for m, e in measures.items()}
        self.calls = list(dict.fromkeys(a for _, calls in self.parsed.values() for a in calls))
        self.grains = [g for g in dict.fromkeys(tuple(sorted(g)) for g in grains) if not any(set(g) < set(o) for o in grains)]
        self.names = list(dict.fromkeys(d for g in self.grains for d in g))
        self.sets = [i for i, a in enumerate(self.calls) if a.distinct]
        # The types that Spark gives each call, which merged states are cast to.
        probe = rows.agg(F.count(F.lit(1)), *(F.expr(a.sql() if not a.distinct else a.sql().replace("(", "(DISTINCT ", 1)).alias(f"c{i}") for i, a in enumerate(self.calls)))
        self.types = {i: probe.schema[f"c{i}"].dataType for i in range(len(self.calls))}
        self.cells = kept(self._cells(rows, dimensions))

    def _states(self) -> dict[str, tuple[str, str]]:
        """Column -> (expression over rows, how it is merged) of all calls but the DISTINCT ones."""
        return {f"s{i}_{j}": (a.sql(function, "`_set` = 0"), merge) for i, a in enumerate(self.calls) if not a.distinct for j, (function, merge) in enumerate(_STATES[a.function])}

    def _cells(self, rows: DataFrame, dimensions: dict[str, str]) -> DataFrame:
        kinds = [F.struct(F.lit(g).alias("g"), F.lit(s).alias("s")) for g in range(len(self.grains)) for s in [0, *(i + 1 for i in self.sets)]]
        dealt = rows.withColumn("_kind", F.explode(F.array(*kinds))).withColumn("_grain", F.col("_kind.g")).withColumn("_set", F.col("_kind.s"))
        keys = [F.when(F.col("_grain").isin([g for g, grain in enumerate(self.grains) if d in grain]), F.expr(dimensions[d])).alias(d) for d in self.names]
        values = []
        for i in self.sets:
            a = self.calls[i]
            # As in SQL, a value with a null among its parts does not count.
            there = " AND ".join([f"({x}) IS NOT NULL" for x in a.arguments] + ([f"({a.where})"] if a.where else []))
            parts = ", ".join(f"'p{j}', {x}" for j, x in enumerate(a.arguments))
            values.append(F.expr(f"CASE WHEN `_set` = {i + 1} AND {there} THEN named_struct({parts}) END").alias(f"v{i}"))
        states = [F.expr(e).alias(n) for n, (e, _) in self._states().items()]
        cells = dealt.groupBy("_grain", "_set", *keys, *values).agg(F.count(F.lit(1)).alias("_rows"), *states)
        return cells.where(reduce(lambda a, b: a | b, (F.col(f"v{i}").isNotNull() for i in self.sets), F.col("_set") == 0))

    def _level(self, dims: tuple[str, ...]) -> DataFrame:
        """Cells of a grain: one row for each group, and one for each value of each DISTINCT aggregate in it."""
        at = next((i for i, g in enumerate(self.grains) if set(dims) <= set(g)), None)
        if at is None:
            raise ValueError(f"no cells for {', '.join(dims)}")
        merges = [_MERGE[how](n).alias(n) for n, (_, how) in self._states().items()]
        return self.cells.where(F.col("_grain") == at).groupBy(*dims, "_set", *(f"v{i}" for i in self.sets)).agg(F.sum("_rows").alias("_rows"), *merges)

    def _values(self) -> list[Column]:
        """Counts and sums of the distinct values among rows of cells, as states."""
        out = []
        for i in self.sets:
            mine = F.col("_set") == i + 1
            out.append(F.count_if(mine).alias(f"d{i}_n"))
            if self.calls[i].function != "count":
                out.append(F.sum(F.when(mine, F.col(f"v{i}.p0"))).alias(f"d{i}_s"))
        return out

    def merged(self, dims: tuple[str, ...]) -> DataFrame:
        """One row for each group of ``dims`` with all states."""
        level = self._level(dims)
        plain = F.col("_set") == 0
        merges = [_MERGE[how](F.when(plain, F.col(n))).alias(n) for n, (_, how) in self._states().items()]
        return level.groupBy(*dims).agg(F.sum(F.when(plain, F.col("_rows"))).alias("_rows"), *merges, *self._values())

    def first_seen(self, dims: tuple[str, ...], order: str) -> DataFrame:
        """``dims``, ``order`` and states of the values that first appear at that ``order`` (null before all others) within ``dims``."""
        level = self._level((*dims, order)).where("_set > 0")
        seen = level.groupBy(*dims, "_set", *(f"v{i}" for i in self.sets)).agg(F.min(F.struct(F.col(order).isNotNull().alias("k"), F.col(order).alias("o"))).alias("_at"))
        return seen.select(*dims, F.col("_at.o").alias(order), "_set", *(f"v{i}" for i in self.sets)).groupBy(*dims, order).agg(*self._values())

    def states(self) -> dict[str, str]:
        """All states and how each is merged over groups whose values are different."""
        sets = {f"d{i}_{x}": "sum" for i in self.sets for x in ("n", "s") if x == "n" or self.calls[i].function != "count"}
        return {n: how for n, (_, how) in self._states().items()} | sets

    def measure(self, name: str, state=lambda n: n) -> Column:
        """The measure over merged states; ``state`` gives the column that holds each."""
        template, calls = self.parsed[name]
        parts = []
        for call in calls:
            i = self.calls.index(call)
            kind = self.types[i].simpleString()
            if call.distinct:
                n, s = f"`{state(f'd{i}_n')}`", f"`{state(f'd{i}_s')}`"
                value = {"count": f"coalesce({n}, 0)", "sum": s, "avg": f"({s} / nullif({n}, 0))"}[call.function]
            else:
                columns = [f"`{state(f's{i}_{j}')}`" for j in range(len(_STATES[call.function]))]
                value = f"({columns[0]} / nullif({columns[1]}, 0))" if call.function == "avg" else f"coalesce({columns[0]}, 0)" if call.function in ("count", "count_if") else columns[0]
            parts.append(f"cast({value} AS {kind})")
        return F.expr(template.format(*parts)).alias(name)

    def view(self, dims: list[str], measures: list[str]) -> DataFrame:
        """The measures by ``dims``; without dimensions one row, as in SQL also where there are no rows."""
        return self.merged(tuple(dims)).select(*dims, *(self.measure(m) for m in measures))


def windowed(lattice: Lattice, dims: list[str], measures: list[str], windows: dict[str, dict | None], order: str) -> DataFrame:
    """Measures with a window over ``order``, merged from states; others cover the rows of their own group.

    cumulative windows run from the first to the current value of ``order`` (null first),
    unbounded ones over all of a group.  A DISTINCT aggregate merges by where each value
    first appears.  Where ``order`` is not among ``dims``, the value at its last or first
    value is taken.  A task holds the distinct values of ``order`` of one group, streamed.
    """
    others = tuple(d for d in dims if d != order)
    grain = (*others, order)
    base, running = lattice.merged(grain), []
    states = dict(lattice.states())
    if lattice.sets:
        firsts = lattice.first_seen(others, order)
        fresh = [c for c in firsts.columns if c not in grain]
        firsts = firsts.select(*(F.col(g).alias(f"_{g}") for g in grain), *(F.col(c).alias(f"new_{c}") for c in fresh))
        same = reduce(lambda a, b: a & b, (F.col(g).eqNullSafe(F.col(f"_{g}")) for g in grain))
        base = base.join(firsts, same, "left")
    ranges = {(w or {}).get("range") or "cumulative" for m in measures if (w := windows[m])}
    frame = Window.partitionBy(*others)
    frames = {"cumulative": frame.orderBy(F.col(order).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow), "unbounded": frame}
    for r in sorted(ranges):
        for name, how in states.items():
            source = f"new_{name}" if name.startswith("d") else name
            running.append(_MERGE[how](source).over(frames[r]).alias(f"{r}_{name}"))
    rows = base.select(*grain, *states, *running)

    def column(m: str):
        w = windows[m]
        return (lambda n: n) if w is None else (lambda n: f"{w.get('range') or 'cumulative'}_{n}")

    if order in dims:
        return rows.select(*dims, *(lattice.measure(m, column(m)) for m in measures))
    own = [m for m in measures if windows[m] is None]
    at = F.struct(F.col(order).isNotNull(), F.col(order))
    pick = {"last": F.max_by, "first": F.min_by}
    held = rows.select(*others, order, *(F.struct(lattice.measure(m, column(m))).alias(m) for m in measures if windows[m] is not None))
    out = held.groupBy(*others).agg(*(pick[windows[m].get("semiadditive") or "last"](m, at)[m].alias(m) for m in measures if windows[m] is not None))
    if own:
        groups = lattice.view(list(others), own).select(*(F.col(o).alias(f"_{o}") for o in others), *own)
        out = out.join(groups, reduce(lambda a, b: a & b, (F.col(o).eqNullSafe(F.col(f"_{o}")) for o in others), F.lit(True)))
    return out.select(*others, *measures)
