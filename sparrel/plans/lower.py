"""From a query's state to a lazy DataFrame. Catalyst does the rest: pushdown, pruning, join strategies,
and the rewriting of subqueries into semi, anti and outer joins.

Every scan is aliased by its table name, which is unique in a query, so names can't clash. A column of an
enclosing query becomes an outer reference. Spark resolves those one level up only: a subquery that
reaches further gets the distinct outer keys it needs (its domain) as a table of its own, joined with
its tables, and the enclosing query compares with the keys (see _Domain). So does one with groups, LIMIT or
OFFSET, which then count for each key.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparrel.errors import QueryCompilationError
from sparrel.model import Attr
from sparrel.operators.expr import Aggregate, Predicate, Scalar
from sparrel.operators.query import Select, is_leaf, leaves, subqueries, table_of

_COMPARE = {"eq": "__eq__", "ne": "__ne__", "gt": "__gt__", "gte": "__ge__", "lt": "__lt__", "lte": "__le__"}


@dataclass
class Scope:
    """What names mean in one query: its own tables, keys of outer ones that it holds as its domain,
    and the query around it."""

    query: Select
    source: Any
    parent: Scope | None = None
    domain: dict[tuple[str, str], str] = field(default_factory=dict)
    aggregates: dict[tuple[str, str | None], str] = field(default_factory=dict)
    frame: DataFrame | None = None  # the domain's rows

    def column(self, attr: Attr) -> Column:
        table = attr.model.table
        if table in self.query.tables():
            return F.col(f"`{table}`.`{attr.name}`")
        if name := self.domain.get((table, attr.name)):
            return F.col(name)
        up = self.parent
        if up is not None and table in up.query.tables():
            return F.col(f"`{table}`.`{attr.name}`").outer()
        if up is not None and (name := up.domain.get((table, attr.name))):
            return F.col(name).outer()
        raise QueryCompilationError(f"{attr!r} belongs to no table of this query or one around it")

    def depth(self) -> int:
        return 0 if self.parent is None else 1 + self.parent.depth()

    def knows(self, table: str) -> bool:
        return table in self.query.tables() or self.parent is not None and self.parent.knows(table)


def conditions(query: Select) -> tuple[Predicate, ...]:
    return (*query.predicates, *query.havings)


def outer_columns(query: Select) -> dict[tuple[str, str], Attr]:
    """Columns of enclosing queries that a query or its subqueries name."""
    found: dict[tuple[str, str], Attr] = {}

    def add(x: Any) -> None:
        attr = x.attr if is_leaf(x) or isinstance(x, Aggregate) else x
        if isinstance(attr, Attr):
            found[(attr.model.table, attr.name)] = attr

    inner = [f.query for f in query.fields if isinstance(f, Scalar)]
    for f in query.fields:
        add(f)
    for p in conditions(query):
        for leaf in leaves(p):
            add(leaf.operand)
            for v in leaf.values:
                add(v)
        inner += subqueries(p)
    for q in inner:
        found |= outer_columns(q)
    return {k: a for k, a in found.items() if k[0] not in query.tables()}


def nested(query: Select) -> list[Select]:
    return [q for p in conditions(query) for q in subqueries(p)] + [f.query for f in query.fields if isinstance(f, Scalar)]


def far_columns(query: Select) -> dict[tuple[str, str], Attr]:
    """Outer columns that subqueries of this query name past it: Spark can't resolve those."""
    return {k: a for q in nested(query) for k, a in outer_columns(q).items() if k[0] not in query.tables()}


def check(query: Select, scope: Scope) -> None:
    """What the builder can't know before the query is whole."""
    query.check_intent()
    tables = query.tables()
    for f in (*query.fields, *(o.operand for o in query.orders), *query.keys):
        if not isinstance(f, Scalar) and table_of(f) not in tables:
            raise QueryCompilationError(f"{f.name} is of {table_of(f)}, which is not in this query")
    for p in conditions(query):
        for leaf in leaves(p):
            for x in (leaf.operand, *leaf.values):
                if isinstance(x, Attr | Aggregate) and not scope.knows(table_of(x)):
                    raise QueryCompilationError(f"{x.name} is of {table_of(x)}, which is not in this query or one around it")
    keys = {(k.model.table, k.name) for k in query.keys}
    if query.havings and not query.grouped:
        raise QueryCompilationError("having() needs group_by() or a selected aggregate")
    if query.grouped:
        bare = [f for f in (*query.fields, *(o.operand for o in query.orders)) if isinstance(f, Attr) or is_leaf(f)]
        bare += [x for p in query.havings for leaf in leaves(p) for x in (leaf.operand, *leaf.values) if (isinstance(x, Attr) or x is not None and is_leaf(x)) and table_of(x) in tables]
        for x in bare:
            attr = x if isinstance(x, Attr) else x.attr
            if (attr.model.table, attr.name) not in keys:
                raise QueryCompilationError(f"{x.name} is neither aggregated nor in group_by()")
    elif any(isinstance(o.operand, Aggregate) for o in query.orders):
        raise QueryCompilationError("an aggregate orders grouped queries only")


# operands and predicates


def operand(x: Any, scope: Scope, *, filtering: bool = True) -> Column:
    if isinstance(x, Attr):
        return scope.column(x)
    if isinstance(x, Aggregate):
        if (name := scope.aggregates.get((x.func, x.attr and repr(x.attr)))) is None:
            raise QueryCompilationError(f"{x.name} can't stand here")
        return F.col(name)
    if isinstance(x, Scalar):
        return scalar_column(x, scope)
    return x.to_column(scope.column(x.attr), filtering=filtering)


def literal(x: Any, value: Any) -> Column:
    from pyspark.sql import types as T

    value = x.operand_value(value)
    kind = x.attr.codec.spark if isinstance(x, Aggregate) and x.attr is not None and x.func != "count" else x.codec.spark if isinstance(x, Attr) else None
    if isinstance(kind, T.TimestampType | T.TimestampNTZType):
        # py4j would read a datetime in the driver's zone
        return F.lit(value.isoformat()).cast(kind)
    return F.lit(value)


def condition(p: Predicate, scope: Scope) -> Column:
    kind, x = p.kind, p.operand
    if kind in ("and", "or"):
        a, b = (condition(v, scope) for v in p.values)
        return a & b if kind == "and" else a | b
    if kind == "not":
        return ~condition(p.values[0], scope)
    if kind in ("exists", "not_exists"):
        found = member(p.values[0], scope, None)
        return found if kind == "exists" else ~found
    column = operand(x, scope)
    if kind in _COMPARE:
        return getattr(column, _COMPARE[kind])(literal(x, p.values[0]))
    if kind.endswith("_col"):
        return getattr(column, _COMPARE[kind[:-4]])(operand(p.values[0], scope))
    if kind == "between":
        return column.between(*(literal(x, v) for v in p.values))
    if kind in ("in", "not_in"):
        found = column.isin([literal(x, v) for v in p.values])
        return found if kind == "in" else ~found
    if kind in ("is_null", "is_not_null"):
        return column.isNull() if kind == "is_null" else column.isNotNull()
    if kind in ("like", "not_like"):
        found = column.like(p.values[0].replace("\\", "\\\\"))  # Spark's escape character, made ordinary
        return found if kind == "like" else ~found
    if kind in ("in_subquery", "not_in_subquery"):
        found = member(p.values[0], scope, column)
        return found if kind == "in_subquery" else ~found
    raise QueryCompilationError(f"predicate {kind} is unknown")


def conjunction(ps: tuple[Predicate, ...], scope: Scope) -> Column:
    return reduce(lambda a, b: a & b, (condition(p, scope) for p in ps))


# subqueries


def _parts(ps: tuple[Predicate, ...]) -> list[Predicate]:
    """Conditions that all must hold."""
    return [x for p in ps for x in (_parts(p.values) if p.kind == "and" else [p])]


def _tables_in(p: Predicate) -> set[str]:
    """Tables that a condition names; of its subqueries, those outside of them."""
    found = set()
    for leaf in leaves(p):
        for x in (leaf.operand, *leaf.values):
            if isinstance(x, Select | Scalar):
                found |= {k[0] for k in outer_columns(x if isinstance(x, Select) else x.query)}
            elif isinstance(x, Attr | Aggregate) and (not isinstance(x, Aggregate) or x.attr is not None) or x is not None and is_leaf(x):
                found.add(table_of(x))
    return found


class _Domain:
    """The distinct values of the outer columns that a subquery's own subqueries need, or that it needs
    itself if it has groups, LIMIT or OFFSET. The subquery is lowered with them as a table joined with its own; the
    enclosing query compares its columns with the names under which they come out. Rows that other conditions
    of the enclosing query exclude give no keys."""

    def __init__(self, query: Select, scope: Scope) -> None:
        far = far_columns(query)
        if far or query.keys or query.first is not None or query.skip is not None:
            far = outer_columns(query)
        # a name of its own on each level: the enclosing query may hold the same key
        self.names = {k: f"__{scope.depth()}__{k[0]}__{k[1]}" for k in far}
        tables = scope.query.tables()
        if any(k[0] not in tables and k not in scope.domain for k in far):
            raise QueryCompilationError("a subquery names a column of no query around it")
        self.frame = None
        if far:
            rows = scope.frame
            if any(k[0] in tables for k in far):
                rows = scanned(scope.query, scope, anew=True)
                own = [p for p in _parts(scope.query.predicates) if not list(subqueries(p)) and _tables_in(p) <= tables.keys()]
                rows = rows.where(conjunction(tuple(own), scope)) if own else rows
                if any(k in scope.domain for k in far):
                    rows, _ = _met(rows, scope.query, scope)
            self.frame = rows.select(*(scope.column(a).alias(self.names[k]) for k, a in far.items())).distinct()

    def matched(self, df: DataFrame, scope: Scope) -> DataFrame:
        """df, which holds the keys, for the outer row only."""
        for (table, column), name in self.names.items():
            around = scope.domain.get((table, column), f"`{table}`.`{column}`")
            df = df.where(F.col(name).eqNullSafe(F.col(around).outer()))
        return df


def _met(df: DataFrame, query: Select, scope: Scope) -> tuple[DataFrame, list[Predicate]]:
    """df joined with the domain of its query, and the conditions that are left. Where a subquery that must have
    a row names the keys, and is tied to this query by equal columns, the keys join there, on what it says of
    them, and come here by the equal columns; else they join here, on the conditions that name them. Only where none
    does (as under NOT) every row meets every key."""
    parts, own = _parts(query.predicates), query.tables()
    far = {k[0] for k in scope.domain}
    for p in parts:
        if p.kind not in ("exists", "in_subquery") or p.kind == "in_subquery" and not isinstance(p.operand, Attr):
            continue
        q = p.values[0]
        inner = q.tables()
        if q.grouped or q.havings or q.first is not None or q.skip is not None or far_columns(q):
            continue
        ties = [(p.operand, q.fields[0])] if p.kind == "in_subquery" else []
        if any(not isinstance(b, Attr) for _, b in ties):
            continue
        rest = []
        for x in _parts(q.predicates):
            sides = [x.operand, *x.values] if x.kind == "eq_col" else []
            mine = [y for y in sides if isinstance(y, Attr) and y.model.table in own]
            its = [y for y in sides if isinstance(y, Attr) and y.model.table in inner]
            if len(mine) == len(its) == 1:
                ties.append((mine[0], its[0]))
            else:
                rest.append(x)
        named = {(y.model.table, y.name) for x in rest for leaf in leaves(x) for y in (leaf.operand, *leaf.values) if isinstance(y, Attr)}
        if not ties or any(_tables_in(x) & own.keys() for x in rest) or not scope.domain.keys() <= named:
            continue
        within = Scope(q, scope.source, None, scope.domain)
        on = [x for x in rest if _tables_in(x) & far]
        if any(list(subqueries(x)) for x in on):
            continue
        before = tuple(x for x in rest if x not in on)
        rows = scanned(q, within, anew=True)
        rows = rows.where(conjunction(before, within)) if before else rows
        rows = rows.join(scope.frame, conjunction(tuple(on), within))
        rows = rows.select(*(within.column(b).alias(f"__tie{i}") for i, (_, b) in enumerate(ties)), *(F.col(n) for n in scope.domain.values())).distinct()
        df = df.join(rows, reduce(lambda a, b: a & b, (scope.column(a) == F.col(f"__tie{i}") for i, (a, _) in enumerate(ties))))
        return df, [x for x in parts if x is not p]
    on = [p for p in parts if _tables_in(p) & far and not list(subqueries(p))]
    if on:
        return df.join(scope.frame, conjunction(tuple(on), scope)), [p for p in parts if p not in on]
    return df.crossJoin(scope.frame), parts


def member(query: Select, scope: Scope, column: Column | None) -> Column:
    """EXISTS, or with a column IN."""
    if column is None and query.first and not query.skip:
        query = replace(query, first=None)  # whether there is a row doesn't depend on it
    domain = _Domain(query, scope)
    if domain.frame is None:
        df = lower(query, scope.source, scope)
        return df.exists() if column is None else column.isin(df)
    df = lower(query, scope.source, scope, domain)
    names = [c for c in df.columns if c not in domain.names.values()]
    df = domain.matched(df, scope)
    return df.exists() if column is None else column.isin(df.select(*(F.col(f"`{n}`") for n in names)))


def scalar_column(x: Scalar, scope: Scope) -> Column:
    query = x.query
    domain = _Domain(query, scope)
    if domain.frame is None:
        return lower(query, scope.source, scope).scalar()
    df = lower(query, scope.source, scope, domain)
    name = next(c for c in df.columns if c not in domain.names.values())
    value = F.col(f"`{name}`")
    # Spark wants to see that there is one row at most
    several = F.raise_error(F.lit("a scalar subquery has more than one row")).cast(df.schema[name].dataType)
    one = domain.matched(df, scope).select(F.when(F.count(F.lit(1)) > 1, several).otherwise(F.first(value)).alias("__one")).scalar()
    f = query.fields[0]
    # without rows in the domain there is no group, where a count would be 0
    counts = isinstance(f, Aggregate) and f.func == "count" and not query.keys and query.first != 0 and not query.skip
    return F.coalesce(one, F.lit(0)) if counts else one


# the query itself


def scanned(query: Select, scope: Scope, *, anew: bool = False) -> DataFrame:
    """FROM and JOIN. Whether a row of a left-joined table is there is told by a column of its own."""

    def table(model: Any) -> DataFrame:
        df = scope.source.table(model)
        if missing := [c for c in model.columns if c not in df.columns]:
            raise QueryCompilationError(f"{model.table} has no {', '.join(missing)}")
        df = df.select(*(F.col(f"`{c}`") for c in model.columns))
        if query.shape == "model" and not anew:
            df = df.withColumn(f"__{model.table}", F.lit(True))
        return df.alias(model.table)

    df = table(query.model)
    for j in query.joins:
        on = F.col(f"`{j.on.left.model.table}`.`{j.on.left.name}`") == F.col(f"`{j.on.right.model.table}`.`{j.on.right.name}`")
        df = df.join(table(j.model), on, j.how)
    return df


def _aggregate(a: Aggregate, scope: Scope) -> Column:
    if a.attr is None:
        return F.count(F.lit(1))
    return {"count": F.count, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}[a.func](scope.column(a.attr))


def output_names(query: Select) -> list[str]:
    """Names of the result's columns: those of fields, with the table before a name that repeats."""
    if query.shape == "model":
        return [c for c in query.model.columns] if not query.joins else [m.table for m in query.models]
    names: list[str] = []
    for f in query.fields:
        name = f.name if f.name not in names else f"{'scalar' if isinstance(f, Scalar) else table_of(f)}_{f.name}"
        names.append(name if name not in names else f"{name}_{len(names)}")
    return names


def lower(query: Select, source: Any, parent: Scope | None = None, domain: _Domain | None = None) -> DataFrame:
    """The query as a lazy DataFrame over source.table(model). With a domain its keys come out too."""
    scope = Scope(query, source, parent)
    if domain and domain.frame is not None:
        scope.domain, scope.frame = domain.names, domain.frame
    check(query, scope)
    kept = [F.col(n) for n in scope.domain.values()]
    df, predicates = scanned(query, scope), query.predicates
    if scope.domain:
        df, left = _met(df, query, scope)
        predicates = tuple(left)
    if predicates:
        df = df.where(conjunction(predicates, scope))

    if query.grouped:
        wanted = [f for f in (*query.fields, *(o.operand for o in query.orders)) if isinstance(f, Aggregate)]
        wanted += [x for p in query.havings for leaf in leaves(p) for x in (leaf.operand, *leaf.values) if isinstance(x, Aggregate) and table_of(x) in query.tables()]
        made = {}
        for a in wanted:
            made.setdefault((a.func, a.attr and repr(a.attr)), _aggregate(a, scope))
        names = {k: f"__a{i}" for i, k in enumerate(made)}
        keys = [*(scope.column(k) for k in dict.fromkeys(query.keys)), *kept]
        aggregates = [c.alias(names[k]) for k, c in made.items()]
        if made:
            df = df.groupBy(*keys).agg(*aggregates) if keys else df.select(*aggregates)
        else:
            # keys stay under their tables' names, as enclosing conditions name them
            df = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows"))
        scope.aggregates = names
        if query.havings:
            df = df.where(conjunction(query.havings, scope))

    if query.shape == "model":
        columns = _rows(query)
    else:
        columns = [operand(f, scope, filtering=False).alias(n) for f, n in zip(query.fields, output_names(query), strict=True)]
    if scope.domain and (query.first is not None or query.skip is not None):
        return _limited(df, query, scope, columns, kept)
    if query.is_distinct:
        df = df.select(*columns, *kept).distinct()
        df = df.orderBy(*_distinct_orders(query)) if query.orders else df
    else:
        if query.orders:
            df = df.orderBy(*(_ordered(operand(o.operand, scope, filtering=False), o.descending) for o in query.orders))
        df = df.select(*columns, *kept)
    if query.skip is not None:
        df = df.offset(query.skip)  # before the limit: LIMIT n OFFSET m
    return df.limit(query.first) if query.first is not None else df


def _limited(df: DataFrame, query: Select, scope: Scope, columns: list[Column], kept: list[Column]) -> DataFrame:
    """The selected columns with LIMIT and OFFSET for each key of the domain."""
    if query.is_distinct:
        df = df.select(*columns, *kept).distinct()
        orders = _distinct_orders(query) if query.orders else [F.lit(0)]
        columns = [F.col(f"`{n}`") for n in output_names(query)]
    else:
        orders = [_ordered(operand(o.operand, scope, filtering=False), o.descending) for o in query.orders] or [F.lit(0)]
    df = df.withColumn("__place", F.row_number().over(Window.partitionBy(*kept).orderBy(*orders)))
    first = query.skip or 0
    df = df.where(F.col("__place") > first)
    df = df.where(F.col("__place") <= first + query.first) if query.first is not None else df
    return df.select(*columns, *kept)


def _ordered(c: Column, descending: bool) -> Column:
    return c.desc_nulls_last() if descending else c.asc_nulls_first()


def _distinct_orders(query: Select) -> list[Column]:
    if query.shape == "model":
        if query.joins:
            return [_ordered(F.col(f"`{table_of(o.operand)}`.`{o.operand.name}`"), o.descending) for o in query.orders]
        fields = list(query.model.columns.values())
    else:
        fields = list(query.fields)
    names = output_names(query)
    out = []
    for o in query.orders:
        at = [n for f, n in zip(fields, names, strict=True) if f is o.operand or isinstance(f, Aggregate) and isinstance(o.operand, Aggregate) and (f.func, f.attr) == (o.operand.func, o.operand.attr)]
        if not at:
            raise QueryCompilationError("a distinct query is ordered by what it selects")
        out.append(_ordered(F.col(f"`{at[0]}`"), o.descending))
    return out


def _rows(query: Select) -> list[Column]:
    """Whole rows: the columns of one table, or a struct for each of several tables, null where a left
    join found no row."""
    of = lambda m: [F.col(f"`{m.table}`.`{c}`") for c in m.columns]
    if not query.joins:
        return of(query.model)
    return [F.when(F.col(f"`{m.table}`.`__{m.table}`"), F.struct(*of(m))).alias(m.table) for m in query.models]
