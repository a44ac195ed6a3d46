"""The query builder: immutable selects and writes. Every call gives a new query; nothing touches Spark
until the query is lowered (see sparrel.plans.lower) or run by a transaction."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import TYPE_CHECKING, Any, Self

from sparrel.errors import QueryCompilationError, QueryConstructionError, ValueRefusedError
from sparrel.model import Attr, Model
from sparrel.operators.expr import Aggregate, Assignment, JoinOn, Leaf, Order, Predicate, Scalar

if TYPE_CHECKING:
    from pyspark.sql import DataFrame, SparkSession


def is_leaf(x: Any) -> bool:
    return not isinstance(x, (Attr, Aggregate)) and isinstance(x, Leaf)


def _with(query: Any, **changes: Any) -> Any:
    """A copy with other fields; dataclasses.replace would look at each of them."""
    new = object.__new__(type(query))
    new.__dict__.update(query.__dict__)
    new.__dict__.update(changes)
    return new


def table_of(x: Any) -> str:
    """The table a field or operand belongs to."""
    return (x.attr.model if is_leaf(x) else x.model).table


def _count(n: Any, what: str) -> int:
    if not isinstance(n, int) or isinstance(n, bool) or n < 0:
        raise ValueRefusedError(f"{what} must be an int of 0 or more, not {n!r}")
    return n


def leaves(p: Predicate) -> Iterator[Predicate]:
    """The single conditions of a predicate."""
    if p.kind in ("and", "or", "not"):
        for x in p.values:
            yield from leaves(x)
    else:
        yield p


def subqueries(p: Predicate) -> Iterator[Select]:
    for leaf in leaves(p):
        for v in leaf.values:
            if isinstance(v, Select):
                yield v
            elif isinstance(v, Scalar):
                yield v.query


class _Shown:
    """repr never raises: an incomplete query says so."""

    def describe(self) -> str:
        raise NotImplementedError

    def sql(self) -> tuple[str, list[Any]]:
        """SQL text with a ? for each value, and the values. That of a select runs by
        spark.sql(text, args=values) where its tables are views."""
        from sparrel.operators.text import text_of

        return text_of(self, inline=False)

    def __repr__(self) -> str:
        try:
            return f"<{type(self).__name__} {self.describe()}>"
        except Exception as e:  # noqa: BLE001
            return f"<{type(self).__name__} incomplete: {e}>"

    def __str__(self) -> str:
        """SQL text with the values in it."""
        from sparrel.operators.text import text_of

        try:
            return text_of(self, inline=True)[0]
        except Exception as e:  # noqa: BLE001
            return f"incomplete: {e}"


class _Filtered(_Shown):
    """where() and all(), of which a query has exactly one."""

    predicates: tuple[Predicate, ...]
    whole: bool

    def _tables(self) -> set[str]:
        raise NotImplementedError

    def where(self, *predicates: Predicate) -> Self:
        """Conditions that rows must meet; repeated calls add more."""
        if self.whole:
            raise QueryConstructionError("all() and where() exclude each other")
        if not predicates:
            raise QueryConstructionError("where() needs a condition")
        for p in predicates:
            if not isinstance(p, Predicate):
                raise QueryConstructionError(f"{type(p).__name__} is no predicate")
            for leaf in leaves(p):
                if isinstance(leaf.operand, Aggregate):
                    raise QueryConstructionError("an aggregate can't stand in where(): use having()")
        return _with(self, predicates=(*self.predicates, *predicates))

    def all(self) -> Self:
        """Says that every row is meant."""
        if self.predicates:
            raise QueryConstructionError("all() and where() exclude each other")
        return _with(self, whole=True)

    def check_intent(self) -> None:
        if not self.predicates and not self.whole:
            raise QueryCompilationError("say which rows: where(...) or all()")


@dataclass(frozen=True, eq=False, repr=False)
class Join:
    model: type[Model]
    on: JoinOn
    how: str


@dataclass(frozen=True, eq=False, repr=False)
class Select(_Filtered):
    """A query of rows. shape: model (whole rows, of several tables when joined), value or tuple."""

    shape: str
    model: type[Model]
    fields: tuple[Any, ...] = ()
    joins: tuple[Join, ...] = ()
    predicates: tuple[Predicate, ...] = ()
    whole: bool = False
    is_distinct: bool = False
    keys: tuple[Attr, ...] = ()
    havings: tuple[Predicate, ...] = ()
    orders: tuple[Order, ...] = ()
    first: int | None = None
    skip: int | None = None

    @property
    def models(self) -> tuple[type[Model], ...]:
        return (self.model, *(j.model for j in self.joins))

    def tables(self) -> dict[str, type[Model]]:
        return {m.table: m for m in self.models}

    @property
    def grouped(self) -> bool:
        return bool(self.keys) or any(isinstance(f, Aggregate) for f in self.fields)

    def distinct(self) -> Select:
        return _with(self, is_distinct=True)

    def limit(self, n: int) -> Select:
        return _with(self, first=_count(n, "limit"))

    def offset(self, n: int) -> Select:
        return _with(self, skip=_count(n, "offset"))

    def order_by(self, *orders: Order) -> Select:
        for o in orders:
            if not isinstance(o, Order):
                raise QueryConstructionError("order_by() takes column.asc() and column.desc()")
            self._in_scope(o.operand)
            if isinstance(o.operand, Aggregate) and self.shape == "model":
                raise QueryConstructionError("whole rows aren't ordered by aggregates")
        return _with(self, orders=(*self.orders, *orders))

    def group_by(self, *columns: Attr) -> Select:
        if self.shape == "model":
            raise QueryConstructionError("whole rows aren't grouped: select columns")
        if not columns or not all(isinstance(c, Attr) for c in columns):
            raise QueryConstructionError("group_by() takes columns")
        for c in columns:
            self._in_scope(c)
        return _with(self, keys=(*self.keys, *columns))

    def having(self, *predicates: Predicate) -> Select:
        if self.shape == "model":
            raise QueryConstructionError("whole rows aren't grouped: select columns")
        if not predicates or not all(isinstance(p, Predicate) for p in predicates):
            raise QueryConstructionError("having() takes predicates")
        return _with(self, havings=(*self.havings, *predicates))

    def join(self, model: type[Model], *, on: JoinOn) -> Select:
        return self._join(model, on, "inner")

    def left_join(self, model: type[Model], *, on: JoinOn) -> Select:
        return self._join(model, on, "left")

    def _join(self, model: type[Model], on: JoinOn, how: str) -> Select:
        if not (isinstance(model, type) and issubclass(model, Model) and model.columns):
            raise QueryConstructionError("join() takes a model")
        if not isinstance(on, JoinOn):
            raise QueryConstructionError("on= takes column.references(column)")
        if model.table in self.tables():
            raise QueryConstructionError(f"{model.table} is in the query already")
        sides = {on.left.model.table, on.right.model.table}
        if model.table not in sides or len(sides) == 1:
            raise QueryConstructionError(f"on= must compare a column of {model.table} with one of a table joined before")
        if missing := sides - {model.table} - set(self.tables()):
            raise QueryConstructionError(f"{', '.join(missing)} isn't joined yet")
        return _with(self, joins=(*self.joins, Join(model, on, how)))

    def _in_scope(self, x: Any) -> None:
        if not (isinstance(x, (Attr, Aggregate)) or is_leaf(x)):
            raise QueryConstructionError(f"{type(x).__name__} is no column")

    def describe(self) -> str:
        self.check_intent()
        fields = ", ".join(map(str, (m.table + ".*" for m in self.models))) if self.shape == "model" else ", ".join(f.name for f in self.fields)
        parts = [f"select {'distinct ' if self.is_distinct else ''}{fields} from {self.model.table}"]
        parts += [f"{j.how} join {j.model.table} on {j.on.left!r} = {j.on.right!r}" for j in self.joins]
        parts += ["where " + " and ".join(map(show, self.predicates))] if self.predicates else []
        parts += ["group by " + ", ".join(map(repr, self.keys))] if self.keys else []
        parts += ["having " + " and ".join(map(show, self.havings))] if self.havings else []
        parts += ["order by " + ", ".join(f"{_name(o.operand)} {'desc' if o.descending else 'asc'}" for o in self.orders)] if self.orders else []
        parts += [f"limit {self.first}"] if self.first is not None else []
        parts += [f"offset {self.skip}"] if self.skip is not None else []
        return " ".join(parts)

    def to_df(self, source: Any) -> DataFrame:
        """The query as a lazy DataFrame. source: what gives a model's table, see sparrel.sources."""
        from sparrel.plans.lower import lower

        return lower(self, source)


def _name(x: Any) -> str:
    return repr(x) if isinstance(x, Attr) else x.name


def show(p: Predicate) -> str:
    """A predicate as text, for people."""
    if p.kind in ("and", "or"):
        return "(" + f" {p.kind} ".join(map(show, p.values)) + ")"
    if p.kind == "not":
        return f"not {show(p.values[0])}"
    values = ", ".join(f"({v.describe()})" if isinstance(v, Select) else f"({v.query.describe()})" if isinstance(v, Scalar) else _name(v) if isinstance(v, Attr | Aggregate) else repr(v) for v in p.values)
    return f"{_name(p.operand) + ' ' if p.operand is not None else ''}{p.kind}{' ' + values if values else ''}"


def select(*fields: Any) -> Select:
    """Whole rows of one model, or one or more columns, aggregates, scalars or leaves."""
    if not fields:
        raise QueryConstructionError("select() needs a model or columns")
    models = [f for f in fields if isinstance(f, type) and issubclass(f, Model)]
    if models:
        if len(fields) > 1:
            raise QueryConstructionError("select one model, or columns; further models come by join()")
        if not models[0].columns:
            raise QueryConstructionError("Model itself has no table")
        return Select("model", models[0])
    for f in fields:
        if not (isinstance(f, Attr | Aggregate | Scalar) or is_leaf(f)):
            raise QueryConstructionError(f"{f!r} can't be selected")
    anchor = next((f for f in fields if not isinstance(f, Scalar)), None)
    if anchor is None:
        raise QueryConstructionError("a scalar alone has no table to select from")
    model = anchor.attr.model if is_leaf(anchor) else anchor.model
    return Select("value" if len(fields) == 1 else "tuple", model, tuple(fields))


class _Returning(_Shown):
    model: type[Model]
    returned: tuple[Attr, ...] | None

    def returning(self, *columns: Attr) -> Self:
        """Give back the rows, or some of their columns, as they are after the statement (before it,
        for a delete)."""
        if self.returned is not None:
            raise QueryConstructionError("returning() is there already")
        for c in columns:
            if not isinstance(c, Attr) or c.model is not self.model:
                raise QueryConstructionError(f"{c!r} is no column of {self.model.table}")
        return _with(self, returned=tuple(columns))


@dataclass(frozen=True, eq=False, repr=False)
class Insert(_Returning):
    model: type[Model] | None
    rows: tuple[Model, ...]
    many: bool
    returned: tuple[Attr, ...] | None = None

    def describe(self) -> str:
        return f"insert {len(self.rows)} into {self.model.table if self.model else '?'}"


@dataclass(frozen=True, eq=False, repr=False)
class Update(_Returning, _Filtered):
    model: type[Model]
    assignments: tuple[Assignment, ...] = ()
    predicates: tuple[Predicate, ...] = ()
    whole: bool = False
    returned: tuple[Attr, ...] | None = None

    def set(self, *assignments: Assignment) -> Update:
        if not assignments:
            raise QueryConstructionError("set() takes column.to(value)")
        names = {a.attr.name for a in self.assignments}
        for a in assignments:
            if not isinstance(a, Assignment):
                raise QueryConstructionError("set() takes column.to(value)")
            if a.attr.model is not self.model:
                raise QueryConstructionError(f"only columns of {self.model.table} can be set")
            if a.attr.name in names:
                raise QueryConstructionError("a column is set twice")
            names.add(a.attr.name)
        return _with(self, assignments=(*self.assignments, *assignments))

    def check_intent(self) -> None:
        if not self.assignments:
            raise QueryCompilationError("nothing is set")
        super().check_intent()

    def describe(self) -> str:
        self.check_intent()
        return f"update {self.model.table} set {', '.join(f'{a.attr.name} = {a.value!r}' for a in self.assignments)}" + "".join(f" where {show(p)}" for p in self.predicates)


@dataclass(frozen=True, eq=False, repr=False)
class Delete(_Returning, _Filtered):
    model: type[Model]
    predicates: tuple[Predicate, ...] = ()
    whole: bool = False
    returned: tuple[Attr, ...] | None = None

    def describe(self) -> str:
        self.check_intent()
        return f"delete from {self.model.table}" + "".join(f" where {show(p)}" for p in self.predicates)


def insert(rows: Model | Sequence[Model]) -> Insert:
    many = not isinstance(rows, Model)
    if many and not isinstance(rows, Sequence):
        raise QueryConstructionError("insert() takes rows of a model")
    all_rows = tuple(rows) if many else (rows,)
    if any(not isinstance(r, Model) for r in all_rows):
        raise QueryConstructionError("insert() takes rows of a model")
    if any(r._fetched for r in all_rows):
        raise QueryConstructionError("fetched rows are in the table already")
    if len({type(r) for r in all_rows}) > 1:
        raise QueryConstructionError("rows of one model go together")
    from sparrel.types import PENDING_GENERATION

    if len({tuple(k for k, v in r._values.items() if v is PENDING_GENERATION) for r in all_rows}) > 1:
        raise QueryConstructionError("rows that go together leave the same columns to the store")
    return Insert(type(all_rows[0]) if all_rows else None, all_rows, many)


def _model(model: Any) -> type[Model]:
    if not (isinstance(model, type) and issubclass(model, Model) and model.columns):
        raise QueryConstructionError(f"{model!r} is no model")
    return model


def update(model: type[Model]) -> Update:
    return Update(_model(model))


def delete(model: type[Model]) -> Delete:
    return Delete(_model(model))
