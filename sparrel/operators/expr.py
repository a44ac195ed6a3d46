"""The expression tree: predicates, aggregates, orders, join conditions, scalars and assignments.

Nodes are plain frozen values. They know nothing of Spark; sparrel.plans.lower turns them into columns.
Further leaves take part by the Leaf protocol.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import TYPE_CHECKING, Any, Protocol, runtime_checkable

from sparrel.errors import QueryConstructionError, ValueRefusedError

if TYPE_CHECKING:
    from pyspark.sql import Column

    from sparrel.operators.query import Select


@runtime_checkable
class Leaf(Protocol):
    """An operand of one's own: something over a column that becomes a Spark column.

    attr is the column it is over (for scope checks). to_column gets that column as Spark's and
    whether it stands in a filter, where bad values should be no match instead of a failure."""

    attr: Any

    def to_column(self, column: Column, *, filtering: bool) -> Column: ...

    def decode(self, value: Any) -> Any: ...


def _given(value: Any) -> Any:
    if value is None:
        raise ValueRefusedError("None compares with nothing: use is_null() or is_not_null()")
    return value


class Comparable:
    """What columns, aggregates and leaves are compared with."""

    def eq(self, value: Any) -> Predicate:
        return Predicate("eq", self, (_given(value),))

    def ne(self, value: Any) -> Predicate:
        return Predicate("ne", self, (_given(value),))

    def gt(self, value: Any) -> Predicate:
        return Predicate("gt", self, (_given(value),))

    def gte(self, value: Any) -> Predicate:
        return Predicate("gte", self, (_given(value),))

    def lt(self, value: Any) -> Predicate:
        return Predicate("lt", self, (_given(value),))

    def lte(self, value: Any) -> Predicate:
        return Predicate("lte", self, (_given(value),))

    def between(self, low: Any, high: Any) -> Predicate:
        """Both ends included; low over high is allowed and matches nothing."""
        return Predicate("between", self, (_given(low), _given(high)))

    def is_null(self) -> Predicate:
        return Predicate("is_null", self)

    def is_not_null(self) -> Predicate:
        return Predicate("is_not_null", self)

    def in_(self, *values: Any) -> Predicate:
        return Predicate("in", self, self._several(values))

    def not_in(self, *values: Any) -> Predicate:
        return Predicate("not_in", self, self._several(values))

    @staticmethod
    def _several(values: tuple) -> tuple:
        if not values:
            raise ValueRefusedError("a list of values can't be empty")
        return tuple(_given(v) for v in values)

    def _beside(self, kind: str, other: Any) -> Predicate:
        if not isinstance(other, (Comparable, Scalar)):
            raise ValueRefusedError(f"{kind}_col() compares with a column or scalar(), not {type(other).__name__}")
        return Predicate(f"{kind}_col", self, (other,))

    def eq_col(self, other: Any) -> Predicate:
        return self._beside("eq", other)

    def ne_col(self, other: Any) -> Predicate:
        return self._beside("ne", other)

    def gt_col(self, other: Any) -> Predicate:
        return self._beside("gt", other)

    def gte_col(self, other: Any) -> Predicate:
        return self._beside("gte", other)

    def lt_col(self, other: Any) -> Predicate:
        return self._beside("lt", other)

    def lte_col(self, other: Any) -> Predicate:
        return self._beside("lte", other)

    def in_subquery(self, query: Select) -> Predicate:
        return Predicate("in_subquery", self, (one_column(query),))

    def not_in_subquery(self, query: Select) -> Predicate:
        """NOT IN of three-valued logic: a null in the subquery matches nothing."""
        return Predicate("not_in_subquery", self, (one_column(query),))

    def asc(self) -> Order:
        return Order(self, False)

    def desc(self) -> Order:
        return Order(self, True)


def one_column(query: Any) -> Any:
    from sparrel.operators.query import Select

    if not isinstance(query, Select) or query.shape == "model" or len(query.fields) != 1:
        raise QueryConstructionError("a select of exactly one column is needed here")
    return query


@dataclass(frozen=True, eq=False)
class Predicate:
    """A condition. Combine with &, | and ~."""

    kind: str
    operand: Any = None
    values: tuple = ()

    def __and__(self, other: Predicate) -> Predicate:
        return Predicate("and", None, (self, self._other(other)))

    def __or__(self, other: Predicate) -> Predicate:
        return Predicate("or", None, (self, self._other(other)))

    def __invert__(self) -> Predicate:
        return Predicate("not", None, (self,))

    def __bool__(self) -> bool:
        raise TypeError("a predicate has no truth value: use &, | and ~ instead of and, or and not")

    @staticmethod
    def _other(other: Any) -> Predicate:
        if not isinstance(other, Predicate):
            raise QueryConstructionError(f"{type(other).__name__} is no predicate")
        return other


@dataclass(frozen=True, eq=False)
class Aggregate(Comparable):
    """count, sum, avg, min or max of a column; attr None counts rows of `model`."""

    func: str
    attr: Any
    model: Any

    @property
    def name(self) -> str:
        return f"{self.func}_{self.attr.name}" if self.attr is not None else "count_all"

    def decode(self, value: Any) -> Any:
        if value is None or self.func == "count":
            return value
        if self.func == "avg":
            return float(value)
        return self.attr.decode(value)

    def operand_value(self, value: Any) -> Any:
        return value if self.func in ("count", "avg") else self.attr.operand_value(value)


@dataclass(frozen=True, eq=False)
class Order:
    operand: Any
    descending: bool


@dataclass(frozen=True, eq=False)
class JoinOn:
    """One equality of two columns."""

    left: Any
    right: Any


@dataclass(frozen=True, eq=False)
class Scalar:
    """A subquery of one column as a value; null without a row, an error with several."""

    query: Any

    @property
    def name(self) -> str:
        return f"scalar_{self.query.fields[0].name}"

    def decode(self, value: Any) -> Any:
        return None if value is None else self.query.fields[0].decode(value)


@dataclass(frozen=True, eq=False)
class Assignment:
    attr: Any
    value: Any


def scalar(query: Select) -> Scalar:
    return Scalar(one_column(query))


def exists(query: Select) -> Predicate:
    return Predicate("exists", None, (_select(query),))


def not_exists(query: Select) -> Predicate:
    return Predicate("not_exists", None, (_select(query),))


def _select(query: Any) -> Any:
    from sparrel.operators.query import Select

    if not isinstance(query, Select):
        raise QueryConstructionError(f"{type(query).__name__} is no select")
    return query
