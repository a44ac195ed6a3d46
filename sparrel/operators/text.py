"""Queries as SQL text, for people and for spark.sql()."""

from __future__ import annotations

from datetime import datetime
from typing import Any

from sparrel.errors import QueryCompilationError
from sparrel.model import Attr, Model
from sparrel.operators.expr import Aggregate, Predicate, Scalar
from sparrel.operators.query import Delete, Insert, Select, Update
from sparrel.types import PENDING_GENERATION, CurrentTimestamp

_SIGNS = {"eq": "=", "ne": "<>", "gt": ">", "gte": ">=", "lt": "<", "lte": "<="}
_WORDS = {"in": "IN", "not_in": "NOT IN", "like": "LIKE", "not_like": "NOT LIKE", "in_subquery": "IN", "not_in_subquery": "NOT IN", "exists": "EXISTS", "not_exists": "NOT EXISTS"}


def _quoted(name: str) -> str:
    return f"`{name}`"


def constant(value: Any) -> str:
    """A stored value as a literal of Spark's SQL."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, float):
        return f"{value!r}D"
    if isinstance(value, datetime):
        return f"{'TIMESTAMP_NTZ' if value.tzinfo is None else 'TIMESTAMP'} '{value.isoformat(sep=' ')}'"
    if isinstance(value, bytes):
        return f"X'{value.hex()}'"
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return str(value)


class Text:
    """Renders one query. inline: values stand in the text; else each is a ? and a parameter."""

    def __init__(self, *, inline: bool) -> None:
        self.inline, self.values = inline, list[Any]()

    def value(self, value: Any) -> str:
        if self.inline:
            return constant(value)
        self.values.append(value)
        return "?"

    def operand(self, x: Any) -> str:
        if isinstance(x, Attr):
            return f"{_quoted(x.model.table)}.{_quoted(x.name)}"
        if isinstance(x, Aggregate):
            return f"{x.func.upper()}({'*' if x.attr is None else self.operand(x.attr)})"
        if isinstance(x, Scalar):
            return f"({self.select(x.query)})"
        made = getattr(x, "to_sql", None)  # a leaf of one's own may say how it looks
        return made(self.operand(x.attr)) if made else f"{type(x).__name__}({self.operand(x.attr)})"

    def condition(self, p: Predicate) -> str:
        kind = p.kind
        if kind in ("and", "or"):
            return "(" + f" {kind.upper()} ".join(map(self.condition, p.values)) + ")"
        if kind == "not":
            return f"NOT ({self.condition(p.values[0])})"
        if kind in ("exists", "not_exists"):
            return f"{_WORDS[kind]} ({self.select(p.values[0])})"
        left = self.operand(p.operand)
        if kind in ("is_null", "is_not_null"):
            return f"{left} {kind.replace('_', ' ').upper()}"
        if kind in _SIGNS:
            return f"{left} {_SIGNS[kind]} {self.value(p.operand.operand_value(p.values[0]))}"
        if kind.endswith("_col"):
            return f"{left} {_SIGNS[kind[:-4]]} {self.operand(p.values[0])}"
        if kind == "between":
            low, high = (self.value(p.operand.operand_value(v)) for v in p.values)
            return f"{left} BETWEEN {low} AND {high}"
        if kind in ("like", "not_like"):
            return f"{left} {_WORDS[kind]} {self.value(p.values[0].replace(chr(92), chr(92) * 2))}"  # no escape character
        if kind in ("in", "not_in"):
            return f"{left} {_WORDS[kind]} ({', '.join(self.value(p.operand.operand_value(v)) for v in p.values)})"
        if kind in ("in_subquery", "not_in_subquery"):
            return f"{left} {_WORDS[kind]} ({self.select(p.values[0])})"
        raise QueryCompilationError(f"predicate {kind} is unknown")

    def _all(self, word: str, ps: tuple[Predicate, ...]) -> str:
        return f" {word} " + " AND ".join(map(self.condition, ps)) if ps else ""

    def select(self, q: Select) -> str:
        q.check_intent()
        fields = [self.operand(c) for m in q.models for c in m.columns.values()] if q.shape == "model" else [f"{self.operand(f)} AS {_quoted(f.name)}" for f in q.fields]
        out = f"SELECT {'DISTINCT ' if q.is_distinct else ''}{', '.join(fields)} FROM {_quoted(q.model.table)}"
        for j in q.joins:
            out += f" {j.how.upper()} JOIN {_quoted(j.model.table)} ON {self.operand(j.on.left)} = {self.operand(j.on.right)}"
        out += self._all("WHERE", q.predicates)
        out += f" GROUP BY {', '.join(map(self.operand, q.keys))}" if q.keys else ""
        out += self._all("HAVING", q.havings)
        # after DISTINCT only what is selected has a name
        by = (lambda x: _quoted(x.name)) if q.is_distinct and q.shape != "model" else self.operand
        out += f" ORDER BY {', '.join(by(o.operand) + (' DESC' if o.descending else ' ASC') for o in q.orders)}" if q.orders else ""
        out += f" LIMIT {q.first}" if q.first is not None else ""
        return out + (f" OFFSET {q.skip}" if q.skip is not None else "")

    def _returning(self, columns: tuple[Attr, ...] | None) -> str:
        return "" if columns is None else f" RETURNING {', '.join(_quoted(c.name) for c in columns) or '*'}"

    def _row(self, row: Model, names: list[str]) -> str:
        return "(" + ", ".join(self.value(row.columns[n].encode(row._values[n])) for n in names) + ")"

    def insert(self, q: Insert) -> str:
        if not q.rows:
            raise QueryCompilationError("an insert of no rows")
        names = [n for n in q.model.columns if q.rows[0]._values[n] is not PENDING_GENERATION]
        rows = ", ".join(self._row(r, names) for r in q.rows)
        return f"INSERT INTO {_quoted(q.model.table)} ({', '.join(map(_quoted, names))}) VALUES {rows}{self._returning(q.returned)}"

    def update(self, q: Update) -> str:
        q.check_intent()
        sets = ", ".join(f"{_quoted(a.attr.name)} = {'CURRENT_TIMESTAMP' if a.value is CurrentTimestamp else self.value(a.attr.encode(a.value))}" for a in q.assignments)
        return f"UPDATE {_quoted(q.model.table)} SET {sets}{self._all('WHERE', q.predicates)}{self._returning(q.returned)}"

    def delete(self, q: Delete) -> str:
        q.check_intent()
        return f"DELETE FROM {_quoted(q.model.table)}{self._all('WHERE', q.predicates)}{self._returning(q.returned)}"


def text_of(query: Select | Insert | Update | Delete, *, inline: bool) -> tuple[str, list[Any]]:
    made = Text(inline=inline)
    return getattr(made, type(query).__name__.lower())(query), made.values
