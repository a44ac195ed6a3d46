"""Table models: a class declares a table's columns; its instances are rows, which are values.

    class User(Model):
        id: Model.GenCol[int] = Integer(primary_key=True, auto_increment=True)
        email: Model.Col[str] = Text(unique=True)

Class access to a column gives a query expression, instance access its value. Col is a plain column,
GenCol one that the store may fill, FKCol a foreign key. Rows made by hand are pending (validated);
rows read from a table are fetched.
"""

from __future__ import annotations

import re
import sys
import typing
import warnings
from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import types as T

from sparrel import types as _t
from sparrel.errors import ImmutableRowError, LexicalOrderWarning, ModelDeclarationError, ModelValidationError, QueryConstructionError
from sparrel.operators.expr import Aggregate, Assignment, Comparable, JoinOn

_MISSING: Any = type("_Missing", (), {"__repr__": lambda self: "<missing>"})()
_IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_]*\Z")
ACTIONS = ("CASCADE", "RESTRICT", "SET NULL", "NO ACTION")


class Pending:
    """Marks rows made by the application."""


class Fetched:
    """Marks rows read from a table."""


class _Shape:
    """Col[T], GenCol[T] and FKCol[T] of annotations."""

    def __init__(self, kind: str, logical: Any = None) -> None:
        self.kind, self.logical = kind, logical

    def __getitem__(self, logical: Any) -> _Shape:
        return _Shape(self.kind, logical)


def identifier(name: Any, what: str) -> str:
    if not isinstance(name, str) or not _IDENTIFIER.match(name):
        raise ModelDeclarationError(f"{name!r} is no name for a {what}")
    return name


class Attr(Comparable):
    """A column of a model."""

    def __init__(
        self,
        storage: str | None,
        *,
        primary_key: bool = False,
        auto_increment: bool = False,
        nullable: bool = False,
        unique: bool = False,
        index: bool = False,
        default: Any = _MISSING,
        default_factory: Callable[[], Any] | None = None,
        zone: bool = True,
        target: Attr | Callable[[], Attr] | None = None,
        on_delete: str = "NO ACTION",
        on_update: str = "NO ACTION",
    ) -> None:
        self.storage, self.primary_key, self.auto_increment, self.nullable = storage, primary_key, auto_increment, nullable
        self.unique, self.index, self.default, self.default_factory, self.zone = unique, index, default, default_factory, zone
        self.target_, self.on_delete, self.on_update = target, on_delete, on_update
        self.name, self.model, self.codec, self.generated = "", None, None, False
        if default is not _MISSING and default_factory is not None:
            raise ModelDeclarationError("default and default_factory exclude each other")
        for action in (on_delete, on_update):
            if action not in ACTIONS:
                raise ModelDeclarationError(f"{action!r} is none of {ACTIONS}")

    def __set_name__(self, owner: type, name: str) -> None:
        if self.name:
            raise ModelDeclarationError(f"one column object can't be both {self.name} and {name}")
        self.name = identifier(name, "column")

    def __get__(self, row: Any, owner: type) -> Any:
        return self if row is None else row._values[self.name]

    def __set__(self, row: Any, value: Any) -> None:
        raise ImmutableRowError(f"{self.name} can't be set: rows are values")

    def __repr__(self) -> str:
        return f"{self.model.table if self.model else '?'}.{self.name}"

    @property
    def target(self) -> Attr | None:
        t = self.target_
        return t if t is None or isinstance(t, Attr) else t()

    @property
    def has_default(self) -> bool:
        return self.default is not _MISSING or self.default_factory is not None

    @property
    def filled(self) -> bool:
        """Whether the store fills it where a row leaves it out."""
        return self.auto_increment or self.default is _t.CurrentTimestamp or self.default is _t.PENDING_GENERATION

    def bind(self, model: type[Model], shape: _Shape) -> None:
        self.model = model
        logical, optional = _t.split_optional(shape.logical)
        self.generated = shape.kind == "GenCol"
        if optional != self.nullable:
            raise ModelDeclarationError(f"{self!r}: T | None and nullable=True go together")
        if (self.target_ is not None) != (shape.kind == "FKCol"):
            raise ModelDeclarationError(f"{self!r}: FKCol and ForeignKey go together")
        if self.target_ is not None and self.storage is None:
            self.storage, self.zone = self.target.storage, self.target.zone
        self.codec = _t.codec_of(self.storage, logical, zone=self.zone)
        if self.codec.lexical:
            warnings.warn(f"{self!r} keeps times as text, which compare by their letters: use UtcDatetime", LexicalOrderWarning, stacklevel=4)
        if self.primary_key and (self.unique or self.index) or self.unique and self.index:
            raise ModelDeclarationError(f"{self!r}: primary_key, unique and index exclude each other")
        if self.primary_key and self.nullable:
            raise ModelDeclarationError(f"{self!r}: a primary key can't be null")
        if self.auto_increment and not (self.primary_key and self.storage == "integer"):
            raise ModelDeclarationError(f"{self!r}: auto_increment is for integer primary keys")
        if (self.default is _t.CurrentTimestamp or self.default is _t.PENDING_GENERATION) and not self.generated:
            raise ModelDeclarationError(f"{self!r}: only a GenCol is filled by the store")
        if self.on_delete == "SET NULL" and not self.nullable or self.on_update == "SET NULL" and not self.nullable:
            raise ModelDeclarationError(f"{self!r}: SET NULL needs nullable=True")

    def validate(self, value: Any) -> Any:
        if value is _t.PENDING_GENERATION and self.generated:
            return value
        if value is None:
            if not self.nullable:
                raise ModelValidationError(f"{self!r} can't be null")
            return None
        try:
            return self.codec.check(value)
        except ModelValidationError as e:
            raise ModelValidationError(f"{self!r}: {e}") from e

    def encode(self, value: Any) -> Any:
        return None if value is None else self.codec.encode(value)

    def operand_value(self, value: Any) -> Any:
        """A value to compare with, as Spark's; checked as far as it goes over the wire."""
        return self.codec.encode(self.validate(value)) if value is not None else None

    def decode(self, value: Any) -> Any:
        if value is None:
            return None
        try:
            return self.codec.decode(value)
        except (ModelValidationError, ValueError, TypeError) as e:
            raise ModelValidationError(f"{self!r}: {e}") from e

    def field(self) -> T.StructField:
        facts = {"primary_key": self.primary_key, "auto_increment": self.auto_increment, "unique": self.unique, "has_default": self.has_default, "nullable": self.nullable}
        if self.target is not None:
            facts["references"] = f"{self.target.model.table}.{self.target.name}"
        return T.StructField(self.name, self.codec.spark, self.nullable, facts)

    # what else a column can be in a query

    def like(self, pattern: str) -> Any:
        """Case matters; % and _ are the only special characters."""
        return self._like("like", pattern)

    def not_like(self, pattern: str) -> Any:
        return self._like("not_like", pattern)

    def _like(self, kind: str, pattern: str) -> Any:
        from sparrel.operators.expr import Predicate

        if not self.codec.likable:
            raise QueryConstructionError(f"{self!r} holds no plain text to match")
        if not isinstance(pattern, str):
            raise QueryConstructionError("a pattern is a str")
        return Predicate(kind, self, (pattern,))

    def references(self, other: Attr) -> JoinOn:
        if not isinstance(other, Attr):
            raise QueryConstructionError("a join compares two columns")
        return JoinOn(self, other)

    def to(self, value: Any) -> Assignment:
        return Assignment(self, value if value is _t.CurrentTimestamp else self.validate(value))

    def count(self) -> Aggregate:
        return Aggregate("count", self, self.model)

    def _of_numbers(self, func: str) -> Aggregate:
        if not self.codec.numeric:
            raise QueryConstructionError(f"{func} needs a column of numbers, {self!r} is none")
        return Aggregate(func, self, self.model)

    def sum(self) -> Aggregate:
        return self._of_numbers("sum")

    def avg(self) -> Aggregate:
        return self._of_numbers("avg")

    def min(self) -> Aggregate:
        return Aggregate("min", self, self.model)

    def max(self) -> Aggregate:
        return Aggregate("max", self, self.model)

    def json_extract_int(self, path: str) -> Any:
        from sparrel.functions.json import JsonInt

        return JsonInt(self, path)


def _column(storage: str) -> Callable[..., Any]:
    def make(**options: Any) -> Any:
        return Attr(storage, **options)

    make.__name__ = storage.capitalize()
    return make


Integer, Real, Text, Blob, Json, Boolean, Uuid = (_column(s) for s in ("integer", "real", "text", "blob", "json", "boolean", "uuid"))


def DateTime(*, zone: bool = True, **options: Any) -> Any:  # noqa: N802
    """A Spark timestamp; zone=False: one without time zone, for naive datetimes."""
    return Attr("datetime", zone=zone, **options)


def ForeignKey(target: Any, **options: Any) -> Any:  # noqa: N802
    """A column that refers to `target`, a column or a function that gives it."""
    return Attr(None, target=target, **options)


class Index:
    """An index of columns, for __indexes__. Spark has none: unique ones are checked on writing."""

    def __init__(self, *columns: Attr, unique: bool = False, name: str | None = None) -> None:
        if not columns or not all(isinstance(c, Attr) for c in columns):
            raise ModelDeclarationError("an index is over columns")
        if len({id(c) for c in columns}) < len(columns):
            raise ModelDeclarationError("an index can't have a column twice")
        self.columns, self.unique, self.given = columns, unique, name and identifier(name, "index")

    def name(self, table: str) -> str:
        return self.given or f"{'ux' if self.unique else 'ix'}_{table}_{'_'.join(c.name for c in self.columns)}"


def _snake(name: str) -> str:
    return re.sub(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", "_", name).lower()


class Model:
    """Base of table models. A model can't be subclassed further."""

    Col, GenCol, FKCol = _Shape("Col"), _Shape("GenCol"), _Shape("FKCol")
    table: str = ""
    columns: dict[str, Attr] = {}
    indexes: tuple[Index, ...] = ()
    _decoders: tuple[tuple[str, Callable[[Any], Any], bool], ...] = ()
    _values: dict[str, Any]

    def __class_getitem__(cls, _: Any) -> type:
        return cls  # Model[S, "User[Fetched]"] is for type checkers

    def __init_subclass__(cls, **options: Any) -> None:
        super().__init_subclass__(**options)
        if any(b.columns for b in cls.__mro__[1:] if isinstance(b, type) and issubclass(b, Model)):
            raise ModelDeclarationError(f"{cls.__name__}: a concrete model can't be subclassed")
        if any(b is not Model and b is not typing.Generic for b in cls.__bases__):
            raise ModelDeclarationError(f"{cls.__name__}: a model has no other bases")
        found = {k: v for k, v in vars(cls).items() if isinstance(v, Attr)}
        if not found:
            raise ModelDeclarationError(f"{cls.__name__} has no column")
        notes = dict(getattr(cls, "__annotations__", {}))
        if stray := [k for k in notes if k not in found and not k.startswith("__")]:
            raise ModelDeclarationError(f"{cls.__name__}: annotations without column: {', '.join(stray)}")
        if bad := [k for k, v in vars(cls).items() if isinstance(v, property)]:
            raise ModelDeclarationError(f"{cls.__name__}: no properties in a model ({', '.join(bad)})")
        cls.table = identifier(vars(cls).get("__tablename__") or _snake(cls.__name__), "table")
        cls.columns = found
        scope = {**vars(typing), **vars(sys.modules[cls.__module__]), **_caller_names(), cls.__name__: cls}
        for name, attr in found.items():
            if name not in notes:
                raise ModelDeclarationError(f"{cls.__name__}.{name} has no annotation")
            shape = notes[name]
            if isinstance(shape, str):
                try:
                    shape = eval(shape, scope)  # noqa: S307  the model's own source
                except Exception as e:
                    raise ModelDeclarationError(f"{cls.__name__}.{name}: {shape} can't be resolved: {e}") from e
            if not isinstance(shape, _Shape) or shape.logical is None:
                raise ModelDeclarationError(f"{cls.__name__}.{name}: annotate with Col[T], GenCol[T] or FKCol[T]")
            attr.bind(cls, shape)
        cls._decoders = tuple((name, attr.codec.decode, attr.nullable) for name, attr in found.items())
        cls.indexes = cls._all_indexes()
        keys = cls.primary_key()
        if len(keys) > 1 and any(k.auto_increment for k in keys):
            raise ModelDeclarationError(f"{cls.__name__}: a composite primary key has no auto_increment member")

    @classmethod
    def _all_indexes(cls) -> tuple[Index, ...]:
        own = tuple(vars(cls).get("__indexes__", ()))
        if not all(isinstance(i, Index) for i in own):
            raise ModelDeclarationError(f"{cls.__name__}: __indexes__ holds Index objects")
        made = [Index(a, unique=a.unique) for a in cls.columns.values() if a.unique or a.index] + list(own)
        for index in made:
            if any(cls.columns.get(c.name) is not c for c in index.columns):
                raise ModelDeclarationError(f"{cls.__name__}: an index is over columns of another model")
        for what in ([i.name(cls.table) for i in made], [tuple(c.name for c in i.columns) for i in made]):
            if len(set(what)) < len(what):
                raise ModelDeclarationError(f"{cls.__name__}: two indexes are the same")
        return tuple(made)

    def __init__(self, **values: Any) -> None:
        cls = type(self)
        if unknown := values.keys() - cls.columns.keys():
            raise ModelValidationError(f"{cls.__name__} has no {', '.join(sorted(unknown))}")
        out = {}
        for name, attr in cls.columns.items():
            if name in values:
                out[name] = attr.validate(values[name])
            elif attr.filled:
                out[name] = _t.PENDING_GENERATION
            elif attr.has_default:
                out[name] = attr.validate(attr.default_factory() if attr.default_factory else attr.default)
            else:
                raise ModelValidationError(f"{cls.__name__}.{name} is missing")
        object.__setattr__(self, "_values", out)
        object.__setattr__(self, "_fetched", False)

    @classmethod
    def construct(cls, **values: Any) -> Any:
        """A row without validation, for values known to be right."""
        row = object.__new__(cls)
        object.__setattr__(row, "_values", {n: values.get(n, _t.PENDING_GENERATION if a.filled else None if not a.has_default else a.default) for n, a in cls.columns.items()})
        object.__setattr__(row, "_fetched", False)
        return row

    @classmethod
    def from_stored(cls, values: Iterable[Any], *, validate: bool = True) -> Any:
        """A fetched row of values in the order of the columns, as Spark gives them."""
        row = object.__new__(cls)
        out = {}
        if validate:
            for (name, decode, nullable), value in zip(cls._decoders, values, strict=True):
                if value is not None:
                    try:
                        out[name] = decode(value)
                    except (ModelValidationError, ValueError, TypeError) as e:
                        raise ModelValidationError(f"{cls.columns[name]!r}: {e}") from e
                elif nullable:
                    out[name] = None
                else:
                    raise ModelValidationError(f"{cls.columns[name]!r} is null in the table")
        else:
            out = dict(zip(cls.columns, values, strict=True))
        object.__setattr__(row, "_values", out)
        object.__setattr__(row, "_fetched", True)
        return row

    def __setattr__(self, name: str, value: Any) -> None:
        raise ImmutableRowError(f"{name} can't be set: rows are values")

    def __delattr__(self, name: str) -> None:
        raise ImmutableRowError(f"{name} can't be deleted: rows are values")

    def __eq__(self, other: object) -> bool:
        if type(other) is not type(self):
            return NotImplemented
        return self._values == other._values and self._fetched == other._fetched

    __hash__ = None  # type: ignore[assignment]

    def __repr__(self) -> str:
        shown = (f"{k}={v!r}" for k, v in self._values.items()) if self._fetched else ("pending",)
        return f"{type(self).__name__}({', '.join(shown)})"

    @classmethod
    def primary_key(cls) -> list[Attr]:
        return [a for a in cls.columns.values() if a.primary_key]

    @classmethod
    def schema(cls) -> T.StructType:
        return T.StructType([a.field() for a in cls.columns.values()])

    @classmethod
    def count_all(cls) -> Aggregate:
        return Aggregate("count", None, cls)


def _caller_names() -> dict[str, Any]:
    """Local names around a class statement, so that models may be declared within functions."""
    frame = sys._getframe(2)
    while frame is not None and frame.f_globals.get("__name__") == __name__:
        frame = frame.f_back
    return dict(frame.f_locals) if frame is not None else {}
