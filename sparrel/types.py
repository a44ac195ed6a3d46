"""Column types (where a value is stored) and logical types (what it is in Python).

A column pairs one of each: the constructor names the storage, the annotation the logical type. The pair
decides the Spark type and how values are checked and turned at the edge. Inside Spark nothing is
decoded: queries run on plain Spark columns.
"""

from __future__ import annotations

import json
import math
import types as _types
import typing
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import types as T

from sparrel.errors import ModelDeclarationError, ModelValidationError

_LOW, _HIGH = -(2**63), 2**63 - 1


class UtcDatetime(datetime):
    """Logical type: an aware time, kept in UTC and cut to milliseconds."""


class Json:
    """Logical type Json[T]: a value kept as JSON text; T is checked as far as it is plain."""

    inner: Any = Any

    def __class_getitem__(cls, inner: Any) -> type:
        return type("Json", (Json,), {"inner": inner})


class CurrentTimestamp:
    """Default or assigned value: the time when the statement runs, in milliseconds of UTC."""


class _Pending:
    """The one value of columns that the store fills."""

    _one: _Pending | None = None

    def __new__(cls) -> _Pending:
        if cls._one is None:
            cls._one = super().__new__(cls)
        return cls._one

    def __repr__(self) -> str:
        return "PENDING_GENERATION"

    def __bool__(self) -> bool:
        raise TypeError("PENDING_GENERATION has no truth value")

    def __copy__(self) -> _Pending:
        return self

    def __deepcopy__(self, memo: object) -> _Pending:
        return self

    def __reduce__(self) -> tuple:
        return (_Pending, ())


PENDING_GENERATION = _Pending()


def utc_millis(value: datetime) -> datetime:
    if value.tzinfo is None or value.utcoffset() is None:
        raise ModelValidationError("a time with a zone is needed")
    value = value.astimezone(UTC)
    return value.replace(microsecond=value.microsecond // 1000 * 1000)


def split_optional(annotation: Any) -> tuple[Any, bool]:
    """T | None as (T, True); anything else as (itself, False)."""
    if typing.get_origin(annotation) in (typing.Union, _types.UnionType):
        rest = [a for a in typing.get_args(annotation) if a is not type(None)]
        if len(rest) == 1 and len(rest) < len(typing.get_args(annotation)):
            return rest[0], True
        raise ModelDeclarationError(f"{annotation} is no logical type; only T | None is a union here")
    return annotation, False


def _fits(value: Any, kind: Any) -> bool:
    """Whether a JSON value fits a plain type: builtins, list[T], dict[str, T], unions, Any."""
    origin = typing.get_origin(kind)
    if kind in (Any, object):
        return True
    if kind is None or kind is type(None):
        return value is None
    if origin in (typing.Union, _types.UnionType):
        return any(_fits(value, k) for k in typing.get_args(kind))
    if origin in (list, dict):
        args = typing.get_args(kind)
        inner = value if origin is list else value.values() if isinstance(value, dict) else ()
        return isinstance(value, origin) and all(_fits(x, args[-1]) for x in inner)
    if kind is float:
        return isinstance(value, (int, float)) and not isinstance(value, bool)
    if kind is int:
        return isinstance(value, int) and not isinstance(value, bool)
    return isinstance(value, kind) if isinstance(kind, type) else True


@dataclass(frozen=True)
class Codec:
    """How a pair of storage and logical type behaves.

    check: validates a Python value and gives its normal form. encode: normal form to what Spark
    stores. decode: what Spark gives to the Python value."""

    spark: T.DataType
    logical: Any
    check: Callable[[Any], Any]
    encode: Callable[[Any], Any]
    decode: Callable[[Any], Any]
    numeric: bool = False
    likable: bool = False
    lexical: bool = False


def _same(x: Any) -> Any:
    return x


def _checked(kind: type, *, also: tuple[type, ...] = ()) -> Callable[[Any], Any]:
    def check(x: Any) -> Any:
        if not isinstance(x, (kind, *also)) or isinstance(x, bool) and kind is not bool:
            raise ModelValidationError(f"{type(x).__name__} given, {kind.__name__} needed")
        return x

    return check


def _int(x: Any) -> int:
    if isinstance(x, bool):
        return int(x)
    if not isinstance(x, int):
        raise ModelValidationError(f"{type(x).__name__} given, int needed")
    if not _LOW <= x <= _HIGH:
        raise ModelValidationError(f"{x} is outside signed 64 bits")
    return x


def _float(x: Any) -> float:
    if isinstance(x, bool) or not isinstance(x, (int, float)):
        raise ModelValidationError(f"{type(x).__name__} given, float needed")
    if not math.isfinite(x):
        raise ModelValidationError("NaN and infinities can't be stored")
    return float(x)


def _bytes(x: Any) -> bytes:
    if not isinstance(x, (bytes, bytearray, memoryview)):
        raise ModelValidationError(f"{type(x).__name__} given, bytes needed")
    return bytes(x)


def _zero_one(x: Any) -> bool:
    if x not in (0, 1):
        raise ModelValidationError(f"{x!r} is no stored bool")
    return bool(x)


def _uuid(x: Any) -> uuid.UUID:
    if isinstance(x, uuid.UUID):
        return x
    raise ModelValidationError(f"{type(x).__name__} given, UUID needed")


def _time(x: Any) -> datetime:
    if not isinstance(x, datetime):
        raise ModelValidationError(f"{type(x).__name__} given, datetime needed")
    if x.tzinfo is not None and (offset := x.utcoffset()) is not None and offset.total_seconds() % 60:
        raise ModelValidationError("offsets of parts of minutes can't be stored")
    return x


def _naive(x: Any) -> datetime:
    if _time(x).tzinfo is not None:
        raise ModelValidationError("this column holds times without a zone")
    return x


def _from_spark_time(x: datetime) -> datetime:
    # the driver gives session times without a zone; the session's zone is UTC
    return x.replace(tzinfo=UTC) if x.tzinfo is None else x.astimezone(UTC)


def _json_codec(inner: Any) -> Codec:
    def check(x: Any) -> Any:
        try:
            text = json.dumps(x, allow_nan=False)
        except (TypeError, ValueError) as e:
            raise ModelValidationError(str(e)) from e
        if not _fits(x, inner):
            raise ModelValidationError(f"the JSON value is no {inner}")
        return json.loads(text)

    def decode(text: str) -> Any:
        try:
            value = json.loads(text)
        except ValueError as e:
            raise ModelValidationError(f"no JSON: {e}") from e
        if not _fits(value, inner):
            raise ModelValidationError(f"the JSON value is no {inner}")
        return value

    return Codec(T.StringType(), Json, check, lambda x: json.dumps(x, ensure_ascii=False, separators=(",", ":")), decode)


def codec_of(storage: str, logical: Any, *, zone: bool = True) -> Codec:
    """The codec of a pair. Pairs that can't work raise ModelDeclarationError.

    storage: integer, real, text, blob, json, boolean, datetime or uuid. zone=False makes datetime
    storage a time without zone."""
    if isinstance(logical, type) and issubclass(logical, Json):
        if storage in ("text", "json"):
            return _json_codec(logical.inner)
    elif storage == "json":
        return _json_codec(logical)
    elif storage == "integer":
        if logical is int:
            return Codec(T.LongType(), int, _int, _same, _int, numeric=True)
        if logical is bool:
            return Codec(T.LongType(), bool, _checked(bool), int, _zero_one)
    elif storage == "real":
        if logical in (float, int):
            return Codec(T.DoubleType(), float, _float, float, _float, numeric=True)
    elif storage == "boolean":
        if logical is bool:
            return Codec(T.BooleanType(), bool, _checked(bool), _same, _zero_one)
    elif storage == "blob":
        if logical is bytes:
            return Codec(T.BinaryType(), bytes, _bytes, _same, _bytes)
        if logical is uuid.UUID:
            return Codec(T.BinaryType(), uuid.UUID, _uuid, lambda x: x.bytes, lambda x: uuid.UUID(bytes=bytes(x)))
    elif storage == "uuid":
        if logical is uuid.UUID:
            return Codec(T.StringType(), uuid.UUID, _uuid, str, uuid.UUID)
    elif storage in ("text", "datetime"):
        if logical is UtcDatetime or logical is datetime and storage == "datetime" and zone:
            return Codec(T.TimestampType(), UtcDatetime, lambda x: utc_millis(_time(x)), _same, _from_spark_time)
        if logical is datetime and storage == "datetime":
            return Codec(T.TimestampNTZType(), datetime, _naive, _same, _same)
        if storage == "text":
            if logical is str:
                return Codec(T.StringType(), str, _checked(str), _same, _checked(str), likable=True)
            if logical is uuid.UUID:
                return Codec(T.StringType(), uuid.UUID, _uuid, str, uuid.UUID)
            if logical is datetime:
                return Codec(T.StringType(), datetime, _time, lambda x: x.isoformat(), datetime.fromisoformat, lexical=True)
    raise ModelDeclarationError(f"{storage} storage can't hold {logical}")
