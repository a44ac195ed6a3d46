"""Operands over JSON columns."""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparrel.errors import ModelValidationError, QueryConstructionError, ValueRefusedError
from sparrel.operators.expr import Comparable

_PATH = re.compile(r"\$(\.[A-Za-z_][A-Za-z0-9_]*|\[\d+\])*\Z")


class JsonInt(Comparable):
    """The integer at a path of a JSON column; null where the path is missing.

    In a filter a value that is no integer matches nothing; in a projection it raises."""

    def __init__(self, attr: Any, path: str) -> None:
        if attr.storage != "json" and attr.codec.likable is False and attr.codec.spark.simpleString() != "string":
            raise QueryConstructionError(f"{attr!r} holds no JSON")
        if not isinstance(path, str) or not _PATH.match(path):
            raise ValueRefusedError(f"{path!r} is no path like $.a.b[0]")
        self.attr, self.path, self.model = attr, path, attr.model

    @property
    def name(self) -> str:
        return f"{self.attr.name}_{re.sub(r'[^A-Za-z0-9]+', '_', self.path).strip('_')}"

    def to_column(self, column: Column, *, filtering: bool) -> Column:
        text = F.get_json_object(column, self.path)
        return text.try_cast("bigint") if filtering else text.cast("bigint")

    def to_sql(self, column: str) -> str:
        return f"try_cast(get_json_object({column}, '{self.path}') AS BIGINT)"

    def operand_value(self, value: Any) -> Any:
        if not isinstance(value, int) or isinstance(value, bool):
            raise ModelValidationError(f"{self.name} compares with an int")
        return value

    def decode(self, value: Any) -> Any:
        return value
