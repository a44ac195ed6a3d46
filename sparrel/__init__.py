"""Typed relational queries on Spark."""

from sparrel.errors import *  # noqa: F403
from sparrel.functions.json import JsonInt
from sparrel.model import Blob, Boolean, DateTime, Fetched, ForeignKey, Index, Integer, Json, Model, Pending, Real, Text, Uuid
from sparrel.operators.expr import Predicate, exists, not_exists, scalar
from sparrel.operators.query import delete, insert, select, update
from sparrel.runtime import AsyncDatabase, Catalog, Database, Transaction
from sparrel.schema import scaffold
from sparrel.sources.files import Frames, Jdbc, ParquetFolder
from sparrel.types import PENDING_GENERATION, CurrentTimestamp, UtcDatetime
from sparrel.types import Json as JsonOf

__all__ = [
    *("AsyncDatabase", "Blob", "Boolean", "Catalog", "CurrentTimestamp", "Database", "DateTime", "Fetched", "ForeignKey", "Frames", "Index", "Integer", "Jdbc", "Json", "JsonInt", "JsonOf", "Model"),
    *("PENDING_GENERATION", "ParquetFolder", "Pending", "Predicate", "Real", "Text", "Transaction", "UtcDatetime", "Uuid"),
    *("delete", "exists", "insert", "not_exists", "scaffold", "scalar", "select", "update"),
]
