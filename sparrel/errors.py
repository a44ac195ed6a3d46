"""Everything this library raises on purpose descends from SparrelError; warnings from SparrelWarning."""

from __future__ import annotations


class SparrelError(Exception):
    """Root of the library's errors."""


class SparrelWarning(UserWarning):
    """Root of the library's warnings."""


class LexicalOrderWarning(SparrelWarning):
    """A time kept as text compares by its letters, not by instant."""


class CatalogWarning(SparrelWarning):
    """verify(policy="warn") found drift."""


class ModelError(SparrelError):
    """Root of errors about table models."""


class ModelDeclarationError(ModelError):
    """A model class is declared in a way that can't work."""


class ModelValidationError(ModelError):
    """A value doesn't fit its column."""


class ImmutableRowError(ModelError, AttributeError):
    """Rows are values; they can't be changed."""


class QueryError(SparrelError):
    """Root of errors about queries."""


class QueryConstructionError(QueryError):
    """A builder call makes no sense where it stands."""


class QueryCompilationError(QueryError):
    """A finished query can't be lowered to a DataFrame."""


class ValueRefusedError(QueryConstructionError):
    """An argument has a wrong type or range."""


class RuntimeUseError(SparrelError):
    """Root of errors about databases and transactions."""


class ConfigurationError(RuntimeUseError):
    """The session or the configuration can't be used."""


class NotStartedError(RuntimeUseError):
    """Used before it was entered."""


class ClosedError(RuntimeUseError):
    """Used after it was closed."""


class ReusedError(RuntimeUseError):
    """A transaction or stream may be entered once only."""


class ExecutionError(RuntimeUseError):
    """Spark failed to run a query; the cause is chained."""


class ConflictError(ExecutionError):
    """Another writer published first."""


class IntegrityError(ExecutionError):
    """Root of violated constraints."""


class NotNullError(IntegrityError):
    """A null in a column that has none."""


class UniqueError(IntegrityError):
    """A primary key or unique column would repeat."""


class ForeignKeyError(IntegrityError):
    """A reference to no row, or rows that still refer to one that goes."""


class CardinalityError(RuntimeUseError):
    """Root of results of the wrong number of rows."""


class NoResultError(CardinalityError):
    """Exactly one row was asked for and there is none."""


class MultipleResultsError(CardinalityError):
    """At most one row was asked for and there are more."""


class SchemaError(SparrelError):
    """Root of errors about schemas."""


class SchemaPlanError(SchemaError):
    """Models that don't make a schema together."""


class SchemaDriftError(SchemaError):
    """Stored tables differ from the models."""


class MigrationError(SchemaError):
    """A migration failed, or its lock is held."""
