"""Databases and transactions: running queries, decoding their rows, and writing.

    with Database.initialize(spark, root) as db:
        db.migrate({"0001": scaffold([User])})
        with db.transaction() as tx:
            tx.execute(insert(User(email="a@b.c")))
            rows = tx.fetch_all(select(User).all())

A transaction reads one snapshot and its own writes; its writes are published together on a clean exit.
For results that are large, tx.to_df(query) gives the lazy DataFrame.
"""

from __future__ import annotations

import asyncio
import logging
import random
import time
from datetime import UTC, datetime
from typing import Any, Self

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparrel.errors import (
    ClosedError,
    ConfigurationError,
    ConflictError,
    ExecutionError,
    ForeignKeyError,
    MultipleResultsError,
    NoResultError,
    NotNullError,
    NotStartedError,
    QueryConstructionError,
    ReusedError,
    SparrelError,
    UniqueError,
)
from sparrel.model import Attr, Model
from sparrel.operators.query import Delete, Insert, Select, Update
from sparrel.plans.lower import Scope, conjunction, lower
from sparrel.sources.store import Snapshot, Store
from sparrel.streaming.chunks import ChunkStream
from sparrel.types import PENDING_GENERATION, CurrentTimestamp, utc_millis

log = logging.getLogger("sparrel.runtime")
log.addHandler(logging.NullHandler())

#: Attempts to publish, and the longest first wait in seconds.
ATTEMPTS, WAIT = 5, 0.05


def decoder(query: Select, *, validate: bool = True) -> Any:
    """What turns a Spark row of the query into its result: a row, a value or a tuple."""
    if query.shape == "model" and not query.joins:
        return lambda r: query.model.from_stored(r, validate=validate)
    if query.shape == "model":
        return lambda r: tuple(None if part is None else m.from_stored(part, validate=validate) for m, part in zip(query.models, r, strict=True))
    turn = [f.decode if validate else lambda v: v for f in query.fields]
    if query.shape == "value":
        return lambda r: turn[0](r[0])
    return lambda r: tuple(t(v) for t, v in zip(turn, r, strict=True))


def run(what: Any, query: Any) -> Any:
    """What a query's action gives; one record for each, with its kind, table and time, and never its values."""
    started = time.monotonic()
    facts = {"kind": type(query).__name__.lower(), "table": query.model.table if query.model else None}
    try:
        out = what()
    except Exception as e:
        log.warning("%s on %s failed after %.3f s: %s", facts["kind"], facts["table"], time.monotonic() - started, type(e).__name__, extra=facts | {"seconds": time.monotonic() - started, "error": type(e).__name__})
        if isinstance(e, SparrelError):
            raise
        raise ExecutionError(f"{query!r} failed: {e}") from e
    rows = len(out) if isinstance(out, list) else None
    log.debug("%s on %s took %.3f s", facts["kind"], facts["table"], time.monotonic() - started, extra=facts | {"seconds": time.monotonic() - started, "rows": rows})
    return out


class Reader:
    """The verbs that read, over anything with table(model)."""

    def table(self, model: type[Model]) -> DataFrame:
        raise NotImplementedError

    def _ready(self) -> None:
        pass

    def to_df(self, query: Select) -> DataFrame:
        self._ready()
        if not isinstance(query, Select):
            raise QueryConstructionError(f"{type(query).__name__} is no select")
        return lower(query, self)

    def fetch_all(self, query: Select, *, validate: bool = True) -> list:
        df, turn = self.to_df(query), decoder(query, validate=validate)
        return [turn(r) for r in run(df.collect, query)]

    def _two(self, query: Select) -> list:
        df, turn = self.to_df(query), decoder(query)
        return [turn(r) for r in run(lambda: df.limit(2).collect(), query)]

    def fetch_one(self, query: Select) -> Any:
        rows = self._two(query)
        if not rows:
            raise NoResultError(f"{query!r} has no row")
        if len(rows) > 1:
            raise MultipleResultsError(f"{query!r} has more than one row")
        return rows[0]

    def fetch_one_or_none(self, query: Select) -> Any:
        if isinstance(query, Select) and query.shape == "value":
            raise QueryConstructionError("None would mean both no row and a null: use fetch_one() or select more columns")
        rows = self._two(query)
        if len(rows) > 1:
            raise MultipleResultsError(f"{query!r} has more than one row")
        return rows[0] if rows else None

    def fetch_chunks(self, query: Select, size: int, *, validate: bool = True) -> ChunkStream:
        return ChunkStream(lambda: self.to_df(query), decoder(query, validate=validate), size)


class Catalog(Reader):
    """Reads the tables of a source (see sparrel.sources.files) without a store."""

    def __init__(self, source: Any) -> None:
        self.source = source

    def table(self, model: type[Model]) -> DataFrame:
        return self.source.table(model)


class Transaction(Reader):
    def __init__(self, db: Database, timeout: float | None, mode: str) -> None:
        if mode not in ("deferred", "immediate"):
            raise QueryConstructionError(f"{mode!r} is no mode: deferred or immediate")
        self.db, self.timeout, self.mode = db, timeout, mode
        self.state = "new"
        self.snapshot, self.changed = Snapshot(), set()
        self.staged: list[str] = []
        self.models: dict[str, type[Model]] = {}
        self.referred: set[str] = set()

    def __enter__(self) -> Self:
        self.db._ready()
        if self.state != "new":
            raise ReusedError("a transaction is entered once")
        self.base = self.db.store.latest()
        self.snapshot, self.state = self.base.copy(), "open"
        log.debug("transaction began at commit %d", self.base.number, extra={"commit": self.base.number, "mode": self.mode})
        return self

    def __exit__(self, kind: Any, error: Any, trace: Any) -> None:
        self.state = "closed"
        if kind is not None or not self.changed:
            self._discard()
            log.debug("transaction %s", "rolled back" if kind is not None else "ended without changes", extra={"error": kind and kind.__name__})
            return
        try:
            self._publish()
        except BaseException as e:
            self._discard()
            log.warning("transaction failed to commit: %s", type(e).__name__, extra={"error": type(e).__name__})
            raise
        self._discard(only="_scratch/")
        log.info("transaction committed %s", ", ".join(sorted(self.changed)), extra={"tables": sorted(self.changed)})

    def _discard(self, only: str = "") -> None:
        for folder in self.staged:
            if folder.startswith(only):
                self.db.store.files.delete(folder)

    def _publish(self) -> None:
        deadline = time.monotonic() + (self.timeout if self.timeout is not None else 30.0)
        for attempt in range(ATTEMPTS):
            try:
                self.db.store.publish(self.snapshot)
                return
            except ConflictError:
                latest = self.db.store.latest()
                # another writer's tables may be taken over if this one neither read nor wrote them
                if self.mode != "immediate" or attempt + 1 == ATTEMPTS or time.monotonic() > deadline or self._touched(latest):
                    raise
                new = latest.copy()
                for t in self.changed:
                    new.tables[t], new.high[t] = self.snapshot.tables[t], self.snapshot.high.get(t, 0)
                self.snapshot = new
                time.sleep(random.uniform(0, WAIT * 2**attempt))  # noqa: S311

    def _touched(self, latest: Snapshot) -> bool:
        if any(latest.tables.get(t) != self.base.tables.get(t) for t in {*self.models, *self.changed}):
            return True
        # rows that were referred to must still be there; added ones don't matter
        return any(not set(self.base.tables.get(t, ())) <= set(latest.tables.get(t, ())) for t in self.referred)

    def _ready(self) -> None:
        self.db._ready()
        if self.state == "new":
            raise NotStartedError("enter the transaction first")
        if self.state == "closed":
            raise ClosedError("the transaction is over")

    def table(self, model: type[Model]) -> DataFrame:
        self._ready()
        if model.table not in self.snapshot.tables:
            raise ExecutionError(f"there is no table {model.table}: migrate first")
        self.models[model.table] = model
        return self.db.store.read(model, self.snapshot.tables[model.table])

    def _referred(self, model: type[Model]) -> DataFrame:
        """A table that is read only for rows that are referred to."""
        known = model.table in self.models
        df = self.table(model)
        if not known:
            del self.models[model.table]
            self.referred.add(model.table)
        return df

    # writing

    def execute(self, query: Insert | Update | Delete) -> Any:
        """Inserts give None, updates and deletes the number of matching rows; with returning(), rows
        (one for an insert of a single row, else a list)."""
        self._ready()
        if isinstance(query, Insert):
            return run(lambda: self._insert(query), query)
        if isinstance(query, Update | Delete):
            return run(lambda: self._change(query), query)
        raise QueryConstructionError(f"execute() is for writes, not {type(query).__name__}")

    def execute_df(self, query: Insert | Update | Delete) -> DataFrame:
        """execute() of a query with returning(): its rows as a lazy DataFrame, of any size. For a delete it
        can be read as long as the transaction is open."""
        self._ready()
        if not isinstance(query, Insert | Update | Delete) or query.returned is None:
            raise QueryConstructionError("execute_df() is for writes with returning()")
        return run(lambda: self._insert(query, lazy=True) if isinstance(query, Insert) else self._change(query, lazy=True), query)

    def _stage(self, model: type[Model], df: DataFrame, *, anew: bool) -> DataFrame:
        folder = self.db.store.stage(model.table, df)
        self.staged.append(folder)
        self.snapshot.tables[model.table] = [folder] if anew else [*self.snapshot.tables[model.table], folder]
        self.changed.add(model.table)
        return self.db.store.read(model, [folder])

    def _returned(self, model: type[Model], columns: tuple[Attr, ...], df: DataFrame, lazy: bool = False) -> Any:
        if lazy:
            return df.select(*((c.name for c in columns) if columns else model.columns))
        if not columns:
            return [model.from_stored(r) for r in df.select(*model.columns).collect()]
        rows = df.select(*(c.name for c in columns)).collect()
        if len(columns) == 1:
            return [columns[0].decode(r[0]) for r in rows]
        return [tuple(c.decode(v) for c, v in zip(columns, r, strict=True)) for r in rows]

    def _insert(self, query: Insert, lazy: bool = False) -> Any:
        if not query.rows:
            if lazy:
                raise QueryConstructionError("an insert of no rows has no columns")
            return None if query.returned is None else []
        model, now = query.model, utc_millis(datetime.now(UTC))
        self.table(model)
        high = self.snapshot.high.get(model.table, 0)
        values = []
        for row in query.rows:
            one = []
            for name, attr in model.columns.items():
                v = row._values[name]
                if v is PENDING_GENERATION:
                    if attr.auto_increment:
                        v = high + 1
                    elif attr.default is CurrentTimestamp:
                        v = now.replace(tzinfo=None) if attr.codec.spark.simpleString() == "timestamp_ntz" else now
                    else:
                        raise NotNullError(f"{attr!r} has no value and the store gives none")
                if attr.auto_increment:
                    high = max(high, v)
                one.append(attr.encode(v))
            values.append(one)
        self.snapshot.high[model.table] = high
        spark = self.db.spark
        # nullable for Spark, so that nulls are found by the checks below with their names
        schema = type(model.schema())([type(f)(f.name, f.dataType, True) for f in model.schema()])
        rows = spark.createDataFrame(values, schema).coalesce(1)
        folder_rows = self._stage(model, rows, anew=False)
        self._check(model, folder_rows)
        if query.returned is None:
            return None
        out = self._returned(model, query.returned, folder_rows, lazy)
        return out if query.many or lazy else out[0]

    def append(self, model: type[Model], df: DataFrame, *, check: bool = True) -> None:
        """Add the rows of a DataFrame with the model's columns, at any size. Columns that the store
        fills may be null; ids follow no order. check=False leaves constraints to the caller."""
        self._ready()
        self.table(model)
        from pyspark.sql import Window

        df = df.select(*(F.col(f"`{n}`").cast(a.codec.spark).alias(n) for n, a in model.columns.items()))
        high = self.snapshot.high.get(model.table, 0)
        for name, attr in model.columns.items():
            if attr.default is CurrentTimestamp:
                df = df.withColumn(name, F.coalesce(F.col(name), F.date_trunc("MILLISECOND", F.current_timestamp()).cast(attr.codec.spark)))
            if attr.auto_increment:
                # numbers by part: a part's rows are numbered alone, then moved by the parts before
                parts = max(1, int(self.db.spark.conf.get("spark.sql.shuffle.partitions")))
                df = df.withColumn("_part", F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in model.columns)), F.lit(parts)))
                top = df.agg(F.max(name)).first()[0]
                high = max(high, top or 0)
                df = df.withColumn("_n", F.when(F.col(name).isNull(), F.row_number().over(Window.partitionBy("_part", F.col(name).isNull()).orderBy(F.lit(1)))))
                df = self.db.store.read_any(self._scratch(model, df))
                sizes = df.groupBy("_part").agg(F.max("_n").alias("_m"))
                starts = sizes.select("_part", (F.coalesce(F.sum("_m").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + high).alias("_from"))
                df = df.join(F.broadcast(starts), "_part").withColumn(name, F.coalesce(F.col(name), F.col("_from") + F.col("_n"))).select(*model.columns)
        rows = self._stage(model, df, anew=False)
        for attr in model.primary_key():
            if attr.auto_increment:
                self.snapshot.high[model.table] = max(high, rows.agg(F.max(attr.name)).first()[0] or 0)
        if check:
            self._check(model, rows)

    def _scratch(self, model: type[Model], df: DataFrame) -> str:
        folder = self.db.store.stage(f"_scratch/{model.table}", df)
        self.staged.append(folder)
        return folder

    def _change(self, query: Update | Delete, lazy: bool = False) -> Any:
        query.check_intent()
        model = query.model
        whole = Select("model", model, (), (), query.predicates, query.whole)
        self.table(model)
        entries = list(self.snapshot.tables[model.table])
        base = self.db.store.read(model, entries)
        base = (base.select("*", F.col("_metadata.file_path").alias("_file")) if entries else base.withColumn("_file", F.lit(""))).alias(model.table)
        scope = Scope(whole, self)
        hit = F.lit(True)
        if query.predicates:
            from sparrel.plans.lower import check

            check(whole, scope)
            # what is null is no hit
            hit = F.coalesce(conjunction(query.predicates, scope), F.lit(False))
        updating = isinstance(query, Update)
        # hits are kept; the other rows of their files are read again, and other files stay as they are
        found = self.db.store.read_any(self._scratch(model, base.where(hit).select(*(F.col(f"`{model.table}`.`{c}`") for c in model.columns), "_file")))
        files = found.groupBy("_file").agg(F.count(F.lit(1)).alias("n")).collect()  # a row for each file
        count = sum(r.n for r in files)
        before = found.select(*model.columns)
        if not count:
            if lazy:
                return self._returned(model, query.returned, before, lazy)
            return 0 if query.returned is None else []
        touched = {"/".join(r._file.rsplit("/", 3)[-3:]) for r in files}
        kept, again = self._split(entries, touched)
        rest = self.db.store.read(model, again).alias(model.table)
        rest = rest.where(~hit) if query.predicates else rest.where(F.lit(False))
        out = before
        self.snapshot.tables[model.table] = kept
        try:
            if query.predicates:
                self._stage(model, rest.select(*(F.col(f"`{model.table}`.`{c}`") for c in model.columns)), anew=False)
        except BaseException:
            self.snapshot.tables[model.table] = entries
            raise
        self.changed.add(model.table)
        new = None
        if updating:
            now = utc_millis(datetime.now(UTC))
            new = {x.attr.name: stored(x.attr, now if x.value is CurrentTimestamp else x.attr.encode(x.value)) for x in query.assignments}
            out = self._stage(model, before.select(*(new[n].alias(n) if n in new else F.col(f"`{n}`") for n in model.columns)), anew=False)
            self._check(model, out)
        self._follow(model, before, new)
        return count if query.returned is None else self._returned(model, query.returned, out, lazy)

    def _split(self, entries: list[str], touched: set[str]) -> tuple[list[str], list[str]]:
        """Entries of a table without touched files, and those files. A folder that holds some becomes its files."""
        kept, again = [], []
        for entry in entries:
            folder = "/".join(entry.split("/")[:2])
            if not any(f.startswith(folder + "/") for f in touched):
                kept.append(entry)
                continue
            files = [entry] if entry.count("/") > 1 else [f"{entry}/{n}" for n in self.db.store.files.names(entry) if n.startswith("part-")]
            for f in files:
                (again if f in touched else kept).append(f)
        return kept, again

    def compact(self, model: type[Model]) -> int:
        """Write a table as one folder, which many small inserts and updates ask for. Returns how many entries it had."""
        rows = self.table(model)
        entries = len(self.snapshot.tables[model.table])
        if entries > 1:
            self._stage(model, rows, anew=True)
        return entries

    # constraints

    def _check(self, model: type[Model], new: DataFrame) -> None:
        """NOT NULL, unique and foreign keys of the rows that were staged."""
        if not self.db.check_constraints:
            return
        needed = [a for a in model.columns.values() if not a.nullable]
        if needed:
            row = new.agg(*(F.count(F.when(F.col(f"`{a.name}`").isNull(), 1)).alias(a.name) for a in needed)).first()
            if bad := [a for a in needed if row[a.name]]:
                raise NotNullError(f"null in {', '.join(map(repr, bad))}")
        unique = [model.primary_key()] if model.primary_key() else []
        unique += [list(i.columns) for i in model.indexes if i.unique]
        for columns in unique:
            names = [c.name for c in columns]
            mine = new.dropna(subset=names).select(*names)
            # only keys that were written can repeat now
            twice = self.table(model).join(mine.distinct(), names, "left_semi").groupBy(*names).count().where("count > 1")
            if not twice.isEmpty():
                raise UniqueError(f"{model.table}: {', '.join(names)} would repeat")
        for attr in model.columns.values():
            target = attr.target
            if target is None:
                continue
            theirs = self._referred(target.model).select(F.col(f"`{target.name}`").alias(attr.name))
            if not new.select(attr.name).dropna().join(theirs, attr.name, "left_anti").isEmpty():
                raise ForeignKeyError(f"{attr!r} refers to no {target!r}")

    def _follow(self, model: type[Model], before: DataFrame, new: dict[str, Column] | None) -> None:
        """Rows of other tables that refer to values that are gone, by on_delete (new is None) or by
        on_update (new: the columns that were set)."""
        if not self.db.check_constraints:
            return
        for child in self.db.known_models():
            for attr in child.columns.values():
                target = attr.target
                if target is None or target.model is not model or new is not None and target.name not in new or child.table not in self.snapshot.tables:
                    continue
                still = self.table(model).select(F.col(f"`{target.name}`").alias("_k"))
                gone = before.select(F.col(f"`{target.name}`").alias("_k")).dropna().distinct().join(still, "_k", "left_anti")
                same = F.col(f"`{attr.name}`") == F.col("_k")
                rows = self.table(child)
                held = self.db.store.read_any(self._scratch(child, rows.join(gone, same, "left_semi").select(*child.columns)))
                if held.isEmpty():
                    continue
                action = attr.on_delete if new is None else attr.on_update
                if action in ("RESTRICT", "NO ACTION"):
                    raise ForeignKeyError(f"{attr!r} still refers to {target!r}")
                self._stage(child, rows.join(gone, same, "left_anti").select(*child.columns), anew=True)
                if action == "CASCADE" and new is None:
                    self._follow(child, held, None)
                    continue
                value = F.lit(None).cast(attr.codec.spark) if action == "SET NULL" else new[target.name]
                self._stage(child, held.withColumn(attr.name, value).select(*child.columns), anew=False)
                self._follow(child, held, {attr.name: value})


def stored(attr: Attr, value: Any) -> Column:
    """An encoded value as a column of the attribute's Spark type."""
    if isinstance(value, datetime):
        value = value.isoformat()  # py4j would read it in the driver's zone
    return F.lit(value).cast(attr.codec.spark)


class Database:
    """A store of tables, and a session to run on."""

    def __init__(self, spark: SparkSession, root: str, *, check_constraints: bool = True) -> None:
        self.spark, self.root, self.check_constraints = spark, root, check_constraints
        self.state = "open"
        self.store = Store(spark, root)
        self._models: dict[str, type[Model]] = {}

    @classmethod
    def initialize(cls, spark: SparkSession, root: str, *, check_constraints: bool = True) -> Database:
        """Connects only; tables come by migrate(). The session must be in UTC and in ANSI mode, which
        make times and overflows behave the same everywhere."""
        for key, value in (("spark.sql.session.timeZone", "UTC"), ("spark.sql.ansi.enabled", "true")):
            spark.conf.set(key, value)
            if spark.conf.get(key) != value:
                raise ConfigurationError(f"{key} must be {value}")
        return cls(spark, root, check_constraints=check_constraints)

    def __enter__(self) -> Self:
        self._ready()
        return self

    def __exit__(self, *_: Any) -> None:
        self.close()

    def close(self) -> None:
        self.state = "closed"

    def _ready(self) -> None:
        if self.state == "closed":
            raise ClosedError("the database is closed")

    def know(self, *models: type[Model]) -> None:
        """Models whose foreign keys count when rows that they refer to change."""
        self._models |= {m.table: m for m in models}

    def known_models(self) -> list[type[Model]]:
        return list(self._models.values())

    def transaction(self, *, timeout: float | None = None, mode: str = "deferred") -> Transaction:
        """mode="immediate" publishes again, a few times, if another writer came first but neither
        read nor wrote the same tables."""
        self._ready()
        return Transaction(self, timeout, mode)

    def migrate(self, migrations: dict[str, str]) -> list[str]:
        from sparrel.schema import migrate

        self._ready()
        return migrate(self, migrations)

    def verify(self, models: list[type[Model]], *, policy: str = "strict") -> list[str]:
        from sparrel.schema import verify

        self._ready()
        self.know(*models)
        return verify(self, models, policy)


class AsyncDatabase:
    """The same verbs as coroutines, each in a thread: Spark's actions block."""

    def __init__(self, db: Database) -> None:
        self.db = db

    async def fetch_all(self, query: Select) -> list:
        def work() -> list:
            with self.db.transaction() as tx:
                return tx.fetch_all(query)

        return await asyncio.to_thread(work)

    async def execute(self, *queries: Any) -> list:
        def work() -> list:
            with self.db.transaction() as tx:
                return [tx.execute(q) for q in queries]

        return await asyncio.to_thread(work)
