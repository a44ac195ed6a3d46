"""Queries of the catalogue that go through the verbs: whole rows of joins, writes with what they return, fetches,
schema verbs, reads by JDBC, and what is refused. Each has its SQL; a refusal is a row with the error's name."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparrel.catalogue import _OF_CUSTOMER, _OF_NATION, C, L, N, O, R, _database
from sparrel.model import DateTime, Integer, Model, Text
from sparrel.operators.expr import exists, scalar
from sparrel.operators.query import Select, delete, insert, select, update
from sparrel.runtime import Catalog, Database
from sparrel.schema import scaffold
from sparrel.sources import derby
from sparrel.sources.files import Jdbc, ParquetFolder
from sparrel.sources.scratch import scratch
from sparrel.types import CurrentTimestamp

Query = Callable[[SparkSession, str], DataFrame]


class Note(Model):
    """Columns that the store fills."""

    id: Model.GenCol[int] = Integer(primary_key=True, auto_increment=True)
    made: Model.GenCol[datetime] = DateTime(default=CurrentTimestamp)
    text: Model.Col[str | None] = Text(nullable=True)


class Tick(Model):
    """Nothing but columns that the store fills."""

    id: Model.GenCol[int] = Integer(primary_key=True, auto_increment=True)
    made: Model.GenCol[datetime] = DateTime(default=CurrentTimestamp)


def _rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def _whole(query: Select) -> Query:
    """Whole rows of several tables, their columns side by side."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = query.to_df(ParquetFolder(spark, sf_dir))
        return df.select(*(F.col(f"`{m.table}`.`{c}`") for m in query.models for c in m.columns))

    return run


def _empty(spark: SparkSession, *models: type[Model]) -> Database:
    db = Database.initialize(spark, scratch(spark, "store"))
    db.migrate({"0001": scaffold(list(models))})
    db.know(*models)
    return db


# writes


def insert_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _database(spark, sf_dir, R)
    with db.transaction() as tx:
        assert tx.execute(insert([R(r_regionkey=k, r_name=f"NEW {k}") for k in range(10, 13)])) is None
        assert tx.execute(insert([])) is None
    return db.transaction().__enter__().to_df(select(R).all())


def insert_all_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _empty(spark, Tick)
    with db.transaction() as tx:
        tx.execute(insert(Tick()))
        tx.execute(insert([Tick(), Tick()]))
    return db.transaction().__enter__().to_df(select(Tick).all()).select("id", F.col("made").isNotNull().alias("has_time"))


def insert_returning_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _empty(spark, Note)
    with db.transaction() as tx:
        one = tx.execute(insert(Note(text="a")).returning())
        more = tx.execute(insert([Note(text=None), Note(text="c")]).returning())
        pairs = tx.execute(insert([Note(text="d")]).returning(Note.id, Note.text))
    return _rows(spark, [(n.id, n.text) for n in (one, *more)] + pairs, "id long, text string")


def current_timestamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A time by default, and one set by an update, each within a minute of now."""
    db = _empty(spark, Note)
    with db.transaction() as tx:
        tx.execute(insert([Note(made=datetime.fromisoformat("2001-01-01T00:00:00+00:00"), text="old"), Note(made=datetime.fromisoformat("2001-01-01T00:00:00+00:00"), text="set")]))
        tx.execute(insert(Note(text="new")))
        tx.execute(update(Note).set(Note.made.to(CurrentTimestamp)).where(Note.text.eq("set")))
    df = db.transaction().__enter__().to_df(select(Note).all())
    return df.select("text", (F.abs(F.unix_timestamp("made") - F.unix_timestamp(F.current_timestamp())) < 60).alias("is_now"))


def update_with_subquery(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _database(spark, sf_dir, O)
    with db.transaction() as tx:
        tx.execute(update(C).set(C.c_mktsegment.to("LARGE"), C.c_acctbal.to(0.0)).where(exists(select(O.o_orderkey).where(O.o_custkey.eq_col(C.c_custkey), O.o_totalprice.gt(450000.0)))))
    return db.transaction().__enter__().to_df(select(C.c_custkey, C.c_mktsegment, C.c_acctbal).all())


def update_key_and_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A primary key is a column like others; counts are of rows that match, changed or not."""
    db = _database(spark, sf_dir, R)
    with db.transaction() as tx:
        counts = [tx.execute(update(R).set(R.r_regionkey.to(77)).where(R.r_regionkey.eq(1))), tx.execute(update(R).set(R.r_name.to("SAME")).where(R.r_regionkey.gte(2))), tx.execute(update(R).set(R.r_name.to("SAME")).where(R.r_name.eq("SAME"))), tx.execute(update(R).set(R.r_name.to("x")).where(R.r_regionkey.lt(0)))]
        rows = tx.execute(update(R).set(R.r_name.to("END")).where(R.r_regionkey.eq(77)).returning())
    return _rows(spark, [("count", k, n) for k, n in enumerate(counts)] + [(r.r_name, 0, r.r_regionkey) for r in rows], "what string, step int, n long")


def delete_returning(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _database(spark, sf_dir, R)
    with db.transaction() as tx:
        names = tx.execute(delete(R).where(R.r_regionkey.gt(2)).returning(R.r_name))
        rows = tx.execute(delete(R).where(R.r_regionkey.eq(0)).returning())
        left = tx.execute(delete(R).all())
    return _rows(spark, [(n,) for n in names] + [(r.r_name,) for r in rows] + [(f"{left} more",)], "r_name string")


def delete_with_subquery(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _database(spark, sf_dir, O)
    with db.transaction() as tx:
        tx.execute(delete(O).where(O.o_custkey.in_subquery(select(C.c_custkey).where(C.c_mktsegment.eq("BUILDING")))))
    return db.transaction().__enter__().to_df(select(O.o_orderkey).all())


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Own writes are read; an error undoes them; a snapshot stays; a child may be added while a parent is."""
    db = _database(spark, sf_dir, N)
    seen: list[tuple[str, int]] = []
    count = lambda tx, m, c: tx.fetch_one(select(c.count()).all())
    try:
        with db.transaction() as tx:
            tx.execute(insert(R(r_regionkey=9, r_name="x")))
            seen.append(("own write", count(tx, R, R.r_regionkey)))
            raise KeyError
    except KeyError:
        pass
    reader = db.transaction().__enter__()
    with db.transaction() as tx:
        seen.append(("after the error", count(tx, R, R.r_regionkey)))
        tx.execute(delete(N).where(N.n_nationkey.eq(0)))
    seen.append(("snapshot", count(reader, N, N.n_nationkey)))
    a, b = db.transaction().__enter__(), db.transaction(mode="immediate").__enter__()
    a.execute(insert(R(r_regionkey=10, r_name="parent")))
    b.execute(insert(N(n_nationkey=100, n_name="child", n_regionkey=1)))
    a.__exit__(None, None, None)
    b.__exit__(None, None, None)
    with db.transaction() as tx:
        seen += [("regions", count(tx, R, R.r_regionkey)), ("nations", count(tx, N, N.n_nationkey))]
    return _rows(spark, seen, "what string, n long")


# fetches


def fetch_verbs(spark: SparkSession, sf_dir: str) -> DataFrame:
    cat = Catalog(ParquetFolder(spark, sf_dir))
    by_key = select(R).all().order_by(R.r_regionkey.asc())
    out: list[tuple[str, str | None]] = [("fetch_all", r.r_name) for r in cat.fetch_all(by_key)]
    out.append(("fetch_one", cat.fetch_one(select(R.r_name).where(R.r_regionkey.eq(2)))))
    none = cat.fetch_one_or_none(select(R).where(R.r_regionkey.eq(-1)))
    out += [("fetch_one_or_none", none and none.r_name), ("fetch_one_or_none", cat.fetch_one_or_none(select(R).where(R.r_regionkey.eq(3))).r_name)]
    with cat.fetch_chunks(select(R.r_name).all().order_by(R.r_regionkey.asc()), 2) as chunks:
        out += [("fetch_chunks", "+".join(c)) for c in chunks]
    joined = cat.fetch_all(select(N).join(R, on=N.n_regionkey.references(R.r_regionkey)).where(N.n_nationkey.lt(3)))
    out += [("tuple", f"{n.n_nationkey} {r.r_regionkey}") for n, r in joined]
    return _rows(spark, out, "verb string, value string")


# schema


def schema_verbs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Migrations run once; verify finds no drift, then what a changed model would need."""
    db = Database.initialize(spark, scratch(spark, "store"))
    migrations = {"0001": scaffold([R, N])}
    out = [("ran", str(len(db.migrate(migrations)))), ("ran", str(len(db.migrate(migrations)))), ("drift", str(len(db.verify([R, N]))))]
    later = migrations | {"0002": "ALTER TABLE `region` ADD COLUMNS (\n  `extra` BIGINT\n);"}
    out.append(("ran", ",".join(db.migrate(later))))
    out += [("drift", x) for x in db.verify([R, N], policy="warn")]
    db.migrate(later | {"0003": "DROP TABLE `nation`;"})
    return _rows(spark, out + [("drift", x) for x in db.verify([R, N], policy="warn")], "what string, value string")


# JDBC


def jdbc_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of a database, the one that comes with Spark, read back by all executors in partitions by key with a filter."""
    url, partitions = derby.archive(spark, {"customer": (ParquetFolder(spark, sf_dir).table(C), "c_custkey")})
    source = Jdbc(spark, url, options={"driver": derby.DRIVER, "dbtable": '"customer"'}, partitions=partitions)
    return select(C.c_custkey, C.c_name).where(C.c_mktsegment.eq("BUILDING")).to_df(source)


# refusals


def _error(what: Callable[[], Any]) -> str:
    try:
        what()
    except Exception as e:  # noqa: BLE001
        return type(e).__name__
    return "none"


def refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    cat = Catalog(ParquetFolder(spark, sf_dir))
    closed = Database.initialize(spark, scratch(spark, "store"))
    closed.close()
    fresh = _empty(spark, Note)
    cases: dict[str, Callable[[], Any]] = {
        "no intent": lambda: cat.to_df(select(R)),
        "where after all": lambda: select(R).all().where(R.r_regionkey.eq(1)),
        "model beside a column": lambda: select(R, N.n_name),
        "truth of a predicate": lambda: bool(R.r_regionkey.eq(1)),
        "column of another table": lambda: cat.to_df(select(R.r_name).where(N.n_name.eq("x"))),
        "aggregate in where": lambda: select(R.r_name).where(R.r_regionkey.count().gt(1)),
        "table joined twice": lambda: select(C).join(N, on=_OF_NATION).join(N, on=_OF_NATION),
        "join of an unknown table": lambda: select(R.r_name).join(C, on=_OF_NATION),
        "column not in group by": lambda: cat.to_df(select(C.c_name, C.c_custkey.count()).all().group_by(C.c_mktsegment)),
        "having without groups": lambda: cat.to_df(select(C.c_name).all().having(C.c_name.eq("x"))),
        "distinct by what is not selected": lambda: cat.to_df(select(C.c_name).distinct().all().order_by(C.c_custkey.asc())),
        "negative limit": lambda: select(C.c_name).limit(-1),
        "no row": lambda: cat.fetch_one(select(R).where(R.r_regionkey.eq(-1))),
        "several rows": lambda: cat.fetch_one(select(R).all()),
        "one or none of a value": lambda: cat.fetch_one_or_none(select(R.r_name).all()),
        "several rows of a scalar": lambda: cat.fetch_all(select(R.r_name, scalar(select(N.n_name).where(N.n_regionkey.eq_col(R.r_regionkey)).limit(2))).all()),
        "closed database": closed.transaction,
        "transaction not entered": lambda: fresh.transaction().fetch_all(select(Note).all()),
        "unknown mode": lambda: fresh.transaction(mode="other"),
        "update without set": lambda: fresh.transaction().__enter__().execute(update(Note).all()),
        "select executed": lambda: fresh.transaction().__enter__().execute(select(Note).all()),
        "null where none may be": lambda: R(r_regionkey=1, r_name=None),
        "unknown table": lambda: fresh.transaction().__enter__().fetch_all(select(R).all()),
    }
    return _rows(spark, [(k, _error(v)) for k, v in cases.items()], "what string, error string")


#: What each case of refusals() gives.
ERRORS = {
    "no intent": "QueryCompilationError",
    "where after all": "QueryConstructionError",
    "model beside a column": "QueryConstructionError",
    "truth of a predicate": "TypeError",
    "column of another table": "QueryCompilationError",
    "aggregate in where": "QueryConstructionError",
    "table joined twice": "QueryConstructionError",
    "join of an unknown table": "QueryConstructionError",
    "column not in group by": "QueryCompilationError",
    "having without groups": "QueryCompilationError",
    "distinct by what is not selected": "QueryCompilationError",
    "negative limit": "ValueRefusedError",
    "no row": "NoResultError",
    "several rows": "MultipleResultsError",
    "one or none of a value": "QueryConstructionError",
    "several rows of a scalar": "ExecutionError",
    "closed database": "ClosedError",
    "transaction not entered": "NotStartedError",
    "unknown mode": "QueryConstructionError",
    "update without set": "QueryCompilationError",
    "select executed": "QueryConstructionError",
    "null where none may be": "ModelValidationError",
    "unknown table": "ExecutionError",
}


def _values(names: str, rows: list[tuple]) -> str:
    text = lambda v: "null" if v is None else f"'{v}'" if isinstance(v, str) else f"cast({v} as bigint)"
    return f"select * from (values {', '.join('(' + ', '.join(map(text, r)) + ')' for r in rows)}) t({names})"


QUERIES: dict[str, Query] = {
    "join_model_inner": _whole(select(C).join(N, on=_OF_NATION).where(C.c_acctbal.gt(0.0))),
    "join_model_left": _whole(select(C).left_join(O, on=_OF_CUSTOMER).all()),
    "join_model_chain": _whole(select(C).join(N, on=_OF_NATION).left_join(R, on=N.n_regionkey.references(R.r_regionkey)).all().order_by(C.c_custkey.asc()).limit(50)),
    **{f.__name__: f for f in (insert_many, insert_all_pending, insert_returning_rows, current_timestamp, update_with_subquery, update_key_and_count, delete_returning, delete_with_subquery, transactions, fetch_verbs, schema_verbs, jdbc_scan, refusals)},
}

SQL: dict[str, str] = {
    "join_model_inner": "select c.*, n.* from customer c join nation n on c_nationkey = n_nationkey where c_acctbal > 0",
    "join_model_left": "select c.*, o.* from customer c left join orders o on o_custkey = c_custkey",
    "join_model_chain": "select c.*, n.*, r.* from customer c join nation n on c_nationkey = n_nationkey left join region r on n_regionkey = r_regionkey order by c_custkey limit 50",
    "insert_many": "select * from region union all select k, 'NEW ' || k from (values (10), (11), (12)) t(k)",
    "insert_all_pending": "select cast(k as bigint) as id, true as has_time from (values (1), (2), (3)) t(k)",
    "insert_returning_rows": _values("id, text", [(1, "a"), (2, None), (3, "c"), (4, "d")]),
    "current_timestamp": "select * from (values ('old', false), ('set', true), ('new', true)) t(text, is_now)",
    "update_with_subquery": "with large as (select distinct o_custkey from orders where o_totalprice > 450000) select c_custkey, case when o_custkey is null then c_mktsegment else 'LARGE' end as c_mktsegment, case when o_custkey is null then c_acctbal else 0 end as c_acctbal from customer left join large on o_custkey = c_custkey",
    "update_key_and_count": "select 'count' as what, cast(0 as int) as step, count(*) as n from region where r_regionkey = 1 union all select 'count', 1, count(*) + 1 from region where r_regionkey >= 2 union all select 'count', 2, count(*) + 1 from region where r_regionkey >= 2 union all select 'count', 3, 0 union all select 'END', 0, 77",
    "delete_returning": "select r_name from region where r_regionkey > 2 or r_regionkey = 0 union all select count(*) || ' more' from region where r_regionkey in (1, 2)",
    "delete_with_subquery": "select o_orderkey from orders where not coalesce(o_custkey in (select c_custkey from customer where c_mktsegment = 'BUILDING'), false)",
    "transactions": "select 'own write' as what, count(*) + 1 as n from region union all select 'after the error', count(*) from region union all select 'snapshot', count(*) from nation union all select 'regions', count(*) + 1 from region union all select 'nations', count(*) from nation",
    "fetch_verbs": "select 'fetch_all' as verb, r_name as value from region union all select 'fetch_one', r_name from region where r_regionkey = 2 union all select 'fetch_one_or_none', null union all select 'fetch_one_or_none', r_name from region where r_regionkey = 3"
    " union all select 'fetch_chunks', string_agg(r_name, '+' order by r_regionkey) from (select *, (row_number() over (order by r_regionkey) - 1) // 2 as c from region) group by c union all select 'tuple', n_nationkey || ' ' || n_regionkey from nation where n_nationkey < 3",
    "schema_verbs": _values("what, value", [("ran", "1"), ("ran", "0"), ("drift", "0"), ("ran", "0002"), ("drift", "region.extra: not declared"), ("drift", "region.extra: not declared"), ("drift", "nation: missing")]),
    "jdbc_scan": "select c_custkey, c_name from customer where c_mktsegment = 'BUILDING'",
    "refusals": _values("what, error", list(ERRORS.items())),
}
