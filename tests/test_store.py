from __future__ import annotations

import asyncio
from datetime import UTC, datetime

import pytest

from sparrel import AsyncDatabase, CurrentTimestamp, Database, DateTime, ForeignKey, Index, Integer, Jdbc, Model, Text, UtcDatetime, delete, insert, scaffold, select, update
from sparrel.errors import ClosedError, ConflictError, ExecutionError, ForeignKeyError, MigrationError, NotNullError, NotStartedError, QueryCompilationError, QueryConstructionError, ReusedError, SchemaDriftError, SchemaPlanError, UniqueError


class Team(Model):
    id: Model.GenCol[int] = Integer(primary_key=True, auto_increment=True)
    name: Model.Col[str] = Text(unique=True)
    made: Model.GenCol[UtcDatetime] = DateTime(default=CurrentTimestamp)


class Member(Model):
    id: Model.Col[int] = Integer(primary_key=True)
    team_id: Model.FKCol[int | None] = ForeignKey(Team.id, nullable=True, on_delete="SET NULL", on_update="CASCADE")
    note: Model.Col[str | None] = Text(nullable=True, default=None)


class Badge(Model):
    member_id: Model.FKCol[int] = ForeignKey(Member.id, on_delete="CASCADE", primary_key=True)
    kind: Model.Col[str] = Text(primary_key=True)
    __indexes__ = [Index(kind, member_id)]


class Pass(Model):
    id: Model.Col[int] = Integer(primary_key=True)
    badge_owner: Model.FKCol[int] = ForeignKey(Member.id, on_delete="RESTRICT")


MODELS = [Team, Member, Badge]


@pytest.fixture
def db(spark, tmp_path):
    with Database.initialize(spark, f"file://{tmp_path}/store") as db:
        db.migrate({"0001": scaffold(MODELS)})
        db.verify(MODELS)
        yield db


def test_insert(db):
    before = datetime.now(UTC)
    with db.transaction() as tx:
        assert tx.execute(insert(Team(name="a"))) is None
        got = tx.execute(insert([Team(name="b"), Team(name="c")]).returning())
        assert [t.id for t in got] == [2, 3] and abs((got[0].made - before).total_seconds()) < 60 and got[0].made.microsecond % 1000 == 0
        assert tx.execute(insert(Team(id=10, name="d")).returning(Team.id)) == 10
        assert tx.execute(insert(Team(name="e")).returning(Team.id, Team.name)) == (11, "e")
        assert tx.execute(insert([])) is None and tx.execute(insert([]).returning()) == []
        assert tx.fetch_one(select(Team.count_all()).all()) == 5  # its own writes
    with db.transaction() as tx:
        assert sorted(tx.fetch_all(select(Team.id).all())) == [1, 2, 3, 10, 11]
        tx.execute(delete(Team).where(Team.id.eq(11)))
    with db.transaction() as tx:
        assert tx.execute(insert(Team(name="f")).returning(Team.id)) == 12  # ids aren't used again


def test_update_and_delete(db):
    with db.transaction() as tx:
        tx.execute(insert([Team(name=n) for n in "abc"]))
        tx.execute(insert([Member(id=i, team_id=i % 3 + 1 if i else None, note=None if i % 2 else "n") for i in range(6)]))
        assert tx.execute(update(Member).set(Member.note.to("x")).where(Member.note.eq("n"))) == 3
        # null is no match, in either form
        assert tx.execute(update(Member).set(Member.note.to("y")).where(~Member.note.eq("x"))) == 0
        assert sorted(tx.execute(update(Member).set(Member.note.to(None)).where(Member.id.lt(3)).returning(Member.id))) == [0, 1, 2]
        assert tx.execute(delete(Member).where(Member.note.ne("x"))) == 0
        assert [m.id for m in tx.execute(delete(Member).where(Member.note.eq("x")).returning())] == [4]
        assert tx.execute(update(Team).set(Team.made.to(CurrentTimestamp)).all()) == 3
        moved = update(Member).set(Member.note.to("sub")).where(Member.team_id.in_subquery(select(Team.id).where(Team.name.eq("a"))))
        assert tx.execute(moved) == 1
        assert tx.execute(delete(Member).all()) == 5 and tx.fetch_all(select(Member).all()) == []


def test_rollback_and_snapshots(db):
    with db.transaction() as tx:
        tx.execute(insert(Team(name="a")))
    reader = db.transaction().__enter__()
    with pytest.raises(RuntimeError), db.transaction() as tx:
        tx.execute(delete(Team).all())
        raise RuntimeError
    with db.transaction() as tx:
        tx.execute(insert(Team(name="b")))
    assert reader.fetch_all(select(Team.name).all()) == ["a"]
    with db.transaction() as tx:
        assert sorted(tx.fetch_all(select(Team.name).all())) == ["a", "b"]
    assert db.store.vacuum(keep=1) == []


def test_conflicts(db):
    a, b = db.transaction().__enter__(), db.transaction().__enter__()
    a.execute(insert(Team(name="a")))
    b.execute(insert(Team(name="b")))
    a.__exit__(None, None, None)
    with pytest.raises(ConflictError):
        b.__exit__(None, None, None)
    a, b = db.transaction().__enter__(), db.transaction(mode="immediate").__enter__()
    a.execute(insert(Team(name="c")))
    b.execute(insert(Member(id=1, team_id=None)))
    b.snapshot.copy()
    b.models.pop("team", None)  # the check of a null reference read teams
    a.__exit__(None, None, None)
    b.__exit__(None, None, None)
    with db.transaction() as tx:
        assert sorted(tx.fetch_all(select(Team.name).all())) == ["a", "c"] and tx.fetch_all(select(Member.id).all()) == [1]


def test_constraints(db):
    with db.transaction() as tx:
        tx.execute(insert([Team(name="a"), Team(name="b")]))
        tx.execute(insert([Member(id=1, team_id=1), Member(id=2, team_id=2)]))
        tx.execute(insert([Badge(member_id=1, kind="x"), Badge(member_id=1, kind="y"), Badge(member_id=2, kind="x")]))
    for query, error in [
        (insert(Team(name="a")), UniqueError),
        (insert(Member(id=1, team_id=1)), UniqueError),
        (insert([Badge(member_id=2, kind="z"), Badge(member_id=2, kind="z")]), UniqueError),
        (insert(Member(id=3, team_id=9)), ForeignKeyError),
        (insert(Team.construct(name=None)), NotNullError),
        (update(Member).set(Member.id.to(1)).all(), UniqueError),
    ]:
        with pytest.raises(error), db.transaction() as tx:
            tx.execute(query)
    with db.transaction() as tx:
        tx.execute(delete(Team).where(Team.name.eq("a")))
        assert sorted(tx.fetch_all(select(Member.id, Member.team_id).all())) == [(1, None), (2, 2)]
        tx.execute(update(Team).set(Team.id.to(7)).all())
        assert sorted(tx.fetch_all(select(Member.id, Member.team_id).all())) == [(1, None), (2, 7)]
        tx.execute(delete(Member).where(Member.id.eq(1)))
        assert tx.fetch_all(select(Badge.member_id).all()) == [2]


def test_restrict(spark, tmp_path):
    db = Database.initialize(spark, f"file://{tmp_path}/store")
    db.migrate({"0001": scaffold([Team, Member, Pass])})
    db.verify([Team, Member, Pass])
    with db.transaction() as tx:
        tx.execute(insert(Member(id=1, team_id=None)))
        tx.execute(insert(Pass(id=1, badge_owner=1)))
    with pytest.raises(ForeignKeyError), db.transaction() as tx:
        tx.execute(delete(Member).all())


def test_append_numbers_rows(db, spark):
    rows = [(None if i % 5 else 1000 + i, f"n{i}", None) for i in range(200)]
    with db.transaction() as tx:
        tx.execute(insert(Team(name="first")))
        tx.append(Team, spark.createDataFrame(rows, "id long, name string, made timestamp").repartition(6))
        got = tx.fetch_all(select(Team.id).all())
        assert len(got) == len(set(got)) == 201 and tx.fetch_one(select(Team.made.count()).all()) == 201
        assert tx.execute(insert(Team(name="last")).returning(Team.id)) == max(got) + 1


def test_misuse(db):
    tx = db.transaction()
    with pytest.raises(NotStartedError):
        tx.fetch_all(select(Team).all())
    with tx:
        with pytest.raises(QueryConstructionError):
            tx.execute(select(Team).all())
        with pytest.raises(QueryConstructionError):
            tx.fetch_all(insert(Team(name="x")))
        with pytest.raises(ExecutionError):
            tx.fetch_all(select(Pass).all())
        for bad in (update(Team).all(), update(Team).set(Team.name.to("x")), delete(Team)):
            with pytest.raises(QueryCompilationError):
                tx.execute(bad)
    with pytest.raises(ClosedError):
        tx.fetch_all(select(Team).all())
    with pytest.raises(ReusedError):
        tx.__enter__()
    with pytest.raises(QueryConstructionError):
        db.transaction(mode="sometimes")
    db.close()
    with pytest.raises(ClosedError):
        db.transaction()


def test_builders_of_writes_refuse():
    for make in (
        lambda: insert([Team(name="a"), Member(id=1, team_id=1)]),
        lambda: insert([Team(name="a"), Team(id=1, name="b")]),
        lambda: insert(Team),
        lambda: insert(Team.from_stored([1, "a", datetime(2020, 1, 1)])),
        lambda: update(Team).set(),
        lambda: update(Team).set(Member.note.to("x")),
        lambda: update(Team).set(Team.name.to("x"), Team.name.to("y")),
        lambda: delete(Team).where(Team.id.count().gt(1)),
        lambda: delete(Team).all().returning(Member.id),
        lambda: update(5),
    ):
        with pytest.raises(QueryConstructionError):
            make()


def test_migrations_run_once_in_order(db, spark):
    assert db.migrate({"0001": "this isn't run again"}) == [] and db.migrate({}) == []
    more = {"0001": "", "0002": "ALTER TABLE `member` ADD COLUMNS (\n  `age` BIGINT\n)", "0003": "nonsense here", "0004": "DROP TABLE badge"}
    with db.transaction() as tx:
        tx.execute(insert(Member(id=1, team_id=None)))
    with pytest.raises(MigrationError):
        db.migrate(more)
    assert db.store.latest().migrations == ["0001", "0002"]
    with pytest.raises(SchemaDriftError, match="member.age"):
        db.verify(MODELS)
    assert any("not declared" in x for x in db.verify(MODELS, policy="warn"))
    with pytest.raises(MigrationError):
        db.migrate({"0005": scaffold([Team])})
    assert db.migrate({"0006": "DROP TABLE badge"}) == ["0006"]
    assert any("badge: missing" in x for x in db.verify(MODELS, policy="warn"))
    with pytest.raises(QueryConstructionError):
        db.verify(MODELS, policy="maybe")


def test_scaffold_is_text_that_spark_reads(spark):
    text = scaffold([Member, Team])
    assert text.index("`team`") < text.index("CREATE TABLE `member`") and scaffold([]) == ""
    for statement in text.split(";\n"):
        if statement.strip():
            spark._jsparkSession.sessionState().sqlParser().parsePlan(statement)


def test_schema_plans_refuse():
    class Loose(Model):
        id: Model.Col[int] = Integer(primary_key=True)
        to: Model.FKCol[str | None] = ForeignKey(Member.note, nullable=True)

    for models in ([Member], [Team, Team], [Team, Member, Loose]):
        with pytest.raises(SchemaPlanError):
            scaffold(models)


def test_async_and_jdbc(db, spark):
    both = AsyncDatabase(db)

    async def work():
        await both.execute(insert(Team(name="a")))
        return await both.fetch_all(select(Team.name).all())

    assert asyncio.run(work()) == ["a"]
    options = Jdbc(spark, "jdbc:x:y", options={"user": "u"}, partitions={"team": ("id", 0, 9, 3)}).reader_options("team")
    assert options["dbtable"] == "team" and options["numPartitions"] == "3" and options["user"] == "u"
