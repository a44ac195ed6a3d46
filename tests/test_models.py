from __future__ import annotations

import copy
import pickle
import uuid
import warnings
from datetime import UTC, datetime, timedelta, timezone

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import types as T

from sparrel import PENDING_GENERATION, Blob, Boolean, CurrentTimestamp, DateTime, ForeignKey, Index, Integer, Json, Model, Real, Text, UtcDatetime, Uuid
from sparrel.errors import ImmutableRowError, LexicalOrderWarning, ModelDeclarationError, ModelValidationError
from sparrel.types import Json as JsonOf
from sparrel.types import codec_of


class Account(Model):
    id: Model.GenCol[int] = Integer(primary_key=True, auto_increment=True)
    email: Model.Col[str] = Text(unique=True)
    status: Model.Col[str] = Text(default="active", index=True)
    score: Model.Col[float | None] = Real(nullable=True, default=None)
    made: Model.GenCol[UtcDatetime] = DateTime(default=CurrentTimestamp)


class HTTPLogEntry(Model):
    id: Model.Col[int] = Integer(primary_key=True)
    account_id: Model.FKCol[int] = ForeignKey(Account.id, on_delete="CASCADE")


def test_names_and_schema():
    assert Account.table == "account" and HTTPLogEntry.table == "http_log_entry"
    schema = HTTPLogEntry.schema()
    assert schema["account_id"].dataType == T.LongType() and schema["account_id"].metadata["references"] == "account.id"
    assert Account.schema()["score"].nullable and not Account.schema()["email"].nullable
    assert [i.name("account") for i in Account.indexes] == ["ux_account_email", "ix_account_status"]


def test_rows_are_values():
    a, b = Account(email="x"), Account(email="x")
    assert a == b and a != Account(email="y") and a.status == "active" and a.id is PENDING_GENERATION
    assert "x" not in repr(a) and "pending" in repr(a)
    with pytest.raises(ImmutableRowError):
        a.email = "z"
    with pytest.raises(ImmutableRowError):
        del a.email
    with pytest.raises(TypeError):
        hash(a)
    got = Account.from_stored([1, "x", "on", None, datetime(2020, 1, 1)])
    assert got.made == datetime(2020, 1, 1, tzinfo=UTC) and got != a and "x" in repr(got)


def test_construction_is_checked():
    for bad in ({}, {"email": 1}, {"email": None}, {"email": "x", "nope": 1}, {"email": "x", "score": "1"}, {"email": "x", "score": float("nan")}, {"email": "x", "id": 2**63}, {"email": "x", "made": datetime(2020, 1, 1)}, {"email": PENDING_GENERATION}):
        with pytest.raises(ModelValidationError):
            Account(**bad)
    assert Account.construct(email=5).email == 5
    with pytest.raises(ModelValidationError):
        Account.from_stored([None, "x", "on", None, None])
    assert Account.from_stored([None] * 5, validate=False).email is None


def test_pending_is_one_value():
    assert copy.deepcopy(PENDING_GENERATION) is pickle.loads(pickle.dumps(PENDING_GENERATION)) is PENDING_GENERATION
    with pytest.raises(TypeError):
        bool(PENDING_GENERATION)


def declare(**columns):
    notes = {k: v[0] for k, v in columns.items()}
    return type("Made", (Model,), {**{k: v[1] for k, v in columns.items()}, "__annotations__": notes, "__module__": __name__})


@pytest.mark.parametrize(
    "columns",
    [
        {},
        {"a": (Model.Col[int | None], Integer())},
        {"a": (Model.Col[int], Integer(nullable=True))},
        {"a": (Model.Col[int], Integer(default=CurrentTimestamp))},
        {"a": (Model.Col[str], Integer())},
        {"a": (int, Integer())},
        {"a": (Model.Col, Integer())},
        {"a": (Model.GenCol[str], Text(primary_key=True, auto_increment=True))},
        {"a": (Model.Col[int], Integer(primary_key=True, unique=True))},
        {"a": (Model.Col[int], Integer(index=True, unique=True))},
        {"a": (Model.Col[int | None], Integer(nullable=True, primary_key=True))},
        {"a": (Model.Col[int], ForeignKey(Account.id))},
        {"a": (Model.FKCol[int], Integer())},
        {"a": (Model.FKCol[int], ForeignKey(Account.id, on_delete="SET NULL"))},
        {"a": (Model.GenCol[int], Integer(primary_key=True, auto_increment=True)), "b": (Model.Col[int], Integer(primary_key=True))},
        {"a": (Model.Col[int | str], Integer())},
    ],
)
def test_declarations_that_cannot_work(columns):
    with pytest.raises(ModelDeclarationError):
        declare(**columns)


def test_more_declarations_that_cannot_work():
    for make in (
        lambda: type("Sub", (Account,), {}),
        lambda: type("Mixed", (Model, dict), {"a": Integer(), "__annotations__": {"a": Model.Col[int]}, "__module__": __name__}),
        lambda: type("Stray", (Model,), {"a": Integer(), "__annotations__": {"a": Model.Col[int], "b": int}, "__module__": __name__}),
        lambda: type("Named", (Model,), {"a": Integer(), "__tablename__": "a b", "__annotations__": {"a": Model.Col[int]}, "__module__": __name__}),
        lambda: type("Twice", (Model,), {"a": (c := Integer(index=True)), "__indexes__": [Index(c)], "__annotations__": {"a": Model.Col[int]}, "__module__": __name__}),
        lambda: Integer(default=1, default_factory=int),
        lambda: ForeignKey(Account.id, on_delete="MAYBE"),
        lambda: Index(),
        lambda: Index(Account.id, Account.id),
    ):
        with pytest.raises(ModelDeclarationError):
            make()


def test_lexical_times_warn():
    with pytest.warns(LexicalOrderWarning):
        declare(at=(Model.Col[datetime], Text()))
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        declare(at=(Model.Col[UtcDatetime], Text()))


def test_state_parameters_are_for_type_checkers():
    class User[S](Model[S, "User"]):
        id: User.Col[int] = Integer(primary_key=True)

    assert User(id=1).id == 1 and User.table == "user"


PAIRS = [
    ("integer", int, st.integers(-(2**63), 2**63 - 1)),
    ("integer", bool, st.booleans()),
    ("real", float, st.floats(allow_nan=False, allow_infinity=False)),
    ("text", str, st.text()),
    ("blob", bytes, st.binary()),
    ("boolean", bool, st.booleans()),
    ("text", uuid.UUID, st.uuids()),
    ("blob", uuid.UUID, st.uuids()),
    ("uuid", uuid.UUID, st.uuids()),
    ("text", JsonOf[dict[str, int]], st.dictionaries(st.text(), st.integers(-(2**53), 2**53))),
    ("json", list[str], st.lists(st.text())),
    ("text", datetime, st.datetimes()),
]


@given(st.data())
def test_values_come_back(data):
    storage, logical, values = data.draw(st.sampled_from(PAIRS))
    codec = codec_of(storage, logical)
    value = data.draw(values)
    assert codec.decode(codec.encode(codec.check(value))) == value


@given(st.datetimes(min_value=datetime(1900, 1, 1)), st.integers(-14 * 60, 14 * 60))
def test_times_are_utc_milliseconds(value, minutes):
    codec = codec_of("text", UtcDatetime)
    aware = value.replace(tzinfo=timezone(timedelta(minutes=minutes)))
    got = codec.check(aware)
    assert got.tzinfo is UTC and got.microsecond % 1000 == 0 and timedelta(0) <= aware - got < timedelta(milliseconds=1)


def test_values_that_do_not_fit():
    for storage, logical, bad in [
        ("integer", int, 2**63),
        ("integer", int, 1.5),
        ("real", float, float("inf")),
        ("real", float, True),
        ("text", str, 1),
        ("blob", bytes, "x"),
        ("boolean", bool, 1),
        ("text", UtcDatetime, datetime(2020, 1, 1)),
        ("text", datetime, datetime(2020, 1, 1, tzinfo=timezone(timedelta(seconds=30)))),
        ("json", dict[str, int], {"a": "b"}),
        ("json", dict, {1, 2}),
        ("uuid", uuid.UUID, "x"),
    ]:
        with pytest.raises(ModelValidationError):
            codec_of(storage, logical).check(bad)
    for storage, logical, bad in [("integer", bool, 2), ("json", int, "{"), ("json", int, '"x"')]:
        with pytest.raises(ModelValidationError):
            codec_of(storage, logical).decode(bad)
    assert codec_of("integer", int).check(True) == 1


class Everything(Model):
    id: Model.Col[int] = Integer(primary_key=True)
    real: Model.Col[float] = Real()
    text: Model.Col[str] = Text()
    blob: Model.Col[bytes] = Blob()
    flag: Model.Col[bool] = Boolean()
    key: Model.Col[uuid.UUID] = Uuid()
    data: Model.Col[dict] = Json()
    at: Model.Col[datetime] = DateTime()
    local: Model.Col[datetime] = DateTime(zone=False)


def test_spark_types():
    assert [f.dataType.simpleString() for f in Everything.schema()] == ["bigint", "double", "string", "binary", "boolean", "string", "string", "timestamp", "timestamp_ntz"]
