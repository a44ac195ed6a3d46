import logging
import os
import subprocess
import sys
import time
from pathlib import Path

import duckdb
import pytest

from sparrel import catalogue, verbs
from sparrel.catalogue import C, N, R
from sparrel.errors import ConfigurationError, ConflictError
from sparrel.operators.query import delete, insert, select, update
from sparrel.runtime import Database
from sparrel.schema import migrate, scaffold
from sparrel.sources import derby
from sparrel.sources import scratch as scratch_folder
from sparrel.sources.files import Jdbc, ParquetFolder

SF = "/root/testdata/sf0.001"
NESTED = [n for n in catalogue.SELECTS if n.startswith("nested") or "limit" in n]


@pytest.mark.parametrize("name", [*verbs.QUERIES, *NESTED])
def test_query_against_its_sql(spark, name):
    con = duckdb.connect()
    for t in "region nation customer orders lineitem".split():
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(catalogue.SQL[name])
    columns = [c[0] for c in want.description]
    df = catalogue.QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(columns)
    assert sorted(tuple(str(r[c]) for c in columns) for r in df.collect()) == sorted(tuple(map(str, r)) for r in want.fetchall())


@pytest.mark.parametrize("name", [n for n in NESTED if n.startswith("nested")])
def test_nested_subqueries_multiply_no_tables(spark, name):
    plan = catalogue.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Cross" not in plan and "Cartesian" not in plan


@pytest.fixture
def db(spark, tmp_path):
    db = Database.initialize(spark, str(tmp_path / "store"))
    migrate(db, {"1": scaffold([R, N, C])})
    with db.transaction() as tx:
        for m in (R, N, C):
            tx.append(m, ParquetFolder(spark, SF).table(m).repartitionByRange(4, *[next(iter(m.columns))]))
    return db


def test_writes_touch_only_files_that_hold_hits(db):
    before = db.store.latest().tables["customer"]
    with db.transaction() as tx:
        assert tx.execute(update(C).set(C.c_name.to("first")).where(C.c_custkey.eq(tx.fetch_one(select(C.c_custkey.min()).all())))) == 1
    after = db.store.latest().tables["customer"]
    files = db.store.files.names(before[0])
    parts = [f for f in files if f.startswith("part-")]
    kept = [e for e in after if e.startswith(before[0] + "/")]
    assert len(before) == 1 and len(kept) == len(parts) - 1 >= 2
    with db.transaction() as tx:
        assert tx.execute(delete(C).where(C.c_name.eq("first"))) == 1
        assert tx.fetch_one(select(C.c_custkey.count()).all()) == 149
    assert [e for e in db.store.latest().tables["customer"] if e.startswith(before[0] + "/")] == kept
    assert not [f for f in db.store.vacuum() if f == before[0]]  # some of its files are still read
    with db.transaction() as tx:
        assert tx.compact(C) > 1
        assert tx.fetch_one(select(C.c_custkey.count()).all()) == 149
    assert len(db.store.latest().tables["customer"]) == 1 and before[0] in db.store.vacuum()
    with db.transaction() as tx:
        assert tx.fetch_one(select(C.c_custkey.count()).all()) == 149


def test_returning_as_a_frame(db):
    with db.transaction() as tx:
        rows = tx.execute_df(update(C).set(C.c_acctbal.to(1.0)).where(C.c_custkey.lte(3)).returning(C.c_custkey, C.c_acctbal))
        assert rows.columns == ["c_custkey", "c_acctbal"] and {r.c_acctbal for r in rows.collect()} == {1.0}
        assert tx.execute_df(insert(R(r_regionkey=50, r_name="x")).returning()).first().r_name == "x"
        gone = tx.execute_df(delete(R).where(R.r_regionkey.eq(50)).returning(R.r_name))
        assert [r.r_name for r in gone.collect()] == ["x"]
        assert tx.execute_df(delete(R).where(R.r_regionkey.eq(50)).returning(R.r_name)).count() == 0


def test_added_parents_do_not_conflict_and_deleted_ones_do(db):
    a, b = db.transaction().__enter__(), db.transaction(mode="immediate").__enter__()
    a.execute(insert(R(r_regionkey=60, r_name="new")))
    b.execute(insert(N(n_nationkey=60, n_name="child", n_regionkey=0)))
    a.__exit__(None, None, None)
    b.__exit__(None, None, None)
    with db.transaction() as tx:
        assert tx.fetch_one(select(R.r_name).where(R.r_regionkey.eq(60))) == "new" and tx.fetch_one(select(N.n_name).where(N.n_nationkey.eq(60))) == "child"
    a, b = db.transaction().__enter__(), db.transaction(mode="immediate").__enter__()
    a.execute(delete(R).where(R.r_regionkey.eq(60)))
    b.execute(insert(N(n_nationkey=61, n_name="orphan", n_regionkey=60)))
    a.__exit__(None, None, None)
    with pytest.raises(ConflictError):
        b.__exit__(None, None, None)


def test_commits_without_links(db, monkeypatch):
    """Stores that are no local disk: a rename that fails if the name is taken, or refusal."""
    files = db.store.files
    files.local = None
    with pytest.raises(ConfigurationError):
        files.create("_commits/a", "x")
    monkeypatch.setattr("sparrel.sources.store.ATOMIC", {"file"})
    assert files.create("_commits/a", "x") and not files.create("_commits/a", "y") and files.read("_commits/a") == "x"
    assert not [n for n in files.names("_commits") if n.endswith(".part")]


def test_the_last_commit_is_found_from_a_hint(db):
    for i in range(20):
        with db.transaction() as tx:
            tx.execute(insert(R(r_regionkey=100 + i, r_name="x")))
    other = Database.initialize(db.spark, db.root)
    assert int(db.store.files.read("_commits/hint")) == 16 and other.store.latest().number == db.store.latest().number > 20


def test_a_dead_migration_lock_is_broken(db):
    db.store.files.create("_commits/migrating.lock", str(time.time() - 10_000))
    assert migrate(db, {"1": scaffold([R, N, C]), "2": "DROP TABLE `customer`;"}) == ["2"]
    assert not [n for n in db.store.files.names("_commits") if "lock" in n]


def test_log_records(db, caplog):
    with caplog.at_level(logging.DEBUG, "sparrel.runtime"):
        with db.transaction() as tx:
            tx.fetch_all(select(R.r_name).where(R.r_name.eq("secret")))
            tx.execute(insert(R(r_regionkey=70, r_name="secret")))
        with pytest.raises(ZeroDivisionError), db.transaction() as tx:
            tx.execute(delete(R).where(R.r_regionkey.eq(70)))
            raise ZeroDivisionError
    kinds = [getattr(r, "kind", None) for r in caplog.records]
    assert "select" in kinds and "insert" in kinds and "delete" in kinds and "secret" not in caplog.text
    assert "transaction began" in caplog.text and "committed region" in caplog.text and "rolled back" in caplog.text
    record = next(r for r in caplog.records if getattr(r, "kind", None) == "select")
    assert record.table == "region" and record.seconds >= 0 and record.rows == 0


def test_scratch_goes(spark):
    path = scratch_folder.scratch(spark, "x")
    spark.range(3).write.parquet(path)
    # others of this session may still read theirs: only the folder's place is checked here
    assert path.startswith(f"{scratch_folder.shared_dir(spark)}/sparrel/{spark.sparkContext.applicationId}/") and spark.read.parquet(path).count() == 3


def test_jdbc_scan_on_executors_in_processes_of_their_own(tmp_path):
    import pyspark

    for f in Path(pyspark.__file__).parent.iterdir():  # the executors' folders go to work in Spark's home
        if f.name != "work":
            (tmp_path / "home" / f.name).parent.mkdir(exist_ok=True)
            (tmp_path / "home" / f.name).symlink_to(f)
    conf = {"spark.master": "local-cluster[2,1,1024]", "spark.ui.enabled": "false", "spark.driver.host": "127.0.0.1", "spark.checkpoint.dir": f"file://{tmp_path}/shared files", "spark.sql.warehouse.dir": f"{tmp_path}/warehouse"}
    code = f"""
from pyspark.sql import SparkSession
from __spark_entry__ import queries
spark = SparkSession.builder.config(map={conf}).getOrCreate()
spark.sparkContext.setLogLevel("OFF")
df = queries()["jdbc_scan"](spark, {SF!r})
df.write.parquet({str(tmp_path / "out")!r})
print("partitions", df.rdd.getNumPartitions())
spark.stop()
"""
    env = os.environ | {"SPARK_HOME": str(tmp_path / "home"), "SPARK_SCALA_VERSION": "2.13", "SPARK_LOCAL_IP": "127.0.0.1", "PYTHONPATH": str(Path(__file__).parents[1])}
    run = subprocess.run([sys.executable, "-c", code], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert "partitions 4" in run.stdout, run.stderr[-2000:]
    con = duckdb.connect()
    con.execute(f"create view customer as select * from '{SF}/customer.parquet'")
    assert sorted(con.execute(f"select * from '{tmp_path}/out/*.parquet'").fetchall()) == sorted(con.execute(verbs.SQL["jdbc_scan"]).fetchall())


def test_jdbc_scan_of_odd_rows(spark, tmp_path):
    names = ["", None, " a b ", "x" * 40_000, 'q"u,o\'te\\', "\r\n", '"', "\0", "\U0001f600", "twice", "twice"]
    rows = [(k if k < 9 else 9, n, 1, float("nan"), "BUILDING") for k, n in enumerate(names)]
    rows += [(None, "null key", None, None, "BUILDING"), (-(2**63), "least", 1, float("inf"), "BUILDING"), (2**63 - 1, "most", 1, 1e308, "BUILDING")]
    others = [(50, "blank", 1, 1.0, "BUILDING "), (51, "case", 1, 1.0, "building"), (52, "null", 1, 1.0, None), (53, "long", 1, 1.0, "y" * 40_000)]
    for n, part in enumerate((rows + others, others, [])):
        spark.createDataFrame(part, "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string").write.parquet(f"{tmp_path}/{n}/customer.parquet")
        want = [(r[0], r[1]) for r in part if r[4] == "BUILDING"]
        assert sorted(map(tuple, verbs.jdbc_scan(spark, f"{tmp_path}/{n}").collect()), key=str) == sorted(want, key=str)


def test_jdbc_partitions_and_what_goes_to_the_database(spark):
    df = ParquetFolder(spark, SF).table(C)
    url, partitions = derby.archive(spark, {"customer": (df, "c_custkey")})
    assert partitions == {"customer": ("c_custkey", *df.selectExpr("min(c_custkey)", "max(c_custkey)").first(), 4)}

    def pushed(**more):
        source = Jdbc(spark, url, options={"driver": derby.DRIVER, "dbtable": '"customer"'}, partitions=partitions, **more)
        found = select(C.c_name).where(C.c_mktsegment.eq("BUILDING"), C.c_custkey.gt(100)).to_df(source)
        return found, found._jdf.queryExecution().executedPlan().toString().partition("PushedFilters: ")[2].partition("]")[0]

    found, conditions = pushed()
    assert "c_custkey" in conditions and "c_mktsegment" not in conditions
    assert found.count() == df.where("c_mktsegment = 'BUILDING' and c_custkey > 100").count() > 0
    assert "c_mktsegment" in pushed(push_text=True)[1]
    with pytest.raises(ConfigurationError, match="c_blob"):
        derby.archive(spark, {"customer": (df.selectExpr("c_custkey", "cast(c_name as binary) as c_blob"), "c_custkey")})
