"""A database by JDBC without a server: Apache Derby, which comes with Spark. Only one process at a time can have such
a database open, in its memory or on a disk, unless it is an archive, which none can write. So the driver loads it
from files that the executors wrote, and leaves an archive in the folder that all of them share. A process that
has read it keeps it open, with up to 1,000 of its pages, until it ends."""

from __future__ import annotations

import shutil
import tempfile
import zipfile
from collections.abc import Mapping
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparrel.errors import ConfigurationError
from sparrel.sources.scratch import scratch
from sparrel.sources.store import Files

DRIVER = "org.apache.derby.iapi.jdbc.AutoloadedDriver"
#: Rows of a partition when a table is read back.
ROWS = 50_000
_KINDS = ("string", "int", "bigint", "double")


def _field(name: str, kind: str) -> Column:
    """A value as Derby's import reads it: null as nothing, text in quotes. It has no NaN and no infinity: null."""
    c = F.col(f"`{name}`")
    if kind == "string":
        value = F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    elif kind == "double":
        value = F.when(F.abs(c) < float("inf"), c.cast("string"))
    else:
        value = c.cast("string")
    return F.coalesce(value, F.lit(""))


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def archive(spark: SparkSession, tables: Mapping[str, tuple[DataFrame, str]]) -> tuple[str, dict[str, tuple[str, int, int, int]]]:
    """Load tables of text and numbers, each given with its whole-numbered key, which gets an index and may be null or repeated. Returns
    the archive's URL and, for Jdbc, the partitions of each table: its key, the key's bounds and their number."""
    files, manager = Files(spark, scratch(spark, "derby")), spark._jvm.java.sql.DriverManager
    if files.local is None:
        raise ConfigurationError(f"Derby opens local files only, no {files.scheme}: set spark.checkpoint.dir to a file:// folder that all executors share")
    shared = Path(files.local)
    partitions = {}
    spark._jvm.java.lang.Class.forName(DRIVER)
    with tempfile.TemporaryDirectory() as own:
        folder = Path(own).resolve() / "db"
        url = f"jdbc:derby:{folder}"
        connection = manager.getConnection(f"{url};create=true")
        try:
            statement = connection.createStatement()
            for table, (df, key) in tables.items():
                if other := [c for c, kind in df.dtypes if kind not in _KINDS]:
                    raise ConfigurationError(f"columns of {table} that can't be loaded: {', '.join(other)}")
                # no rows, so no task: this makes the table, with Spark's types
                df.limit(0).write.format("jdbc").mode("append").options(url=url, dbtable=_quoted(table), driver=DRIVER).save()
                line = F.concat_ws(",", *(_field(c, kind) for c, kind in df.dtypes)).alias("line")
                df.select(line, F.col(f"`{key}`").alias("key")).sort("key", "line").select("line").write.text(f"{files.root}/{table}", compression="none", lineSep="\n")
                load = connection.prepareCall("call SYSCS_UTIL.SYSCS_IMPORT_TABLE(null, ?, ?, ',', '\"', 'UTF-8', 0)")
                load.setString(1, table)
                for part in sorted((shared / table).glob("part-*")):
                    if part.stat().st_size:
                        load.setString(2, str(part))
                        load.execute()
                    part.unlink()
                shutil.rmtree(shared / table)
                statement.execute(f"create index {_quoted(f'{table} by key')} on {_quoted(table)} ({_quoted(key)})")
                found = statement.executeQuery(f"select coalesce(min({_quoted(key)}), 0), coalesce(max({_quoted(key)}), 0), count(*) from {_quoted(table)}")
                found.next()
                low, high, rows = (found.getLong(i) for i in (1, 2, 3))
                partitions[table] = (key, low, high, max(4, -(-rows // ROWS)))
        finally:
            connection.close()
            try:
                manager.getConnection(f"{url};shutdown=true")
            except Py4JJavaError as e:  # so it tells that it is closed
                if e.java_exception.getSQLState() != "08006":
                    raise
        shared.mkdir(parents=True, exist_ok=True)
        # stored as they are: a compressed page could be found only by reading all before it
        with zipfile.ZipFile(path := shared / "db.jar", "w", zipfile.ZIP_STORED) as z:
            for f in sorted(folder.rglob("*")):
                if f.is_file() and f.relative_to(folder).parts[0] not in ("log", "tmp", "db.lck", "dbex.lck"):
                    z.write(f, f"db/{f.relative_to(folder)}")
    return f"jdbc:derby:jar:({path})db", partitions
