"""Where queries keep what they write between their steps: a folder that all executors share, one for each
application. It is removed when the driver's process ends, or by clear()."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import SparkSession

from sparrel.errors import ConfigurationError

#: Temporary folders of local applications, and folders of applications that have any.
_LOCAL: dict[str, str] = {}
_USED: dict[str, tuple[SparkSession, str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir. Only where that is unset and
    the master is local (as in tests) a temporary folder serves, one for each application."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master, application = spark.sparkContext.master, spark.sparkContext.applicationId
        if master != "local" and not master.startswith("local["):
            raise ConfigurationError("set spark.checkpoint.dir to a folder that all executors share")
        if application not in _LOCAL:
            _LOCAL[application] = "file://" + tempfile.mkdtemp(prefix="sparrel-checkpoint-")
        base = _LOCAL[application]
    return base.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the application's scratch folder."""
    application = spark.sparkContext.applicationId
    folder = f"{shared_dir(spark)}/sparrel/{application}"
    _USED[application] = (spark, folder)
    return f"{folder}/{uuid.uuid4().hex}/{name}"


def clear(spark: SparkSession) -> bool:
    """Remove the application's scratch folder; results that still read from it are lost. Whether it was there."""
    used = _USED.pop(spark.sparkContext.applicationId, None)
    if used is None:
        return False
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(used[1])
    return bool(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True))


@atexit.register
def _clear_all() -> None:
    for spark, _ in list(_USED.values()):
        with contextlib.suppress(Exception):  # the session may have ended before
            clear(spark)
