import os
import sys
from pathlib import Path

import pytest
from hypothesis import HealthCheck, settings

# a loaded machine is no failure of a property
settings.register_profile("any_load", deadline=None, suppress_health_check=[HealthCheck.too_slow, HealthCheck.data_too_large])
settings.load_profile("any_load")

sys.path.insert(0, str(Path(__file__).parents[1]))
os.environ.setdefault("TZ", "UTC")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    base = tmp_path_factory.mktemp("spark")
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.warehouse.dir", str(base / "warehouse"))
        .config("spark.checkpoint.dir", f"file://{base}/checkpoint")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
