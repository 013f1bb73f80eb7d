"""One local session for all tests, and small tables of every kind."""

from __future__ import annotations

import pytest
from pyspark.sql import SparkSession

from tests import small


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "3g").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture()
def ws(spark):
    from marlinspike.plans.workspace import Workspace

    return Workspace(spark)


@pytest.fixture(scope="session")
def tables(spark, tmp_path_factory):
    """Folders of the project's tables: 'full' with dirty rows, 'empty' without rows, 'wide' with clashing extra columns."""
    out = {}
    for kind in ("full", "empty", "wide"):
        d = tmp_path_factory.mktemp(kind)
        small.write(str(d), kind)
        out[kind] = str(d)
    return out
