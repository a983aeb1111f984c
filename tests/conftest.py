import datetime as dt
import os
import sys
import tempfile

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

from rackwise.sources.schema import DEFAULTS, SCHEMAS  # noqa: E402
from rackwise.sources.tables import Tables  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]").appName("rackwise-tests")
        .config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "4g").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="rackwise-tests-"))
        .config("spark.sql.maxMetadataStringLength", "1000").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


def day(text):
    return dt.date.fromisoformat(text) if isinstance(text, str) else text


def table(spark, name, rows):
    """A shop table from dicts; columns a dict leaves out take the table's defaults."""
    schema, defaults = SCHEMAS[name], DEFAULTS[name]
    dates = {"date", "acquired_at", "listed_at", "sold_at"}
    full = [
        tuple(day(r.get(f.name, defaults.get(f.name))) if f.name in dates else r.get(f.name, defaults.get(f.name)) for f in schema)
        for r in rows
    ]
    return spark.createDataFrame(full, schema)


@pytest.fixture
def make_shop(spark):
    def make(consignors=(), items=(), sales=()):
        return Tables(table(spark, "consignors", consignors), table(spark, "items", items), table(spark, "sales", sales))

    return make


@pytest.fixture
def make_table(spark):
    return lambda name, rows: table(spark, name, rows)


def rows(df):
    return [tuple(r) for r in df.collect()]
