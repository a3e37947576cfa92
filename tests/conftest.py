"""One small local session for all tests."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    from pointloom import configure

    session = (SparkSession.builder.master("local[8]").appName("tests").config("spark.sql.shuffle.partitions", "4")
               .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "6g")
               .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints"))).getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield configure(session)
    session.stop()


@pytest.fixture
def table(spark):
    """Build a point table from rows; ``lon`` and ``lat`` default to zero."""
    from pyspark.sql import functions as F

    from pointloom.table import conform, describe

    def build(schema, rows, lon=None, lat=None, ids=None, **how):
        numbered = [(i, ids[i] if ids else f"p{i}", lon[i] if lon else 0.0, lat[i] if lat else 0.0, *r) for i, r in enumerate(rows)]
        df = spark.createDataFrame(numbered, f"row_id bigint, point_id string, lon double, lat double, {schema}")
        names = df.columns[4:]
        return describe(conform(df, names), row="row_id", id="point_id", lon="lon", lat="lat", attributes=names, **how)

    build.F = F
    return build
