import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    shared = tmp_path_factory.mktemp("shared")
    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{shared}")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def one(spark):
    """The value of a column expression over one row of named values."""

    def run(expression, **values):
        kinds = {str: "string", int: "long", float: "double", list: "array<double>", type(None): "string"}
        schema = ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items()) or "x int"
        return spark.createDataFrame([tuple(values.values()) or (1,)], schema).select(expression).first()[0]

    return run
