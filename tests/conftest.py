import sys
from pathlib import Path
from types import SimpleNamespace

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .appName("commitlens-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def tables(spark):
    """Build a table bundle from lists of rows: ``tables(commits=(rows, schema), ...)``."""

    def build(**parts):
        return SimpleNamespace(
            **{name: spark.createDataFrame(rows, schema) for name, (rows, schema) in parts.items()}
        )

    return build
