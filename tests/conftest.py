import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path[:0] = [str(Path(__file__).resolve().parents[1]), str(Path(__file__).resolve().parent)]

from book import Book  # noqa: E402

from hearth.operators.base import session_defaults  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        session_defaults(SparkSession.builder.master("local[4]").appName("hearth-tests"))
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "3g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoint"))).getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture()
def book(spark):
    return Book(spark)
