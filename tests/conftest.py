import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.abspath(os.path.join(os.path.dirname(__file__), "..")))

from inkveil.session import ensure_checkpoint_dir, tune  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("FATAL")
    ensure_checkpoint_dir(session, str(tmp_path_factory.mktemp("checkpoints")))
    yield tune(session)
    session.stop()


@pytest.fixture(scope="session")
def texts(spark):
    """rows -> DataFrame (id, text) in their order."""
    def build(rows):
        return spark.createDataFrame(list(enumerate(rows)), "id int, text string")
    return build
