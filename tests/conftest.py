import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from lexloom.session import build_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = build_session("tests", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"})
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture
def docs(spark):
    """Make a (doc_key, text) table from texts, keys counted from 1."""
    def make(*texts):
        return spark.createDataFrame(list(enumerate(texts, 1)), "doc_key int, text string")
    return make
