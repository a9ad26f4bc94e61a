"""Every registered query against its DuckDB SQL at the smallest scale."""
import pytest

import __spark_entry__ as entry
from check_oracles import compare, connect
from conftest import SF
from lexloom.plans.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_all_queries_have_sql():
    assert set(QUERIES) == set(ORACLES) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, con, name):
    assert compare(entry.queries()[name](spark, SF), con, ORACLES[name]) is None


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["doc_key", "block_no", "section_type", "doc_id", "department",
                          "type_data", "category", "date", "source", "content"]
    assert df.limit(1).count() == 1
