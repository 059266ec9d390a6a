import pytest

from oracle import database, same
from sparkloom.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
DB = database(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_rows_equal_duckdb(spark, name):
    assert same(QUERIES[name](spark, FOLDER), DB, ORACLES[name])
