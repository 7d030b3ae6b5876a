"""Every registered query against its SQL counterpart, over the whole test tables."""

import compare
import pytest

import __spark_entry__ as entry_points
from tracklake.plans.oracle import ORACLE
from tracklake.plans.queries import QUERIES


@pytest.fixture(scope="module")
def duck(sf_dir):
    return compare.connect(sf_dir)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)
    assert QUERIES.items() <= entry_points.queries().items()
    assert ORACLE.items() <= entry_points.oracle_sql().items()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, sf_dir, duck, name):
    columns, rows = compare.spark_rows(QUERIES[name](spark, sf_dir))
    expected_columns, expected = compare.duck_rows(duck, ORACLE[name])
    assert columns == expected_columns
    assert len(rows) == len(expected)
    assert rows == expected


def test_entry(spark):
    result = entry_points.entry(spark)
    assert result.columns == ["track_id", "run", "seq", "lat", "lon", "ts_ms"]
    assert not result.isEmpty()
