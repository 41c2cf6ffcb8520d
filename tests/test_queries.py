"""Every registered query against its SQL in DuckDB."""

import pytest

from lodemap.queries import oracle_sql, queries
from tests.compare import assert_same
from tests.conftest import SMALL

MAY_BE_EMPTY = {"profile_outliers", "anomaly_mad", "anomaly_orphan"}


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, name):
    assert assert_same(queries()[name](spark, SMALL), oracle_sql()[name], SMALL) or name in MAY_BE_EMPTY


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql())))
def test_query_without_sql_runs(spark, name):
    assert queries()[name](spark, SMALL).count() > 0
