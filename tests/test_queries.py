"""Every query that SQL can express, against DuckDB on the same tables."""

import pytest
from conftest import DATA, same

from gaugeworks import plans


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_against_sql(spark, duck, name):
    same(plans.QUERIES[name](spark, f"{DATA}/sf0.001"), duck.sql(plans.ORACLE_SQL[name]))
