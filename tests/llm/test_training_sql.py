"""Each operator that SQL can express, against DuckDB over whole tables."""

import pytest
from compare import assert_same, duck

from tarnfall.llm import registry

SQL = registry.oracle_sql()


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
@pytest.mark.parametrize("name", list(SQL))
def test_same_as_sql(spark, name, sf):
    d = f"/root/testdata/{sf}"
    assert_same(registry.queries()[name](spark, d), duck(d), SQL[name])
