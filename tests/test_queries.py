"""Every registered query of the engine equals its SQL in DuckDB."""

from __future__ import annotations

import pytest
from compare import differences

from corvane import registry

SF = "/root/testdata/sf0.001"
SQL = registry.oracle_sql()
QUERIES = {name: q for name, q in registry.queries().items() if name in SQL}  # the others have tests of their own


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_equals_sql(spark, name):
    assert differences(QUERIES[name](spark, SF), SQL[name], SF) == ""


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_registry_reads_no_text(spark):
    plan = QUERIES["registry"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "text" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_cutoff_reaches_the_scan(spark):
    plan = QUERIES["source_filter"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in plan or "GreaterThanOrEqual(ts" in plan
