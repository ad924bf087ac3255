"""Registered queries against their SQL."""

from __future__ import annotations

import pytest
from compare import differences

from corvane.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, name):
    assert differences(queries.queries()[name](spark, SF), queries.oracle_sql()[name], SF) == ""
