"""The queries that SQL can express against DuckDB, and that all of them are registered."""

import pytest
from compare import connect, differences

import __spark_entry__ as entry_file
from orderloom.llm.queries import QUERIES
from orderloom.llm.queries_sql import ORACLE


def test_all_are_registered():
    registered = entry_file.queries()
    assert set(QUERIES) | {"pipeline"} <= set(registered)
    assert [sum(q.startswith(f"op{n}_") for q in registered) for n in range(1, 14)] == [1] * 13
    assert set(ORACLE) <= set(entry_file.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, folder, name):
    assert differences(QUERIES[name](spark, folder), connect(folder), ORACLE[name]) == []
