"""Every registered query against its SQL in DuckDB, or, without SQL, for its shape."""

import pytest

import __spark_entry__ as registered
from tools.check_queries import compare, connect

QUERIES, ORACLE = registered.queries(), registered.oracle_sql()
# sizes of the fixture's samples exceed the smallest data set
NEEDS_MORE_ROWS = {"wilson_by_sample_size"}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, sf_dir, name):
    folder = "/root/testdata/sf0.01" if name in NEEDS_MORE_ROWS else sf_dir
    result = compare(name, QUERIES[name](spark, folder), connect(folder), ORACLE[name])
    assert result.startswith("ok"), result
    assert "types" not in result, result


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_without_sql_runs(spark, sf_dir, name):
    if name in ("pca_50", "boosted_importance"):  # 69 training texts of the smallest set do not pay for a cut
        sf_dir = "/root/testdata/sf0.01"
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    assert registered.entry(spark).columns == ["pattern", "count"]
