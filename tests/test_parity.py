"""Every registered query against its oracle on the smallest tables."""

import pytest

import __spark_entry__ as entry
from checks.parity import compare, connect

SF_DIR = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    diff, rows, _ = compare(spark, SF_DIR, QUERIES[name], ORACLES.get(name), con)
    assert not diff
    assert rows >= 0


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["b05_assign_versions", "g13_conflict_dispatch", "h07_search_batch", "i04_loss_metrics"])
def test_same_rows_for_any_partitioning(spark, name):
    from checks.parity import rows_sorted
    results = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        df = QUERIES[name](spark, SF_DIR)
        results.append(rows_sorted(df.columns, [tuple(r) for r in df.collect()]))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert results[0] == results[1]
