"""Every array query gives the rows of its SQL."""

import os

import duckdb
import pytest

from shardflow import catalogue

DATA = "/root/testdata/sf0.001"


def normal(rows):
    return sorted(repr(tuple(None if x is None else int(x) if isinstance(x, float) and x == int(x) else x for x in r)) for r in rows)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("events", "embeddings", "orders"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query(spark, con, name):
    got = catalogue.QUERIES[name](spark, DATA)
    want = con.execute(catalogue.ORACLE[name])
    names = [x[0] for x in want.description]
    assert sorted(got.columns) == sorted(names)
    assert normal(got.select(*names).collect()) == normal(want.fetchall())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", ["tile_fill", "reshard_gather", "reshard_broadcast", "reshard_partial_to_replicated", "reshard_sg_2d"])
def test_shards_are_aggregated_before_they_move(spark, name):
    """Where a layout has one shard, or whole replicas, only partial results are shuffled, not the cells."""
    plan = catalogue.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION" not in plan and plan.index("Exchange") < plan.rindex("partial_")


def test_entry_points():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and set(catalogue.QUERIES) <= set(e.queries())
