"""Queries of vectors give the rows of their SQL where the number of vectors doesn't divide into the pieces."""

import os

import duckdb
import pytest

from shardflow import catalogue
from shardflow.catalogue.arrays import _layout, _vectors
from shardflow.operators import reshard
from tests.test_catalogue import DATA, normal

VECTORS = [name for name, sql in catalogue.ORACLE.items() if "embeddings" in sql]


@pytest.fixture(scope="module", params=[98, 101])
def uneven(request, tmp_path_factory):
    """A folder of tables with few vectors, by hundreds and by pieces uneven."""
    folder = tmp_path_factory.mktemp("uneven")
    con = duckdb.connect()
    for t in ("events", "orders"):
        os.symlink(f"{DATA}/{t}.parquet", folder / f"{t}.parquet")
    con.execute(f"COPY (SELECT * FROM '{DATA}/embeddings.parquet' WHERE vec_id < {request.param}) TO '{folder}/embeddings.parquet'")
    for t in ("events", "embeddings", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return str(folder), con, request.param


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.filterwarnings("ignore:the layout")
@pytest.mark.parametrize("name", VECTORS)
def test_query(spark, uneven, name):
    folder, con, _ = uneven
    want = con.execute(catalogue.ORACLE[name])
    names = [x[0] for x in want.description]
    assert normal(catalogue.QUERIES[name](spark, folder).select(*names).collect()) == normal(want.fetchall())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_the_array_keeps_its_tail(spark, uneven):
    """No cell is lost to the array: what no shard of one layout holds, those of another do.  It is said when it happens."""
    folder, _, n = uneven
    with pytest.warns(UserWarning, match="which no shard holds"):
        a = _vectors(spark, folder, "V/4@0, 64/2@1")
    assert a.cells.count() == n * 64 and a.sharded().count() == n // 4 * 4 * 64
    assert reshard(a, _layout(spark, folder, "V/1@0, 64/2@1")).sharded().count() == n * 64
