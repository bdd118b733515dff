"""Products with more cells than their factors: made whole where they are, equal to NumPy's."""

import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shardflow import catalogue
from shardflow.catalogue.blocks import _ranges_of_blocks
from shardflow.layout import Sharding
from shardflow.operators import BlockedArray, ShardedArray, blocks, matmul, matmul_kernel
from tests.test_catalogue import DATA



def blocked(spark, m, text, rows, dtype="S64"):
    """Blocks of at most ``rows`` rows."""
    kind = {"S64": "bigint", "F64": "double"}[dtype]
    lists = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)], f"i long, x array<{kind}>")
    return BlockedArray.from_lists(lists, "i", "x", Sharding.of(text, tails=True), dtype).stacked(rows)


def dense(array, m, n, dtype=np.int64):
    out = np.zeros((m, n), dtype)
    for i, j, v in array.to_cells().cells.select("i0", "i1", "v").collect():
        out[i, j] = v
    return out


@pytest.mark.parametrize("large", [50, 1 << 28])
def test_whole_numbers_stay_whole(spark, monkeypatch, large):
    """Also where doubles don't hold the sums; factors may be cut differently in the inner dimension, and the grid grows."""
    r = np.random.default_rng(large)
    x, y = r.integers(-large, large, (301, 6)), r.integers(-large, large, (6, 290))
    a, b = blocked(spark, x, "301/4@0, 6/2@1", 40), blocked(spark, y.T, "290/2@1, 6/3@0", 30).transposed()
    for cells in (blocks.PANEL_CELLS, 700):
        monkeypatch.setattr(blocks, "PANEL_CELLS", cells)
        assert (dense(matmul(a, b, Sharding.of("301/4@0, 290/2@1", tails=True)), 301, 290) == x @ y).all()


def test_numbers_with_fractions(spark):
    r = np.random.default_rng(5)
    x, y = r.random((40, 4)), r.random((4, 30))
    got = dense(matmul(blocked(spark, x, "40/2@0, 4/1@1", 7, "F64"), blocked(spark, y.T, "30/3@0, 4/1@1", 9, "F64").transposed(), Sharding.of("40/2@0, 30/3@1")), 40, 30, float)
    assert np.allclose(got, x @ y, rtol=1e-12)


@pytest.mark.parametrize("dst", ["{m}/4@0, {n}/3@1", "{m}/4@1, {n}/3@0, 1/2@2"])
@pytest.mark.parametrize(("m", "inner", "n"), [(301, 5, 290), (31, 40, 29)])
def test_kernels_over_products(spark, dst, m, inner, n):
    """Every cell of each shard once, replicas too, and none that no shard holds: by both ways of making products."""
    r = np.random.default_rng(inner)
    x, y = r.integers(-9, 9, (m, inner)), r.integers(-9, 9, (inner, n))
    layout = Sharding.of(dst.format(m=m, n=n), tails=True)
    a, b = blocked(spark, x, f"{m}/4@0, {inner}/1@1", 40), blocked(spark, y.T, f"{n}/2@0, {inner}/1@1", 30).transposed()
    assert blocks._wide(m, inner, n) == (inner == 5)
    merge = [F.sum("n").alias("n"), F.sum("s").alias("s"), F.min("low").alias("low"), F.max("high").alias("high")]
    got = {g["shard"]: tuple(g)[1:] for g in matmul_kernel(a, b, layout, _ranges_of_blocks, "shard long, n long, s long, low long, high long", merge).collect()}
    product, want = x @ y, {}
    whole = ShardedArray.create(spark.createDataFrame([(0, 0, 0)], "i int, j int, v long"), layout, "S64")
    for shard in range(layout.shards):
        (i, j), (k, z) = whole.bounds(shard)
        tile = product[i : k + 1, j : z + 1]
        want[shard] = (tile.size, tile.sum(), tile.min(), tile.max())
    assert got == want


def test_rows_that_no_block_has(spark):
    """A factor of some tiles only: products of these and no other."""
    r = np.random.default_rng(3)
    x, y = r.integers(1, 9, (300, 4)), r.integers(1, 9, (4, 20))
    a, b = blocked(spark, x, "300/3@0, 4/1@1", 40), blocked(spark, y.T, "20/2@0, 4/1@1", 8).transposed()
    assert blocks._wide(300, 4, 20)
    got = matmul(a.tile(2), b, Sharding.of("300/3@0, 20/2@1"))
    assert got.to_cells().cells.agg(F.min("i0"), F.max("i0"), F.count("*")).first() == (200, 299, 2000)
    assert (dense(got, 300, 20)[200:] == (x @ y)[200:]).all()


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_no_cell_of_the_product_moves(spark):
    """A quarter of a million cells are made of 500 vectors, and only some rows for each task come out of them."""
    df = catalogue.QUERIES["matmul_vvt"](spark, DATA)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "SortMergeJoin" not in plan
    above = plan.partition("MapInArrow")[0]
    assert above.count("Exchange") == 1 and above.index("Exchange") < above.index("partial_sum")


def test_one_block_at_a_time_is_held():
    """Blocks have a bounded number of cells, whatever the tile."""
    there = np.ones(1000, bool)
    there[400:410] = False
    steps = blocks._steps(30, there, 333)
    assert all(0 < z - a <= blocks.SIDE and a // 333 == (z - 1) // 333 for a, z in steps)
    assert sorted(k for a, z in steps for k in range(a, z)) == [k for k in range(30, 1030) if not 430 <= k < 440]
    vals = pa.array([[1, -2, 3]], pa.list_(pa.int64()))
    one = pa.RecordBatch.from_arrays([pa.array([4], pa.int64()), pa.array([[0, 0]]), pa.array([[1, 3]]), vals], ["shard", "lo", "size", "vals"])
    assert [list(b.to_pylist()[0].values()) for b in _ranges_of_blocks(iter([one]))] == [[4, 3, 2, -2, 3]]
