"""Blocks, products, single tiles, gangs and pools, on small arrays."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from shardflow.functions.layout import layout_table
from shardflow.layout import Sharding
from shardflow.mesh import DeviceList
from shardflow.operators import ArrayCache, BlockedArray, ShardedArray, matmul
from shardflow.operators.array import ArrayIds, swap
from shardflow.operators.gang import gang
from shardflow.operators.reshard import label, reshard_to
from shardflow.plans.classify import UnsupportedReshard
from shardflow.sources.arrays import from_digits, from_key, from_lists


def cells(spark, shape, text):
    rows = [(*map(int, i), int(np.ravel_multi_index(i, shape)) * 7 % 101) for i in np.ndindex(*shape)]
    return ShardedArray.create(spark.createDataFrame(rows, ", ".join(f"i{k} int" for k in range(len(shape))) + ", v long"), Sharding.of(text), "S64")


def contents(df, rank):
    return sorted(tuple(r) for r in df.select(*[f"i{k}" for k in range(rank)], "v").collect())


@pytest.mark.parametrize(
    ("shape", "extents", "src", "dst"),
    [
        ((24,), [5], "24/2", "24/3"), ((12, 10), [5, 3], "12/2@1, 10/1@0", "12/3@0, 10/5@1"), ((6, 4, 10), [2, 3, 4], "6/3@0, 4/2@2, 10/1@1", "6/2@2, 4/1@0, 10/5@1, 1/2@3"),
        ((12, 10), [12, 10], "1/2@0, 12/1@1, 10/1@2", "12/4@0, 10/2@1"),
    ],
)
def test_moves_of_blocks(spark, shape, extents, src, dst):
    a = cells(spark, shape, src)
    moved = BlockedArray.from_cells(a, extents).reshard(Sharding.of(dst))
    assert contents(moved.to_cells().cells, len(shape)) == contents(a.cells, len(shape))
    ends = {r["shard"]: (r["lo"], r["hi"]) for r in layout_table(spark, Sharding.of(dst)).collect()}
    for r in moved.by_shard().collect():
        low, high = ends[r["shard"]]
        assert all(a <= x and x + n - 1 <= z for a, z, x, n in zip(low, high, r["lo"], r["size"], strict=True)) and len(r["vals"]) == np.prod(r["size"])
    sent = BlockedArray.from_cells(a, extents).moves(Sharding.of(dst)).agg(F.sum("cells"), F.sum("bytes")).first()
    assert tuple(sent) == (np.prod(shape) * Sharding.of(dst).replicas, 8 * np.prod(shape) * Sharding.of(dst).replicas)


def test_blocks_are_bounded_and_cut_without_cells(spark):
    a = BlockedArray.from_cells(cells(spark, (60,), "60/3"), [7])
    assert a.pieces.agg(F.max(F.size("vals"))).first()[0] == 7
    plan = a.reshard(Sharding.of("60/4")).pieces._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "posexplode" not in plan  # the one that made the blocks
    with pytest.raises(UnsupportedReshard):
        a.reshard(Sharding.of("61/1"))
    with pytest.raises(UnsupportedReshard):
        BlockedArray.from_cells(cells(spark, (8, 8), "8/4@0, 8/2@1"), [8, 8]).reshard(Sharding.of("8/2@0, 8/4@1"), strict=True)


def test_missing_and_repeated_cells_are_errors(spark):
    rows = [(k, k) for k in range(10) if k != 3]
    for more in ([], [(4, 4)]):
        a = ShardedArray.create(spark.createDataFrame(rows + more, "i long, v long"), Sharding.of("10/2"), "S64")
        with pytest.raises(Exception, match="hasn't each of its cells once"):
            BlockedArray.from_cells(a, [5]).pieces.collect()


def test_a_shard_is_many_tasks_work(spark):
    a = BlockedArray.from_cells(cells(spark, (4000,), "4000/2"), [10])
    parts = a.placed(8).select("shard", F.spark_partition_id().alias("p")).distinct().collect()
    assert all(len({r["p"] for r in parts if r["shard"] == s}) > 2 for s in (0, 1))


@pytest.mark.parametrize("held", [1 << 20, 1])
def test_products(spark, monkeypatch, held):
    r = random.Random(held)
    x, y = (np.array([[r.randrange(-50, 50) for _ in range(n)] for _ in range(m)]) for m, n in ((12, 20), (20, 6)))
    make = lambda m, text: ShardedArray.create(spark.createDataFrame([(i, j, int(m[i, j])) for i, j in np.ndindex(*m.shape)], "i int, j int, v long"), Sharding.of(text), "S64")
    a = BlockedArray.from_cells(make(x, "12/2@0, 20/2@1"), [4, 5])
    b = BlockedArray.from_cells(make(y, "20/2@0, 6/3@1"), [5, 2])
    got = np.zeros((12, 6), int)
    for i, j, v in contents(matmul(a, b, Sharding.of("12/3@0, 6/2@1"), grid=(2, 3)).to_cells().cells, 2):
        got[i, j] = v
    assert (got == x @ y).all()
    back = contents(a.transposed().to_cells().cells, 2)
    assert back == sorted((j, i, int(x[i, j])) for i, j in np.ndindex(*x.shape)) and a.transposed().layout.dims[0].size == 20
    with pytest.raises(ValueError, match="inner"):
        matmul(a, a, Sharding.of("12/3@0, 20/2@1"))


def scanned(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_tile_is_a_range_of_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(2000).select("id", (F.col("id") * 3).alias("v"), F.array(*[F.col("id") + k for k in range(8)]).alias("e"), F.lit("x").alias("more")).write.parquet(path)
    df = spark.read.parquet(path)
    cube = from_digits(df, "id", "v", [20, 10, 10], Sharding.of("20/4@0, 10/5@1, 10/1@2"), "S64")
    got = cube.map(lambda v: v + 1).tile(7)
    assert "GreaterThanOrEqual(id,540)" in scanned(got) and "LessThanOrEqual(id,959)" in scanned(got) and "more" not in scanned(got)
    assert contents(got, 3) == sorted((i, j, k, 3 * (100 * i + 10 * j + k) + 1) for i in range(5, 10) for j in (4, 5) for k in range(10))
    key = from_key(df, "id", "v", Sharding.of("2000/4"), "S64").tile(1)
    assert "GreaterThanOrEqual(id,500)" in scanned(key) and key.count() == 500
    lists = from_lists(df, "id", "e", Sharding.of("2000/4@0, 8/2@1"), "S64").tile(3)
    assert "GreaterThanOrEqual(id,500)" in scanned(lists) and contents(lists, 2) == sorted((i, j, i + j) for i in range(500, 1000) for j in range(4, 8))


def test_keys_outside_of_a_layout_are_errors(spark):
    df = spark.createDataFrame([(0, 1), (5, 1), (None, 1)], "k long, v long")
    for a in (from_key(df, "k", "v", Sharding.of("4/2"), "S64"), from_digits(df.filter("k IS NOT NULL"), "k", "v", [2, 2], Sharding.of("2/1@0, 2/2@1"), "S64")):
        with pytest.raises(Exception, match="outside of the layout"):
            a.cells.collect()


def test_gangs(spark):
    a = cells(spark, (8,), "8/4")

    def run(shard, batches, ask):
        import pyarrow as pa

        n = sum(b.num_rows for b in batches)
        yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([",".join(ask(f"{shard}:{n}"))])], ["shard", "said"])

    assert {tuple(r) for r in gang(a, run, "shard long, said string").collect()} == {(s, "0:2,1:2,2:2,3:2") for s in range(4)}
    with pytest.raises(ValueError, match="slots"):
        gang(cells(spark, (64,), "64/64"), run, "shard long, said string")


def test_ids_and_pools(spark):
    ids = ArrayIds()
    assert [ids.allocate(DeviceList(0, 2)), ids.allocate(DeviceList(0, 2)), ids.allocate(DeviceList(1, 2))] == [0, 1, 0]
    disk, memory = ArrayCache(StorageLevel.DISK_ONLY), ArrayCache(StorageLevel.MEMORY_ONLY)
    a, b = (cells(spark, (6,), "6/2").move_to_memory() for _ in range(2))
    assert a.id != b.id and a.map(lambda v: v + 1).id not in (a.id, b.id)
    out = swap(a, disk, save=memory)
    assert out.id == a.id and not out.cells.storageLevel.useMemory and memory.counts() == {a.layout.short("S64"): 1}
    back = swap(out, memory, save=disk)
    assert back.id == a.id and back.cells.storageLevel.useMemory and contents(back.cells, 1) == contents(b.cells, 1)
    # the place that the pool had was taken up, its own array is gone, and the place on disk is free
    assert memory.counts() == {a.layout.short("S64"): 0} and disk.counts() == {a.layout.short("S64"): 1}
    gone = swap(back, disk)
    assert gone.id == a.id and contents(gone.cells, 1) == contents(b.cells, 1) and not back.cells.is_cached


def test_an_array_that_is_kept_where_it_went(spark, tmp_path):
    a = cells(spark, (12, 10), "12/2@1, 10/1@0")
    path = str(tmp_path / "moved")
    b = reshard_to(a, Sharding.of("12/3@0, 10/5@1"), path)
    assert contents(b.cells, 2) == contents(a.cells, 2) and len(list((tmp_path / "moved").glob("piece=*"))) == 3
    got = b.map(lambda v: v + 1).tile(7)
    assert contents(got, 2) == [(i, j, v + 1) for i, j, v in contents(a.cells, 2) if 4 <= i < 8 and 4 <= j < 6]
    assert "PartitionFilters: [isnotnull(piece" in scanned(got) and len(b.tile(7).inputFiles()) >= 1 and all("piece=" in f for f in b.tile(7).inputFiles())
    assert label(a, b.layout).startswith("reshard  TYPE=S64 [ 12 10 ] % [ 2 1 ] -> TYPE=S64 [ 12 10 ] % [ 3 5 ]: 64 bytes a shard, devices 0-1 -> 0-14")
    assert spark.sparkContext.getLocalProperty("spark.job.description") is None
