"""Golden values of layouts, moves and trees, and properties of random layouts."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shardflow.functions.layout import cell_shards, layout_table, tile_shard
from shardflow.layout import Dim, Sharding
from shardflow.mesh import DeviceList
from shardflow.operators import ShardedArray, reshard
from shardflow.plans.classify import Move, UnsupportedReshard, classify
from shardflow.plans.transfer import broadcast_tree, overlap_plan, transfer_plan


def rows(df, *columns):
    return {r[0]: tuple(tuple(x) if isinstance(x, list) else x for x in r[1:]) for r in df.select(*columns).collect()}


def test_tile_index(spark):
    full = rows(layout_table(spark, Sharding.of("8/2@0, 9/3@1")), "shard", "idx")
    assert full[0] == ((0, 0),) and full[1] == ((0, 1),) and full[5] == ((1, 2),)
    permuted = rows(layout_table(spark, Sharding.of("8/2@2, 9/3@0, 1/4@1")), "shard", "idx")
    golden = {0: (0, 0, 0), 1: (1, 0, 0), 2: (0, 0, 1), 3: (1, 0, 1), 4: (0, 0, 2), 5: (1, 0, 2), 11: (1, 1, 1), 12: (0, 1, 2)}
    assert all(permuted[k][0] == (v[0], v[1], v[2]) for k, v in golden.items())


def test_tile_bounds(spark):
    full = rows(layout_table(spark, Sharding.of("8/2@0, 9/3@1")), "shard", "lo", "hi")
    assert full[0] == ((0, 0), (3, 2)) and full[1] == ((0, 3), (3, 5)) and full[5] == ((4, 6), (7, 8))
    partial = rows(layout_table(spark, Sharding.of("8/2@0, 1/4@1, 9/3@2")), "shard", "lo", "hi")
    assert partial[0] == ((0, 0), (3, 2)) and partial[4] == ((0, 3), (3, 5)) and partial[20] == ((4, 6), (7, 8))
    permuted = rows(layout_table(spark, Sharding.of("8/2@2, 1/4@0, 9/3@1")), "shard", "lo", "hi")
    assert permuted[0] == ((0, 0), (3, 2)) and permuted[4] == ((0, 6), (3, 8)) and permuted[15] == ((4, 3), (7, 5))
    copies = rows(layout_table(spark, Sharding.of("1/4@0, 8/1@1, 6/1@2")), "shard", "lo", "hi")
    assert all(copies[k] == ((0, 0), (7, 5)) for k in (0, 2, 3))


def test_predicates_and_checks():
    x = Sharding.of("16/2@0, 1/2@1")
    assert (x.total_sharding, x.num_real_dims, x.num_local_elements, x.partially_replicated, x.replicas) == (2, 1, 8, True, 2)
    one = Sharding.of("8/1")
    assert one.fully_sharded and one.replicated
    with pytest.raises(ValueError, match="divide"):
        Sharding.of("9/2").validate()
    with pytest.raises(ValueError, match="devices"):
        Sharding((Dim(8, 2),), DeviceList(0, 3)).validate()


def test_device_list():
    d = DeviceList(4, 8)
    assert list(d.slice(2, 3)) == [6, 7, 8] and d[0] == 4 and 11 in d and 12 not in d and DeviceList(5, 2) in d
    assert d.shard_id(3) is None and d.shard_id(5) == 1
    with pytest.raises(IndexError):
        d.slice(6, 3)


def test_classes_with_devices():
    a, b = Sharding.of("8/1@0,1/4@1"), Sharding.of("8/1@0,1/2@1")
    assert [classify(a, b, k) for k in range(5)] == [Move.POINT_TO_POINT] * 2 + [Move.NO_OP] * 3


def test_trees_reach_every_rank(spark):
    for n in (1, 2, 3, 6, 10, 11, 14, 17):
        tree = broadcast_tree(spark, 1, n).collect()
        parent = {r["dst_shard"]: r["from_dst"] for r in tree}
        assert sorted(parent) == list(range(n)) and parent[0] is None
        assert sorted(x for r in tree for x in r["leaves"]) == list(range(1, n))


def test_strict_reshard(spark):
    cells = spark.range(16).select(F.col("id").alias("i"), F.lit(0).alias("j"), "id").union(spark.range(16).select("id", F.lit(1), "id"))
    a = ShardedArray.create(cells, Sharding.of("16/4@0, 2/2@1"), "S64")
    b = Sharding.of("16/8@0, 2/1@1")
    with pytest.raises(UnsupportedReshard):
        reshard(a, b, strict=True)
    assert rows(reshard(a, b).shard_stats(), "shard", "cells") == {k: (4,) for k in range(8)}
    with pytest.raises(UnsupportedReshard):
        reshard(a, Sharding.of("8/8@0, 2/1@1"))


def test_placed_is_one_partition_a_shard(spark):
    a = ShardedArray.create(spark.range(64).select("id", F.col("id").alias("v")), Sharding.of("64/8"), "S64")
    found = a.placed().select("shard", F.spark_partition_id().alias("p")).distinct().collect()
    assert len(found) == 8 and len({r["p"] for r in found}) == 8
    plan = a.placed().groupBy("shard").count()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


@st.composite
def layouts(draw, sizes=(12, 8)):
    pieces = [draw(st.sampled_from([1, 2, 4])) for _ in sizes]
    copies = draw(st.sampled_from([1, 2, 3]))
    dims = [(n, p) for n, p in zip(sizes, pieces, strict=True)] + ([(1, copies)] if copies > 1 else [])
    places = draw(st.permutations(range(len(dims))))
    return Sharding.of(", ".join(f"{n}/{p}@{k}" for (n, p), k in zip(dims, places, strict=True)))


@settings(max_examples=8, deadline=None)
@given(src=layouts(), dst=layouts())
def test_any_plan_covers_every_destination_once(spark, src, dst):
    plan = overlap_plan(spark, src, dst).collect()
    seen = {}
    for r in plan:
        for i in range(r["lo"][0], r["hi"][0] + 1):
            for j in range(r["lo"][1], r["hi"][1] + 1):
                seen[r["dst_shard"], i, j] = seen.get((r["dst_shard"], i, j), 0) + 1
    want = {(r["shard"], i, j) for r in layout_table(spark, dst).collect() for i in range(r["lo"][0], r["hi"][0] + 1) for j in range(r["lo"][1], r["hi"][1] + 1)}
    assert set(seen) == want and set(seen.values()) == {1}


@settings(max_examples=8, deadline=None)
@given(x=layouts())
def test_cells_are_in_the_shards_whose_bounds_hold_them(spark, x):
    table = layout_table(spark, x)
    again = table.select("shard", tile_shard(x, [F.col("idx")[k] for k in range(len(x.dims))]).alias("s")).collect()
    assert all(r["shard"] == r["s"] for r in again)
    cells = spark.range(96).select((F.col("id") / 8).cast("long").alias("i"), (F.col("id") % 8).alias("j"))
    found = {(r["i"], r["j"]): sorted(r["s"]) for r in cells.select("i", "j", cell_shards(x, [F.col("i"), F.col("j")]).alias("s")).collect()}
    bounds = table.collect()
    for (i, j), shards in found.items():
        assert shards == sorted(r["shard"] for r in bounds if r["lo"][0] <= i <= r["hi"][0] and r["lo"][1] <= j <= r["hi"][1])


def test_sliced_gather_covers(spark):
    plan = transfer_plan(spark, Sharding.of("256/2@1,1/2@0"), Sharding.of("256/1@0,1/4@1")).collect()
    for d in range(4):
        assert sorted(i for r in plan if r["dst_shard"] == d for i in range(r["lo"][0], r["hi"][0] + 1)) == list(range(256))
