"""Queries of stores that tasks write: nested writers, several stores at once, arrays that keep their number."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from shardflow.catalogue.arrays import _CUBE_SQL, _EVENTS_SQL, E1, E3, _cells, _cube, _events, _layout, _query, _shards_sql
from shardflow.flow import Future, Store, View, Writers, after, defer
from shardflow.layout import Sharding
from shardflow.mesh import DeviceList
from shardflow.operators import ArrayCache, ShardedArray, reshard, reshard_to
from shardflow.operators.array import swap
from shardflow.sources.arrays import table


def _plus(n: int):
    return lambda df: df.withColumn("v", F.col("v") + n)


def _times(n: int):
    return lambda df: df.withColumn("v", F.col("v") * n)


def _sums_of(found: list[tuple[str, DataFrame]]) -> DataFrame:
    """A sum for each version: each a partial aggregate of one scan."""
    rows = [df.agg(F.lit(path).alias("version"), F.sum("v").cast("long").alias("v")) for path, df in found]
    return reduce(DataFrame.union, rows)


def _inner(store: Store) -> None:
    store.write(_times(2)).write(_plus(1))


def _outer(store: Store) -> None:
    store.write(_plus(10))
    defer(_inner, store)
    store.write(_times(3))


@_query(
    "store_nested_write",
    f"""SELECT version, sum(CASE version WHEN '0' THEN v WHEN '1.1' THEN v + 10 WHEN '1.2.1' THEN 2 * (v + 10) WHEN '1.2.2' THEN 2 * (v + 10) + 1
 WHEN '1.2' THEN 2 * (v + 10) + 1 WHEN '1.3' THEN 3 * (2 * (v + 10) + 1) WHEN '1' THEN 3 * (2 * (v + 10) + 1) ELSE 3 * (2 * (v + 10) + 1) - 5 END)::BIGINT AS v
 FROM {_EVENTS_SQL}, (VALUES ('0'), ('1.1'), ('1.2.1'), ('1.2.2'), ('1.2'), ('1.3'), ('1'), ('2')) t(version) GROUP BY version""",
)
def store_nested_write(spark: SparkSession, d: str) -> DataFrame:
    """A task writes, lets another write, and writes again; then the owner writes: all versions by number."""
    s = Store.create(_cells(spark, d))
    defer(_outer, s)
    s.write(_plus(-5))
    return _sums_of(s.tree())


def _keep_and_write(before: View, store: Store) -> DataFrame:
    """Writes a store of which it has a view, too: the view stays as it was."""
    store.write(_plus(7))
    return before.df.join(store.df.withColumnRenamed("v", "w"), "i0").select("i0", (F.col("w") - F.col("v")).alias("v"))


@_query("store_view_and_write", f"SELECT 7::BIGINT AS v, count(*)::BIGINT AS n FROM {_EVENTS_SQL}")
def store_view_and_write(spark: SparkSession, d: str) -> DataFrame:
    s = Store.create(_cells(spark, d))
    return defer(_keep_and_write, s.view(), s).groupBy("v").agg(F.count("*").alias("n"))


def _transfer(stores: list[Store]) -> None:
    """What one store loses the other gets."""
    for s, sign in zip(stores, (-1, 1), strict=True):
        s.write(lambda df, sign=sign: df.withColumn("v", F.col("v") + F.lit(sign) * (F.col("i0") % 10)))


def _fail_after_one(stores: list[Store]) -> None:
    stores[0].write(_plus(1_000_000))
    raise ArithmeticError("the second store can't be written")


@_query(
    "store_vector_commit",
    f"""SELECT k::BIGINT AS k, CASE k WHEN 0 THEN sum(v - i0 % 10) WHEN 1 THEN sum(v + i0 % 10) ELSE sum(2 * v) END::BIGINT AS v, CASE k WHEN 2 THEN 0 ELSE 1 END::BIGINT AS version
 FROM {_EVENTS_SQL}, range(3) t(k) GROUP BY k""",
)
def store_vector_commit(spark: SparkSession, d: str) -> DataFrame:
    """Two stores written by one task, then by a task that fails after the first: neither keeps anything of it.

    Row 2 is the sum of both, which no transfer changes."""
    stores = [Store.create(_cells(spark, d)) for _ in range(2)]
    defer(_transfer, Writers(stores))
    try:
        defer(_fail_after_one, Writers(stores))
    except ArithmeticError:
        pass
    rows = [s.df.agg(F.lit(k).cast("long").alias("k"), F.sum("v").alias("v"), F.lit(s.version).cast("long").alias("version")) for k, s in enumerate(stores)]
    both = stores[0].df.select("v").union(stores[1].df.select("v")).agg(F.lit(2).cast("long").alias("k"), F.sum("v").alias("v"), F.lit(0).cast("long").alias("version"))
    return reduce(DataFrame.union, [*rows, both])


@_query("array_swap_identity", "SELECT shard, cells, first, v_sum, true AS same_id, 'disk' AS out_level, 'memory' AS in_level FROM (" + _shards_sql(_EVENTS_SQL, E1, "count(*)::BIGINT AS cells, min(i0)::BIGINT AS first, sum(v)::BIGINT AS v_sum") + ")")
def array_swap_identity(spark: SparkSession, d: str) -> DataFrame:
    """An array swapped out to a pool on disk and back into memory: values and number are those it had."""
    disk, memory = ArrayCache(StorageLevel.DISK_ONLY), ArrayCache(StorageLevel.MEMORY_AND_DISK)
    a = _events(spark, d, E1).move_to_memory()
    out = swap(a, disk, save=memory)
    level = "memory" if out.cells.storageLevel.useMemory else "disk"
    back = swap(out, memory, save=disk)
    found = back.sharded().groupBy("shard").agg(F.count("*").alias("cells"), F.min("i0").alias("first"), F.sum("v").alias("v_sum"))
    return found.select("shard", "cells", "first", "v_sum", F.lit(a.id == out.id == back.id).alias("same_id"), F.lit(level).alias("out_level"), F.lit("memory" if back.cells.storageLevel.useMemory else "disk").alias("in_level"))


def _shared(spark: SparkSession, name: str) -> str:
    """A new folder that all executors share."""
    return f"{spark.conf.get('spark.checkpoint.dir').rstrip('/')}/{name}-{uuid.uuid4().hex}"


@_query("token_order", f"SELECT (i0 % 7)::BIGINT AS k, sum(v + 3)::BIGINT AS v, count(*)::BIGINT AS n FROM {_EVENTS_SQL} GROUP BY 1")
def token_order(spark: SparkSession, d: str) -> DataFrame:
    """A task without a result writes a table, and one that begins after it reads the table."""
    path = _shared(spark, "token")

    def write(df: DataFrame) -> None:
        df.withColumn("v", F.col("v") + 3).write.parquet(path)

    written = defer(write, Store.create(_cells(spark, d)))
    return after(written).defer(lambda: spark.read.parquet(path).groupBy((F.col("i0") % 7).alias("k")).agg(F.sum("v").alias("v"), F.count("*").alias("n")))


@_query("token_store", f"SELECT sum(2 * v + 1)::BIGINT AS v, 1::BIGINT AS version FROM {_EVENTS_SQL}")
def token_store(spark: SparkSession, d: str) -> DataFrame:
    """The same with a store that the first task writes: its new version is computed before the second begins."""
    s = Store.create(_cells(spark, d))

    def write(store: Store) -> None:
        store.write(lambda df: df.withColumn("v", 2 * F.col("v") + 1))

    return after(defer(write, s)).defer(lambda df: df.agg(F.sum("v").alias("v"), F.lit(s.version).cast("long").alias("version")), s)


@_query("reshard_stored", _shards_sql(_CUBE_SQL, "M/5@0, 10/2@1, 10/1@2", "count(*)::BIGINT AS cells, sum(v)::BIGINT AS v_sum"))
def reshard_stored(spark: SparkSession, d: str) -> DataFrame:
    """An array moved and kept as a table by piece, read back shard by shard of the new layout."""
    a = reshard_to(_cube(spark, d, E3), _layout(spark, d, "M/5@0, 10/2@1, 10/1@2"), _shared(spark, "reshard"))
    tiles = [a.tile(k).agg(F.lit(k).cast("long").alias("shard"), F.count("*").alias("cells"), F.sum("v").alias("v_sum")) for k in range(a.layout.shards)]
    return reduce(DataFrame.union, tiles)


@_query("future_value", f"""WITH m AS (SELECT max(v) AS m FROM {_EVENTS_SQL})
 SELECT count(*)::BIGINT AS n, sum(v)::BIGINT AS v, any_value(m)::BIGINT AS most FROM {_EVENTS_SQL}, m WHERE 2 * v > m""")
def future_value(spark: SparkSession, d: str) -> DataFrame:
    """A value that is computed first, and decides what a later task does."""
    cells = _cells(spark, d)
    most = Future(cells.agg(F.max("v"))).get()
    return defer(lambda df: df.filter(2 * F.col("v") > most).agg(F.count("*").alias("n"), F.sum("v").alias("v"), F.lit(most).cast("long").alias("most")), cells)


def _there_and_back(store: Store, there: Sharding, back: Sharding) -> None:
    """A task that moves the array it writes, changes it there, and moves it back."""
    store.write(lambda a: reshard(a, there).map(lambda v: v + 1))
    store.write(lambda a: reshard(a, back).scale(2))


@_query("store_of_arrays", _shards_sql(f"(SELECT i0, 16 * v + 30 AS v FROM {_EVENTS_SQL})", E1, "count(*)::BIGINT AS cells, sum(v)::BIGINT AS v_sum, 4::BIGINT AS version, 13::BIGINT AS versions"))
def store_of_arrays(spark: SparkSession, d: str) -> DataFrame:
    """A store of an array that four tasks in turn move to other devices and back; all versions stay."""
    s = Store.create(_events(spark, d, E1))
    for start in range(4):
        defer(_there_and_back, s, _layout(spark, d, "N/2@0, 1/2@1", start), s.df.layout)
    found = s.df.sharded().groupBy("shard").agg(F.count("*").alias("cells"), F.sum("v").alias("v_sum"))
    return found.select("*", F.lit(s.version).cast("long").alias("version"), F.lit(len(s.tree())).cast("long").alias("versions"))


# one value on many devices

#: Devices that hold a value and those that get it: first device, number.
_SCALARS = {"disjoint": ((0, 3), (3, 10)), "overlap": ((0, 3), (0, 10)), "wider": ((0, 4), (2, 8))}


def _scalar(spark: SparkSession, d: str, devices: DeviceList) -> ShardedArray:
    """The largest value of the events as an array without dimensions, on each of some devices."""
    one = table(spark, d, "events").agg(F.lit(0).alias("i"), F.max(F.floor(F.col("value") * 100)).cast("long").alias("v"))
    return ShardedArray.create(one, _layout(spark, d, f"1/1@0, 1/{devices.n}@1", devices.start), "S64")


def _on_devices(step: int, a: ShardedArray) -> DataFrame:
    return a.sharded().select(F.lit(step).cast("long").alias("step"), (F.col("shard") + a.layout.devices.start).alias("device"), "v")


def _scalar_queries() -> None:
    for name, (src, dst) in _SCALARS.items():
        devices = [f"SELECT {step} AS step, {start} + range AS device FROM range({n})" for step, (start, n) in enumerate((src, dst, src))]
        sql = f"SELECT step::BIGINT AS step, device::BIGINT AS device, (SELECT max(floor(value * 100)) FROM events)::BIGINT + CASE step WHEN 0 THEN 0 ELSE 1 END AS v FROM ({' UNION ALL '.join(devices)})"

        def run(spark: SparkSession, d: str, src=src, dst=dst) -> DataFrame:
            """There, changed there, and back."""
            a = _scalar(spark, d, DeviceList(*src))
            there = reshard(a, _layout(spark, d, f"1/1@0, 1/{dst[1]}@1", dst[0])).map(lambda v: v + 1)
            back = reshard(there, a.layout)
            return _on_devices(0, a).union(_on_devices(1, there)).union(_on_devices(2, back))

        _query(f"scalar_broadcast_{name}", sql)(run)


_scalar_queries()
