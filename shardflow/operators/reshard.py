"""Moving an array to another layout: arithmetic on each cell's coordinates and one shuffle."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from shardflow.layout import Sharding
from shardflow.operators.array import ShardedArray
from shardflow.plans.classify import Move, UnsupportedReshard, classify


def reshard(array: ShardedArray, dst: Sharding, strict: bool = False) -> ShardedArray:
    """The same array in another layout.  Any layout can become any other of the same cells; with ``strict`` only
    moves that have a strategy of their own are done.

    Nothing is shuffled here: the new layout only says which shards a cell belongs to, and ``placed()`` moves each
    cell there at once, so a chain of reshards costs one shuffle, that of the last.
    """
    dst.validate()
    sizes = [[x.dims[k].size for k in x.real] for x in (array.layout, dst)]
    if sizes[0] != sizes[1]:
        raise UnsupportedReshard(f"an array of {sizes[0]} can't have the layout of {sizes[1]}")
    if strict and classify(array.layout, dst) is Move.UNSUPPORTED:
        raise UnsupportedReshard(f"{array.layout.short(array.dtype)} -> {dst.short(array.dtype)}")
    return replace(array, layout=dst)


def label(array: ShardedArray, dst: Sharding) -> str:
    """What the job that moves an array is called."""
    devices = [f"{d.start}-{d.stop - 1}" for d in (array.layout.devices, dst.devices)]
    return f"reshard {array.name} {array.layout.short(array.dtype)} -> {dst.short(array.dtype)}: {dst.shard_bytes(array.dtype)} bytes a shard, devices {devices[0]} -> {devices[1]}"


def reshard_to(array: ShardedArray, dst: Sharding, path: str, strict: bool = False) -> ShardedArray:
    """Move an array and keep it where it went: a folder for each piece of its first real dimension, so that a tile is
    read from the folders of its own pieces and nothing else.

    The job is named by :func:`label`.  Cells move once, dealt by tile into tasks of Spark's own size (a tile may be many
    tasks' work); replicas are stored once.
    """
    moved = reshard(array, dst, strict)
    context = array.cells.sparkSession.sparkContext
    before = context.getLocalProperty("spark.job.description")
    tile = F.array(*[F.call_function("div", F.col(c), F.lit(dst.dims[k].extent)) for c, k in zip(array.coords, dst.real, strict=True)])
    context.setJobDescription(label(array, dst))
    try:
        rows = moved.cells.withColumn("piece", tile[0]).repartition(tile, F.floor(F.rand(7) * 4))
        rows.write.partitionBy("piece").parquet(path)
    finally:
        context.setJobDescription(before)
    schema = StructType([*array.cells.schema.fields, StructField("piece", LongType())])
    stored = array.cells.sparkSession.read.schema(schema).parquet(path)
    extent = dst.dims[dst.real[0]].extent

    def box(lo: list[int], hi: list[int]) -> DataFrame:
        return stored.filter(F.col("piece").between(lo[0] // extent, hi[0] // extent)).drop("piece")

    return replace(moved, cells=stored.drop("piece"), box=box)
