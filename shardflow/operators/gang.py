"""Gangs: one task for each device of an array, all at once, which can wait for each other."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.resource import ResourceProfile
from pyspark.sql import DataFrame

from shardflow.operators.array import ShardedArray

Run = Callable[[int, Iterator[pa.RecordBatch], Callable[[str], list[str]]], Iterator[pa.RecordBatch]]


def slots(df: DataFrame) -> int:
    """Tasks that the cluster can run at once."""
    return df.sparkSession.sparkContext.defaultParallelism


def gang(array: ShardedArray, run: Run, schema: str, profile: ResourceProfile | None = None) -> DataFrame:
    """``run(shard, batches, ask)`` for every shard, as one barrier stage: all start together or none does, and if one is
    lost all start again.

    Batches of (shard, coordinates, v) stream, so a task needn't hold its shard; ``ask(text)`` waits for all tasks
    and gives what each said, by shard.  ``profile`` places the gang on executors with certain resources (device groups).
    More shards than the cluster has slots can never start: that is an error here.
    """
    wanted, there = array.layout.shards, slots(array.cells)
    if wanted > there:
        raise ValueError(f"a gang of {wanted} tasks can't start together: the cluster has {there} slots")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import BarrierTaskContext

        context = BarrierTaskContext.get()
        yield from run(context.partitionId(), batches, context.allGather)

    return array.placed().mapInArrow(task, schema, barrier=True, profile=profile)
