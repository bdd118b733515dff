"""Totals of arrays by shape, as metrics of the queries that read them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from shardflow.operators.array import ShardedArray
from shardflow.types import width


def observed(array: ShardedArray) -> tuple[DataFrame, Observation]:
    """The cells, and an observation of how many of them the first action over them reads."""
    seen = Observation()
    return array.cells.observe(seen, F.count(F.lit(1)).alias("cells")), seen


def totals(arrays: Sequence[ShardedArray], result: Column) -> DataFrame:
    """Rows (shape, cells, bytes, result): an aggregate over each array, and its size as seen while that ran.

    The actions run here, one for each array; no array is read a second time for its size.
    """
    rows, name = [], None
    for a in arrays:
        cells, seen = observed(a)
        found = cells.agg(result)
        name = found.schema[0]
        rows.append((a.layout.short(a.dtype), found.first()[0], seen.get["cells"]))
    spark = arrays[0].cells.sparkSession
    table = [(shape, n, n * width(a.dtype), value) for a, (shape, value, n) in zip(arrays, rows, strict=True)]
    return spark.createDataFrame(table, f"shape string, cells long, bytes long, {name.name} {name.dataType.simpleString()}")
