"""Arrays from Parquet tables: by a dense key, by a list column, by digits of a key."""

from __future__ import annotations

from dataclasses import replace
from math import prod

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shardflow.layout import Sharding
from shardflow.operators.array import ShardedArray
from shardflow.types import TYPES


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _within(value: Column, low: int, high: int) -> Column:
    """A key that must lie in a range: a row outside of the layout is an error when it is read, and never left out."""
    message = F.concat(F.lit("key "), F.coalesce(value.cast("string"), F.lit("null")), F.lit(f" is outside of the layout's {low} to {high}"))
    return F.when(value.between(low, high), value).otherwise(F.raise_error(message).cast("long"))


def from_key(df: DataFrame, key: str, value: str, layout: Sharding, dtype: str, first: int = 0) -> ShardedArray:
    """A 1-d array by a key that counts from ``first``; a key outside of the layout's size is an error."""
    size = layout.dims[layout.real[0]].size

    def cells(rows: DataFrame) -> DataFrame:
        return rows.select((_within(F.col(key), first, first + size - 1) - first).alias("i0"), F.col(value).cast(TYPES[dtype][1]).alias("v"))

    array = ShardedArray.create(cells(df), layout, dtype)
    return replace(array, box=lambda lo, hi: cells(df.filter(F.col(key).between(first + lo[0], first + hi[0]))))


def from_lists(df: DataFrame, key: str, values: str, layout: Sharding, dtype: str) -> ShardedArray:
    """A 2-d array: a row for each key, a column for each place of the list."""

    def box(lo: list[int], hi: list[int]) -> DataFrame:
        part = F.slice(values, lo[1] + 1, hi[1] - lo[1] + 1)
        rows = df.filter(F.col(key).between(lo[0], hi[0])).select(F.col(key).cast("long").alias("i0"), F.posexplode(part).alias("j", "v"))
        return rows.select("i0", (F.col("j") + F.lit(lo[1])).cast("long").alias("i1"), F.col("v").cast(TYPES[dtype][1]).alias("v"))

    array = ShardedArray.create(df.select(key, F.posexplode(values).alias("j", "v")), layout, dtype)
    return replace(array, box=box)


def from_digits(df: DataFrame, key: str, value: str, sizes: list[int], layout: Sharding, dtype: str) -> ShardedArray:
    """An N-d array whose coordinates are the mixed-radix digits of a key; a key outside of the layout is an error.

    A box is scanned by the range from its first to its last key, which the leading digits make narrow."""
    below = [prod(sizes[k + 1 :]) for k in range(len(sizes))]

    def cells(rows: DataFrame) -> DataFrame:
        whole = _within(F.col(key), 0, prod(sizes) - 1)
        digits = [(F.call_function("div", whole, F.lit(b)) % n).alias(f"i{k}") for k, (b, n) in enumerate(zip(below, sizes, strict=True))]
        return rows.select(*digits, F.col(value).cast(TYPES[dtype][1]).alias("v"))

    def box(lo: list[int], hi: list[int]) -> DataFrame:
        ends = [sum(x * b for x, b in zip(corner, below, strict=True)) for corner in (lo, hi)]
        return cells(df.filter(F.col(key).between(*ends)))

    return replace(ShardedArray.create(cells(df), layout, dtype), box=box)
