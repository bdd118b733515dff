"""Layout algebra as column expressions: plain arithmetic, never a join."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shardflow.layout import Sharding


def _div(a: Column, b: int) -> Column:
    return F.call_function("div", a, F.lit(b)) if b > 1 else a


def tile_index(layout: Sharding, shard: Column) -> list[Column]:
    """The piece of each dimension that a shard holds."""
    return [F.pmod(_div(shard, layout.stride(k)), F.lit(d.sharding)).cast("long") for k, d in enumerate(layout.dims)]


def tile_shard(layout: Sharding, index: list[Column]) -> Column:
    """The shard of a tile index; inverts :func:`tile_index` for every permutation."""
    return reduce(lambda a, b: a + b, [i * F.lit(layout.stride(k)) for k, i in enumerate(index)]).cast("long")


def tile_shard_linear(layout: Sharding, index: list[Column]) -> Column:
    """The row-major number of a tile index in the order of dimensions, whatever their places."""
    return reduce(lambda a, x: a * F.lit(x[0].sharding) + x[1], zip(layout.dims, index, strict=True), F.lit(0)).cast("long")


def tile_bounds(layout: Sharding, shard: Column) -> tuple[list[Column], list[Column]]:
    """Inclusive bounds of a shard's tile in each real dimension ([0, 0] for a scalar)."""
    index = tile_index(layout, shard)
    low = [index[k] * F.lit(layout.dims[k].extent) for k in layout.real] or [F.lit(0).cast("long")]
    high = [a + F.lit(layout.dims[k].extent - 1) for a, k in zip(low, layout.real, strict=False)] or [F.lit(0).cast("long")]
    return low, high


def volume(low: list[Column], high: list[Column]) -> Column:
    """Cells of a box."""
    return reduce(lambda a, b: a * b, [h - x + 1 for x, h in zip(low, high, strict=True)]).cast("long")


def slice_bounds(low: Column, high: Column, k: int, n: Column) -> tuple[Column, Column]:
    """The n-th of k equal slices of a range."""
    size = _div(high - low + 1, k)
    return low + n * size, low + n * size + size - 1


def cell_shards(layout: Sharding, coords: list[Column]) -> Column:
    """All shards that hold a cell, as an array (one for each replica)."""
    base = F.lit(0).cast("long")
    for c, k in zip(coords, layout.real, strict=True):
        base = base + _div(c, layout.dims[k].extent) * F.lit(layout.stride(k))
    out = F.array(base)
    for k, d in enumerate(layout.dims):
        if d.replica:
            out = _copies(out, d.sharding, layout.stride(k))
    return out


def held(rows: DataFrame, layout: Sharding, coords: list[Column]) -> DataFrame:
    """The rows that lie in a tile; where sizes divide these are all, and nothing is filtered."""
    for c, k in zip(coords, layout.real, strict=True):
        d = layout.dims[k]
        if d.tail:
            rows = rows.filter(c < d.extent * d.sharding)
    return rows


def _copies(shards: Column, n: int, stride: int) -> Column:
    """Each shard and those of its n - 1 further replicas."""
    steps = F.sequence(F.lit(0).cast("long"), F.lit((n - 1) * stride).cast("long"), F.lit(stride).cast("long"))
    return F.flatten(F.transform(shards, lambda s: F.transform(steps, lambda r: s + r)))


def layout_table(spark: SparkSession, layout: Sharding) -> DataFrame:
    """A row for each shard: shard, device, index, lo and hi as arrays, cells."""
    shard = F.col("id")
    low, high = tile_bounds(layout, shard)
    return spark.range(layout.shards).select(
        shard.alias("shard"), (shard + layout.devices.start).alias("device"), F.array(*tile_index(layout, shard)).alias("idx"), F.array(*low).alias("lo"), F.array(*high).alias("hi"), volume(low, high).alias("cells")
    )
