"""Sharded arrays: a DataFrame of cells (i0, i1, ..., v) and a layout.

Cells are stored once; replicas are expanded only where a result needs the contents of each shard.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from shardflow.functions.layout import cell_shards, held
from shardflow.layout import Sharding
from shardflow.mesh import DeviceList
from shardflow.types import TYPES


class ArrayIds:
    """Numbers of arrays, counted for each device list: what stays the same when an array moves to other memory."""

    def __init__(self):
        self._next: dict[DeviceList, itertools.count] = {}

    def allocate(self, devices: DeviceList) -> int:
        return next(self._next.setdefault(devices, itertools.count()))


IDS = ArrayIds()


@dataclass(frozen=True)
class ShardedArray:
    """``box(lo, hi)``, where it is known, scans only the cells between two corners; ``id`` tells arrays on the same
    devices apart and stays where values stay (:meth:`move_to_memory`, :func:`swap`)."""

    cells: DataFrame
    layout: Sharding
    dtype: str = "F64"
    name: str = ""
    box: Callable[[list[int], list[int]], DataFrame] | None = field(default=None, compare=False)
    id: int | None = None

    @classmethod
    def create(cls, cells: DataFrame, layout: Sharding, dtype: str = "F64", name: str = "") -> ShardedArray:
        """From a table whose first columns are the coordinates and whose last is the value."""
        layout.validate()
        *coords, value = cells.columns
        if len(coords) != len(layout.real):
            raise ValueError(f"{len(coords)} coordinates for {len(layout.real)} dimensions")
        named = [F.col(c).cast("long").alias(f"i{k}") for k, c in enumerate(coords)]
        return cls(cells.select(*named, F.col(value).cast(TYPES[dtype][1]).alias("v")), layout, dtype, name, id=IDS.allocate(layout.devices))

    @property
    def coords(self) -> list[str]:
        return self.cells.columns[:-1]

    def sharded(self) -> DataFrame:
        """The cells of every shard: shard, coordinates, v.  Narrow: no row moves."""
        coords = [F.col(c) for c in self.coords]
        shards, cells = cell_shards(self.layout, coords), held(self.cells, self.layout, coords)
        return cells.select(F.explode(shards).alias("shard"), *self.coords, "v") if self.layout.replicas > 1 else cells.select(shards[0].alias("shard"), *self.coords, "v")

    def placed(self) -> DataFrame:
        """The same with a partition for each shard (an int here): one shuffle, which grouping by shard uses again."""
        return self.sharded().withColumn("shard", F.col("shard").cast("int")).repartitionById(self.layout.shards, F.col("shard"))

    def bounds(self, shard: int) -> tuple[list[int], list[int]]:
        """The first and the last cell of a shard's tile."""
        dims = [(self.layout.dims[k], self.layout.stride(k)) for k in self.layout.real]
        low = [(shard // stride) % d.sharding * d.extent for d, stride in dims]
        return low, [a + d.extent - 1 for a, (d, _) in zip(low, dims, strict=True)]

    def tile(self, shard: int) -> DataFrame:
        """The cells of one shard: where the source knows how, ranges of its key and places of its lists are scanned and
        nothing else, otherwise the cells are filtered."""
        low, high = self.bounds(shard)
        out = self.cells if self.box is None else self.box(low, high)
        for c, a, z in zip(self.coords, low, high, strict=True):
            out = out.filter(F.col(c).between(a, z))
        return out

    def _changed(self, cells: Callable[[DataFrame], DataFrame]) -> ShardedArray:
        """Each cell on its own is changed: so are the cells of a box.  A new array."""
        box = self.box
        return replace(self, cells=cells(self.cells), box=None if box is None else lambda lo, hi: cells(box(lo, hi)), id=IDS.allocate(self.layout.devices))

    def map(self, value: Callable[[Column], Column]) -> ShardedArray:
        """A new value for every cell from its old one: no row moves."""
        return self._changed(lambda cells: cells.select(*self.coords, value(F.col("v")).cast(TYPES[self.dtype][1]).alias("v")))

    def fill(self, value: Callable[..., Column]) -> ShardedArray:
        """A value for every cell from its coordinates."""
        return self._changed(lambda cells: cells.select(*self.coords, value(*[F.col(c) for c in self.coords]).cast(TYPES[self.dtype][1]).alias("v")))

    def scale(self, factor: float) -> ShardedArray:
        return self.map(lambda v: v * factor)

    def zero(self) -> ShardedArray:
        return self.map(lambda v: F.lit(0))

    def mismatches(self, expected: Callable[..., Column]) -> DataFrame:
        """Rows (shard, cells, wrong) that compare every cell of every shard with a value from its coordinates."""
        wrong = ~F.col("v").eqNullSafe(expected(*[F.col(c) for c in self.coords]).cast(TYPES[self.dtype][1]))
        return self.sharded().groupBy("shard").agg(F.count("*").alias("cells"), F.sum(wrong.cast("long")).alias("wrong"))

    def shard_stats(self) -> DataFrame:
        """Rows (shard, cells, v_min, v_max): partial aggregates before the shuffle."""
        return self.sharded().groupBy("shard").agg(F.count("*").alias("cells"), F.min("v").alias("v_min"), F.max("v").alias("v_max"))

    def move_to_memory(self, level: StorageLevel = StorageLevel.MEMORY_AND_DISK, free: ShardedArray | None = None) -> ShardedArray:
        """Keep the cells at another storage level; values and identity stay.  ``free`` gives another array's up."""
        kept = replace(self, cells=self.cells.persist(level), box=None)
        if free is not None:
            free.cells.unpersist(blocking=False)
        return kept


class ArrayCache:
    """Arrays that are kept for use again, by layout and type: a pool at one storage level."""

    def __init__(self, level: StorageLevel = StorageLevel.MEMORY_AND_DISK):
        self.level = level
        self._free: dict[tuple[Sharding, str], list[ShardedArray]] = {}

    def get(self, layout: Sharding, dtype: str, make: Callable[[], ShardedArray], least: int = 0) -> ShardedArray:
        """A kept array, if more than ``least`` are there, else a new one."""
        kept = self._free.get((layout, dtype), [])
        return kept.pop() if len(kept) > least else make()

    def free(self, array: ShardedArray) -> None:
        self._free.setdefault((array.layout, array.dtype), []).append(array)

    def counts(self) -> dict[str, int]:
        """How many arrays are kept of each shape."""
        return {layout.short(dtype): len(x) for (layout, dtype), x in self._free.items()}

    def clear(self) -> None:
        for arrays in self._free.values():
            for a in arrays:
                a.cells.unpersist(blocking=False)
        self._free.clear()


def swap(array: ShardedArray, into: ArrayCache, save: ArrayCache | None = None) -> ShardedArray:
    """The array's values at the storage level of another pool, under the array's own id.

    A place that the pool has free is taken up (its old values are given up), the values are copied from where they are,
    and only then does the old place go: to ``save``, for use again, or away.  The values are computed no second time.
    """
    place = into.get(array.layout, array.dtype, lambda: array)
    if place is not array:
        place.cells.unpersist(blocking=False)
    # a plan of its own, so that both places exist side by side while values are copied
    cells = array.cells.filter(F.lit(True)).persist(into.level)
    cells.count()
    if save is None:
        array.cells.unpersist(blocking=False)
    else:
        save.free(array)
    return replace(array, cells=cells, box=None)
