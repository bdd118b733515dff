"""Arrays as blocks: rows (lo, size, vals), each a box of cells inside one tile with its values in row-major order.

A block has a bounded number of cells, so that no tile passes whole through a row, a group or a task, and moving an
array to another layout cuts blocks at the new tiles' bounds by arithmetic and ``slice``: a cell is never a row, and what
stays in its block isn't copied.  Kernels see blocks and give partial results, which are merged by shard.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shardflow.functions.layout import cell_shards, held
from shardflow.layout import Sharding
from shardflow.operators.array import ShardedArray
from shardflow.plans.classify import Move, UnsupportedReshard, classify
from shardflow.types import TYPES, width


def _div(a: Column, b: Column | int) -> Column:
    return F.call_function("div", a, F.lit(b) if isinstance(b, int) else b)


def _put(column: str, k: int, value: Column) -> Column:
    """The array with another value at place k."""
    return F.transform(column, lambda x, i: F.when(i == k, value.cast("long")).otherwise(x))


def _slab(j: int, rank: int, low: Column, n: Column) -> Column:
    """The values of a block from ``low`` (counted from the block) on for ``n`` places of dimension j."""
    inner = reduce(lambda a, k: a * F.col("size")[k], range(j + 1, rank), F.lit(1).cast("long"))
    if j == 0:
        return F.slice("vals", (low * inner + 1).cast("int"), (n * inner).cast("int"))
    outer = reduce(lambda a, k: a * F.col("size")[k], range(j), F.lit(1).cast("long"))
    rows = F.sequence(F.lit(0).cast("long"), outer - 1)
    return F.flatten(F.transform(rows, lambda o: F.slice("vals", (o * F.col("size")[j] * inner + low * inner + 1).cast("int"), (n * inner).cast("int"))))


def cut(pieces: DataFrame, layout: Sharding) -> DataFrame:
    """Blocks cut where a layout's tiles end, a dimension at a time; blocks inside one tile stay as they are."""
    names = ["lo", "size", "vals"]
    for j, k in enumerate(layout.real):
        d = layout.dims[k]
        if d.sharding == 1:
            continue
        lo, n = F.col("lo")[j], F.col("size")[j]
        tiles = F.sequence(_div(lo, d.extent), _div(lo + n - 1, d.extent))
        rows = pieces.select(*names, F.explode(tiles).alias("_tile"))
        low = F.greatest(lo, F.col("_tile") * d.extent)
        many = F.least(lo + n, (F.col("_tile") + 1) * d.extent) - low
        vals = F.when(many == n, F.col("vals")).otherwise(_slab(j, len(layout.real), low - lo, many))
        # new names first: inside lambdas Spark would take a column for the alias that is made beside it
        rows = rows.select(_put("lo", j, low).alias("_lo"), _put("size", j, many).alias("_size"), vals.alias("_vals"))
        pieces = rows.toDF(*names)
    return pieces


@dataclass(frozen=True)
class BlockedArray:
    pieces: DataFrame
    layout: Sharding
    dtype: str = "F64"

    @property
    def rank(self) -> int:
        return len(self.layout.real)

    @classmethod
    def from_cells(cls, array: ShardedArray, extents: Sequence[int]) -> BlockedArray:
        """Blocks of at most ``extents`` cells in each dimension, counted from where their tile begins.

        One shuffle by block; a group has at most the product of ``extents`` cells.  A block with missing or repeated
        cells is an error when it is computed.
        """
        low, high, place = [], [], F.lit(0).cast("long")
        for c, k, e in zip(array.coords, array.layout.real, extents, strict=True):
            tile = _div(F.col(c), array.layout.dims[k].extent) * array.layout.dims[k].extent
            low.append(tile + _div(F.col(c) - tile, e) * e)
            high.append(F.least(low[-1] + e, tile + array.layout.dims[k].extent))
        for c, a, z in zip(array.coords, low, high, strict=True):
            place = place * (z - a) + F.col(c) - a
        rows = array.cells.select(F.array(*low).alias("lo"), F.array(*[z - a for a, z in zip(low, high, strict=True)]).alias("size"), place.alias("place"), "v")
        grouped = rows.groupBy("lo", "size").agg(F.sort_array(F.collect_list(F.struct("place", "v"))).alias("x"))
        volume = F.aggregate("size", F.lit(1).cast("long"), lambda a, n: a * n)
        whole = (F.size("x") == volume) & (F.size(F.array_distinct("x.place")) == volume)
        vals = F.when(whole, F.col("x.v")).otherwise(F.raise_error(F.concat(F.lit("a block at "), F.array_join(F.col("lo").cast("array<string>"), ","), F.lit(" hasn't each of its cells once"))))
        return cls(grouped.select("lo", "size", vals.alias("vals")), array.layout, array.dtype)

    @classmethod
    def from_lists(cls, df: DataFrame, key: str, values: str, layout: Sharding, dtype: str) -> BlockedArray:
        """A 2-d array of a list for each key: every list is a block, cut where tiles end.  Nothing is shuffled."""
        layout.validate()
        size = F.array(F.lit(1).cast("long"), F.size(values).cast("long"))
        rows = df.select(F.array(F.col(key).cast("long"), F.lit(0).cast("long")).alias("lo"), size.alias("size"), F.col(values).cast(f"array<{TYPES[dtype][1]}>").alias("vals"))
        return cls(cut(rows, layout), layout, dtype)

    def stacked(self, rows: int) -> BlockedArray:
        """Blocks of one row each of a 2-d array put together, ``rows`` of a tile at most; one shuffle by block."""
        extent = self.layout.dims[self.layout.real[0]].extent
        i = F.col("lo")[0]
        tile = _div(i, extent) * extent
        first = tile + _div(i - tile, rows) * rows
        grouped = self.pieces.groupBy(first.alias("i"), F.col("lo")[1].alias("j"), F.col("size")[1].alias("n")).agg(F.sort_array(F.collect_list(F.struct(i.alias("at"), "vals"))).alias("x"))
        return replace(self, pieces=grouped.select(F.array("i", "j").alias("lo"), F.array(F.size("x").cast("long"), F.col("n")).alias("size"), F.flatten("x.vals").alias("vals")))

    def by_shard(self) -> DataFrame:
        """Rows (shard, lo, size, vals): the blocks of every shard, replicas too.  No row moves."""
        corner = [F.col("lo")[j] for j in range(self.rank)]
        shards, pieces = cell_shards(self.layout, corner), held(self.pieces, self.layout, corner)
        if self.layout.replicas > 1:
            return pieces.select(F.explode(shards).alias("shard"), "lo", "size", "vals")
        return pieces.select(shards[0].alias("shard"), "lo", "size", "vals")

    def map(self, value: Callable[[Column], Column], dtype: str | None = None) -> BlockedArray:
        """A new value for every cell from its old one."""
        kind = dtype or self.dtype
        return replace(self, pieces=self.pieces.select("lo", "size", F.transform("vals", lambda v: value(v).cast(TYPES[kind][1])).alias("vals")), dtype=kind)

    def tile(self, shard: int) -> BlockedArray:
        """The blocks of one shard, by the range of their first cells."""
        out = self.pieces
        for j, k in enumerate(self.layout.real):
            d = self.layout.dims[k]
            low = (shard // self.layout.stride(k)) % d.sharding * d.extent
            out = out.filter(F.col("lo")[j].between(low, low + d.extent - 1))
        return replace(self, pieces=out)

    def to_cells(self) -> ShardedArray:
        """The same array by cells."""
        rows = self.pieces.select("lo", "size", F.posexplode("vals").alias("p", "v"))
        coords, below = [], F.lit(1).cast("long")
        for j in reversed(range(self.rank)):
            coords.insert(0, (F.col("lo")[j] + _div(F.col("p").cast("long"), below) % F.col("size")[j]).alias(f"i{j}"))
            below = below * F.col("size")[j]
        return ShardedArray(rows.select(*coords, "v"), self.layout, self.dtype)

    def reshard(self, dst: Sharding, strict: bool = False) -> BlockedArray:
        """The same array in another layout: blocks are cut at the new tiles' bounds, none is taken apart.  Shards send
        what they hold; a tail that is in no tile here stays behind."""
        dst.validate()
        if [self.layout.dims[k].size for k in self.layout.real] != [dst.dims[k].size for k in dst.real]:
            raise UnsupportedReshard(f"{self.layout.short(self.dtype)} -> {dst.short(self.dtype)}")
        if strict and classify(self.layout, dst) is Move.UNSUPPORTED:
            raise UnsupportedReshard(f"{self.layout.short(self.dtype)} -> {dst.short(self.dtype)}")
        sent = held(self.pieces, self.layout, [F.col("lo")[j] for j in range(self.rank)])
        return replace(self, pieces=cut(sent, dst), layout=dst)

    def moves(self, dst: Sharding) -> DataFrame:
        """Rows (src_shard, dst_shard, pieces, cells, bytes): what each destination shard gets from each source shard.

        Of a tile's replicas the one sends whose turn it is: destination shards take them in turn.
        """
        coords = [F.col("lo")[j] for j in range(self.rank)]
        sent = held(self.reshard(dst).pieces, dst, coords).select(cell_shards(self.layout, coords).alias("srcs"), F.explode(cell_shards(dst, coords)).alias("dst_shard"), F.size("vals").cast("long").alias("cells"))
        src = F.get("srcs", F.pmod(F.col("dst_shard"), F.size("srcs")).cast("int"))
        return sent.groupBy(src.alias("src_shard"), "dst_shard").agg(F.count("*").alias("pieces"), F.sum("cells").alias("cells"), (F.sum("cells") * width(self.dtype)).alias("bytes"))

    def placed(self, parts: int) -> DataFrame:
        """The blocks of every shard, dealt over ``parts`` tasks by shard and block: a shard is many tasks' work."""
        return self.by_shard().repartition(parts, "shard", "lo")

    def kernel(self, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, merge: Sequence[Column]) -> DataFrame:
        """An opaque kernel over the blocks (shard, lo, size, vals) wherever they are, with partial results of ``schema``,
        which has a column shard; ``merge`` are the aggregates that put the partial results of a shard together."""
        return self.by_shard().mapInArrow(run, schema).groupBy("shard").agg(*merge)

    def transposed(self) -> BlockedArray:
        """A 2-d array with its dimensions exchanged."""
        a, b = self.layout.real
        dims = list(self.layout.dims)
        dims[a], dims[b] = dims[b], dims[a]
        rows, columns = F.col("size")[0], F.col("size")[1]
        vals = F.transform(F.sequence(F.lit(0).cast("long"), rows * columns - 1), lambda t: F.get("vals", ((t % rows) * columns + _div(t, rows)).cast("int")))
        turned = self.pieces.select(F.reverse("lo").alias("_lo"), F.reverse("size").alias("_size"), vals.alias("_vals")).toDF("lo", "size", "vals")
        return BlockedArray(turned, replace(self.layout, dims=tuple(dims)), self.dtype)


#: Cells of partial products that a task holds before it hands them on.
HELD_CELLS = 1 << 20
#: Inner places and cells of the rows, and of the columns, that a task has whole; places of a product's side made at a time.
INNER, PANEL_CELLS, SIDE = 1 << 12, 1 << 20, 256


def _batches(found: dict, kind) -> Iterator[pa.RecordBatch]:
    keys = list(found)
    for k in range(0, len(keys), 64):
        part = keys[k : k + 64]
        lo = pa.array([list(x[:2]) for x in part], pa.list_(pa.int64()))
        size = pa.array([list(x[2:]) for x in part], pa.list_(pa.int64()))
        vals = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum([found[x].size for x in part])), pa.int32()), pa.array(np.concatenate([found[x].ravel() for x in part]), kind))
        yield pa.RecordBatch.from_arrays([lo, size, vals], ["lo", "size", "vals"])


def _block(batch: pa.RecordBatch, first: int, row: int, dtype) -> tuple[list[int], np.ndarray]:
    lo, size = (batch.column(first + k)[row].as_py() for k in (0, 1))
    return lo, batch.column(first + 2)[row].values.to_numpy(zero_copy_only=False).astype(dtype).reshape(size)


def _checked(a: BlockedArray, b: BlockedArray, dst: Sharding) -> tuple[int, int, int]:
    """Rows, inner places and columns of a product."""
    (m, inner), (again, n) = ([x.layout.dims[k].size for k in x.layout.real] for x in (a, b))
    if inner != again:
        raise ValueError(f"inner sizes {inner} and {again} differ")
    dst.validate()
    sizes = [dst.dims[k].size for k in dst.real]
    if sizes != [m, n]:
        raise ValueError(f"the product hasn't the sizes {sizes}")
    return m, inner, n


def _wide(m: int, inner: int, n: int) -> bool:
    """Whether a product has more cells than its factors together, and tasks can have rows and columns of these whole."""
    return inner <= INNER and m * n > inner * (m + n)


def _kinds(a: BlockedArray, b: BlockedArray) -> tuple:
    """Whole numbers stay whole: the types of products in NumPy, Arrow and Spark, and the product's own."""
    whole = not (a.dtype[0] in "FBC" or b.dtype[0] in "FBC")
    return (np.int64, pa.int64(), "bigint", "S64") if whole else (np.float64, pa.float64(), "double", "F64")


def _dealt(a: BlockedArray, b: BlockedArray, sizes: tuple[int, int, int], grid: tuple[int, int]) -> DataFrame:
    """Rows (lo, size, vals, right) with a partition for each place of a grid over the product: the blocks of a range of a's
    rows and of a range of b's columns, of about ``PANEL_CELLS`` cells at most.  The grid grows with the sizes."""
    m, inner, n = sizes
    rows, columns = (max(g, -(-x * inner // PANEL_CELLS)) for g, x in zip(grid, (m, n), strict=True))
    steps = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    at = lambda x, k, size: _div(F.col("lo")[x] * k, size).cast("int")
    left = a.pieces.select("lo", "size", "vals", F.lit(False).alias("right"), at(0, rows, m).alias("r"), steps(columns).alias("c"))
    right = b.pieces.select("lo", "size", "vals", F.lit(True).alias("right"), steps(rows).alias("r"), at(1, columns, n).alias("c"))
    return left.unionByName(right).withColumn("place", F.col("r") * columns + F.col("c")).repartitionById(rows * columns, F.col("place")).select("lo", "size", "vals", "right")


def _panel(blocks: list, inner: int, dtype) -> tuple[int, np.ndarray, np.ndarray]:
    """The first row of some blocks, their rows (whole in the inner dimension), and a flag for each that a block has."""
    first, end = min(lo[0] for lo, _ in blocks), max(lo[0] + len(x) for lo, x in blocks)
    out, there = np.zeros((end - first, inner), dtype), np.zeros(end - first, bool)
    for (i, k), x in blocks:
        out[i - first : i - first + len(x), k : k + x.shape[1]] += x
        there[i - first : i - first + len(x)] = True
    return first, out, there


def _steps(first: int, there: np.ndarray, extent: int) -> list[tuple[int, int]]:
    """Ranges of at most ``SIDE`` places that are there, cut where tiles end."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], there.astype(np.int8), [0]]))) + first
    out = []
    for low, end in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        while low < end:
            stop = min(end, low + SIDE, (low // extent + 1) * extent)
            out.append((low, stop))
            low = stop
    return out


def _exact_in_doubles(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether no sum of products of rows of whole numbers leaves what doubles hold exactly."""
    top = [max(int(z.max(initial=0)), -int(z.min(initial=0))) for z in (x, y)]
    return top[0] * top[1] * x.shape[1] < 1 << 53


def _products(batches: Iterator[pa.RecordBatch], inner: int, dtype, dst: Sharding) -> Iterator[tuple[int, int, np.ndarray]]:
    """Each block of the product of a task's rows and columns: its first row and column, and its cells, all of one tile."""
    sides: tuple[list, list] = ([], [])
    for batch in batches:
        for r in range(batch.num_rows):
            lo, x = _block(batch, 0, r, dtype)
            if batch.column(3)[r].as_py():
                sides[1].append((lo[::-1], x.T))
            else:
                sides[0].append((lo, x))
    if not all(sides):
        return
    (i0, x, rows), (j0, y, columns) = (_panel(side, inner, dtype) for side in sides)
    if dtype is np.int64 and _exact_in_doubles(x, y):
        x, y = x.astype(np.float64), y.astype(np.float64)
    extents = [dst.dims[k].extent for k in dst.real]
    across = _steps(j0, columns, extents[1])
    for i, end in _steps(i0, rows, extents[0]):
        for j, stop in across:
            yield i, j, (x[i - i0 : end - i0] @ y[j - j0 : stop - j0].T).astype(dtype, copy=False)


def matmul_kernel(a: BlockedArray, b: BlockedArray, dst: Sharding, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, merge: Sequence[Column], grid: tuple[int, int] = (4, 4)) -> DataFrame:
    """An opaque kernel over the blocks of a product by shard, as :meth:`BlockedArray.kernel` has it.

    Where the product is larger than its factors, ``run`` gets each block in the task that makes it, one at a time, and no
    cell of the product is written, shuffled or handed to another process: only what ``run`` gives is."""
    sizes = _checked(a, b, dst)
    if not _wide(*sizes):
        return matmul(a, b, dst, grid).kernel(run, schema, merge)
    dtype, kind, _, _ = _kinds(a, b)
    dims = [(dst.dims[k].extent, dst.dims[k].sharding, dst.stride(k)) for k in dst.real]
    copies = [0]
    for k, d in enumerate(dst.dims):
        if d.replica:
            copies = [x + r * dst.stride(k) for x in copies for r in range(d.sharding)]

    def blocks(batches):
        for i, j, z in _products(batches, sizes[1], dtype, dst):
            tile = [x // extent for x, (extent, _, _) in zip((i, j), dims, strict=True)]
            if any(t >= pieces for t, (_, pieces, _) in zip(tile, dims, strict=True)):
                continue  # behind the last tiles: no shard holds it
            shard = sum(t * stride for t, (_, _, stride) in zip(tile, dims, strict=True))
            vals = pa.ListArray.from_arrays(pa.array([0, z.size], pa.int32()), pa.array(z.ravel(), kind))
            for c in copies:
                yield pa.RecordBatch.from_arrays([pa.array([shard + c], pa.int64()), pa.array([[i, j]], pa.list_(pa.int64())), pa.array([list(z.shape)], pa.list_(pa.int64())), vals], ["shard", "lo", "size", "vals"])

    return _dealt(a, b, sizes, grid).mapInArrow(lambda batches: run(blocks(batches)), schema).groupBy("shard").agg(*merge)


def matmul(a: BlockedArray, b: BlockedArray, dst: Sharding, grid: tuple[int, int] = (4, 4)) -> BlockedArray:
    """The product of two 2-d arrays as blocks of ``dst``.

    A product with more cells than its factors, of at most ``INNER`` inner places, is made by a grid of tasks: each has
    the rows of its place and the columns of its place whole, so that nothing of the product is shuffled.

    Otherwise blocks meet by where they are in the inner dimension (both must be cut alike there) and in a grid of tasks over
    the result: a's blocks go to a row of the grid, b's to a column, so that an inner place that all blocks share is dealt
    over the grid.  Tasks add products of equal result blocks while they hold at most ``HELD_CELLS`` cells; what is left
    meets by result block, sorted, and is added as it streams.  Whole numbers stay whole (64 bits).
    """
    sizes = _checked(a, b, dst)
    dtype, kind, spark_type, name = _kinds(a, b)
    schema = f"lo array<bigint>, size array<bigint>, vals array<{spark_type}>"
    if _wide(*sizes):

        def made(batches):
            for i, j, z in _products(batches, sizes[1], dtype, dst):
                yield from _batches({(i, j, *z.shape): z}, kind)

        return BlockedArray(_dealt(a, b, sizes, grid).mapInArrow(made, schema), dst, name)
    rows, columns = grid
    steps = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = a.pieces.select(F.col("lo").alias("alo"), F.col("size").alias("asize"), F.col("vals").alias("avals"), F.col("lo")[1].alias("k"), F.pmod(F.xxhash64(F.col("lo")[0]), F.lit(rows)).cast("int").alias("r"), steps(columns).alias("c"))
    right = b.pieces.select(F.col("lo").alias("blo"), F.col("size").alias("bsize"), F.col("vals").alias("bvals"), F.col("lo")[0].alias("k"), F.pmod(F.xxhash64(F.col("lo")[1]), F.lit(columns)).cast("int").alias("c"), steps(rows).alias("r"))
    pairs = left.join(right, ["k", "r", "c"]).select("alo", "asize", "avals", "blo", "bsize", "bvals")

    def multiply(batches):
        held: dict[tuple, np.ndarray] = {}
        cells = 0
        for batch in batches:
            for row in range(batch.num_rows):
                (i, k), x = _block(batch, 0, row, dtype)
                (m, j), y = _block(batch, 3, row, dtype)
                if k != m or x.shape[1] != y.shape[0]:
                    raise ValueError("the arrays are cut differently in the inner dimension")
                key = (i, j, x.shape[0], y.shape[1])
                if key in held:
                    held[key] += x @ y
                else:
                    held[key] = x @ y
                    cells += held[key].size
                if cells > HELD_CELLS:
                    yield from _batches(held, kind)
                    held, cells = {}, 0
        yield from _batches(held, kind)

    def add(batches):
        key, total = None, None
        for batch in batches:
            done: dict[tuple, np.ndarray] = {}
            for row in range(batch.num_rows):
                lo, x = _block(batch, 0, row, dtype)
                here = (*lo, *x.shape)
                if here == key:
                    total = total + x
                else:
                    if key is not None:
                        done[key] = total
                    key, total = here, x
            yield from _batches(done, kind)
        if key is not None:
            yield from _batches({key: total}, kind)

    summed = pairs.mapInArrow(multiply, schema).repartition("lo").sortWithinPartitions("lo").mapInArrow(add, schema)
    return BlockedArray(cut(summed, dst), dst, name)
