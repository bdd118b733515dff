"""Queries of arrays in blocks: tile form, moves, kernels, products and single tiles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardflow.catalogue.arrays import (
    _CUBE_SQL, _EVENTS_SQL, _STATS, _VECTORS_SQL, E1, E3, V2, Layout, _cube, _dims_sql, _events, _joined_sql, _layout, _list, _query, _real, _shards_sql, _tiles_sql, _vectors,
)
from shardflow.operators import BlockedArray, matmul, matmul_kernel
from shardflow.operators.gang import gang
from shardflow.operators.totals import totals
from shardflow.sources.arrays import table

#: Cells of a block in each dimension, for arrays of one, two and three.
BLOCKS = {1: [96], 2: [100, 32], 3: [7, 10, 10]}


def _blocked(spark: SparkSession, d: str, rank: int, layout: str) -> BlockedArray:
    if rank == 2:
        return BlockedArray.from_lists(table(spark, d, "embeddings"), "vec_id", "embedding", _layout(spark, d, layout), "F32").stacked(BLOCKS[2][0])
    return BlockedArray.from_cells((_events if rank == 1 else _cube)(spark, d, layout), BLOCKS[rank])


def _pieces_sql(cells: str, src: Layout, dst: Layout | None, what: str, rank: int) -> str:
    """Cells by destination shard and block: blocks are counted from the source's tiles and cut by the destination's."""
    real = range(len(_real(src)))
    on = lambda t: " AND ".join(f"c.i{k} BETWEEN {t}.lo{k} AND {t}.hi{k}" for k in real)
    start = [f"(a.lo{k} + (c.i{k} - a.lo{k}) // {BLOCKS[rank][k]} * {BLOCKS[rank][k]})" for k in real]
    tiles = f"(SELECT * FROM {_tiles_sql(src)} t WHERE {' AND '.join(f'd{k} = 0' for k, (size, pieces, _) in enumerate(_dims_sql(src)) if size == '1' and pieces > 1) or 'true'})"
    if dst is None:
        return f"SELECT a.shard::BIGINT AS shard, {_joined_sql(start)} AS lo, {what} FROM {cells} c JOIN {tiles} a ON {on('a')} GROUP BY a.shard, {', '.join(start)}"
    low = [f"greatest({s}, b.lo{k})" for k, s in enumerate(start)]
    return f"SELECT b.shard::BIGINT AS shard, {_joined_sql(low)} AS lo, {what} FROM {cells} c JOIN {tiles} a ON {on('a')} JOIN {_tiles_sql(dst)} b ON {on('b')} GROUP BY b.shard, {', '.join(low)}"


def _hash_of_block(array: BlockedArray) -> DataFrame:
    """A row for each block of each shard: its corner, its cells and a sum that tells their order."""
    values = F.aggregate("vals", F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("s")), lambda a, v: F.struct((a["n"] + 1).alias("n"), (a["s"] + (a["n"] + 1) * v).alias("s")))
    return array.by_shard().select("shard", _list("lo").alias("lo"), F.size("vals").cast("long").alias("cells"), values["s"].alias("ordered"))


def _ordered_sql(rank: int) -> str:
    order = ", ".join(f"i{k}" for k in range(rank))
    return f"count(*)::BIGINT AS cells, list_sum(list_transform(array_agg(v ORDER BY {order}), lambda v, n: n * v))::BIGINT AS ordered"


_WHOLE_VECTORS_SQL = f"(SELECT i0, i1, floor(v::DOUBLE * 1000)::BIGINT AS v FROM {_VECTORS_SQL})"


def _whole_vectors(spark: SparkSession, d: str, layout: str) -> BlockedArray:
    return _blocked(spark, d, 2, layout).map(lambda v: F.floor(v.cast("double") * 1000), "S64")


@_query("tile_values", "WITH w AS (SELECT i0, v, n // 4 AS e, i0 // (n // 4) AS shard FROM " + _EVENTS_SQL + f""", (SELECT count(*) AS n FROM events))
 SELECT shard::BIGINT AS shard, min(i0)::VARCHAR AS lo, max(i0)::VARCHAR AS hi, string_agg(v::VARCHAR, ',' ORDER BY i0) AS vals FROM w GROUP BY shard, (i0 - shard * e) // {BLOCKS[1][0]}""")
def tile_values(spark: SparkSession, d: str) -> DataFrame:
    """Every tile as blocks of at most 96 values."""
    high = F.zip_with("lo", "size", lambda a, n: a + n - 1)
    return _blocked(spark, d, 1, E1).by_shard().select("shard", _list("lo").alias("lo"), _list(high).alias("hi"), _list("vals").alias("vals"))


@_query("tile_blocks_2d", _pieces_sql(_WHOLE_VECTORS_SQL, V2, None, _ordered_sql(2), 2))
def tile_blocks_2d(spark: SparkSession, d: str) -> DataFrame:
    return _hash_of_block(_whole_vectors(spark, d, V2))


@_query("tile_blocks_3d", _pieces_sql(_CUBE_SQL, E3, None, _ordered_sql(3), 3))
def tile_blocks_3d(spark: SparkSession, d: str) -> DataFrame:
    return _hash_of_block(_blocked(spark, d, 3, E3))


#: Moves of blocks: dimensions, source, destination.
_MOVES = {
    "1d": (1, "N/4", "N/5"),
    "gather": (1, "N/4", "N/1@0, 1/2@1"),
    "scatter": (1, "N/1@0, 1/2@1", "N/8"),
    "2d": (2, V2, "V/2@1, 64/8@0"),
    "replicated": (2, "V/2@0, 64/2@1, 1/2@2", "V/4@1, 64/1@2, 1/3@0"),
    "3d": (3, E3, "M/5@1, 10/2@2, 10/2@0"),
}


def _moves() -> None:
    for name, (rank, src, dst) in _MOVES.items():
        cells = {1: _EVENTS_SQL, 2: _WHOLE_VECTORS_SQL, 3: _CUBE_SQL}[rank]

        def array(spark: SparkSession, d: str, rank: int = rank, src: str = src) -> BlockedArray:
            return _whole_vectors(spark, d, src) if rank == 2 else _blocked(spark, d, rank, src)

        _query(f"reshard_blocks_{name}", _pieces_sql(cells, src, dst, _ordered_sql(rank), rank))(lambda spark, d, array=array, dst=dst: _hash_of_block(array(spark, d).reshard(_layout(spark, d, dst))))
        if name in ("1d", "replicated", "3d"):
            _query(f"moves_blocks_{name}", _moves_sql(cells, src, dst, rank))(lambda spark, d, array=array, dst=dst: array(spark, d).moves(_layout(spark, d, dst)))


def _moves_sql(cells: str, src: Layout, dst: Layout, rank: int) -> str:
    """Of the source shards that have a cell (in ascending order) the one sends whose turn it is by destination shard."""
    real = range(len(_real(src)))
    on = lambda t: " AND ".join(f"c.i{k} BETWEEN {t}.lo{k} AND {t}.hi{k}" for k in real)
    box = ", ".join(f"a.lo{k} + (c.i{k} - a.lo{k}) // {BLOCKS[rank][k]} * {BLOCKS[rank][k]}" for k in real)
    keys = ", ".join(f"lo{k}" for k in real)
    copies = f"(SELECT {keys}, {', '.join(f'hi{k}' for k in real)}, array_agg(shard ORDER BY shard) AS shards FROM {_tiles_sql(src)} GROUP BY ALL)"
    return f"""SELECT a.shards[1 + b.shard % len(a.shards)]::BIGINT AS src_shard, b.shard::BIGINT AS dst_shard, count(DISTINCT ({box}))::BIGINT AS pieces, count(*)::BIGINT AS cells, (8 * count(*))::BIGINT AS bytes
 FROM {cells} c JOIN {copies} a ON {on('a')} JOIN {_tiles_sql(dst)} b ON {on('b')} GROUP BY 1, 2"""


_moves()


@_query("blocks_roundtrip", _shards_sql(_CUBE_SQL, "M/5@0, 10/1@1, 10/2@2", _STATS))
def blocks_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Cells to blocks, moved, and back to cells."""
    return _blocked(spark, d, 3, E3).reshard(_layout(spark, d, "M/5@0, 10/1@1, 10/2@2")).to_cells().shard_stats()


# kernels


def _totals_of_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each block its number of cells, their sum and the largest step from one to the next."""
    for b in batches:
        vals = b.column(3)
        ends, flat = vals.offsets.to_numpy(), vals.values.to_numpy()
        parts = [flat[ends[k] : ends[k + 1]] for k in range(b.num_rows)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(p) for p in parts], pa.int64()), pa.array([int(p.sum()) for p in parts], pa.int64()), pa.array([int(np.abs(np.diff(p)).max(initial=0)) for p in parts], pa.int64())], ["shard", "n", "s", "step"])


@_query("gang_kernel", _shards_sql(_EVENTS_SQL, E1, "sum(v)::BIGINT AS total"))
def gang_kernel(spark: SparkSession, d: str) -> DataFrame:
    """An opaque kernel over the blocks of every shard; what it finds in blocks is put together by shard."""
    return _blocked(spark, d, 1, E1).kernel(_totals_of_blocks, "shard long, n long, s long, step long", [F.sum("s").alias("total")])


@_query(
    "kernel_partials",
    "WITH w AS (SELECT i0, v, i0 // (n // 4) AS shard, (i0 - (n // 4) * (i0 // (n // 4))) // 96 AS block FROM "
    + _EVENTS_SQL
    + """, (SELECT count(*) AS n FROM events)), s AS (SELECT *, abs(v - lag(v) OVER (PARTITION BY shard, block ORDER BY i0)) AS step FROM w)
 SELECT shard::BIGINT AS shard, count(DISTINCT block)::BIGINT AS blocks, count(*)::BIGINT AS cells, sum(v)::BIGINT AS total, coalesce(max(step), 0)::BIGINT AS step FROM s GROUP BY shard""",
)
def kernel_partials(spark: SparkSession, d: str) -> DataFrame:
    """The same with several partial results, which are merged each in its own way."""
    merge = [F.count("*").alias("blocks"), F.sum("n").alias("cells"), F.sum("s").alias("total"), F.max("step").alias("step")]
    return _blocked(spark, d, 1, E1).kernel(_totals_of_blocks, "shard long, n long, s long, step long", merge)


@_query("matmul_gram", f"SELECT a.i1::BIGINT AS i0, b.i1::BIGINT AS i1, sum(a.v * b.v)::BIGINT AS v FROM {_WHOLE_VECTORS_SQL} a JOIN {_WHOLE_VECTORS_SQL} b ON a.i0 = b.i0 GROUP BY a.i1, b.i1")
def matmul_gram(spark: SparkSession, d: str) -> DataFrame:
    """The product of the vectors' transpose with the vectors: blocks of vectors are what is summed over."""
    v = _whole_vectors(spark, d, "V/4@0, 64/2@1")
    return matmul(v.transposed(), v, _layout(spark, d, "64/2@0, 64/2@1")).to_cells().cells


def _ranges_of_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each block its number of cells, their sum, the least and the largest."""
    for b in batches:
        vals = b.column(3)
        ends, flat = vals.offsets.to_numpy(), vals.values.to_numpy()
        parts = [flat[ends[k] : ends[k + 1]] for k in range(b.num_rows)]
        columns = [[len(p) for p in parts], *[[int(f(p)) for p in parts] for f in (np.sum, np.min, np.max)]]
        yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, pa.int64()) for c in columns]], ["shard", "n", "s", "low", "high"])


@_query(
    "matmul_vvt",
    f"""WITH c AS (SELECT a.i0, b.i0 AS i1, sum(a.v * b.v) AS v FROM {_WHOLE_VECTORS_SQL} a JOIN {_WHOLE_VECTORS_SQL} b ON a.i1 = b.i1 GROUP BY a.i0, b.i0)
 {_shards_sql("c", "V/4@0, V/2@1", "count(*)::BIGINT AS cells, sum(v)::BIGINT AS total, min(v)::BIGINT AS v_min, max(v)::BIGINT AS v_max").replace("FROM c c", "FROM c")}""",
)
def matmul_vvt(spark: SparkSession, d: str) -> DataFrame:
    """Every vector with every vector, by the tiles of the product: cells are totalled in the tasks that make them."""
    v = _whole_vectors(spark, d, "V/4@0, 64/2@1")
    merge = [F.sum("n").alias("cells"), F.sum("s").alias("total"), F.min("low").alias("v_min"), F.max("high").alias("v_max")]
    return matmul_kernel(v, v.transposed(), _layout(spark, d, "V/4@0, V/2@1"), _ranges_of_blocks, "shard long, n long, s long, low long, high long", merge)


@_query("matmul_chain", f"""WITH g AS (SELECT a.i1 AS i0, b.i1, sum(a.v * b.v) AS v FROM {_WHOLE_VECTORS_SQL} a JOIN {_WHOLE_VECTORS_SQL} b ON a.i0 = b.i0 GROUP BY a.i1, b.i1)
 SELECT x.i0::BIGINT AS i0, y.i1::BIGINT AS i1, sum(floor(x.v::DOUBLE / 10000)::BIGINT * floor(y.v::DOUBLE / 10000)::BIGINT)::BIGINT AS v FROM g x JOIN g y ON x.i1 = y.i0 GROUP BY x.i0, y.i1""")
def matmul_chain(spark: SparkSession, d: str) -> DataFrame:
    """A chain of two products: the Gram matrix of the vectors, scaled down, with itself, moved in between."""
    v = _whole_vectors(spark, d, "V/4@0, 64/2@1")
    square = _layout(spark, d, "64/4@0, 64/2@1")
    gram = matmul(v.transposed(), v, square).map(lambda x: F.floor(x / F.lit(10_000)))
    return matmul(gram.reshard(_layout(spark, d, "64/2@0, 64/4@1")), gram.reshard(_layout(spark, d, "64/2@0, 64/1@1")), square).to_cells().cells


# single tiles, by what the scan has to read


@_query("tile_pruned_1d", f"SELECT i0::BIGINT AS i0, v FROM {_EVENTS_SQL} WHERE i0 // ((SELECT count(*) FROM events) // 4) = 2")
def tile_pruned_1d(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d, E1).tile(2)


@_query("tile_pruned_2d", f"SELECT i0::BIGINT AS i0, i1::BIGINT AS i1, v FROM {_VECTORS_SQL} WHERE i0 // ((SELECT count(*) FROM embeddings) // 4) = 2 AND i1 < 32")
def tile_pruned_2d(spark: SparkSession, d: str) -> DataFrame:
    return _vectors(spark, d, V2).tile(4)


@_query("tile_pruned_3d", f"SELECT i0::BIGINT AS i0, i1::BIGINT AS i1, i2::BIGINT AS i2, (v * 3)::BIGINT AS v FROM {_CUBE_SQL} WHERE i0 >= (SELECT count(*) // 100 FROM events) // 2 AND i1 // 2 = 3")
def tile_pruned_3d(spark: SparkSession, d: str) -> DataFrame:
    return _cube(spark, d, E3).map(lambda v: v * 3).tile(8)


# gangs and totals


def _prefix(device: int, batches: Iterator[pa.RecordBatch], ask) -> Iterator[pa.RecordBatch]:
    total = sum(int(b.column(b.num_columns - 1).to_numpy().sum()) for b in batches)
    every = [int(x) for x in ask(str(total))]
    yield pa.RecordBatch.from_arrays([pa.array([device], pa.int64()), pa.array([total], pa.int64()), pa.array([sum(every[:device])], pa.int64())], ["shard", "total", "before"])


@_query(
    "gang_prefix",
    "WITH t AS (" + _shards_sql(_EVENTS_SQL, E1, "sum(v)::BIGINT AS total") + ") SELECT shard, total, coalesce(sum(total) OVER (ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM t",
)
def gang_prefix(spark: SparkSession, d: str) -> DataFrame:
    """Four tasks at once, one for each device, that tell each other their totals."""
    return gang(_events(spark, d, E1), _prefix, "shard long, total long, before long")


@_query(
    "array_totals",
    """SELECT * FROM (SELECT 'TYPE=S64 [ ' || count(*) || ' ] % [ 4 ]' AS shape, count(*)::BIGINT AS cells, (8 * count(*))::BIGINT AS bytes, sum(floor(value * 100))::BIGINT AS total FROM events
 UNION ALL SELECT 'TYPE=S64 [ ' || count(*) // 100 || ' 10 10 ] % [ 2 5 1 ]', count(*), 8 * count(*), sum(floor(value * 100))::BIGINT FROM events)""",
)
def array_totals(spark: SparkSession, d: str) -> DataFrame:
    """Cells and bytes of arrays by shape, counted while a query over them runs, beside that query's own result."""
    return totals([_events(spark, d, E1), _cube(spark, d, E3)], F.sum("v").cast("long").alias("total"))
