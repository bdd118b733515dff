"""Queries of layouts, devices, classes of moves and transfers, all over the cells of arrays of the tables."""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shardflow.catalogue.arrays import (
    _CUBE_SQL, _EVENTS_SQL, _VECTORS_SQL, E1, Layout, _cube, _dims_sql, _events, _joined_sql, _layout, _list, _query, _real, _tiles_sql, _vectors,
)
from shardflow.flow import defer
from shardflow.functions import layout as fl
from shardflow.layout import Sharding
from shardflow.mesh import DeviceList
from shardflow.operators import ShardedArray
from shardflow.plans.classify import classify
from shardflow.plans.transfer import broadcast_tree, moved_cells
from shardflow.sources.arrays import table
from shardflow.types import TYPES

_ARRAYS = {1: _events, 2: _vectors, 3: _cube}
_SQL = {1: _EVENTS_SQL, 2: _VECTORS_SQL, 3: _CUBE_SQL}

#: Layouts of arrays of the tables: dimensions of the cells, and the layout.
LAYOUTS: dict[str, tuple[int, str]] = {
    "full": (2, "V/4@0, 64/2@1"),
    "permuted": (3, "M/2@2, 10/5@0, 1/4@1, 10/1@3"),
    "partial": (2, "V/2@0, 1/4@1, 64/4@2"),
    "partial_permuted": (2, "V/2@2, 1/4@0, 64/4@1"),
    "replicated": (2, "1/4@0, V/1@1, 64/1@2"),
}


def _array(spark: SparkSession, d: str, name: str) -> ShardedArray:
    rank, text = LAYOUTS[name]
    return _ARRAYS[rank](spark, d, text)


def _counted(a: ShardedArray) -> DataFrame:
    """Rows (shard, cells): partial aggregates before the shuffle."""
    return a.sharded().groupBy("shard").agg(F.count("*").alias("cells"))


def _by_tile_sql(name: str, what: str, more: str = "") -> str:
    """An aggregate of the cells of each shard."""
    rank, text = LAYOUTS[name]
    inside = " AND ".join(f"c.i{k} BETWEEN t.lo{k} AND t.hi{k}" for k in range(rank))
    return f"SELECT shard::BIGINT AS shard, {what}, count(*)::BIGINT AS cells FROM {_SQL[rank]} c JOIN {_tiles_sql(text)} t ON {inside} GROUP BY shard{more}"


def _pieces(name: str) -> list[str]:
    return [f"d{k}" for k in range(len(_dims_sql(LAYOUTS[name][1])))]


def _ends_sql(name: str) -> str:
    real = range(len(_real(LAYOUTS[name][1])))
    return f"{_joined_sql([f'min(i{k})' for k in real])} AS lo, {_joined_sql([f'max(i{k})' for k in real])} AS hi"


def _tile_queries() -> None:
    for name in ("full", "permuted"):

        def index(spark: SparkSession, d: str, name: str = name) -> DataFrame:
            """The place of each shard in the grid of pieces, and the cells that it holds."""
            a = _array(spark, d, name)
            return _counted(a).select("shard", _list(F.array(*fl.tile_index(a.layout, F.col("shard")))).alias("idx"), "cells")

        pieces = _joined_sql(_pieces(name))
        _query(f"tile_index_{name}", _by_tile_sql(name, f"{pieces} AS idx", f", {pieces}"))(index)
    for name in ("full", "partial", "partial_permuted", "replicated"):

        def bounds(spark: SparkSession, d: str, name: str = name) -> DataFrame:
            """The bounds that arithmetic gives each shard; the SQL has those of the cells in it."""
            a = _array(spark, d, name)
            low, high = fl.tile_bounds(a.layout, F.col("shard"))
            return _counted(a).select("shard", _list(F.array(*low)).alias("lo"), _list(F.array(*high)).alias("hi"), "cells")

        _query(f"tile_bounds_{name}", _by_tile_sql(name, _ends_sql(name)))(bounds)


_tile_queries()


@_query("tile_shard_inverse", _by_tile_sql("permuted", "shard::BIGINT AS again"))
def tile_shard_inverse(spark: SparkSession, d: str) -> DataFrame:
    a = _array(spark, d, "permuted")
    return _counted(a).select("shard", fl.tile_shard(a.layout, fl.tile_index(a.layout, F.col("shard"))).alias("again"), "cells")


@_query("tile_shard_linear", _by_tile_sql("permuted", "(((d0 * 5 + d1) * 4 + d2) * 1 + d3)::BIGINT AS linear", ", d0, d1, d2, d3"))
def tile_shard_linear(spark: SparkSession, d: str) -> DataFrame:
    a = _array(spark, d, "permuted")
    return _counted(a).select("shard", fl.tile_shard_linear(a.layout, fl.tile_index(a.layout, F.col("shard"))).alias("linear"), "cells")


@_query("tile_volume", _by_tile_sql("partial", "count(*)::BIGINT AS volume"))
def tile_volume(spark: SparkSession, d: str) -> DataFrame:
    a = _array(spark, d, "partial")
    return _counted(a).select("shard", fl.volume(*fl.tile_bounds(a.layout, F.col("shard"))).alias("volume"), "cells")


@_query("slice_dim", f"SELECT (i0 // (n // 4))::BIGINT AS n, min(i0)::BIGINT AS lo, max(i0)::BIGINT AS hi, count(*)::BIGINT AS cells FROM {_EVENTS_SQL}, (SELECT count(*) AS n FROM events) GROUP BY 1")
def slice_dim(spark: SparkSession, d: str) -> DataFrame:
    """The n-th quarter of the events: its bounds by arithmetic, its cells by counting."""
    a = _events(spark, d, E1)
    size = a.layout.dims[0].size
    lo, hi = fl.slice_bounds(F.lit(0).cast("long"), F.lit(size - 1).cast("long"), 4, F.col("n"))
    return a.cells.groupBy(F.expr(f"i0 div {size // 4}").alias("n")).agg(F.count("*").alias("cells")).select("n", lo.alias("lo"), hi.alias("hi"), "cells")


def _predicates_sql(name: str) -> str:
    rank, text = LAYOUTS[name]
    replica = any(size == "1" and pieces > 1 for size, pieces, _ in _dims_sql(text))
    shards = reduce(lambda a, d: a * d[1], _dims_sql(text), 1)
    return f"""SELECT '{name}' AS name, count(DISTINCT (lo, hi))::INT AS total_sharding, {len(_dims_sql(text)) - replica} AS real_dims, max(cells)::INT AS local_elements,
 (SELECT count(*) FROM {_SQL[rank]})::INT AS all_elements, count(DISTINCT (lo, hi)) BETWEEN 2 AND {shards - 1} AS partial, count(DISTINCT (lo, hi)) = {shards} AS fully, count(DISTINCT (lo, hi)) = 1 AS replicated,
 min(cells)::BIGINT AS least, max(cells)::BIGINT AS most FROM ({_by_tile_sql(name, _ends_sql(name))})"""


@_query("sharding_predicates", " UNION ALL ".join(_predicates_sql(name) for name in LAYOUTS))
def sharding_predicates(spark: SparkSession, d: str) -> DataFrame:
    """What layouts say of themselves, beside the fewest and the most cells that a shard turns out to hold."""

    def row(name: str) -> DataFrame:
        a = _array(spark, d, name)
        x = a.layout
        said = {"total_sharding": x.total_sharding, "real_dims": x.num_real_dims, "local_elements": x.num_local_elements, "all_elements": x.full_dimension_product, "partial": x.partially_replicated, "fully": x.fully_sharded, "replicated": x.replicated}
        return _counted(a).agg(F.lit(name).alias("name"), *[F.lit(v).alias(k) for k, v in said.items()], F.min("cells").alias("least"), F.max("cells").alias("most"))

    return reduce(DataFrame.union, map(row, LAYOUTS))


# element types


def _each(rows: DataFrame, values: list[tuple], names: list[str], *columns: Column) -> DataFrame:
    """Each row of a result with each of some fixed values."""
    listed = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, x, strict=True)]) for x in values])
    return rows.select("*", F.inline(listed)).select(*columns)


_TYPES_SQL = "(VALUES ('PRED', 1), ('S8', 1), ('U8', 1), ('S16', 2), ('U16', 2), ('F16', 2), ('BF16', 2), ('S32', 4), ('U32', 4), ('F32', 4), ('S64', 8), ('U64', 8), ('F64', 8), ('C64', 8), ('C128', 16)) t(dtype, bytes)"


@_query("dtype_sizes", f"SELECT dtype, bytes, (SELECT count(*) FROM events) * bytes AS array_bytes FROM {_TYPES_SQL}")
def dtype_sizes(spark: SparkSession, d: str) -> DataFrame:
    """The width of each type, and the bytes of the events as an array of it."""
    n = _events(spark, d, E1).cells.agg(F.count("*").alias("n"))
    return _each(n, [(t, w) for t, (w, _) in TYPES.items()], ["dtype", "bytes"], F.col("dtype"), F.col("bytes"), (F.col("n") * F.col("bytes")).alias("array_bytes"))


@_query("shard_bytes", f"SELECT shard::BIGINT AS shard, dtype, (count(*) * bytes)::BIGINT AS shard_bytes FROM {_EVENTS_SQL} c JOIN {_tiles_sql(E1)} t ON c.i0 BETWEEN lo0 AND hi0, {_TYPES_SQL.replace('t(', 'y(')} GROUP BY shard, dtype, bytes")
def shard_bytes(spark: SparkSession, d: str) -> DataFrame:
    """The bytes of each shard that holds cells, as the layout has them for each type."""
    a = _events(spark, d, E1)
    return _each(_counted(a), [(t, a.layout.shard_bytes(t)) for t in TYPES], ["dtype", "shard_bytes"], F.col("shard"), F.col("dtype"), F.col("shard_bytes").cast("long").alias("shard_bytes"))


# devices


def _by_device(spark: SparkSession, d: str) -> DataFrame:
    """Events dealt to sixteen devices by number."""
    return table(spark, d, "events").groupBy((F.col("event_id") % 16).alias("device")).agg(F.count("*").alias("events"))


_BY_DEVICE_SQL = "SELECT event_id % 16 AS device, count(*) AS events FROM events GROUP BY 1"


@_query("device_list_contains", f"SELECT device, device >= 4 AND device < 12 AS inside, events FROM ({_BY_DEVICE_SQL})")
def device_list_contains(spark: SparkSession, d: str) -> DataFrame:
    return _by_device(spark, d).select("device", DeviceList(4, 8).contains_column(F.col("device")).alias("inside"), "events")


@_query("device_list_slice", f"SELECT * FROM ({_BY_DEVICE_SQL}) WHERE device BETWEEN 6 AND 8")
def device_list_slice(spark: SparkSession, d: str) -> DataFrame:
    return _by_device(spark, d).filter(DeviceList(4, 8).slice(2, 3).contains_column(F.col("device")))


@_query("device_shard_id", f"SELECT device, CASE WHEN device BETWEEN 4 AND 11 THEN device - 4 END AS shard, events FROM ({_BY_DEVICE_SQL})")
def device_shard_id(spark: SparkSession, d: str) -> DataFrame:
    return _by_device(spark, d).select("device", DeviceList(4, 8).shard_column(F.col("device")).alias("shard"), "events")


@_query("scalar_array", "SELECT s::BIGINT AS shard, 1::BIGINT AS cells, (SELECT sum(floor(value * 100)) FROM events)::BIGINT AS v FROM range(4) t(s)")
def scalar_array(spark: SparkSession, d: str) -> DataFrame:
    """The sum of all events as an array without dimensions, on four devices."""
    one = _events(spark, d, E1).cells.agg(F.lit(0).alias("i"), F.sum("v").alias("v"))
    return ShardedArray.create(one, Sharding.of("1/1@0, 1/4@1"), "S64").sharded().groupBy("shard").agg(F.count("*").alias("cells"), F.max("v").alias("v"))


@_query("bulk_launch", f"SELECT device, (42 + device)::BIGINT AS v, events FROM ({_BY_DEVICE_SQL})")
def bulk_launch(spark: SparkSession, d: str) -> DataFrame:
    """One task for the events of each of sixteen devices."""
    return defer(lambda df: df.select("device", (F.col("device") + 42).alias("v"), "events"), _by_device(spark, d))


# classes of moves

#: name -> dimensions, source, destination, class
MOVES: dict[str, tuple[int, str, str, str]] = {
    "same layout, other devices": (2, "V/4@0, 64/2@1", "V/4@0, 64/2@1", "point_to_point"),
    "split one dimension": (2, "V/2@0, 64/2@1", "V/2@0, 64/4@1", "scatter_gather"),
    "partial to replicated 1d": (1, "N/2@0, 1/2@1", "N/1@0, 1/4@1", "partial_to_replicated"),
    "partial to replicated 2d": (2, "V/2@0, 1/2@1, 64/1@2", "V/1@0, 1/8@1, 64/1@2", "partial_to_replicated"),
    "partial to replicated 3d": (3, "M/2@0, 10/1@1, 10/2@2, 1/2@3", "M/1@0, 10/1@1, 10/1@2, 1/4@3", "partial_to_replicated"),
    "increase 3d": (3, "M/2@0, 10/1@1, 10/2@2", "M/10@0, 10/1@1, 10/2@2", "scatter_gather"),
    "decrease 3d": (3, "M/10@0, 10/1@1, 10/2@2", "M/2@0, 10/1@1, 10/2@2", "scatter_gather"),
    "replicas change": (3, "M/10@0, 10/1@1, 10/1@2, 1/2@3", "M/5@0, 10/1@1, 10/1@2, 1/2@3", "scatter_gather"),
    "gather to one": (2, "V/8@0, 64/1@1", "V/1@0, 64/1@1, 1/8@2", "gather"),
    "scatter": (1, "N/1@0, 1/4@1", "N/8", "scatter"),
    "gather": (1, "N/2", "N/1@0, 1/2@1", "gather"),
    "replicas to more": (1, "N/1@0, 1/2@1", "N/1@0, 1/8@1", "broadcast"),
    "replicas to fewer": (1, "N/1@0, 1/4@1", "N/1@0, 1/2@1", "point_to_point"),
    "two dimensions differ": (2, "V/4@0, 64/2@1", "V/2@0, 64/4@1", "unsupported"),
    "other rank": (1, "N/2@0, 1/2@1", "N/4", "unsupported"),
    "nothing divides": (1, "N/2@0, 1/64@1", "N/1@0, 1/128@1", "unsupported"),
}


def _replicas(text: str) -> int:
    return reduce(lambda a, x: a * x[1] if x[0] == "1" else a, _dims_sql(text), 1)


def _undivided(events: int) -> str:
    """The source of "nothing divides" as its name says, for any number of events: 128 divides 6,000,000 of them, and among
    64 replicas they could share the sending.  Then it has the next number of replicas that doesn't divide them."""
    return MOVES["nothing divides"][1].replace("1/64", f"1/{next(r for r in count(64) if events % (2 * r))}")


@_query("classify_matrix", " UNION ALL ".join(f"SELECT '{name}' AS name, '{move}' AS move, (SELECT count(*) FROM {_SQL[rank]}) * {_replicas(dst)} AS cells" for name, (rank, _, dst, move) in MOVES.items()))
def classify_matrix(spark: SparkSession, d: str) -> DataFrame:
    """The class of each move, and the cells that its destination shards get together."""
    out, undivided = [], _undivided(table(spark, d, "events").count())
    for rank, make in _ARRAYS.items():
        mine = [(name, _layout(spark, d, undivided if name == "nothing divides" else src), _layout(spark, d, dst)) for name, (r, src, dst, _) in MOVES.items() if r == rank]
        n = make(spark, d, LAYOUTS["full"][1] if rank == 2 else E1 if rank == 1 else MOVES["increase 3d"][1]).cells.agg(F.count("*").alias("n"))
        out.append(_each(n, [(name, classify(a, b).value, b.replicas) for name, a, b in mine], ["name", "move", "copies"], F.col("name"), F.col("move"), (F.col("n") * F.col("copies")).alias("cells")))
    return reduce(DataFrame.union, out)


# transfers, found in the cells


def _transfers_sql(move: str, sender: str) -> str:
    rank, src, dst, _ = MOVES[move]
    on = lambda t: " AND ".join(f"c.i{k} BETWEEN {t}.lo{k} AND {t}.hi{k}" for k in range(rank))
    keys, n_dst = ", ".join(f"lo{k}, hi{k}" for k in range(rank)), reduce(lambda a, x: a * x[1], _dims_sql(dst), 1)
    copies = f"(SELECT {keys}, array_agg(shard ORDER BY shard) AS shards FROM {_tiles_sql(src)} GROUP BY ALL)"
    place = {"turn": "b.shard % len(a.shards)", "block": f"b.shard * len(a.shards) // {n_dst}", "slice": "(c.i0 - a.lo0) // ((a.hi0 - a.lo0 + 1) // len(a.shards))"}[sender]
    low, high = _joined_sql([f"min(c.i{k})" for k in range(rank)]), _joined_sql([f"max(c.i{k})" for k in range(rank)])
    return f"""SELECT a.shards[1 + {place}]::BIGINT AS src_shard, b.shard::BIGINT AS dst_shard, {low} AS lo, {high} AS hi, count(*)::BIGINT AS cells, (count(*) * {4 if rank == 2 else 8})::BIGINT AS bytes
 FROM {_SQL[rank]} c JOIN {copies} a ON {on('a')} JOIN {_tiles_sql(dst)} b ON {on('b')} GROUP BY 1, 2"""


def _transfers(spark: SparkSession, d: str, move: str, sender: str = "turn") -> DataFrame:
    rank, src, dst, _ = MOVES[move]
    return moved_cells(_ARRAYS[rank](spark, d, src), _layout(spark, d, dst), sender)


def _transfer_queries() -> None:
    found = {
        "p2p": ("same layout, other devices", "turn"), "sg_increase": ("increase 3d", "turn"), "sg_decrease": ("decrease 3d", "turn"), "sg_1d": ("split one dimension", "turn"), "gather": ("gather", "turn"),
        "scatter": ("scatter", "block"), "any": ("two dimensions differ", "turn"), "partial_to_replicated": ("partial to replicated 1d", "slice"),
    }
    for name, (move, sender) in found.items():
        _query(f"plan_{name}", _transfers_sql(move, sender))(
            lambda spark, d, move=move, sender=sender: _transfers(spark, d, move, sender).withColumns({"lo": _list("lo"), "hi": _list("hi")})
        )


_transfer_queries()


@_query("plan_bytes_per_link", f"SELECT src_shard, sum(bytes)::BIGINT AS bytes FROM ({_transfers_sql('increase 3d', 'turn')}) GROUP BY src_shard")
def plan_bytes_per_link(spark: SparkSession, d: str) -> DataFrame:
    return _transfers(spark, d, "increase 3d").groupBy("src_shard").agg(F.sum("bytes").alias("bytes"))


@_query("plan_noop_ranks", "SELECT d::BIGINT AS device, CASE WHEN d < 2 THEN 'point_to_point' ELSE 'no_op' END AS move, CASE WHEN d < 2 THEN (SELECT count(*) FROM events) ELSE 0 END::BIGINT AS cells FROM range(6) t(d)")
def plan_noop_ranks(spark: SparkSession, d: str) -> DataFrame:
    """What each of six devices has to do where replicas become fewer, and the cells that it gets."""
    rank, src, dst, _ = MOVES["replicas to fewer"]
    a, b = _layout(spark, d, src), _layout(spark, d, dst)
    n = _events(spark, d, src).cells.agg(F.count("*").alias("n"))
    moves = [(k, classify(a, b, k).value) for k in range(6)]
    return _each(n, moves, ["device", "move"], F.col("device").cast("long").alias("device"), F.col("move"), F.when(F.col("move") == "no_op", 0).otherwise(F.col("n")).cast("long").alias("cells"))


def _tree(n_src: int, n_dst: int):
    def run(spark: SparkSession, d: str) -> DataFrame:
        """Which replica hands the events on to which, and the bytes that it gets."""
        got = _counted(_events(spark, d, f"N/1@0, 1/{n_dst}@1")).withColumnRenamed("shard", "dst_shard")
        tree = broadcast_tree(spark, n_src, n_dst).select("dst_shard", "src_shard", "from_dst", _list("leaves").alias("leaves"))
        return got.join(tree, "dst_shard").select("dst_shard", "src_shard", "from_dst", "leaves", (F.col("cells") * 8).alias("bytes"))

    return run


def _tree_sql(rows: str) -> str:
    return f"SELECT dst_shard::BIGINT AS dst_shard, src_shard::BIGINT AS src_shard, from_dst::BIGINT AS from_dst, leaves, (SELECT 8 * count(*) FROM events)::BIGINT AS bytes FROM (VALUES {rows}) t(dst_shard, src_shard, from_dst, leaves)"


_query("plan_broadcast_pow2", _tree_sql("(0, 0, NULL, '2,1'), (1, NULL, 0, ''), (2, NULL, 0, '3'), (3, NULL, 2, ''), (4, 1, NULL, '6,5'), (5, NULL, 4, ''), (6, NULL, 4, '7'), (7, NULL, 6, '')"))(_tree(2, 8))
_query("plan_broadcast_uneven", _tree_sql("(0, 0, NULL, '2,1'), (1, NULL, 0, ''), (2, NULL, 0, ''), (3, 1, NULL, '5,4'), (4, NULL, 3, ''), (5, NULL, 3, ''), (6, 2, NULL, '')"))(_tree(3, 7))


@_query(
    "plan_broadcast_reach",
    """WITH RECURSIVE p AS (SELECT n, r, r & (r - 1) AS up FROM (VALUES (6), (10), (11), (12), (14)) g(n), range(14) t(r) WHERE r < n),
 w AS (SELECT n, r, 0 AS depth FROM p WHERE r = 0 UNION ALL SELECT p.n, p.r, depth + 1 FROM w JOIN p ON p.n = w.n AND p.up = w.r AND p.r > 0)
 SELECT n::BIGINT AS n, count(*)::BIGINT AS reached, (count(*) * (SELECT count(*) FROM events))::BIGINT AS cells FROM w GROUP BY n""",
)
def plan_broadcast_reach(spark: SparkSession, d: str) -> DataFrame:
    """How many replicas of the events a tree reaches, also for sizes that are no power of two, and the cells there."""
    out = None
    for n in (6, 10, 11, 12, 14):
        tree = broadcast_tree(spark, 1, n).select(F.col("dst_shard").alias("r"), "from_dst")
        reached = tree.filter("from_dst IS NULL").select("r")
        for _k in range(n.bit_length()):
            reached = reached.union(tree.join(reached.withColumnRenamed("r", "from_dst"), "from_dst").select("r")).distinct()
        cells = _counted(_events(spark, d, f"N/1@0, 1/{n}@1")).withColumnRenamed("shard", "r")
        found = reached.join(cells, "r").agg(F.lit(n).cast("long").alias("n"), F.count("*").alias("reached"), F.sum("cells").alias("cells"))
        out = found if out is None else out.union(found)
    return out


