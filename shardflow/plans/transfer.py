"""Tables of transfers: (src_shard, dst_shard, lo, hi, cells, bytes), a row for each box that one shard sends another.

:func:`moved_cells` finds them in an array's cells; the others give the boxes that a move has for layouts alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardflow.functions.layout import cell_shards, held, layout_table
from shardflow.layout import Sharding
from shardflow.operators.array import ShardedArray
from shardflow.plans.classify import Move, classify, split_dim
from shardflow.types import width


def moved_cells(array: ShardedArray, dst: Sharding, sender: str = "turn") -> DataFrame:
    """What each destination shard gets from each source shard, by the cells that both hold: one partial aggregate.

    Of the shards that hold a cell (replicas), the one sends whose ``turn`` it is by destination shard, the one of the
    destination's ``block`` (destinations dealt to sources in equal runs), or each the ``slice`` of the tile that is its
    own along the first dimension that divides."""
    src, coords = array.layout, [F.col(c) for c in array.coords]
    n = src.replicas
    if sender == "slice":
        k = split_dim(src)
        d = src.dims[k]
        rank = F.call_function("div", coords[src.real.index(k)] % d.extent, F.lit(d.extent // n))
    elif sender == "block":
        rank = F.call_function("div", F.col("dst_shard") * n, F.lit(dst.shards))
    else:
        rank = F.pmod(F.col("dst_shard"), F.lit(n))
    cells = held(held(array.cells, src, coords), dst, coords)
    sent = cells.select(*array.coords, cell_shards(src, coords).alias("srcs"), F.explode(cell_shards(dst, coords)).alias("dst_shard"))
    ends = [f(c).alias(f"{name}{c}") for c in array.coords for name, f in (("lo_", F.min), ("hi_", F.max))]
    found = sent.groupBy(F.get("srcs", rank.cast("int")).alias("src_shard"), "dst_shard").agg(*ends, F.count("*").alias("cells"))
    corner = lambda name: F.array(*[F.col(f"{name}{c}") for c in array.coords])
    return found.select("src_shard", "dst_shard", corner("lo_").alias("lo"), corner("hi_").alias("hi"), "cells", (F.col("cells") * width(array.dtype)).alias("bytes"))


def _rows(df: DataFrame, dtype: str) -> DataFrame:
    cells = F.aggregate(F.zip_with("lo", "hi", lambda a, b: b - a + 1), F.lit(1).cast("long"), lambda a, x: a * x)
    return df.select("src_shard", "dst_shard", "lo", "hi", cells.alias("cells"), (cells * width(dtype)).alias("bytes"))


def overlap_plan(spark: SparkSession, src: Sharding, dst: Sharding) -> DataFrame:
    """Any layout to any other: each destination shard gets the overlaps with all source tiles, each from one of the
    tile's replicas, dealt out in turn."""
    a = layout_table(spark, src).groupBy("lo", "hi").agg(F.sort_array(F.collect_list("shard")).alias("copies"))
    b = layout_table(spark, dst).select("shard", F.col("lo").alias("dlo"), F.col("hi").alias("dhi"))
    meets = F.lit(True)
    for k in range(max(1, len(src.real))):
        meets &= (F.col("lo")[k] <= F.col("dhi")[k]) & (F.col("dlo")[k] <= F.col("hi")[k])
    joined = F.broadcast(a).join(b, meets)  # layouts have a row for each device
    sender = F.col("copies")[F.pmod(F.col("shard"), F.size("copies")).cast("int")]
    return joined.select(sender.alias("src_shard"), F.col("shard").alias("dst_shard"), F.zip_with("lo", "dlo", lambda x, y: F.greatest(x, y)).alias("lo"), F.zip_with("hi", "dhi", lambda x, y: F.least(x, y)).alias("hi"))


def broadcast_tree(spark: SparkSession, n_src: int, n_dst: int) -> DataFrame:
    """Rows (dst_shard, src_shard, from_dst, leaves).  Each source roots a group of destinations; in a group rank r
    receives from r & (r - 1), and the root from its source.  Leaves are listed farthest first."""
    size = -(-n_dst // n_src)
    d = spark.range(n_dst).select(F.col("id").alias("dst_shard"), F.pmod("id", F.lit(size)).alias("r"), (F.col("id") - F.pmod("id", F.lit(size))).alias("root"))
    up = F.col("r").bitwiseAND(F.col("r") - 1)
    d = d.withColumn("from_dst", F.when(F.col("r") > 0, F.col("root") + up)).withColumn("src_shard", F.when(F.col("r") == 0, F.floor(F.col("dst_shard") / size).cast("long")))
    leaves = d.filter("r > 0").groupBy(F.col("from_dst").alias("p")).agg(F.sort_array(F.collect_list("dst_shard"), asc=False).alias("leaves"))
    joined = d.join(leaves, F.col("dst_shard") == F.col("p"), "left")
    return joined.select("dst_shard", "src_shard", "from_dst", F.coalesce("leaves", F.array().cast("array<bigint>")).alias("leaves"))


def transfer_plan(spark: SparkSession, src: Sharding, dst: Sharding, dtype: str = "F32") -> DataFrame:
    """The transfers of a move.  A broadcast's rows name the first sender only; see :func:`broadcast_tree`."""
    move = classify(src, dst)
    a = layout_table(spark, src).select(F.col("shard").alias("src_shard"), "lo", "hi")
    b = layout_table(spark, dst).select(F.col("shard").alias("dst_shard"), "lo", "hi")
    n_src, n_dst = src.shards, dst.shards
    if move is Move.POINT_TO_POINT:
        return _rows(b.join(a.select("src_shard"), F.col("src_shard") == F.col("dst_shard")), dtype)
    if move is Move.SCATTER:
        return _rows(b.withColumn("src_shard", F.floor(F.col("dst_shard") * n_src / n_dst).cast("long")), dtype)
    if move is Move.BROADCAST:
        group = -(-n_dst // n_src)
        return _rows(b.withColumn("src_shard", F.floor(F.col("dst_shard") / group).cast("long")), dtype)
    if move is Move.GATHER:
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_dst - 1).cast("long"))).alias("dst_shard")
        return _rows(a.select("*", every), dtype)
    if move is Move.PARTIAL_TO_REPLICATED:
        # the replicas of a tile share the sending: the r-th sends the r-th slice
        k, r = src.real.index(split_dim(src)), src.replicas
        rank = F.row_number().over(_by_tile()) - 1
        piece = F.floor((F.col("hi")[k] - F.col("lo")[k] + 1) / r).cast("long")
        low = F.transform("lo", lambda x, i: F.when(i == k, x + F.col("rank") * piece).otherwise(x))
        high = F.transform("hi", lambda x, i: F.when(i == k, F.col("lo")[k] + (F.col("rank") + 1) * piece - 1).otherwise(x))
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_dst - 1).cast("long"))).alias("dst_shard")
        return _rows(a.withColumn("rank", rank).select("src_shard", low.alias("l"), high.alias("h"), every).selectExpr("src_shard", "dst_shard", "l AS lo", "h AS hi"), dtype)
    return _rows(overlap_plan(spark, src, dst), dtype)


def _by_tile():
    from pyspark.sql import Window

    return Window.partitionBy("lo", "hi").orderBy("src_shard")
