"""Classes of moves are those of their SQL whatever divides the number of events."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from shardflow import catalogue
from shardflow.catalogue.layouts import MOVES, _undivided
from shardflow.layout import Sharding
from shardflow.plans.classify import classify
from tests.test_catalogue import DATA, normal


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.filterwarnings("ignore:the layout")
def test_events_that_128_divides(spark, tmp_path):
    """12,800 events, as the 6,000,000 of the large tables, can be shared by 64 replicas of halves."""
    events = spark.range(12_800).select(F.col("id").alias("event_id"), (F.col("id") / 4).alias("value"))
    events.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    os.symlink(f"{DATA}/embeddings.parquet", tmp_path / "embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{DATA}/embeddings.parquet'")
    want = con.execute(catalogue.ORACLE["classify_matrix"])
    names = [x[0] for x in want.description]
    assert normal(catalogue.QUERIES["classify_matrix"](spark, str(tmp_path)).select(*names).collect()) == normal(want.fetchall())


def test_classes_of_moves_by_size():
    """Of every number of events that its arrays take, each move has the class that its SQL says; the layout of a number
    that 128 doesn't divide is as it was, and where it does the move with 64 replicas has another class."""
    for n in (200, 400, 1000, 10_000, 12_800, 100_000, 128 * 130, 128 * 9 * 25 * 65, 6_000_000, 128 * 46_875 * 13 * 11):
        for name, (_, src, dst, move) in MOVES.items():
            sized = [x.replace("N", str(n)).replace("M", str(n // 100)).replace("V", "51282") for x in (_undivided(n) if name == "nothing divides" else src, dst)]
            assert classify(*map(Sharding.of, sized)).value == move, (n, name)
        assert (_undivided(n) == MOVES["nothing divides"][1]) == (n % 128 > 0)
    assert classify(Sharding.of("6000000/2@0, 1/64@1"), Sharding.of("6000000/1@0, 1/128@1")).value == "partial_to_replicated"
