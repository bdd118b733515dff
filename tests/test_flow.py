import pytest
from pyspark.sql import functions as F

from shardflow.flow import Future, Store, Token, View, Writers, across, after, defer
from shardflow.mesh import DeviceList


def test_a_view_keeps_its_version(spark):
    s = Store.create(spark.range(3).withColumn("v", F.col("id")))
    v = s.view()
    s.write(lambda df: df.withColumn("v", F.col("v") + 10))
    assert [r["v"] for r in v.df.orderBy("id").collect()] == [0, 1, 2]
    assert [r["v"] for r in s.df.orderBy("id").collect()] == [10, 11, 12] and s.version == 1
    s.checkpoint().wait()
    assert s.df.count() == 3


def test_defer_nests_and_takes_lists(spark):
    x = Store.create(spark.range(5))
    total = defer(lambda dfs: defer(lambda a: a.agg(F.sum("id").alias("s")), dfs[0].union(dfs[1])), [x, x.view()])
    assert total.first()["s"] == 20


def plus(n):
    return lambda df: df.withColumn("v", F.col("v") + n)


def total(df):
    return df.agg(F.sum("v")).first()[0]


def test_a_writer_hands_its_last_version_over(spark):
    s = Store.create(spark.range(4).withColumn("v", F.lit(0)))

    def inner(store: Store):
        store.write(plus(1)).write(plus(1))

    def outer(store: Store, before: View):
        store.write(plus(10))
        with pytest.raises(RuntimeError, match="still writes"):
            s.df  # noqa: B018
        defer(inner, store)
        store.write(plus(100))
        return before

    kept = defer(outer, s, s.view())
    assert s.version == 1 and total(s.df) == 4 * 112 and total(kept.df) == 0
    assert [(path, total(df)) for path, df in s.tree()] == [("0", 0), ("1.1", 40), ("1.2.1", 44), ("1.2.2", 48), ("1.2", 48), ("1.3", 448), ("1", 448)]
    defer(lambda df: df, s)
    assert s.version == 1


def test_a_task_that_fails_leaves_nothing(spark):
    stores = [Store.create(spark.range(3).withColumn("v", F.lit(k))) for k in range(3)]

    def fails(writers):
        writers[0].write(plus(1))
        defer(lambda more: more[0].write(plus(1)), Writers(writers[1:2]))
        raise ArithmeticError

    with pytest.raises(ArithmeticError):
        defer(fails, Writers(stores))
    assert [s.version for s in stores] == [0, 0, 0] and [total(s.df) for s in stores] == [0, 3, 6]

    def bad(writers):
        writers[0].write(plus(1))
        writers[2].write(lambda df: df.withColumn("v", F.raise_error(F.lit("no value")).cast("int")))

    with pytest.raises(Exception, match="no value"):
        defer(bad, Writers(stores, durable=True))
    assert [s.version for s in stores] == [0, 0, 0]
    defer(lambda w: [s.write(plus(5)) for s in w[:2]], Writers(stores, durable=True))
    assert [s.version for s in stores] == [1, 1, 0] and [total(s.df) for s in stores] == [15, 18, 6]


def test_a_store_has_one_writer_at_a_time(spark):
    s = Store.create(spark.range(1).withColumn("v", F.lit(0)))
    c = s.child()
    for f in (s.child, s.view, lambda: s.write(plus(1))):
        with pytest.raises(RuntimeError):
            f()
    c.write(plus(1)).close()
    assert s.version == 1
    with pytest.raises(RuntimeError, match="isn't open"):
        c.close()


def test_tokens(spark):
    s, seen = Store.create(spark.range(2).withColumn("v", F.lit(1))), []

    def write(store: Store):
        store.write(plus(4))

    first = defer(write, s)
    second = defer(lambda: seen.append("second"))
    assert isinstance(first, Token) and [x.version for x in first.written] == [1] and not first.done and second.written == []
    assert after(first, second).defer(lambda df: (seen.append("third"), total(df))[1], s) == 10
    assert first.done and seen == ["second", "third"]


def test_futures(spark):
    f = Future(spark.range(5).agg(F.sum("id")))
    assert f.get() == 10 and f.view().df.first()[0] == 10 and defer(lambda df: df.first()[0] + 1, f) == 11
    with pytest.raises(ValueError, match="one row"):
        Future(spark.range(2)).get()


def test_across(spark):
    assert sorted(r["device"] for r in across(spark.range(8).withColumnRenamed("id", "device"), DeviceList(2, 3)).collect()) == [2, 3, 4]
