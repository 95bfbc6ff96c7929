from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F

from geotable.functions import bbox as B
from geotable.operators import index as X
from geotable.operators import lifecycle as L
from geotable.operators import spatial_join as J
from geotable.operators import windows as N


def random_boxes(spark, n, seed=1, size=3.0):
    r = random.Random(seed)
    data = []
    for i in range(n):
        x, y = r.uniform(0, 100), r.uniform(0, 100)
        data.append((i, x, y, x + r.uniform(0, size), y + r.uniform(0, size)))
    return data, spark.createDataFrame(data, "fid long, a double, b double, c double, d double").select("fid", B.make("a", "b", "c", "d").alias("bbox"))


def meets(b, r):
    return b[1] <= r[2] and b[3] >= r[0] and b[2] <= r[3] and b[4] >= r[1]


def test_tree_shape():
    assert X.tree_bytes(1000) == 42720 and X.tree_bytes(97894767) == 4176843520 and X.tree_bytes(0) == 0
    assert X.level_bounds(20) == [(3, 23), (1, 3), (0, 1)]
    assert X.level_bounds(16) == [(1, 17), (0, 1)]
    assert X.level_sizes(1) == [1, 1]
    for bad in (0, 1, 65536):
        with pytest.raises(ValueError, match="children"):
            X.tree_bytes(10, bad)
    with pytest.raises(ValueError, match="leaf"):
        X.level_sizes(0)


@pytest.mark.parametrize("node_size", [4, 16])
def test_search_is_complete_and_sound(spark, node_size):
    data, df = random_boxes(spark, 100)
    nodes = X.build(df, node_size)
    for rect in [(10.0, 10.0, 50.0, 60.0), (300.0, 300.0, 400.0, 400.0)]:
        got = [r.fid for r in X.search(nodes, rect, node_size).collect()]
        assert sorted(got) == [b[0] for b in data if meets(b, rect)]


def test_golden_tree_of_19(spark):
    data = [(0, 0.0, 0.0, 1.0, 1.0), (1, 2.0, 2.0, 3.0, 3.0)]
    data += [(2 + i, 100.0 + i, 100.0 + i, 110.0 + i, 110.0 + i) for i in range(5)] + [(7 + i, 10010.0, 10010.0, 10110.0, 10110.0) for i in range(12)]
    df = spark.createDataFrame(data, "fid long, a double, b double, c double, d double").select("fid", B.make("a", "b", "c", "d").alias("bbox"))
    hits = X.search(X.build(df), (102.0, 102.0, 103.0, 103.0)).collect()
    assert sorted(r.pos for r in hits) == [13, 14, 15, 16]


def test_empty_and_single(spark):
    _, df = random_boxes(spark, 1)
    assert X.search(X.build(df), (-1.0, -1.0, 200.0, 200.0)).count() == 1
    none = X.build(df.limit(0))
    assert none.count() == 0 and X.search(none, (0.0, 0.0, 1.0, 1.0)).count() == 0


def test_leaves_are_sorted_and_gapless(spark):
    _, df = random_boxes(spark, 200)
    got = X.leaves(df).orderBy("pos").collect()
    assert [r.pos for r in got] == list(range(200))
    assert all((-a.hilbert, a.fid) < (-b.hilbert, b.fid) for a, b in zip(got, got[1:], strict=False))


def test_zero_extent(spark):
    df = spark.createDataFrame([(i, 5.0) for i in range(5)], "fid long, v double").select("fid", B.make("v", "v", "v", "v").alias("bbox"))
    assert {r.hilbert for r in X.with_hilbert(df).collect()} == {0}


def test_box_join_equals_brute_force(spark):
    a, left = random_boxes(spark, 150, 2)
    b, right = random_boxes(spark, 120, 3, size=40.0)
    right = right.select(F.col("fid").alias("other"), F.col("bbox").alias("bbox2"))
    got = sorted((r.fid, r.other) for r in J.box_join(left, right).select("fid", "other").collect())
    assert got == sorted((x[0], y[0]) for x in a for y in b if meets(x, y[1:]))
    assert len(got) == len(set(got))
    joined = J.box_join(left, right)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in joined and "Cartesian" not in joined


def test_box_join_of_very_different_sizes(spark):
    a, left = random_boxes(spark, 60, 4, size=0.01)
    b, right = random_boxes(spark, 20, 5, size=5.0)
    world = (99, -1000.0, -1000.0, 1000.0, 1000.0)
    right = right.union(spark.createDataFrame([world], "fid long, a double, b double, c double, d double").select("fid", B.make("a", "b", "c", "d").alias("bbox")))
    right = right.select(F.col("fid").alias("other"), F.col("bbox").alias("bbox2"))
    got = sorted((r.fid, r.other) for r in J.box_join(left, right).select("fid", "other").collect())
    assert got == sorted((x[0], y[0]) for x in a for y in [*b, world] if meets(x, y[1:]))


def test_box_join_with_bad_boxes(spark):
    _, left = random_boxes(spark, 5)
    nan = spark.createDataFrame([(1, float("nan")), (2, None)], "other int, v double").select("other", B.make("v", "v", "v", "v").alias("bbox2"))
    assert J.box_join(left, nan).count() == 0


def test_tiles(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0), (2, -180.0, 85.0)], "fid int, x double, y double").select("fid", B.of_point("x", "y").alias("bbox"))
    got = {(r.fid, r.tile) for r in J.tiles_of(df, 1).collect()}
    assert (2, "1/0/0") in got and any(t[0] == 1 for t in got)
    assert J.load_tile(df, 0, 0, 0).count() == 2


def test_windows(spark):
    df = spark.createDataFrame([(0, 10), (1, 20), (2, 30)], "pos int, size int")
    off = N.offsets(df, ["pos"])
    assert [r.offset for r in off.orderBy("pos").collect()] == [0, 10, 30]
    assert [r.length for r in N.lengths(off).orderBy("pos").collect()] == [10, 20, None]


def test_wide_windows_equal_plain_ones(spark):
    r = random.Random(7)
    df = spark.createDataFrame([(i, r.randrange(1, 400)) for i in range(300)], "pos long, size long").repartition(3)
    key = lambda d, *c: sorted(tuple(x) for x in d.select(*c).collect())
    assert key(N.offsets_wide(df, ["pos"]), "pos", "offset") == key(N.offsets(df, ["pos"]), "pos", "offset")
    laid = N.offsets(df, ["pos"])
    assert key(N.lengths_wide(laid).fillna(-1), "pos", "length") == key(N.lengths(laid).fillna(-1), "pos", "length")
    some = N.lengths(laid).where("pos % 3 = 0")
    assert key(N.batched_wide(some, gap=300), "pos", "batch") == key(N.batched(some, gap=300), "pos", "batch")
    for wide in (N.offsets_wide(df.limit(0), ["pos"]), N.lengths_wide(laid.limit(0)), N.batched_wide(some.limit(0))):
        assert wide.count() == 0


def test_batches_split_only_beyond_the_gap(spark):
    df = spark.createDataFrame([(0, 10), (20, 10), (41, 10), (100, None)], "offset long, length long")
    got = N.batches(df, gap=10).orderBy("batch").collect()
    assert [(r.start, r.end, r.ranges, r.wasted) for r in got] == [(0, 30, 2, 10), (41, 51, 1, 0), (100, 104, 1, 0)]
    with pytest.raises(ValueError, match="gap"):
        N.batched(df, gap=-1)


def test_lifecycle(spark):
    data, df = random_boxes(spark, 20)
    assert L.count(df).first()[0] == 20
    assert [r.fid for r in L.skip(df, 17).collect()] == [17, 18, 19]
    assert L.skip(df, -3).count() == 20 and L.skip(df, 99).count() == 0
    assert L.nth(df, 4).count() == 1 and L.nth(df, 99).count() == 0
    assert [r.fid for r in L.first(df, 2).collect()] == [0, 1]
    assert {r.fid for r in X.lookup(df, [3, 5], 20).collect()} == {3, 5}
    with pytest.raises(IndexError):
        X.lookup(df, [20], 20)
    h = L.header(df.withColumn("name", F.lit("x"))).first()
    assert h.features_count == 20 and [c.name for c in h["columns"]] == ["name"] and h["columns"][0].type == 11
    assert L.header(df.limit(0)).first().envelope is None


def test_properties_leave_nulls_out(spark):
    df = spark.createDataFrame([(1, "a", None), (2, None, 3)], "fid int, s string, n int")
    assert [r.m for r in df.select(L.properties(df).alias("m")).collect()] == [{"s": "a"}, {"n": "3"}]


def test_cut_tables_are_swept(spark):
    from geotable.operators import storage

    df = storage.cut(spark.range(5).toDF("id"))
    assert df.count() == 5
    path = storage._written[-1].removeprefix("file://")
    assert os.path.isdir(path)
    storage.sweep(spark)
    assert not os.path.exists(path) and storage._written == []


def test_box_join_spreads_pairs_of_crowded_places(spark, monkeypatch):
    """Rows are few, pairs many: tasks are as many as the pairs ask for, also where all are in one place."""
    spot = spark.range(600).select(F.col("id").alias("fid"), B.make(F.col("id") % 3, F.lit(0), F.col("id") % 3 + 1.5, F.lit(1)).alias("bbox"))
    _, more = random_boxes(spark, 100, 6)
    left = spot.union(more.select((F.col("fid") + 1000).alias("fid"), "bbox"))
    right = left.select(F.col("fid").alias("other"), F.col("bbox").alias("bbox2"))
    rows = [(r.fid, tuple(r.bbox)) for r in left.collect()]
    want = sorted((i, j) for i, x in rows for j, y in rows if meets((i, *x), y))
    monkeypatch.setattr(J, "SIDE", 20)
    monkeypatch.setattr(J, "FEW", 400)
    for crowded in (J.CROWDED, 0):
        monkeypatch.setattr(J, "CROWDED", crowded)
        joined = J.box_join(left, right).select("fid", "other")
        assert sorted((r.fid, r.other) for r in joined.collect()) == want
    per_task = joined.groupBy(F.spark_partition_id().alias("p")).count().agg(F.max("count"), F.count(F.lit(1))).first()
    assert per_task[1] > 100 and per_task[0] < len(want) / 20
