from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from geotable.functions import bbox as B
from geotable.functions import geometry as G
from geotable.functions import hilbert as H
from geotable.functions import wkb as W

CURVE = [(0, 0, 0), (1, 0, 1), (1, 1, 2), (0, 1, 3), (0, 65535, 1431655765), (65535, 65535, 2863311530), (65535, 0, 4294967295), (32767, 32767, 715827882)]
SHAPES = [
    '{"type":"Point","coordinates":[1.2,-2.1]}',
    '{"type":"Point","coordinates":[1,2,3]}',
    '{"type":"LineString","coordinates":[[1,2],[3,4.5]]}',
    '{"type":"Polygon","coordinates":[[[0,0],[10,0],[10,10],[0,0]],[[1,1],[2,1],[2,2],[1,1]]]}',
    '{"type":"MultiPoint","coordinates":[[1,2],[3,4]]}',
    '{"type":"MultiLineString","coordinates":[[[1,2],[3,4]],[[5,6],[7,8]]]}',
    '{"type":"MultiPolygon","coordinates":[[[[0,0],[1,0],[1,1],[0,0]]],[[[5,5],[6,5],[6,6],[5,5]],[[5,5],[5.5,5],[5.5,5.5],[5,5]]]]}',
    '{"type":"GeometryCollection","geometries":[{"type":"Point","coordinates":[1,2]},{"type":"LineString","coordinates":[[1,2],[3,4]]}]}',
    '{"type":"GeometryCollection","geometries":[{"type":"MultiPolygon","coordinates":[[[[0,0],[1,0],[1,1],[0,0]]],[[[5,5],[6,5],[6,6],[5,5]]]]},{"type":"Point","coordinates":[1,2]},{"type":"GeometryCollection","geometries":[{"type":"Point","coordinates":[3,4]},{"type":"LineString","coordinates":[[1,2],[3,4]]}]}]}',
]


def rows(spark, data, schema):
    return spark.createDataFrame(data, schema)


def test_curve_vectors(spark):
    df = rows(spark, CURVE, "x int, y int, h long")
    assert df.where(H.index(F.col("x"), F.col("y")) != F.col("h")).count() == 0
    assert all(H.scalar(x, y) == h for x, y, h in CURVE)


def test_curve_is_one_to_one_and_connected(spark):
    got = spark.range(64 * 64).select((F.col("id") % 64).cast("int").alias("x"), F.floor(F.col("id") / 64).cast("int").alias("y"))
    cells = {r.h: (r.x, r.y) for r in got.withColumn("h", H.index(F.col("x"), F.col("y"))).collect()}
    assert sorted(cells) == list(range(64 * 64))
    assert all(abs(cells[i][0] - cells[i + 1][0]) + abs(cells[i][1] - cells[i + 1][1]) == 1 for i in range(64 * 64 - 1))


def test_touching_nan_and_null_boxes(spark):
    nan = float("nan")
    df = rows(spark, [(1, 0.0, 0.0, 1.0, 1.0), (2, 1.0, 1.0, 2.0, 2.0), (3, nan, 0.0, nan, 1.0), (4, 2.5, 2.5, 3.0, 3.0), (5, 0.0, nan, 1.0, nan)], "i int, a double, b double, c double, d double")
    df = df.withColumn("bbox", B.make("a", "b", "c", "d"))
    df = df.unionByName(df.where("i = 1").withColumns({"i": F.lit(6), "bbox": F.lit(None).cast(B.TYPE)}))
    assert {r.i for r in B.filter_rect(df, (1.0, 1.0, 1.0, 1.0)).collect()} == {1, 2}
    assert {r.i for r in B.filter_rect(df, (-9.0, -9.0, 9.0, 9.0)).collect()} == {1, 2, 4}
    assert tuple(B.extent(df).first()) == (0.0, 0.0, 3.0, 3.0)


def test_empty_box_expands_to_the_other(spark):
    df = spark.range(1).select(B.expand(B.empty(), B.make(F.lit(1), F.lit(2), F.lit(3), F.lit(4))).alias("b"), B.empty().alias("e"))
    assert tuple(df.first().b) == (1.0, 2.0, 3.0, 4.0)
    assert df.where(B.intersects("e", (-1e9, -1e9, 1e9, 1e9))).count() == 0


def test_box_filter_reaches_parquet(spark, tmp_path):
    spark.range(100).select("id", B.of_point("id", "id").alias("bbox")).write.parquet(str(tmp_path / "p"))
    df = B.filter_rect(spark.read.parquet(str(tmp_path / "p")), (1.0, 1.0, 5.0, 5.0)).select("id")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(bbox.minx)" in plan and "bbox.minx" in plan
    assert df.count() == 5


def test_geojson_there_and_back(spark):
    df = rows(spark, [(s,) for s in SHAPES], "j string").withColumn("g", G.from_geojson("j"))
    assert all(r.j == r.o for r in df.select("j", G.to_geojson("g").alias("o")).collect())
    bad = rows(spark, [(None,), ("no json",), ('{"type":"Cube","coordinates":[]}',)], "j string").select(G.from_geojson("j").alias("g"))
    assert all(r.g is None for r in bad.collect())


def test_wkt(spark):
    df = rows(spark, [(s,) for s in SHAPES], "j string").withColumn("g", G.from_geojson("j"))
    got = [r.w for r in df.select(G.to_wkt("g").alias("w")).collect()]
    assert got == [
        "POINT (1.2 -2.1)",
        "POINT Z (1 2 3)",
        "LINESTRING (1 2, 3 4.5)",
        "POLYGON ((0 0, 10 0, 10 10, 0 0), (1 1, 2 1, 2 2, 1 1))",
        "MULTIPOINT (1 2, 3 4)",
        "MULTILINESTRING ((1 2, 3 4), (5 6, 7 8))",
        "MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)), ((5 5, 6 5, 6 6, 5 5), (5 5, 5.5 5, 5.5 5.5, 5 5)))",
        "GEOMETRYCOLLECTION (POINT (1 2), LINESTRING (1 2, 3 4))",
        "GEOMETRYCOLLECTION (MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)), ((5 5, 6 5, 6 6, 5 5))), POINT (1 2), GEOMETRYCOLLECTION (POINT (3 4), LINESTRING (1 2, 3 4)))",
    ]
    promoted = [r.w for r in df.select(G.to_wkt(G.promoted("g")).alias("w")).collect()]
    assert promoted[2:4] == ["MULTILINESTRING ((1 2, 3 4.5))", "MULTIPOLYGON (((0 0, 10 0, 10 10, 0 0), (1 1, 2 1, 2 2, 1 1)))"]
    assert promoted[:2] == got[:2] and promoted[4:] == got[4:]


def test_wkb_there_and_back(spark):
    df = rows(spark, [(s,) for s in SHAPES] + [(None,)], "j string").withColumn("g", G.from_geojson("j"))
    back = W.with_geometry(W.with_wkb(df, "g"), "wkb", "h").select("j", "wkb", G.to_geojson("h").alias("o")).collect()
    assert all(r.j == r.o for r in back)
    assert [r.wkb is None for r in back] == [False] * len(SHAPES) + [True]
    big_endian = bytes.fromhex("00000000013ff00000000000004000000000000000")
    odd = W.with_geometry(rows(spark, [(big_endian,), (b"\x01\x02",), (None,)], "w binary"), "w", "w").select(G.to_wkt("w").alias("t")).collect()
    assert [r.t for r in odd] == ["POINT (1 2)", None, None]


def test_accessors(spark):
    df = rows(spark, [(i, s) for i, s in enumerate(SHAPES)], "i int, j string").withColumn("g", G.from_geojson("j"))
    poly = df.where("i = 3")
    r = poly.select(G.n_interiors("g").alias("n"), G.exterior("g").alias("e"), G.interior_n("g", 0).alias("h"), G.n_points("g").alias("p")).first()
    assert (r.n, len(r.e), len(r.h), r.p) == (1, 4, 4, 8)
    r = df.where("i = 6").select(G.to_wkt(G.polygon_n("g", 0)).alias("a"), G.n_parts("g").alias("n"), G.to_wkt(G.geometry_n("g", 1)).alias("b")).first()
    assert (r.a, r.n, r.b) == ("POLYGON ((0 0, 1 0, 1 1, 0 0))", 2, "POLYGON ((5 5, 6 5, 6 6, 5 5), (5 5, 5.5 5, 5.5 5.5, 5 5))")
    r = df.where("i = 7").select(G.to_wkt(G.geometry_n("g", 0)).alias("a"), G.geometry_n("g", 9).alias("b")).first()
    assert (r.a, r.b) == ("POINT (1 2)", None)
    r = df.where("i = 1").select(G.x("g").alias("x"), G.y("g").alias("y"), G.z("g").alias("z"), G.m("g").alias("m"), G.has_z("g").alias("h"), G.coord_dim("g").alias("d"), G.max_z("g").alias("mz")).first()
    assert tuple(r) == (1.0, 2.0, 3.0, None, True, 3, 3.0)


def test_ends(spark):
    part = lambda ends: G.part(G.POLYGON, F.array(*[F.lit(float(i)) for i in range(4)]), F.array(*map(F.lit, ends)) if ends else None)
    got = spark.range(1).select(*[G.ends_valid(part(e)).alias(f"c{i}") for i, e in enumerate([[], [1, 2], [2, 1], [3, 4]])]).first()
    assert tuple(got) == (True, True, False, False)
    got = spark.range(1).select(G.ends_of(F.array(F.lit(4), F.lit(5))).alias("a"), G.ends_of(F.array(F.lit(4))).alias("b")).first()
    assert (got.a, got.b) == ([4, 9], None)


def test_interleaving(spark):
    xy, z = F.array(*[F.lit(float(v)) for v in (1, 2, 3, 4)]), F.array(F.lit(9.0), F.lit(8.0))
    got = spark.range(1).select(G.interleaved(xy, z).alias("f"), G.deinterleaved(G.interleaved(xy, z), 3).alias("s")).first()
    assert got.f == [1, 2, 9, 3, 4, 8] and (got.s.xy, got.s.z, got.s.m) == ([1, 2, 3, 4], [9, 8], None)


def test_mercator(spark):
    x, y = G.project_xy(10.0, 50.0, 4326, 3857)
    assert math.isclose(x, 1113194.9079327357) and math.isclose(y, 6446275.841017161, rel_tol=1e-9)
    got = spark.range(1).select(G.projected(G.point(F.lit(10.0), F.lit(50.0)), 4326, 3857).alias("g")).select(G.x("g").alias("x"), G.y("g").alias("y")).first()
    assert math.isclose(got.x, x) and math.isclose(got.y, y)
    with pytest.raises(ValueError, match="no transformation"):
        G.project_xy(0, 0, 4326, 25832)


def test_types(spark):
    got = spark.range(18).select(G.type_code(G.type_name("id")).alias("c"), F.col("id")).collect()
    assert all(r.c == r.id for r in got)
    one = spark.createDataFrame([(2,), (2,)], "t tinyint").agg(G.common_type("t").alias("t")).first().t
    two = spark.createDataFrame([(2,), (3,)], "t tinyint").agg(G.common_type("t").alias("t")).first().t
    assert (one, two) == (2, 0)
    r = spark.range(1).select(G.resolved_type(0, F.lit(3)).alias("a"), G.resolved_type(6, F.lit(3)).alias("b"), G.is_collection(F.lit(6)).alias("c"), G.is_collection(F.lit(5)).alias("d")).first()
    assert tuple(r) == (3, 6, True, False)


def test_svg(spark):
    got = spark.range(1).select(G.to_svg(G.from_geojson(F.lit(SHAPES[2])), invert_y=True).alias("s")).first().s
    assert got == '<path d="M 1 -2 L 3 -4.5"/>'


def test_views_of_text(spark):
    from geotable.functions import attributes as A

    df = rows(spark, [('{"a": {"b": 5}}', "2020-02-29T12:34:56Z"), ("X", "no time"), (None, None)], "j string, t string")
    got = df.select(A.json_value("j", "$.a.b", "int").alias("v"), A.time_text(A.time_view("t")).alias("t"), A.json_view("j").isNull().alias("n")).collect()
    assert [tuple(r) for r in got] == [(5, "2020-02-29T12:34:56.000000Z", False), (None, None, True), (None, None, True)]
