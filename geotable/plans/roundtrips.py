"""Queries that write files of a format in the shared folder, read them back, and say what a SQL twin says of the tables they came from."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geotable.functions import bbox as B
from geotable.functions import geometry as G
from geotable.functions import wkb as W
from geotable.operators import index as X
from geotable.operators import storage
from geotable.plans import catalog as C
from geotable.plans.catalog import RECT, SQL_RECT, query, sides, with_boxes, with_points
from geotable.sources import binary, geojson
from geotable.streaming import feeds

_ALL = "SELECT fid AS part, p_brand, p_size, minx, miny, maxx, maxy FROM boxes"
_WITHIN = f"SELECT fid AS part, p_brand FROM boxes WHERE {SQL_RECT}"


def somewhere(spark: SparkSession) -> str:
    """A new path in the shared folder, which sweep() deletes."""
    return storage.scratch(spark, "files")


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part, geometry (a rectangle), and attributes."""
    return C.boxes(spark, sf_dir).select(F.col("fid").alias("part"), G.of_box("bbox").alias("geometry"), "p_brand", "p_type", "p_size")


def stored(df: DataFrame, mode: str = "append", **options) -> str:
    path = somewhere(df.sparkSession)
    binary.write(df, path, mode, **options)
    return path


def whole(df: DataFrame) -> DataFrame:
    return df.select("part", "p_brand", "p_size", *sides())


@query("features_read", with_boxes(_ALL))
def features_read(spark, sf_dir):
    return whole(binary.read(spark, stored(features(spark, sf_dir))))


@query("features_read_in_many_tasks", with_boxes(_ALL))
def features_read_in_many_tasks(spark, sf_dir):
    return whole(binary.read(spark, stored(features(spark, sf_dir).coalesce(1)), split=8192))


@query("features_read_unindexed", with_boxes(_ALL))
def features_read_unindexed(spark, sf_dir):
    return whole(binary.read(spark, stored(features(spark, sf_dir).coalesce(1), index="false", count="false"), split=8192))


@query("features_rect", with_boxes(_WITHIN))
def features_rect(spark, sf_dir):
    return binary.read(spark, stored(features(spark, sf_dir)), RECT).select("part", "p_brand")


@query("features_rect_unindexed", with_boxes(_WITHIN))
def features_rect_unindexed(spark, sf_dir):
    return binary.read(spark, stored(features(spark, sf_dir), index="false"), RECT).select("part", "p_brand")


@query("features_rect_wide_nodes", with_boxes(_WITHIN))
def features_rect_wide_nodes(spark, sf_dir):
    return binary.read(spark, stored(features(spark, sf_dir), node_size=4), RECT, gap=0).select("part", "p_brand")


@query("features_pushdown", with_boxes(_WITHIN))
def features_pushdown(spark, sf_dir):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return B.filter_rect(binary.read(spark, stored(features(spark, sf_dir)), pushdown="true"), RECT).select("part", "p_brand")


@query("features_columns", with_boxes("SELECT p_brand, COUNT(*) AS n, MIN(minx) AS minx FROM boxes GROUP BY p_brand"))
def features_columns(spark, sf_dir):
    df = binary.read(spark, stored(features(spark, sf_dir)), columns=["p_brand"], geometry="false")
    return df.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.min("bbox.minx").alias("minx"))


@query("features_ids", with_boxes("SELECT COUNT(*) AS n, COUNT(*) AS ids, CAST(0 AS BIGINT) AS least, COUNT(*) - 1 AS most FROM boxes"))
def features_ids(spark, sf_dir):
    df = binary.read(spark, stored(features(spark, sf_dir).repartition(3)))
    return df.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("fid").alias("ids"), F.min("fid").alias("least"), F.max("fid").alias("most"))


@query("features_ids_of_hits", with_boxes(f"SELECT fid AS part, TRUE AS same FROM boxes WHERE {SQL_RECT}"))
def features_ids_of_hits(spark, sf_dir):
    path = stored(features(spark, sf_dir).coalesce(1))
    hits = binary.read(spark, path, RECT, gap=0).select("part", F.col("fid").alias("hit"))
    return hits.join(binary.read(spark, path).select("part", "fid"), "part").select("part", (F.col("hit") == F.col("fid")).alias("same"))


@query("features_curve_order", with_boxes(f"SELECT fid AS part, ROW_NUMBER() OVER (ORDER BY hilbert DESC, fid) - 1 AS fid FROM ({C.hilbert_sql(C._PARTS)}) q"))
def features_curve_order(spark, sf_dir):
    rows = features(spark, sf_dir).coalesce(1).sortWithinPartitions("part")
    return binary.read(spark, stored(rows)).select("part", "fid")


@query(
    "features_header",
    with_boxes("SELECT 'parts' AS name, 'T' AS title, 3 AS geometry_type, COUNT(*) AS features_count, 16 AS index_node_size, 4 AS n_columns, 4326 AS code, MIN(minx) AS e0, MIN(miny) AS e1, MAX(maxx) AS e2, MAX(maxy) AS e3 FROM boxes"),
)
def features_header(spark, sf_dir):
    path = stored(features(spark, sf_dir).coalesce(1), name="parts", title="T", srid=4326)
    h = binary.read(spark, path, table="header")
    ends = [F.col("envelope")[i].alias(f"e{i}") for i in range(4)]
    return h.select("name", "title", F.col("geometry_type").cast("int"), F.col("features_count").cast("long"), "index_node_size", F.size("columns").alias("n_columns"), "crs.code", *ends)


@query("features_header_columns", "SELECT * FROM (VALUES (0, 'part', 7), (1, 'p_brand', 11), (2, 'p_type', 11), (3, 'p_size', 7)) t(place, name, type)")
def features_header_columns(spark, sf_dir):
    rows = features(spark, sf_dir).coalesce(1).withColumn("p_size", F.col("p_size").cast("long")).withColumn("part", F.col("part").cast("long"))
    c = binary.header_info(spark, stored(rows)).select(F.posexplode("columns").alias("place", "c"))
    return c.select("place", "c.name", F.col("c.type").cast("int").alias("type"))


@query("features_index", f"{C._nodes_sql()} SELECT CAST(level AS INTEGER) AS level, pos, minx, miny, maxx, maxy FROM al, top WHERE level <= top")
def features_index(spark, sf_dir):
    rows = features(spark, sf_dir).coalesce(1).sortWithinPartitions("part")
    return binary.read(spark, stored(rows), table="index").select("level", "pos", *sides())


@query("features_count", with_boxes("SELECT COUNT(*) AS stated, COUNT(*) AS walked FROM boxes"))
def features_count(spark, sf_dir):
    rows = features(spark, sf_dir)
    counts = [binary.count_features(spark, stored(rows)), binary.count_features(spark, stored(rows, index="false", count="false"))]
    return spark.createDataFrame([counts], "stated long, walked long")


@query("features_usage", with_boxes(f"SELECT CAST(1 AS BIGINT) AS open_requests, CAST(12944 AS BIGINT) AS open_bytes, TRUE AS few, COUNT(*) AS features FROM boxes WHERE {SQL_RECT}"))
def features_usage(spark, sf_dir):
    path = stored(features(spark, sf_dir).coalesce(1))
    used = binary.usage(binary.files_of(path)[0], RECT)
    hits = binary.read(spark, path, RECT).agg(F.count(F.lit(1)).alias("features"))
    few = used["requests"] <= 10 and 0 <= used["wasted"] <= used["bytes"]
    return hits.select(F.lit(used["open_requests"]).cast("long").alias("open_requests"), F.lit(used["open_bytes"]).cast("long").alias("open_bytes"), F.lit(few).alias("few"), "features")


@query("features_append", with_boxes("SELECT fid AS part, 2 AS times FROM boxes"))
def features_append(spark, sf_dir):
    path = stored(features(spark, sf_dir))
    binary.write(features(spark, sf_dir), path)
    return binary.read(spark, path).groupBy("part").agg(F.count(F.lit(1)).cast("int").alias("times"))


@query("features_overwrite", with_boxes("SELECT fid AS part, 1 AS times FROM boxes"))
def features_overwrite(spark, sf_dir):
    path = stored(features(spark, sf_dir))
    binary.write(features(spark, sf_dir), path, "overwrite")
    return binary.read(spark, path).groupBy("part").agg(F.count(F.lit(1)).cast("int").alias("times"))


@query("features_of_files", with_boxes("SELECT part_of, COUNT(*) AS n FROM (SELECT CASE WHEN p_size > 25 THEN 'large' ELSE 'small' END AS part_of FROM boxes) b GROUP BY part_of"))
def features_of_files(spark, sf_dir):
    rows = features(spark, sf_dir).withColumn("part_of", F.when(F.col("p_size") > 25, "large").otherwise("small"))
    path = stored(rows.where("p_size > 25"))
    binary.write(rows.where("p_size <= 25"), path)
    return binary.read(spark, path, columns=["part_of"], geometry="false").groupBy("part_of").agg(F.count(F.lit(1)).alias("n"))


@query("features_stream", with_boxes(_ALL))
def features_stream(spark, sf_dir):
    path, sink = stored(features(spark, sf_dir)), somewhere(spark)
    feeds.run_once(feeds.read_stream(spark, path), f"{sink}/out", f"{sink}/check").awaitTermination()
    return whole(spark.read.parquet(f"{sink}/out"))


@query("features_lines", f"SELECT fid AS line, 'LINESTRING (' || {C._WKT_LIST} || ')' AS wkt FROM ({C._LINE_POINTS}) p GROUP BY fid")
def features_lines(spark, sf_dir):
    rows = C.lines(spark, sf_dir).select(F.col("fid").alias("line"), "geometry")
    return binary.read(spark, stored(rows)).select("line", G.to_wkt("geometry").alias("wkt"))


@query("features_promoted", f"SELECT fid AS line, 'MULTILINESTRING ((' || {C._WKT_LIST} || '))' AS wkt FROM ({C._LINE_POINTS}) p GROUP BY fid")
def features_promoted(spark, sf_dir):
    rows = C.lines(spark, sf_dir).select(F.col("fid").alias("line"), "geometry")
    return binary.read(spark, stored(rows, promote_to_multi="true")).select("line", G.to_wkt("geometry").alias("wkt"))


@query("features_with_z", f"SELECT fid AS line, CAST(COUNT(*) AS DOUBLE) AS z, TRUE AS has_z, COUNT(*) AS n FROM ({C._LINE_POINTS}) p GROUP BY fid")
def features_with_z(spark, sf_dir):
    xy = F.get("geometry.parts", F.lit(0))["xy"]
    z = F.transform(F.sequence(F.lit(1), G.points_in(xy)), lambda i: i.cast("double"))
    rows = C.lines(spark, sf_dir).select(F.col("fid").alias("line"), G.simple(G.LINE, xy, z=z).alias("geometry"))
    return binary.read(spark, stored(rows)).select("line", G.max_z("geometry").alias("z"), G.has_z("geometry").alias("has_z"), G.n_points("geometry").cast("long").alias("n"))


@query("features_points", with_points("SELECT fid AS customer, x, y, c_mktsegment, c_nationkey FROM points"))
def features_points(spark, sf_dir):
    rows = C.points(spark, sf_dir).select(F.col("fid").alias("customer"), G.point("x", "y").alias("geometry"), "c_mktsegment", "c_nationkey")
    return binary.read(spark, stored(rows)).select("customer", G.x("geometry").alias("x"), G.y("geometry").alias("y"), "c_mktsegment", "c_nationkey")


@query(
    "features_attributes",
    with_points(
        """SELECT fid AS customer, CAST(fid % 100 AS TINYINT) AS b, CAST(fid % 30000 AS SMALLINT) AS s, CAST(fid AS INTEGER) AS i, CAST(fid AS BIGINT) * 4294967296 AS l, CAST(fid % 64 AS FLOAT) / 2 AS f,
        x AS d, fid % 2 = 0 AS yes, c_mktsegment AS t, upper(to_hex(CAST(fid AS BIGINT))) AS raw FROM points"""
    ),
)
def features_attributes(spark, sf_dir):
    p, k = C.points(spark, sf_dir), F.col("fid")
    rows = p.select(
        k.alias("customer"), G.point("x", "y").alias("geometry"), (k % 100).cast("tinyint").alias("b"), (k % 30000).cast("smallint").alias("s"), k.cast("int").alias("i"), (k.cast("long") * 4294967296).alias("l"),
        ((k % 64).cast("float") / F.lit(2).cast("float")).cast("float").alias("f"), F.col("x").alias("d"), (k % 2 == 0).alias("yes"), F.col("c_mktsegment").alias("t"), F.encode(F.hex(k.cast("long")), "UTF-8").alias("raw"),
    )
    return binary.read(spark, stored(rows)).select("customer", "b", "s", "i", "l", "f", "d", "yes", "t", F.decode("raw", "UTF-8").alias("raw"))


@query("features_nulls", with_boxes("SELECT fid AS part, CASE WHEN fid % 3 = 0 THEN NULL ELSE p_brand END AS p_brand, CASE WHEN fid % 5 = 0 THEN NULL ELSE minx END AS minx, fid % 5 = 0 AS no_geometry FROM boxes"))
def features_nulls(spark, sf_dir):
    rows = features(spark, sf_dir).withColumn("geometry", F.when(F.col("part") % 5 != 0, F.col("geometry"))).withColumn("p_brand", F.when(F.col("part") % 3 != 0, F.col("p_brand")))
    return binary.read(spark, stored(rows)).select("part", "p_brand", F.col("bbox.minx").alias("minx"), F.col("geometry").isNull().alias("no_geometry"))


@query("geojson_lines_file", with_boxes(_ALL))
def geojson_lines_file(spark, sf_dir):
    path = somewhere(spark)
    geojson.write(features(spark, sf_dir), path)
    return whole(geojson.read(spark, path, "part bigint, p_brand string, p_size int", lines=True))


@query("geojson_collection_file", with_boxes("SELECT fid AS part, ROW_NUMBER() OVER (ORDER BY fid) - 1 AS fid, minx, miny, maxx, maxy FROM boxes"))
def geojson_collection_file(spark, sf_dir):
    path = somewhere(spark)
    geojson.write(features(spark, sf_dir).coalesce(1).sortWithinPartitions("part").select("part", "geometry"), path, lines=False)
    return geojson.read(spark, path, "part bigint").select("part", "fid", *sides())


@query("wkb_roundtrip", f"SELECT fid, 'LINESTRING (' || {C._WKT_LIST} || ')' AS wkt FROM ({C._LINE_POINTS}) p GROUP BY fid")
def wkb_roundtrip(spark, sf_dir):
    there = W.with_wkb(C.lines(spark, sf_dir)).select("fid", "wkb")
    return W.with_geometry(there).select("fid", G.to_wkt("geometry").alias("wkt"))


@query("clustered_parquet", with_boxes(f"SELECT fid, p_brand FROM boxes WHERE {SQL_RECT}"))
def clustered_parquet(spark, sf_dir):
    path = somewhere(spark)
    X.clustered(C.boxes(spark, sf_dir), 4).write.parquet(path)
    return B.filter_rect(spark.read.parquet(path), RECT).select("fid", "p_brand")
