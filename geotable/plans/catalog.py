"""Registered queries and their SQL twins, over fixtures derived from the driver's tables.

Each query is a plain composition of the library's operators; each SQL text says the same in ANSI SQL
without them (the curve's index, for instance, is computed bit by bit).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geotable.functions import bbox as B
from geotable.functions import geometry as G
from geotable.operators import index as X
from geotable.operators import lifecycle as L
from geotable.operators import spatial_join as J
from geotable.operators import windows as N

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

RECT = (-20.0, 0.0, 60.0, 50.0)
SQL_RECT = "minx <= 60 AND maxx >= -20 AND miny <= 50 AND maxy >= 0"

_BOX = """SELECT p_partkey AS fid, p_brand, p_type, p_size,
  CAST((p_partkey*7919)%36000 AS DOUBLE)/100-180 AS minx, CAST((p_partkey*10473)%18000 AS DOUBLE)/100-90 AS miny,
  CAST((p_partkey*7919)%36000 AS DOUBLE)/100-180 + CAST(p_size AS DOUBLE)/10 AS maxx,
  CAST((p_partkey*10473)%18000 AS DOUBLE)/100-90 + p_retailprice/1000 AS maxy FROM part"""
_POINT = """SELECT c_custkey AS fid, c_mktsegment, c_nationkey, c_acctbal,
  CAST((c_custkey*7919)%36000 AS DOUBLE)/100-180 AS x, CAST((c_custkey*10473)%18000 AS DOUBLE)/100-90 AS y FROM customer"""
_PARTS = "SELECT fid, minx, miny, maxx, maxy FROM boxes"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fid, bbox, p_brand, p_type, p_size."""
    p = table(spark, sf_dir, "part")
    x = ((F.col("p_partkey") * 7919) % 36000).cast("double") / 100 - 180
    y = ((F.col("p_partkey") * 10473) % 18000).cast("double") / 100 - 90
    box = B.make(x, y, x + F.col("p_size").cast("double") / 10, y + F.col("p_retailprice") / 1000)
    return p.select(F.col("p_partkey").alias("fid"), box.alias("bbox"), "p_brand", "p_type", "p_size")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fid, bbox (of zero size), x, y and attributes."""
    c = table(spark, sf_dir, "customer")
    x = ((F.col("c_custkey") * 7919) % 36000).cast("double") / 100 - 180
    y = ((F.col("c_custkey") * 10473) % 18000).cast("double") / 100 - 90
    return c.select(F.col("c_custkey").alias("fid"), x.alias("x"), y.alias("y"), B.of_point(x, y).alias("bbox"), "c_mktsegment", "c_nationkey", "c_acctbal")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fid, geometry: one line per order through whole-number points, in order of line number."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    vertex = F.struct("l_linenumber", "l_partkey", ((F.col("l_partkey") * 7919) % 360 - 180).cast("double").alias("x"), ((F.col("l_suppkey") * 10473) % 180 - 90).cast("double").alias("y"))
    # an order has a few lines, so a group is small
    grouped = li.groupBy(F.col("l_orderkey").alias("fid")).agg(F.array_sort(F.collect_list(vertex)).alias("v"))
    return grouped.select("fid", G.simple(G.LINE, F.flatten(F.transform("v", lambda v: F.array(v["x"], v["y"])))).alias("geometry"))


_LINE_POINTS = """SELECT l_orderkey AS fid, l_linenumber, l_partkey, CAST((l_partkey*7919)%360 - 180 AS DOUBLE) AS x, CAST((l_suppkey*10473)%180 - 90 AS DOUBLE) AS y FROM lineitem"""


def with_boxes(sql: str) -> str:
    return f"WITH boxes AS ({_BOX}) {sql}"


def with_points(sql: str) -> str:
    return f"WITH points AS ({_POINT}) {sql}"


def hilbert_sql(source: str) -> str:
    """SQL for (fid, minx, miny, maxx, maxy, hilbert) of `source`, step by step through the bits."""
    q = f"""SELECT b.*, e.* FROM ({source}) b CROSS JOIN (SELECT MIN(minx) AS ex, MIN(miny) AS ey, MAX(maxx)-MIN(minx) AS ew, MAX(maxy)-MIN(miny) AS eh FROM ({source}) s) e"""
    q = f"""SELECT fid, minx, miny, maxx, maxy,
      CASE WHEN ew = 0 THEN 0 ELSE CAST(FLOOR(65535 * ((minx+maxx)/2 - ex) / ew) AS BIGINT) END AS hx,
      CASE WHEN eh = 0 THEN 0 ELSE CAST(FLOOR(65535 * ((miny+maxy)/2 - ey) / eh) AS BIGINT) END AS hy, CAST(0 AS BIGINT) AS d FROM ({q}) c"""
    for level in range(15, -1, -1):
        s = 1 << level
        # rx, ry: the bits of this level; the lower bits are turned as the quadrant asks
        q = f"SELECT fid, minx, miny, maxx, maxy, hx, hy, d, (hx // {s}) % 2 AS rx, (hy // {s}) % 2 AS ry FROM ({q}) t{level}"
        q = f"""SELECT fid, minx, miny, maxx, maxy, d + CAST({s * s} AS BIGINT) * (CASE WHEN rx = 1 THEN 3 - ry ELSE ry END) AS d,
          CASE WHEN ry = 0 THEN CASE WHEN rx = 1 THEN {s - 1} - hy % {s} ELSE hy % {s} END ELSE hx % {s} END AS hx,
          CASE WHEN ry = 0 THEN CASE WHEN rx = 1 THEN {s - 1} - hx % {s} ELSE hx % {s} END ELSE hy % {s} END AS hy FROM ({q}) u{level}"""
    return f"SELECT fid, minx, miny, maxx, maxy, d AS hilbert FROM ({q}) h"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add



def sides() -> list:
    return [F.col("bbox")[s].alias(s) for s in B.SIDES]


# -- filters and extents -------------------------------------------------------------------------


@query("bbox_filter", with_boxes(f"SELECT fid, minx, miny, maxx, maxy FROM boxes WHERE {SQL_RECT}"))
def bbox_filter(spark, sf_dir):
    return B.filter_rect(boxes(spark, sf_dir), RECT).select("fid", *sides())


@query("bbox_extent", with_boxes(f"SELECT COUNT(*) AS n, MIN(minx) AS minx, MIN(miny) AS miny, MAX(maxx) AS maxx, MAX(maxy) AS maxy FROM boxes WHERE {SQL_RECT}"))
def bbox_extent(spark, sf_dir):
    return B.filter_rect(boxes(spark, sf_dir), RECT).agg(F.count(F.lit(1)).alias("n"), *B.extent_columns("bbox"))


@query("bbox_filter_points", with_points("SELECT fid, x, y FROM points WHERE x BETWEEN -20 AND 60 AND y BETWEEN 0 AND 50"))
def bbox_filter_points(spark, sf_dir):
    return B.filter_rect(points(spark, sf_dir), RECT).select("fid", "x", "y")


@query("point_query", with_boxes("SELECT fid FROM boxes WHERE minx <= 12 AND maxx >= 12 AND miny <= 20 AND maxy >= 20"))
def point_query(spark, sf_dir):
    return B.filter_rect(boxes(spark, sf_dir), (12.0, 20.0, 12.0, 20.0)).select("fid")


@query("touching_edges", with_points("SELECT COUNT(*) AS n FROM points WHERE x BETWEEN -100.81 AND 0 AND y BETWEEN 14.73 AND 30"))
def touching_edges(spark, sf_dir):
    return L.count(points(spark, sf_dir), (-100.81, 14.73, 0.0, 30.0)).select(F.col("features_count").alias("n"))


@query("ordered_search", with_boxes(f"SELECT fid, ROW_NUMBER() OVER (ORDER BY fid) AS place FROM boxes WHERE {SQL_RECT}"))
def ordered_search(spark, sf_dir):
    hits = X.global_rank(B.filter_rect(boxes(spark, sf_dir), RECT).select("fid"), [F.col("fid")], "place")
    return hits.select("fid", (F.col("place") + 1).alias("place"))


@query("attribute_filter", "SELECT c_custkey AS fid, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 0")
def attribute_filter(spark, sf_dir):
    return points(spark, sf_dir).where((F.col("c_mktsegment") == "BUILDING") & (F.col("c_acctbal") > 0)).select("fid", "c_acctbal")


@query("attribute_find", "SELECT c_custkey AS fid FROM customer WHERE c_nationkey = 7 ORDER BY c_custkey LIMIT 1")
def attribute_find(spark, sf_dir):
    return points(spark, sf_dir).where("c_nationkey = 7").select("fid").orderBy("fid").limit(1)


@query("property_map", "SELECT p_partkey AS fid, p_brand AS brand, CAST(p_size AS VARCHAR) AS size, 3 AS n FROM part")
def property_map(spark, sf_dir):
    b = boxes(spark, sf_dir)
    return b.select("fid", L.properties(b).alias("m")).select("fid", F.col("m")["p_brand"].alias("brand"), F.col("m")["p_size"].alias("size"), F.size("m").alias("n"))


@query("vector_filter", "SELECT vec_id AS fid FROM embeddings WHERE CAST(embedding[1] AS DOUBLE) BETWEEN -0.05 AND 0.05 AND CAST(embedding[2] AS DOUBLE) BETWEEN -0.05 AND 0.1")
def vector_filter(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    box = B.of_point(F.get("embedding", F.lit(0)), F.get("embedding", F.lit(1)))
    return B.filter_rect(e.select(F.col("vec_id").alias("fid"), box.alias("bbox")), (-0.05, -0.05, 0.05, 0.1)).select("fid")


@query("extent", with_boxes("SELECT MIN(minx) AS minx, MIN(miny) AS miny, MAX(maxx) AS maxx, MAX(maxy) AS maxy FROM boxes"))
def extent(spark, sf_dir):
    return B.extent(boxes(spark, sf_dir))


@query("extent_by_group", with_boxes("SELECT p_brand, MIN(minx) AS minx, MIN(miny) AS miny, MAX(maxx) AS maxx, MAX(maxy) AS maxy FROM boxes GROUP BY p_brand"))
def extent_by_group(spark, sf_dir):
    return boxes(spark, sf_dir).groupBy("p_brand").agg(*B.extent_columns("bbox"))


@query("box_measures", with_boxes("SELECT fid, maxx-minx AS width, maxy-miny AS height, (minx+maxx)/2 AS cx, (miny+maxy)/2 AS cy FROM boxes"))
def box_measures(spark, sf_dir):
    return boxes(spark, sf_dir).select("fid", B.width("bbox").alias("width"), B.height("bbox").alias("height"), B.centre_x("bbox").alias("cx"), B.centre_y("bbox").alias("cy"))


@query("box_expand", with_boxes("SELECT fid, LEAST(minx, 0) AS minx, LEAST(miny, 0) AS miny, GREATEST(maxx, 0) AS maxx, GREATEST(maxy, 0) AS maxy FROM boxes"))
def box_expand(spark, sf_dir):
    return boxes(spark, sf_dir).select("fid", B.expand_point("bbox", F.lit(0), F.lit(0)).alias("bbox")).select("fid", *sides())


@query("invalid_boxes", with_boxes("SELECT COUNT(*) AS n FROM boxes WHERE fid % 7 NOT IN (0, 1) AND minx <= 60 AND maxx >= -20 AND miny <= 50 AND maxy >= 0"))
def invalid_boxes(spark, sf_dir):
    nan = B.make(F.lit(float("nan")), F.lit(0.0), F.lit(float("nan")), F.lit(1.0))
    box = F.when(F.col("fid") % 7 == 0, F.lit(None)).when(F.col("fid") % 7 == 1, nan).otherwise(F.col("bbox"))
    return B.filter_rect(boxes(spark, sf_dir).withColumn("bbox", box), RECT).agg(F.count(F.lit(1)).alias("n"))


# -- curve and index -----------------------------------------------------------------------------


@query("hilbert_index", with_boxes(f"SELECT fid, hilbert FROM ({hilbert_sql(_PARTS)}) q"))
def hilbert_index(spark, sf_dir):
    return X.with_hilbert(boxes(spark, sf_dir)).select("fid", "hilbert")


@query("hilbert_sort", with_boxes(f"SELECT fid, hilbert, ROW_NUMBER() OVER (ORDER BY hilbert DESC, fid) - 1 AS pos FROM ({hilbert_sql(_PARTS)}) q"))
def hilbert_sort(spark, sf_dir):
    return X.leaves(boxes(spark, sf_dir)).select("fid", "hilbert", "pos")


@query("hilbert_sort_ascending", with_boxes(f"SELECT fid, hilbert, ROW_NUMBER() OVER (ORDER BY hilbert, fid) - 1 AS pos FROM ({hilbert_sql(_PARTS)}) q"))
def hilbert_sort_ascending(spark, sf_dir):
    return X.global_rank(X.with_hilbert(boxes(spark, sf_dir)), [F.col("hilbert"), F.col("fid")], "pos").select("fid", "hilbert", "pos")


@query("level_bounds", "SELECT * FROM (VALUES (0, CAST(3 AS BIGINT), CAST(23 AS BIGINT)), (1, 1, 3), (2, 0, 1)) t(level, lo, hi)")
def level_bounds(spark, sf_dir):
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(X.level_bounds(20))], "level int, lo long, hi long")


@query("tree_size", "SELECT * FROM (VALUES (CAST(1000 AS BIGINT), CAST(42720 AS BIGINT)), (97894767, 4176843520), (0, 0)) t(n, bytes)")
def tree_size(spark, sf_dir):
    return spark.createDataFrame([(n, X.tree_bytes(n)) for n in (1000, 97894767, 0)], "n long, bytes long")


def _nodes_sql() -> str:
    leaf = f"SELECT 0 AS level, ROW_NUMBER() OVER (ORDER BY hilbert DESC, fid) - 1 AS pos, minx, miny, maxx, maxy, fid AS first_child FROM ({hilbert_sql(_PARTS)}) q"
    up = "SELECT MIN(level) + 1 AS level, pos // 16 AS pos, MIN(minx) AS minx, MIN(miny) AS miny, MAX(maxx) AS maxx, MAX(maxy) AS maxy, MIN(pos) AS first_child FROM {} GROUP BY pos // 16"
    levels = ", ".join(f"l{i} AS ({up.format(f'l{i - 1}')})" for i in range(1, 7))
    # levels above the root have one node as well, so the tree ends at the first level with one
    alls = " UNION ALL ".join(f"SELECT * FROM l{i}" for i in range(7))
    return f"WITH boxes AS ({_BOX}), l0 AS ({leaf}), {levels}, al AS ({alls}), top AS (SELECT MIN(level) AS top FROM (SELECT level FROM al WHERE level > 0 GROUP BY level HAVING COUNT(*) = 1) z)"


@query("index_build", f"{_nodes_sql()} SELECT CAST(level AS INTEGER) AS level, pos, minx, miny, maxx, maxy, first_child FROM al, top WHERE level <= top")
def index_build(spark, sf_dir):
    return X.build(boxes(spark, sf_dir)).select("level", "pos", *sides(), "first_child")


@query("index_search", with_boxes(f"SELECT fid FROM boxes WHERE {SQL_RECT}"))
def index_search(spark, sf_dir):
    return X.search(X.build(boxes(spark, sf_dir)), RECT).select("fid")


@query("index_dump", f"{_nodes_sql()} SELECT CAST(level AS INTEGER) AS level, COUNT(*) AS nodes, MIN(minx) AS minx, MAX(maxy) AS maxy FROM al, top WHERE level <= top GROUP BY level")
def index_dump(spark, sf_dir):
    b = boxes(spark, sf_dir)
    d = X.dump(X.build(b), b.count())
    return d.groupBy("level").agg(F.count(F.lit(1)).alias("nodes"), F.min("bbox.minx").alias("minx"), F.max("bbox.maxy").alias("maxy"))


@query("id_lookup", "SELECT p_partkey AS fid, p_brand FROM part WHERE p_partkey IN (3, 17, 42, 199)")
def id_lookup(spark, sf_dir):
    return X.lookup(boxes(spark, sf_dir), [42, 3, 17, 199]).select("fid", "p_brand")


# -- joins ---------------------------------------------------------------------------------------


@query("semi_join", with_boxes("SELECT fid, p_type FROM boxes WHERE fid IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 49)"))
def semi_join(spark, sf_dir):
    hits = table(spark, sf_dir, "lineitem").where("l_quantity >= 49").select(F.col("l_partkey").alias("fid"))
    return J.semi_join(boxes(spark, sf_dir), hits).select("fid", "p_type")


@query("fetch_hits", with_boxes(f"SELECT b.fid, b.p_brand FROM boxes b JOIN (SELECT fid FROM boxes WHERE {SQL_RECT}) h ON b.fid = h.fid"))
def fetch_hits(spark, sf_dir):
    b = boxes(spark, sf_dir)
    return J.fetch(b.select("fid", "p_brand"), B.filter_rect(b, RECT).select("fid")).select("fid", "p_brand")


_JOIN = f"""WITH boxes AS ({_BOX}), points AS ({_POINT})
SELECT b.fid AS fid, p.fid AS pid FROM boxes b JOIN points p ON b.minx <= p.x AND b.maxx >= p.x AND b.miny <= p.y AND b.maxy >= p.y"""


@query("box_join", _JOIN)
def box_join(spark, sf_dir):
    p = points(spark, sf_dir).select(F.col("fid").alias("pid"), F.col("bbox").alias("bbox2"))
    return J.box_join(boxes(spark, sf_dir).select("fid", "bbox"), p).select("fid", "pid")


@query("box_self_join", with_boxes("SELECT a.fid, b.fid AS other FROM boxes a JOIN boxes b ON a.fid < b.fid AND a.minx <= b.maxx AND a.maxx >= b.minx AND a.miny <= b.maxy AND a.maxy >= b.miny"))
def box_self_join(spark, sf_dir):
    b = boxes(spark, sf_dir).select("fid", "bbox")
    return J.box_join(b, b.select(F.col("fid").alias("other"), F.col("bbox").alias("bbox2"))).where("fid < other").select("fid", "other")


@query("tiles", with_points("SELECT CAST(LEAST(GREATEST(FLOOR((x + 180) / 360 * 16), 0), 15) AS INTEGER) AS tile_x, COUNT(*) AS n FROM points GROUP BY 1"))
def tiles(spark, sf_dir):
    return J.tiles_of(points(spark, sf_dir), 4).groupBy("tile_x").agg(F.count(F.lit(1)).alias("n"))


_TILE = J.tile_rect(3, 4, 3)


@query("tile_load", with_boxes(f"SELECT fid FROM boxes WHERE minx <= {_TILE[2]!r} AND maxx >= {_TILE[0]!r} AND miny <= {_TILE[3]!r} AND maxy >= {_TILE[1]!r}"))
def tile_load(spark, sf_dir):
    return J.load_tile(boxes(spark, sf_dir), 3, 4, 3).select("fid")


# -- windows over byte layouts -------------------------------------------------------------------


@query("feature_offsets", "SELECT doc_id AS fid, n_chars AS size, COALESCE(CAST(SUM(n_chars) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS \"offset\" FROM documents")
def feature_offsets(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("fid"), F.col("n_chars").alias("size"))
    return N.offsets_wide(d, ["fid"]).select("fid", "size", "offset")


_OFFSETS = "SELECT doc_id AS pos, COALESCE(CAST(SUM(n_chars) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS start FROM documents"


@query("feature_lengths", f"SELECT pos, LEAD(start) OVER (ORDER BY pos) - start AS length FROM ({_OFFSETS}) o")
def feature_lengths(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pos"), F.col("n_chars").alias("size"))
    return N.lengths_wide(N.offsets_wide(d, ["pos"])).select("pos", "length")


_LEN = f"SELECT pos, start, LEAD(start) OVER (ORDER BY pos) - start AS length FROM ({_OFFSETS}) o"
_BATCH = f"""SELECT pos, start, length, SUM(fresh) OVER (ORDER BY start ROWS UNBOUNDED PRECEDING) AS batch FROM (
 SELECT pos, start, length, CASE WHEN start - LAG(start + COALESCE(length, 4)) OVER (ORDER BY start) > 4096 THEN 1 ELSE 0 END AS fresh
 FROM ({_LEN}) l WHERE pos IN (SELECT doc_id FROM documents WHERE lang = 'de')) f"""


@query("gap_batches", f"SELECT CAST(batch AS BIGINT) AS batch, MIN(start) AS \"start\", MAX(start + COALESCE(length, 4)) AS \"end\", COUNT(*) AS ranges FROM ({_BATCH}) b GROUP BY batch")
def gap_batches(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pos"), F.col("n_chars").alias("size"), "lang")
    hits = N.lengths_wide(N.offsets_wide(d, ["pos"])).where("lang = 'de'")
    return N.batches(hits, gap=4096).select("batch", "start", "end", "ranges")


@query("ordinal_ids", "SELECT event_id, ROW_NUMBER() OVER (ORDER BY ts, event_id) - 1 AS fid FROM events")
def ordinal_ids(spark, sf_dir):
    return X.global_rank(table(spark, sf_dir, "events").select("ts", "event_id"), [F.col("ts"), F.col("event_id")], "fid").select("event_id", "fid")


# -- counting, skipping, describing --------------------------------------------------------------


@query("count_features", with_boxes(f"SELECT COUNT(*) AS features_count FROM boxes WHERE {SQL_RECT}"))
def count_features(spark, sf_dir):
    return L.count(boxes(spark, sf_dir), RECT)


@query("skip_features", with_boxes("SELECT fid FROM boxes ORDER BY fid OFFSET 150"))
def skip_features(spark, sf_dir):
    return L.skip(boxes(spark, sf_dir), 150).select("fid")


@query("skip_past_end", with_boxes("SELECT fid FROM boxes WHERE fid < 0"))
def skip_past_end(spark, sf_dir):
    return L.skip(boxes(spark, sf_dir), 1_000_000_000).select("fid")


@query("nth_feature", with_boxes("SELECT fid, p_brand FROM boxes WHERE fid = 17"))
def nth_feature(spark, sf_dir):
    return L.nth(boxes(spark, sf_dir), 17).select("fid", "p_brand")


@query("first_features", with_boxes("SELECT fid FROM boxes ORDER BY fid LIMIT 25"))
def first_features(spark, sf_dir):
    return L.first(boxes(spark, sf_dir), 25).select("fid")


@query("header_row", with_boxes("SELECT MIN(minx) AS e0, MAX(maxy) AS e3, COUNT(*) AS features_count, 16 AS index_node_size, 3 AS n_columns FROM boxes"))
def header_row(spark, sf_dir):
    h = L.header(boxes(spark, sf_dir))
    return h.select(F.col("envelope")[0].alias("e0"), F.col("envelope")[3].alias("e3"), F.col("features_count").cast("long"), "index_node_size", F.size("columns").alias("n_columns"))


@query("geometry_type", "SELECT 2 AS geometry_type")
def geometry_type(spark, sf_dir):
    return L.infer_geometry_type(lines(spark, sf_dir)).select(F.col("geometry_type").cast("int"))


@query("geometry_type_mixed", "SELECT 0 AS geometry_type")
def geometry_type_mixed(spark, sf_dir):
    a = lines(spark, sf_dir).select("geometry")
    b = boxes(spark, sf_dir).select(G.of_box("bbox").alias("geometry"))
    return L.infer_geometry_type(a.union(b)).select(F.col("geometry_type").cast("int"))


@query("total_size", "SELECT CAST(SUM(n_chars) AS BIGINT) AS bytes FROM documents")
def total_size(spark, sf_dir):
    return table(spark, sf_dir, "documents").agg(F.sum("n_chars").alias("bytes"))


_LABELS = ["over 750", "over 500", "over 250", "over 100", "over 50", "over 25", "over 10", "rest"]
_STEPS = [750, 500, 250, 100, 50, 25, 10]
_CASE = "CASE " + " ".join(f"WHEN l_quantity * 20 > {t} THEN '{n}'" for t, n in zip(_STEPS, _LABELS, strict=False)) + " ELSE 'rest' END"


@query("choropleth", f"SELECT {_CASE} AS bin, COUNT(*) AS n FROM lineitem GROUP BY 1")
def choropleth(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(L.binned(F.col("l_quantity") * 20, _STEPS, _LABELS).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


# -- geometry ------------------------------------------------------------------------------------


@query("line_boxes", f"SELECT fid, MIN(x) AS minx, MIN(y) AS miny, MAX(x) AS maxx, MAX(y) AS maxy FROM ({_LINE_POINTS}) p GROUP BY fid")
def line_boxes(spark, sf_dir):
    return lines(spark, sf_dir).select("fid", G.bbox("geometry").alias("bbox")).select("fid", *sides())


@query("vertex_counts", f"SELECT fid, COUNT(*) AS n FROM ({_LINE_POINTS}) p GROUP BY fid")
def vertex_counts(spark, sf_dir):
    return lines(spark, sf_dir).select("fid", G.n_points("geometry").alias("n"))


_WKT_LIST = "STRING_AGG(CAST(CAST(x AS BIGINT) AS VARCHAR) || ' ' || CAST(CAST(y AS BIGINT) AS VARCHAR), ', ' ORDER BY l_linenumber, l_partkey, x, y)"
_JSON_LIST = "STRING_AGG('[' || CAST(CAST(x AS BIGINT) AS VARCHAR) || ',' || CAST(CAST(y AS BIGINT) AS VARCHAR) || ']', ',' ORDER BY l_linenumber, l_partkey, x, y)"


@query("line_wkt", f"SELECT fid, 'LINESTRING (' || {_WKT_LIST} || ')' AS wkt FROM ({_LINE_POINTS}) p GROUP BY fid")
def line_wkt(spark, sf_dir):
    return lines(spark, sf_dir).select("fid", G.to_wkt("geometry").alias("wkt"))


_GEOJSON = f"SELECT fid, '{{\"type\":\"LineString\",\"coordinates\":[' || {_JSON_LIST} || ']}}' AS geojson FROM ({_LINE_POINTS}) p GROUP BY fid"


@query("line_geojson", _GEOJSON)
def line_geojson(spark, sf_dir):
    return lines(spark, sf_dir).select("fid", G.to_geojson("geometry").alias("geojson"))


@query("geojson_roundtrip", _GEOJSON)
def geojson_roundtrip(spark, sf_dir):
    return lines(spark, sf_dir).select("fid", G.to_geojson(G.from_geojson(G.to_geojson("geometry"))).alias("geojson"))


@query("promoted_wkt", f"SELECT fid, 'MULTILINESTRING ((' || {_WKT_LIST} || '))' AS wkt FROM ({_LINE_POINTS}) p GROUP BY fid")
def promoted_wkt(spark, sf_dir):
    return lines(spark, sf_dir).select("fid", G.to_wkt(G.promoted("geometry")).alias("wkt"))


@query("ring_ends", f"SELECT fid, n, CASE WHEN n > 1 THEN 2 ELSE 1 END AS parts, n AS last_end FROM (SELECT fid, CAST(COUNT(*) AS INTEGER) AS n FROM ({_LINE_POINTS}) p GROUP BY fid) q")
def ring_ends(spark, sf_dir):
    p = F.get("geometry.parts", F.lit(0))
    n = G.points_in(p["xy"])
    sizes = F.when(n > 1, F.array(F.lit(1), n - 1)).otherwise(F.array(n))
    ends = G.ends_of(sizes)
    out = lines(spark, sf_dir).select("fid", n.alias("n"), F.size(G.split(G.pairs(p["xy"]), ends)).alias("parts"), F.coalesce(F.element_at(ends, -1), n).alias("last_end"))
    return out


@query("interleave", f"SELECT fid, CAST(COUNT(*) * 3 AS INTEGER) AS flat, CAST(COUNT(*) AS INTEGER) AS max_z FROM ({_LINE_POINTS}) p GROUP BY fid")
def interleave(spark, sf_dir):
    li = lines(spark, sf_dir)
    xy = F.get("geometry.parts", F.lit(0))["xy"]
    z = F.transform(F.sequence(F.lit(1), G.points_in(xy)), lambda i: i.cast("double"))
    flat = G.interleaved(xy, z)
    back = G.deinterleaved(flat, 3)
    return li.select("fid", F.size(flat).alias("flat"), F.array_max(back["z"]).cast("int").alias("max_z"))


@query("type_names", "SELECT * FROM (VALUES (0,'Unknown'),(1,'Point'),(2,'LineString'),(3,'Polygon'),(6,'MultiPolygon'),(7,'GeometryCollection'),(17,'Triangle')) t(code, name)")
def type_names(spark, sf_dir):
    codes = spark.range(18).select(F.col("id").cast("int").alias("code")).where("code in (0, 1, 2, 3, 6, 7, 17)")
    return codes.select(G.type_code(G.type_name("code")).cast("int").alias("code"), G.type_name("code").alias("name"))


@query("mercator_roundtrip", with_points("SELECT fid, CAST(ROUND(x * 100) AS BIGINT) AS x, CAST(ROUND(y * 100) AS BIGINT) AS y FROM points"))
def mercator_roundtrip(spark, sf_dir):
    there = G.projected(G.point("x", "y"), 4326, 3857)
    back = points(spark, sf_dir).where("y > -90").select("fid", there.alias("g")).select("fid", G.projected("g", 3857, 4326).alias("g"))
    edge = points(spark, sf_dir).where("y <= -90").select("fid", F.round(F.col("x") * 100).cast("long").alias("x"), F.round(F.col("y") * 100).cast("long").alias("y"))
    return back.select("fid", F.round(G.x("g") * 100).cast("long").alias("x"), F.round(G.y("g") * 100).cast("long").alias("y")).union(edge)


@query("box_rings", with_boxes("SELECT fid, 5 AS points, minx AS x0, maxy AS y2 FROM boxes"))
def box_rings(spark, sf_dir):
    ring = G.exterior(G.of_box("bbox"))
    return boxes(spark, sf_dir).select("fid", F.size(ring).alias("points"), F.get(F.get(ring, F.lit(0)), F.lit(0)).alias("x0"), F.get(F.get(ring, F.lit(2)), F.lit(1)).alias("y2"))


@query("valid_ends", f"SELECT fid, TRUE AS good, COUNT(*) >= 3 AS bad FROM ({_LINE_POINTS}) p GROUP BY fid")
def valid_ends(spark, sf_dir):
    p = F.get("geometry.parts", F.lit(0))
    three = p.withField("ends", F.array(F.lit(3)))
    return lines(spark, sf_dir).select("fid", G.valid("geometry").alias("good"), G.ends_valid(three).alias("bad"))


# -- what Catalyst gives as it is ----------------------------------------------------------------


@query("json_attribute", "SELECT event_id, props FROM events WHERE event_type = 'click'")
def json_attribute(spark, sf_dir):
    return table(spark, sf_dir, "events").where("event_type = 'click'").select("event_id", "props")


@query("append_features", f"WITH boxes AS ({_BOX}), points AS ({_POINT}) SELECT fid, minx, maxy FROM boxes UNION ALL SELECT fid, x, y FROM points")
def append_features(spark, sf_dir):
    both = boxes(spark, sf_dir).select("fid", "bbox").unionByName(points(spark, sf_dir).select("fid", "bbox"))
    return both.select("fid", F.col("bbox.minx").alias("minx"), F.col("bbox.maxy").alias("maxy"))


@query("distinct_groups", "SELECT p_brand, COUNT(DISTINCT p_type) AS types FROM part GROUP BY p_brand")
def distinct_groups(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.countDistinct("p_type").alias("types"))


@query("curve_clusters", with_boxes(f"SELECT hilbert // 268435456 AS cluster, COUNT(*) AS n, MIN(minx) AS minx, MAX(maxx) AS maxx FROM ({hilbert_sql(_PARTS)}) q GROUP BY 1"))
def curve_clusters(spark, sf_dir):
    coded = X.with_hilbert(boxes(spark, sf_dir))
    return coded.groupBy(F.shiftright("hilbert", 28).alias("cluster")).agg(F.count(F.lit(1)).alias("n"), F.min("bbox.minx").alias("minx"), F.max("bbox.maxx").alias("maxx"))


