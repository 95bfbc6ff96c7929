"""Nested geometries as structs of arrays, and functions over them as built-in expressions.

    geometry struct<type, parts array<struct<path, type, ends, xy, z, m, t, tm>>>

A simple geometry is one part with an empty path. Polygons of a MultiPolygon, members of a collection,
and parts of curves and surfaces are parts with their place as path. `ends` are exclusive point
indexes of rings or lines (null for one); ordinates are flat arrays, x and y in turns.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from geotable.functions import bbox as B

NAMES = (
    "Unknown Point LineString Polygon MultiPoint MultiLineString MultiPolygon GeometryCollection CircularString CompoundCurve "
    "CurvePolygon MultiCurve MultiSurface Curve Surface PolyhedralSurface TIN Triangle"
).split()
POINT, LINE, POLYGON, MULTIPOINT, MULTILINE, MULTIPOLYGON, COLLECTION = range(1, 8)
#: Types that are made of parts with geometries of their own.
NESTED = (6, 7, 9, 10, 11, 12, 15, 16)
PART = "struct<path:array<int>,type:tinyint,ends:array<int>,xy:array<double>,z:array<double>,m:array<double>,t:array<double>,tm:array<decimal(20,0)>>"
TYPE = f"struct<type:tinyint,parts:array<{PART}>>"
RADIUS = 6378137.0


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _let(c: Column | str, f: Callable[[Column], Column]) -> Column:
    """f of a column, which is evaluated, and stands in the plan, once: as the variable of a function over a list of one."""
    return f(F.col(c)) if isinstance(c, str) else F.get(F.transform(F.array(c), f), F.lit(0))


# -- types ---------------------------------------------------------------------------------------


def type_name(code: Column | str) -> Column:
    return F.try_element_at(F.array(*map(F.lit, NAMES)), _col(code).cast("int") + 1)


def type_code(name: Column | str) -> Column:
    """Code of a type name, in any case; 0 for names that are none."""
    known = F.create_map(*[F.lit(x) for i, n in enumerate(NAMES) for x in (n.lower(), i)])
    return F.coalesce(F.try_element_at(known, F.lower(_col(name))), F.lit(0)).cast("tinyint")


def is_collection(code: Column | str) -> Column:
    """Types whose parts are geometries: multi-geometries (but MultiPoint and MultiLineString, which are flat) and collections."""
    return _col(code).isin(*NESTED)


def resolved_type(header: Column | int, own: Column) -> Column:
    """The header's type, unless that is Unknown."""
    h = header if isinstance(header, Column) else F.lit(header)
    return F.when(F.coalesce(h, F.lit(0)) != 0, h).otherwise(own).cast("tinyint")


def common_type(code: Column | str) -> Column:
    """Aggregate: the one type of all rows, else Unknown."""
    c = _col(code)
    return F.when(F.min(c) == F.max(c), F.min(c)).otherwise(F.lit(0)).cast("tinyint")


# -- construction --------------------------------------------------------------------------------


def part(code: Column | int, xy: Column, ends: Column | None = None, z: Column | None = None, m: Column | None = None, path: Column | None = None) -> Column:
    null = lambda t: F.lit(None).cast(t)
    of = lambda c, t: (null(t) if c is None else c.cast(t))
    code = code if isinstance(code, Column) else F.lit(code)
    return F.struct(
        (F.array() if path is None else path).cast("array<int>").alias("path"),
        code.cast("tinyint").alias("type"),
        of(ends, "array<int>").alias("ends"),
        xy.cast("array<double>").alias("xy"),
        of(z, "array<double>").alias("z"),
        of(m, "array<double>").alias("m"),
        null("array<double>").alias("t"),
        null("array<decimal(20,0)>").alias("tm"),
    )


def simple(code: Column | int, xy: Column, ends: Column | None = None, z: Column | None = None, m: Column | None = None) -> Column:
    """A geometry of one part."""
    c = code if isinstance(code, Column) else F.lit(code)
    return F.struct(c.cast("tinyint").alias("type"), F.array(part(c, xy, ends, z, m)).alias("parts"))


def point(x: Column | str, y: Column | str) -> Column:
    return simple(POINT, F.array(_col(x).cast("double"), _col(y).cast("double")))


def of_box(box: Column | str) -> Column:
    """A box as a polygon."""
    return simple(POLYGON, B.ring(box))


def of_parts(code: int, parts: Column) -> Column:
    """A multi-geometry or collection of an array of parts (numbered by their place)."""
    placed = F.transform(parts, lambda p, i: p.withField("path", F.array(i)))
    return F.struct(F.lit(code).cast("tinyint").alias("type"), placed.alias("parts"))


# -- coordinates ---------------------------------------------------------------------------------


def points_in(xy: Column) -> Column:
    return F.floor(F.coalesce(F.size(xy), F.lit(0)) / 2).cast("int")


def pairs(xy: Column, z: Column | None = None) -> Column:
    """[[x, y], ...], or with z [[x, y, z], ...]."""
    n = points_in(xy)
    at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    flat = lambda i: F.array(F.get(xy, i * 2), F.get(xy, i * 2 + 1))
    if z is None:
        return F.transform(at, flat)
    return F.transform(at, lambda i: F.when(F.size(z) > i, F.concat(flat(i), F.array(F.get(z, i)))).otherwise(flat(i)))


def flatten_pairs(coords: Column) -> Column:
    """[[x, y, ...], ...] to flat x, y."""
    return F.flatten(F.transform(coords, lambda p: F.slice(p, 1, 2)))


def flatten_z(coords: Column) -> Column:
    """Third ordinates, or null if any point lacks one."""
    all_z = F.forall(coords, lambda p: F.size(p) >= 3) & (F.size(coords) > 0)
    return F.when(all_z, F.transform(coords, lambda p: F.get(p, F.lit(2))))


def interleaved(xy: Column, z: Column | None = None, m: Column | None = None) -> Column:
    """Flat x, y, then z and m where given, point by point."""
    at = F.sequence(F.lit(0), points_in(xy) - 1)
    more = [c for c in (z, m) if c is not None]
    out = F.flatten(F.transform(at, lambda i: F.array(F.get(xy, i * 2), F.get(xy, i * 2 + 1), *[F.get(c, i) for c in more])))
    return F.when(points_in(xy) > 0, out).otherwise(F.array().cast("array<double>"))


def every(flat: Column, stride: int, offset: int) -> Column:
    """Each stride-th ordinate of a flat array from offset on."""
    return F.filter(flat, lambda _, i: i % stride == offset)


def deinterleaved(flat: Column, stride: int, third: str = "z") -> Column:
    """struct<xy, z, m> of a flat array with `stride` ordinates a point; of three, the third is z, or m."""
    none = F.lit(None).cast("array<double>")
    if stride == 3 and third == "m":
        return F.struct(F.filter(flat, lambda _, i: i % 3 < 2).alias("xy"), none.alias("z"), every(flat, 3, 2).alias("m"))
    return F.struct(
        F.filter(flat, lambda _, i: i % stride < 2).alias("xy"), (every(flat, stride, 2) if stride > 2 else none).alias("z"), (every(flat, stride, 3) if stride > 3 else none).alias("m")
    )


def ends_of(sizes: Column) -> Column:
    """Exclusive ends from the numbers of points of rings or lines; null for at most one."""
    run = F.aggregate(sizes, F.array().cast("array<int>"), lambda a, n: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0)) + n.cast("int"))))
    return F.when(F.size(sizes) > 1, run)


def split(points: Column, ends: Column) -> Column:
    """An array of points cut at its ends; one part where ends are null."""
    starts = F.concat(F.array(F.lit(0)), F.slice(ends, 1, F.greatest(F.size(ends) - 1, F.lit(0))))
    cuts = F.zip_with(starts, ends, lambda a, b: F.slice(points, a + 1, F.greatest(b - a, F.lit(0))))
    return F.when(F.coalesce(F.size(ends), F.lit(0)) > 0, cuts).otherwise(F.array(points))


def ends_valid(p: Column) -> Column:
    """Whether a part's ends rise (never fall) and stay within its points."""
    e = p["ends"]
    rising = F.aggregate(e, F.struct(F.lit(0).alias("at"), F.lit(True).alias("ok")), lambda a, v: F.struct(v.alias("at"), (a["ok"] & (v >= a["at"]) & (v <= points_in(p["xy"]))).alias("ok")), lambda a: a["ok"])
    return F.when(e.isNull(), F.lit(True)).otherwise(rising) & (F.coalesce(F.size(p["xy"]), F.lit(0)) % 2 == 0)


def valid(geom: Column | str) -> Column:
    """Whether all parts' ends are valid; null for a null geometry."""
    return F.forall(_col(geom)["parts"], ends_valid)


# -- accessors -----------------------------------------------------------------------------------


def n_parts(geom: Column | str) -> Column:
    return F.size(_col(geom)["parts"])


def part_n(geom: Column | str, n: int | Column = 0) -> Column:
    return F.get(_col(geom)["parts"], n if isinstance(n, Column) else F.lit(n))


def n_points(geom: Column | str) -> Column:
    """Vertices of all parts (long); 0 for an empty geometry, null for null."""
    return _let(geom, lambda g: _n_points(g))


def _n_points(g: Column) -> Column:
    return F.aggregate(g["parts"], F.lit(0).cast("long"), lambda a, p: a + points_in(p["xy"]))


def x(geom: Column | str) -> Column:
    return F.get(part_n(geom)["xy"], F.lit(0))


def y(geom: Column | str) -> Column:
    return F.get(part_n(geom)["xy"], F.lit(1))


def z(geom: Column | str) -> Column:
    return F.get(part_n(geom)["z"], F.lit(0))


def m(geom: Column | str) -> Column:
    return F.get(part_n(geom)["m"], F.lit(0))


def max_z(geom: Column | str) -> Column:
    return F.array_max(F.flatten(F.transform(_col(geom)["parts"], lambda p: F.coalesce(p["z"], F.array().cast("array<double>")))))


def rings(p: Column) -> Column:
    """Rings or lines of a part, as arrays of points."""
    return split(pairs(p["xy"], p["z"]), p["ends"])


def n_rings(p: Column) -> Column:
    return F.greatest(F.coalesce(F.size(p["ends"]), F.lit(0)), F.lit(1))


def exterior(geom: Column | str) -> Column:
    return F.get(rings(part_n(geom)), F.lit(0))


def n_interiors(geom: Column | str) -> Column:
    return n_rings(part_n(geom)) - 1


def interior_n(geom: Column | str, n: int) -> Column:
    return F.get(rings(part_n(geom)), F.lit(n + 1))


def line_n(geom: Column | str, n: int) -> Column:
    return F.get(rings(part_n(geom)), F.lit(n))


def point_n(geom: Column | str, n: int) -> Column:
    return F.get(pairs(part_n(geom)["xy"]), F.lit(n))


def polygon_n(geom: Column | str, n: int) -> Column:
    """The n-th polygon of a MultiPolygon (always a polygon, whatever type its part claims)."""
    return _let(geom, lambda g: _polygon_n(g, n))


def _polygon_n(g: Column, n: int) -> Column:
    p = part_n(g, n)
    return F.when(p.isNotNull(), F.struct(F.lit(POLYGON).cast("tinyint").alias("type"), F.array(p.withField("path", F.array().cast("array<int>")).withField("type", F.lit(POLYGON).cast("tinyint"))).alias("parts")))


def geometry_n(geom: Column | str, n: int) -> Column:
    """The n-th member of a collection, with its own type."""
    return _let(geom, lambda g: _geometry_n(g, n))


def _geometry_n(g: Column, n: int) -> Column:
    own = F.filter(g["parts"], lambda p: F.get(p["path"], F.lit(0)) == n)
    inner = F.transform(own, lambda p: p.withField("path", F.slice(p["path"], 2, F.greatest(F.size(p["path"]) - 1, F.lit(0)))))
    code = F.when(F.exists(inner, lambda p: F.size(p["path"]) > 0), F.lit(MULTIPOLYGON)).otherwise(F.get(inner, F.lit(0))["type"]).cast("tinyint")
    return F.when(F.size(own) > 0, F.struct(code.alias("type"), inner.alias("parts")))


def _has(geom: Column | str, name: str) -> Column:
    return F.exists(_col(geom)["parts"], lambda p: F.exists(F.coalesce(p[name], F.array().cast("array<double>")), lambda v: v.isNotNull() & ~F.isnan(v)))


def has_z(geom: Column | str) -> Column:
    """Whether any z is a number."""
    return _has(geom, "z")


def has_m(geom: Column | str) -> Column:
    return _has(geom, "m")


def coord_dim(geom: Column | str) -> Column:
    return F.lit(2) + has_z(geom).cast("int") + has_m(geom).cast("int")


def bbox(geom: Column | str) -> Column:
    """The box around all coordinates of all parts, NaN ordinates ignored; null for a null or empty geometry."""
    return _let(geom, lambda g: _bbox(g))


def _bbox(g: Column) -> Column:
    side = lambda o: F.filter(F.flatten(F.transform(g["parts"], lambda p: every(p["xy"], 2, o))), lambda v: ~F.isnan(v))
    xs, ys = side(0), side(1)
    return F.when(F.size(xs) > 0, B.make(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)))


# -- transformations -----------------------------------------------------------------------------


def promoted(geom: Column | str) -> Column:
    """LineString to MultiLineString and Polygon to MultiPolygon, at the top level only; all else stays."""
    return _let(geom, lambda g: _promoted(g))


def _promoted(g: Column) -> Column:
    line = F.struct(F.lit(MULTILINE).cast("tinyint").alias("type"), F.transform(g["parts"], lambda p: p.withField("type", F.lit(MULTILINE).cast("tinyint"))).alias("parts"))
    area = F.struct(F.lit(MULTIPOLYGON).cast("tinyint").alias("type"), F.transform(g["parts"], lambda p: p.withField("path", F.array(F.lit(0)))).alias("parts"))
    return F.when(g["type"] == LINE, line).when(g["type"] == POLYGON, area).otherwise(g)


def project_xy(px: float, py: float, source: int, destination: int) -> tuple[float, float]:
    """A point between EPSG:4326 and EPSG:3857."""
    if source == destination:
        return px, py
    if (source, destination) == (4326, 3857):
        return math.radians(px) * RADIUS, math.log(math.tan(math.pi / 4 + math.radians(max(-89.99999999, min(89.99999999, py))) / 2)) * RADIUS
    if (source, destination) == (3857, 4326):
        return math.degrees(px / RADIUS), math.degrees(2 * math.atan(math.exp(py / RADIUS)) - math.pi / 2)
    raise ValueError(f"no transformation from {source} to {destination}")


def projected(geom: Column | str, source: int, destination: int) -> Column:
    """All coordinates between EPSG:4326 and EPSG:3857."""
    g = _col(geom)
    if source == destination:
        return g
    if (source, destination) == (4326, 3857):
        fx = lambda v: F.radians(v) * RADIUS
        fy = lambda v: F.log(F.tan(F.lit(math.pi / 4) + F.radians(F.greatest(F.least(v, F.lit(89.99999999)), F.lit(-89.99999999))) / 2)) * RADIUS
    elif (source, destination) == (3857, 4326):
        fx = lambda v: F.degrees(v / RADIUS)
        fy = lambda v: F.degrees(2 * F.atan(F.exp(v / RADIUS)) - math.pi / 2)
    else:
        raise ValueError(f"no transformation from {source} to {destination}")
    move = lambda p: p.withField("xy", F.transform(p["xy"], lambda v, i: F.when(i % 2 == 0, fx(v)).otherwise(fy(v))))
    return _let(geom, lambda g: F.when(g.isNotNull(), F.struct(g["type"].alias("type"), F.transform(g["parts"], move).alias("parts"))))


# -- text ----------------------------------------------------------------------------------------


def number(v: Column) -> Column:
    """A double as text, whole numbers without a point."""
    whole = (v == F.floor(v)) & (F.abs(v) < 1e15)
    return F.when(whole, v.cast("decimal(20,0)").cast("string")).otherwise(v.cast("string"))


def _join(a: Column, f, sep: str = ", ", left: str = "(", right: str = ")") -> Column:
    return F.concat(F.lit(left), F.array_join(F.transform(a, f), sep), F.lit(right))


def _members(g: Column) -> Column:
    """A collection's members, each as an array of its parts."""
    places = F.array_distinct(F.transform(g["parts"], lambda p: F.get(p["path"], F.lit(0))))
    return F.transform(places, lambda i: F.filter(g["parts"], lambda p: F.get(p["path"], F.lit(0)) == i))


def _by_kind(m: Column, one: Callable, polygons: Callable, inner: Callable) -> Column:
    """A member as a simple geometry, a MultiPolygon (polygons below it), or a collection within the collection."""
    deep = F.exists(m, lambda p: F.size(p["path"]) > 1)
    return F.when(~deep, one(F.get(m, F.lit(0)))).when(F.forall(m, lambda p: p["type"] == POLYGON), polygons(m)).otherwise(inner(m))


def _wkt_part(p: Column) -> Column:
    """A part's coordinates in brackets, as its own type writes them."""
    pt = lambda c: F.array_join(F.transform(c, number), " ")
    flat = _join(pairs(p["xy"], p["z"]), pt)
    nested = _join(rings(p), lambda r: _join(r, pt))
    empty = points_in(p["xy"]) == 0
    return F.when(empty, F.lit("EMPTY")).when(p["type"].isin(POLYGON, MULTILINE, 17, 10), nested).otherwise(flat)


def _tag(code: Column, dim3: Column) -> Column:
    return F.concat(F.upper(type_name(code)), F.when(dim3, F.lit(" Z ")).otherwise(F.lit(" ")))


def to_wkt(geom: Column | str) -> Column:
    """Well-known text; parts of multi-geometries and surfaces in place, members of collections with their own names."""
    return _let(geom, lambda g: _to_wkt(g))


def _to_wkt(g: Column) -> Column:
    dim3 = has_z(g)
    body = F.get(g["parts"], F.lit(0))
    plain = F.concat(_tag(g["type"], dim3), _wkt_part(body.withField("type", g["type"])))
    bare = F.concat(_tag(g["type"], dim3), _join(g["parts"], lambda p: _wkt_part(p.withField("type", F.when(p["type"] == 0, F.lit(POLYGON)).otherwise(p["type"])))))
    one = lambda p: F.concat(_tag(p["type"], dim3), _wkt_part(p))
    polygons = lambda m: F.concat(_tag(F.lit(MULTIPOLYGON), dim3), _join(m, _wkt_part))
    inner = lambda m: F.concat(_tag(F.lit(COLLECTION), dim3), _join(m, one))
    named = F.concat(_tag(g["type"], dim3), _join(_members(g), lambda m: _by_kind(m, one, polygons, inner)))
    empty = F.concat(F.upper(type_name(g["type"])), F.lit(" EMPTY"))
    return F.when(g.isNull(), F.lit(None)).when(n_points(g) == 0, empty).when(g["type"].isin(6, 15, 16), bare).when(g["type"].isin(7, 9, 10, 11, 12), named).otherwise(plain)


def _json_part(p: Column) -> Column:
    pt = lambda c: _join(c, number, ",", "[", "]")
    points, nested = pairs(p["xy"], p["z"]), rings(p)
    one = F.coalesce(pt(F.get(points, F.lit(0))), F.lit("[]"))
    return (
        F.when(p["type"] == POINT, one)
        .when(p["type"].isin(POLYGON, MULTILINE), F.when(points_in(p["xy"]) == 0, F.lit("[]")).otherwise(_join(nested, lambda r: _join(r, pt, ",", "[", "]"), ",", "[", "]")))
        .otherwise(_join(points, pt, ",", "[", "]"))
    )


def to_geojson(geom: Column | str) -> Column:
    """GeoJSON text of a geometry (types Point to GeometryCollection); null for null."""
    return _let(geom, lambda g: _to_geojson(g))


def _to_geojson(g: Column) -> Column:
    wrap = lambda code, coords: F.concat(F.lit('{"type":"'), type_name(code), F.lit('","coordinates":'), coords, F.lit("}"))
    plain = wrap(g["type"], _json_part(F.get(g["parts"], F.lit(0)).withField("type", g["type"])))
    multi = wrap(g["type"], _join(g["parts"], lambda p: _json_part(p.withField("type", F.lit(POLYGON).cast("tinyint"))), ",", "[", "]"))
    one = lambda p: wrap(p["type"], _json_part(p))
    polygons = lambda m: wrap(F.lit(MULTIPOLYGON), _join(m, _json_part, ",", "[", "]"))
    gather = lambda inside: F.concat(F.lit('{"type":"GeometryCollection","geometries":'), inside, F.lit("}"))
    inner = lambda m: gather(_join(m, one, ",", "[", "]"))
    members = gather(_join(_members(g), lambda m: _by_kind(m, one, polygons, inner), ",", "[", "]"))
    return F.when(g.isNull(), F.lit(None)).when(g["type"] == COLLECTION, members).when(g["type"] == MULTIPOLYGON, multi).otherwise(plain)


def from_geojson(text: Column | str) -> Column:
    """A geometry from GeoJSON text; null for null, for invalid text and for unknown types. Collections may hold collections, one level deep."""
    return _let(text, lambda t: _from_geojson(t))


def _from_geojson(t: Column, depth: int = 2) -> Column:
    """Collections may nest `depth` deep; members that are no geometry are left out."""
    member = _member(t)
    if not depth:
        return member
    inner = F.from_json(F.get_json_object(t, "$.geometries"), "array<string>")
    read = lambda s: F.coalesce(_let(s, lambda v: _from_geojson(v, depth - 1))["parts"], F.array().cast(f"array<{PART}>"))
    nested = F.flatten(F.transform(inner, lambda s, i: F.transform(read(s), lambda p: p.withField("path", F.concat(F.array(i), p["path"])))))
    whole = F.struct(F.lit(COLLECTION).cast("tinyint").alias("type"), F.coalesce(nested, F.array().cast(f"array<{PART}>")).alias("parts"))
    return F.when(F.get_json_object(t, "$.type") == "GeometryCollection", whole).otherwise(member)


def _member(t: Column) -> Column:
    kind, coords = F.get_json_object(t, "$.type"), F.get_json_object(t, "$.coordinates")
    depth = lambda n: F.from_json(coords, "array<" * n + "double" + ">" * n)
    c1, c2, c3, c4 = (depth(n) for n in (1, 2, 3, 4))
    of_rings = lambda code, r: part(code, flatten_pairs(F.flatten(r)), ends_of(F.transform(r, F.size)), flatten_z(F.flatten(r)))
    one = lambda code, p: F.struct(F.lit(code).cast("tinyint").alias("type"), F.array(p).alias("parts"))
    flat = lambda code: one(code, part(code, flatten_pairs(c2), None, flatten_z(c2)))
    polygons = F.struct(F.lit(MULTIPOLYGON).cast("tinyint").alias("type"), F.transform(c4, lambda p, i: of_rings(POLYGON, p).withField("path", F.array(i))).alias("parts"))
    z1 = F.when(F.size(c1) >= 3, F.slice(c1, 3, 1))
    return (
        F.when(kind == "Point", one(POINT, part(POINT, F.slice(c1, 1, 2), None, z1)))
        .when(kind == "LineString", flat(LINE))
        .when(kind == "MultiPoint", flat(MULTIPOINT))
        .when(kind == "Polygon", one(POLYGON, of_rings(POLYGON, c3)))
        .when(kind == "MultiLineString", one(MULTILINE, of_rings(MULTILINE, c3)))
        .when(kind == "MultiPolygon", polygons)
    )


def to_svg(geom: Column | str, invert_y: bool = False) -> Column:
    """An SVG path of all rings and lines; y is turned over for geographic coordinates."""
    return _let(geom, lambda g: _to_svg(g, invert_y))


def _to_svg(g: Column, invert_y: bool ) -> Column:
    sign = -1.0 if invert_y else 1.0
    pt = lambda c: F.concat(number(F.get(c, F.lit(0))), F.lit(" "), number(F.get(c, F.lit(1)) * F.lit(sign)))
    lines = F.flatten(F.transform(g["parts"], lambda p: F.transform(rings(p), lambda r: _join(r, pt, " L ", "M ", ""))))
    return F.concat(F.lit('<path d="'), F.array_join(lines, " "), F.lit('"/>'))
