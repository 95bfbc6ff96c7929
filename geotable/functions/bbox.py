"""Bounding boxes as struct<minx, miny, maxx, maxy> columns.

A box that touches a rectangle meets it. A null box, and one with a NaN, meets nothing. Everything is a
built-in expression, so comparisons reach Parquet row groups as pushed filters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Rect = tuple[float, float, float, float]
SIDES = ("minx", "miny", "maxx", "maxy")
TYPE = "struct<minx:double,miny:double,maxx:double,maxy:double>"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def make(minx: Column | str, miny: Column | str, maxx: Column | str, maxy: Column | str) -> Column:
    return F.struct(*[_col(c).cast("double").alias(n) for n, c in zip(SIDES, (minx, miny, maxx, maxy), strict=True)])


def of_point(x: Column | str, y: Column | str) -> Column:
    return make(x, y, x, y)


def empty() -> Column:
    """The inverted infinite box: nothing meets it, and expanding it by a box gives that box."""
    inf = F.lit(float("inf"))
    return make(inf, inf, -inf, -inf)


def intersects_sides(minx: Column, miny: Column, maxx: Column, maxy: Column, rect: Rect) -> Column:
    a, b, c, d = (F.lit(float(v)) for v in rect)
    return (minx <= c) & (maxx >= a) & (miny <= d) & (maxy >= b) & ~F.isnan(maxx) & ~F.isnan(maxy)


def intersects(box: Column | str, rect: Rect) -> Column:
    """Whether a box meets a rectangle; a rectangle of zero size is a point query. Null for a null box, which filters take as no."""
    b = _col(box)
    return intersects_sides(*[b[s] for s in SIDES], rect)


def boxes_intersect(left: Column | str, right: Column | str) -> Column:
    """Whether two boxes meet, for joins."""
    a, b = _col(left), _col(right)
    clean = ~F.isnan(a["maxx"]) & ~F.isnan(a["maxy"]) & ~F.isnan(b["maxx"]) & ~F.isnan(b["maxy"])
    return (a["minx"] <= b["maxx"]) & (a["maxx"] >= b["minx"]) & (a["miny"] <= b["maxy"]) & (a["maxy"] >= b["miny"]) & clean


def _number(c: Column) -> Column:
    return F.nanvl(c, F.lit(None).cast("double"))


def expand(left: Column | str, right: Column | str) -> Column:
    """The smallest box around both; NaN ordinates and null boxes are ignored."""
    a, b = _col(left), _col(right)
    pick = lambda f, s: f(_number(a[s]), _number(b[s]))
    return make(pick(F.least, "minx"), pick(F.least, "miny"), pick(F.greatest, "maxx"), pick(F.greatest, "maxy"))


def expand_point(box: Column | str, x: Column | str, y: Column | str) -> Column:
    return expand(box, of_point(x, y))


def width(box: Column | str) -> Column:
    return _col(box)["maxx"] - _col(box)["minx"]


def height(box: Column | str) -> Column:
    return _col(box)["maxy"] - _col(box)["miny"]


def centre_x(box: Column | str) -> Column:
    return (_col(box)["minx"] + _col(box)["maxx"]) / 2


def centre_y(box: Column | str) -> Column:
    return (_col(box)["miny"] + _col(box)["maxy"]) / 2


def as_array(box: Column | str) -> Column:
    return F.array(*[_col(box)[s] for s in SIDES])


def ring(box: Column | str) -> Column:
    """The closed ring of five points, flat: x, y, x, y, ..."""
    b = _col(box)
    a, c, d, e = (b[s] for s in SIDES)
    return F.array(a, c, d, c, d, e, a, e, a, c)


def extent_columns(box: Column | str) -> list[Column]:
    """Aggregates for the box around all boxes of a group: partial minima and maxima combine on the map side."""
    b = _col(box)
    fold = {"minx": F.min, "miny": F.min, "maxx": F.max, "maxy": F.max}
    return [fold[s](_number(b[s])).alias(s) for s in SIDES]


def extent(df: DataFrame, box: Column | str = "bbox") -> DataFrame:
    """One row with the box around all boxes (nulls for no boxes)."""
    return df.agg(*extent_columns(box))


def filter_rect(df: DataFrame, rect: Rect, box: str = "bbox") -> DataFrame:
    """Rows whose box meets the rectangle."""
    return df.where(intersects(box, rect))


def rect_from_extent(rect: Rect, source: int, destination: int) -> Rect:
    """A rectangle in another reference system (4326 and 3857): its corners transformed, which is exact as both axes are monotonic."""
    from geotable.functions.geometry import project_xy

    x0, y0 = project_xy(rect[0], rect[1], source, destination)
    x1, y1 = project_xy(rect[2], rect[3], source, destination)
    return (min(x0, x1), min(y0, y1), max(x0, x1), max(y0, y1))
