"""Joins of boxes with boxes and with map tiles.

Catalyst plans a join on a box condition as a nested loop. Here both sides are cut by a grid, meet by
cell (an equi-join, so it shuffles, broadcasts and splits skewed cells like any other), and a pair is kept in just
one of the cells it shares: the one that holds the lower left corner of the pair's overlap.

Grids come in levels of doubling cells. A box lives on the level whose cells are no smaller than it, so it
covers four cells at most, and is shown on all coarser levels that are in use; a pair meets on the level
of its larger box. So a box of the whole world costs no more than any other.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geotable.functions import bbox as B
from geotable.functions import geometry as G
from geotable.operators.storage import cut

WORLD = 2 * math.pi * G.RADIUS


def _cells(df: DataFrame, box: str, size: float, top: int, x0: float, y0: float, tag: str) -> DataFrame:
    """`df` once for each cell of a box, with the cell, the box's sides as columns, and bits: first column (1) and first row (2) of its cells, its own level (4)."""
    b = F.col(box)
    clean = b.isNotNull() & ~F.isnan(b["maxx"]) & ~F.isnan(b["maxy"]) & ~F.isnan(b["minx"]) & ~F.isnan(b["miny"]) & (b["minx"] <= b["maxx"]) & (b["miny"] <= b["maxy"])
    side = F.greatest(B.width(box), B.height(box))
    own = F.when(side <= size, F.lit(0)).otherwise(F.least(F.ceil(F.log2(side / F.lit(size))), F.lit(top))).cast("int")
    level = F.col(f"__level{tag}")
    at = lambda c, o: _cell(c, o, size, level)
    rows = df.where(clean).withColumn(f"__own{tag}", own).withColumn(f"__level{tag}", F.explode(F.sequence(F.col(f"__own{tag}"), F.lit(top))))
    rows = rows.withColumns({f"__left{tag}": at(b["minx"], x0), f"__low{tag}": at(b["miny"], y0)} | {f"__{s}{tag}": b[s] for s in B.SIDES})
    left, low = F.col(f"__left{tag}"), F.col(f"__low{tag}")
    rows = rows.withColumn(f"__x{tag}", F.explode(F.sequence(left, at(b["maxx"], x0)))).withColumn(f"__y{tag}", F.explode(F.sequence(low, at(b["maxy"], y0))))
    bit = lambda c, v: F.when(c, F.lit(v)).otherwise(F.lit(0))
    bits = bit(F.col(f"__x{tag}") == left, 1) + bit(F.col(f"__y{tag}") == low, 2) + bit(F.col(f"__own{tag}") == level, 4)
    return rows.withColumn(f"__bits{tag}", bits).drop(left, low, f"__own{tag}")


def _cell(c: Column, low: float, size: float, level: Column) -> Column:
    return F.floor((c - F.lit(low)) / (F.lit(size) * F.pow(F.lit(2.0), level))).cast("long")


#: Rows of one side that meet as many of the other in one place, at most. A task has the square of it in pairs to look at, or a little more.
SIDE = 10_000
#: Cells with more than SIDE rows that are broadcast to both sides.
CROWDED = 1_000_000
TASKS = 20_000
#: Pairs to look at that are left to Catalyst, which plans by the rows.
FEW = 1_000_000


def _spread(a: DataFrame, b: DataFrame, columns: tuple[list[str], list[str]]) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides partitioned by cell into tasks by the pairs to look at (of which the rows tell little), and the names of the keys they meet by.

    In cells with more than SIDE rows each side is cut into blocks by its rows' hash, and every block goes to all blocks of the other.
    """
    keys = ["__level", "__x", "__y"]
    named = lambda t: [F.col(f"{k}{t}").alias(k) for k in keys]
    sizes = a.groupBy(*named("a")).agg(F.count(F.lit(1)).alias("na")).join(b.groupBy(*named("b")).agg(F.count(F.lit(1)).alias("nb")), keys)
    full = (F.col("na") > SIDE) | (F.col("nb") > SIDE)
    sizes = cut(sizes.where(full).select(*keys, *[F.ceil(F.col(f"n{t}") / SIDE).cast("int").alias(f"__blocks{t}") for t in "ab"], (F.col("na").cast("double") * F.col("nb")).alias("pairs")).unionByName(
        sizes.where(~full).agg(F.sum(F.col("na").cast("double") * F.col("nb")).alias("pairs")), allowMissingColumns=True))
    found = sizes.agg(F.sum("pairs").alias("pairs"), F.count("__x").alias("crowded")).first()
    if found["crowded"]:
        blocks = sizes.where("__x is not null").drop("pairs")
        blocks = F.broadcast(blocks) if found["crowded"] <= CROWDED else blocks
        a, b = (_blocks(df, blocks, keys, t, o, c) for df, t, o, c in ((a, "a", "b", columns[0]), (b, "b", "a", columns[1])))
        keys += ["__ina", "__inb"]
    if (found["pairs"] or 0) > FEW:
        tasks = min(TASKS, max(math.ceil(found["pairs"] / (SIDE * SIDE)), int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
        a, b = (df.repartition(tasks, *[f"{k}{t}" for k in keys]) for df, t in ((a, "a"), (b, "b")))
    return a, b, keys


def _blocks(df: DataFrame, blocks: DataFrame, keys: list[str], tag: str, other: str, columns: list[str]) -> DataFrame:
    """A row's own block, and once for each block of the other side."""
    met = df.join(blocks, [df[f"{k}{tag}"] == blocks[k] for k in keys], "left").drop(*keys)
    own = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in columns], *[F.col(f"__{s}{tag}") for s in B.SIDES]), F.coalesce(f"__blocks{tag}", F.lit(1))).cast("int")
    met = met.withColumn(f"__in{tag}{tag}", own).withColumn(f"__in{other}{tag}", F.explode(F.sequence(F.lit(0), F.coalesce(f"__blocks{other}", F.lit(1)) - 1)))
    return met.drop("__blocksa", "__blocksb")


def box_join(left: DataFrame, right: DataFrame, left_box: str = "bbox", right_box: str = "bbox2", cell: float | None = None) -> DataFrame:
    """Pairs of rows whose boxes meet, each pair once. Column names of the two sides must differ.

    `cell` is the finest grid's cell size; by default twice the mean side of all boxes, but at least a 4096th of
    the extent. Null, NaN and inverted boxes meet nothing.
    """
    sides = [df.select(F.col(b).alias("b")) for df, b in ((left, left_box), (right, right_box))]
    largest = F.max(F.nanvl(F.greatest(B.width("b"), B.height("b")), F.lit(None))).alias("largest")
    mean = F.avg(F.nanvl(B.width("b") + B.height("b"), F.lit(None))).alias("mean")
    row = sides[0].unionByName(sides[1]).agg(*B.extent_columns("b"), mean, largest).first()
    x0, y0, size, top = 0.0, 0.0, 1.0, 0
    if row["minx"] is not None and row["largest"] is not None:
        x0, y0 = row["minx"], row["miny"]
        span = max(row["maxx"] - x0, row["maxy"] - y0, 1e-9)
        size = cell or max(row["mean"], span / 4096)
        top = max(0, math.ceil(math.log2(max(row["largest"], size) / size)))
    plain = lambda df: [n for n, t in df.dtypes if "map<" not in t and "variant" not in t]
    a, b, keys = _spread(_cells(left, left_box, size, top, x0, y0, "a"), _cells(right, right_box, size, top, x0, y0, "b"), (plain(left), plain(right)))
    side = lambda s, t: F.col(f"__{s}{t}")
    same = [F.col(f"{k}a") == F.col(f"{k}b") for k in keys]
    # the pair's level is that of its larger box, its cell the one of its overlap's lower left corner: in both axes the first of either box
    home = F.col("__bitsa").bitwiseOR(F.col("__bitsb")) == 7
    meets = (side("minx", "a") <= side("maxx", "b")) & (side("maxx", "a") >= side("minx", "b")) & (side("miny", "a") <= side("maxy", "b")) & (side("maxy", "a") >= side("miny", "b"))
    met = a.join(b, reduce(and_, same) & home & meets)
    return met.drop(*[f"{k}{t}" for k in (*keys, "__bits", *[f"__{s}" for s in B.SIDES]) for t in "ab"])


def tile_rect(z: int, x: int, y: int, srid: int = 4326) -> B.Rect:
    """The rectangle of a web map tile (y grows southward)."""
    size = WORLD / (1 << z)
    merc = (-WORLD / 2 + x * size, WORLD / 2 - (y + 1) * size, -WORLD / 2 + (x + 1) * size, WORLD / 2 - y * size)
    return merc if srid == 3857 else B.rect_from_extent(merc, 3857, srid)


def tile_key(z: int, x: int, y: int) -> str:
    return f"{z}/{x}/{y}"


def tiles_of(df: DataFrame, z: int, box: str = "bbox") -> DataFrame:
    """Each row once for every tile of a zoom level that its box (EPSG:4326) meets: tile_x, tile_y, tile (z/x/y)."""
    n = 1 << z
    b = F.col(box)
    clip = lambda c: F.greatest(F.least(c, F.lit(n - 1)), F.lit(0)).cast("int")
    tx = lambda c: clip(F.floor((c + 180.0) / 360.0 * n))
    lat = lambda c: F.radians(F.greatest(F.least(c, F.lit(85.0511287798066)), F.lit(-85.0511287798066)))
    ty = lambda c: clip(F.floor((F.lit(1.0) - F.log(F.tan(lat(c)) + 1.0 / F.cos(lat(c))) / math.pi) / 2.0 * n))
    clean = b.isNotNull() & ~F.isnan(b["maxx"]) & ~F.isnan(b["maxy"])
    out = df.where(clean).withColumn("tile_x", F.explode(F.sequence(tx(b["minx"]), tx(b["maxx"])))).withColumn("tile_y", F.explode(F.sequence(ty(b["maxy"]), ty(b["miny"]))))
    return out.withColumn("tile", F.concat_ws("/", F.lit(str(z)), F.col("tile_x").cast("string"), F.col("tile_y").cast("string")))


def load_tile(df: DataFrame, z: int, x: int, y: int, box: str = "bbox") -> DataFrame:
    """Rows whose box meets one tile: a plain rectangle filter, so it is pushed to the files."""
    return B.filter_rect(df, tile_rect(z, x, y), box)


def semi_join(df: DataFrame, hits: DataFrame, key: str = "fid") -> DataFrame:
    """Rows whose key is among the hits."""
    return df.join(hits.select(key), key, "left_semi")


def fetch(df: DataFrame, hits: DataFrame, key: str = "fid") -> DataFrame:
    """Rows for the hits with what the hits carry, once for each hit."""
    return hits.join(df, key)
