"""The packed spatial index as tables: leaves in Hilbert order, inner nodes by grouping.

A tree has fixed fan-out and no gaps, so its shape follows from the number of leaves; nodes are numbered
root first. Nodes are rows (level, pos, bbox, first_child): `pos` counts within the level from 0,
level 0 holds the leaves. Search descends level by level as a semi-join, on the reader's own count of
children, never on stored offsets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geotable.functions import bbox as B
from geotable.functions import hilbert as H
from geotable.operators.storage import cut, ranged

NODE_BYTES = 40
DEFAULT_NODE_SIZE = 16


def check_node_size(node_size: int) -> int:
    if not 2 <= node_size <= 65535:
        raise ValueError("a node has 2 to 65535 children")
    return node_size


def level_sizes(n: int, node_size: int = DEFAULT_NODE_SIZE) -> list[int]:
    """Nodes of each level, leaves first, up to the root; a single leaf has a root of its own."""
    check_node_size(node_size)
    if n < 1:
        raise ValueError("a tree has at least one leaf")
    out = [n]
    while True:
        out.append(-(-out[-1] // node_size))
        if out[-1] == 1:
            return out


def level_bounds(n: int, node_size: int = DEFAULT_NODE_SIZE) -> list[tuple[int, int]]:
    """[start, end) of each level in the root-first numbering, leaves first."""
    sizes = level_sizes(n, node_size)
    total, out = sum(sizes), []
    for size in sizes:
        out.append((total - size, total))
        total -= size
    return out


def node_count(n: int, node_size: int = DEFAULT_NODE_SIZE) -> int:
    return 0 if n == 0 else sum(level_sizes(n, node_size))


def tree_bytes(n: int, node_size: int = DEFAULT_NODE_SIZE) -> int:
    """Size of the serialized tree; 0 without leaves."""
    check_node_size(node_size)
    return node_count(n, node_size) * NODE_BYTES


def extent_of(df: DataFrame, box: str = "bbox") -> B.Rect:
    """The extent as numbers, one pass with partial aggregates; zeros for no boxes."""
    row = B.extent(df, box).first()
    return tuple(row[s] if row[s] is not None else 0.0 for s in B.SIDES)  # type: ignore[return-value]


def with_hilbert(df: DataFrame, extent: B.Rect | None = None, box: str = "bbox") -> DataFrame:
    """`df` with `hilbert`, the curve index of each box's centre in the extent (computed if not given)."""
    return df.withColumn("hilbert", H.of_box(box, extent or extent_of(df, box)))


def hilbert_sorted(df: DataFrame, extent: B.Rect | None = None, box: str = "bbox", fid: str = "fid", ascending: bool = False) -> DataFrame:
    """Rows by curve index, descending unless asked otherwise; ties by id. A range-partitioned total sort."""
    h = F.col("hilbert").asc() if ascending else F.col("hilbert").desc()
    return with_hilbert(df, extent, box).orderBy(h, F.col(fid).asc())


def clustered(df: DataFrame, partitions: int, extent: B.Rect | None = None, box: str = "bbox", fid: str = "fid") -> DataFrame:
    """Rows range-partitioned and sorted by curve index, for writing files whose statistics prune in both axes."""
    h = with_hilbert(df, extent, box)
    return h.repartitionByRange(partitions, F.col("hilbert").desc(), F.col(fid).asc()).sortWithinPartitions(F.col("hilbert").desc(), F.col(fid).asc())


def global_rank(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """`df` with `name`, the 0-based rank in `order`, without a single-partition sort.

    Rows are range-partitioned by the whole order, so a crowded spot is spread like any other, and stored
    with their partition's number, which rises along the order. Partitions are counted, the counts are summed up to
    bases (one row a partition), and rows are numbered within their partition.
    """
    rows = ranged(df, order)
    counts = rows.groupBy("__group").agg(F.count(F.lit(1)).alias("__n"))
    base = counts.select("__group", (F.sum("__n").over(Window.orderBy("__group")) - F.col("__n")).alias("__base"))
    own = F.row_number().over(Window.partitionBy("__group").orderBy(*order))
    return rows.withColumn("__row", own).join(F.broadcast(base), "__group").withColumn(name, (F.col("__base") + F.col("__row") - 1).cast("long")).drop("__group", "__row", "__base")


def leaves(df: DataFrame, extent: B.Rect | None = None, box: str = "bbox", fid: str = "fid") -> DataFrame:
    """`df` with `hilbert` and `pos`, the place of each row among the tree's leaves (descending curve index, then id)."""
    return global_rank(with_hilbert(df, extent, box), [F.col("hilbert").desc(), F.col(fid).asc()], "pos")


def level_up(nodes: DataFrame, node_size: int) -> DataFrame:
    """(pos, bbox, first_child) of the next level: each `node_size` consecutive nodes become one with the box around theirs."""
    up = nodes.groupBy((F.floor(F.col("pos") / node_size)).cast("long").alias("__pos")).agg(*B.extent_columns("bbox"), F.min("pos").alias("first_child"))
    return up.select(F.col("__pos").alias("pos"), B.make("minx", "miny", "maxx", "maxy").alias("bbox"), "first_child")


def build(df: DataFrame, node_size: int = DEFAULT_NODE_SIZE, extent: B.Rect | None = None, box: str = "bbox", fid: str = "fid") -> DataFrame:
    """All nodes (level, pos, bbox, first_child); a leaf's first_child is its row's id. An empty table has no nodes."""
    check_node_size(node_size)
    # each level is stored, as the one above reads it; its number stays a literal, so that a search plans just the level it asks for
    level = cut(leaves(df.select(fid, box), extent, box, fid).select("pos", F.col(box).alias("bbox"), F.col(fid).cast("long").alias("first_child")))
    numbered = lambda d, i: d.select(F.lit(i).alias("level"), "pos", "bbox", "first_child")
    n, out = level.count(), numbered(level, 0)
    for i, _ in enumerate(level_sizes(n, node_size)[1:] if n else [], 1):
        level = cut(level_up(level, node_size))
        out = out.union(numbered(level, i))
    return out


def search(nodes: DataFrame, rect: B.Rect, node_size: int = DEFAULT_NODE_SIZE) -> DataFrame:
    """(pos, fid) of the leaves whose box meets the rectangle, by descending through the levels.

    Each level keeps the nodes that meet the rectangle and whose parent (pos div node_size) was kept; what an inner
    level keeps is stored, so plans stay short.
    """
    check_node_size(node_size)
    top = nodes.agg(F.max("level")).first()[0]
    kept = None
    for level in range(top if top is not None else 0, -1, -1):
        here = nodes.where((F.col("level") == level) & B.intersects("bbox", rect))
        if kept is not None:
            parents = kept.select(F.col("pos").alias("__parent"))
            here = here.join(parents, F.floor(F.col("pos") / node_size).cast("long") == F.col("__parent"), "left_semi")
        kept = cut(here.select("pos", "first_child")) if level else here
    return kept.select("pos", F.col("first_child").alias("fid"))


def dump(nodes: DataFrame, n: int, node_size: int = DEFAULT_NODE_SIZE) -> DataFrame:
    """Nodes as features: level, pos, position in the root-first numbering, byte offset, and the box as a polygon."""
    from geotable.functions import geometry as G

    starts = [a for a, _ in level_bounds(n, node_size)] if n else [0]
    at = F.element_at(F.array(*[F.lit(a).cast("long") for a in starts]), F.col("level") + 1) + F.col("pos")
    return nodes.select("level", "pos", at.alias("position"), (at * NODE_BYTES).alias("offset"), "bbox", G.of_box("bbox").alias("geometry"))


def lookup(df: DataFrame, fids: list[int], count: int | None = None, fid: str = "fid") -> DataFrame:
    """Rows by id; ids at or beyond a known count are an error. The id list becomes a pushed IN filter or a small broadcast."""
    if any(f < 0 or count is not None and f >= count for f in fids):
        raise IndexError("an id is out of range")
    if len(fids) <= 1000:
        return df.where(F.col(fid).isin(*fids)) if fids else df.limit(0)
    ids = df.sparkSession.createDataFrame([(f,) for f in sorted(set(fids))], "__id long")
    return df.join(F.broadcast(ids) if len(fids) <= 1_000_000 else ids, F.col(fid) == F.col("__id"), "left_semi")


def offsets_of(sizes: DataFrame, positions: list[int] | DataFrame, pos: str = "pos", offset: str = "offset") -> DataFrame:
    """Byte offsets of leaves by position, of a table with offsets."""
    if isinstance(positions, DataFrame):
        return sizes.join(positions, pos, "left_semi").select(pos, offset)
    return lookup(sizes, positions, fid=pos).select(pos, offset)
