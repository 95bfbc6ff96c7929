"""Window-like operators over byte layouts: lengths, offsets, ids, and batches of near ranges.

Plain forms take `by`, what separates layouts (say, the file), as each layout is one window. The forms
named _wide take one large layout: rows are cut into ranges, windows run within ranges, and what crosses
a border comes from a table with one row a range.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geotable.operators.storage import ranged

#: Bytes of a gap from which a new request pays.
GAP = 256 * 1024


def _w(order: list, by: list[str]) -> Window:
    return Window.partitionBy(*by).orderBy(*order)


def lengths(df: DataFrame, pos: str = "pos", offset: str = "offset", by: list[str] | None = None) -> DataFrame:
    """`df` with `length`: the next row's offset less this one's, null for the last of each group.

    `by` names what separates layouts (say, the file): without it the whole table is one layout, and one task.
    """
    return df.withColumn("length", F.lead(offset).over(_w([pos], by or [])) - F.col(offset))


def offsets(df: DataFrame, order: list, size: str = "size", by: list[str] | None = None) -> DataFrame:
    """`df` with `offset`: the sum of the sizes before, 0 for the first of each group."""
    before = _w(order, by or []).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("offset", F.coalesce(F.sum(size).over(before), F.lit(0)).cast("long"))


def ordinal(df: DataFrame, order: list, name: str = "fid", by: list[str] | None = None) -> DataFrame:
    """`df` with 0-based ids in order, per group."""
    return df.withColumn(name, (F.row_number().over(_w(order, by or [])) - 1).cast("long"))


def batched(df: DataFrame, offset: str = "offset", length: str = "length", gap: int = GAP, by: list[str] | None = None) -> DataFrame:
    """`df` with `batch`: ranges in order of offset share one as long as the gap to the range before is at most `gap` bytes."""
    if gap < 0:
        raise ValueError("a gap is at least 0")
    w = _w([offset], by or [])
    end = F.col(offset) + F.coalesce(F.col(length), F.lit(4))
    fresh = (F.col(offset) - F.lag(end).over(w) > gap).cast("int")
    marked = df.withColumn("__new", F.coalesce(fresh, F.lit(0)))
    return marked.withColumn("batch", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("__new")


def batches(df: DataFrame, offset: str = "offset", length: str = "length", gap: int = GAP, by: list[str] | None = None) -> DataFrame:
    """One row a batch: its first offset, end, number of ranges, and bytes that are read but not asked for."""
    end = F.col(offset) + F.coalesce(F.col(length), F.lit(4))
    rows = batched(df, offset, length, gap, by) if by else batched_wide(df, offset, length, gap)
    out = rows.groupBy(*(by or []), "batch").agg(F.min(offset).alias("start"), F.max(end).alias("end"), F.count(F.lit(1)).alias("ranges"), F.sum(end - F.col(offset)).alias("__used"))
    return out.withColumn("wasted", F.greatest(F.col("end") - F.col("start") - F.col("__used"), F.lit(0))).drop("__used")



def offsets_wide(df: DataFrame, order: list, size: str = "size") -> DataFrame:
    """offsets() of one large layout."""
    rows = ranged(df, order)
    sums = rows.groupBy("__group").agg(F.sum(size).alias("__s"))
    base = sums.select("__group", (F.sum("__s").over(Window.orderBy("__group")) - F.col("__s")).alias("__base"))
    own = F.coalesce(F.sum(size).over(Window.partitionBy("__group").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("__own", own).join(F.broadcast(base), "__group").withColumn("offset", (F.col("__base") + F.col("__own")).cast("long")).drop("__group", "__own", "__base")


def lengths_wide(df: DataFrame, pos: str = "pos", offset: str = "offset") -> DataFrame:
    """lengths() of one large layout."""
    rows = ranged(df, [F.col(pos)])
    firsts = rows.groupBy("__group").agg(F.min_by(offset, pos).alias("__first"))
    after = firsts.select("__group", F.lead("__first").over(Window.orderBy("__group")).alias("__after"))
    here = F.lead(offset).over(Window.partitionBy("__group").orderBy(pos))
    return rows.withColumn("__next", here).join(F.broadcast(after), "__group").withColumn("length", F.coalesce("__next", "__after") - F.col(offset)).drop("__group", "__next", "__after")


def batched_wide(df: DataFrame, offset: str = "offset", length: str = "length", gap: int = GAP) -> DataFrame:
    """batched() of one large layout."""
    if gap < 0:
        raise ValueError("a gap is at least 0")
    rows = ranged(df, [F.col(offset)]).withColumn("__end", F.col(offset) + F.coalesce(F.col(length), F.lit(4)))
    own = Window.partitionBy("__group").orderBy(offset)
    lasts = rows.groupBy("__group").agg(F.max_by("__end", offset).alias("__last"))
    before = lasts.select("__group", F.lag("__last").over(Window.orderBy("__group")).alias("__before"))
    rows = rows.withColumn("__lag", F.lag("__end").over(own)).join(F.broadcast(before), "__group")
    rows = rows.withColumn("__new", F.coalesce((F.col(offset) - F.coalesce("__lag", "__before") > gap).cast("int"), F.lit(0)))
    sums = rows.groupBy("__group").agg(F.sum("__new").alias("__s"))
    base = sums.select("__group", (F.sum("__s").over(Window.orderBy("__group")) - F.col("__s")).alias("__base"))
    run = F.sum("__new").over(own.rowsBetween(Window.unboundedPreceding, 0))
    out = rows.withColumn("__run", run).join(F.broadcast(base), "__group").withColumn("batch", (F.col("__base") + F.col("__run")).cast("long"))
    return out.drop("__group", "__end", "__lag", "__before", "__new", "__run", "__base")
