"""Sharding by a Hilbert curve over quantised metadata.

Several metadata dimensions are quantised to a few bits each, every row gets the index of its cell
on the Hilbert curve through the grid, and the rows in curve order are cut into runs, the shards.
Neighbouring cells share shards, so min/max statistics of a shard prune in every dimension at once.

The global rank needs no total sort: cells are counted (a bounded grid), a cell that holds many rows
is split into buckets, and ranks are the counts before a (cell, bucket) plus the row number in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from geotable.llm.common import cut
from geotable.operators.storage import ranged

#: Rows that one window group holds on average at most, however hot a cell is.
ROWS_IN_BUCKET = 500_000


def hilbert_index(point: tuple[int, ...], bits: int) -> int:
    """Index of a grid point on the Hilbert curve (transpose form of the coordinates, then interleaving)."""
    x, n = list(point), len(point)
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(n):
            if x[i] & q:
                x[0] ^= q - 1
            else:
                t = (x[0] ^ x[i]) & (q - 1)
                x[0] ^= t
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = 0, 1 << (bits - 1)
    while q > 1:
        if x[n - 1] & q:
            t ^= q - 1
        q >>= 1
    x = [v ^ t for v in x]
    h = 0
    for b in range(bits - 1, -1, -1):
        for v in x:
            h = h << 1 | v >> b & 1
    return h


def curve(dims: int, bits: int) -> list[int]:
    """Hilbert index of each cell; cells are numbered with the first dimension in the highest bits."""
    side = 1 << bits
    return [hilbert_index(tuple(c >> bits * (dims - 1 - d) & side - 1 for d in range(dims)), bits) for c in range(side**dims)]


def text_marks(df: DataFrame, dim: str, side: int) -> list[str]:
    """side - 1 quantiles of a dimension's values as text, in byte order and by their counts over all rows; the i-th is the least value up to which i / side of the rows lie.

    Values are counted, the counts are ranged by value and summed up within ranges, so just the marks come to the driver.
    """
    counts = df.select(F.col(f"`{dim}`").cast("string").alias("v")).where("v is not null").groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    counts = ranged(counts, [F.col("v")])
    shares = counts.groupBy("__group").agg(F.sum("n").alias("m"))
    base = shares.select("__group", (F.sum("m").over(Window.orderBy("__group")) - F.col("m")).alias("base"))  # one row a range
    total = shares.agg(F.sum("m")).first()[0]
    if not total:
        return []
    upto = F.col("base") + F.sum("n").over(Window.partitionBy("__group").orderBy("v"))
    marks = counts.join(F.broadcast(base), "__group").withColumn("upto", upto)
    marks = marks.select("v", F.expr(f"((upto - n) * {side}) DIV {total} + 1").alias("lo"), F.expr(f"LEAST((upto * {side}) DIV {total}, {side - 1})").alias("hi"))
    got = marks.where("hi >= lo").collect()  # no more than side - 1 rows
    return [r["v"] for r in sorted(got, key=lambda r: r["lo"]) for _ in range(r["lo"], r["hi"] + 1)]


def quantised(df: DataFrame, dims: list[str], bits: int) -> list[Column]:
    """One expression with values 0 to 2^bits - 1 for each dimension.

    Values are cut at quantiles that are taken over all rows (2^bits - 1 values for each), numbers by
    their size and other types as text in byte order. So cells keep the order of values, and a shard's
    least and largest value prune. A null, or NaN, is in cell 0.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields}
    numeric = [d for d in dims if isinstance(kinds[d], T.NumericType)]
    side = 1 << bits
    marks = {}
    if numeric:
        at = [i / side for i in range(1, side)]
        got = df.agg(*[F.percentile_approx(F.nanvl(F.col(f"`{d}`").cast("double"), F.lit(None)), at, 1000).alias(f"q{i}") for i, d in enumerate(numeric)]).first()
        marks = {d: got[i] or [] for i, d in enumerate(numeric)}
    out = []
    for d in dims:
        c = F.col(f"`{d}`")
        if d in marks:
            e = sum(((F.nanvl(c.cast("double"), F.lit(None)) > F.lit(float(m))).cast("int") for m in marks[d]), F.lit(0))
        else:
            e = sum(((c.cast("string") > F.lit(m)).cast("int") for m in text_marks(df, d, side)), F.lit(0))
        out.append(F.coalesce(e, F.lit(0)))
    return out


def hilbert_shards(df: DataFrame, dims: list[str], n_shards: int, tie: str, bits: int = 4) -> DataFrame:
    """`df` with `hilbert` int, `shard` int (0 to n_shards - 1) and `slot` long, in curve order.

    Counts of shards differ by one at most; slots are gapless from 0 in each shard. Rows of one cell
    are ordered by `tie`. Columns of `df` with those three names are replaced; all others stay.
    Nulls go to cell 0 of their dimension; repeated rows get slots of their own; an empty table
    gives an empty table; with fewer rows than shards some shards stay empty.
    """
    if n_shards < 1 or not 1 <= bits * len(dims) <= 12:
        raise ValueError("n_shards must be at least 1 and the grid 1 to 12 bits")
    spark = df.sparkSession
    own = [c for c in df.columns if c not in ("hilbert", "shard", "slot")]
    kept = cut(df)
    cell = F.lit(0)
    for q in quantised(kept, dims, bits):
        cell = F.shiftleft(cell, bits).bitwiseOR(q)
    n = kept.count()
    buckets = max(1, -(-n // ROWS_IN_BUCKET))
    table = F.expr("array(" + ",".join(map(str, curve(len(dims), bits))) + ")")
    spread = F.pmod(F.xxhash64(F.col(f"`{tie}`")), F.lit(buckets)).cast("int")
    keyed = kept.select(*[F.col(f"`{c}`") for c in own], F.element_at(table, cell + 1).alias("hilbert"), spread.alias("__bucket"))

    counts = keyed.groupBy("hilbert", "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    cells = counts.groupBy("hilbert").agg(F.sum("__n").alias("__n"))  # no more rows than the grid has cells
    before = cells.select("hilbert", (F.sum("__n").over(Window.orderBy("hilbert")) - F.col("__n")).alias("__before"))
    inside = Window.partitionBy("hilbert").orderBy("__bucket")
    base = counts.select("hilbert", "__bucket", (F.sum("__n").over(inside) - F.col("__n")).alias("__inside"))
    base = base.join(F.broadcast(before), "hilbert").select("hilbert", "__bucket", (F.col("__before") + F.col("__inside")).alias("__base"))

    own_order = Window.partitionBy("hilbert", "__bucket").orderBy(F.col(f"`{tie}`").asc_nulls_first())
    ranked = keyed.withColumn("__row", F.row_number().over(own_order)).join(base, ["hilbert", "__bucket"])
    rank = F.col("__base") + F.col("__row") - 1
    ranked = ranked.withColumn("__rank", rank)
    total, k = F.lit(n).cast("long"), F.lit(n_shards).cast("long")
    ranked = ranked.withColumn("shard", F.expr(f"CAST(((__rank + 1) * {n_shards}L - 1) DIV {max(n, 1)}L AS INT)"))
    return ranked.select(
        *[F.col(f"`{c}`") for c in own],
        "hilbert",
        "shard",
        (F.col("__rank") - F.expr(f"(CAST(shard AS LONG) * {n}L) DIV {n_shards}L")).alias("slot"),
    )


def write_shards(df: DataFrame, path: str, n_shards: int) -> None:
    """The shards as files under `path`/shard=N, rows in slot order; a hot shard takes one task, shards are of equal size."""
    df.repartitionByRange(n_shards, "shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op1_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of equal counts along the curve over source, lang, and size (quantiles of each over all rows)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        "doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), "source", "lang"
    )
    out = hilbert_shards(docs, ["source", "lang", "size"], 24, "doc_id")
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert")
