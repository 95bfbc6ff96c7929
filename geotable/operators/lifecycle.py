"""Counting, skipping, picking and describing datasets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geotable.functions import bbox as B
from geotable.functions import geometry as G

#: Attribute types of the binary format, in the order of their codes, as Spark types.
ATTRIBUTES = (
    ("Byte", "tinyint"), ("UByte", "smallint"), ("Bool", "boolean"), ("Short", "smallint"), ("UShort", "int"), ("Int", "int"), ("UInt", "bigint"), ("Long", "bigint"),
    ("ULong", "decimal(20,0)"), ("Float", "float"), ("Double", "double"), ("String", "string"), ("Json", "string"), ("DateTime", "string"), ("Binary", "binary"),
)
_CODES = {T.ByteType: 0, T.BooleanType: 2, T.ShortType: 3, T.IntegerType: 5, T.LongType: 7, T.FloatType: 9, T.DoubleType: 10, T.StringType: 11, T.BinaryType: 14, T.TimestampType: 13, T.DateType: 13, T.TimestampNTZType: 13}


def attribute_code(field: T.StructField) -> int:
    """Code of a field's attribute type; field metadata `attribute_type` (a name) wins, decimals of scale 0 are ULong, other types Json."""
    named = (field.metadata or {}).get("attribute_type")
    if named:
        return [n for n, _ in ATTRIBUTES].index(named)
    if isinstance(field.dataType, T.DecimalType):
        return 8 if field.dataType.scale == 0 else 10
    return _CODES.get(type(field.dataType), 12)


def count(df: DataFrame, rect: B.Rect | None = None, box: str = "bbox") -> DataFrame:
    """One row: features, optionally of a rectangle. Only the box's columns are read."""
    rows = B.filter_rect(df.select(box), rect, box) if rect else df
    return rows.agg(F.count(F.lit(1)).alias("features_count"))


def skip(df: DataFrame, n: int, fid: str = "fid") -> DataFrame:
    """Rows in order of id after the first n; none are skipped for a negative n, none left beyond the end."""
    return df.orderBy(fid).offset(max(n, 0))


def nth(df: DataFrame, n: int, fid: str = "fid") -> DataFrame:
    """The row with id n."""
    return df.where(F.col(fid) == n)


def first(df: DataFrame, n: int, fid: str = "fid") -> DataFrame:
    """The first n rows in order of id (a distributed top-n)."""
    return df.orderBy(fid).limit(n)


def attributes(df: DataFrame) -> list[T.StructField]:
    """Fields that are neither id, box, geometry nor curve index."""
    return [f for f in df.schema.fields if f.name not in ("fid", "bbox", "geometry", "hilbert")]


def properties(df: DataFrame, fields: list[str] | None = None) -> Column:
    """All attributes as a map of text; nulls are left out, as in a sparse row."""
    names = fields or [f.name for f in attributes(df)]
    entries = F.array(*[F.struct(F.lit(n).alias("key"), F.col(f"`{n}`").cast("string").alias("value")) for n in names])
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))


def header(df: DataFrame, name: str | None = None, node_size: int = 16, srid: int = 0, title: str | None = None, description: str | None = None, metadata: str | None = None) -> DataFrame:
    """One row that describes a dataset: envelope, common geometry type, dimensions, columns, count.

    One pass with partial aggregates. Without rows the envelope is null, the count 0.
    """
    kind = next((f.dataType for f in df.schema.fields if f.name == "geometry"), None)
    columns = F.array(
        *[
            F.struct(
                F.lit(f.name).alias("name"), F.lit(attribute_code(f)).cast("tinyint").alias("type"), *[F.lit((f.metadata or {}).get(k)).cast("string").alias(k) for k in ("title", "description")],
                *[F.lit((f.metadata or {}).get(k, -1)).cast("int").alias(k) for k in ("width", "precision", "scale")], F.lit(f.nullable).alias("nullable"),
                *[F.lit(bool((f.metadata or {}).get(k, False))).alias(k) for k in ("unique", "primary_key")], F.lit((f.metadata or {}).get("metadata")).cast("string").alias("metadata"),
            )
            for f in attributes(df)
        ]
    )
    flags = [F.coalesce(F.bool_or(c), F.lit(False)).alias(n) for n, c in (("has_z", G.has_z("geometry")), ("has_m", G.has_m("geometry")))] if kind is not None else [F.lit(False).alias("has_z"), F.lit(False).alias("has_m")]
    code = F.coalesce(G.common_type("geometry.type"), F.lit(0)).cast("tinyint") if kind is not None else F.lit(0).cast("tinyint")
    found = df.agg(*B.extent_columns("bbox"), code.alias("geometry_type"), *flags, F.count(F.lit(1)).alias("n"))
    text = lambda v, n: F.lit(v).cast("string").alias(n)
    crs = F.struct(text(None, "org"), F.lit(srid).alias("code"), text(None, "name"), text(None, "description"), text(None, "wkt"), text(None, "code_string"))
    envelope = F.when(F.col("minx").isNotNull(), F.array("minx", "miny", "maxx", "maxy"))
    return found.select(
        text(name, "name"), envelope.alias("envelope"), "geometry_type", "has_z", "has_m", F.lit(False).alias("has_t"), F.lit(False).alias("has_tm"), columns.alias("columns"),
        F.col("n").cast("decimal(20,0)").alias("features_count"), F.lit(node_size).alias("index_node_size"), crs.alias("crs"), text(title, "title"), text(description, "description"), text(metadata, "metadata"),
    )


def infer_geometry_type(df: DataFrame, geometry: str = "geometry") -> DataFrame:
    """One row with the type that all geometries share, else Unknown (0)."""
    return df.agg(F.coalesce(G.common_type(F.col(geometry)["type"]), F.lit(0)).cast("tinyint").alias("geometry_type"))


def binned(value: Column | str, thresholds: list[float], labels: list[str]) -> Column:
    """The label of the first threshold, from the highest, that a value exceeds; the last label for none."""
    c = F.col(value) if isinstance(value, str) else value
    out = F.lit(labels[-1])
    for t, label in sorted(zip(thresholds, labels, strict=False)):
        out = F.when(c > t, F.lit(label)).otherwise(out)
    return out
