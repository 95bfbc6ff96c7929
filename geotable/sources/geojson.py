"""GeoJSON feature collections and lines of features, read and written with built-in JSON functions."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geotable.functions import geometry as G
from geotable.operators.index import global_rank
from geotable.operators.lifecycle import attributes
from geotable.operators.storage import cut
from geotable.sources import collections
from geotable.sources.ranged import filesystem

#: Bytes of a collection that a task reads, and members in a batch.
PIECE, ROWS = 8 << 20, 1000
LAST = (1 << 63) - 1
#: Files that can't be read from the middle, so one task reads the whole.
PACKED = (".gz", ".bz2", ".zst", ".lz4")


def read(spark: SparkSession, path: str, properties: str | T.StructType | None = None, lines: bool = False, infer: str = "all") -> DataFrame:
    """Features as rows: fid, bbox, geometry, then the properties as columns.

    `lines` reads one feature a line; otherwise a file is one collection (or one feature), whose members that are no objects
    are left out. Both split large files, the latter after a task has followed a file's brackets.
    Without a schema for the properties it is inferred, from all features or (infer="first_row") from the first. fid is the
    place in the file order (by file, then by place). A null geometry gives a null geometry and box; a missing
    property gives null.
    """
    if lines:
        raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
        rows = raw.where(F.trim("value") != "").withColumn("at", F.monotonically_increasing_id()).select("file", "block", "at", F.col("value").alias("feature"))
    else:
        rows = _members(spark, path)
    feature = F.col("feature")
    rows = rows.select("file", "block", "at", G.from_geojson(F.get_json_object(feature, "$.geometry")).alias("geometry"), F.get_json_object(feature, "$.properties").alias("p"))
    if properties is None:
        known = rows.where("p is not null").select("p")
        known = known.limit(1) if infer == "first_row" else known
        found = known.agg(F.schema_of_variant_agg(F.try_parse_json("p"))).first()[0]
        inferred = _as_struct(found) if found and found.startswith("OBJECT<") else T.StructType()
        properties = inferred
    kind = T._parse_datatype_string(properties) if isinstance(properties, str) else properties
    out = global_rank(rows, [F.col("file"), F.col("block"), F.col("at")], "fid")
    if not kind.fields:
        return out.select("fid", G.bbox("geometry").alias("bbox"), "geometry")
    return out.withColumn("p", F.from_json("p", kind)).select("fid", G.bbox("geometry").alias("bbox"), "geometry", "p.*")


def _members(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, at, feature): the members of each file's collection. A task a file follows brackets to cut it into pieces of about PIECE bytes, which other tasks read."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"))
    files = files.repartition(max(1, min(files.count(), 10_000)))

    def cuts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file in b.column(0).to_pylist():
                with _opened(file) as f:
                    for some in collections.pieces(f.read, 1 << 62 if file.endswith(PACKED) else PIECE):
                        yield pa.RecordBatch.from_pydict({"file": [file], "block": [some[0]], "end": [some[1]]})

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, start, end in zip(*[c.to_pylist() for c in b.columns], strict=True):
                with _opened(file) as f:
                    f.read(start) if file.endswith(PACKED) else f.seek(start)
                    found = collections.members(f.read(end - start))
                for k in range(0, len(found), ROWS):
                    some = found[k : k + ROWS]
                    yield pa.RecordBatch.from_pydict({"file": [file] * len(some), "block": [start] * len(some), "at": list(range(k, k + len(some))), "feature": [v.decode("utf-8", "replace") for v in some]})

    found = cut(files.mapInArrow(cuts, "file string, block long, end long"))
    tasks = max(1, min(found.count(), 10_000))
    rows = found.repartition(tasks).mapInArrow(members, "file string, block long, at long, feature string")
    return rows.where((F.col("block") > 0) | (F.get_json_object("feature", "$.type") == "Feature"))


def _opened(file: str):
    system, inner = filesystem("/" + file[5:].lstrip("/") if file.startswith("file:") else file.replace("s3a://", "s3://", 1))
    return system.open_input_stream(inner) if file.endswith(PACKED) else system.open_input_file(inner)


def _as_struct(found: str) -> str:
    """A variant's schema as a struct: whole numbers are bigint, others double, what has no type or several is text."""
    parts = re.split(r"(`(?:[^`]|``)*`)", found)  # quoted names stay as they are
    for i in range(0, len(parts), 2):
        parts[i] = re.sub(r"DECIMAL\(\d+,\d+\)", "DOUBLE", re.sub(r"\b(VARIANT|VOID)\b(?!:)", "STRING", parts[i].replace("OBJECT<", "STRUCT<")))
    return "".join(parts)


def features(df: DataFrame) -> DataFrame:
    """One column `value`: each row as a GeoJSON feature."""
    names = [f.name for f in attributes(df)]
    props = F.to_json(F.struct(*[F.col(f"`{n}`") for n in names])) if names else F.lit("{}")
    geometry = F.coalesce(G.to_geojson("geometry"), F.lit("null"))
    return df.select(F.concat(F.lit('{"type":"Feature","geometry":'), geometry, F.lit(',"properties":'), props, F.lit("}")).alias("value"))


def write(df: DataFrame, path: str, lines: bool = True) -> None:
    """Lines of features (many files), or one collection (one file, written by a single task, a feature a line)."""
    rows = features(df)
    if lines:
        rows.write.text(path)
        return
    # rows keep their order on the way to the one task that writes, which holds none of them
    ends = df.sparkSession.createDataFrame([('{"type":"FeatureCollection","features":[', -1), ("]}", LAST)], "value string, at long")
    placed = rows.withColumn("at", F.monotonically_increasing_id()).union(ends).repartition(1).sortWithinPartitions("at")
    first = F.monotonically_increasing_id() <= 1
    placed.select(F.concat(F.when(first | (F.col("at") == LAST), F.lit("")).otherwise(F.lit(",")), "value").alias("value")).write.text(path)
