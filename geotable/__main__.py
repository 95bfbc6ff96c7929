"""python -m geotable convert|info: between GeoJSON, the binary layout and Parquet, and what files hold."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geotable.functions import geometry as G
from geotable.operators import index as X
from geotable.sources import binary, geojson

FORMATS = ("geojson", "geojsonl", "features", "parquet", "wkt")


def load(spark: SparkSession, path: str, kind: str) -> DataFrame:
    if kind in ("geojson", "geojsonl"):
        return geojson.read(spark, path, lines=kind == "geojsonl")
    if kind == "parquet":
        return spark.read.parquet(path)
    return binary.read(spark, path)


def save(df: DataFrame, path: str, kind: str, index: bool) -> None:
    if kind in ("geojson", "geojsonl"):
        geojson.write(df, path, lines=kind == "geojsonl")
    elif kind == "wkt":
        df.select(G.to_wkt("geometry").alias("value")).write.text(path)
    elif kind == "parquet":
        (X.clustered(df, df.sparkSession.sparkContext.defaultParallelism) if index else df).write.parquet(path)
    else:
        binary.write(df, path, index=str(index).lower())


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="geotable", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("convert")
    for name in ("--input", "--output"):
        c.add_argument(name, required=True)
    c.add_argument("--inputformat", choices=FORMATS[:4], default="geojson")
    c.add_argument("--outputformat", choices=FORMATS, default="features")
    c.add_argument("--index", action=argparse.BooleanOptionalAction, default=True)
    i = sub.add_parser("info")
    i.add_argument("--input", required=True)
    i.add_argument("--index", action="store_true", help="the index's nodes")
    i.add_argument("--dump", type=int, help="the feature with this id")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("geotable").getOrCreate()
    if a.command == "convert":
        save(load(spark, a.input, a.inputformat), a.output, a.outputformat, a.index)
    elif a.index:
        binary.read(spark, a.input, table="index").orderBy("path", F.col("level").desc(), "pos").show(100, truncate=False)
    elif a.dump is not None:
        binary.read(spark, a.input).where(F.col("fid") == a.dump).withColumn("geometry", G.to_wkt("geometry")).show(truncate=False, vertical=True)
    else:
        binary.header_info(spark, a.input).show(truncate=False, vertical=True)


if __name__ == "__main__":
    main()
