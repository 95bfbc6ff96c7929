"""Tables in the folder that all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: What this process has written, for sweep().
_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir where it is set.

    Where it is unset, a local session (as in tests) uses a temporary folder; on a cluster that would be
    another folder on each machine, so there it is an error.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir is to name a folder that all executors share")
        at = "file://" + os.path.join(tempfile.gettempdir(), "geotable-shared")
    return at.rstrip("/")


def scratch(spark: SparkSession, kind: str) -> str:
    """A new path in the shared folder, known to sweep()."""
    path = f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Write `df` once to the shared folder and read it back.

    Lineage ends at the written files, which outlive executors, so a lost executor costs only
    the tasks that it ran.
    """
    path = scratch(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ranged(df: DataFrame, order: list) -> DataFrame:
    """`df` range-partitioned by the whole `order` and stored, with __group, the partition's number, which rises along the order.

    Ranges are sampled, so a crowded value is split as long as `order` tells its rows apart; a group is one task's share.
    """
    return cut(df.repartitionByRange(*order).withColumn("__group", F.spark_partition_id()))


def mark() -> int:
    """A point in time for sweep()."""
    return len(_written)


def sweep(spark: SparkSession, since: int = 0, keep: DataFrame | None = None) -> None:
    """Delete what cut() has written in this process (since a mark()), but for the files of `keep`; to be called when no other DataFrame that reads it is needed any more."""
    kept = keep.inputFiles() if keep is not None else []
    jvm, spared = spark._jvm, []
    while len(_written) > since:
        at = _written.pop()
        if any(f"/{at.rpartition('/')[2]}/" in f for f in kept):
            spared.append(at)
            continue
        path = jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    _written.extend(spared)
