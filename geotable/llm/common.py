"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geotable.operators.storage import cut, shared_dir

__all__ = ["batches", "cut", "looked_up", "mapped", "shared_dir", "text_or_empty", "weighed"]

#: Bytes of a table that may be broadcast, as weighed() has them.
BROADCAST_BYTES = 32 << 20
#: Parts in which a hot key of a lookup that can't be broadcast is spread.
SALTS = 16


#: Rows and bytes of an Arrow batch between JVM and Python; both sides hold a few batches for each task.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def mapped(df: DataFrame, run, schema) -> DataFrame:
    """mapInArrow over small batches: lowers the session's batch limits to BATCH_ROWS and BATCH_BYTES, and leaves lower ones.

    By default a batch holds 10,000 rows, and with long texts that is more than a small executor has
    outside its heap.
    """
    conf = df.sparkSession.conf
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        now = int("".join(c for c in conf.get(key) or "" if c.isdigit()) or 0)
        if not 0 < now <= most:
            conf.set(key, f"{most}b" if name == "maxBytesPerBatch" else str(most))

    def freeing(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(it)
        freed()

    return df.mapInArrow(freeing, schema)


def freed() -> None:
    """Give a finished task's memory back to the system: workers live on for the next stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def weighed(df: DataFrame) -> int:
    """Bytes of a table in memory, about: its rows as JSON and 64 for each; a pass over the table, so it is for written ones."""
    n, size = df.agg(F.count(F.lit(1)), F.sum(F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))))).first()
    return 64 * n + (size or 0)


def looked_up(rows: DataFrame, table: DataFrame, key: str, how: str = "left") -> DataFrame:
    """`rows` joined with `table`, which has each `key` once: broadcast up to BROADCAST_BYTES, else shuffled with every key in SALTS parts."""
    if weighed(table) <= BROADCAST_BYTES:
        return rows.join(F.broadcast(table), key, how)
    salted = rows.withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    copies = table.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, [key, "__salt"], how).drop("__salt")


def batches(it: Iterator[pa.RecordBatch], rows: int = 512, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of Arrow batches with at most `rows` rows and about `size` bytes each (one row at least)."""
    for b in it:
        n = b.num_rows
        if not n:
            continue
        step = max(1, min(rows, n * size // max(1, b.nbytes)))
        for i in range(0, n, step):
            yield b.slice(i, step)
