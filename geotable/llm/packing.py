"""Packing of token sequences: non-negative least squares over length combinations.

Whole windows are cut off first, so what is left of a document is shorter than a window. Those
remainders are packed by their histogram, which has one bin for each length however many documents
there are: shallow combinations of lengths that fill a window are enumerated, non-negative least
squares finds how often to repeat each so that the histogram is used up, counts are rounded down, and
what is left is packed greedily, longest first. The plan says which ranks of a length go where; ranks
come from a window over (length, bucket), so nothing but the histogram reaches the driver.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geotable.llm import bpe
from geotable.llm.common import batches, cut, mapped, text_or_empty

#: Pieces of one length that one window group holds on average at most.
ROWS_IN_BUCKET = 500_000


def combinations(counts: np.ndarray, window: int) -> list[tuple[int, ...]]:
    """Shallow combinations that fill the window: pairs and triples of lengths that occur.

    For each length, longest first, its exact partner (or the longest that fits) and triples with the
    two-part splits of the rest; at most four combinations a length, so their number is bounded by
    the window.
    """
    have = np.flatnonzero(counts)
    out: dict[tuple[int, ...], None] = {}
    below = np.zeros(window + 1, dtype=int)  # the longest length that occurs and is at most i
    for n in range(1, window + 1):
        below[n] = n if n < len(counts) and counts[n] else below[n - 1]
    for a in map(int, have[::-1]):
        rest = window - a
        if b := int(below[rest]):
            out[tuple(sorted((a, b), reverse=True))] = None
        for share in (2, 3, 4):
            if b := int(below[rest // share]):
                if c := int(below[rest - b]):
                    out[tuple(sorted((a, b, c), reverse=True))] = None
    return list(out)


def nnls(sets: list[tuple[int, ...]], b: np.ndarray, rounds: int = 300) -> np.ndarray:
    """min |Ax - b| with x >= 0, where A[n, j] says how often combination j has length n, by accelerated projected gradients.

    A is kept as its few entries, so memory follows the number of combinations.
    """
    k = len(sets)
    col = np.repeat(np.arange(k), [len(s) for s in sets])
    row = np.fromiter((n for s in sets for n in s), np.int64, len(col))
    times = lambda x: np.bincount(row, x[col], minlength=len(b))
    back = lambda r: np.bincount(col, r[row], minlength=k)
    v = np.ones(k)
    for _ in range(30):  # the largest eigenvalue, for the step
        v = back(times(v))
        norm = float(np.linalg.norm(v)) or 1.0
        v /= norm
    step = 1 / (1.05 * norm)
    x = y = np.zeros(k)
    t = 1.0
    for _ in range(rounds):
        z = np.maximum(y - step * back(times(y) - b), 0)
        u = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, x, t = z + (t - 1) / u * (z - x), z, u
    return x


def plan(counts: dict[int, int], window: int) -> list[tuple[tuple[int, ...], int]]:
    """Combinations of lengths (each at most the window) and how often each is used; every piece is placed.

    First by non-negative least squares, rounded down and held to what is there; the residual by best
    fit, longest first, taking as many at once as the scarcest length of the combination allows.
    """
    left = np.zeros(window + 1, dtype=np.int64)
    for n, k in counts.items():
        left[n] = k
    out: list[tuple[tuple[int, ...], int]] = []
    sets = combinations(left[:window], window)
    if sets:
        x = nnls(sets, left.astype(float))
        waste = [window - sum(s) for s in sets]
        for j in sorted(range(len(sets)), key=lambda j: (waste[j], -x[j])):
            need = {n: sets[j].count(n) for n in sets[j]}
            k = min(int(x[j]), *(int(left[n]) // m for n, m in need.items()))
            if k > 0 and waste[j] * 50 <= window:
                out.append((sets[j], k))
                for n, m in need.items():
                    left[n] -= k * m
    while (have := np.flatnonzero(left)).size:
        pieces, room, taken = [], window, {}
        while True:
            fit = have[(have <= room)]
            fit = [n for n in fit[::-1] if left[n] > taken.get(int(n), 0)][:1]
            if not fit:
                break
            n = int(fit[0])
            pieces.append(n)
            taken[n] = taken.get(n, 0) + 1
            room -= n
        k = min(int(left[n]) // m for n, m in taken.items())
        out.append((tuple(pieces), k))
        for n, m in taken.items():
            left[n] -= k * m
    return out


def placed(steps: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """Rows (length, first rank, end rank, first sequence, offset): the piece of that length and rank r goes to sequence first + r - first rank."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for pieces, k in steps:
        offset = 0
        for n in pieces:
            r = used.get(n, 0)
            rows.append((n, r, r + k, sequence, offset))
            used[n] = r + k
            offset += n
        sequence += k
    return rows


def pieces(df: DataFrame, path: str, window: int, end: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Whole windows and the remainder of each document's ids (its tokens, then `end`), without the ids themselves."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = bpe.get(path)
        for b in batches(it):
            rows: list[list] = [[], [], [], [], []]
            for i, x in enumerate(b.column(1).to_pylist()):
                ids = np.asarray([*encoder.ids(x), end], dtype="<u4")
                for start in range(0, len(ids), window):
                    part = ids[start : start + window]
                    for col, v in zip(rows, (i, start, len(part), zlib.crc32(part.tobytes()), len(ids)), strict=True):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows[0], pa.int32())), *[pa.array(c, pa.int64()) for c in rows[1:]]], names=["key", "start", "length", "ids_crc32", "doc_tokens"])

    kind = df.schema[key].dataType.simpleString()
    return mapped(df.select(F.col(f"`{key}`").alias("key"), text_or_empty(f"`{text}`")), run, f"key {kind}, start long, length long, ids_crc32 long, doc_tokens long")


def pack(df: DataFrame, path: str, window: int = 2048, end: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each piece: `key`, start, length, ids_crc32, doc_tokens, sequence_id, offset (all long but the key).

    A null or empty text is the end id alone. Long texts are cut at multiples of the window and
    nowhere else. Repeated rows are documents of their own. An empty table gives no rows.
    Sequences are numbered without gaps; in each, pieces lie without gaps from offset 0.
    """
    spark = df.sparkSession
    cuts = cut(pieces(df, path, window, end, key, text))
    histogram = {r["length"]: r["n"] for r in cuts.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `window` rows
    whole = histogram.pop(window, 0)
    rows = [(n, a, b, s + whole, o) for n, a, b, s, o in placed(plan(histogram, window))]
    if whole:
        rows.append((window, 0, whole, 0, 0))
    spots = spark.createDataFrame(rows, "length long, first long, last long, sequence long, offset long")  # bounded by the window, not by the data

    most = max(histogram.values(), default=1)
    buckets = max(1, -(-max(most, whole) // ROWS_IN_BUCKET))
    spread = cuts.withColumn("bucket", F.pmod(F.xxhash64("key", "start"), F.lit(buckets)).cast("int"))
    counts = spread.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    base = counts.select("length", "bucket", (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("base"))
    order = Window.partitionBy("length", "bucket").orderBy("key", "start")
    ranked = spread.withColumn("row", F.row_number().over(order)).join(base, ["length", "bucket"]).withColumn("rank", F.col("base") + F.col("row") - 1)
    at = (ranked["length"] == spots["length"]) & (ranked["rank"] >= spots["first"]) & (ranked["rank"] < spots["last"])
    return ranked.join(F.broadcast(spots), at).select(
        ranked["key"].alias(key), "start", ranked["length"], "ids_crc32", "doc_tokens", (F.col("sequence") + F.col("rank") - F.col("first")).alias("sequence_id"), "offset"
    )


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens, id 1 after each document."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
