"""Benchmark decontamination by pigeonhole edit matching.

A test item with an error budget of k edits is split into k + 1 pieces. If a document holds the item
within k edits, at least one piece stands in it unchanged. An automaton of all pieces finds such exact
hits in one pass over the text; around each hit Myers' bit-parallel distance verifies the whole item.
Texts are compared in normal form: lower case, runs of anything but letters and digits as one space.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from geotable.llm.common import batches, mapped, text_or_empty

_GAP = re.compile(r"[\W_]+")
#: Characters of items that are searched in one pass (an automaton takes about 50 bytes for each); more items make more passes.
BLOCK_CHARS = 4_000_000


def normal(text: str) -> str:
    return _GAP.sub(" ", text.lower()).strip()


def budget(length: int, share: float) -> int:
    """Edits that an item of this length may have."""
    return int(length * share)


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """k + 1 pieces of almost equal length, with their offsets."""
    n = k + 1
    cuts = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]


class Item:
    """Myers' automaton for one item: `find` gives the best end and distance in a window."""

    def __init__(self, item_id: int, text: str, k: int):
        self.id, self.text, self.k, self.m = item_id, text, k, len(text)
        self.eq: dict[str, int] = {}
        for i, c in enumerate(text):
            self.eq[c] = self.eq.get(c, 0) | 1 << i

    def find(self, text: str, start: int, end: int) -> tuple[int, int] | None:
        """(distance, end) of the nearest substring of text[start:end], if within the budget; the first end among equals."""
        full, top = (1 << self.m) - 1, 1 << (self.m - 1)
        pv, mv, score, best, at = full, 0, self.m, self.k + 1, -1
        get = self.eq.get
        for j in range(start, end):
            eq = get(text[j], 0)
            xv = eq | mv
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph = mv | ~(xh | pv) & full
            mh = pv & xh
            if ph & top:
                score += 1
            elif mh & top:
                score -= 1
            ph = ph << 1 & full
            mh = mh << 1 & full
            pv = mh | ~(xv | ph) & full
            mv = ph & xv
            if score < best:
                best, at = score, j + 1
                if not best:
                    break
        return (best, at) if at >= 0 else None


class Matcher:
    """All items of one block."""

    def __init__(self, items: list[tuple[int, str]], share: float):
        self.items: list[Item] = []
        table: dict[str, list[tuple[int, int]]] = {}
        for item_id, raw in items:
            text = normal(raw)
            if not text:
                continue
            k = budget(len(text), share)
            at = len(self.items)
            self.items.append(Item(item_id, text, k))
            for offset, piece in pieces(text, k):
                table.setdefault(piece, []).append((at, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, at in table.items():
            self.automaton.add_word(piece, (len(piece), at))
        if table:
            self.automaton.make_automaton()

    def matches(self, raw: str) -> list[tuple[int, int, int, int]]:
        """(item id, distance, start, end) of the best place of each item; offsets in the normal form, start up to the budget early."""
        if not self.items:
            return []
        text = normal(raw)
        found: dict[int, tuple[int, int, int]] = {}
        tried: set[tuple[int, int]] = set()  # items and starts; the pieces of one undisturbed place share a start
        for end, (length, places) in self.automaton.iter(text):
            first = end + 1 - length
            for at, offset in places:
                item = self.items[at]
                start = first - offset
                if (at, start) in tried or start < -2 * item.k or start + item.m > len(text) + 2 * item.k:
                    continue
                tried.add((at, start))
                best = item.find(text, max(0, start - item.k), min(len(text), start + item.m + item.k))
                if best and (at not in found or best[0] < found[at][0]):
                    found[at] = (best[0], max(0, best[1] - item.m), best[1])
        return [(self.items[at].id, *v) for at, v in sorted(found.items())]


#: The matcher that this worker built last, under the name of its block; it serves the worker's next tasks.
_last: dict[str, Matcher] = {}


def matcher_of(name: str, items: list[tuple], share: float) -> Matcher:
    if name not in _last:
        _last.clear()
        _last[name] = Matcher(items, share)
    return _last[name]


def contaminated(df: DataFrame, benchmark: DataFrame, share: float = 0.08, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(key, item as its table has it, distance long, start long, end long) for each document and item that it holds within share * length edits.

    Null, empty and all-punctuation texts or items match nothing. An item that stands in a document
    several times gives one row, of its best place. Repeated rows give repeated results, empty tables
    none. Texts are searched whole.
    """
    rows = benchmark.where(F.col(item_text).isNotNull() & F.col(item).isNotNull()).select(F.col(f"`{item}`").alias("item"), F.col(f"`{item_text}`").alias("text")).distinct()
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-chars // BLOCK_CHARS) or 1
    sc = df.sparkSession.sparkContext
    item_kind = rows.schema["item"].dataType.simpleString()
    item_type = to_arrow_type(rows.schema["item"].dataType)
    out = None
    for block in range(n):  # items are queries against all documents, in blocks of bounded size
        mine = [tuple(r) for r in rows.where(F.pmod(F.xxhash64("item"), F.lit(n)) == block).orderBy("item", "text").collect()]
        shared, name = sc.broadcast(mine), uuid.uuid4().hex

        def run(it: Iterator[pa.RecordBatch], shared=shared, name=name) -> Iterator[pa.RecordBatch]:
            matcher = matcher_of(name, shared.value, share)
            for b in batches(it):
                got = [(i, *m) for i, x in enumerate(b.column(1).to_pylist()) for m in matcher.matches(x)]
                at = b.column(0).take(pa.array([g[0] for g in got], pa.int32()))
                cols = [pa.array([g[1] for g in got], item_type), *[pa.array([g[j] for g in got], pa.int64()) for j in range(2, 5)]]
                yield pa.RecordBatch.from_arrays([at, *cols], names=["key", "item", "distance", "start", "end"])

        kind = df.schema[key].dataType.simpleString()
        part = mapped(df.select(F.col(f"`{key}`").alias("key"), text_or_empty(f"`{text}`")), run, f"key {kind}, item {item_kind}, distance long, start long, end long")
        out = part if out is None else out.union(part)
    return out.select(F.col("key").alias(key), F.col("item").alias(item), "distance", "start", "end")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items in all documents, within edits for 8 % of an item's length."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))
