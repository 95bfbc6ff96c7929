"""Near-duplicate detection: MinHash signatures joined by multi-index Hamming search.

A document's set of word shingles is signed by PARTS minima of BITS bits. The signatures' distance is
the number of parts that differ. A signature is split into CHUNKS chunks; two signatures at a
distance of at most CHUNKS * (ERRORS + 1) - 1 agree, by the pigeonhole principle, in all but ERRORS
parts of at least one chunk. So each chunk is indexed under every choice of ERRORS parts left out,
and every pair within that distance meets under some key. Pairs are confirmed on their full sets.

Documents with equal sets are one class from the start. Under a key only links to the smallest class
are tried first; then, between classes whose components still differ, pairs near enough are taken
from blocks of a key's members, closest first, until every such pair is linked or refuted. So copies
are never expanded to all pairs, and no link between different texts is lost.

Versions of one text that are near, yet not near enough, are as many pairs as their number squared. Most
are refuted where they meet, without their texts: a set has a parity sketch, of which each shingle flips
one bit, so two sketches differ in no more bits than their sets in shingles. That bound is exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geotable.llm.common import batches, cut, mapped
from geotable.llm.components import components

PARTS, BITS, CHUNKS, ERRORS = 40, 16, 10, 1
SIZE = PARTS // CHUNKS
#: Every pair at this distance or less meets under a key.
GUARANTEED = CHUNKS * (ERRORS + 1) - 1
#: Pairs that meet are confirmed up to this distance (a similarity of 0.8 exceeds it once in 10 million).
FARTHEST = GUARANTEED + 4
#: Bits of a parity sketch: a power of two, at least twice the set's size within these bounds. Beyond, a sketch refutes less, and texts decide.
FEWEST_BITS, MOST_BITS = 512, 1 << 17
#: Members of one key that are compared at once, at least; a key has no more than BLOCKS blocks of a sort, so a member has at most twice as many copies.
BLOCK, BLOCKS = 1000, 64
#: Pairs of one document that are confirmed at once.
GROUP = 500
#: Ids, or rows of a few ids, that may be broadcast (32 MB at most); beyond, the join shuffles.
BROADCAST_IDS = 1_000_000

_rng = np.random.default_rng(20240607)
_WORD = _rng.integers(1, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_XOR = _rng.integers(0, 2**63, PARTS, dtype=np.uint64)
_MUL = _rng.integers(1, 2**63, PARTS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MASKS = [(c, tuple(p for p in range(SIZE) if p not in out)) for c in range(CHUNKS) for out in combinations(range(SIZE), ERRORS)]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words(dict):
    """Hashes of words; emptied when it has grown large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: bytes | None, width: int, words: Words) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles of `width` words.

    A-Z is lower-cased and words are split at ASCII white space, as bytes.lower() and bytes.split()
    do. Fewer words are one shingle; no word, or a null, gives none.
    """
    parts = text.lower().split() if text else []
    if not parts:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, parts), np.uint64, len(parts))
    w = min(width, len(h))
    n = len(h) - w + 1
    s = np.full(n, w, np.uint64)
    for i in range(w):
        s += mixed(h[i : i + n] ^ _WORD[i % 16]) * _WORD[(i + 7) % 16]
    return np.unique(mixed(s))


def signature(s: np.ndarray) -> np.ndarray:
    """PARTS minima of BITS bits each."""
    least = np.full(PARTS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), 4096):
        np.minimum(least, ((s[i : i + 4096, None] ^ _XOR) * _MUL).min(axis=0), out=least)
    return (mixed(least) & np.uint64(2**BITS - 1)).astype("<u2")


def sketch(s: np.ndarray) -> bytes:
    """Bit i is the parity of the number of shingles whose hash is i modulo the number of bits."""
    bits = min(MOST_BITS, max(FEWEST_BITS, 1 << (2 * len(s) - 1).bit_length()))
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


class Sketches:
    """Sketches of sets of `sizes` shingles; refutes pairs of them, given by their places."""

    def __init__(self, sketches: list[bytes], sizes: np.ndarray, percent: int):
        self.sketches, self.sizes, self.percent, self.words = sketches, sizes, percent, np.array([len(x) // 8 for x in sketches], np.int64)
        self.least = np.empty((len(sketches), FEWEST_BITS // 64), np.uint64)
        for w in np.unique(self.words):
            at = np.flatnonzero(self.words == w)
            self.least[at] = self._folded(at, int(w), FEWEST_BITS // 64)

    def _folded(self, at: np.ndarray, own: int, words: int) -> np.ndarray:
        """Sketches of `own` 64-bit words at places, as those of `words` words: the halves are added without carry."""
        x = np.frombuffer(b"".join([self.sketches[i] for i in at.tolist()]), "<u8").reshape(-1, own)
        return np.bitwise_xor.reduce(x.reshape(-1, own // words, words), axis=1)

    def _possible(self, x: np.ndarray, y: np.ndarray, both: np.ndarray) -> np.ndarray:
        # 100 * intersection >= percent * union, written with the sum of the sizes and the difference, which the bits bound from below
        return (100 + self.percent) * np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64) <= (100 - self.percent) * both

    def quickly(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether pairs stand by their sizes and by sketches of the fewest bits."""
        a, b = self.sizes[i], self.sizes[j]
        ok = 100 * np.minimum(a, b) >= self.percent * np.maximum(a, b)
        ok[ok] = self._possible(self.least[i[ok]], self.least[j[ok]], (a + b)[ok])
        return ok

    def closely(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether pairs stand by as many bits as both have."""
        ok, both, words = np.ones(len(i), bool), self.sizes[i] + self.sizes[j], np.minimum(self.words[i], self.words[j])
        for w in np.unique(words[words > FEWEST_BITS // 64]).tolist():
            pairs = np.flatnonzero(words == w)
            for p in np.array_split(pairs, len(pairs) * w // 1_000_000 + 1):
                at, place = np.unique(np.concatenate([i[p], j[p]]), return_inverse=True)
                folded = np.empty((len(at), w), np.uint64)
                for own in np.unique(self.words[at]).tolist():
                    folded[self.words[at] == own] = self._folded(at[self.words[at] == own], own, w)
                ok[p] = self._possible(folded[place[: len(p)]], folded[place[len(p) :]], both[p])
        return ok


def keys(sigs: np.ndarray) -> np.ndarray:
    """One row of keys for each signature: the number of the chunk and mask, then the parts that stay."""
    out = np.empty((len(sigs), len(_MASKS)), np.int64)
    for j, (c, stay) in enumerate(_MASKS):
        k = np.full(len(sigs), j, np.int64)
        for p in stay:
            k = k << BITS | sigs[:, c * SIZE + p].astype(np.int64)
        out[:, j] = k
    return out


def signed(df: DataFrame, width: int, key: str, text: str) -> DataFrame:
    """key, n_shingles long, set_key binary (16 bytes, equal for equal sets; null if empty), sig binary, sketch binary."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for b in batches(it):
            n, ks, sigs, parities = [], [], [], []
            for x in b.column(1).cast(pa.binary()).to_pylist():
                s = shingles(x, width, words)
                n.append(len(s))
                ks.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                sigs.append(signature(s).tobytes() if len(s) else None)
                parities.append(sketch(s) if len(s) else None)
            arrays = [b.column(0), pa.array(n, pa.int64()), *(pa.array(x, pa.binary()) for x in (ks, sigs, parities))]
            yield pa.RecordBatch.from_arrays(arrays, names=["key", "n_shingles", "set_key", "sig", "sketch"])

    kind = df.schema[key].dataType.simpleString()
    return mapped(df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`")), run, f"key {kind}, n_shingles long, set_key binary, sig binary, sketch binary")


def _keyed(classes: DataFrame) -> DataFrame:
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it, rows=5000):
            k = keys(np.frombuffer(b"".join(b.column(1).to_pylist()), "<u2").reshape(-1, PARTS))
            yield pa.RecordBatch.from_arrays([pa.array(k.ravel()), b.column(0).take(pa.array(np.repeat(np.arange(len(k)), k.shape[1])))], names=["k", "id"])

    return mapped(classes.select("id", "sig"), run, f"k long, id {classes.schema['id'].dataType.simpleString()}")


def _near(pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v, and of both sig, sketch, n: su, sv, pu, pv, nu, nv) at a signature distance of at most FARTHEST that sketches don't refute, with the distance."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it, rows=5000):
            x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), "<u2").reshape(-1, PARTS) for i in (2, 3))
            d = (x != y).sum(axis=1)
            sketches = Sketches(b.column(4).to_pylist() + b.column(5).to_pylist(), np.concatenate([b.column(i).to_numpy() for i in (6, 7)]), percent)
            ok = np.flatnonzero(d <= FARTHEST)
            ok = ok[sketches.quickly(ok, ok + b.num_rows)]
            ok = ok[sketches.closely(ok, ok + b.num_rows)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(ok)), b.column(1).take(pa.array(ok)), pa.array(d[ok], pa.int64())], names=["u", "v", "d"])

    kind = pairs.schema["u"].dataType.simpleString()
    return mapped(pairs.select("u", "v", "su", "sv", "pu", "pv", "nu", "nv"), run, f"u {kind}, v {kind}, d long")


def _blocks(members: DataFrame, percent: int) -> DataFrame:
    """Pairs of members (k, id, component, sig, sketch, n) of a key that are near, not refuted by sketches and of different components.

    Under each key the members of the smallest id's component, most of a hot key, are cut into blocks
    of about BLOCK, and so are all others. Blocks of the first sort meet only blocks of the second,
    which also meet each other. What meets is compared where it meets: two blocks at a time.
    """
    one = members.groupBy("k").agg(F.min_by("component", "id").alias("main"))
    marked = members.join(one, "k").withColumn("in", F.col("component") == F.col("main"))
    sized = marked.groupBy("k").agg(F.count_if("in").alias("n_in"), F.count_if(~F.col("in")).alias("n_out"))
    blocks = lambda c: F.expr(f"CAST(LEAST(({c} + {BLOCK - 1}) DIV {BLOCK}, {BLOCKS}) AS INT)")
    sized = sized.where("n_out > 0").select("k", blocks("n_in").alias("b_in"), blocks("n_out").alias("b_out"))
    own = F.when(F.col("in"), F.pmod(F.xxhash64("id"), F.col("b_in"))).otherwise(F.col("b_in") + F.pmod(F.xxhash64("id"), F.col("b_out"))).cast("int")
    placed = marked.join(sized, "k").withColumn("blk", own)
    others = F.sequence(F.when(F.col("in"), F.col("b_in")).otherwise(F.lit(0)), F.col("b_in") + F.col("b_out") - 1)
    met = placed.withColumn("other", F.explode(others)).select(F.xxhash64("k", F.least("blk", "other"), F.greatest("blk", "other")).alias("cell"), "id", "component", "sig", "sketch", "n")
    kind = members.schema["id"].dataType.simpleString()

    def compared(t: pa.Table) -> pa.RecordBatch:
        cell, ids, comp = (t.column(c).to_numpy() for c in ("cell", "id", "component"))
        sigs = np.frombuffer(b"".join(t.column("sig").to_pylist()), "<u2").reshape(-1, PARTS)
        sketches = Sketches(t.column("sketch").to_pylist(), t.column("n").to_numpy(), percent)
        us, vs, ds = [ids[:0]], [ids[:0]], [np.zeros(0, np.int64)]
        for shift in range(1, len(ids)):  # rows are in order of cells: the i-th and the (i + shift)-th meet if their cells are one
            same = cell[shift:] == cell[:-shift]
            if not same.any():
                break
            i = np.flatnonzero(same & (comp[shift:] != comp[:-shift]))
            for i in np.array_split(i, len(i) // 50_000 + 1):
                i = i[sketches.quickly(i, i + shift)]
                d = (sigs[i] != sigs[i + shift]).sum(axis=1)
                i, d = i[d <= FARTHEST], d[d <= FARTHEST]
                ok = sketches.closely(i, i + shift)
                i, d = i[ok], d[ok]
                us.append(np.minimum(ids[i], ids[i + shift]))
                vs.append(np.maximum(ids[i], ids[i + shift]))
                ds.append(d)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (us, vs, ds)], names=["u", "v", "d"])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in it:
            t = pa.Table.from_batches([b])
            held = t if held is None else pa.concat_tables([held, t]).combine_chunks()
            cell = held.column("cell").to_numpy()
            end = int(np.flatnonzero(cell != cell[-1])[-1]) + 1 if len(cell) and cell[0] != cell[-1] else 0
            if end:
                yield compared(held.slice(0, end))
                held = held.slice(end)
        if held is not None and held.num_rows:
            yield compared(held)

    return mapped(met.repartition("cell").sortWithinPartitions("cell"), run, f"u {kind}, v {kind}, d long").distinct()


def only(df: DataFrame, key: str, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """Rows of `df` whose key is (left_semi) or is not (left_anti) in the one column of `ids`; broadcasts only a counted size."""
    ids = ids.select(F.col(ids.columns[0]).alias("__id")).distinct()
    small = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return df.join(F.broadcast(ids) if small else ids, F.col(f"`{key}`") == F.col("__id"), how)


def _confirmed(pairs: DataFrame, read: DataFrame, width: int, percent: int) -> DataFrame:
    """Those pairs (u, v; a written table) whose full sets are similar enough; read: (id, text).

    The pairs of one u are cut into groups of about GROUP, and a group has one copy of u's text, however many
    it is linked with. So each pair moves one text, and a hot u is spread. Of rows with one id all texts are tried.
    """
    groups = pairs.groupBy("u").agg(F.expr(f"CAST((COUNT(1) + {GROUP - 1}) DIV {GROUP} AS INT)").alias("n"))
    if pairs.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        groups = F.broadcast(groups)
    placed = pairs.join(groups, "u").select("u", "v", F.xxhash64("u", F.pmod(F.xxhash64("v"), F.col("n"))).alias("cell"))
    asks = cut(placed.select(F.col("v").alias("id"), "cell", "u", F.lit(1).alias("place")).union(placed.select(F.col("u").alias("id"), "cell", "u", F.lit(0).alias("place")).distinct()))
    if asks.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        asks = F.broadcast(asks)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, last, lefts = Words(), None, []
        for b in batches(it, rows=256):
            ok = []
            cells, us, places = (b.column(i).to_pylist() for i in (0, 1, 2))
            for i, x in enumerate(b.column(4).cast(pa.binary())):
                if (cells[i], us[i]) != last:
                    last, lefts = (cells[i], us[i]), []
                own = shingles(x.as_py(), width, words)
                if not places[i]:
                    lefts.append(own)
                elif any(_alike(left, own, percent) for left in lefts):
                    ok.append(i)
            ok = pa.array(ok, pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(1).take(ok), b.column(3).take(ok)], names=["u", "v"])

    kind = pairs.schema["u"].dataType.simpleString()
    met = read.join(asks, "id").select("cell", "u", "place", "id", "text")
    return mapped(met.repartition("cell").sortWithinPartitions("cell", "u", "place"), run, f"u {kind}, v {kind}")


def _alike(left: np.ndarray, right: np.ndarray, percent: int) -> bool:
    if 100 * min(len(left), len(right)) < percent * max(len(left), len(right)):
        return False
    both = len(np.intersect1d(left, right, assume_unique=True))
    return 100 * both >= percent * (len(left) + len(right) - both)


def near_duplicates(df: DataFrame, width: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key`, n_shingles long, component_id (smallest key that is reachable over links), kept boolean.

    Linked are documents with 100 * intersection >= percent * union of their sets of `width`-word
    shingles. Null, empty and white texts have no shingles and no links. Rows with one key are one
    document even if their texts differ; a row without a key is linked with nothing and kept. An
    empty table gives no rows. Texts are taken whole, other columns are ignored.
    """
    rows = cut(signed(df, width, key, text))
    classes = cut(
        rows.where("set_key is not null and key is not null").groupBy("set_key").agg(F.min("key").alias("id"), *[F.first(c).alias(n) for c, n in (("sig", "sig"), ("sketch", "sketch"), ("n_shingles", "n"))])
    )
    keyed = _keyed(classes)
    shared = keyed.groupBy("k").agg(F.min("id").alias("lead"), F.count(F.lit(1)).alias("n")).where("n > 1").select("k", "lead")
    buckets = cut(keyed.join(shared, "k"))  # only keys that at least two classes share

    sig = lambda at: classes.select(F.col("id").alias(at), F.col("sig").alias(f"s{at}"), F.col("sketch").alias(f"p{at}"), F.col("n").alias(f"n{at}"))
    stars = buckets.where("id <> lead").select(F.col("lead").alias("u"), F.col("id").alias("v")).distinct()
    stars = cut(_near(stars.join(sig("v"), "v").join(sig("u"), "u"), percent))
    read = df.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text"))
    # of rows with one key, the one whose set gave the class is not known: all are tried
    links = cut(_confirmed(stars, read, width, percent))
    found = components(links)

    labelled = classes.join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"), "sig", "sketch", "n")
    members = buckets.select("k", "id").join(labelled.select("id", "component"), "id")
    open_keys = members.groupBy("k").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b").select("k")
    open_members = members.join(open_keys, "k").join(labelled.select("id", "sig", "sketch", "n"), "id").select("k", "id", "component", "sig", "sketch", "n")
    rest = cut(_blocks(open_members, percent).join(stars.select("u", "v"), ["u", "v"], "left_anti"))
    take = 4
    while rest.head(1):
        ends = found.select(F.col("id").alias("u"), F.col("component").alias("cu")), found.select(F.col("id").alias("v"), F.col("component").alias("cv"))
        between = rest.join(ends[0], "u", "left").join(ends[1], "v", "left").select("u", "v", "d", F.coalesce("cu", "u").alias("cu"), F.coalesce("cv", "v").alias("cv")).where("cu <> cv")
        order = Window.partitionBy(F.least("cu", "cv"), F.greatest("cu", "cv")).orderBy("d", "u", "v")
        ranked = cut(between.withColumn("r", F.row_number().over(order)).select("u", "v", "d", "r"))
        more = cut(_confirmed(ranked.where(F.col("r") <= take), read, width, percent))
        if more.head(1):
            links = links.union(more)
            found = components(found.select(F.col("id").alias("u"), F.col("component").alias("v")).union(more))
        rest = ranked.where(F.col("r") > take).select("u", "v", "d")
        take *= 64

    class_of = classes.select("set_key", F.col("id").alias("class_id")).join(found.withColumnRenamed("id", "class_id"), "class_id", "left")
    class_of = class_of.select("set_key", F.coalesce("component", "class_id").alias("component_id"))
    named = rows.where("set_key is not null and key is not null").select("key", "n_shingles", "set_key").join(class_of, "set_key").select("key", "n_shingles", "component_id")
    alone = rows.where("set_key is null or key is null").select("key", "n_shingles", F.col("key").alias("component_id"))
    return named.union(alone).select(F.col("key").alias(key), "n_shingles", "component_id", F.col("key").eqNullSafe(F.col("component_id")).alias("kept"))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents: four-word shingles, similarity 0.8 or more."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), width=4)
