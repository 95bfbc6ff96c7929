"""Document fingerprints by SpotSigs, in DataFrame operations alone.

Common words (of four languages), line ends and the start of a text are anchors. The chain of up to
CHAIN content words after an anchor, as far as the next one, is a spot signature, and so is each further
chain up to the next anchor, so every content word is in a signature. A document's
fingerprint is its set of signatures, hashed to 32 bits. Likeness is the Jaccard similarity of two sets.
Pairs are pruned by length: sets whose sizes differ by more than the threshold allows can't be alike,
so a search partitions documents by set length and compares neighbouring partitions alone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geotable.llm.common import cut, text_or_empty

ANCHORS = (
    "the of and to in a is that it for on was with as be by this are from an at or not "
    "de la le et les des un une en du que qui dans pour par sur au "
    "der die das und von zu den mit ist auf ein eine im für nicht sich "
    "el los las y se por con una del es lo para al"
).split()
CHAIN = 3
#: Ids in one bucket of the order by id, at least; integer ids, so this bounds its rows.
BUCKET = 256
#: Buckets that the order is cut into, about; more rows make wider buckets.
BUCKETS = 250_000
#: Rows (an id and a bucket, 16 bytes) that may be broadcast.
BROADCAST_ROWS = 1_000_000
#: Where the lengths of two sets alone keep their likeness under this, they are not compared: it is 0.
LEAST = 0.1

_MARK = "\x01"
_CONTENT = rf"(?<![^ \x01])(?!(?:{'|'.join(dict.fromkeys(ANCHORS))})(?![^ \x01]))[^ \x01]++"
_CHAINS = rf"{_CONTENT}(?: {_CONTENT}){{0,{CHAIN - 1}}}"


def spots(text: Column) -> Column:
    """Distinct signatures of a text as sorted 32-bit hashes (array<int>); empty for a text without words."""
    plain = F.regexp_replace(F.translate(F.lower(text), "\n|", _MARK * 2), rf"[^\p{{L}}\p{{N}}{_MARK}]+", " ")
    chains = F.regexp_extract_all(plain, F.lit(_CHAINS), F.lit(0))
    return F.array_sort(F.array_distinct(F.transform(chains, lambda c: F.hash(c))))


def written(sigs: Column) -> Column:
    """A fingerprint as text: eight hexadecimal digits for each signature, in order."""
    return F.lower(F.array_join(F.transform(sigs, lambda h: F.lpad(F.hex(h.cast("long").bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))), 8, "0")), ""))


def likeness(a: Column, b: Column, least: float = 0.0) -> Column:
    """Jaccard similarity of two sets; 0 without comparing where the sizes alone keep it under `least`. Two empty sets are alike."""
    n, m = F.size(a), F.size(b)
    both = F.size(F.array_intersect(a, b)).cast("double")
    full = F.when((n == 0) & (m == 0), 1.0).otherwise(both / F.greatest(n + m - both, F.lit(1.0)))
    return F.when(F.least(n, m) < least * F.greatest(n, m), 0.0).otherwise(full)


def with_next(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text, next_text, is_guest): each row beside the following row's text, in order of key, then text; the first follows the last.

    Rows are bucketed by key; one row of each bucket, the first, also visits the bucket before. So each text is shuffled once.
    """
    low = F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(-(1 << 62)))
    width = max(BUCKET, df.count() // BUCKETS)
    rows = df.select(F.col(f"`{key}`").alias("key"), low.alias("kid"), text_or_empty(f"`{text}`").alias("text")).withColumn("bucket", F.expr(f"kid DIV {width} - IF(kid % {width} < 0, 1, 0)"))
    # the bucket before each bucket: ranges of buckets first, then the ends of the ranges (one row a range)
    firsts = df.select(low.alias("kid")).groupBy(F.expr(f"kid DIV {width} - IF(kid % {width} < 0, 1, 0)").alias("bucket")).agg(F.min("kid").alias("first"))
    firsts = cut(firsts.repartitionByRange("bucket").withColumn("pid", F.spark_partition_id()))
    own = Window.partitionBy("pid").orderBy("bucket")
    ends = firsts.groupBy("pid").agg(F.max("bucket").alias("end"))
    ends = ends.select("pid", F.coalesce(F.lag("end").over(Window.orderBy("pid")), F.max("end").over(Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("end"))
    guests = firsts.withColumn("host", F.lag("bucket").over(own)).join(F.broadcast(ends), "pid").select(F.col("first").alias("kid"), F.coalesce("host", "end").alias("host"))
    guests = guests.where("host is not null")
    if firsts.count() <= BROADCAST_ROWS:
        guests = F.broadcast(guests)
    visits = F.explode(F.array(F.struct(F.col("bucket").alias("at"), F.lit(False).alias("guest")), F.struct(F.col("host").alias("at"), F.lit(True).alias("guest"))))
    placed = rows.join(guests, "kid", "left").select("key", "kid", "text", visits.alias("v")).where("v.at is not null").select("key", "kid", "text", F.col("v.at").alias("at"), F.col("v.guest").alias("guest"))
    order = Window.partitionBy("at").orderBy("guest", "kid", "text")
    return placed.withColumn("next_text", F.lead("text").over(order))


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key` with n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for each row.

    The edited text has its last quarter replaced by as much of the start of the next row's text (all of it, where it
    is shorter). Sets are compared by length first: where that keeps a likeness under LEAST, it is 0. Null texts are empty; empty texts have empty fingerprints, alike to each other (1) and to nothing
    else (0). Repeated keys are ordered by text; null keys come first. A single row is its own next. An empty table
    gives no rows; texts are taken whole.
    """
    rows = with_next(df, key, text)
    order = Window.partitionBy("at").orderBy("guest", "kid", "text")
    n = F.length("text")
    rows = rows.withColumn("sigs", spots(F.col("text"))).withColumn("next_sigs", F.lead("sigs").over(order)).where("not guest")
    quarter = F.floor(n / 4).cast("int")
    rows = rows.withColumn("edited", F.concat(F.left(F.col("text"), n - quarter), F.left(F.col("next_text"), quarter))).withColumn("edited_sigs", spots(F.col("edited")))
    return rows.select(
        F.col("key").alias(key),
        n.cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        written(F.col("sigs")).alias("fingerprint"),
        written(F.col("edited_sigs")).alias("edited_fingerprint"),
        likeness(F.col("sigs"), F.col("edited_sigs"), LEAST).alias("near_edited"),
        likeness(F.col("sigs"), F.col("next_sigs"), LEAST).alias("near_next"),
    )


def alike(df: DataFrame, least: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(u, v, likeness): representatives of distinct fingerprints with a likeness of `least` or more; members() has who stands for whom.

    Sets are partitioned by length, into bands whose bounds grow by 1 / least, so that partners lie in the same or the
    next band. Within a band they meet under the rarest signatures: partners share one of the first
    size - ceil(least * size) + 1 in order of frequency over all sets. Every pair is compared once, under the first
    such signature they share. Texts without words are alike to nothing.
    """
    if not 0 < least <= 1:
        raise ValueError("least must be above 0 and at most 1")
    sets = cut(members(df, key, text).where("size(sigs) > 0").groupBy("sigs").agg(F.min("id").alias("id")))
    grow = math.log(1 / least) if least < 1 else 1.0
    counts = sets.select(F.explode("sigs").alias("sig")).groupBy("sig").agg(F.count(F.lit(1)).alias("n"))
    ranked = sets.select("id", F.size("sigs").alias("size"), F.explode("sigs").alias("sig")).join(counts, "sig")
    prefix = F.col("size") - F.ceil(F.col("size") * F.lit(least) - 1e-9) + 1
    ranked = ranked.withColumn("pos", F.row_number().over(Window.partitionBy("id").orderBy("n", "sig"))).where(F.col("pos") <= prefix)
    band = F.floor(F.log(F.col("size").cast("double")) / F.lit(grow)) if least < 1 else F.col("size")
    ranked = ranked.select("sig", "id", "size", "pos", band.cast("long").alias("band"))
    left = ranked.withColumn("meet", F.explode(F.array(F.col("band"), F.col("band") + 1)))
    a, b = left.alias("a"), ranked.alias("b")
    fits = (F.col("a.size") < F.col("b.size")) | (F.col("a.size") == F.col("b.size")) & (F.col("a.id") < F.col("b.id"))
    room = 1 + F.least(F.col("a.size") - F.col("a.pos"), F.col("b.size") - F.col("b.pos"))
    need = F.ceil(F.lit(least / (1 + least)) * (F.col("a.size") + F.col("b.size")) - 1e-9)
    long_enough = F.col("a.size") >= F.lit(least) * F.col("b.size") - 1e-9
    met = a.join(b, (F.col("a.sig") == F.col("b.sig")) & (F.col("a.meet") == F.col("b.band")) & fits & long_enough)
    # the first shared signature bounds what can still be shared
    pairs = met.groupBy(F.col("a.id").alias("x"), F.col("b.id").alias("y")).agg(F.max(room).alias("room"), F.max(need).alias("need")).where("room >= need").select("x", "y")
    s = lambda at: sets.select(F.col("id").alias(at), F.col("sigs").alias(f"{at}s"))
    out = pairs.join(s("x"), "x").join(s("y"), "y").withColumn("likeness", likeness(F.col("xs"), F.col("ys"), least))
    return out.where(F.col("likeness") >= least - 1e-12).select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v"), "likeness")


def members(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, sigs): each row's set of signatures; rows with equal sets are one class, led by the smallest id."""
    return df.select(F.col(f"`{key}`").alias("id"), spots(text_or_empty(f"`{text}`")).alias("sigs"))


def op9_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document, its edited text's, and likeness to that and to the next document."""
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
