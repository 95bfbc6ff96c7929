"""Secrets by multipart credential linking, in DataFrame operations alone.

Strong forms (assignments, access keys, long hexadecimal runs) are secrets by themselves. Access
identifiers, secret-like values and endpoints are weak: each is common in clean text, so it is reported
only if parts that complete it to a credential stand within SCOPE code points in the same text. That is
an interval join of parts with parts, done as a sweep: in order of starts, the farthest end so far and, from
the other side, the nearest start to come tell whether an interval of a sort lies within SCOPE. So the join
is linear in the parts but for their sort, however many crowd into one text, and it never pairs them.

A text is searched once. Its matches leave the search as lengths (what lies between the matches and
the matches themselves, from split() and regexp_extract_all() of one pattern), which a running sum turns
into positions. Offsets are code points, end exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geotable.llm.common import cut, text_or_empty

#: Code points between the end of one part of a credential and the start of another.
SCOPE = 200
#: Code points of a piece in which long texts are cut up to replace their secrets.
PIECE = 4096

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
IDENTIFIER = r"""((?i:access|client|account|tenant|app|user)[_-]?(?i:key[_-]?id|id|name))["']?\x20*[:=]\x20*["']?([A-Za-z0-9._@-]{4,})"""
# a run of 32 characters or more with capital, small letter and digit, also right after '='; no key before '=', no authority and path of an URL, no full stop at the end
LOOSE = (
    r"(?<![A-Za-z0-9+/_.-])(?!//(?<=(?:https?|jdbc:[a-z]{1,20}|s3|postgres|mysql|mongodb|redis|amqp)://))"
    r"(?=[A-Za-z0-9+/_.-]*[A-Z])(?=[A-Za-z0-9+/_.-]*[a-z])(?=[A-Za-z0-9+/_.-]*[0-9])[A-Za-z0-9+/_.-]{31,}[A-Za-z0-9+/_-]={0,2}(?![A-Za-z0-9+/=_-])"
)
ENDPOINT = r"""(?:https?|jdbc:[a-z]+|s3|postgres|mysql|mongodb|redis|amqp)://[^\s"'<>]{4,}|((?i:endpoint|hostname|host|server|bucket))["']?\x20*[:=]\x20*["']?[A-Za-z0-9._:/-]{4,}"""

KINDS = ("assign", "access", "hex", "identifier", "loose", "endpoint")
#: What each sort of part is good for: an identifier, a secret, or an endpoint.
SORT = {"assign": "s", "access": "i", "hex": "s", "identifier": "i", "loose": "s", "endpoint": "e"}
SPAN = "struct<start:int,rank:int,kind:string,end:int>"


def searched(df: DataFrame, text: str, keep_text: bool = True) -> DataFrame:
    """`df` with __row (unique), __hit (something matched) and, for each kind, the lengths of its matches: __p0 to __p5, null without any.

    A match is a struct of g, the code points since the match before, h, its own, and v, those of its value (of an endpoint: its name).
    """
    t = F.col("__text")
    out = df.withColumn("__text", text_or_empty(f"`{text}`"))
    patterns, groups = (ASSIGN, ACCESS, HEX, IDENTIFIER, LOOSE, ENDPOINT), {0: 2, 5: 1}
    for i, p in enumerate(patterns):
        hits = F.regexp_extract_all(t, F.lit(p), F.lit(0))
        out = out.withColumn(f"__h{i}", F.when(F.contains(t, F.lit("AKIA")), hits) if p == ACCESS else hits)
    for i, p in enumerate(patterns):
        values = F.regexp_extract_all(t, F.lit(p), F.lit(groups[i])) if i in groups else F.col(f"__h{i}")
        rows = F.arrays_zip(F.split(t, p, -1).alias("g"), F.col(f"__h{i}").alias("h"), values.alias("v"))
        lengths = F.transform(rows, lambda x: F.struct(F.length(x["g"]).alias("g"), F.length(x["h"]).alias("h"), F.length(x["v"]).alias("v")))
        out = out.withColumn(f"__p{i}", F.when(F.size(f"__h{i}") > 0, F.filter(lengths, lambda x: x["h"].isNotNull())))
    hit = F.coalesce(*[F.col(f"__p{i}") for i in range(len(patterns))]).isNotNull()
    drop = [f"__h{i}" for i in range(len(patterns))]
    return out.withColumn("__hit", hit).withColumn("__row", F.monotonically_increasing_id()).drop("__text", *drop, *([] if keep_text else [text]))


def _sweeps(scope: str) -> tuple:
    """Windows from each interval to all that start before or with it, and to all that start with or after it."""
    before = Window.partitionBy(scope).orderBy("start").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return before, Window.partitionBy(scope).orderBy(F.desc("start")).rangeBetween(Window.unboundedPreceding, Window.currentRow)


def _within(which: Column, gap: int, scope: str) -> Column:
    """Whether an interval for which `which` holds lies at most `gap` code points away (-1: overlaps)."""
    before, after = _sweeps(scope)
    left = F.col("start") - F.max(F.when(which, F.col("end"))).over(before)
    right = F.min(F.when(which, F.col("start"))).over(after) - F.col("end")
    return F.coalesce(left <= gap, F.lit(False)) | F.coalesce(right <= gap, F.lit(False))


def joined(parts: DataFrame, scope: str = "scope") -> DataFrame:
    """`parts` (scope, start, rank, kind, end, and others) with __kept: base parts, and weak ones whose complement is near.

    An identifier needs a secret, a loose secret needs an identifier or an endpoint, and an endpoint needs both an
    identifier and a secret with at most SCOPE code points in between.
    """
    sort = F.element_at(F.create_map(*[F.lit(x) for kv in SORT.items() for x in kv]), F.col("kind"))
    near = {s: _within(sort == s, SCOPE, scope) for s in "ise"}
    linked_ = (F.col("kind") == "identifier") & near["s"] | (F.col("kind") == "loose") & (near["i"] | near["e"]) | (F.col("kind") == "endpoint") & near["i"] & near["s"]
    return parts.withColumn("__kept", (F.col("rank") < 3) | linked_)


def linked(parts: DataFrame) -> DataFrame:
    """(scope, spans): the weak spans of each scope whose complement is near; parts: (scope, start, rank, kind, end). Equal parts count once."""
    kept = joined(parts.distinct()).where(F.col("__kept") & (F.col("rank") >= 3))
    return kept.groupBy("scope").agg(F.sort_array(F.collect_list(F.struct("start", "rank", "kind", "end"))).alias("spans"))  # a text's own spans


def located(rows: DataFrame) -> DataFrame:
    """(__row, start, rank, kind, end, __kept): spans of the rows that searched() gave; one task has all parts of a text.

    Weak parts count where they touch no base span (a hexadecimal run within a loose secret is but a piece of it), and
    loose secrets where they aren't the value of an identifier or of a named endpoint.
    """
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(k).alias("kind"), F.col(f"__p{i}").alias("p")) for i, k in enumerate(KINDS)])).alias("x")
    parts = rows.where("__hit").select("__row", each).select("__row", "x.rank", "x.kind", F.posexplode("x.p").alias("i", "m")).select("__row", "rank", "kind", "i", "m.*")
    so_far = Window.partitionBy("__row", "rank").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col("g") + F.col("h")).over(so_far), F.lit(0)) + F.col("g")
    parts = parts.repartition("__row").withColumn("start", start.cast("int")).withColumn("end", (F.col("start") + F.col("h")).cast("int"))
    parts = parts.where((F.col("rank") != 0) | (F.col("v") >= 6)).select("__row", "start", "rank", "kind", "end", "v")
    base, loose = F.col("rank") < 3, F.col("kind") == "loose"
    taken = (F.col("rank") < 2) | (F.col("kind") == "identifier") | (F.col("kind") == "endpoint") & (F.col("v") >= 1)
    free = F.when(loose, ~_within(taken, -1, "__row")).otherwise(~_within(base, -1, "__row"))
    parts = parts.withColumn("__free", base | free).where("__free").drop("v", "__free")
    return joined(parts, "__row")


def secret_spans(df: DataFrame, text: str = "text", keep_text: bool = True) -> DataFrame:
    """`df` with __base, __spans: arrays of struct(start, rank, kind, end), sorted; __spans holds the base ones and all that links found.

    A null text is empty; empty texts have no spans; repeated rows stay, each with its spans; an empty table gives
    an empty table. Texts are searched whole, once; the searched rows are written (without the text, unless
    `keep_text`), and only those with a match are joined with their spans.
    """
    own = [c for c in df.columns if keep_text or c != text]
    rows = cut(searched(df, text, keep_text))
    span = F.struct("start", "rank", "kind", "end")
    spans = located(rows).where("__kept").groupBy("__row").agg(F.sort_array(F.collect_list(F.when(F.col("rank") < 3, span))).alias("__base"), F.sort_array(F.collect_list(span)).alias("__spans"))
    none = F.expr(f"CAST(array() AS array<{SPAN}>)")
    mine = [F.col(f"`{c}`") for c in own]
    some = rows.where("__hit").join(spans, "__row", "left").select(*mine, F.coalesce("__base", none).alias("__base"), F.coalesce("__spans", none).alias("__spans"))
    return some.union(rows.where("not __hit").select(*mine, none.alias("__base"), none.alias("__spans")))


def written(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _replaced() -> Column:
    """__text with each interval of __cuts (start, end; sorted, apart) replaced by __mark. Texts go by pieces, so an interval costs no more than a piece."""
    place = f"IF(j = 0, g.a % {PIECE}, 0)"
    piece = f"substring(c, CAST({place} AS INT) + 1, CAST(IF(j = g.n - 1, (g.b - 1) % {PIECE} + 1, {PIECE}) - {place} AS INT))"
    between = f"array_join(transform(slice(x.c, CAST(g.a DIV {PIECE} AS INT) + 1, g.n), (c, j) -> {piece}), '')"
    ends = "named_struct('a', IF(i = 0, 0, get(x.s, i - 1).end), 'b', IF(i = size(x.s), x.n, get(x.s, i).start))"
    sized = f"transform(array({ends}), h -> named_struct('a', h.a, 'b', h.b, 'n', CAST((h.b - 1) DIV {PIECE} - h.a DIV {PIECE} AS INT) + 1))"
    kept = f"transform(sequence(0, size(x.s)), i -> get(transform({sized}, g -> IF(g.b > g.a, {between}, '')), 0))"
    whole = f"array(named_struct('c', regexp_extract_all(__text, '(?s).{{1,{PIECE}}}', 0), 's', __cuts, 'n', length(__text), 'm', __mark))"
    return F.expr(f"get(transform({whole}, x -> array_join({kept}, x.m)), 0)")


def redacted(df: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """`df` with every span (overlapping ones as one) of its text replaced by `mark`; rows and other columns stay.

    Null and empty texts stay as they are. Texts are searched once and written once; those without a match pass by.
    """
    rows = cut(searched(df, text))
    before = Window.partitionBy("__row").orderBy("start", "rank", "end").rowsBetween(Window.unboundedPreceding, -1)
    spans = located(rows).where("__kept").withColumn("__new", F.coalesce(F.col("start") >= F.max("end").over(before), F.lit(True)).cast("int"))
    upto = Window.partitionBy("__row").orderBy("start", "rank", "end").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    spans = spans.withColumn("__at", F.sum("__new").over(upto)).groupBy("__row", "__at").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    cuts = spans.groupBy("__row").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("__cuts"))
    mine = [F.col(f"`{c}`") for c in df.columns]
    some = rows.where("__hit").join(cuts, "__row", "left").withColumn("__text", F.col(f"`{text}`")).withColumn("__mark", F.lit(mark))
    some = some.withColumn(text, F.when(F.col("__cuts").isNull(), F.col("__text")).otherwise(_replaced()))
    return some.select(*mine).union(rows.where("not __hit").select(*mine))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: the base forms, and weak parts that links complete."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = secret_spans(docs, keep_text=False)
    n = lambda k: F.size(F.filter("__base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return out.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(written("__base"), 256).alias("base_sha256"), written("__spans").alias("spans"))
