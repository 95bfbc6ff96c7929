"""Toxicity by multiple-instance learning: documents have labels, sentences get scores.

A document is a bag of sentences. Each sentence has a logistic score over its words and the words'
first letters; the document's score is their noisy-or, 1 - product of (1 - p). Sentences without any
selected feature have a p of 0, so length alone makes no document toxic. Only documents have
labels, so the gradient of the noisy-or decides which sentences are blamed. The same sentence scores
then locate the offending sentences of any document.

The model is fitted on the driver on a bounded sample of labelled documents (`most` of each label, SAMPLE_BYTES of text);
scoring runs over every row where it is read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geotable.llm.common import batches, freed, mapped, text_or_empty

SENTENCE = re.compile(r"[^.!?\n|]+")
WORD = re.compile(r"[^\W_]+")
STEMS = (3, 4, 5, 6)
#: Bytes of the texts of each label that the driver takes to fit.
SAMPLE_BYTES = 24 << 20


def features(word: str) -> list[str]:
    """A word's features: itself and its first letters, marked by a hyphen."""
    return [word, *[word[:n] + "-" for n in STEMS if len(word) > n]]


@dataclass
class Model:
    """A bias and a weight for each selected feature; `score` gives a document's score and its sentences'."""

    bias: float
    weights: dict[str, float]
    cache: dict[str, float] = field(default_factory=dict, repr=False)

    def word(self, w: str) -> float:
        v = self.cache.get(w)
        if v is None:
            if len(self.cache) > 100_000:
                self.cache.clear()
            v = self.cache[w] = sum(self.weights.get(f, 0.0) for f in features(w))
        return v

    def score(self, text: str) -> tuple[float, list[tuple[int, int, float]]]:
        """Score 0 to 1, and (start, end, p) of sentences with a p of 0.5 or more, or else of the one with the largest p."""
        z, spans, some = [], [], []
        for m in SENTENCE.finditer(text):
            words = set(WORD.findall(m.group().lower()))
            if words:
                own = [v for v in map(self.word, sorted(words)) if v]
                z.append(self.bias + sum(own))
                some.append(bool(own))
                spans.append(m.span())
        if not z:
            z, spans, some = [self.bias], [(0, len(text))], [False]
        x, some = np.clip(np.array(z), -40, 40), np.array(some)
        p = some / (1 + np.exp(-x))
        at = np.flatnonzero(p >= 0.5) if p.max() >= 0.5 else [int(p.argmax())]
        return float(-np.expm1(-(np.logaddexp(0, x) * some).sum())), [(*spans[i], float(p[i])) for i in at]


def fit(texts: list[str], labels: list[int], kept: int = 6000, rounds: int = 200, l2: float = 1e-5, least: float = 4.0, ratio: float = 5.0, weights: tuple[float, float] = (1.0, 1.0)) -> Model:
    """Fit the noisy-or by Adam on all given documents; features are those that mark toxic documents.

    `weights` are the labelled documents that one document of label 0 and of label 1 stands for. Equal texts count once.

    Without documents of both labels the model says 0 for everything.
    """
    once = dict(zip(texts, labels, strict=True))
    texts, y = list(once), np.array(list(once.values()), dtype=float)
    if not len(y) or y.min() == y.max():
        return Model(-40.0, {})
    seen: tuple[Counter, Counter] = (Counter(), Counter())
    for t, v in zip(texts, y, strict=True):
        seen[int(v)].update({f for w in set(WORD.findall(t.lower())) for f in features(w)})
    n1, n0 = y.sum(), len(y) - y.sum()
    rated = []
    for f in seen[1].keys() | seen[0].keys():
        a, b = seen[1][f], seen[0][f]
        if a + b >= 3:
            p = (a + b) / (n1 + n0)
            z = (a / n1 - b / n0) / (p * (1 - p) * (1 / n1 + 1 / n0) + 1e-9) ** 0.5
            if z >= least and a / n1 >= ratio * (b + 0.5) / n0:
                rated.append((z, f))
    rated.sort(reverse=True)
    index = {f: i for i, (_, f) in enumerate(rated[:kept])}
    words: dict[str, list[int]] = {}
    doc, sent, feat, k = [], [], [], 0
    for d, t in enumerate(texts):
        before = k
        for m in SENTENCE.finditer(t):
            own = sorted(set(WORD.findall(m.group().lower())))
            if not own:
                continue
            for w in own:
                ids = words.get(w)
                if ids is None:
                    ids = words[w] = [index[f] for f in features(w) if f in index]
                sent.extend([k] * len(ids))
                feat.extend(ids)
            doc.append(d)
            k += 1
        if k == before:
            doc.append(d)
            k += 1
    doc_, sent_, feat_ = np.array(doc), np.array(sent, dtype=np.int64), np.array(feat, dtype=np.int64)
    stands = np.where(y == 1, weights[1], weights[0])
    stands /= stands.sum()
    some = np.bincount(sent_, minlength=k) > 0
    w, bias = np.zeros(len(index)), -6.0
    m1, m2, b1, b2 = np.zeros(len(index) + 1), np.zeros(len(index) + 1), 0.9, 0.99
    for r in range(1, rounds + 1):
        z = np.clip(bias + np.bincount(sent_, w[feat_], minlength=k), -30, 30)
        s = np.bincount(doc_, np.logaddexp(0, z) * some, minlength=len(y))
        g_doc = np.where(y == 1, -np.exp(-s) / np.maximum(-np.expm1(-s), 1e-9), 1.0) * stands
        g_z = g_doc[doc_] * some / (1 + np.exp(-z))
        g = np.append(np.bincount(feat_, g_z[sent_], minlength=len(w)) + l2 * w, g_z.sum())
        m1, m2 = b1 * m1 + (1 - b1) * g, b2 * m2 + (1 - b2) * g * g
        step = 0.1 * (m1 / (1 - b1**r)) / (np.sqrt(m2 / (1 - b2**r)) + 1e-8)
        w -= step[:-1]
        bias -= step[-1]
    return Model(float(bias), {f: float(w[i]) for f, i in index.items() if w[i]})


def df_of(docs: DataFrame, pairs: list[tuple], like: DataFrame) -> DataFrame:
    """The picked (id, hash) pairs as a table, of a few thousand rows."""
    return docs.sparkSession.createDataFrame(pairs, like.select("__id", "__h").schema)


def held_out(key: str) -> Column:
    """Rows whose labels are never learned from. A null key counts as an empty one."""
    return F.pmod(F.crc32(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))), F.lit(4)) == 2


def trained(docs: DataFrame, labels: DataFrame, most: int = 3000, key: str = "doc_id", text: str = "text", label: str = "toxic", most_bytes: int = SAMPLE_BYTES) -> Model:
    """Fit on labelled rows that are not held out: of each label `most` at most, chosen by a hash of their ids, and of those as many whole texts as have `most_bytes`, in that order."""
    known = labels.where(~held_out(key) & F.col(label).isin(0, 1)).groupBy(key).agg(F.max(label).alias("__y"))
    order = [F.xxhash64(key), F.col(key)]
    some = [known.where(F.col("__y") == v).orderBy(*order).limit(most) for v in (0, 1)]
    chosen = some[0].union(some[1])  # 2 * most rows at most, so it can be broadcast
    rows = docs.select(F.col(f"`{key}`").alias("__id"), text_or_empty(f"`{text}`").alias("__text")).join(F.broadcast(chosen.withColumnRenamed(key, "__id")), "__id")
    rows = rows.withColumn("__h", F.xxhash64("__text"))
    sizes = rows.select("__id", "__h", "__y", F.octet_length("__text").alias("__n")).orderBy(F.xxhash64("__id"), "__id", "__h").limit(2 * most).collect()
    taken, spent = set(), {0: 0, 1: 0}
    for r in sizes:
        if (r["__id"], r["__h"]) not in taken and spent[r["__y"]] + r["__n"] <= most_bytes:
            taken.add((r["__id"], r["__h"]))
            spent[r["__y"]] += r["__n"]
    picked = df_of(docs, sorted(taken, key=str), rows)
    got = sorted({tuple(r) for r in rows.join(F.broadcast(picked), ["__id", "__h"]).select("__id", "__text", "__y").collect()}, key=lambda r: (r[0], r[1]))
    of = {r["__y"]: r["n"] for r in known.groupBy("__y").agg(F.count(F.lit(1)).alias("n")).collect()}
    model = fit([r[1] for r in got], [r[2] for r in got], weights=tuple(max(1.0, of.get(v, 0) / most) for v in (0, 1)))
    del got
    freed()
    return model


def scored(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """`df` without its text, with score double, n_offending long and the worst sentence's worst_start, worst_end long and worst_score double.

    Offsets are code points, end exclusive. A null text is an empty one: its score is 0, that of
    one empty sentence. Repeated rows stay, texts are scored whole, an empty table gives an empty table.
    """
    new = ["score", "n_offending", "worst_start", "worst_end", "worst_score"]
    own = [c for c in df.columns if c not in (text, *new)]
    shared = df.sparkSession.sparkContext.broadcast((model.bias, model.weights))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*shared.value)
        for b in batches(it):
            rows = []
            for x in b.column(b.num_columns - 1).to_pylist():
                s, found = m.score(x)
                worst = max(found, key=lambda f: (f[2], -f[0]))
                rows.append((s, sum(f[2] >= 0.5 for f in found), *worst))
            cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.float64()), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *cols], names=[*b.schema.names[:-1], *new])

    kept = df.select(*[F.col(f"`{c}`") for c in own], text_or_empty(f"`{text}`").alias("__text"))
    schema = kept.drop("__text").schema
    for c, t in zip(new, ("double", "long", "long", "long", "double"), strict=True):
        schema = schema.add(c, t)
    return mapped(kept, run, schema)


def op5_toxicity(spark: SparkSession, sf_dir: str, threshold: float = 0.3) -> DataFrame:
    """Toxicity of every document, learned from labels outside the held-out quarter."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = trained(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))
    out = scored(docs, model)
    return out.select(
        "doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_offending", "worst_start", "worst_end", "worst_score"
    )
