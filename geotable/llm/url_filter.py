"""URL filter: rules first, then gradient-boosted trees on lexical features.

Labels are a table (url, label). A row's suffix statistics, as it is trained on, come from the other folds of hosts, so
its own label is not in them; what is scored has those of all labels.

A rule names a host and a path prefix, and fits that host with all its subdomains; the longest rule
wins. URLs that no rule fits are judged by trees trained from labelled URLs. Features come from the URL
alone (lengths, depth, digit ratios, entropy, parameter counts) and from statistics of its suffix, which
are counted over all rows in a bounded number of hash buckets.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geotable.llm.common import batches, mapped

RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]
#: Words of hosts that label a URL as one to block (labels by distant supervision, as for any blocklist of words).
BAD_WORDS = ["adult", "ads", "casino", "cheap", "free", "loan", "pills", "poker", "porn", "spam", "viagra", "win", "xxx"]
#: Hash buckets of suffixes, and folds of hosts; they bound what is collected.
BUCKETS, FOLDS = 4096, 4
NAMES = (
    "length host_length path_length depth digit_ratio host_digit_ratio longest_digits hyphens dots entropy host_entropy vowel_ratio params fragment extension https "
    "longest_label suffix_share suffix_rate"
).split()


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest rule that fits, as written, or null."""
    out = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: len(r[0])):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit("/" + rest))
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values()) if n else 0.0


def lexical(url: str, host: str, path: str) -> list[float]:
    """The features of a URL but for its suffix's."""
    digits = run = longest = 0
    for c in url:
        run = run + 1 if c.isdigit() else 0
        digits += c.isdigit()
        longest = max(longest, run)
    query = url.partition("?")[2].partition("#")[0]
    letters = sum(c.isalpha() for c in host)
    return [
        len(url), len(host), len(path), sum(bool(p) for p in path.split("/")), digits / max(1, len(url)), sum(c.isdigit() for c in host) / max(1, len(host)), longest, host.count("-"), host.count("."),
        entropy(url), entropy(host), sum(c in "aeiou" for c in host) / max(1, letters), sum(bool(p) for p in query.split("&")), float("#" in url), float("." in path.rsplit("/", 1)[-1]),
        float(url.startswith("https:")), max(map(len, host.split("."))),
    ]


@dataclass
class Trees:
    """Boosted trees over binned features; a node is (feature, bin, left, right) or a leaf's value."""

    base: float
    edges: list[np.ndarray]
    trees: list[list[tuple]]

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1) if self.edges else np.zeros((len(x), 0), int)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1."""
        b, z = self.binned(x), np.full(len(x), self.base)
        for tree in self.trees:
            at = np.zeros(len(x), dtype=int)
            feature, cut, left, right, value = (np.array(v) for v in zip(*tree, strict=True))
            while (inner := feature[at] >= 0).any():
                i = np.flatnonzero(inner)
                go = b[i, feature[at[i]]] <= cut[at[i]]
                at[i] = np.where(go, left[at[i]], right[at[i]])
            z += value[at]
        return 1 / (1 + np.exp(-z))


def boosted(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32, least: float = 1.0) -> Trees:
    """Second-order boosting of the logistic loss on histograms."""
    if not len(y) or y.min() == y.max():
        return Trees(20.0 if len(y) and y[0] == 1 else -20.0, [], [])
    edges = [np.unique(np.quantile(x[:, j], np.arange(1, bins) / bins)) for j in range(x.shape[1])]
    out = Trees(float(np.log(y.mean() / (1 - y.mean()))), edges, [])
    b, z = out.binned(x), np.full(len(y), out.base)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-z))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        tree: list[list] = [[-1, 0, 0, 0, 0.0]]
        open_: list[tuple[int, np.ndarray, int]] = [(0, np.arange(len(y)), 0)]
        while open_:
            node, rows, level = open_.pop()
            gs, hs = g[rows].sum(), h[rows].sum()
            best = (1e-3, -1, 0)
            for j in range(x.shape[1]) if level < depth else ():
                gl = np.bincount(b[rows, j], g[rows], minlength=bins)[:-1].cumsum()
                hl = np.bincount(b[rows, j], h[rows], minlength=bins)[:-1].cumsum()
                gain = np.where((hl >= least) & (hs - hl >= least), gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1), 0)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (float(gain[k]), j, k)
            if best[1] < 0:
                tree[node][4] = -rate * gs / (hs + 1)
                z[rows] += tree[node][4]
                continue
            go = b[rows, best[1]] <= best[2]
            tree[node][:4] = [best[1], best[2], len(tree), len(tree) + 1]
            tree += [[-1, 0, 0, 0, 0.0], [-1, 0, 0, 0, 0.0]]
            open_ += [(len(tree) - 2, rows[go], level + 1), (len(tree) - 1, rows[~go], level + 1)]
        out.trees.append([tuple(t) for t in tree])
    return out


def suffix_bucket(host: Column) -> Column:
    """The bucket of a host's last label."""
    return F.pmod(F.crc32(F.substring_index(host, ".", -1)), F.lit(BUCKETS)).cast("int")


def fold_of(host: Column) -> Column:
    """The fold of a host; its subdomains may have others."""
    return F.pmod(F.xxhash64(host), F.lit(FOLDS)).cast("int")


def suffix_tables(rows: DataFrame) -> np.ndarray:
    """Per bucket the log share of all rows and the rate of label 1 among labelled rows, drawn to the mean as by 20 rows: FOLDS tables, each without a fold's labels, then one with all."""
    got = rows.groupBy(suffix_bucket(F.col("host")).alias("b"), fold_of(F.col("host")).alias("f")).agg(F.count(F.lit(1)).alias("n"), F.count("label").alias("m"), F.sum("label").alias("s")).collect()  # at most BUCKETS * FOLDS rows
    n, m, s = np.zeros(BUCKETS), np.zeros((BUCKETS, FOLDS)), np.zeros((BUCKETS, FOLDS))
    for r in got:
        n[r["b"]] += r["n"]
        m[r["b"], r["f"]], s[r["b"], r["f"]] = r["m"], r["s"] or 0
    share, out = np.log((n + 0.5) / (n.sum() + 1)), []
    for without in [*range(FOLDS), None]:
        mm, ss = (x.sum(axis=1) if without is None else np.delete(x, without, axis=1).sum(axis=1) for x in (m, s))
        mean = ss.sum() / mm.sum() if mm.sum() else 0.0
        out.append(np.stack([share, (ss + 20 * mean) / (mm + 20)], axis=1))
    return np.stack(out)


def vectors(urls: list, hosts: list, paths: list, buckets: list, suffixes: np.ndarray, folds: list | None = None) -> np.ndarray:
    """Features; `suffixes` has the tables of suffix_tables(), and of them the one without a row's fold is taken, or the last."""
    x = np.array([lexical(u or "", h, p) for u, h, p in zip(urls, hosts, paths, strict=True)]).reshape(len(urls), len(NAMES) - 2)
    return np.concatenate([x, suffixes[-1 if folds is None else np.array(folds, dtype=int), np.array(buckets, dtype=int)]], axis=1)


def trained(rows: DataFrame, suffixes: np.ndarray, most: int = 20_000) -> Trees:
    """Trees from the rows that have a label (0 or 1): `most` of each label at most, chosen by a hash of the URL."""
    got = []
    for v in (0, 1):
        some = rows.where(F.col("label") == v).select("url", "host", "path", suffix_bucket(F.col("host")).alias("b"), fold_of(F.col("host")).alias("f"), "label")
        got += some.orderBy(F.xxhash64("url"), "url").limit(most).collect()
    if not got:
        return boosted(np.zeros((0, len(NAMES))), np.zeros(0))
    urls, hosts, paths, b, f, y = zip(*got, strict=True)
    return boosted(vectors(urls, hosts, paths, b, suffixes, f), np.array(y, dtype=float))


def measured(labels: DataFrame, most: int = 20_000) -> dict[str, float]:
    """Precision and recall of label 1 on the hosts of fold 0, by trees that are trained on the other folds alone; and the share of label 1 there (what calling all of them 1 would give)."""
    rows = labels.select("url", F.col("label").cast("int").alias("label")).withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    known = rows.where(fold_of(F.col("host")) != 0)
    trees, suffixes = trained(known, tables := suffix_tables(known), most), tables
    got = rows.where(fold_of(F.col("host")) == 0).select("url", "host", "path", suffix_bucket(F.col("host")).alias("b"), "label").orderBy(F.xxhash64("url"), "url").limit(most).collect()
    if not got:
        return {"rows": 0, "precision": 0.0, "recall": 0.0, "share": 0.0}
    urls, hosts, paths, b, y = zip(*got, strict=True)
    said, y = trees.score(vectors(urls, hosts, paths, b, suffixes)) >= 0.5, np.array(y) == 1
    both = float((said & y).sum())
    return {"rows": len(y), "precision": both / max(1, said.sum()), "recall": both / max(1, y.sum()), "share": float(y.mean())}


def judged(df: DataFrame, rules: list[tuple[str, str]], labels: DataFrame | None = None, url: str = "url") -> DataFrame:
    """`df` with host, path, rule, verdict and score (replacing columns of those names).

    `labels` (url, label 1 to block) trains the trees; without it, the URLs that the rules fit are the
    labelled ones. score is the trees' probability of block, for every row. A null URL, or one without
    "://", has an empty host and path. Without labels of both kinds the trees say the only one, or allow.
    """
    spark = df.sparkSession
    own = [c for c in df.columns if c not in ("host", "path", "rule", "verdict", "score")]
    said = F.element_at(F.create_map(*[F.lit(x) for r in rules for x in r]), F.col("rule")) if rules else F.lit(None).cast("string")
    u = F.col(f"`{url}`").cast("string")
    parsed = df.select(*[F.col(f"`{c}`") for c in own], host_of(u).alias("host"), path_of(u).alias("path"))
    parsed = parsed.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules)).withColumn("__said", said)
    if labels is None:
        known = parsed.select(u.alias("url"), "host", "path", (F.col("__said") == "block").cast("int").alias("label"))
    else:
        taught = labels.select("url", F.col("label").cast("int").alias("label")).withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
        known = parsed.select(u.alias("url"), "host", "path", F.lit(None).cast("int").alias("label")).union(taught.select("url", "host", "path", "label"))
    suffixes = suffix_tables(known)
    trees = trained(known.where("label is not null"), suffixes)
    shared = spark.sparkContext.broadcast((trees, suffixes))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, table = shared.value
        for b in batches(it, rows=2048):
            x = vectors(*(b.column(i).to_pylist() for i in range(b.num_columns - 4, b.num_columns)), table)
            yield pa.RecordBatch.from_arrays([*b.columns[:-4], pa.array(model.score(x), pa.float64())], names=[*b.schema.names[:-4], "score"])

    kept = parsed.select(*[F.col(f"`{c}`") for c in own], "host", "path", "rule", "__said", u.alias("__url"), F.col("host").alias("__host"), F.col("path").alias("__path"), suffix_bucket(F.col("host")).alias("__b"))
    schema = kept.drop("__url", "__host", "__path", "__b").schema.add("score", "double")
    out = mapped(kept, run, schema)
    verdict = F.coalesce(F.col("__said"), F.when(F.col("score") >= 0.5, "block").otherwise("allow"))
    return out.withColumn("verdict", verdict).drop("__said")


def labelled(pages: DataFrame, rules: list[tuple[str, str]], url: str = "url") -> DataFrame:
    """(url, label): 1 where a whole word of the host (split at dots and hyphens) is in BAD_WORDS, else 0 where a rule allows it; other URLs have none."""
    u = F.col(f"`{url}`").cast("string")
    host, allowed = host_of(u), [r for r, v in rules if v == "allow"]
    bad = F.arrays_overlap(F.split(host, "[.-]"), F.array(*map(F.lit, BAD_WORDS)))
    label = F.when(bad, 1).when(rule_of(host, path_of(u), rules).isin(allowed), 0)
    return pages.select(u.alias("url"), label.alias("label")).where("label is not null")


def op10_url_filter(spark: SparkSession, sf_dir: str, labels: DataFrame | None = None) -> DataFrame:
    """Every page's URL against five rules, then against trees taught by `labels` (url, label), or without them by allowed URLs and a word list."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judged(pages, RULES, labelled(pages, RULES) if labels is None else labels).select("page_id", "host", "path", "rule", "verdict", "score")
