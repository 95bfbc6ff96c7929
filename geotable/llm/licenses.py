"""License scan by an exact set-similarity join, in DataFrame operations alone.

Text blocks (sentences of lines, and of paragraphs whatever their line ends) are matched against license templates: a block has a template's label
when it holds at least CONTAINMENT of the template's distinct words. The templates' words are ordered by
their frequency over all documents, rarest first. A block that reaches need = ceil(CONTAINMENT * size) of a
template's words has one of its first size - need + 1, the prefix (prefix filter); it has at least `need`
words of the templates at all (length filter); and what follows the first shared word on both sides must
still suffice (positional filter). What passes is verified on the full sets, so the join is exact.

Equal blocks are joined once, however many documents repeat them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geotable.llm.common import cut, looked_up, text_or_empty

CONTAINMENT = 0.8

WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_W, _S = WORD[:-1], r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
BASE = rf"(?<!{_W})(?i:" + "|".join(p.replace(" ", _S) for p in PHRASES) + rf")(?!{_W})"

#: Label and text of a template; several may have one label. Sentences of public license notices.
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "Distributed on an as is basis, without warranties or conditions of any kind, either express or implied"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-2.0", "Licensed under the GNU General Public License, version 2"),
    ("gpl-2.0", "You can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "Licensed under the GNU Lesser General Public License"),
    ("agpl-3.0", "Licensed under the GNU Affero General Public License, version 3"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License"),
    ("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work"),
]


def words_of(text: str) -> list[str]:
    """Distinct ASCII words of a template in lower case, in order of appearance."""
    out = "".join(c if c.isalnum() else " " for c in text.lower()).split()
    return list(dict.fromkeys(out))


def lower_words(text: Column) -> Column:
    """Words of a text with A-Z lower-cased."""
    return F.regexp_extract_all(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(WORD), F.lit(0))


def counted(df: DataFrame, text: str) -> DataFrame:
    """`df`, which has __low (the lower-cased text) and __words (its words), with n_words, n_base, first_word, last_word (long) and __base (array of labels)."""
    n = lambda c: F.regexp_count(c, F.lit(WORD)).cast("long")
    # every phrase has one of these in the lower-cased text, so other texts need no search
    low = F.col("__low")
    maybe = F.contains(low, F.lit("reserved")) | F.contains(low, F.lit("license")) | F.contains(low, F.lit("cc")) & F.contains(low, F.lit("by"))
    out = df.withColumn("__text", text_or_empty(f"`{text}`")).withColumn("n_words", F.size("__words").cast("long"))
    out = out.withColumn("__hits", F.when(maybe, F.regexp_extract_all(F.col("__text"), F.lit(BASE), F.lit(0))).otherwise(F.expr("CAST(array() AS array<string>)")))
    some = F.size("__hits") > 0
    out = out.withColumn("__gaps", F.when(some, F.split("__text", BASE, -1))).withColumn("n_base", F.size("__hits").cast("long"))
    first = {p[0]: v for p, v in PHRASES.items()}
    pick = lambda h: F.element_at(F.create_map(*[F.lit(x) for kv in first.items() for x in kv]), F.lower(F.left(h, F.lit(1))))
    out = out.withColumn("first_word", F.when(some, n(F.element_at("__gaps", 1))))
    out = out.withColumn("last_word", F.when(some, F.col("n_words") - n(F.element_at("__gaps", -1)) - n(F.element_at("__hits", -1))))
    out = out.withColumn("__base", F.when(some, F.array_sort(F.array_distinct(F.transform("__hits", pick)))).otherwise(F.expr("CAST(array() AS array<string>)")))
    return out.drop("__text", "__hits", "__gaps")


def frequencies(rows: DataFrame) -> dict[str, int]:
    """In how many rows each word of the (bounded) vocabulary occurs, over all rows; rows have them in __known."""
    seen = rows.select(F.explode("__known").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    return {r["w"]: r["n"] for r in seen.collect()}


def need_of(size: int, containment: float) -> int:
    """Words of a template of `size` that a block must hold."""
    return max(1, math.ceil(containment * size - 1e-9))


def ordered(templates: list[tuple[str, str]], seen: dict[str, int], containment: float) -> tuple[dict[str, int], list[dict]]:
    """Rank of each word (rarest first), and templates with label, ranks (ascending), need and prefix."""
    sets = [(label, words_of(t)) for label, t in templates]
    rank = {w: i for i, w in enumerate(sorted({w for _, s in sets for w in s}, key=lambda w: (seen.get(w, 0), w)))}
    out = []
    for i, (label, s) in enumerate(sets):
        ranks, need = sorted(rank[w] for w in s), need_of(len(s), containment)
        out.append({"id": i, "label": label, "ranks": ranks, "need": need, "prefix": ranks[: len(ranks) - need + 1]})
    return rank, out


def blocks(text: Column) -> Column:
    """Sentences of a text's lines, and those of its paragraphs, where a single line end is a blank (so wrapped ones are whole)."""
    cuts = r"[.!?]+(?=\s|\z)|[\n\r|]"
    # blank lines part paragraphs
    whole = F.translate(F.regexp_replace(text, r"(?>\r\n|[\n\r])(?:[ \t]*+(?>\r\n|[\n\r]))+", "|"), "\n\r", "  ")
    return F.concat(F.split(text, cuts), F.when(text.rlike(r"[\n\r]"), F.split(whole, cuts)).otherwise(F.expr("CAST(array() AS array<string>)")))


def matched(ranked: DataFrame, templates: list[dict]) -> DataFrame:
    """(block, labels, score) for blocks (arrays of distinct ranks, ascending) that reach a template; each distinct block once.

    Near relatives reach each other's threshold, so a template is left out where all its words that the block holds are
    also words of another reached template, which has more words in the block, or as many and the larger containment.
    """
    one = lambda t, r, i: F.struct(
        F.lit(t["id"]).alias("id"), F.lit(t["label"]).alias("label"), F.array(*map(F.lit, t["ranks"])).alias("ranks"), F.lit(t["need"]).alias("need"), F.lit(r).alias("rank"), F.lit(i).alias("i")
    )
    rows = F.array(*[one(t, r, i) for t in templates for i, r in enumerate(t["prefix"])])
    table = F.broadcast(ranked.sparkSession.range(1).select(F.inline(rows)))  # as many rows as the templates have prefix words
    words = ranked.distinct().select("block", F.posexplode("block").alias("j", "rank"))
    left = F.least(F.size("ranks") - F.col("i"), F.size("block") - F.col("j"))
    met = words.join(table, "rank").where((F.size("block") >= F.col("need")) & (left >= F.col("need") - (F.least("i", "j"))))
    both = F.array_sort(F.array_intersect("block", "ranks"))
    found = met.select("block", "id", "label", both.alias("both"), "need", F.size("ranks").alias("size")).where("size(both) >= need").distinct()
    found = found.groupBy("block").agg(F.collect_list(F.struct((F.size("both") / F.col("size")).alias("c"), "label", "both")).alias("found"))  # at most one entry a template
    within = lambda f, g: (F.size(F.array_except(f["both"], g["both"])) == 0) & ((F.size(f["both"]) < F.size(g["both"])) | (f["c"] < g["c"]))
    own = F.filter("found", lambda f: ~F.exists("found", lambda g: within(f, g)))
    return found.select("block", F.array_distinct(F.transform(own, lambda f: f["label"])).alias("labels"), F.array_max(F.col("found.c")).alias("score"))


def license_labels(df: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, containment: float = CONTAINMENT, text: str = "text") -> DataFrame:
    """`df` without its text, with n_words, n_base, first_word, last_word, base_labels, labels, score (replacing columns of those names).

    Base labels come from phrases, the others from templates. score is the largest containment of a template that is
    reached, 1 where a phrase stands, else 0. Null texts are empty: no words, null positions, no labels. Repeated rows
    stay; an empty table gives an empty table; texts are searched whole.
    """
    new = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    own = [c for c in df.columns if c not in (text, *new)]
    sets_of = [set(words_of(t)) for _, t in templates]
    needs = [need_of(len(w), containment) for w in sets_of]
    words = lambda w: F.array(*map(F.lit, sorted(w))).cast("array<string>")
    vocabulary = words(set().union(*sets_of))

    # lower() differs from lower-casing A-Z in other letters alone, so words are as many; blocks are taken exactly below
    rows = df.select(*[F.col(f"`{c}`") for c in own], F.col(f"`{text}`")).withColumn("__low", F.lower(text_or_empty(f"`{text}`")))
    rows = rows.withColumn("__words", F.regexp_extract_all("__low", F.lit(WORD), F.lit(0))).withColumn("__known", F.array_intersect("__words", vocabulary))
    rows = counted(rows, text)
    # a text without enough of any template's words has no block with enough
    open_ = F.lit(False)
    for w, need in zip(sets_of, needs, strict=True):
        open_ = open_ | (F.size(F.array_intersect("__known", words(w))) >= need)
    known = F.transform(blocks(text_or_empty(f"`{text}`")), lambda b: F.array_intersect(lower_words(b), vocabulary))
    found = F.array_distinct(F.filter(known, lambda b: F.size(b) >= min(needs, default=1)))
    rows = rows.withColumn("__found", F.when(open_, found).otherwise(F.expr("CAST(array() AS array<array<string>>)")))
    rows = cut(rows.drop(text, "__low", "__words"))

    rank, sets = ordered(templates, frequencies(rows), containment)
    known = F.create_map(*[F.lit(x) for kv in rank.items() for x in kv]) if rank else F.expr("CAST(map() AS map<string,int>)")
    ranks = F.transform("__found", lambda b: F.array_sort(F.transform(b, lambda w: F.try_element_at(known, w))))
    rows = rows.withColumn("__blocks", F.when(F.size("__found") > 0, ranks).otherwise(F.expr("CAST(array() AS array<array<int>>)"))).drop("__found", "__known")
    labels = cut(matched(rows.select(F.explode("__blocks").alias("block")), sets))

    # what a row's blocks add: rows with equal sets of blocks are looked up once
    asked = rows.where(F.size("__blocks") > 0).select("__blocks").distinct().select("__blocks", F.explode("__blocks").alias("block"))
    given = looked_up(asked, labels, "block", "inner")
    given = cut(given.groupBy("__blocks").agg(F.array_distinct(F.flatten(F.collect_set("labels"))).alias("__more"), F.max("score").alias("__score")))
    # most rows have no block with enough words: they don't enter the join
    some = looked_up(rows.where(F.size("__blocks") > 0), given, "__blocks")
    rest = rows.where(F.size("__blocks") == 0).withColumn("__more", F.lit(None).cast("array<string>")).withColumn("__score", F.lit(None).cast("double"))
    out = some.unionByName(rest)
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    none = F.expr("CAST(array() AS array<string>)")
    return out.select(
        *[F.col(f"`{c}`") for c in own],
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        joined(F.col("__base")).alias("base_labels"),
        joined(F.concat("__base", F.coalesce("__more", none))).alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("__score", F.lit(0.0))).alias("score"),
    )


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and templates in every document."""
    return license_labels(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
