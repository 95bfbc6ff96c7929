"""The pipeline, stage by stage, on a small corpus with planted cases."""

from __future__ import annotations

import random
import zlib

import corpus_pipeline as P
import numpy as np
import public_tokenizers
import pytest

from geotable.llm import bpe
from geotable.llm import decontamination as D


def corpus():
    rng = random.Random(9)
    words = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    item = words(40)
    texts = {}
    for i in range(0, 400):
        texts[i] = ". ".join(words(9) for _ in range(6))
        if i % 6 == 0:
            texts[i] += ". you vilest " + words(3)
    texts |= {500: texts[1], 501: texts[1] + " more", 502: words(20) + " " + item + " " + words(20), 503: words(30) + " password=abcdef123 " + words(30), 504: "", 505: None}
    labels = [(i, int(i % 6 == 0)) for i in range(400)]
    return texts, labels, item


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    texts, labels, item = corpus()
    rows = [(i, t, "en", "s", len(t or "")) for i, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, y in labels], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_stages(spark, tables):
    texts, labels, item = corpus()
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns = docs.columns
    at = {}
    for name, stage in P.STAGES[:-1]:
        docs = P.cut(stage(spark, docs, tables))
        assert docs.columns == columns
        at[name] = {r.doc_id: r.text for r in docs.collect()}
    toxic = {i for i, y in labels if y}
    assert set(at["toxicity"]) == set(texts) - toxic
    assert set(at["dedup"]) == set(at["toxicity"]) - {500, 501}
    assert set(at["decontamination"]) == set(at["dedup"]) - {502} and D.normal(item) in D.normal(texts[502])
    assert set(at["secrets"]) == set(at["decontamination"])
    assert "password" not in at["secrets"][503] and "[SECRET]" in at["secrets"][503]
    assert all(v == texts[i] for i, v in at["secrets"].items() if i != 503)
    pieces = P.STAGES[-1][1](spark, docs, tables).collect()
    encoder = bpe.get(public_tokenizers.path("byte_bpe_50k.json"))
    whole = {r.doc_id: r for r in pieces if r.length == r.doc_tokens}
    for i, t in at["secrets"].items():
        ids = np.asarray([*encoder.ids(t or ""), 1], dtype="<u4")
        assert whole[i].ids_crc32 == zlib.crc32(ids.tobytes())
    ran = {(r.doc_id, r.start, r.ids_crc32) for r in P.run(spark, tables).collect()}
    assert ran == {(r.doc_id, r.start, r.ids_crc32) for r in pieces}
