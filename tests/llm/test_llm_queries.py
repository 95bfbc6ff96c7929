"""Every opN_ query on small tables: the columns that the queries derive from their operators."""

from __future__ import annotations

import hashlib
import re
import zlib

import pytest

from geotable.llm import queries

TEXTS = [None, "", "password=abcdef12 AKIA" + "A" * 16 + " " + "0" * 24, "All rights reserved. CC BY", "you vilest w1 w2", "the word of the day " * 300, "the word of the day " * 300, "é 😀 text"]


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    docs = [(i, t, "en" if i % 2 else None, f"s{i}", len(t or "")) for i, t in enumerate(TEXTS)]
    docs += [(100 + i, f"plain text number {i} " + ("you vilest" if i % 4 == 0 else "of day") + f" w{i}", "de", "s", 40) for i in range(120)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(100 + i, 1, int(i % 4 == 0)) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, TEXTS[5][:60])], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    urls = ["http://A.example.com/en/1", "https://www.example.com/en/2?x", "ftp://x.net/es/", None, "none", "http://casino-win.example.org/"]
    spark.createDataFrame([(i, u, "") for i, u in enumerate(urls)], "page_id long, url string, html string").write.parquet(f"{d}/pages.parquet")
    return d


def rows(spark, sf, name, key="doc_id"):
    return {r[key]: r for r in queries.QUERIES[name](spark, sf).collect()}


def test_op1(spark, sf):
    got = rows(spark, sf, "op1_hilbert_shards")
    for i, t in enumerate(TEXTS):
        raw = (t or "").encode()
        assert (got[i]["size"], got[i].text_crc32, got[i].law, got[i].grown_shard) == (len(raw) + 8, zlib.crc32(raw), "rows", None)
    assert {r.shard for r in got.values()} <= set(range(24)) and len(got) == len(TEXTS) + 120


def test_op2(spark, sf):
    r = rows(spark, sf, "op2_secrets")
    want = "assign:0:17,access:18:38,hex:39:63"
    assert (r[2].n_assign, r[2].n_access, r[2].n_hex, r[2].spans) == (1, 1, 1, want)
    assert r[2].base_sha256 == hashlib.sha256(want.encode()).hexdigest() and r[0].base_sha256 == hashlib.sha256(b"").hexdigest()


def test_op3(spark, sf):
    r = rows(spark, sf, "op3_licenses")
    assert (r[3].n_words, r[3].n_base, r[3].first_word, r[3].last_word, r[3].base_labels, r[3].score) == (5, 2, 0, 3, "cc-by,reserved", 1.0)
    assert (r[0].n_words, r[0].first_word, r[0].labels, r[0].score) == (0, None, "", 0.0)


def test_op4(spark, sf):
    r = rows(spark, sf, "op4_token_counts")
    assert r[5].over_limit and not r[7].over_limit and (r[0].n_tokens, r[0].n_bytes) == (0, 0) and r[7].n_bytes == len(TEXTS[7].encode())


def test_op5(spark, sf):
    for i, r in rows(spark, sf, "op5_toxicity").items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and r.predicted == int(r.score >= 0.3) == int(i == 4 or i >= 100 and i % 4 == 0)


def test_op6(spark, sf):
    assert set(rows(spark, sf, "op6_decontamination")) == {5, 6}


def test_op7(spark, sf):
    r = rows(spark, sf, "op7_minhash")
    assert (r[6].component_id, r[6].kept, r[5].kept, r[0].n_shingles, r[0].component_id) == (5, False, True, 0, 0)


def test_op8(spark, sf):
    got = queries.QUERIES["op8_packing"](spark, sf).collect()
    assert sum(r.length for r in got if r.doc_id == 5) == next(r.doc_tokens for r in got if r.doc_id == 5) and {r.doc_tokens for r in got if r.doc_id in (0, 1)} == {1}


def test_op9(spark, sf):
    r = rows(spark, sf, "op9_spotsigs")
    assert r[5].fingerprint == r[6].fingerprint and re.fullmatch("[0-9a-f]*", r[5].fingerprint) and r[7].n_chars == len(TEXTS[7]) and r[0].near_next == 1.0


def test_op10(spark, sf):
    r = rows(spark, sf, "op10_url_filter", "page_id")
    assert [(r[i].host, r[i].path, r[i].rule, r[i].verdict) for i in range(3)] == [
        ("a.example.com", "/en/1", "example.com/en/", "block"), ("www.example.com", "/en/2", "www.example.com/en/", "allow"), ("x.net", "/es/", "net/es/", "block"),
    ]
    assert (r[3].host, r[3].rule, r[4].path) == ("", None, "") and {r[i].verdict for i in (3, 4, 5)} <= {"allow", "block"}
