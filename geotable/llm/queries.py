"""Queries over this subpackage's operators, and their SQL where SQL can express them."""

from __future__ import annotations

from geotable.llm import licenses
from geotable.llm.decontamination import op6_decontamination
from geotable.llm.hilbert_shards import op1_hilbert_shards
from geotable.llm.licenses import op3_licenses
from geotable.llm.minhash import op7_minhash
from geotable.llm.packing import op8_packing
from geotable.llm.secrets import op2_secrets
from geotable.llm.spotsigs import op9_spotsigs
from geotable.llm.token_counts import op4_token_counts
from geotable.llm.toxicity import op5_toxicity
from geotable.llm.url_filter import op10_url_filter

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _licenses_sql() -> str:
    """Every block against every template, and phrases by the places of their words."""
    word = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
    of = lambda c: f"regexp_extract_all(translate({c}, '{_UP}', '{_LOW}'), {word})"
    rows = []
    for label, text in licenses.TEMPLATES:
        words = licenses.words_of(text)
        rows.append(f"('{label}', {words!r}, {licenses.need_of(len(words), licenses.CONTAINMENT)})")
    places = []
    for phrase, label in licenses.PHRASES.items():
        parts = phrase.split()
        same = " AND ".join(f"ws[i + {k}] = '{x}'" for k, x in enumerate(parts, 1))
        places.append(f"list_transform(list_filter(range(0, len(ws) - {len(parts) - 1}), lambda i: {same}), lambda i: {{'at': i, 'label': '{label}'}})")
    cut_of = lambda c: rf"regexp_replace(regexp_replace({c}, '[.!?]+([ \t\n\x0B\f\r])', chr(10) || '\1', 'g'), '[.!?]+$', '')"
    cut = cut_of("COALESCE(text, '')")
    # paragraphs: blank lines part them, other line ends are blanks
    whole = cut_of(r"translate(regexp_replace(replace(COALESCE(text, ''), chr(13) || chr(10), chr(10)), '[\n\r]([ \t]*[\n\r])+', '|', 'g'), chr(10) || chr(13), '  ')")
    return f"""
WITH t(label, ws, need) AS (VALUES {", ".join(rows)}),
d AS (SELECT doc_id, {of("COALESCE(text, '')")} AS ws, {cut} AS cut, {whole} AS whole FROM documents),
p AS (SELECT doc_id, ws, cut, list_concat({places[0]}, list_concat({places[1]}, {places[2]})) AS ps FROM d),
b AS (SELECT DISTINCT doc_id, list_sort(list_distinct({of("block")})) AS bw FROM (SELECT doc_id, unnest(list_concat(regexp_split_to_array(cut, '[\n\r|]'), regexp_split_to_array(whole, '[\n\r|]'))) AS block FROM d) x),
m AS (SELECT b.doc_id, bw, label, list_intersect(bw, t.ws) AS held, len(list_intersect(bw, t.ws)) / CAST(len(t.ws) AS DOUBLE) AS c FROM b JOIN t ON len(list_intersect(bw, t.ws)) >= t.need),
own AS (SELECT f.doc_id, f.label, f.c FROM m f WHERE NOT EXISTS (SELECT 1 FROM m g WHERE g.doc_id = f.doc_id AND g.bw = f.bw AND len(list_intersect(f.held, g.held)) = len(f.held) AND (len(f.held) < len(g.held) OR f.c < g.c))),
g AS (SELECT doc_id, list(DISTINCT label) AS more, MAX(c) AS c FROM own GROUP BY doc_id)
SELECT p.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ps) AS BIGINT) AS n_base,
  CASE WHEN len(ps) > 0 THEN CAST(list_min(list_transform(ps, lambda x: x.at)) AS BIGINT) END AS first_word,
  CASE WHEN len(ps) > 0 THEN CAST(list_max(list_transform(ps, lambda x: x.at)) AS BIGINT) END AS last_word,
  array_to_string(list_sort(list_distinct(list_transform(ps, lambda x: x.label))), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(list_transform(ps, lambda x: x.label), COALESCE(more, CAST([] AS VARCHAR[]))))), ',') AS labels,
  CASE WHEN len(ps) > 0 THEN 1.0::DOUBLE ELSE COALESCE(g.c, 0.0::DOUBLE) END AS score
FROM p LEFT JOIN g ON g.doc_id = p.doc_id"""


QUERIES = {
    "op1_hilbert_shards": op1_hilbert_shards,
    "op2_secrets": op2_secrets,
    "op3_licenses": op3_licenses,
    "op4_token_counts": op4_token_counts,
    "op5_toxicity": op5_toxicity,
    "op6_decontamination": op6_decontamination,
    "op7_minhash": op7_minhash,
    "op8_packing": op8_packing,
    "op9_spotsigs": op9_spotsigs,
    "op10_url_filter": op10_url_filter,
}

ORACLES = {
    "op3_licenses": _licenses_sql(),
    # every pair of documents with a common shingle, and reachability over the links: exact, for small tables
    "op7_minhash": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) END) AS sh FROM w
), n AS (SELECT doc_id, COUNT(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS u, b.doc_id AS v, COUNT(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
p AS (SELECT u, v FROM c JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT u, v FROM p UNION ALL SELECT v, u FROM p),
r(doc_id, least) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.v, r.least FROM r JOIN e ON r.doc_id = e.u WHERE r.least < e.v)
SELECT r.doc_id, COALESCE(MAX(n.n), 0) AS n_shingles, MIN(r.least) AS component_id, r.doc_id = MIN(r.least) AS kept
FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id""",
}
