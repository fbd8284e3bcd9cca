"""SQL for the operators whose results SQL can express on whole tables, written from their contracts, not their methods.

Trained models (3), tokenizers (1, 8, 10) and what an index finds (6) are beyond it; tests/llm holds them against brute
force, the tokenizers library and measured recall.
"""

from __future__ import annotations

from .licenses import PHRASES, TEMPLATES, tokens_of

LOWER = "translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORD = r"'[^\x20\x09-\x0D]+'"
COMPONENTS = """reach(a, b) AS (SELECT id, id FROM nodes UNION SELECT r.a, l.y FROM reach r JOIN pairs l ON r.b = l.x), roots AS (SELECT a AS id, min(b) AS root FROM reach GROUP BY a)"""

NEAR_DOCUMENTS = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({LOWER}, {WORD}) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
links AS (SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2) p JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
pairs AS (SELECT a AS x, b AS y FROM links UNION ALL SELECT b, a FROM links), nodes AS (SELECT DISTINCT x AS id FROM pairs), {COMPONENTS}
SELECT d.doc_id, COALESCE(n.n, 0) AS n_shingles, COALESCE(root, d.doc_id) AS component_id, COALESCE(root, d.doc_id) = d.doc_id AS kept FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN roots ON id = d.doc_id"""

WARC = """WITH p AS (SELECT page_id, encode(COALESCE(html, '')) AS b FROM pages), d AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY digest) AS last FROM d)
SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN n >= 1000 AND last > page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN n >= 1000 AND last > page_id THEN last END AS refers_to FROM m"""

SUBSTRINGS = f"""WITH w AS (SELECT doc_id, regexp_extract_all(COALESCE(text, ''), {WORD}) AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM w WHERE len(w) >= 13)),
bad AS (SELECT doc_id, i FROM win JOIN (SELECT h, min(doc_id) AS m FROM win GROUP BY h) USING (h) WHERE m < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS k FROM bad),
each AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS k FROM w),
kept AS (SELECT e.doc_id, count(g.k) AS n_removed, string_agg(word, ' ' ORDER BY e.k) FILTER (g.k IS NULL) AS text FROM each e LEFT JOIN gone g ON g.doc_id = e.doc_id AND g.k = e.k GROUP BY 1)
SELECT w.doc_id, len(w) AS n_words, COALESCE(n_removed, 0) AS n_removed, sha256(COALESCE(kept.text, '')) AS kept_sha256 FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id"""

NEAR_VECTORS = f"""WITH RECURSIVE good AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x != 0)) > 0),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM good x JOIN good y ON x.label = y.label AND x.vec_id < y.vec_id AND len(x.v) = len(y.v) WHERE list_dot_product(x.v, y.v) / (sqrt(list_dot_product(x.v, x.v)) * sqrt(list_dot_product(y.v, y.v))) >= 0.93e0),
pairs AS (SELECT a AS x, b AS y FROM links UNION ALL SELECT b, a FROM links), nodes AS (SELECT DISTINCT x AS id FROM pairs), {COMPONENTS}
SELECT e.vec_id, COALESCE(c, 0) AS n_links, COALESCE(root, e.vec_id) AS component_id, COALESCE(root, e.vec_id) = e.vec_id AS kept FROM embeddings e LEFT JOIN (SELECT x, count(*) AS c FROM pairs GROUP BY 1) ON x = e.vec_id LEFT JOIN roots ON id = e.vec_id"""


def pattern(template: str) -> str:
    """A template as a regular expression over a line of words, each with a blank after it."""
    marks = {"[[": "(?:(?:", "|": ")|(?:", "]]": "))?"}
    return "".join(marks.get(t) or (f"(?:[^ ]+ ){{1,{t[2:-2]}}}" if t.startswith("<<") else t + " ") for t in tokens_of(template))


def licenses() -> str:
    """Labels by regular expressions on the line of words, places of base phrases by comparing words."""
    found = ", ".join(f"CASE WHEN regexp_matches(line, ' {pattern(t)}') THEN '{label}' END" for label, t in TEMPLATES.items())
    starts = []
    for phrase in PHRASES:
        words = phrase.split()
        same = " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(words))
        starts.append(f"list_filter(range(1, len(w) - {len(words) - 2}), lambda i: {same})")
    base = ", ".join(f"CASE WHEN len(p{n}) > 0 THEN '{label}' END" for n, label in enumerate(PHRASES.values()))
    every = "list_concat(" * (len(starts) - 1) + "p0" + "".join(f", p{n})" for n in range(1, len(starts)))
    return f"""WITH w AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
p AS (SELECT doc_id, w, ' ' || array_to_string(w, ' ') || ' ' AS line, {', '.join(f'{x} AS p{n}' for n, x in enumerate(starts))} FROM w),
l AS (SELECT doc_id, len(w) AS n_words, {every} AS places, list_sort(list_filter([{base}], lambda x: x IS NOT NULL)) AS base, list_filter([{found}], lambda x: x IS NOT NULL) AS found FROM p)
SELECT doc_id, n_words, len(places) AS n_base, list_min(places) - 1 AS first_word, list_max(places) - 1 AS last_word, array_to_string(base, ',') AS base_labels,
 array_to_string(list_sort(list_distinct(list_concat(base, found))), ',') AS labels, CASE WHEN len(base) + len(found) > 0 THEN 1e0 ELSE 0e0 END AS score FROM l"""


def oracle_sql() -> dict[str, str]:
    return {"op2_near_documents": NEAR_DOCUMENTS, "op4_license_scan": licenses(), "op5_warc": WARC, "op7_substrings": SUBSTRINGS, "op9_near_vectors": NEAR_VECTORS}
