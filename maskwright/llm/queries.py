"""Registered queries of the training-data operators, and DuckDB SQL where it can express one."""

from __future__ import annotations

from . import binary, chunks, codes, decontaminate, jaccard, media, packing, quality, resample, sharding, suffix, template, toxicity

QUERIES = {
    "op1_media_columns": media.op1_media_columns,
    "op2_substring_dedup": chunks.op2_substring_dedup,
    "op3_benchmark_decontamination": decontaminate.op3_benchmark_decontamination,
    "op4_ngram_jaccard_join": jaccard.op4_ngram_jaccard_join,
    "op5_suffix_array_dedup": suffix.op5_suffix_array_dedup,
    "op6_best_fit_packing": packing.op6_best_fit_packing,
    "op7_quality_classifier": quality.op7_quality_classifier,
    "op8_sharding": sharding.op8_sharding,
    "op9_token_binary": binary.op9_token_binary,
    "op10_html_extraction": template.op10_html_extraction,
    "op11_vector_codes": codes.op11_vector_codes,
    "op12_toxicity": toxicity.op12_toxicity,
    "op13_importance_resampling": resample.op13_importance_resampling,
}

#: Every 400-byte window of the texts (as hex digits, in blocks of 1000 windows), the windows that occur twice, and what they leave.
_REPEATED_BYTES = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
b AS (SELECT r, k, substr(x, 2000 * k + 1, 2798) AS y FROM (SELECT r, x, unnest(range(0, length(x) // 2000 + 1)) AS k FROM d)),
w AS (SELECT r, 1000 * k + j AS i, hash(substr(y, 2 * j + 1, 800)) AS h FROM (SELECT r, k, y, unnest(range(0, length(y) // 2 - 399)) AS j FROM b)),
m AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY h) AS n FROM w) WHERE n > 1),
f AS (SELECT r, i, coalesce(i > lag(i) OVER (PARTITION BY r ORDER BY i) + 400, true) AS first FROM m),
s AS (SELECT r, min(i) AS a, max(i) + 400 AS b FROM (SELECT r, i, count_if(first) OVER (PARTITION BY r ORDER BY i) AS run FROM f) GROUP BY r, run),
g AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS behind FROM s),
k AS (SELECT r, string_agg(substr(x, 2 * behind + 1, 2 * (a - behind)), '' ORDER BY a) AS before, max(b) AS stop, sum(b - a) AS n_removed, count(*) AS n_spans FROM g JOIN d USING (r) GROUP BY r)
SELECT doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(before, '') || substr(x, 2 * coalesce(stop, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN k USING (r)
"""

#: Sets of five words, classes of equal sets, all pairs of classes that share a shingle, and what is linked over others.
_NEAR_COPIES = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '(?:[a-z0-9]|[^\x00-\x7F])+') AS w FROM documents),
s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)] END)) AS g FROM d),
c AS (SELECT row_number() OVER () AS c, g, copies, doc FROM (SELECT g, count(*) AS copies, min(doc_id) AS doc FROM s GROUP BY g)),
e AS (SELECT c, len(g) AS n, unnest(g) AS t FROM c),
p AS (SELECT a.c AS a, b.c AS b FROM e a JOIN e b ON a.t = b.t AND a.c <> b.c GROUP BY a.c, b.c, a.n, b.n HAVING 5 * count(*) >= 4 * (a.n + b.n - count(*))),
l AS (SELECT a AS c, sum(copies) AS links FROM p JOIN c ON c.c = p.b GROUP BY a),
t(a, b) AS (SELECT c, c FROM c UNION SELECT t.a, p.b FROM t JOIN p ON t.b = p.a),
m AS (SELECT a AS c, min(doc) AS class_id FROM t JOIN c ON c.c = t.b GROUP BY a)
SELECT doc_id, class_id, CAST(copies - 1 + coalesce(links, 0) AS BIGINT) AS n_links, CAST(copies AS BIGINT) AS n_copies FROM s JOIN c ON s.g = c.g JOIN m ON c.c = m.c LEFT JOIN l ON c.c = l.c
"""

#: Integer parts, and each part's 64 entries assigned, moved and assigned again, over all pairs of part and entry.
_VECTOR_CODES = """
WITH k AS (SELECT vec_id, label, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS c, len(embedding) // 16 AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
p AS (SELECT vec_id, p, c[p * w + 1:(p + 1) * w] AS v FROM k, range(16) t(p)),
b0 AS (SELECT p, dense_rank() OVER (ORDER BY vec_id) - 1 AS e, v FROM p WHERE vec_id IN (SELECT vec_id FROM k ORDER BY vec_id LIMIT 64)),
{rounds}
f AS (SELECT vec_id, string_agg(lpad(to_hex(e), 2, '0'), '' ORDER BY p) AS code, sum(d) AS error FROM a2 GROUP BY vec_id),
s AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS sha FROM b2)
SELECT vec_id, lower(code) AS code, CAST(error AS BIGINT) AS error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, sha AS codebooks_sha256 FROM f JOIN k USING (vec_id), s
"""
_ASSIGNED = """a{r} AS (SELECT vec_id, p, arg_min(e, (d, e)) AS e, min(d) AS d FROM (SELECT vec_id, x.p, b.e, list_sum([(x.v[i] - b.v[i]) * (x.v[i] - b.v[i]) FOR i IN range(1, len(x.v) + 1)]) AS d FROM p x JOIN b{r} b ON x.p = b.p) GROUP BY vec_id, p),"""
_MOVED = """m{r} AS (SELECT p, e, i, CAST(floor(sum(x.v[i]) / count(*)) AS BIGINT) AS c FROM p x JOIN a{r} USING (vec_id, p), range(1, (SELECT max(w) + 1 FROM k)) t(i) GROUP BY p, e, i),
b{s} AS (SELECT p, e, coalesce(n.v, b.v) AS v FROM b{r} b LEFT JOIN (SELECT p, e, list(c ORDER BY i) AS v FROM m{r} GROUP BY p, e) n USING (p, e)),"""
_VECTOR_CODES = _VECTOR_CODES.format(rounds="\n".join([*(x.format(r=r, s=r + 1) for r in (0, 1) for x in (_ASSIGNED, _MOVED)), _ASSIGNED.format(r=2)]))

#: Runs of one to three words, their crc32 bit by bit through a table made by its rule, gains of buckets, and the order of scores.
_RESAMPLED = r"""
WITH z AS (SELECT [list_reduce([0, 1, 2, 3, 4, 5, 6, 7], lambda c, j: xor(c >> 1, (c & 1) * 3988292384), CAST(i AS BIGINT)) FOR i IN range(256)] AS z),
x AS (SELECT 'd' AS kind, doc_id, row_number() OVER () AS r, coalesce(text, '') AS text FROM documents UNION ALL SELECT 'b', NULL, row_number() OVER (), coalesce(text, '') FROM benchmark),
w AS (SELECT kind, doc_id, r, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '(?:[0-9a-z]|[^\x00-\x7F])+') AS w FROM x),
g AS (SELECT kind, r, unnest(list_concat(w, [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))], [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)])) AS f FROM w),
h AS (SELECT f, hex(encode(f)) AS y FROM (SELECT DISTINCT f FROM g)),
c AS (SELECT f, xor(list_reduce([CAST('0x' || y[i:i + 1] AS BIGINT) FOR i IN range(1, length(y), 2)], lambda c, b: xor(c >> 8, z[CAST(xor(c, b) & 255 AS INT) + 1]), 4294967295), 4294967295) % 10000 AS k FROM h, z),
n AS (SELECT kind, r, k, count(*) AS n FROM g JOIN c USING (f) GROUP BY ALL),
s AS (SELECT k, sum(n) FILTER (kind = 'd') AS s, coalesce(sum(n) FILTER (kind = 'b'), 0) AS t FROM n GROUP BY k),
a AS (SELECT coalesce(sum(s), 0) + 10000 AS s, coalesce(sum(t), 0) + 10000 AS t FROM s),
v AS (SELECT k, floor(1000 * ln(CAST(s.t + 1 AS DOUBLE) * CAST(a.s AS DOUBLE) / (CAST(s.s + 1 AS DOUBLE) * CAST(a.t AS DOUBLE)))) AS gain FROM s, a WHERE s.s IS NOT NULL),
q AS (SELECT r, sum(n) AS n, sum(n * gain) AS weight FROM n JOIN v USING (k) WHERE kind = 'd' GROUP BY r),
o AS (SELECT doc_id, len(w) AS words, CAST(coalesce(n, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight, CAST('0x' || sha256('42:' || doc_id)[1:8] AS BIGINT) AS h FROM w LEFT JOIN q USING (r) WHERE kind = 'd'),
e AS (SELECT *, CAST(weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296))) AS BIGINT) AS score FROM o),
i AS (SELECT *, CASE WHEN words >= 20 THEN row_number() OVER (PARTITION BY words >= 20 ORDER BY score DESC, doc_id) END AS i, count(*) FILTER (words >= 20) OVER () AS n FROM e)
SELECT doc_id, n_features, weight, score, CASE WHEN i <= 5 * n // 100 THEN i END AS rank FROM i
"""

ORACLE_SQL: dict[str, str] = {"op4_ngram_jaccard_join": _NEAR_COPIES, "op5_suffix_array_dedup": _REPEATED_BYTES, "op11_vector_codes": _VECTOR_CODES, "op13_importance_resampling": _RESAMPLED}
