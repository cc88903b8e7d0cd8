"""DuckDB SQL for the training-data queries that SQL can express."""

WORD = r"[^\x20\x09-\x0D]+"

OP5 = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS lines
  FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(ws[i:i+4], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM d WHERE len(ws) >= 5)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM win) WHERE c > 1),
cover AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM rep, range(0, 5) r(j) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
         len(string_split(t, chr(10))) AS n_lines, len(list_distinct(ws)) AS n_distinct,
         len(list_filter(ws, lambda x: regexp_full_match(x, '[^a-zß-öø-ÿ]*[A-ZÀ-ÖØ-Þ][^a-zß-öø-ÿ]*'))) AS n_capitals,
         len(list_filter(ws, lambda x: NOT regexp_matches(x, '[A-Za-zÀ-ÖØ-öø-ÿ]'))) AS n_no_letter, len(lines) AS n_full_lines,
         len(list_filter(lines, lambda x: left(regexp_replace(x, '^[\x20\x09\x0B-\x0D]+', ''), 1) IN ('-', '*', '•'))) AS n_bullets,
         coalesce(list_max(map_values(list_histogram(list_transform(ws, lambda x: lower(x))))), 0) AS n_top
  FROM d LEFT JOIN cover USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > 3 * n_words OR word_chars < 2 * n_words OR word_chars > 14 * n_words
            OR 2 * n_dup_lines > n_lines OR 10 * n_capitals > 6 * n_words OR 20 * n_distinct < n_words
            OR 2 * n_no_letter > n_words OR 10 * n_top > 3 * n_words OR 10 * n_bullets > 9 * n_full_lines) AS kept
FROM b
"""


OP8 = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i+4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
overlap AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM overlap JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 80 * (p.n + q.n - k)),
sym AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT sym.b, r.c FROM r JOIN sym ON sym.a = r.doc_id WHERE r.c < sym.b)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(r.c) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN r USING (doc_id) GROUP BY ALL
"""


OP7 = rf"""
WITH w AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}')) AS t FROM documents),
tf AS (SELECT doc_id, t, count(*) AS c FROM w GROUP BY ALL), dl AS (SELECT doc_id, count(*) AS n FROM w GROUP BY doc_id),
st AS (SELECT count(*) AS n, (SELECT sum(n) FROM dl)::DOUBLE / count(*) AS m FROM documents), df AS (SELECT t, count(*) AS d FROM tf GROUP BY t),
s AS (
  SELECT q.doc_id AS query_id, x.doc_id, round(sum(ln(1 + (st.n - d + 0.5) / (d + 0.5)) * x.c * 2.2 / (x.c + 1.2 * (0.25 + 0.75 * dl.n / st.m))), 6) AS score
  FROM tf q JOIN tf x USING (t) JOIN df USING (t) JOIN dl ON dl.doc_id = x.doc_id, st WHERE q.doc_id % 50 = 0 GROUP BY q.doc_id, x.doc_id)
SELECT query_id, rank::INT AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 10
"""


def _either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(_either_case(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
_ASSIGN = rf"""(?:{_NAMES})["\']?\x20*[:=]\x20*["\']?([A-Za-z0-9+/_.=-]+)""".replace("'", "''")
_KINDS = (("assign", _ASSIGN, 1, 6), ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]{24,}", 0, 24), ("owned", "[A-Za-z0-9+/_=-]{20,}", 0, 20))


def _spans(k: int, kind: str, pattern: str, group: int, least: int) -> str:
    """Rows (doc_id, own, repo, k, kind, s, e, v) of one kind: what lies before a match is gaps and matches up to it."""
    before = "coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0)"
    cut = f"SELECT doc_id, own, repo, regexp_extract_all(t, '{pattern}') AS m, string_split_regex(t, '{pattern}') AS g FROM d"
    each = f"SELECT doc_id, own, repo, m, g, unnest(range(1, len(m) + 1)) AS i FROM ({cut}) WHERE len(m) > 0"
    found = f"SELECT doc_id, own, repo, {k} AS k, '{kind}' AS kind, ({before})::BIGINT AS s, m[i] AS whole, regexp_extract(m[i], '{pattern}', {group}) AS v FROM ({each})"
    return f"SELECT doc_id, own, repo, k, kind, s, s + length(whole) AS e, v FROM ({found}) WHERE length(v) >= {least}"


OP10 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '(none)') AS own, coalesce(source, '(none)') || '/' || coalesce(lang, '(none)') AS repo FROM documents),
base AS ({" UNION ALL ".join(_spans(k, *x) for k, x in enumerate(_KINDS[:3]))}),
tokens AS (SELECT * FROM ({_spans(3, *_KINDS[3])}) WHERE regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]') AND round(list_entropy(string_split(v, '')), 9) >= 3.5),
free AS (SELECT * FROM tokens x WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = x.doc_id AND b.s < x.e AND x.s < b.e)),
every AS (SELECT * FROM base UNION ALL SELECT * FROM free),
held AS (SELECT v, count(DISTINCT own)::BIGINT AS owners, count(DISTINCT repo)::BIGINT AS repos FROM every GROUP BY v),
kept AS (SELECT * FROM every JOIN held USING (v) WHERE kind <> 'owned' OR owners <= 1),
b AS (SELECT doc_id, count_if(k = 0)::BIGINT AS n_assign, count_if(k = 1)::BIGINT AS n_access, count_if(k = 2)::BIGINT AS n_hex, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) AS line FROM base GROUP BY doc_id),
a AS (SELECT doc_id, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k, e) AS spans, count_if(owners <= 1)::BIGINT AS n_live, count_if(owners > 1)::BIGINT AS n_widely_copied, max(repos)::BIGINT AS most_repositories FROM kept GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(line, '')) AS base_sha256, coalesce(spans, '') AS spans,
       coalesce(n_live, 0) AS n_live, coalesce(n_widely_copied, 0) AS n_widely_copied, coalesce(most_repositories, 0) AS most_repositories
FROM d LEFT JOIN b USING (doc_id) LEFT JOIN a USING (doc_id)
"""


_FINITE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"

OP11 = f"""
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND {_FINITE}),
s AS (
  SELECT a.vec_id AS anchor_id, o.vec_id AS other, a.label = o.label AS same, list_inner_product(a.v, o.v)::BIGINT AS score
  FROM e a JOIN e o ON a.vec_id <> o.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) AS n FROM s WHERE same) WHERE n <= 5),
w AS (
  SELECT p.anchor_id, p.other AS positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.other ORDER BY s.score DESC, s.other) AS rank, s.other AS negative_id, p.score AS positive_score, s.score AS negative_score
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM w WHERE rank <= 3
"""


def _kmeans_round(i: int) -> str:
    """Assignment a{i} of all vectors to centroids c{i}, and the centroids after it."""
    gap = "list_sum(list_transform(list_zip(e.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    return f"""
a{i} AS (SELECT vec_id, v, b.cluster AS cluster, b.d AS d FROM (SELECT e.vec_id, any_value(e.v) AS v, min({{'d': {gap}, 'cluster': c.cluster}}) AS b FROM e, c{i} c GROUP BY e.vec_id)),
m{i} AS (SELECT cluster, list(x ORDER BY i) AS v FROM (SELECT cluster, i, floor(sum(v[i])::DOUBLE / count(*))::BIGINT AS x FROM a{i}, range(1, 65) r(i) GROUP BY cluster, i) GROUP BY cluster),
c{i + 1} AS (SELECT c.cluster, coalesce(m.v, c.v) AS v FROM c{i} c LEFT JOIN m{i} m USING (cluster))"""


OP12 = f"""
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE {_FINITE} AND len(embedding) = 64),
c0 AS (SELECT row_number() OVER (ORDER BY h) - 1 AS cluster, v FROM (SELECT sha256('1:' || vec_id) AS h, v FROM e ORDER BY h LIMIT 16)),{",".join(_kmeans_round(i) for i in range(4))}
SELECT vec_id, cluster::INT AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(c3.v, ',')) AS centroid_sha256
FROM a3 JOIN c3 USING (cluster)
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_quality_rules": OP5, "op7_top_k": OP7, "op8_ngram_join": OP8, "op10_secrets": OP10, "op11_hard_negatives": OP11, "op12_exponion_clusters": OP12}
