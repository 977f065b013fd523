"""DuckDB SQL for the operators that SQL expresses, by brute force: all pairs, all windows, the exponent in closed form."""

from __future__ import annotations

from spanloom.llm import exact_dedup
from spanloom.llm.decontaminate import WORDS as WORDS_12
from spanloom.llm.fill_middle import PLAIN, SPM
from spanloom.llm.fill_middle import SEED as SEED_11
from spanloom.llm.mixing import BLOCK_ROWS, REPEATS, SEED
from spanloom.llm.spelling import EVERY, LEAST_CHARS, LEAST_COUNT, TIMES

_REACH = """reach(id, near) AS (
  SELECT id, id FROM nodes
  UNION
  SELECT r.id, l.b FROM reach r JOIN links l ON r.near = l.a
), roots AS (SELECT id, min(near) AS component_id FROM reach GROUP BY id)"""

EMBEDDING = f"""
WITH RECURSIVE usable AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM usable x JOIN usable y ON x.vec_id <> y.vec_id AND len(x.e) = len(y.e)
  WHERE list_cosine_similarity(x.e, y.e) >= 0.95
), nodes AS (SELECT DISTINCT a AS id FROM links), {_REACH}, counted AS (SELECT a AS id, count(*) AS n FROM links GROUP BY a)
SELECT v.vec_id, coalesce(c.n, 0) AS n_links, coalesce(r.component_id, v.vec_id) AS component_id, v.vec_id = coalesce(r.component_id, v.vec_id) AS kept
FROM embeddings v LEFT JOIN roots r ON r.id = v.vec_id LEFT JOIN counted c ON c.id = v.vec_id
"""

MINHASH = rf"""
WITH RECURSIVE listed AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM listed
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (
  SELECT s.a, s.b FROM shared s JOIN sizes x ON x.doc_id = s.a JOIN sizes y ON y.doc_id = s.b
  WHERE 100 * s.n >= 85 * (x.n + y.n - s.n)
), nodes AS (SELECT DISTINCT a AS id FROM links), {_REACH}
SELECT d.doc_id, coalesce(z.n, 0) AS n_shingles, coalesce(r.component_id, d.doc_id) AS component_id, d.doc_id = coalesce(r.component_id, d.doc_id) AS kept
FROM documents d LEFT JOIN sizes z ON z.doc_id = d.doc_id LEFT JOIN roots r ON r.id = d.doc_id
"""

SUFFIX = """
WITH bytes AS (SELECT doc_id, encode(coalesce(text, '')) AS t FROM documents),
starts AS (SELECT doc_id, unnest(range(1, octet_length(t) - 398)) AS p FROM bytes WHERE octet_length(t) >= 400),
windows AS (SELECT s.doc_id, s.p, md5(b.t[s.p:s.p + 399]) AS w FROM starts s JOIN bytes b ON b.doc_id = s.doc_id),
several AS (SELECT w FROM windows GROUP BY w HAVING count(*) > 1),
hit AS (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS q FROM windows SEMI JOIN several USING (w)),
runs AS (SELECT doc_id, p, sum(CASE WHEN q IS NULL OR p > q + 400 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM hit),
spans AS (SELECT doc_id, run, min(p) AS s, max(p) + 400 AS e FROM runs GROUP BY doc_id, run),
cuts AS (
  SELECT doc_id, coalesce(lag(e) OVER w, 1) AS f, s AS u FROM spans WINDOW w AS (PARTITION BY doc_id ORDER BY s)
  UNION ALL SELECT b.doc_id, coalesce(max(e), 1), octet_length(any_value(b.t)) + 1 FROM bytes b LEFT JOIN spans x ON x.doc_id = b.doc_id GROUP BY b.doc_id
),
kept AS (SELECT c.doc_id, string_agg(CASE WHEN c.u > c.f THEN hex(b.t[c.f:c.u - 1]) ELSE '' END, '' ORDER BY c.f) AS k FROM cuts c JOIN bytes b ON b.doc_id = c.doc_id GROUP BY c.doc_id),
totals AS (SELECT doc_id, sum(e - s) AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id)
SELECT b.doc_id, octet_length(b.t) AS n_bytes, CAST(coalesce(t.n_removed, 0) AS BIGINT) AS n_removed, coalesce(t.n_spans, 0) AS n_spans, sha256(from_hex(k.k)) AS kept_sha256
FROM bytes b JOIN kept k ON k.doc_id = b.doc_id LEFT JOIN totals t ON t.doc_id = b.doc_id
"""

MIXING = rf"""
WITH counted AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n_tokens, md5(CAST(doc_id AS VARCHAR) || ':{SEED}') AS k FROM documents
), totals AS (SELECT source, sum(n_tokens) AS tokens, count(*) AS docs FROM counted GROUP BY source),
ends AS (SELECT CAST(max(tokens) AS DOUBLE) AS most, CAST(min(tokens) AS DOUBLE) AS least, CAST(sum(tokens) AS DOUBLE) AS everything FROM totals WHERE tokens > 0),
powers AS (SELECT most, everything, CASE WHEN most > least THEN greatest(0.0, 1 - ln({REPEATS}) / ln(most / least)) ELSE 0.0 END AS t FROM ends),
weighed AS (
  SELECT source, tokens, greatest(1, CAST(ceil(docs / {BLOCK_ROWS}.0) AS BIGINT)) AS blocks,
    CASE WHEN tokens > 0 THEN pow(tokens / everything, t) ELSE 0.0 END AS part, CASE WHEN tokens > 0 THEN pow(tokens / most, t - 1) ELSE 1.0 END AS passes
  FROM totals, powers
), budgets AS (
  SELECT *, part / sum(part) OVER () AS weight, CAST(floor(passes + 1e-9) AS INTEGER) AS whole, floor((passes - floor(passes + 1e-9)) * tokens + 1e-6) AS budget FROM weighed
), placed AS (
  SELECT c.*, b.weight, b.passes, b.whole, b.budget, CAST('0x' || substr(k, 1, 8) AS BIGINT) % b.blocks AS block
  FROM counted c JOIN budgets b ON c.source IS NOT DISTINCT FROM b.source
), running AS (
  SELECT *, sum(n_tokens) OVER (PARTITION BY source ORDER BY block, k, doc_id RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM placed
)
SELECT doc_id, source, n_tokens, round(weight, 6) AS weight, round(passes, 6) AS passes, CAST(whole + CASE WHEN upto <= budget THEN 1 ELSE 0 END AS INTEGER) AS copies FROM running
"""

FILL = rf"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('{SEED_11}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), drawn AS (
  SELECT doc_id, text, u, len(u) AS n, list_transform([1, 9, 17, 25], lambda k: CAST('0x' || substr(h, k, 8) AS BIGINT)) AS d FROM t
), placed AS (
  SELECT doc_id, text, u, n, least(d[1] % (n + 1), d[2] % (n + 1)) AS a, greatest(d[1] % (n + 1), d[2] % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR d[3] % 100 >= 100 - {PLAIN} THEN 'plain' WHEN d[4] % 100 < {SPM} THEN 'spm' ELSE 'psm' END AS form FROM drawn
), cut AS (
  SELECT doc_id, text, n, form, coalesce(array_to_string(list_slice(u, 1, a), ''), '') AS p, coalesce(array_to_string(list_slice(u, a + 1, b), ''), '') AS m, coalesce(array_to_string(list_slice(u, b + 1, n), ''), '') AS s FROM placed
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(p || m || s) AS restored_sha256
FROM cut
"""

_WORDS_12 = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
LEAKS = f"""
WITH items AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_WORDS_12} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item, least(len(w), {WORDS_12}) AS size, array_to_string(w[i:i + {WORDS_12} - 1], ' ') AS g
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - {WORDS_12}, 0) + 2)) AS i FROM items WHERE len(w) > 0)
), docs AS (SELECT doc_id, {_WORDS_12} AS w FROM documents),
grams AS (
  SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS g
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM docs, (SELECT DISTINCT size FROM windows) WHERE len(w) >= size)
), hits AS (SELECT x.doc_id, x.i, x.size, y.item FROM grams x JOIN windows y ON y.g = x.g AND y.size = x.size),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hits) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(n.n_items, 0) AS n_items, sha256(coalesce(n.listed, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN covered c ON c.doc_id = d.doc_id LEFT JOIN named n ON n.doc_id = d.doc_id
"""

SPELLING = f"""
WITH RECURSIVE bits(i, c, k) AS (
  SELECT i, i, 0 FROM range(256) r(i) UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8
), crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' AS k, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents
), once AS (SELECT k, run, count(*) AS n FROM runs WHERE length(run) >= {LEAST_CHARS} GROUP BY ALL),
listed AS (SELECT run, n, flatten(list_transform(string_split(k || run, ''), lambda c: CASE WHEN ord(c) < 128 THEN [ord(c)] ELSE [195, ord(c) - 64] END)) AS b FROM once),
summed AS (SELECT run, n, xor(list_reduce(b, lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1]), 4294967295), 4294967295) AS h FROM listed, crc),
changed AS (SELECT CASE WHEN h % {EVERY} = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM summed),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM changed WHERE length(word) >= {LEAST_CHARS} GROUP BY word HAVING sum(n) >= {LEAST_COUNT}),
gaps AS (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS g FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
one AS (
  SELECT x.word, x.n, y.word AS near, y.n AS near_n FROM gaps x JOIN gaps y ON x.g = y.g AND x.i = y.i AND x.word <> y.word
  UNION SELECT x.word, x.n, y.word, y.n FROM gaps x JOIN words y ON x.g = y.word
  UNION SELECT y.word, y.n, x.word, x.n FROM gaps x JOIN words y ON x.g = y.word
), best AS (SELECT word, count(*) AS n_near, arg_min(near, (-near_n, near)) AS near, max(near_n) AS near_n FROM one GROUP BY word),
formed AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.near_n >= {TIMES} * w.n THEN b.near END AS form, CASE WHEN b.near_n >= {TIMES} * w.n THEN b.near_n END AS form_n
  FROM words w LEFT JOIN best b ON b.word = w.word
), follow(word, here, step) AS (
  SELECT word, word, 0 FROM formed UNION ALL SELECT f.word, x.form, f.step + 1 FROM follow f JOIN formed x ON x.word = f.here WHERE x.form IS NOT NULL
), ends AS (SELECT word, arg_max(here, step) AS root FROM follow GROUP BY word)
SELECT f.word, f.form, e.root, f.n, f.n_near, f.form_n FROM formed f JOIN ends e ON e.word = f.word
"""

SQL = exact_dedup.SQL | {
    "op1_embedding_near_dedup": EMBEDDING,
    "op6_minhash_near_dedup": MINHASH,
    "op7_suffix_dedup": SUFFIX,
    "op9_mixing": MIXING,
    "op11_fill_in_middle": FILL,
    "op12_decontamination": LEAKS,
    "op13_spelling_variants": SPELLING,
}
