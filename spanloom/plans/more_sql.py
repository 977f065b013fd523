"""DuckDB SQL that gives the rows of the queries in ``more``."""

from __future__ import annotations

from spanloom.plans.queries import _IV, _LINES, _RECTS, SHAPES

_CH = f"""SELECT doc_id, i, k, substr(t, k::INT, 1) AS ch, s + k - 1 AS pos, n, blocks FROM (SELECT doc_id, i, t, length(t) AS n, blocks, coalesce(sum(length(t)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS s
 FROM (SELECT doc_id, unnest(b) AS t, unnest(range(len(b))) AS i, len(b) AS blocks FROM ({_LINES}))), range(1, n + 1) r(k)"""
# A line break follows every block of a chosen page but the last chosen block of the text.
_TARGET = f"""SELECT doc_id, i, 1 AS part, pos, ch, pos + 1 AS e FROM ({_CH}) WHERE i // 8 IN (0, 2)
 UNION ALL SELECT doc_id, i, 2, s + n, chr(10), s + n FROM (SELECT doc_id, i, length(t) AS n, blocks, coalesce(sum(length(t)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS s
 FROM (SELECT doc_id, unnest(b) AS t, unnest(range(len(b))) AS i, len(b) AS blocks FROM ({_LINES}))) WHERE i // 8 IN (0, 2) AND NOT (i % 8 = 7 OR i = blocks - 1) OR (i // 8 = 0 AND (i % 8 = 7) AND blocks > 16)"""
_CARDS = """SELECT o_orderkey AS doc_id, (o_orderkey % 900 + 1100)::VARCHAR || '年' AS y, '03-' || lpad((o_custkey % 10000)::VARCHAR, 4, '1') || '-' || lpad((o_orderkey % 10000)::VARCHAR, 4, '2') AS p,
 lpad((o_orderkey * 7919 + o_custkey * 104729)::VARCHAR, 12, '1') AS m FROM orders"""
# The text is 山田様、 + year + ' 電話 ' + phone + ' 番号 ' + number + ' 終': all places follow from the lengths.
_BUILT = f"""SELECT doc_id, 'PERSON' AS entity, '山田様' AS word, 0::BIGINT AS start, 3::BIGINT AS "end" FROM ({_CARDS})
 UNION ALL SELECT doc_id, 'YEAR', y, 4, 9 FROM ({_CARDS}) UNION ALL SELECT doc_id, 'PHONE_NUMBER', p, 13, 25 FROM ({_CARDS}) UNION ALL SELECT doc_id, 'INDIVIDUAL_NUMBER', m, 29, 41 FROM ({_CARDS})"""
_DIGIT = "(SELECT sum(try_cast(substr(reverse(substr(word, 1, 11)), k + 1, 1) AS INT) * (CASE WHEN k < 6 THEN k + 2 ELSE k - 4 END)) % 11 FROM range(11) r(k))"
_PLACES = f"SELECT *, doc_id % 4 AS page_num, seq % 3 AS block_num, gstart AS \"offset\", 'w' || gend AS word FROM ({_IV})"
_NAME = "CASE entity WHEN 'PERSON' THEN '人名' WHEN 'LOCATION' THEN '場所' ELSE '固有名詞' END"
_FOUND = f"SELECT * REPLACE (idx % 50 AS doc_id), CASE idx % 3 WHEN 0 THEN 'PERSON' WHEN 1 THEN 'YEAR' ELSE 'ODD' END AS entity, x1 - x0 - 5 AS rad FROM ({_RECTS})"
_HAND = f"""SELECT doc_id, idx, entity, page_num, 'circle' AS shape, x0 - rad AS a, y0 - rad AS b, x0 + rad AS c, y0 + rad AS d, rad AS radius FROM ({_FOUND}) WHERE idx % 7 = 0 AND rad > 0
 UNION ALL SELECT doc_id, idx, entity, page_num, 'rect', x0, y0, x1, y1, NULL FROM ({_FOUND}) WHERE idx % 5 = 0 AND x1 > x0 AND NOT (idx % 35 = 0 AND rad > 0)"""
_CHARS = """SELECT doc_id, page_num, k - 1 AS "offset", substr(t, k::INT, 1) AS ch, ((k - 1) % 40 * 6)::DOUBLE AS x0, ((k - 1) // 40 * 12)::DOUBLE AS y0, ((k - 1) % 40 * 6 + 6)::DOUBLE AS x1, ((k - 1) // 40 * 12 + 10)::DOUBLE AS y1, (k - 1) // 40 AS line_num
 FROM (SELECT conv_id AS doc_id, turn AS page_num, coalesce(text, '') AS t FROM conversations), range(1, length(t) + 1) r(k)"""
_OCR = "SELECT p_partkey AS k, p_partkey % 100 AS x, p_partkey % 70 AS y, p_partkey % 9 AS w, p_partkey % 7 + 1 AS h, p_partkey % 6 AS m FROM part"
_FILES = "SELECT o_orderkey::VARCHAR AS path, o_orderkey % 11 = 0 AS skipped, o_orderkey % 13 = 0 AS bad FROM orders"
_TYPES = "SELECT l_orderkey::VARCHAR AS path, CASE l_returnflag WHEN 'A' THEN 'PERSON' WHEN 'R' THEN 'LOCATION' ELSE 'PROPER_NOUN' END AS entity, count(*) AS n FROM lineitem GROUP BY ALL"
_OLD = f"""SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY m, gstart, gend) AS seq, entity, CASE origin WHEN 'manual' THEN 'addition' ELSE 'auto' END AS origin, gstart AS s, gend AS e
 FROM (SELECT doc_id, gstart, gend, min(seq) AS m, min(entity) AS entity, min(origin) AS origin FROM ({_IV}) GROUP BY ALL)"""
_OLD_COMP = f"""SELECT *, min(seq) OVER (PARTITION BY doc_id, island) AS comp FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY s, e, seq ROWS UNBOUNDED PRECEDING) AS island FROM
 (SELECT *, coalesce((s > max(e) OVER (PARTITION BY doc_id ORDER BY s, e, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))::INT, 1) AS new FROM ({_OLD})))"""
_RANK = "CASE entity WHEN 'LOCATION' THEN 1 WHEN 'PERSON' THEN 2 ELSE 3 END"
_OLD_BEST = lambda order: f"SELECT doc_id, seq, entity FROM ({_OLD_COMP}) QUALIFY row_number() OVER (PARTITION BY doc_id, comp ORDER BY {order}) = 1"
_POINTS = "SELECT s_suppkey AS pid, s_suppkey % 3 AS pd, s_suppkey % 4 AS pg, (s_suppkey * 61 % 500)::DOUBLE AS x, (s_suppkey * 97 % 700)::DOUBLE AS y FROM supplier"
_QUADS = f"SELECT idx % 5 AS doc_id, idx AS seq, page_num, x0, y0, x1 + 20 AS x1, y1 + 20 AS y1 FROM ({_RECTS})"

SQL = {
    "target_text": f"""SELECT b.doc_id, count(t.ch) AS n, sha256(coalesce(string_agg(t.ch, '' ORDER BY t.i, t.part, t.pos), '')) AS sha256, coalesce(sum(t.pos), 0)::BIGINT AS sum_start, coalesce(sum(t.e), 0)::BIGINT AS sum_end
 FROM ({_LINES}) b LEFT JOIN ({_TARGET}) t ON t.doc_id = b.doc_id GROUP BY b.doc_id""",
    "target_positions": f"""WITH c AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS t, count(*) OVER (PARTITION BY doc_id) AS n FROM ({_CH}) WHERE NOT regexp_matches(ch, '^[\\s\\x0B\\x{{85}}\\p{{Z}}]$'))
 SELECT b.doc_id, coalesce(min(pos) FILTER (t = n // 4), len(array_to_string(b.b, '')))::BIGINT AS start, coalesce(max(pos) FILTER (t = n * 3 // 4 - 1) + 1, min(pos) FILTER (t = n // 4), len(array_to_string(b.b, '')))::BIGINT AS "end"
 FROM ({_LINES}) b LEFT JOIN c ON c.doc_id = b.doc_id GROUP BY b.doc_id, b.b""",
    "chunked_detect": "SELECT doc_id, entity, word, count(*) AS n, true AS in_place FROM (" + " UNION ALL ".join(f"SELECT doc_id, '{e}' AS entity, unnest(regexp_extract_all(substr(text, (k * 700 + 1)::INT, 700), '{p}')) AS word FROM documents, range(0, (length(text) + 699) // 700) r(k)" for e, p in SHAPES.items()) + ") GROUP BY ALL",
    "group_spans": "SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), 'token = \"([0-9a-f]+)\"', 1)) AS word FROM documents) GROUP BY ALL",
    "built_in": _BUILT,
    "built_in_valid": f"""SELECT doc_id, entity, word, start, "end" FROM (SELECT *, CASE WHEN entity = 'INDIVIDUAL_NUMBER' THEN {_DIGIT} END AS r FROM ({_BUILT}))
 WHERE entity <> 'INDIVIDUAL_NUMBER' OR ((CASE WHEN r <= 1 THEN 0 ELSE 11 - r END) = try_cast(substr(word, 12, 1) AS INT) AND length(replace(word, substr(word, 1, 1), '')) > 0)""",
    "omitted": f"""WITH a AS (SELECT * FROM (SELECT doc_id, entity, word, 'auto' AS origin, start, "end" FROM ({_BUILT}) WHERE entity NOT IN ('PERSON', 'PHONE_NUMBER')
 UNION ALL SELECT doc_id, 'PERSON', '山田様', 'custom', 0, 3 FROM ({_CARDS}) UNION ALL SELECT doc_id, 'OTHER', '03', 'custom', 13, 15 FROM ({_CARDS})))
 SELECT a.* FROM a JOIN ({_CARDS}) c USING (doc_id) WHERE NOT regexp_matches(a.word, '7$') AND NOT regexp_matches(a.word, '11[0-9][0-9]年')
 AND NOT (entity = 'INDIVIDUAL_NUMBER' AND false)""",
    "literal_search": f"SELECT doc_id, page_num, count(*) AS n, sum(p)::BIGINT AS starts FROM (SELECT doc_id, i // 8 AS page_num, k - 1 AS p FROM (SELECT doc_id, unnest(b) AS t, unnest(range(len(b))) AS i FROM ({_LINES})), range(1, length(t) + 1) r(k) WHERE substr(t, k::INT, 2) = 'an') GROUP BY ALL",
    "filtered": f"SELECT doc_id, seq, word FROM ({_PLACES}) WHERE entity <> 'PROPER_NOUN' AND regexp_matches(word, '[13579]$') AND page_num IN (0, 1) AND origin = 'auto'",
    "sort_order": f"""SELECT doc_id, gstart, row_number() OVER (PARTITION BY doc_id ORDER BY gstart % 4, seq % 3, gstart, seq) AS by_page, row_number() OVER (PARTITION BY doc_id ORDER BY 'w' || gend || '-' || gstart, seq) AS by_text
 FROM (SELECT doc_id, gstart, min(seq) AS seq, min(gend) AS gend FROM ({_IV}) GROUP BY ALL)""",
    "csv_report": f"SELECT (page_num + 1)::VARCHAR AS page, {_NAME} AS type, word, 'p' || (page_num + 1) || ':b' || (block_num + 1) || ':' || (\"offset\" + 1) AS place, CASE origin WHEN 'manual' THEN '✓' ELSE '' END AS mark, count(*) AS n FROM ({_PLACES}) GROUP BY ALL",
    "panel": f"WITH r AS (SELECT doc_id, entity, gstart % 3 AS s, gstart + 1 AS e, CASE origin WHEN 'manual' THEN 'custom' ELSE 'auto' END AS origin FROM ({_IV})) SELECT doc_id, origin, count(*) AS n FROM r WHERE origin = 'auto' OR NOT EXISTS (SELECT 1 FROM r q WHERE q.doc_id = r.doc_id AND q.entity = r.entity AND q.s = r.s AND q.e = r.e AND q.origin = 'auto') GROUP BY ALL",
    "merged_first": f"SELECT doc_id, origin, count(*) AS n FROM (SELECT doc_id, entity, gstart, CASE WHEN bool_or(origin = 'manual') THEN 'manual' ELSE 'auto' END AS origin FROM ({_IV}) GROUP BY ALL) GROUP BY ALL",
    "mask_plan": f"""WITH h AS ({_HAND}), t AS (SELECT doc_id, idx, entity, page_num, 'rect' AS shape, x0 AS a, y0 AS b, x1 AS c, y1 AS d, NULL::DOUBLE AS radius FROM ({_FOUND}) f WHERE idx % 5 <> 0 AND idx % 7 <> 0 AND x1 > x0 AND y1 > y0
 AND NOT EXISTS (SELECT 1 FROM h WHERE h.doc_id = f.doc_id AND h.page_num = f.page_num AND least(x1, h.c) > greatest(x0, h.a) AND least(y1, h.d) > greatest(y0, h.b))),
 u AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_num, shape, entity, round(a, 3), round(b, 3), round(c, 3), round(d, 3), round(radius, 3) ORDER BY idx) AS rn FROM (SELECT * FROM h UNION ALL SELECT * FROM t))
 SELECT doc_id, page_num, entity, shape, a AS x0, b AS y0, c AS x1, d AS y1, coalesce(radius, 0.0) AS radius, CASE entity WHEN 'PERSON' THEN 1.0 WHEN 'YEAR' THEN 0.0 ELSE 0.78 END::DOUBLE AS r, CASE entity WHEN 'PERSON' THEN 0.0 WHEN 'YEAR' THEN 0.0 ELSE 0.78 END::DOUBLE AS g,
 CASE entity WHEN 'PERSON' THEN 0.0 WHEN 'YEAR' THEN 1.0 ELSE 0.78 END::DOUBLE AS b, CASE entity WHEN 'PERSON' THEN 0.25 WHEN 'YEAR' THEN 0.5 ELSE 0.35 END::DOUBLE AS alpha FROM u WHERE rn = 1""",
    "map_rects": f"""SELECT doc_id, page_num, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM ({_CHARS}) JOIN (SELECT conv_id AS c, min(turn) AS p FROM conversations GROUP BY 1) ON c = doc_id
 WHERE (page_num = p AND "offset" >= 30) OR (page_num = p + 1 AND "offset" <= 45) GROUP BY doc_id, page_num, line_num""",
    "span_rects": f"SELECT doc_id, page_num, count(*) AS n_quads, sum(2 * (x0 + x1) + 2 * (y0 + y1)) AS total FROM (SELECT doc_id, page_num, line_num, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM ({_CHARS}) WHERE \"offset\" BETWEEN 10 AND 59 GROUP BY ALL) GROUP BY ALL",
    "char_details": "SELECT conv_id AS doc_id, 100::BIGINT AS n, 100 - greatest(0, least(120, coalesce(max(length(text)) FILTER (turn = 0), 0)) - 20)::BIGINT AS n_missing FROM conversations GROUP BY conv_id",
    "map_tables": f"""SELECT doc_id, (SELECT count(DISTINCT page_num) FROM ({_CHARS}) c WHERE c.doc_id = k.doc_id) AS pages, (SELECT count(DISTINCT page_num) FROM ({_CHARS}) c WHERE c.doc_id = k.doc_id) AS blocks, (SELECT count(*) FROM ({_CHARS}) c WHERE c.doc_id = k.doc_id) AS mappings,
 count(*) AS places, sum("offset")::BIGINT AS offsets FROM (SELECT DISTINCT doc_id, "offset" FROM ({_CHARS})) k GROUP BY doc_id""",
    "near_spans": f"""SELECT pid, idx FROM ({_POINTS}) JOIN ({_RECTS}) ON pd = doc_id AND pg = page_num WHERE x BETWEEN x0 - 5 AND x1 + 5 AND y BETWEEN y0 - 5 AND y1 + 5
 UNION ALL SELECT pid, -min(idx) FROM ({_POINTS}) JOIN ({_RECTS}) ON pd = doc_id AND pg = page_num WHERE x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 GROUP BY pid
 UNION ALL SELECT pid + 1000000, idx FROM ({_POINTS}) JOIN ({_RECTS}) ON pd = doc_id AND pg = page_num WHERE pow(greatest(x0 - x, 0, x - x1), 2) + pow(greatest(y0 - y, 0, y - y1), 2) <= 400""",
    "highlight_spans": f"""WITH w AS (SELECT doc_id, text, unnest(regexp_extract_all(coalesce(text, ''), '{SHAPES['EMAIL']}')) AS word FROM documents), n AS (SELECT doc_id, any_value(text) AS text, word, count(*) AS n FROM w GROUP BY doc_id, word),
 p AS (SELECT doc_id, word, r.k, list_slice(string_split(text, word), 1, r.k) AS g FROM n, range(1, n + 1) r(k))
 SELECT doc_id, word, 'auto' AS origin, (length(array_to_string(g, '')) + (k - 1) * length(word))::BIGINT AS start, (length(array_to_string(g, '')) + k * length(word))::BIGINT AS "end" FROM p""",
    "new_annotations": f"""WITH r AS (SELECT idx, idx % 4 = 0 AS sq FROM ({_RECTS})), f AS (SELECT * REPLACE (idx % 50 AS doc_id), (idx % 9)::VARCHAR AS word, x0 + CASE WHEN idx % 6 = 0 THEN 0.05 ELSE 0.5 END AS p0 FROM ({_RECTS}) WHERE idx % 4 <> 0),
 a AS (SELECT count(*) AS n FROM f WHERE NOT EXISTS (SELECT 1 FROM f e WHERE e.doc_id = f.doc_id AND e.page_num = f.page_num AND e.word = f.word AND abs(f.p0 - e.x0) <= 0.1 AND abs(f.y0 - e.y0) <= 0.1 AND abs(f.x1 - e.x1) <= 0.1 AND abs(f.y1 - e.y1) <= 0.1))
 SELECT 'Square' AS annotation_type, count_if(sq)::BIGINT AS n, m AS mode FROM r, (VALUES ('append'), ('reset_and_append')) v(m) GROUP BY m
 UNION ALL SELECT 'Highlight', (SELECT count(*) FROM f) + n, 'append' FROM a UNION ALL SELECT 'Highlight', (SELECT count(*) FROM f), 'reset_and_append'""",
    "ocr_items": f"""SELECT k AS doc_id, CASE m WHEN 0 THEN 'a' WHEN 1 THEN 'b' WHEN 2 THEN 'c' WHEN 3 THEN 'd' ELSE 'e' END AS text, x * 0.5::DOUBLE + 1 AS x, y * 0.5::DOUBLE + 2 AS y, w * 0.5::DOUBLE AS width, h * 0.5::DOUBLE AS height,
 CASE m WHEN 0 THEN 0.5 WHEN 1 THEN 0.25 WHEN 4 THEN 1.0 ELSE 0.0 END::DOUBLE AS confidence FROM ({_OCR}) WHERE w > 0 AND m < 5""",
    "ocr_plan": f"""SELECT idx AS item_num, x0, y0, least(x1, 300) AS x1, least(y1, 400) AS y1, CASE WHEN idx % 2 = 0 THEN 0.2 ELSE 0.0 END::DOUBLE AS blue, CASE WHEN idx % 2 = 0 THEN 1.0 ELSE 0.5 END::DOUBLE AS opacity,
 round(least(72.0, greatest(1.0, least((least(y1, 400) - y0) * 0.98, (least(x1, 300) - x0) * 0.98 / 1.5))), 4) AS font_size FROM ({_RECTS}) WHERE idx % 5 <> 0 AND least(x1, 300) > x0 AND least(y1, 400) > y0""",
    "ocr_offsets": f"""SELECT round(avg(dx), 6) AS mean_dx, round(stddev_samp(dx), 6) AS sd_dx, round(min(dx), 6) AS min_dx, round(max(dx), 6) AS max_dx, round(avg(dy), 6) AS mean_dy, round(stddev_samp(dy), 6) AS sd_dy, round(min(dy), 6) AS min_dy, round(max(dy), 6) AS max_dy
 FROM (SELECT (idx % 4)::DOUBLE AS dx, 0 - (idx % 3)::DOUBLE AS dy FROM ({_RECTS}))""",
    "file_report": f"""SELECT f.path AS file, CASE WHEN bad OR skipped THEN 0 ELSE coalesce(sum(n), 0) END::BIGINT AS n, CASE WHEN bad THEN 'Error' WHEN skipped THEN 'Skipped' ELSE 'Success' END AS status,
 CASE WHEN bad OR skipped THEN '' ELSE coalesce(string_agg(entity || ':' || n, ', ' ORDER BY entity), '') END AS types FROM ({_FILES}) f LEFT JOIN ({_TYPES}) t ON t.path = f.path GROUP BY f.path, bad, skipped""",
    "run_totals": f"""WITH g AS (SELECT path FROM ({_FILES}) WHERE NOT bad AND NOT skipped), t AS (SELECT * FROM ({_TYPES}) SEMI JOIN g USING (path))
 SELECT entity, sum(n)::BIGINT AS n, count(*) AS files FROM t GROUP BY entity UNION ALL SELECT NULL, coalesce((SELECT sum(n) FROM t), 0)::BIGINT, count(*) FROM g""",
    "text_statistics": f"""WITH b AS (SELECT doc_id, count(DISTINCT i // 8) AS pages, count(*) AS blocks, sum(length(t))::BIGINT AS chars FROM (SELECT doc_id, unnest(b) AS t, unnest(range(len(b))) AS i FROM ({_LINES})) GROUP BY doc_id),
 c AS (SELECT doc_id, count(*) AS grids, sum(n)::BIGINT AS grid_entries FROM (SELECT doc_id, page_num, gx, gy, count(*) AS n FROM ({_RECTS}), range(0, 60) a(gx), range(0, 60) e(gy) WHERE gx BETWEEN floor(x0 / 50) AND floor(x1 / 50) AND gy BETWEEN floor(y0 / 50) AND floor(y1 / 50) GROUP BY ALL) GROUP BY doc_id)
 SELECT b.*, coalesce(grids, 0) AS grids, coalesce(grid_entries, 0) AS grid_entries FROM b LEFT JOIN c USING (doc_id)""",
    "integrity": "SELECT conv_id AS doc_id, length(coalesce(text, ''))::BIGINT AS chars, length(coalesce(text, ''))::BIGINT AS length, true AS consistent, true AS valid FROM conversations WHERE turn = 0",
    "summaries": f"SELECT doc_id, i // 8 AS page_num, i % 8 AS block_num, CASE WHEN length(t) > 100 THEN substr(t, 1, 100) || '...' ELSE t END AS preview, length(t)::BIGINT AS n_chars FROM (SELECT doc_id, unnest(b) AS t, unnest(range(len(b))) AS i FROM ({_LINES}))",
    "legacy_widest": _OLD_BEST("greatest(0, e - s) DESC, seq"),
    "legacy_first": _OLD_BEST("seq"),
    "legacy_last": _OLD_BEST("seq DESC"),
    "legacy_entity_order": _OLD_BEST(f"{_RANK}, seq"),
    "legacy_tie_break": _OLD_BEST(f"CASE origin WHEN 'auto' THEN 1 ELSE 3 END, greatest(0, e - s), {_RANK}, seq"),
    "legacy_quads": f"""WITH RECURSIVE l AS (SELECT a.doc_id, a.seq AS i, b.seq AS j FROM ({_QUADS}) a JOIN ({_QUADS}) b ON a.doc_id = b.doc_id AND a.page_num = b.page_num AND a.seq <> b.seq AND least(a.x1, b.x1) > greatest(a.x0, b.x0) AND least(a.y1, b.y1) > greatest(a.y0, b.y0)),
 reach(doc_id, seq, near) AS (SELECT doc_id, seq, seq FROM ({_QUADS}) UNION SELECT r.doc_id, r.seq, l.j FROM reach r JOIN l ON l.doc_id = r.doc_id AND l.i = r.near)
 SELECT doc_id, seq FROM ({_QUADS}) JOIN (SELECT doc_id, seq, min(near) AS comp FROM reach GROUP BY ALL) USING (doc_id, seq) QUALIFY row_number() OVER (PARTITION BY doc_id, comp ORDER BY (x1 - x0) * (y1 - y0) DESC, seq) = 1""",
    "sessions": """SELECT CASE WHEN side THEN 's' WHEN emb THEN 'e' END AS state, CASE WHEN side THEN 'sidecar' WHEN emb THEN 'embedded' END AS source, (side AND k % 14 <> k % 7) AS mismatch, count(*) AS n
 FROM (SELECT c_custkey AS k, c_nationkey < 10 AS side, c_acctbal > 0 AS emb FROM customer) GROUP BY ALL""",
    "marks": f"""SELECT entity, {_NAME} AS name, CASE entity WHEN 'PERSON' THEN 1 WHEN 'LOCATION' THEN 2 ELSE 7 END::BIGINT AS rank, origin, CASE origin WHEN 'manual' THEN '手動' ELSE '自動' END AS label, CASE entity WHEN 'PERSON' THEN 0.78 WHEN 'LOCATION' THEN 1.0 ELSE 0.86 END::DOUBLE AS mark_g,
 0.0::DOUBLE AS note_b, 0.8::DOUBLE AS high_b, 'entity_type:' || entity || ': w' AS note, count(*) AS n FROM ({_IV}) GROUP BY entity, origin""",
    "coercions": """SELECT c_custkey, least(100.0, greatest(0.0, CASE WHEN k % 3 = 0 THEN 7.0 ELSE k - 50 END))::DOUBLE AS v, k % 5 IN (0, 2, 3) AS "on", '/in/f' || k || CASE k % 4 WHEN 0 THEN '_masked_masked.pdf' WHEN 1 THEN '_backup.x_masked.pdf' ELSE '_masked.pdf' END AS path,
 k % 4 < 2 AS skipped, CASE WHEN k % 2 = 0 THEN k % 3 = 0 ELSE true END AS same FROM (SELECT c_custkey, c_custkey AS k FROM customer)""",
    "shapes": f"""SELECT idx, (x1 - x0) * (y1 - y0) AS area, CASE WHEN least(x1, 300) > greatest(x0, 100) AND least(y1, 400) > greatest(y0, 100) THEN (least(x1, 300) - greatest(x0, 100)) * (least(y1, 400) - greatest(y0, 100)) ELSE -1.0 END AS cut,
 pow(greatest(x0 - 250, 0, 250 - x1), 2) + pow(greatest(y0 - 350, 0, 350 - y1), 2) <= 6400 AS near, true AS bounds, 800 - y0 AS flipped, round(x0 * 0.24 + 2, 6) AS points, '#' || lpad(lower(printf('%x', floor(x0 / 500 * 255)::BIGINT)), 2, '0') || '7fff' AS colour,
 round(least(72.0, greatest(1.0, least((y1 - y0) * 0.98, (x1 - x0) * 0.49))), 6) AS size, abs(xor(xor(round(x0 * 1000)::BIGINT, round(y0 * 1000)::BIGINT), xor(round(x1 * 1000)::BIGINT, round(y1 * 1000)::BIGINT))) AS "offset" FROM ({_RECTS})""",
}
