"""Registered queries of the smaller operators, with the SQL that gives the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions import values as V
from spanloom.operators import detect, highlights, layout, maps, offsets, resolve
from spanloom.plans import more
from spanloom.plans import queries as base
from spanloom.shipping import apart, dealt, ensure_checkpoint_dir, written
from spanloom.sources import files, store

_table = base._table


def content_hashes(spark: SparkSession, d: str) -> DataFrame:
    """Digest of each document's pages, with and without the numbers of images."""
    docs = base._docs(spark, d)
    images = F.transform("text", lambda p, i: F.size(p) + i)
    return docs.select("doc_id", offsets.content_hash(F.col("text")).alias("plain"), offsets.content_hash(F.col("text"), None, images).alias("with_images"))


def entity_rules(spark: SparkSession, d: str) -> DataFrame:
    """Rules over detections of line items: entities that are enabled, ids, first entities of words, and span keys of broken numbers."""
    found = more._places(spark, d).withColumn("entity", F.when(F.col("seq") % 3 == 0, "MUHO").otherwise(F.col("entity")))
    rows = found.withColumn("seen", V.resolved_entity(F.col("entity"), ["PERSON"])).withColumn("id", V.detection_id(F.col("entity"), F.col("word"), F.col("gstart"), F.col("gend")))
    place = lambda o: F.struct(F.col("page_num").cast("string").alias("page_num"), F.when(F.col("seq") % 2 == 0, "x").otherwise(F.col("block_num").cast("string")).alias("block_num"), o.alias("offset"))
    key = resolve.span_key(F.col("entity"), place(F.col("gstart")), place(F.col("gend")))
    return rows.groupBy("doc_id", "seq", "gstart", "gend", F.coalesce("seen", F.lit("-")).alias("seen"), "id", key.k1.cast("long").alias("block"), key.k3.cast("long").alias("page")).agg(F.count("*").alias("n"))


def first_entities(spark: SparkSession, d: str) -> DataFrame:
    """The first entity of each word of a document, other where it is empty."""
    found = more._places(spark, d).select("doc_id", (F.col("seq") * 10**6 + F.col("gstart") * 1000 + F.col("gend")).alias("seq"), F.when(F.col("origin") == "manual", "").otherwise(F.col("entity")).alias("entity"), F.concat(F.lit("　"), (F.col("gend") % 9).cast("string"), F.lit(" ")).alias("word"))
    least = found.groupBy("doc_id", "seq", "word").agg(F.min("entity").alias("entity"))
    return resolve.first_entities(least)


def manual_and_rest(spark: SparkSession, d: str) -> DataFrame:
    """Automatic detections taken away on some pages and by word; new ones that no existing one equals; panels before what was read."""
    rows = more._places(spark, d)
    n = _table(spark, d, "lineitem").count()
    # Each join and the grouping get tasks of so many rows, however much there is.
    by_page, by_span, by_doc = dealt(rows, n, "doc_id", "page_num"), dealt(rows, n, "doc_id", "entity", "gstart", "gend"), dealt(rows, n, "doc_id")
    scope = by_page.filter("entity = 'PERSON'").select("doc_id", "page_num").distinct()
    kept = resolve.without_words(resolve.without_automatic(by_page, scope), ["w50", "w60", "w70"])
    fresh = resolve.unmatched(by_span.filter("origin = 'auto'"), by_span.filter("origin = 'manual'"))
    panel = resolve.detect_input(by_doc.filter("entity = 'LOCATION'"), by_doc.filter("entity = 'PERSON'"))
    tagged = [x.select(F.lit(name).alias("what"), "doc_id", "entity", "origin") for name, x in (("kept", kept), ("fresh", fresh), ("panel", panel), ("manual", resolve.without_automatic(rows)))]
    out = tagged[0]
    for x in tagged[1:]:
        out = out.unionByName(x)
    # Automatic and manual rows are all rows; kept ones and the panel's are at most as many each.
    return dealt(out, 3 * n, "doc_id").groupBy("what", "doc_id", "entity", "origin").agg(F.count("*").alias("n"))


def preferred_results(spark: SparkSession, d: str) -> DataFrame:
    """Of each order's results the one that goes first."""
    o = _table(spark, d, "orders")
    result = lambda name, on: F.when(on, F.concat(F.lit(name), F.col("o_orderkey").cast("string")))
    best = files.preferred(result("duplicate", F.col("o_orderstatus") == "F"), result("detect", F.col("o_orderpriority") < "3"), result("read", F.col("o_totalprice") > 50000))
    return o.select("o_orderkey", best.alias("result"))


def exact_words(spark: SparkSession, d: str) -> DataFrame:
    """Words that a user marked, wherever whole documents hold them, but for those that are there already."""
    docs = _table(spark, d, "documents")
    before = detect.recognise(docs, {"OTHER": r"the[a-z]"}, whole=True).filter("start < 1000").select("doc_id", "entity", "start", "end")
    found = detect.exact_words(docs, [(" the[a-z] ", "OTHER"), ("der ", "PERSON"), (" ", "X"), ("(", "X")], before)
    return found.groupBy("doc_id", "entity", "word", "origin").agg(F.count("*").alias("n"), F.sum("start").cast("long").alias("starts"))


def _word_spans(spark: SparkSession, d: str) -> DataFrame:
    """Words of whole conversation turns as spans of a page: every fifth is hidden, doubled blanks are blank spans."""
    t = _table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("page_num"), F.posexplode(F.split(F.coalesce("text", F.lit("")), " ")).alias("span_num", "text"))
    x, y = F.col("span_num") % 8 * 60.0, F.floor(F.col("span_num") / 8) * 14.0
    return t.withColumns({"block_num": (F.col("span_num") / 16).cast("int"), "visible": F.col("span_num") % 5 != 4, "x0": x, "y0": y, "x1": x + 50, "y1": y + 10})


def span_maps(spark: SparkSession, d: str) -> DataFrame:
    """The map of visible spans, and how many of them hold a text."""
    kept = maps.span_map(_word_spans(spark, d))
    hit = maps.find_text(kept, "an").groupBy("doc_id", "page_num", "block_num").agg(F.count("*").alias("with_an"), F.max("offset").cast("long").alias("last"))
    rows = kept.groupBy("doc_id", "page_num", "block_num").agg(F.count("*").alias("n"), F.max("offset").cast("long").alias("top"))
    return rows.join(apart(hit), ["doc_id", "page_num", "block_num"], "left").fillna(0, ["with_an"]).select("doc_id", *more._long("page_num", "block_num"), "n", "top", "with_an", "last")


def visible_chars(spark: SparkSession, d: str) -> DataFrame:
    """Characters of whole turns without those that are drawn unseen, and the lines of the middle half of what is left, by key and by distance."""
    chars = more._chars(spark, d)
    hidden = chars.filter("ch IN ('e', 'n') AND offset % 2 = 0").select("doc_id", "page_num", F.when(F.col("offset") % 10 == 0, None).otherwise(F.col("x0") + 0.0001).alias("x0"), "y0", "ch")
    seen = layout.visible(chars, hidden)
    n = chars.groupBy("doc_id", "page_num").agg(F.count("*").alias("n"))
    spans = n.select("doc_id", F.col("page_num").alias("det"), (F.col("page_num") * 10**6 + F.floor(F.col("n") / 4)).alias("start"), (F.col("page_num") * 10**6 + F.floor(F.col("n") * 3 / 4) + 1).alias("end"))
    # Lines and distances read the places, which are written once.
    placed = written(layout.chars_of_spans(spans, seen.withColumn("goffset", F.col("page_num") * 10**6 + F.col("offset"))).select("doc_id", "det", "page_num", "block_num", "line_num", "x0", "y0", "x1", "y1"))
    lines = layout.line_rects(placed)
    near = placed.groupBy("doc_id", "det").agg(F.size(layout.grouped_lines(F.collect_list(F.struct("x0", "y0", "x1", "y1")), None)).cast("long").alias("n_near"))
    rows = lines.groupBy("doc_id", "det").agg(F.count("*").alias("n_lines"), F.sum(F.col("x1") - F.col("x0")).alias("width"), F.max("y1").alias("below"))
    return rows.join(near, ["doc_id", "det"]).select("doc_id", *more._long("det"), "n_lines", "width", "below", "n_near")


def restorable(spark: SparkSession, d: str) -> DataFrame:
    """Rows of an annotation report that can be made again, and how many of a document can't."""
    k = F.col("p_partkey")
    quad = F.when(k % 4 == 0, F.array(F.array(*[(k % n).cast("double") for n in (3, 5, 7, 5, 3, 11, 7, 11)])))
    rect = F.struct(F.lit(1.0).alias("x0"), F.lit(1.0).alias("y0"), (k % 3).cast("double").alias("x1"), F.lit(9.0).alias("y1"))
    report = _table(spark, d, "part").select((k % 50).alias("doc_id"), F.when(k % 6 == 0, "Ink").when(k % 2 == 0, "Square").otherwise("Highlight").alias("annotation_type"), (k % 7).alias("page_number"), quad.alias("quads"), rect.alias("rect"))
    back = highlights.restored(report).groupBy("doc_id").agg(F.count("*").alias("n_restored"), F.sum("box.x1").alias("x1"))
    return report.groupBy("doc_id").agg(F.count("*").alias("n")).join(back, "doc_id", "left").fillna(0, ["n_restored"])


def embedded_maps(spark: SparkSession, d: str) -> DataFrame:
    """Maps embedded beside their files: those of changed files aren't, unless forced, and a second run replaces its own only."""
    spans = maps.span_map(_word_spans(spark, d))
    wire = maps.required(maps.offset_map(spans))
    table = store.Table(spark, f"{ensure_checkpoint_dir(spark)}/tables-{uuid.uuid4().hex}", ("doc_id",))
    same = files.same_file(F.when(F.col("doc_id") % 3 == 0, "other"), F.when(F.col("doc_id") % 2 == 0, "other").otherwise("this"))
    table.replace(wire.filter(same).withColumn("run", F.lit("first")))
    table.replace(wire.filter(files.same_file(F.lit("a"), F.lit("b"), True)).filter("doc_id % 5 = 0").withColumn("run", F.lit("forced")))
    back = table.read()
    rows = maps.mapped(back).groupBy("doc_id").agg(F.count("*").alias("n"), F.round(F.sum("x1"), 2).alias("x1"))
    return back.select("doc_id", "run").join(apart(rows), "doc_id")


QUERIES = {
    "content_hashes": content_hashes, "entity_rules": entity_rules, "first_entities": first_entities, "manual_and_rest": manual_and_rest, "preferred_results": preferred_results, "exact_words": exact_words,
    "span_maps": span_maps, "visible_chars": visible_chars, "restorable": restorable, "embedded_maps": embedded_maps,
}

_PLACES = f"SELECT *, (doc_id % 4)::INT AS page_num, (seq % 3)::INT AS block_num, 'w' || gend AS word FROM ({base._IV})"
_PAGES = f"SELECT doc_id, i // 8 AS p, string_agg(t, chr(10) ORDER BY i) AS t, count(*) AS n FROM ({base._BLOCKS}) GROUP BY doc_id, i // 8"
_SPAN_W = """SELECT *, row_number() OVER (PARTITION BY doc_id, page_num, block_num ORDER BY k) - 1 AS o FROM (SELECT conv_id AS doc_id, turn AS page_num, (i - 1) // 16 AS block_num, i - 1 AS k, w[i] AS text, ((i - 1) % 8 * 60 + 50)::DOUBLE AS x1
 FROM (SELECT conv_id, turn, string_split(coalesce(text, ''), ' ') AS w FROM conversations), range(1, len(w) + 1) r(i) WHERE (i - 1) % 5 <> 4 AND NOT regexp_matches(w[i], '^[\\s\\x0B\\x1C-\\x1F\\x{85}\\x{A0}\\p{Z}]*$'))"""
_CHAR_V = """SELECT conv_id AS doc_id, turn AS det, o, length(text) AS n, o % 40 * 6 AS x, o // 40 AS line FROM conversations, range(0, length(coalesce(text, ''))) r(o)
 WHERE NOT (substr(text, o + 1, 1) IN ('e', 'n') AND o % 2 = 0 AND o % 10 <> 0)"""

SQL = {
    "content_hashes": f"""SELECT d.doc_id, sha256(coalesce(n, 0) || '|' || coalesce(a, '')) AS plain, sha256(coalesce(n, 0) || '|' || coalesce(b, '')) AS with_images FROM documents d LEFT JOIN
 (SELECT doc_id, count(*) AS n, string_agg(t, chr(12) ORDER BY p) AS a, string_agg(t || '|' || (n + p), chr(12) ORDER BY p) AS b FROM ({_PAGES}) GROUP BY doc_id) x ON x.doc_id = d.doc_id""",
    "entity_rules": f"""SELECT doc_id, seq, gstart, gend, CASE entity WHEN 'PERSON' THEN 'PERSON' WHEN 'MUHO' THEN 'MUHO' ELSE '-' END AS seen, sha256('["' || entity || '","' || word || '","' || gstart || '","' || gend || '"]') AS id,
 CASE WHEN seq % 2 = 0 THEN -1 ELSE block_num END AS block, page_num AS page, count(*) AS n FROM (SELECT * REPLACE (CASE WHEN seq % 3 = 0 THEN 'MUHO' ELSE entity END AS entity) FROM ({_PLACES})) GROUP BY ALL""",
    "first_entities": f"""SELECT doc_id, word, CASE entity WHEN '' THEN 'OTHER' ELSE entity END AS entity FROM (SELECT doc_id, (gend % 9)::VARCHAR AS word, seq * 1000000 + gstart * 1000 + gend AS s, min(CASE origin WHEN 'manual' THEN '' ELSE entity END) AS entity FROM ({_PLACES}) GROUP BY ALL)
 QUALIFY row_number() OVER (PARTITION BY doc_id, word ORDER BY s) = 1""",
    "manual_and_rest": f"""WITH r AS ({_PLACES}), p AS (SELECT DISTINCT doc_id FROM r WHERE entity = 'PERSON')
 SELECT what, doc_id, entity, origin, count(*) AS n FROM (
 SELECT 'kept' AS what, doc_id, entity, origin FROM r WHERE origin = 'manual' OR (doc_id NOT IN (FROM p) AND word NOT IN ('w50', 'w60', 'w70'))
 UNION ALL SELECT 'fresh', doc_id, entity, origin FROM r a WHERE origin = 'auto' AND NOT EXISTS (FROM r b WHERE b.origin = 'manual' AND b.doc_id = a.doc_id AND b.entity = a.entity AND b.gstart = a.gstart AND b.gend = a.gend)
 UNION ALL SELECT 'panel', doc_id, entity, origin FROM r WHERE entity = 'PERSON' OR (entity = 'LOCATION' AND doc_id NOT IN (FROM p))
 UNION ALL SELECT 'manual', doc_id, entity, origin FROM r WHERE origin = 'manual') GROUP BY ALL""",
    "preferred_results": "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'duplicate' || o_orderkey WHEN o_orderpriority < '3' THEN 'detect' || o_orderkey WHEN o_totalprice > 50000 THEN 'read' || o_orderkey END AS result FROM orders",
    "exact_words": """SELECT doc_id, entity, word, 'manual' AS origin, count(*) AS n, sum(o)::BIGINT AS starts FROM (SELECT doc_id, entity, m[k] AS word, (length(array_to_string(list_slice(g, 1, k), '')) + coalesce(length(array_to_string(list_slice(m, 1, k - 1), '')), 0)) AS o
 FROM (SELECT doc_id, e AS entity, regexp_extract_all(coalesce(text, ''), p) AS m, string_split_regex(coalesce(text, ''), p) AS g FROM documents, (VALUES ('OTHER', 'the[a-z]'), ('PERSON', 'der')) q(e, p)), range(1, len(m) + 1) r(k)) WHERE entity = 'PERSON' OR o >= 1000 GROUP BY ALL""",
    "span_maps": f"SELECT doc_id, page_num, block_num, count(*) AS n, max(o) AS top, count_if(contains(text, 'an'))::BIGINT AS with_an, max(o) FILTER (contains(text, 'an')) AS last FROM ({_SPAN_W}) GROUP BY ALL",
    "visible_chars": f"""SELECT doc_id, det, count(*) AS n_lines, sum(w)::DOUBLE AS width, (max(line) * 12 + 10)::DOUBLE AS below, count(*) AS n_near FROM (SELECT doc_id, det, line, max(x) + 6 - min(x) AS w FROM ({_CHAR_V}) WHERE o >= n // 4 AND o <= n * 3 // 4 GROUP BY ALL) GROUP BY ALL""",
    "restorable": """SELECT p_partkey % 50 AS doc_id, count(*) AS n, count_if(good)::BIGINT AS n_restored, sum(x1) FILTER (good) AS x1 FROM (SELECT p_partkey, x1, p_partkey % 6 <> 0 AND p_partkey % 7 >= 1 AND x1 IS NOT NULL AS good FROM (SELECT p_partkey,
 CASE WHEN p_partkey % 4 = 0 AND greatest(p_partkey % 3, p_partkey % 7) > least(p_partkey % 3, p_partkey % 7) AND greatest(p_partkey % 5, p_partkey % 11) > least(p_partkey % 5, p_partkey % 11) THEN greatest(p_partkey % 3, p_partkey % 7)::DOUBLE WHEN p_partkey % 3 > 1 THEN (p_partkey % 3)::DOUBLE END AS x1 FROM part)) GROUP BY ALL""",
    "embedded_maps": f"SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'forced' ELSE 'first' END AS run, count(*) AS n, round(sum(x1), 2) AS x1 FROM ({_SPAN_W}) WHERE doc_id % 5 = 0 OR doc_id % 3 <> 0 OR doc_id % 2 = 0 GROUP BY ALL",
}
