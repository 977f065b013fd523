"""More registered queries: target texts, recognisers, masks, highlights, maps, recognition results, reports, older resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.functions import geometry as G
from spanloom.functions import values as V
from spanloom.operators import detect, highlights, layout, legacy, maps, masks, ocr, offsets, reports, resolve
from spanloom.plans import queries as base
from spanloom.shipping import apart, dealt, spread
from spanloom.sources import files

_table, _docs, _rects = base._table, base._docs, base._rects
_PLACE = ("x0", "y0", "x1", "y1")
MARKED = r'token = "([0-9a-f]+)"'


def _long(*names: str) -> list[Column]:
    return [F.col(n).cast("long").alias(n) for n in names]


def target_text(spark: SparkSession, d: str) -> DataFrame:
    """Pages 0 and 2 with line breaks: length, digest, and the spans' sums."""
    rows = _docs(spark, d).select("doc_id", offsets.target_chars(F.col("text"), False, False, [0, 2]).alias("c"))
    joined = F.array_join(F.transform("c", lambda x: x["ch"]), "")
    total = lambda k: F.aggregate("c", F.lit(0).cast("long"), lambda n, x: n + x[k]).alias(f"sum_{k}")
    return rows.select("doc_id", F.size("c").cast("long").alias("n"), F.sha2(joined, 256).alias("sha256"), total("start"), total("end"))


def target_positions(spark: SparkSession, d: str) -> DataFrame:
    """The base span of the middle half of each text without white space."""
    rows = _docs(spark, d).select("doc_id", offsets.flat_text(F.col("text")).alias("t"))
    rows = rows.select("doc_id", F.length("t").alias("n"), offsets.pieces(F.col("t")).alias("c"))
    rows = rows.select("doc_id", "n", "c", offsets.unspaced_size(F.col("c")).alias("size"))
    span = offsets.unspaced_span(F.floor(F.col("size") / 4).cast("int"), F.floor(F.col("size") * 3 / 4).cast("int"), F.col("c"), F.col("size"), F.col("n"))
    return rows.select("doc_id", span.alias("s")).select("doc_id", F.col("s.start").cast("long").alias("start"), F.col("s.end").cast("long").alias("end"))


def chunked_detect(spark: SparkSession, d: str) -> DataFrame:
    """Detection chunk by chunk (700 characters), spans checked against the text."""
    docs = _table(spark, d, "documents")
    found = detect.chunked(docs, base.SHAPES, delimiter="", max_chars=700, max_bytes=10**9).join(docs.select("doc_id", "text"), "doc_id")
    return found.groupBy("doc_id", "entity", "word").agg(F.count("*").alias("n"), F.bool_and(F.expr("substring(text, start + 1, `end` - start) = word")).alias("in_place"))


def group_spans(spark: SparkSession, d: str) -> DataFrame:
    """A pattern with a group marks the group alone."""
    found = detect.recognise(_table(spark, d, "documents"), {"TOKEN": MARKED})
    return found.groupBy("doc_id", "word").agg(F.count("*").alias("n"))


def _cards(spark: SparkSession, d: str) -> DataFrame:
    """Texts that hold each built-in shape once, from orders."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    number = F.lpad((k * 7919 + c * 104729).cast("string"), 12, "1")
    text = F.concat(F.lit("山田様、"), (k % 900 + 1100).cast("string"), F.lit("年 電話 03-"), F.lpad((c % 10000).cast("string"), 4, "1"), F.lit("-"), F.lpad((k % 10000).cast("string"), 4, "2"), F.lit(" 番号 "), number, F.lit(" 終"))
    # Dealt by their number, and joins and windows by document need no other shuffle.
    orders = _table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return dealt(orders, orders.count(), "o_orderkey").select(k.alias("doc_id"), text.alias("text"))


def built_in(spark: SparkSession, d: str) -> DataFrame:
    return detect.recognise(_cards(spark, d), detect.PATTERNS, whole=True).select("doc_id", "entity", "word", *_long("start", "end"))


def built_in_valid(spark: SparkSession, d: str) -> DataFrame:
    """The same refined and validated."""
    return detect.refine(detect.recognise(_cards(spark, d), detect.PATTERNS, whole=True)).select("doc_id", "entity", "word", *_long("start", "end"))


def omitted(spark: SparkSession, d: str) -> DataFrame:
    """Detections without words that end in 7 and without spans that years meet; added spans displace built-in ones."""
    docs = _cards(spark, d)
    found = detect.recognise(docs, detect.PATTERNS, whole=True).select("doc_id", "entity", "start", "end", "word", "origin")
    own = detect.added(docs, [("OTHER", r"電話 (03)"), ("PERSON", r"山田様")]).select("doc_id", "entity", "start", "end", "word", "origin")
    rows = detect.without_overlaps(found, own).unionByName(own)
    return detect.omit(rows, docs, ["7$", "11[0-9]{2}年"]).select("doc_id", "entity", "word", "origin", *_long("start", "end"))


def literal_search(spark: SparkSession, d: str) -> DataFrame:
    """Overlapping places of a literal in each block."""
    found = detect.block_spans(offsets.blocks(_docs(spark, d)), "an")
    return found.groupBy("doc_id", "page_num").agg(F.count("*").alias("n"), F.sum("start").cast("long").alias("starts")).select("doc_id", *_long("page_num"), "n", "starts")


def _places(spark: SparkSession, d: str) -> DataFrame:
    """Detections with a page, from line items."""
    return base._intervals(spark, d).withColumn("page_num", (F.col("doc_id") % 4).cast("int")).withColumn("block_num", (F.col("seq") % 3).cast("int")).withColumn("offset", F.col("gstart").cast("int")).withColumn("word", F.concat(F.lit("w"), F.col("gend").cast("string")))


def filtered(spark: SparkSession, d: str) -> DataFrame:
    """Column filters, an invalid one ignored."""
    found = reports.filtered(_places(spark, d), type="人|場", text="[13579]$", place="^p[12]:", origin="自", page="(")
    return found.select("doc_id", "seq", "word")


def sort_order(spark: SparkSession, d: str) -> DataFrame:
    """Ranks of a document's detections, one a start, by place and by text."""
    rank = lambda c: F.row_number().over(W.partitionBy("doc_id").orderBy(*reports.sort_keys(c), "seq")).cast("long")
    one = _places(spark, d).groupBy("doc_id", "gstart").agg(F.min("seq").alias("seq"), F.min("gend").alias("gend"))
    rows = one.withColumns({"page_num": F.col("gstart") % 4, "block_num": F.col("seq") % 3, "offset": F.col("gstart"), "word": F.concat(F.lit("W"), F.col("gend").cast("string"), F.lit("-"), F.col("gstart").cast("string"))})
    return rows.select("doc_id", "gstart", rank("page").alias("by_page"), rank("text").alias("by_text"))


def csv_report(spark: SparkSession, d: str) -> DataFrame:
    """The detection list as shown."""
    rows = files.csv_rows(_places(spark, d))
    return rows.groupBy(*[F.col(h).alias(n) for h, n in zip(files.CSV_HEADER, ("page", "type", "word", "place", "mark"))]).agg(F.count("*").alias("n"))


def panel(spark: SparkSession, d: str) -> DataFrame:
    """Custom rows go where an automatic one has the same entity and span."""
    rows = base._intervals(spark, d).withColumn("origin", F.when(F.col("origin") == "manual", "custom").otherwise("auto")).withColumn("gend", F.col("gstart") + 1).withColumn("gstart", F.col("gstart") % 3)
    return resolve.auto_over_custom(rows).groupBy("doc_id", "origin").agg(F.count("*").alias("n"))


def merged_first(spark: SparkSession, d: str) -> DataFrame:
    """Earlier detections before new ones, the first of each key staying."""
    rows = base._intervals(spark, d).select("doc_id", "seq", "entity", "gstart", "origin")
    old, new = rows.filter("origin = 'manual'"), rows.filter("origin = 'auto'")
    out = resolve.first_wins(resolve.merged(old, new), "doc_id", "entity", "gstart")
    return out.groupBy("doc_id", "origin").agg(F.count("*").alias("n"))


def _found(spark: SparkSession, d: str) -> DataFrame:
    """Detections with manual shapes, from parts: one in five a rectangle, one in seven a circle."""
    k = F.col("idx")
    r = _rects(spark, d).withColumn("doc_id", (k % 50).cast("long"))
    rect = F.struct(F.lit(None).cast("long").alias("page_num"), *_PLACE)
    circle = F.struct(F.lit(None).cast("long").alias("page_num"), F.col("x0").alias("center_x"), F.col("y0").alias("center_y"), (F.col("x1") - F.col("x0") - 5).alias("radius"))
    return r.select(
        "doc_id", k.alias("det"), k.alias("seq"), F.expr("CASE idx % 3 WHEN 0 THEN 'PERSON' WHEN 1 THEN 'YEAR' ELSE 'ODD' END").alias("entity"), "page_num",
        F.when(k % 35 == 0, "circle_drag").otherwise("").alias("selection_mode"), F.when(k % 5 == 0, F.array(rect)).alias("mask_rects"), F.when(k % 7 == 0, F.array(circle)).alias("mask_circles"), *_PLACE,
    )


def mask_plan(spark: SparkSession, d: str) -> DataFrame:
    """Shapes to be masked, with their styles, by document and page."""
    found = _found(spark, d)
    lines = found.select("doc_id", "det", "page_num", *_PLACE)
    plan = masks.mask_plan(found.drop(*_PLACE), lines, masks.mask_styles(spark, ["person=#F00@0.25", "YEAR=rgba(0,0,255,.5)"]))
    return plan.select("doc_id", "page_num", "entity", "shape", *_PLACE, F.coalesce("radius", F.lit(0.0)).alias("radius"), *[F.round(c, 4).alias(c) for c in ("r", "g", "b", "alpha")])


def _chars(spark: SparkSession, d: str) -> DataFrame:
    """Characters on a grid, 6 by 12 points, 40 a line, from conversation turns: a conversation is a document, a turn a page of one block."""
    t = _table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_num"), F.coalesce("text", F.lit("")).alias("text"))
    c = t.select("doc_id", "page_num", F.lit(0).cast("long").alias("block_num"), F.posexplode(F.split("text", "")).alias("offset", "ch")).filter("ch <> ''")
    x, y = F.col("offset") % 40 * 6.0, F.floor(F.col("offset") / 40) * 12.0
    return c.withColumns({"line_num": F.floor(F.col("offset") / 40), "x0": x, "y0": y.cast("double"), "x1": x + 6.0, "y1": y + 10.0})


def map_rects(spark: SparkSession, d: str) -> DataFrame:
    """Line boxes of spans that cross two pages, through the coordinate map."""
    pages = _table(spark, d, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.min("turn").alias("p"))
    place = lambda p, o: F.struct(p.alias("page_num"), F.lit(0).cast("long").alias("block_num"), F.lit(o).alias("offset"))
    spans = pages.select("doc_id", F.lit(1).alias("det"), place(F.col("p"), 30).alias("start"), place(F.col("p") + 1, 45).alias("end"))
    return masks.line_boxes(masks.map_rects(spans, _chars(spark, d))).select("doc_id", "page_num", *_PLACE)


def span_rects(spark: SparkSession, d: str) -> DataFrame:
    """Boxes by block and line of the characters 10 to 59 of each page, and their quads."""
    c = _chars(spark, d).withColumn("det", F.lit(1)).filter("offset BETWEEN 10 AND 59")
    quads = masks.page_quads(layout.line_rects(c))
    return quads.select("doc_id", "page_num", "n_quads", F.aggregate(F.flatten("quads"), F.lit(0.0), lambda a, x: a + x).alias("total"))


def char_details(spark: SparkSession, d: str) -> DataFrame:
    """Characters of a span that reaches past the text: question marks there."""
    c = _chars(spark, d).filter("page_num = 0").select("doc_id", F.col("offset").alias("goffset"), "ch", *_PLACE)
    spans = _table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id")).distinct().select("doc_id", F.lit(1).alias("det"), F.lit(20).alias("start"), F.lit(120).alias("end"))
    return maps.char_details(spans, c).groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(F.col("x0").isNull()).alias("n_missing"))


def map_tables(spark: SparkSession, d: str) -> DataFrame:
    """The wire map and back: boxes by page, and the places that the reverse map keeps."""
    c = maps.listed(_chars(spark, d))
    back = maps.mapped(maps.required(maps.offset_map(c)))
    kept = maps.coords_map(c).groupBy("doc_id").agg(F.count("*").alias("places"), F.sum("offset").cast("long").alias("offsets"))
    return maps.statistics(back).groupBy("doc_id").agg(F.count("*").alias("pages"), F.sum("blocks").alias("blocks"), F.sum("mappings").alias("mappings")).join(apart(kept), "doc_id")


def near_spans(spark: SparkSession, d: str) -> DataFrame:
    """Rectangles within five points of each supplier's point."""
    points = _table(spark, d, "supplier").select(F.col("s_suppkey").alias("pid"), (F.col("s_suppkey") % 3).alias("doc_id"), (F.col("s_suppkey") % 4).alias("page_num"), (F.col("s_suppkey") * 61 % 500).cast("double").alias("x"), (F.col("s_suppkey") * 97 % 700).cast("double").alias("y"))
    return maps.near_points(points, _rects(spark, d)).union(layout.char_at(points, _rects(spark, d)).select("pid", -F.col("idx"))).union(layout.chars_in_circle(points.withColumn("radius", F.lit(20.0)), _rects(spark, d)).select(F.col("pid") + 10**6, "idx"))


def highlight_spans(spark: SparkSession, d: str) -> DataFrame:
    """Highlights of e-mail addresses placed again: the k-th at the k-th place of its word."""
    docs = _table(spark, d, "documents")
    found = detect.recognise(docs, {"EMAIL": base.SHAPES["EMAIL"]})
    marks = found.select("doc_id", F.col("start").cast("long").alias("seq"), F.lit("Auto ").alias("title"), V.highlight_content(F.col("word"), F.lit("OTHER")).alias("content"))
    records = highlights.annotations(marks.withColumns({"annotation_type": F.lit("Highlight"), "page_num": F.lit(0), "opacity": F.lit(None).cast("double"), "vertices": F.lit(None).cast("array<double>"), "rect": F.struct(*(F.lit(float(i)).alias(c) for i, c in enumerate(_PLACE)))}))
    return highlights.to_detections(highlights.highlights(records), docs).select("doc_id", "word", "origin", "start", "end")


def new_annotations(spark: SparkSession, d: str) -> DataFrame:
    """Planned rectangles beside those that exist, by mode."""
    r = _rects(spark, d).withColumns({"doc_id": (F.col("idx") % 50).cast("long"), "entity": F.lit("OTHER"), "word": (F.col("idx") % 9).cast("string"), "annotation_type": F.when(F.col("idx") % 4 == 0, "Square").otherwise("Highlight")})
    planned = r.filter("annotation_type = 'Highlight'").withColumn("x0", F.col("x0") + F.when(F.col("idx") % 6 == 0, 0.05).otherwise(0.5))
    one = lambda mode: highlights.applied(planned, r, mode).groupBy("annotation_type").agg(F.count("*").alias("n")).withColumn("mode", F.lit(mode))
    return one("append").unionByName(one("reset_and_append"))


def ocr_items(spark: SparkSession, d: str) -> DataFrame:
    """Items of results in six shapes, as points on the page."""
    k = F.col("p_partkey")
    n = lambda e: e.cast("string")
    x, y, w, h = (n(v) for v in (k % 100, k % 70, k % 9, k % 7 + 1))
    shapes = [
        F.concat(F.lit('{"results":[{"text":" a ","bbox":{"x":'), x, F.lit(',"y":'), y, F.lit(',"width":'), w, F.lit(',"height":'), h, F.lit('},"score":0.5}]}')),
        F.concat(F.lit('[["b",['), x, F.lit(","), y, F.lit(","), n(k % 100 + k % 9), F.lit(","), n(k % 70 + k % 7 + 1), F.lit('],"0.25"]]')),
        F.concat(F.lit('{"lines":[{"text":"c","points":[['), x, F.lit(","), y, F.lit("],["), n(k % 100 + k % 9), F.lit(","), n(k % 70 + k % 7 + 1), F.lit(']]}]}')),
        F.concat(F.lit('{"text":"d","box":{"left":'), x, F.lit(',"top":'), y, F.lit(',"right":'), n(k % 100 + k % 9), F.lit(',"bottom":'), n(k % 70 + k % 7 + 1), F.lit('},"prob":"x"}')),
        F.concat(F.lit('{"items":[{"text":"e","polygon":['), x, F.lit(","), y, F.lit(","), n(k % 100 + k % 9), F.lit(","), y, F.lit(","), n(k % 100 + k % 9), F.lit(","), n(k % 70 + k % 7 + 1), F.lit(","), x, F.lit(","), n(k % 70 + k % 7 + 1), F.lit('],"confidence":1}]}')),
        F.lit('{"data":[{"text":"f"},{"text":"g","bounds":[1,2,"z",4]}],"results":7}'),
    ]
    raw = F.element_at(F.array(*shapes), (k % 6 + 1).cast("int"))
    # Few bytes of parts make many items: they are dealt to several tasks a core.
    part = spread(_table(spark, d, "part"), "p_partkey")
    rows = ocr.to_points(ocr.items(part.select(k.alias("doc_id"), F.lit(0).alias("page_num"), raw.alias("raw"))), 144.0, 1.0, 2.0)
    return rows.select("doc_id", "text", "x", "y", "width", "height", "confidence")


def ocr_plan(spark: SparkSession, d: str) -> DataFrame:
    """Texts to be written on pages of 300 by 400 points."""
    r = _rects(spark, d).select("doc_id", "page_num", F.col("idx").alias("item_num"), F.when(F.col("idx") % 5 == 0, " ").otherwise("abc").alias("text"), F.col("x0").alias("x"), F.col("y0").alias("y"), F.expr("x1 - x0").alias("width"), F.expr("y1 - y0").alias("height"), F.when(F.col("idx") % 2 == 0, F.array(F.lit(255.0), F.lit(0.0), F.lit(51.0))).alias("text_color"), F.lit(None).cast("double").alias("text_opacity"))
    pages = r.select("doc_id", "page_num", F.lit(300.0).alias("width"), F.lit(400.0).alias("height")).distinct()
    plan = ocr.write_plan(r, pages, (0, 0, 0), 0.5, True)
    return plan.select("item_num", *_PLACE, F.round(F.col("color")[2], 4).alias("blue"), "opacity", F.round("font_size", 4).alias("font_size"))


def ocr_offsets(spark: SparkSession, d: str) -> DataFrame:
    """Read items against truth: offsets of the pairs."""
    k = F.col("idx")
    r = _rects(spark, d).select(k.alias("doc_id"), F.lit(0).alias("page_num"), k.alias("seq"), F.concat(F.lit("Ｎo "), k.cast("string")).alias("text"), F.col("x0").alias("x"), F.col("y0").alias("y"))
    read = r.withColumns({"text": F.concat(F.lit("No"), F.col("seq").cast("string")), "x": F.col("x") + F.col("seq") % 4, "y": F.col("y") - F.col("seq") % 3})
    out = layout.offset_report(ocr.pairs(r, read))
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


def file_report(spark: SparkSession, d: str) -> DataFrame:
    """The run's report over orders as files and line items as detections."""
    o = _table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("path"), (F.col("o_orderkey") % 11 == 0).alias("skipped"), F.when(F.col("o_orderkey") % 13 == 0, "bad").alias("error"))
    found = base._intervals(spark, d).select(F.col("doc_id").cast("string").alias("path"), "seq", "entity")
    rows = reports.run_report(reports.file_summaries(o, found))
    return rows.select(*[F.col(h).alias(n) for h, n in zip(reports.RUN_HEADER, ("file", "n", "status", "types"))])


def run_totals(spark: SparkSession, d: str) -> DataFrame:
    o = _table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("path"), (F.col("o_orderkey") % 11 == 0).alias("skipped"), F.when(F.col("o_orderkey") % 13 == 0, "bad").alias("error"))
    found = base._intervals(spark, d).select(F.col("doc_id").cast("string").alias("path"), "seq", "entity")
    return reports.run_totals(reports.file_summaries(o, found)).select("entity", "n", "files")


def text_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Blocks, pages and grid cells of each text, and whether its characters are the text."""
    block = offsets.blocks(_docs(spark, d))
    cells = _rects(spark, d).withColumn("g", F.explode(G.grid_cells(G.rect(*_PLACE)))).select("doc_id", "page_num", "g.gx", "g.gy")
    return reports.block_statistics(block, cells)


def integrity(spark: SparkSession, d: str) -> DataFrame:
    t = _table(spark, d, "conversations").filter("turn = 0").select(F.col("conv_id").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    c = _chars(spark, d).filter("page_num = 0").select("doc_id", F.col("offset").alias("goffset"), "ch")
    return reports.text_integrity(c, t)


def summaries(spark: SparkSession, d: str) -> DataFrame:
    """Blocks compacted, with previews."""
    rows = offsets.block_summary(offsets.compact(offsets.blocks(_docs(spark, d))))
    return rows.select("doc_id", *_long("page_num", "block_num"), "preview", F.col("n_chars").cast("long").alias("n_chars"))


def _legacy(policy: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        rows = _legacy_rows(spark, d)
        return legacy.keep(rows, "overlap", policy, ("LOCATION", "PERSON")).select("doc_id", "seq", "entity")

    return query


def _legacy_rows(spark: SparkSession, d: str) -> DataFrame:
    one = base._by_document(spark, d).groupBy("doc_id", "gstart", "gend").agg(*[F.min(c).alias(c) for c in ("seq", "entity", "origin")])
    seq = F.row_number().over(W.partitionBy("doc_id").orderBy("seq", "gstart", "gend")).cast("long")
    return one.select("doc_id", seq.alias("seq"), "entity", F.when(F.col("origin") == "manual", "addition").otherwise("auto").alias("origin"), F.col("gstart").alias("start"), F.col("gend").alias("end"))


def legacy_tie_break(spark: SparkSession, d: str) -> DataFrame:
    return legacy.tie_break(_legacy_rows(spark, d), "overlap", ("origin", "length", "entity", "position"), ("auto",), ("LOCATION", "PERSON"), "short").select("doc_id", "seq", "entity")


def legacy_quads(spark: SparkSession, d: str) -> DataFrame:
    """The widest of rectangles that share an area, page by page."""
    r = _rects(spark, d).select((F.col("idx") % 5).alias("doc_id"), F.col("idx").alias("seq"), "page_num", F.lit("OTHER").alias("entity"), F.lit("auto").alias("origin"), F.array(F.array("x0", "y0", F.expr("x1 + 20"), F.expr("y1 + 20"))).alias("quads"))
    return legacy.keep(r).select("doc_id", "seq")


def sessions(spark: SparkSession, d: str) -> DataFrame:
    """States of customers: the sidecar before the embedded one, and whether its hash fits."""
    c = _table(spark, d, "customer")
    key = F.col("c_custkey")
    hashed = lambda m: F.sha2((key % m).cast("string"), 256)
    paths = c.select(key.alias("path"), hashed(7).alias("sha256"))
    side = c.filter("c_nationkey < 10").select(key.alias("path"), hashed(14).alias("content_hash"), F.lit("s").alias("state"))
    inside = c.filter("c_acctbal > 0").select(key.alias("path"), hashed(7).alias("content_hash"), F.lit("e").alias("state"))
    return reports.sessions(paths, side, inside).groupBy("state", "source", "mismatch").agg(F.count("*").alias("n"))


def marks(spark: SparkSession, d: str) -> DataFrame:
    """Names, ranks, colours and labels of entities and origins."""
    t = base._intervals(spark, d).groupBy("entity", "origin").agg(F.count("*").alias("n"))
    e, o = F.col("entity"), F.col("origin")
    low = F.concat(F.lit("  "), F.lower("entity"), F.lit("　"))
    return t.select(
        V.entity_key(low).alias("entity"), V.entity_name_ja(e).alias("name"), V.entity_rank(e).cast("long").alias("rank"), V.origin(F.lit(False), o).alias("origin"), V.origin_label(F.lit(False), o).alias("label"),
        F.round(masks.mark_style(e)["g"], 4).alias("mark_g"), V.entity_colour(e)["b"].alias("note_b"), V.entity_colour(e, True)["b"].alias("high_b"), V.annotation_text(e, F.lit("w"), "verbose", True).alias("note"), "n",
    )


def coercions(spark: SparkSession, d: str) -> DataFrame:
    """Numbers read from text, clamped; flags; output names; skipped files."""
    k = F.col("c_custkey")
    text = F.when(k % 3 == 0, "x").otherwise((k - 50).cast("string"))
    path = F.concat(F.lit("/in/f"), k.cast("string"), F.when(k % 4 == 0, "_masked.pdf").when(k % 4 == 1, "_backup.x.pdf").otherwise(".pdf"))
    flag = F.element_at(F.array(*map(F.lit, (" On", "no", "YES\t", "1", "2"))), (k % 5 + 1).cast("int"))
    name = F.element_at(F.split(path, "/"), -1)
    return _table(spark, d, "customer").select("c_custkey", V.clamped(text, 0, 100, 7).alias("v"), V.flag(flag).alias("on"), files.output_path(path).alias("path"), files.skipped(name).alias("skipped"), files.same_file(F.when(k % 2 == 0, text), F.lit("x")).alias("same"))


def shapes(spark: SparkSession, d: str) -> DataFrame:
    """Areas, clipped parts, circles, sizes and offsets of rectangles."""
    r = G.rect(*_PLACE)
    page = G.rect(F.lit(100.0), F.lit(100.0), F.lit(300.0), F.lit(400.0))
    cut = G.clipped(r, page)
    quad = F.array("x1", "y0", "x0", "y0", "x0", "y1", "x1", "y1")
    return _rects(spark, d).select(
        "idx", G.area(r).alias("area"), F.when(cut.isNull(), -1.0).otherwise(G.area(cut)).alias("cut"), G.touches_circle(r, F.lit(250.0), F.lit(350.0), F.lit(80.0)).alias("near"), (G.quad_bounds(quad)["x0"] == F.col("x0")).alias("bounds"),
        G.flipped(F.col("y0"), F.lit(800.0)).alias("flipped"), F.round(G.pixels_to_points(F.col("x0"), 300.0, 2.0), 6).alias("points"), G.hex_colour(F.col("x0") / 500, F.lit(0.5), F.lit(1.0)).alias("colour"),
        F.round(G.fitting_font_size(F.expr("x1 - x0"), F.expr("y1 - y0"), F.lit(2.0)), 6).alias("size"), G.shape_offset(*[F.col(c) for c in _PLACE]).alias("offset"),
    )


QUERIES = {
    "target_text": target_text, "target_positions": target_positions, "chunked_detect": chunked_detect, "group_spans": group_spans, "built_in": built_in, "built_in_valid": built_in_valid, "omitted": omitted,
    "literal_search": literal_search, "filtered": filtered, "sort_order": sort_order, "csv_report": csv_report, "panel": panel, "merged_first": merged_first, "mask_plan": mask_plan, "map_rects": map_rects, "span_rects": span_rects,
    "char_details": char_details, "map_tables": map_tables, "near_spans": near_spans, "highlight_spans": highlight_spans, "new_annotations": new_annotations, "ocr_items": ocr_items, "ocr_plan": ocr_plan, "ocr_offsets": ocr_offsets,
    "file_report": file_report, "run_totals": run_totals, "text_statistics": text_statistics, "integrity": integrity, "summaries": summaries, "legacy_widest": _legacy("widest"), "legacy_first": _legacy("first"), "legacy_last": _legacy("last"),
    "legacy_entity_order": _legacy("entity-order"), "legacy_tie_break": legacy_tie_break, "legacy_quads": legacy_quads, "sessions": sessions, "marks": marks, "coercions": coercions, "shapes": shapes,
}
