"""The chains as the service runs them: detection of whole documents with a configuration, and masks from detections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions import patterns
from spanloom.functions.values import CONFIG_ALIASES, ENTITIES, normal_entity
from spanloom.operators import detect, highlights, layout, masks, offsets, resolve
from spanloom.plans import config, steps
from spanloom.shipping import apart, spread, written

#: Ways to mask: kinds of annotations, and the mode in which each is applied after the first.
METHODS = ("annotation", "highlight", "both")


def options_of(data: dict) -> dict:
    """run_detect()'s options from a configuration in any of its shapes."""
    c = config.normal(data)
    return {
        "entities": c["enabled_entities"], "add": [(e, p) for e, listed in c["add_entity"].items() for p in listed], "exclude": c["ommit_entity"],
        "chunks": c["chunk_settings"], "custom": config.recogniser_patterns(c), **c["text_preprocess_settings"],
    }


def added_entity(name: str, enabled: list[str]) -> str | None:
    """The entity of an added pattern: a known one only if it is enabled, an unknown one as it is written, no name none."""
    named = lambda x: CONFIG_ALIASES.get((x or "").strip().upper(), normal_entity(x))
    known = named(name)
    if known not in ENTITIES:
        return (name or "").strip() or None
    return known if known in {named(e) for e in enabled} else None


def run_detect(docs: DataFrame, options: dict | None = None) -> DataFrame:
    """(doc_id, seq, entity, word, origin, first, last) of documents (doc_id, text as pages of blocks[, detect]).

    options: entities that are enabled, recognisers (patterns by entity) and custom ones, which displace them, add
    (entity, pattern), exclude (patterns), pages, chunks, ignore_newlines, ignore_whitespace, use_predetect.  Patterns read
    the target text; their spans are mapped back to positions (page_num, block_num, offset), the last one included, and
    start on a wanted page.  detect, an array of (first, last, entity, word, origin), are detections from before: they come
    first, and the first of one entity and span stays.  What an exclusion finds in a word goes, and what meets an excluded
    span of the target text; manual detections stay.  A document without text gives the detections that it came with.
    """
    o = options or {}
    enabled, pages = o.get("entities", list(ENTITIES)), o.get("pages")
    wanted = None if pages is None else sorted({int(p) for p in pages if str(p).lstrip("-").isdigit() and int(p) >= 0})
    text = F.coalesce("text", F.array().cast("array<array<string>>"))
    # Exploding an array of one keeps the optimiser from writing the target's expression wherever it is used.
    target = offsets.target(F.col("text"), o.get("ignore_newlines", True), o.get("ignore_whitespace", False), wanted)
    # Patterns, segments and blocks read the target; it is made once and written, by several tasks a core.
    cut = written(spread(docs.select("doc_id", text.alias("text")), "doc_id").withColumn("target", F.explode(F.array(target))))
    plain = cut.select("doc_id", F.col("target.text").alias("text"))

    recognisers = {e: p for e, p in o.get("recognisers", detect.PATTERNS).items() if e in enabled}
    columns = ["doc_id", "entity", "start", "end", "word", "origin", "turn", "prio"]
    parts = []
    if recognisers:
        chunk = {k: v for k, v in o.get("chunks", {}).items() if k in ("delimiter", "max_chars", "max_bytes")}
        own = detect.refine(detect.chunked(plain, recognisers, **chunk))
        if custom := detect.compile_patterns([(e, p) for e, p in o.get("custom", []) if added_entity(e, enabled)]):
            more = detect.added(plain, custom, "auto")
            own = detect.without_overlaps(own, more).unionByName(more)
        parts.append(own.withColumn("turn", F.lit(0)).withColumn("prio", F.lit(0)).select(columns))
    if add := detect.compile_patterns([(entity, p) for e, p in o.get("add", []) if (entity := added_entity(e, enabled))]):
        parts.append(detect.recognise(plain, add, "custom").withColumn("turn", F.lit(1)).select(columns))
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = parts[0] if parts else docs.sparkSession.createDataFrame([], f"doc_id {kind}, entity string, start int, end int, word string, origin string, turn int, prio int")
    for more in parts[1:]:
        found = found.unionByName(more)

    placed = offsets.positioned(offsets.mapped_back(found, cut), cut)
    if wanted is not None:
        placed = placed.filter(F.col("first.page_num").isin(*wanted))
    rows = steps.ordered(placed, "turn", "prio", "start", "end", "entity", "word").select("doc_id", "seq", "entity", "word", "origin", "first", "last", "start", "end")
    if o.get("use_predetect", True) and "detect" in docs.columns:
        before = docs.select("doc_id", F.posexplode("detect").alias("seq", "d")).select("doc_id", F.col("seq").cast("long").alias("seq"), "d.entity", "d.word", "d.origin", *[_position(F.col(f"d.{c}")).alias(c) for c in ("first", "last")])
        rows = resolve.merged(before.withColumns({c: F.lit(None).cast("int") for c in ("start", "end")}).select(rows.columns), rows)
    rows = resolve.first_wins(rows.withColumn("key_", resolve.span_key(F.col("entity"), F.col("first"), F.col("last"))), "doc_id", "key_").drop("key_")

    unwanted = [p for p in o.get("exclude", []) if patterns.readable(p) and p.strip()]
    if unwanted:
        manual = F.coalesce(F.lower("origin") == "manual", F.lit(False))
        hit = F.lit(False)
        for p in unwanted:
            hit = hit | F.coalesce(patterns.search(F.col("word"), p), F.lit(False))
        rows = rows.withColumn("stays_", manual).filter(F.col("stays_") | ~hit)
        spans = detect.recognise(plain, [("", p) for p in unwanted], whole=True)
        free = detect.without_overlaps(rows.filter("NOT stays_ AND start IS NOT NULL"), spans)
        rows = rows.filter("stays_ OR start IS NULL").unionByName(free).drop("stays_")
    return rows.select("doc_id", "seq", "entity", "word", "origin", "first", "last")


def _position(p: Column) -> Column:
    return F.struct(*[p[c].cast("int").alias(c) for c in ("page_num", "block_num", "offset")])


def text_lines(found: DataFrame, chars: DataFrame | None = None, mapped: DataFrame | None = None, given: str | None = "rects_pdf", threshold: float | None = 2.0) -> DataFrame:
    """(doc_id, det, page_num, x0, y0, x1, y1): the lines that each detection covers, from the first source that knows it.

    found: doc_id, det, page_num, first, last, and in the column given rectangles (x0, y0, x1, y1) on that page; chars: the
    locator's characters (doc_id, page_num, block_num, line_num, offset, x0..y1); mapped: the coordinate map's.
    """
    sources = []
    if given and given in found.columns:
        r = found.select("doc_id", "det", "page_num", F.explode(given).alias("r")).filter(F.size("r") >= 4)
        sources.append(r.select("doc_id", "det", F.col("page_num").cast("int").alias("page_num"), *[F.col("r")[i].alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))]).filter("x1 > x0 AND y1 > y0"))
    spans = found.select("doc_id", "det", F.col("first").alias("start"), F.col("last").alias("end"))
    if chars is not None:
        hit = masks.map_rects(spans, chars.filter("x0 IS NOT NULL")).join(apart(chars.select("doc_id", "page_num", "block_num", "offset", "line_num")), ["doc_id", "page_num", "block_num", "offset"])
        sources.append(layout.line_rects(hit).select("doc_id", "det", F.col("page_num").cast("int").alias("page_num"), "x0", "y0", "x1", "y1"))
    if mapped is not None:
        sources.append(masks.line_boxes(masks.map_rects(spans, mapped), threshold).select("doc_id", "det", F.col("page_num").cast("int").alias("page_num"), "x0", "y0", "x1", "y1"))
    if not sources:
        raise ValueError("masks need rectangles, characters or a coordinate map")
    return masks.text_rects(*sources)


def run_mask(found: DataFrame, styles: DataFrame, pages: DataFrame, chars: DataFrame | None = None, mapped: DataFrame | None = None) -> DataFrame:
    """The shapes to be masked, one row each with its style, cut to its page, from detections (doc_id, det, seq, entity, word, origin,
    page_num, first, last, selection_mode, mask_rects, mask_circles[, rects_pdf]); pages: doc_id, page_num, width, height."""
    lines = text_lines(found, chars, mapped)
    shaped = found.select("doc_id", "det", "seq", "entity", "page_num", "selection_mode", "mask_rects", "mask_circles")
    plan = masks.mask_plan(shaped, lines, styles)
    return masks.clipped_to_pages(plan, pages)


def marked(found: DataFrame, chars: DataFrame | None = None, mapped: DataFrame | None = None) -> DataFrame:
    """Annotations of detections (doc_id, page_num, entity, word, annotation_type, title, content, x0..y1): shapes made by hand are squares, text lines are highlighted."""
    about = found.select("doc_id", "det", "word", "origin")
    hand = masks.manual_shapes(found.select("doc_id", "det", "seq", "entity", "page_num", "selection_mode", "mask_rects", "mask_circles"))
    text = text_lines(found.join(apart(hand.select("doc_id", "det").distinct()), ["doc_id", "det"], "left_anti"), chars, mapped).join(found.select("doc_id", "det", "entity"), ["doc_id", "det"])
    columns = ["doc_id", "det", "entity", "page_num", "x0", "y0", "x1", "y1"]
    both = hand.select(*columns, F.lit(True).alias("from_shape")).unionByName(text.select(*columns, F.lit(False).alias("from_shape")))
    rows = highlights.export_rows(both.join(about, ["doc_id", "det"]))
    return rows.select("doc_id", F.col("page_num").cast("int").alias("page_num"), "entity", "word", "annotation_type", "title", "content", "x0", "y0", "x1", "y1")


def dispatch(planned: DataFrame, existing: DataFrame, runs: DataFrame, tolerance: float = highlights.TOLERANCE) -> DataFrame:
    """(doc_id, action, annotations afterwards): each document masked by its own method and mode.

    runs: doc_id, method (annotation, highlight, both), mode.  Both methods' existing annotations fall under the mode of the
    first, the second appends.  A document whose method or mode isn't known is copied as it is, with the error beside it.
    planned and existing hold annotation_type and new_ones()'s columns.
    """
    known = F.col("method").isin(*METHODS) & F.col("mode").isin(*highlights.MODES)
    asked = runs.select("doc_id", "method", "mode", F.when(known, "masked").otherwise("copied").alias("action"), F.when(~known, F.concat_ws(" ", F.lit("unknown method or mode:"), "method", "mode")).alias("error"))
    is_highlight = F.col("annotation_type") == "Highlight"
    # The first method of a document clears its own kind unless it appends; text marks come before squares.
    cleared = (F.col("mode") != "append") & F.when(F.col("method") == "annotation", ~is_highlight).otherwise(is_highlight)
    stay = apart(existing).join(asked, "doc_id").filter((F.col("action") == "copied") | ~cleared)
    put = planned.join(asked, "doc_id").filter("action = 'masked'").filter(F.when(F.col("method") == "both", F.lit(True)).when(F.col("method") == "highlight", is_highlight).otherwise(~is_highlight))
    columns = existing.columns
    marks = highlights.new_ones(put.filter(is_highlight), stay.filter(is_highlight), tolerance)
    squares = highlights.new_ones(put.filter(~is_highlight), stay.filter(~is_highlight), tolerance, by_entity=True)
    out = stay.select(columns).withColumn("new", F.lit(False)).unionByName(marks.select(columns).withColumn("new", F.lit(True))).unionByName(squares.select(columns).withColumn("new", F.lit(True)))
    listed = out.groupBy("doc_id").agg(F.collect_list(F.struct("new", *[c for c in columns if c != "doc_id"])).alias("annotations"))
    return asked.join(listed, "doc_id", "left")
