"""Mask plans: detections become rectangles and circles with a style, one row a shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.functions import geometry as G
from spanloom.functions import values as V
from spanloom.operators import layout
from spanloom.shipping import apart

# Colours of marks by entity, their opacity, and the opacity of masks that name none.
MARK_STYLES = {
    "PERSON": (1.0, 0.78, 0.78), "LOCATION": (0.78, 1.0, 0.78), "PHONE_NUMBER": (0.78, 0.78, 1.0), "DATE_TIME": (1.0, 1.0, 0.78),
    "INDIVIDUAL_NUMBER": (1.0, 0.78, 1.0), "YEAR": (0.78, 1.0, 1.0), "PROPER_NOUN": (1.0, 0.86, 0.70), "OTHER": (0.78, 0.78, 0.78),
}
MARK_ALPHA, MASK_ALPHA = 0.35, 0.4
_PLACE = ("x0", "y0", "x1", "y1")


def parse_mask_specs(specs: list[str]) -> list[tuple[str, str, float | None]]:
    """(entity, colour, opacity or None) of ENTITY=colour[@opacity] options; a malformed one is an error."""
    out = []
    for spec in specs:
        name, sep, value = spec.partition("=")
        entity = V.normal_entity(name)
        if not sep or not entity:
            raise ValueError(f"a mask is ENTITY=colour[@opacity], not {spec!r}")
        colour, at, alpha = value.partition("@")
        try:
            out.append((entity, colour.strip(), min(1.0, max(0.0, float(alpha))) if at else None))
        except ValueError as e:
            raise ValueError(f"bad opacity in {spec!r}") from e
    return out


def mask_styles(spark: SparkSession, specs: list[str]) -> DataFrame:
    """(entity, r, g, b, alpha): the colour's own opacity before the option's before the default; of repeated entities the last."""
    listed = {e: (e, c, a) for e, c, a in parse_mask_specs(specs)}
    rows = spark.createDataFrame(list(listed.values()), "entity string, colour string, alpha double").withColumn("c", V.colour(F.col("colour")))
    return rows.select("entity", "c.r", "c.g", "c.b", F.coalesce("c.alpha", "alpha", F.lit(MASK_ALPHA)).alias("alpha"))


def mark_style(entity: Column) -> Column:
    """(r, g, b, alpha) of an entity's mark; unknown entities as OTHER."""
    make = lambda rgb: F.struct(*(F.lit(x).alias(n) for x, n in zip((*rgb, MARK_ALPHA), ("r", "g", "b", "alpha"))))
    out = make(MARK_STYLES["OTHER"])
    for name, rgb in MARK_STYLES.items():
        out = F.when(entity == name, make(rgb)).otherwise(out)
    return out


def styled(shapes: DataFrame, styles: DataFrame) -> DataFrame:
    """shapes with r, g, b, alpha in 0..1: what styles (one row an entity, a configuration) give, else the entity's mark."""
    own = styles.select(F.col("entity").alias("e"), *[F.col(c).alias(f"s_{c}") for c in ("r", "g", "b", "alpha")])
    rows = shapes.join(F.broadcast(own), F.col("entity") == F.col("e"), "left").withColumn("m", mark_style(F.col("entity")))
    clamp = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))
    return rows.withColumns({c: clamp(F.coalesce(f"s_{c}", f"m.{c}")) for c in ("r", "g", "b", "alpha")}).drop("e", "m", "s_r", "s_g", "s_b", "s_alpha")


def manual_shapes(found: DataFrame) -> DataFrame:
    """(doc_id, det, seq, entity, page_num, shape, x0, y0, x1, y1, radius) of mask_rects and mask_circles.

    found: doc_id, det, seq, entity, page_num, selection_mode, mask_rects and mask_circles, arrays whose elements may name
    a page of their own.  Shapes without extent are left out.  A circle's rectangle is its box; the rectangle that was
    saved beside a dragged circle is left out.
    """
    ids = ["doc_id", "det", "seq", "entity"]
    c = found.select(*ids, "page_num", F.explode("mask_circles").alias("c")).filter("c.radius > 0 AND c.center_x IS NOT NULL AND c.center_y IS NOT NULL")
    box = [(F.col(f"c.center_{n[0]}") + (F.col("c.radius") if n[1] == "1" else -F.col("c.radius"))).alias(n) for n in _PLACE]
    circles = c.select(*ids, F.coalesce("c.page_num", "page_num").alias("page_num"), F.lit("circle").alias("shape"), *box, F.col("c.radius").alias("radius"))
    good = F.exists(F.coalesce("mask_circles", F.array().cast(found.schema["mask_circles"].dataType)), lambda x: (x["radius"] > 0) & x["center_x"].isNotNull() & x["center_y"].isNotNull())
    r = found.filter(~((F.lower(F.coalesce("selection_mode", F.lit(""))) == "circle_drag") & good)).select(*ids, "page_num", F.explode("mask_rects").alias("r"))
    rects = r.filter("r.x1 > r.x0 AND r.y1 > r.y0").select(*ids, F.coalesce("r.page_num", "page_num").alias("page_num"), F.lit("rect").alias("shape"), *[f"r.{n}" for n in _PLACE], F.lit(None).cast("double").alias("radius"))
    return circles.unionByName(rects)


def distinct_shapes(shapes: DataFrame, digits: int = 3, by_entity: bool = True) -> DataFrame:
    """The first (by seq) of shapes that are equal after rounding, on one page of one document."""
    keys = ["doc_id", "page_num", "shape", *(["entity"] if by_entity else []), *[F.round(c, digits) for c in (*_PLACE, "radius")]]
    return shapes.withColumn("rn", F.row_number().over(W.partitionBy(*keys).orderBy("seq"))).filter("rn = 1").drop("rn")


def mask_plan(found: DataFrame, lines: DataFrame, styles: DataFrame) -> DataFrame:
    """One row a shape to be masked: doc_id, entity, page_num, shape, x0, y0, x1, y1, radius, r, g, b, alpha.

    Manual shapes come first; lines (doc_id, det, page_num, x0, y0, x1, y1: the text rectangles of detections) follow for
    detections without manual shapes, unless a manual shape on their page meets them.
    """
    by_hand = manual_shapes(found)
    plain = found.filter(~(F.coalesce(F.size("mask_rects"), F.lit(0)) > 0) & ~(F.coalesce(F.size("mask_circles"), F.lit(0)) > 0)).select("doc_id", "det", "seq", "entity")
    text = layout.uncovered(lines.filter("x1 > x0 AND y1 > y0").join(plain, ["doc_id", "det"]), by_hand)
    text = text.select("doc_id", "det", "seq", "entity", "page_num", F.lit("rect").alias("shape"), *_PLACE, F.lit(None).cast("double").alias("radius"))
    return styled(distinct_shapes(by_hand.unionByName(text)), styles).drop("det", "seq")


def text_rects(*sources: DataFrame) -> DataFrame:
    """Rectangles (doc_id, det, ...) of each detection from the first source that has any for it."""
    out = sources[0]
    for more in sources[1:]:
        out = out.unionByName(more.join(apart(out.select("doc_id", "det").distinct()), ["doc_id", "det"], "left_anti"))
    return out


def map_rects(found: DataFrame, mapped: DataFrame) -> DataFrame:
    """(doc_id, det, page_num, block_num, offset, x0, y0, x1, y1): the mapped characters of spans that may cross blocks and pages.

    found: doc_id, det, start and end positions (page_num, block_num, offset), the end included.
    """
    at = F.struct("page_num", "block_num", "offset")
    place = lambda c: F.struct(*(F.col(f"{c}.{n}").cast(mapped.schema[n].dataType).alias(n) for n in ("page_num", "block_num", "offset")))
    # A span meets the pages that it crosses, not its whole document.
    spans = found.select("doc_id", "det", place("start").alias("first"), place("end").alias("last")).filter("first.page_num <= last.page_num")
    each = spans.withColumn("page_num", F.explode(F.sequence("first.page_num", "last.page_num")))
    rows = each.join(apart(mapped.select("doc_id", "page_num", "block_num", "offset", *_PLACE)), ["doc_id", "page_num"])
    return rows.filter((at >= F.col("first")) & (at <= F.col("last"))).select("doc_id", "det", "page_num", "block_num", "offset", *_PLACE)


def line_boxes(chars: DataFrame, threshold: float | None = 2.0) -> DataFrame:
    """(doc_id, det, page_num, x0, y0, x1, y1): a span's characters joined to lines, page by page."""
    per = chars.groupBy("doc_id", "det", "page_num").agg(F.collect_list(F.struct(*_PLACE)).alias("r"))
    return per.select("doc_id", "det", "page_num", F.explode(layout.grouped_lines(F.col("r"), threshold)).alias("b")).select("doc_id", "det", "page_num", "b.*")


def page_quads(lines: DataFrame) -> DataFrame:
    """(doc_id, det, page_num, n_quads, quads): one highlight a page, with a quad for each of its lines."""
    quad = F.array("x0", "y0", "x1", "y0", "x0", "y1", "x1", "y1")
    return lines.groupBy("doc_id", "det", "page_num").agg(F.count("*").alias("n_quads"), F.array_sort(F.collect_list(quad)).alias("quads"))


def clipped_to_pages(shapes: DataFrame, pages: DataFrame) -> DataFrame:
    """Shapes cut to their page (doc_id, page_num, width, height); what lies outside goes."""
    rows = shapes.join(pages, ["doc_id", "page_num"]).withColumn("part_", G.clipped(G.rect(*_PLACE), G.rect(F.lit(0.0), F.lit(0.0), F.col("width"), F.col("height"))))
    return rows.filter("part_ IS NOT NULL").withColumns({n: F.col(f"part_.{n}") for n in _PLACE}).drop("part_", "width", "height")
