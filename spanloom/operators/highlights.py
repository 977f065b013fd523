"""Annotations and highlights: reading them as detections, planning new ones beside those that exist."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions import geometry as G
from spanloom.functions import values as V
from spanloom.shipping import apart, saved

_PLACE = ("x0", "y0", "x1", "y1")
#: How far a corner may lie from that of an annotation that exists already, in points.
TOLERANCE = 0.1
MODES = ("clear_all", "append", "reset_and_append")


def quads(vertices: Column, rect: Column) -> Column:
    """Arrays of eight numbers from the vertices (x, y, x, y, ...), or the rectangle as one quad where they make none."""
    n = F.floor(F.coalesce(F.size(vertices), F.lit(0)) / 8).cast("int")
    many = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(vertices, i * 8 + 1, F.lit(8)))
    corners = [("x0", "y0"), ("x1", "y0"), ("x0", "y1"), ("x1", "y1")]
    return F.when(n > 0, many).otherwise(F.array(F.array(*[rect[c] for pair in corners for c in pair])))


def annotations(raw: DataFrame) -> DataFrame:
    """Every annotation as a record: raw's doc_id, annotation_type, page_num, title, content, opacity, vertices and rect.

    Adds page_number (from 1), quads, detect_word and entity_type (of the content, null where absent); opacity is 1 where
    it isn't given.
    """
    parsed = V.parsed_content(F.coalesce("content", F.lit("")))
    rows = raw.withColumn("p", parsed).withColumn("page_number", F.col("page_num") + 1).withColumn("quads", quads(F.col("vertices"), F.col("rect")))
    return rows.withColumns({"detect_word": F.col("p.detect_word"), "entity_type": F.col("p.entity_type"), "opacity": F.coalesce("opacity", F.lit(1.0))}).drop("p", "vertices")


def covered_text(marks: DataFrame, words: DataFrame, wider: float = 5.0) -> DataFrame:
    """(doc_id, mark, covered_text): the words under each mark (doc_id, mark, page_num, rect), in their order, with blanks between.

    words: doc_id, page_num, seq, text, x0, y0, x1, y1.  A word is covered if it shares an area with the rectangle; only marks
    that cover none are looked up again, with rectangles wider by so many points on every side.  Places meet in grid cells.
    """
    w = words.select("doc_id", "page_num", "seq", "text", G.rect(*_PLACE).alias("w")).withColumn("g", F.explode(G.grid_cells(F.col("w")))).select("doc_id", "page_num", "seq", "text", "w", "g.gx", "g.gy")

    def under(rows: DataFrame) -> DataFrame:
        cells = rows.withColumn("g", F.explode(G.grid_cells(F.col("rect")))).select("doc_id", "mark", "page_num", "rect", "g.gx", "g.gy")
        hit = cells.join(apart(w), ["doc_id", "page_num", "gx", "gy"]).filter(G.intersects(F.col("rect"), F.col("w"))).select("doc_id", "mark", "seq", "text").distinct()
        listed = F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"])
        return hit.groupBy("doc_id", "mark").agg(F.array_join(listed, " ").alias("covered_text"))

    given = marks.select("doc_id", "mark", "page_num", F.col("rect").cast("struct<x0:double,y0:double,x1:double,y1:double>").alias("rect"))
    first = under(given)
    grown = G.rect(*[F.col(f"rect.{c}") + (wider if c[1] == "1" else -wider) for c in _PLACE])
    again = under(given.join(first, ["doc_id", "mark"], "left_anti").withColumn("rect", grown))
    return marks.select("doc_id", "mark").join(first.unionByName(again), ["doc_id", "mark"], "left").withColumn("covered_text", F.coalesce("covered_text", F.lit("")))


def mark_colours(stroke: Column, fill: Column) -> Column:
    """(stroke_color, fill_color), each (rgb, hex) of a list of channels in 0..1; null where there is none, black where channels are missing."""
    one = lambda c: F.when(F.size(c) > 0, F.struct(c.alias("rgb"), F.when(F.size(c) >= 3, G.hex_colour(F.get(c, F.lit(0)), F.get(c, F.lit(1)), F.get(c, F.lit(2)))).otherwise("#000000").alias("hex")))
    return F.struct(one(stroke).alias("stroke_color"), one(fill).alias("fill_color"))


def highlights(records: DataFrame) -> DataFrame:
    return records.filter("annotation_type = 'Highlight'")


def to_detections(marks: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, seq, entity, word, origin, start, end): each highlight at the first place of its word that no earlier one took.

    marks: doc_id, seq, title, content, detect_word, entity_type; docs: doc_id, flat text.  Unknown entities, empty words
    and words that the text doesn't hold are dropped; a title that is no origin counts as manual.  A highlight whose
    content names neither has its entity in the title and its word in the content.  One document's highlights meet in one
    task, since each depends on those before it.
    """
    named = F.col("detect_word").isNotNull() & F.col("entity_type").isNotNull()
    title = F.lower(F.trim(F.coalesce("title", F.lit(""))))
    rows = marks.select(
        "doc_id", "seq", F.when(named, F.col("entity_type")).otherwise(F.col("title")).alias("entity"), F.when(named, F.col("detect_word")).otherwise(F.col("content")).alias("word"),
        F.when(title.isin("auto", "manual", "custom"), title).otherwise("manual").alias("origin"),
    ).filter(F.col("entity").isin(*V.ENTITIES) & (F.length("word") > 0))
    kind = marks.schema["doc_id"].dataType.simpleString()

    def place(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out, used = [], set()
        text = right["text"].iloc[0] if len(right) else ""
        for row in left.sort_values("seq").itertuples(index=False) if len(left) else ():
            at = text.find(row.word)
            while at in used:
                at = text.find(row.word, at + 1)
            if at >= 0:
                used.add(at)
                out.append((row.doc_id, row.seq, row.entity, row.word, row.origin, at, at + len(row.word)))
        return pd.DataFrame(out, columns=["doc_id", "seq", "entity", "word", "origin", "start", "end"])

    # Only documents with highlights are given to Python; what they are is written, as it is asked for twice.
    rows = saved(rows)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(apart(rows.select("doc_id").distinct()), "doc_id", "left_semi")
    return rows.groupBy("doc_id").cogroup(texts.groupBy("doc_id")).applyInPandas(place, f"doc_id {kind}, seq bigint, entity string, word string, origin string, start bigint, end bigint")


def new_ones(planned: DataFrame, existing: DataFrame, tolerance: float = TOLERANCE, by_entity: bool = False) -> DataFrame:
    """Planned rectangles (doc_id, page_num, entity, word, x0..y1) without those that exist: same word, all corners within tolerance."""
    # First corners meet in cells, an existing one in all cells that the tolerance reaches; equal ones are looked at once.
    cell = max(1.0, 10 * tolerance)
    at = lambda c, by=0.0: F.floor((F.col(c) + by) / cell)
    e = existing.select(*[F.col(c).alias(f"e_{c}") for c in ("doc_id", "page_num", *(["entity"] if by_entity else []), "word", *_PLACE)]).distinct()
    for c in ("x0", "y0"):
        e = e.withColumn(f"cell_{c}", F.explode(F.sequence(at(f"e_{c}", -2 * tolerance), at(f"e_{c}", 2 * tolerance))))
    on = (F.col("doc_id") == F.col("e_doc_id")) & (F.col("page_num") == F.col("e_page_num")) & F.expr("coalesce(word, '') = coalesce(e_word, '')")
    on = on & (at("x0") == F.col("cell_x0")) & (at("y0") == F.col("cell_y0"))
    if by_entity:
        on = on & F.expr("coalesce(entity, '') = coalesce(e_entity, '')")
    for c in _PLACE:
        on = on & (F.abs(F.col(c) - F.col(f"e_{c}")) <= tolerance)
    return planned.join(apart(e), on, "left_anti")


def applied(planned: DataFrame, existing: DataFrame, mode: str = "append", highlight: bool = True, identical: bool = False) -> DataFrame:
    """Annotations afterwards: existing ones of the kind stay in append only, of the other kind always; then the planned ones.

    Both hold annotation_type and the columns of new_ones(); unless identical, planned ones that still exist are left out.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}; known: {', '.join(MODES)}")
    kind = F.col("annotation_type") == "Highlight"
    mine = kind if highlight else ~kind
    stay = existing if mode == "append" else existing.filter(~mine)
    return stay.unionByName(planned if identical else new_ones(planned, stay.filter(mine), by_entity=not highlight))


def export_rows(shapes: DataFrame) -> DataFrame:
    """Mask shapes and text lines as annotations: shapes are squares, text is highlighted."""
    content = F.concat(F.lit("origin="), "origin", F.lit(", entity="), "entity", F.lit(", word="), F.coalesce("word", F.lit("")))
    return shapes.withColumns({"annotation_type": F.when(F.col("from_shape"), "Square").otherwise("Highlight"), "title": F.col("origin"), "content": content})


def restored(report: DataFrame) -> DataFrame:
    """Rows of a report that can be made again: a known kind, a page, and a rectangle or a quad with extent."""
    box = F.coalesce(G.proper_rect(G.quad_bounds(F.get("quads", F.lit(0)))), G.proper_rect(F.col("rect")))
    return report.withColumn("box", box).filter("annotation_type IN ('Highlight', 'Square', 'FreeText') AND page_number >= 1 AND box IS NOT NULL")
