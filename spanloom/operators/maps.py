"""Coordinate maps: characters and spans by place, their wire form, lookups and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.shipping import apart, spread

_PLACE = ("x0", "y0", "x1", "y1")
_KEYS = ("doc_id", "page_num", "block_num")


def listed(chars: DataFrame) -> DataFrame:
    """chars (doc_id, page_num, block_num, offset, x0..y1) with index, their place in the block's list; those without a box are skipped."""
    boxed = chars.filter(" AND ".join(f"{c} IS NOT NULL" for c in _PLACE))
    return boxed.withColumn("index", F.row_number().over(W.partitionBy(*_KEYS).orderBy("offset")) - 1)


def span_map(spans: DataFrame) -> DataFrame:
    """Visible spans (doc_id, page_num, block_num, span_num, text, visible, x0..y1) that aren't blank, numbered by block."""
    kept = spans.filter(F.col("visible") & ~F.col("text").rlike(r"(?U)^\s*$"))
    return kept.withColumn("offset", F.row_number().over(W.partitionBy(*_KEYS).orderBy("span_num")) - 1).drop("visible")


def offset_map(rows: DataFrame) -> DataFrame:
    """(doc_id, offset2coordsMap): page -> block -> boxes in order, of characters or of spans alike."""
    # A document's map is one row: its characters are brought together once, and pages and blocks need no further shuffle.
    boxes = rows.select(*_KEYS, "offset", *_PLACE).repartition("doc_id").groupBy(*_KEYS).agg(F.transform(F.array_sort(F.collect_list(F.struct("offset", F.array(*_PLACE).alias("b")))), lambda x: x["b"]).alias("boxes"))
    pages = boxes.groupBy("doc_id", "page_num").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("block_num").cast("string"), "boxes")))).alias("blocks"))
    return pages.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("page_num").cast("string"), "blocks"))).alias("offset2coordsMap"))


def coords_map(rows: DataFrame) -> DataFrame:
    """(doc_id, box, page_num, block_num, offset): the last character of each box; pages are not told apart."""
    box = F.concat(F.lit("("), F.array_join(F.array(*[F.col(c).cast("string") for c in _PLACE]), ","), F.lit(")"))
    last = F.max(F.struct("page_num", "block_num", "offset")).alias("at")
    return rows.groupBy("doc_id", box.alias("box")).agg(last).select("doc_id", "box", "at.*")


def mapped(wire: DataFrame) -> DataFrame:
    """A wire map (doc_id, offset2coordsMap) as rows doc_id, page_num, block_num, offset, x0..y1; keys that are no numbers are skipped."""
    pages = wire.select("doc_id", F.explode("offset2coordsMap").alias("page", "blocks"))
    rows = pages.select("doc_id", "page", F.explode("blocks").alias("block", "boxes")).select("doc_id", F.col("page").try_cast("int").alias("page_num"), F.col("block").try_cast("int").alias("block_num"), F.posexplode("boxes").alias("offset", "b"))
    return rows.filter("page_num IS NOT NULL AND block_num IS NOT NULL AND size(b) >= 4").select(*_KEYS, "offset", *[F.col("b")[i].alias(c) for i, c in enumerate(_PLACE)])


def required(wire: DataFrame) -> DataFrame:
    """wire, whose rows must have a map: an empty one fails the job."""
    empty = F.coalesce(F.size("offset2coordsMap"), F.lit(0)) < 1
    return wire.withColumn("offset2coordsMap", F.when(empty, F.raise_error(F.concat(F.lit("no coordinate map: "), F.col("doc_id").cast("string")))).otherwise(F.col("offset2coordsMap")))


def preferred(new: DataFrame, embedded: DataFrame) -> DataFrame:
    """The embedded map of each document, else the new one."""
    return embedded.unionByName(new.join(embedded, "doc_id", "left_anti"))


def char_details(spans: DataFrame, chars: DataFrame) -> DataFrame:
    """(doc_id, det, goffset, ch, x0..y1): every offset of each span; one without a character is ``?`` without a place."""
    each = spans.select("doc_id", "det", F.explode(F.filter(F.sequence("start", F.col("end")), lambda i: i < F.col("end"))).alias("goffset"))
    return each.join(apart(chars.select("doc_id", "goffset", "ch", *_PLACE)), ["doc_id", "goffset"], "left").withColumn("ch", F.coalesce("ch", F.lit("?")))


def find_text(spans: DataFrame, part: str, page: int | None = None) -> DataFrame:
    return spans.filter(F.col("text").contains(part) & (F.lit(True) if page is None else F.col("page_num") == page))


def near_points(points: DataFrame, spans: DataFrame, tolerance: float = 5.0, cell: float = 50.0) -> DataFrame:
    """(pid, idx): spans whose box, widened by tolerance, holds the point; looked up through grid cells of one document's page."""
    wide = spans.select("doc_id", "page_num", "idx", *[(F.col(c) + (tolerance if c[1] == "1" else -tolerance)).alias(c) for c in _PLACE])
    cells = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / cell), F.floor(F.col(b) / cell)))
    wide = spread(wide.withColumn("gx", cells("x0", "x1")).withColumn("gy", cells("y0", "y1")), "doc_id", "page_num", "gx", "gy")
    p = points.withColumn("gx", F.floor(F.col("x") / cell)).withColumn("gy", F.floor(F.col("y") / cell))
    return spread(p, "doc_id", "page_num", "gx", "gy").join(apart(wide), ["doc_id", "page_num", "gx", "gy"]).filter("x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1").select("pid", "idx")


def statistics(rows: DataFrame) -> DataFrame:
    """(doc_id, page_num, blocks, mappings) of a map."""
    return rows.groupBy("doc_id", "page_num").agg(F.countDistinct("block_num").alias("blocks"), F.count("*").alias("mappings"))
