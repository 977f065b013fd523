"""Results of text recognition: parsing what engines return, plans to write them, removal, comparison with ground truth.

The engine itself is an adapter: a function from an image and its page to JSON, run by the caller's ``mapInPandas``.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.functions import geometry as G
from spanloom.operators.detect import let
from spanloom.shipping import apart, ship, spread

# Keys under which engines put their items, boxes and scores, and the marks of written text.
CONTAINERS = ("results", "result", "lines", "ocr_results", "items", "data")
BOXES = ("bbox", "box", "bounds", "points", "polygon", "boundingBox")
SCORES = ("confidence", "score", "prob")
TITLE, SUBJECT, SOURCE = "ocr", "ocr_text", "ocr"
_PLACE = ("x0", "y0", "x1", "y1")


def recognised(pages: DataFrame, engine: Callable[..., str]) -> DataFrame:
    """(doc_id, page_num, raw) of pages (doc_id, page_num, image): the engine runs in Arrow batches; a page that fails has raw null and error.

    Where pages have covered, rectangles in pixels (x0, y0, x1, y1) that the engine is to paint over first, it is given them too.
    """
    ship(pages.sparkSession)
    kind = pages.schema["doc_id"].dataType.simpleString()
    more = ["covered"] if "covered" in pages.columns else []

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for doc, page, image, *covered in zip(*(frame[c] for c in ("doc_id", "page_num", "image", *more))):
                try:
                    out.append((doc, page, engine(image, page, *([tuple(r.values()) for r in x] for x in covered)), None))
                except Exception as e:  # noqa: BLE001 - a page's failure is a row, not the job's
                    out.append((doc, page, None, str(e)))
            yield pd.DataFrame(out, columns=["doc_id", "page_num", "raw", "error"])

    return pages.select("doc_id", "page_num", "image", *more).mapInPandas(run, f"doc_id {kind}, page_num int, raw string, error string")


def _objects(json: Column) -> Column:
    """A JSON list's elements as JSON."""
    return F.from_json(json, "array<string>")


def result_items(raw: Column) -> Column:
    """The items of a result: the result itself if a list, else the first list under a known key, else a lone item with text and box."""
    starts = lambda x: F.when(x.startswith("["), x)
    lists = [let(F.get_json_object(raw, f"$.{k}"), starts) for k in CONTAINERS]
    lone = F.get_json_object(raw, "$.text").isNotNull() & F.coalesce(F.get_json_object(raw, "$.bbox"), F.get_json_object(raw, "$.box")).isNotNull()
    inside = F.when(F.ltrim(raw).startswith("["), raw).otherwise(F.coalesce(*lists))
    return let(inside, lambda x: F.when(x.isNotNull(), _objects(x)).when(lone, F.array(raw)).otherwise(F.array().cast("array<string>")))


def box(json: Column) -> Column:
    """A rectangle from x, y, width, height; left, top, right, bottom; a list of points, of 8 or more numbers, or of 4; null without extent.

    Whatever is used more than once is bound by let(): written out, each use would read the JSON again.
    """

    def parts(json: Column, *keys: str) -> Column:
        return F.array(*[F.get_json_object(json, f"$.{k}") for k in keys])

    known = lambda p: ~F.exists(p, lambda x: x.isNull())
    side = lambda p, i: p[i].try_cast("double")

    def of_object(json: Column) -> Column:
        sized = lambda p: G.rect(side(p, 0), side(p, 1), side(p, 0) + side(p, 2), side(p, 1) + side(p, 3))
        sided = lambda p: F.when(known(p), G.rect(*[side(p, i) for i in range(4)]))
        # Keys that are there decide, not what can be made of their values.
        return let(parts(json, "x", "y", "width", "height"), lambda p: F.when(known(p), sized(p)).otherwise(let(parts(json, "left", "top", "right", "bottom"), sided)))

    def of_points(points: Column) -> Column:
        along = [F.transform(points, lambda p: F.get(p, F.lit(0))), F.transform(points, lambda p: F.get(p, F.lit(1)))]
        return G.rect(*[F.array_min(a) for a in along], *[F.array_max(a) for a in along])

    def of_numbers(numbers: Column) -> Column:
        whole = lambda n: (F.size(numbers) >= n) & known(F.slice(numbers, 1, n))
        eight = F.slice(numbers, 1, 8)
        xs, ys = F.filter(eight, lambda _, i: i % 2 == 0), F.filter(eight, lambda _, i: i % 2 == 1)
        poly = G.rect(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))
        return F.when(whole(8), poly).when((F.size(numbers) < 8) & whole(4), G.rect(*[F.get(numbers, F.lit(i)) for i in range(4)]))

    def found(json: Column) -> Column:
        text = F.ltrim(json)
        numbers = F.transform(_objects(json), lambda x: x.try_cast("double"))
        listed = F.when(text.rlike(r"^\[\s*\["), let(F.from_json(json, "array<array<double>>"), of_points)).when(text.startswith("["), let(numbers, of_numbers))
        return F.when(text.startswith("{"), of_object(json)).otherwise(listed)

    return let(let(json, found), G.proper_rect)


def items(results: DataFrame) -> DataFrame:
    """(doc_id, page_num, item_num, text, x, y, width, height, confidence) of results (doc_id, page_num, raw); items without a box are left out."""
    rows = results.select("doc_id", "page_num", F.posexplode(result_items(F.col("raw"))).alias("item_num", "item"))
    get = lambda path: F.get_json_object("item", path)
    is_list = F.ltrim("item").startswith("[")
    raw_box = F.when(is_list, get("$[1]")).otherwise(F.coalesce(*[get(f"$.{k}") for k in BOXES]))
    score = F.when(is_list, get("$[2]")).otherwise(F.coalesce(*[get(f"$.{k}") for k in SCORES]))
    # Exploded out of an array of one or none, the box is computed once an item, whatever is made of its sides or asked of it afterwards.
    rows = rows.withColumn("r", F.explode(F.filter(F.array(box(raw_box)), lambda r: r.isNotNull())))
    text = F.regexp_replace(F.coalesce(F.when(is_list, get("$[0]")).otherwise(get("$.text")), F.lit("")), r"(?U)^\s+|\s+$", "")
    return rows.select("doc_id", "page_num", "item_num", text.alias("text"), F.col("r.x0").alias("x"), F.col("r.y0").alias("y"), F.expr("r.x1 - r.x0").alias("width"), F.expr("r.y1 - r.y0").alias("height"), F.coalesce(score.try_cast("double"), F.lit(0.0)).alias("confidence"))


def to_points(rows: DataFrame, dpi: float = 300.0, offset_x: float = 0.0, offset_y: float = 0.0) -> DataFrame:
    """Pixel items as points on the page."""
    scale = 72.0 / dpi
    return rows.withColumns({"x": F.col("x") * scale + offset_x, "y": F.col("y") * scale + offset_y, "width": F.col("width") * scale, "height": F.col("height") * scale})


def blanked(rects: DataFrame, dpi: float = 300.0) -> DataFrame:
    """Rectangles of text that a page holds already, in pixels: what is painted over before recognition."""
    return rects.withColumns({c: F.col(c) * (dpi / 72.0) for c in _PLACE})


def rgb(colour: Column) -> Column:
    """Three channels in 0..1; if any exceeds 1, all count as 0..255."""
    scale = F.when(F.array_max(colour) > 1, 255.0).otherwise(1.0)
    return F.transform(F.slice(colour, 1, 3), lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c / scale)))


def write_plan(rows: DataFrame, pages: DataFrame, font_color: tuple = (0, 0, 0), opacity: float = 0.0, auto_color: bool = False, unit_width: float = 0.5) -> DataFrame:
    """Texts to be written: clipped to their page (doc_id, page_num, width, height), blank ones out, with colour, opacity, font size.

    auto_color takes an item's own text_color and text_opacity (1 where it has none).  unit_width: a character's mean width
    at size 1, which a font would tell.
    """
    p = pages.select("doc_id", "page_num", F.col("width").alias("pw"), F.col("height").alias("ph"))
    r = G.clipped(G.rect(F.col("x"), F.col("y"), F.expr("x + width"), F.expr("y + height")), G.rect(F.lit(0.0), F.lit(0.0), F.col("pw"), F.col("ph")))
    out = rows.filter(~F.col("text").rlike(r"(?U)^\s*$")).join(p, ["doc_id", "page_num"]).withColumn("r", F.explode(F.array(r))).filter("r IS NOT NULL")
    base, alpha = rgb(F.array(*[F.lit(float(c)) for c in font_color])), F.lit(float(min(1.0, max(0.0, opacity))))
    if auto_color:
        own = F.col("text_color").isNotNull()
        base, alpha = F.when(own, rgb(F.col("text_color"))).otherwise(base), F.when(own, F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("text_opacity", F.lit(1.0))))).otherwise(alpha)
    size = G.fitting_font_size(F.expr("r.x1 - r.x0"), F.expr("r.y1 - r.y0"), F.length("text") * unit_width)
    return out.select("doc_id", "page_num", "item_num", "text", "r.*", base.alias("color"), alpha.alias("opacity"), size.alias("font_size"), F.lit(TITLE).alias("title"), F.lit(SUBJECT).alias("subject"))


def without_written(records: DataFrame, pages: list[int] | None = None) -> DataFrame:
    """Annotations without the text that write_plan wrote: free text with its subject, title or source mark, on the pages."""
    marked = (F.col("subject") == SUBJECT) | (F.col("title") == TITLE) | F.col("content").contains(f"source={SOURCE}")
    gone = F.coalesce(marked, F.lit(False)) & (F.lower("annotation_type") == "freetext")
    return records.filter(~(gone if pages is None else gone & F.col("page_num").isin(*pages)))


def normal_text(text: Column) -> Column:
    """NFKC without white space: Spark has no normal forms."""

    @F.pandas_udf("string")
    def normal(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: "".join(unicodedata.normalize("NFKC", t or "").split()))

    return normal(text)


def pairs(truth: DataFrame, read: DataFrame) -> DataFrame:
    """(doc_id, page_num, gt, ocr, dx, dy): each read item with the first free truth on its page whose text holds it or lies in it.

    Both: doc_id, page_num, seq, text, x, y.  Read items choose in order, so one page's items meet in one task, which goes
    through its pages one after another and holds no more than one.
    """
    ship(truth.sparkSession)
    kind = truth.schema["doc_id"].dataType.simpleString()
    columns = ["doc_id", "page_num", "gt", "ocr", "dx", "dy"]

    def match(page: tuple, free: list, read: list) -> list[tuple]:
        out = []
        for seq, x, y, norm in read:
            at = next((k for k, g in enumerate(free) if norm and (norm in g[3] or g[3] in norm)), None)
            if at is not None:
                hit = free.pop(at)
                out.append((*page, hit[0], seq, None if x is None or hit[1] is None else x - hit[1], None if y is None or hit[2] is None else y - hit[2]))
        return out

    def table(out: list[tuple], doc_kind: pa.DataType) -> pa.RecordBatch:
        kinds = (doc_kind, pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out) if out else [[]] * 6, kinds)], columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page, sides, doc_kind = None, ([], []), None
        for batch in batches:
            doc_kind, out = batch.schema.field("doc_id").type, []
            for doc, number, side, *item in zip(*(c.to_pylist() for c in batch.columns)):
                if (doc, number) != page:
                    out += match(page, *sides) if page else []
                    page, sides = (doc, number), ([], [])
                sides[side].append(item)
            yield table(out, doc_kind)
        if page:
            yield table(match(page, *sides), doc_kind)

    def side(rows: DataFrame, n: int) -> DataFrame:
        return rows.select("doc_id", F.col("page_num").cast("int").alias("page_num"), F.lit(n).alias("side"), F.col("seq").cast("long").alias("seq"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), normal_text(F.col("text")).alias("norm"))

    rows = spread(side(truth, 0).unionByName(side(read, 1)), "doc_id", "page_num").sortWithinPartitions("doc_id", "page_num", "side", "seq")
    return rows.mapInArrow(run, f"doc_id {kind}, page_num int, gt bigint, ocr bigint, dx double, dy double")


def text_colour(pixels: np.ndarray) -> tuple[int, int, int]:
    """Text colour of an image part (rows, columns, 3): the median of pixels that differ from the border's median; black if few do."""
    if not pixels.size:
        return (0, 0, 0)
    upper = lambda a: np.sort(a, axis=0)[len(a) // 2]
    flat = pixels.reshape(-1, 3).astype(int)
    border = np.concatenate([pixels[0], pixels[-1], pixels[1:-1, 0], pixels[1:-1, -1]]).astype(int)
    front = flat[((flat - upper(border)) ** 2).sum(axis=1) > 50 * 50]
    return tuple(int(c) for c in upper(front)) if len(front) >= max(1, len(flat) // 20) else (0, 0, 0)


def text_colours(images: DataFrame, boxes: DataFrame) -> DataFrame:
    """(doc_id, page_num, box, r, g, b): text_colour() of boxes (x, y, width, height in pixels) of page images, without an image in any one task's hands.

    images: doc_id, page_num, width, height, pixels, three bytes a pixel row by row.  Boxes are cut to the image; one without
    pixels is black.  A box meets the image's lines, its pixels are counted by colour before any shuffle of pixels, and
    medians come from the counts of 256 values a channel.
    """
    keys = ["doc_id", "page_num", "box"]
    edge = lambda c, most: F.least(F.greatest(F.col(c).cast("int"), F.lit(0)), F.col(most))
    size = images.select("doc_id", "page_num", F.col("width").alias("iw"), F.col("height").alias("ih"))
    cut = boxes.withColumn("right", F.col("x") + F.col("width")).withColumn("below", F.col("y") + F.col("height")).join(size, ["doc_id", "page_num"])
    cut = cut.select(*keys, edge("x", "iw").alias("x0"), edge("y", "ih").alias("y0"), edge("right", "iw").alias("x1"), edge("below", "ih").alias("y1")).filter("x1 > x0 AND y1 > y0")
    lines = images.select("doc_id", "page_num", F.explode(F.transform(F.sequence(F.lit(0), F.col("height") - 1), lambda y: F.struct(y.alias("y"), F.substring(F.col("pixels"), (y * F.col("width") * 3 + 1).cast("int"), F.col("width") * 3).alias("line")))).alias("l")).select("doc_id", "page_num", "l.y", "l.line")
    rows = cut.withColumn("y", F.explode(F.sequence("y0", F.col("y1") - 1))).join(apart(lines), ["doc_id", "page_num", "y"])
    part = rows.withColumn("line", F.hex(F.substring("line", F.col("x0") * 3 + 1, (F.col("x1") - F.col("x0")) * 3)))
    ends = F.when(F.col("y") == F.col("y0"), 1).otherwise(0) + F.when(F.col("y") == F.col("y1") - 1, 1).otherwise(0)
    # A pixel counts for the border once for each edge line that holds it; inner lines have their two ends.
    sides = lambda i: F.when(F.col("ends") > 0, F.col("ends")).otherwise(F.when(i == 0, 1).otherwise(0) + F.when(i == F.col("x1") - F.col("x0") - 1, 1).otherwise(0))
    one = lambda i: F.struct(F.substring(F.col("line"), i * 6 + 1, F.lit(6)).alias("c"), sides(i).alias("border"))
    pixels = part.withColumn("ends", ends).select(*keys, F.explode(F.transform(F.sequence(F.lit(0), F.col("x1") - F.col("x0") - 1), one)).alias("p"))
    counts = pixels.groupBy(*keys, F.col("p.c").alias("c")).agg(F.count("*").alias("n"), F.sum("p.border").alias("border"))
    value = lambda k: F.conv(F.substring("c", 2 * k + 1, 2), 16, 10).cast("int")
    counts = counts.select(*keys, "n", "border", *[value(k).alias(x) for k, x in enumerate("rgb")])

    def medians(rows: DataFrame, weight: str, names: str) -> DataFrame:
        """The upper median of each channel by weight."""
        each = rows.filter(F.col(weight) > 0).select(*keys, F.col(weight).alias("w"), F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(x).alias("v")) for k, x in enumerate("rgb")])).alias("e"))
        bins = each.groupBy(*keys, "e.k", "e.v").agg(F.sum("w").alias("w"))
        order = W.partitionBy(*keys, "k").orderBy("v")
        upto = bins.withColumn("upto", F.sum("w").over(order)).withColumn("all", F.sum("w").over(W.partitionBy(*keys, "k")))
        first = upto.filter("upto > floor(all / 2)").groupBy(*keys, "k").agg(F.min("v").alias("v"))
        return first.groupBy(*keys).agg(*[F.max(F.when(F.col("k") == k, F.col("v"))).alias(x) for k, x in enumerate(names)])

    behind = counts.join(medians(counts, "border", "xyz"), keys)
    far = sum(((F.col(a) - F.col(b)) * (F.col(a) - F.col(b)) for a, b in zip("rgb", "xyz")), F.lit(0)) > 50 * 50
    front = behind.withColumn("front", F.when(far, F.col("n")).otherwise(0))
    enough = front.groupBy(*keys).agg(F.sum("front").alias("some"), F.sum("n").alias("of")).filter("some >= greatest(1, floor(of / 20))").select(*keys)
    told = medians(front.join(enough, keys, "left_semi"), "front", "rgb")
    return boxes.select(*keys).join(told, keys, "left").select(*keys, *[F.coalesce(x, F.lit(0)).alias(x) for x in "rgb"])
