"""Recognition chains over page documents: recognise, write, read again, detect; and taking written text away again.

A document's own text is rows of blocks (doc_id, page_num, block_num, text, x0, y0, x1, y1), what recognition wrote rows as
``ocr.write_plan`` gives them.  A run replaces what was written on its pages and leaves other pages alone, so a run that is
repeated changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.operators import ocr
from spanloom.plans import config, service
from spanloom.shipping import saved, spread

_PLACE = ("x0", "y0", "x1", "y1")


def target_pages(pages: DataFrame, wanted: list | None = None) -> DataFrame:
    """The pages (doc_id, page_num, ...) that are wanted; numbers that aren't whole, or that no document has, choose none."""
    if wanted is None:
        return pages
    most = max((int(p) for p in wanted if str(p).lstrip("-").isdigit()), default=-1)
    return pages.filter(F.col("page_num").isin(*config.target_pages(most + 1, wanted)))


def run_ocr(pages: DataFrame, own: DataFrame, engine: Callable[..., str], written: DataFrame | None = None, settings: dict | None = None, wanted: list | None = None, dpi: int = 300) -> tuple[DataFrame, DataFrame]:
    """(written, failed): the written text after recognising the wanted pages (doc_id, page_num, width, height in points, image), and
    the pages (doc_id, page_num, error) whose engine failed, which keep what was written on them.

    Text that a page has of its own is painted over first.  settings: as in a configuration's ocr_settings.  What the engine
    gives is written to the checkpoint folder, so that no page is recognised twice, whatever is done with the result.
    """
    if dpi <= 0:
        raise ValueError("dpi must be positive")
    s = config.normal({"ocr_settings": settings or {}})["ocr_settings"]
    chosen = target_pages(pages, wanted)
    rects = ocr.blanked(own.select("doc_id", "page_num", *_PLACE), dpi).groupBy("doc_id", "page_num").agg(F.collect_list(F.struct(*_PLACE)).alias("covered"))
    none = F.array().cast(rects.schema["covered"].dataType)
    # Few bytes of images are much work: pages are dealt to several tasks a core, which what is made of them inherits.
    chosen = spread(chosen, "doc_id", "page_num")
    raw = saved(ocr.recognised(chosen.join(rects, ["doc_id", "page_num"], "left").withColumn("covered", F.coalesce("covered", none)), engine))
    items = ocr.to_points(ocr.items(raw.filter("error IS NULL")), dpi, s["offset_x"], s["offset_y"])
    if s["auto_color"] and "text_color" not in items.columns:
        items = items.withColumn("text_color", F.lit(None).cast("array<int>")).withColumn("text_opacity", F.lit(None).cast("double"))
    new = ocr.write_plan(items, pages, tuple(s["font_color"]), s["opacity"], s["auto_color"])
    failed = raw.filter("error IS NOT NULL").select("doc_id", "page_num", "error")
    if written is not None:
        read = raw.filter("error IS NULL").select("doc_id", "page_num")
        new = written.join(read, ["doc_id", "page_num"], "left_anti").select(new.columns).unionByName(new)
    return saved(new), failed


def cleared(written: DataFrame, wanted: list | None = None) -> tuple[DataFrame, DataFrame]:
    """(written, counts): without the text on the wanted pages, and (doc_id, removed)."""
    gone = target_pages(written, wanted)
    left = written.filter("false") if wanted is None else written.join(gone.select("doc_id", "page_num").distinct(), ["doc_id", "page_num"], "left_anti").select(written.columns)
    return left, gone.groupBy("doc_id").agg(F.count("*").alias("removed"))


def read_again(docs: DataFrame, own: DataFrame, written: DataFrame) -> DataFrame:
    """(doc_id, text): pages of blocks, a page's own first, then what was written on it; pages without text leave no gap."""
    rows = own.select("doc_id", "page_num", F.lit(0).alias("kind"), F.col("block_num").cast("long").alias("n"), "text")
    rows = rows.unionByName(written.select("doc_id", "page_num", F.lit(1).alias("kind"), F.col("item_num").cast("long").alias("n"), "text"))
    rows = rows.filter(F.trim("text") != "")
    page = rows.groupBy("doc_id", "page_num").agg(F.transform(F.array_sort(F.collect_list(F.struct("kind", "n", "text"))), lambda x: x["text"]).alias("blocks"))
    text = page.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("page_num", "blocks"))), lambda x: x["blocks"]).alias("text"))
    return docs.select("doc_id").join(text, "doc_id", "left").withColumn("text", F.coalesce("text", F.array().cast("array<array<string>>")))


def ocr_then_detect(docs: DataFrame, pages: DataFrame, own: DataFrame, engine: Callable[..., str], written: DataFrame | None = None, settings: dict | None = None, options: dict | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(written, docs, found): recognition on the pages that detection is to read, the documents read again, and what is detected in them."""
    wanted = (options or {}).get("pages")
    now, _ = run_ocr(pages, own, engine, written, settings, wanted)
    read = saved(read_again(docs, own, now))
    return now, read, service.run_detect(read, options)
