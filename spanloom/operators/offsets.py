"""Documents as pages, blocks and characters: the offset algebra.

A text is an array of pages, each an array of blocks.  Positions are (page_num, block_num, offset), from 0, the end of
a span included; flat offsets are half-open.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.functions.values import SPACE, blank
from spanloom.shipping import apart


def pages_of(text: Column, lines: int = 8) -> Column:
    """Plain text as pages of so many non-blank lines, each line a block."""
    blocks = F.filter(F.split(text, "\n"), lambda b: ~blank(b))
    starts = F.sequence(F.lit(0), F.floor((F.size(blocks) - 1) / lines).cast("int"))
    return F.when(F.size(blocks) > 0, F.transform(starts, lambda i: F.slice(blocks, i * lines + 1, F.lit(lines)))).otherwise(F.array().cast("array<array<string>>"))


def flat_text(text: Column) -> Column:
    return F.array_join(F.flatten(text), "")


def blocks(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(doc_id, page_num, block_num, text, block_start, block_len); block_start counts all text before the block."""
    pages = docs.select("doc_id", F.posexplode(text_col).alias("page_num", "page"))
    out = pages.select("doc_id", "page_num", F.posexplode("page").alias("block_num", "text")).withColumn("block_len", F.length("text"))
    before = W.partitionBy("doc_id").orderBy("page_num", "block_num").rowsBetween(W.unboundedPreceding, -1)
    return out.withColumn("block_start", F.coalesce(F.sum("block_len").over(before), F.lit(0)))


def compact(block: DataFrame) -> DataFrame:
    """Blank blocks out; pages and blocks numbered anew, so that pages without blocks leave no gap."""
    kept = block.filter(~blank(F.col("text")))
    page = F.dense_rank().over(W.partitionBy("doc_id").orderBy("page_num")) - 1
    number = F.row_number().over(W.partitionBy("doc_id", "page_num").orderBy("block_num")) - 1
    return kept.select("doc_id", page.alias("page_num"), number.alias("block_num"), "text")


def target_text(text: Column, ignore_newlines: bool = True, ignore_whitespace: bool = False, pages: list[int] | None = None) -> Column:
    """The text that detection reads: blocks, with line breaks between them and after pages unless ignored."""
    chosen = text if pages is None else F.filter(text, lambda _, i: i.isin(*pages))
    out = F.array_join(F.transform(chosen, lambda p: F.array_join(p, "" if ignore_newlines else "\n")), "" if ignore_newlines else "\n")
    return F.regexp_replace(out, r"(?U)\s", "") if ignore_whitespace else out


def target_chars(text: Column, ignore_newlines: bool = True, ignore_whitespace: bool = False, pages: list[int] | None = None) -> Column:
    """target_text()'s characters as (ch, start, end): the span of each in the base text, all pages counted; inserted line breaks span nothing."""
    kind = "array<struct<ch:string,start:int,end:int>>"
    place = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<page:int,last:boolean,text:string,at:int>>").alias("out"))
    sized = F.flatten(F.transform(text, lambda p, i: F.transform(p, lambda b, j: F.struct(i.alias("page"), (j == F.size(p) - 1).alias("last"), b.alias("text")))))
    step = lambda acc, b: F.struct((acc["at"] + F.length(b["text"])).alias("at"), F.concat(acc["out"], F.array(F.struct(b["page"].alias("page"), b["last"].alias("last"), b["text"].alias("text"), acc["at"].alias("at")))).alias("out"))
    blocks_ = F.aggregate(sized, place, step, lambda acc: acc["out"])
    chosen = blocks_ if pages is None else F.filter(blocks_, lambda b: b["page"].isin(*pages))
    top = F.size(text) - 1 if pages is None else F.coalesce(F.array_max(F.filter(F.array(*map(F.lit, pages)), lambda p: p < F.size(text))), F.lit(-1))

    def of(b: Column) -> Column:
        after = b["at"] + F.length(b["text"])
        chars = F.when(F.length(b["text"]) > 0, F.transform(F.split(b["text"], ""), lambda c, k: F.struct(c.alias("ch"), (b["at"] + k).alias("start"), (b["at"] + k + 1).alias("end")))).otherwise(F.array().cast(kind))
        breaks = F.when(~b["last"] | (b["page"] < top), F.array(F.struct(F.lit("\n").alias("ch"), after.alias("start"), after.alias("end")))).otherwise(F.array().cast(kind))
        return chars if ignore_newlines else F.concat(chars, breaks)

    out = F.flatten(F.transform(chosen, of))
    return F.filter(out, lambda c: ~blank(c["ch"])) if ignore_whitespace else out


def target(text: Column, ignore_newlines: bool = True, ignore_whitespace: bool = False, pages: list[int] | None = None) -> Column:
    """(text, segments): the text that detection reads, and where its stretches lie in the base text, all pages counted.

    A segment (t, n, base) says that n characters from t on are those of the base text from base on; an inserted line break
    has n = 1 and feed set, and lies at the border base.  Without white space a segment is a run between blanks, otherwise a
    block: a row a block, not one a character.
    """
    from spanloom.operators.detect import let, running_spans, spans

    kind = "array<struct<base:int,text:string,feed:boolean>>"
    # Each page ends with an empty stretch of its own, so that pages without blocks break the line as well.
    listed = F.flatten(F.transform(text, lambda p, i: F.concat(
        F.transform(p, lambda b, j: F.struct(i.alias("page"), b.alias("text"), (j < F.size(p) - 1).alias("inner"), F.lit(False).alias("closes"))),
        F.array(F.struct(i.alias("page"), F.lit("").alias("text"), F.lit(False).alias("inner"), F.lit(True).alias("closes"))),
    )))
    chosen = (lambda page: F.lit(True)) if pages is None else (lambda page: page.isin(*pages))
    top = F.size(text) - 1 if pages is None else F.coalesce(F.array_max(F.filter(F.array(*map(F.lit, pages or [-1])), lambda p: p < F.size(text))), F.lit(-1))
    gapless = lambda rows: running_spans(F.transform(rows, lambda x: F.struct(F.lit(0).alias("gap"), x["text"].alias("hit"))))

    def pieces(b: Column, at: Column) -> Column:
        one = lambda base, t, feed: F.struct(base.cast("int").alias("base"), t.alias("text"), F.lit(feed).alias("feed"))
        none = F.array().cast(kind)
        runs = F.transform(spans(b["text"], r"\S+", whole=True), lambda s: one(at + s["start"], s["text"], False)) if ignore_whitespace else F.array(one(at, b["text"], False))
        own = F.when(chosen(b["page"]) & (b["text"] != ""), runs).otherwise(none)
        if ignore_newlines or ignore_whitespace:
            return own
        breaks = chosen(b["page"]) & (b["inner"] | (b["closes"] & (b["page"] < top)))
        return F.concat(own, F.when(breaks, F.array(one(at + F.length(b["text"]), F.lit("\n"), True))).otherwise(none))

    def segments(found: Column) -> Column:
        placed = F.zip_with(found, gapless(found), lambda x, s: F.struct(s["start"].alias("t"), F.length(x["text"]).alias("n"), x["base"].alias("base"), x["feed"].alias("feed")))
        return F.struct(F.array_join(F.transform(found, lambda x: x["text"]), "").alias("text"), placed.alias("segments"))

    return let(listed, lambda rows: let(F.flatten(F.zip_with(rows, gapless(rows), lambda b, s: pieces(b, s["start"]))), segments))


#: Characters that the lookups of offsets take together.
REACH = 1024


def _held(rows: DataFrame, at: str, table: DataFrame) -> DataFrame:
    """rows joined to the table's stretch (doc_id, first, n, ...) that holds their offset at, null where none does."""
    cut = table.filter("n > 0").withColumn("cell", F.explode(F.sequence(F.floor(F.col("first") / REACH), F.floor((F.col("first") + F.col("n") - 1) / REACH)))).withColumnRenamed("doc_id", "of_doc")
    on = (F.col("doc_id") == F.col("of_doc")) & (F.floor(F.col(at) / REACH) == F.col("cell")) & (F.col(at) >= F.col("first")) & (F.col(at) < F.col("first") + F.col("n"))
    return rows.join(apart(cut), on, "left").drop("of_doc", "cell")


def mapped_back(found: DataFrame, docs: DataFrame) -> DataFrame:
    """found (doc_id, start, end in the target text) with base_start, base_end; docs hold doc_id and target()'s value as target."""
    table = docs.select("doc_id", F.explode("target.segments").alias("s")).select("doc_id", F.col("s.t").alias("first"), "s.n", "s.base", "s.feed")
    rows = _held(found.withColumn("last_", F.col("end") - 1), "start", table)
    rows = rows.withColumn("base_start", F.col("base") + F.col("start") - F.col("first")).drop("first", "n", "base", "feed")
    rows = _held(rows, "last_", table)
    return rows.withColumn("base_end", F.col("base") + F.when(F.col("feed"), 0).otherwise(F.col("last_") + 1 - F.col("first"))).drop("first", "n", "base", "feed", "last_")


def positioned(found: DataFrame, docs: DataFrame) -> DataFrame:
    """found (doc_id, base_start, base_end) with the positions first and last, the last character's; docs: doc_id, text as pages of blocks.

    A start outside is (0, 0, 0), an end outside the last block's last character.
    """
    place = lambda p, b, o: F.struct(p.cast("int").alias("page_num"), b.cast("int").alias("block_num"), o.cast("int").alias("offset"))
    block = blocks(docs).withColumn("n", F.col("block_len")).withColumnRenamed("block_start", "first")
    ends = block.groupBy("doc_id").agg(F.max(F.struct("page_num", "block_num", "n")).alias("e"))
    ends = ends.select("doc_id", place(F.col("e.page_num"), F.col("e.block_num"), F.greatest(F.col("e.n") - 1, F.lit(0))).alias("end_"))
    table = block.select("doc_id", "first", "n", "page_num", "block_num").withColumnsRenamed({"page_num": "p_", "block_num": "b_", "first": "first"})
    zero = place(F.lit(0), F.lit(0), F.lit(0))
    here = lambda at: F.when(F.col("p_").isNotNull(), place(F.col("p_"), F.col("b_"), F.col(at) - F.col("first")))
    rows = _held(found.withColumn("last_", F.greatest(F.col("base_end") - 1, F.lit(0))), "base_start", table)
    rows = rows.withColumn("first_", F.coalesce(here("base_start"), zero)).drop("first", "n", "p_", "b_")
    rows = _held(rows, "last_", table).withColumn("then_", here("last_")).drop("first", "n", "p_", "b_").join(apart(ends), "doc_id", "left")
    return rows.withColumn("first", F.col("first_")).withColumn("last", F.coalesce("then_", "end_", zero)).drop("first_", "then_", "end_", "last_")


def position_of(text: Column, offset: Column) -> Column:
    """Position of a flat offset: the block that holds it; null beyond the text.  Empty blocks never match."""
    sized = F.flatten(F.transform(text, lambda p, i: F.transform(p, lambda b, j: F.struct(i.alias("page_num"), j.alias("block_num"), F.length(b).alias("n")))))
    start = F.struct(F.lit(0).alias("at"), F.lit(None).cast("struct<page_num:int,block_num:int,offset:int>").alias("found"))

    def step(acc: Column, b: Column) -> Column:
        here = acc["found"].isNull() & (offset >= acc["at"]) & (offset < acc["at"] + b["n"])
        hit = F.struct(b["page_num"].alias("page_num"), b["block_num"].alias("block_num"), (offset - acc["at"]).cast("int").alias("offset"))
        return F.struct((acc["at"] + b["n"]).alias("at"), F.when(here, hit).otherwise(acc["found"]).alias("found"))

    return F.aggregate(sized, start, step, lambda acc: acc["found"])


def span_positions(text: Column, start: Column, end: Column) -> Column:
    """(start, end) of a half-open span; a start outside is (0, 0, 0), an end outside the last character."""
    total = F.length(flat_text(text))
    zero = F.struct(F.lit(0).alias("page_num"), F.lit(0).alias("block_num"), F.lit(0).alias("offset"))
    last = F.coalesce(position_of(text, total - 1), zero)
    return F.struct(F.coalesce(position_of(text, start), zero).alias("start"), F.coalesce(position_of(text, end - 1), last).alias("end"))


def global_offset(block: DataFrame, positions: DataFrame) -> DataFrame:
    """positions (doc_id, page_num, block_num, offset, ...) with goffset; a block that isn't known gives a stand-in by page and block."""
    known = block.select("doc_id", "page_num", "block_num", "block_start")
    inside = F.greatest(F.col("offset"), F.lit(0)).cast("decimal(38,0)")
    stand_in = F.col("page_num").cast("decimal(38,0)") * F.lit(10**15).cast("decimal(38,0)") + F.col("block_num").cast("decimal(38,0)") * F.lit(10**9).cast("decimal(38,0)") + inside
    return positions.join(known, ["doc_id", "page_num", "block_num"], "left").withColumn("goffset", F.coalesce(F.col("block_start").cast("decimal(38,0)") + inside, stand_in)).drop("block_start")


def entity_span(start: Column, end: Column) -> Column:
    """(gstart, gend) of two flat ends, swapped if reversed."""
    return F.struct(F.least(start, end).alias("gstart"), F.greatest(start, end).alias("gend"))


def base_span(start: Column, end: Column, target: Column, base_length: Column) -> Column:
    """(start, end) in the base text of a half-open span of the target text, whose characters lie at target: array of (start, end).

    Clamped to the base; an empty span is the start of its character, one past the target the end of the base.  Null ends give (0, 0).
    """
    s = F.greatest(start, F.lit(0))
    e, most = F.greatest(end, s), F.greatest(base_length, F.lit(0))
    clamp = lambda x, low: F.least(F.greatest(x, low), most)
    make = lambda a, b: F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"))
    last, at = F.least(e, F.size(target)), clamp(F.get(target, s)["start"], F.lit(0))
    return (
        F.when(start.isNull() | end.isNull(), make(F.lit(0), F.lit(0)))
        .when(target.isNull() | (F.size(target) == 0), make(F.least(s, most), F.least(e, most)))
        .when(s >= F.size(target), make(most, most))
        .when(last <= s, make(at, at))
        .otherwise(make(at, clamp(F.get(target, last - 1)["end"], at)))
    )


#: Characters of a piece that pieces() cuts.
PIECE = 64


def pieces(text: Column) -> Column:
    """The text cut into (text, n): pieces of PIECE characters, the last one shorter, and how many of them aren't white space."""
    kept = lambda c: F.length(F.regexp_replace(c, rf"[{SPACE}]+", ""))
    return F.transform(F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{PIECE}}}"), F.lit(0)), lambda c: F.struct(c.alias("text"), kept(c).alias("n")))


def unspaced_size(cut: Column) -> Column:
    """How many characters of pieces() aren't white space."""
    return F.aggregate(cut, F.lit(0), lambda n, c: n + c["n"])


def unspaced_span(start: Column, end: Column, cut: Column, size: Column, base_length: Column) -> Column:
    """base_span() where the target text is the base text without white space: cut is its pieces(), size their unspaced_size().

    Whole pieces are counted off and characters are looked at in those two alone where the span begins and ends.
    """
    from spanloom.operators.detect import let

    make = lambda a, b: F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"))
    at = lambda left, i, here: F.struct(left.alias("left"), i.alias("i"), F.lit(here).alias("here"))

    def place(k: Column) -> Column:
        step = lambda acc, c: F.when(acc["here"] | (acc["left"] < c["n"]), at(acc["left"], acc["i"], True)).otherwise(at(acc["left"] - c["n"], acc["i"] + 1, False))
        inside = lambda c: F.filter(F.transform(F.split(c, ""), lambda x, j: F.when(~blank(x), j)), lambda j: j.isNotNull())
        return let(F.aggregate(cut, at(k.cast("int"), F.lit(0), False), step), lambda f: f["i"] * PIECE + F.get(inside(F.get(cut, f["i"])["text"]), f["left"]))

    s, most = F.greatest(start, F.lit(0)), F.greatest(base_length, F.lit(0))
    e = F.greatest(end, s)
    return (
        F.when(start.isNull() | end.isNull(), make(F.lit(0), F.lit(0)))
        .when(cut.isNull() | (size == 0), make(F.least(s, most), F.least(e, most)))
        .when(s >= size, make(most, most))
        .otherwise(let(place(s), lambda first: make(first, F.when(e > s, place(F.least(e, size) - 1) + 1).otherwise(first))))
    )


def content_hash(text: Column, rects: Column | None = None, images: Column | None = None) -> Column:
    """Digest of page count, page texts, and where given of the pages' rectangles (six digits) and image counts."""
    page = lambda i, p: F.concat(F.array_join(p, "\n"), *([F.lit("|"), F.array_join(F.transform(F.get(rects, i), lambda x: F.format_string("%.6f", x)), ",")] if rects is not None else []), *([F.lit("|"), F.get(images, i).cast("string")] if images is not None else []))
    return F.sha2(F.concat(F.size(text).cast("string"), F.lit("|"), F.array_join(F.transform(text, lambda p, i: page(i, p)), "\f")), 256)


def block_summary(block: DataFrame, preview: int = 100) -> DataFrame:
    short = F.when(F.length("text") > preview, F.concat(F.substring("text", 1, preview), F.lit("..."))).otherwise(F.col("text"))
    return block.select("doc_id", "page_num", "block_num", short.alias("preview"), F.length("text").alias("n_chars"))
