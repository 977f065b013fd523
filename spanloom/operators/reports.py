"""Reports over files and documents: run reports, summaries, statistics, and the table's sorting and filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions import patterns
from spanloom.functions import values as V

# Fixed value: the run report's header.
RUN_HEADER = ("File", "Entities Found", "Status", "Entity Types")
COLUMNS = ("page", "type", "text", "place", "origin")


def file_summaries(files: DataFrame, found: DataFrame, details: bool = False) -> DataFrame:
    """(path, total_entities_found, entities_by_type[, detected_entities]) of every file; found has a row a detection."""
    by_type = found.groupBy("path", "entity").agg(F.count("*").alias("n"))
    per = by_type.groupBy("path").agg(F.sum("n").alias("total_entities_found"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("entity", "n")))).alias("entities_by_type"))
    out = files.join(per, "path", "left").fillna(0, ["total_entities_found"])
    if details:
        rows = found.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("seq", "entity", "word", (F.col("page_num") + 1).alias("page_number")))).alias("detected_entities"))
        out = out.join(rows, "path", "left")
    return out


def run_totals(summaries: DataFrame) -> DataFrame:
    """(entity, n): what all files that worked hold by type; the row without entity counts files and detections."""
    good = summaries.filter("error IS NULL AND NOT skipped")
    types = good.select(F.explode("entities_by_type").alias("entity", "n")).groupBy("entity").agg(F.sum("n").alias("n"), F.count("*").alias("files"))
    return types.unionByName(good.agg(F.lit(None).cast("string").alias("entity"), F.coalesce(F.sum("total_entities_found"), F.lit(0)).alias("n"), F.count("*").alias("files")))


def run_report(summaries: DataFrame) -> DataFrame:
    """The report's rows: path, detections, status, and types with their counts; errors and skipped files count none."""
    failed, skipped = F.col("error").isNotNull(), F.coalesce("skipped", F.lit(False))
    types = F.array_join(F.transform(F.array_sort(F.map_entries("entities_by_type")), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ", ")
    bad = failed | skipped
    cells = (F.col("path"), F.when(bad, F.lit(0)).otherwise(F.col("total_entities_found")), F.when(failed, "Error").when(skipped, "Skipped").otherwise("Success"), F.when(bad, "").otherwise(F.coalesce(types, F.lit(""))))
    return summaries.select(*[c.alias(h) for c, h in zip(cells, RUN_HEADER)])


def attempted(rows: DataFrame, result: Column) -> DataFrame:
    """rows with result and error: a row whose result is null failed, and stays; an error that it has already is kept."""
    own = F.col("error") if "error" in rows.columns else F.lit(None).cast("string")
    return rows.withColumn("result", result).withColumn("error", F.when(F.col("result").isNull(), F.coalesce(own, F.lit("no result"))))


def block_statistics(block: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """(doc_id, pages, blocks, chars[, grids, grid_entries]): cells has a row for each grid cell that a character touches."""
    out = block.groupBy("doc_id").agg(F.countDistinct("page_num").alias("pages"), F.count("*").alias("blocks"), F.sum(F.length("text")).alias("chars"))
    if cells is not None:
        grids = cells.groupBy("doc_id", "page_num", "gx", "gy").agg(F.count("*").alias("n")).groupBy("doc_id").agg(F.count("*").alias("grids"), F.sum("n").alias("grid_entries"))
        out = out.join(grids, "doc_id", "left").fillna(0, ["grids", "grid_entries"])
    return out


def text_integrity(chars: DataFrame, texts: DataFrame) -> DataFrame:
    """(doc_id, chars, length, consistent, valid): whether characters (doc_id, goffset, ch) are the text (doc_id, text), all of them."""
    c = chars.join(texts, "doc_id").groupBy("doc_id").agg(F.count("*").alias("chars"), F.bool_and(F.expr("substring(text, goffset + 1, 1) = ch")).alias("valid"))
    out = texts.select("doc_id", F.length("text").cast("long").alias("length")).join(c, "doc_id", "left").fillna(0, ["chars"])
    return out.select("doc_id", "chars", "length", (F.col("chars") == F.col("length")).alias("consistent"), F.coalesce("valid", F.lit(True)).alias("valid"))


def column_text(column: str) -> Column:
    """What the table shows of a detection (entity, word, origin, page_num, block_num, offset)."""
    if column not in COLUMNS:
        raise ValueError(f"unknown column {column!r}; known: {', '.join(COLUMNS)}")
    place = V.place_label(F.coalesce("page_num", F.lit(0)), F.coalesce("block_num", F.lit(0)), F.coalesce("offset", F.lit(0)))
    shown = {"page": (F.coalesce("page_num", F.lit(0)) + 1).cast("string"), "type": V.entity_name_ja(F.coalesce("entity", F.lit(""))), "text": F.coalesce("word", F.lit("")), "place": place, "origin": V.origin_label(F.lit(False), F.col("origin"))}
    return shown[column]


def filtered(found: DataFrame, **wanted: str) -> DataFrame:
    """Detections whose shown columns all hold their pattern; one that doesn't compile filters nothing."""
    for column, pattern in wanted.items():
        shown = column_text(column)
        if patterns.readable(pattern):
            found = found.filter(patterns.search(shown, pattern))
    return found


def sort_keys(column: str) -> list[Column]:
    start = [F.coalesce(c, F.lit(0)) for c in ("page_num", "block_num", "offset")]
    if column == "place":
        return [*start, *[F.coalesce(f"end_{c}", a) for c, a in zip(("page_num", "block_num", "offset"), start)]]
    rank = V.entity_rank(V.origin_label(F.lit(False), F.col("origin")), ("手動", "追加", "自動"))
    return {"page": start, "type": [F.lower(F.coalesce("entity", F.lit("")))], "text": [F.lower(F.coalesce("word", F.lit("")))], "origin": [rank]}[column]


def sorted_by(found: DataFrame, column: str, descending: bool = False) -> DataFrame:
    """Rows in the order of a column, equal ones by seq: a total sort, for what is shown or written."""
    return found.orderBy(*[k.desc() if descending else k.asc() for k in sort_keys(column)], "seq")


def by_position(found: DataFrame) -> DataFrame:
    """Rows by page and upper edge, absent ones as 0, equal ones by seq."""
    return found.orderBy(F.coalesce("page_num", F.lit(0)), F.coalesce("y0", F.lit(0.0)), "seq")


def sessions(paths: DataFrame, sidecar: DataFrame, embedded: DataFrame) -> DataFrame:
    """(path, state, source, mismatch): the sidecar's state before the embedded one; mismatch where its hash isn't the file's.

    paths: path, sha256; the others: path, content_hash, state.  A file without either has a null state.
    """
    s = sidecar.select("path", F.col("content_hash").alias("sh"), F.col("state").alias("ss"))
    e = embedded.select("path", F.col("content_hash").alias("eh"), F.col("state").alias("es"))
    rows = paths.join(s, "path", "left").join(e, "path", "left")
    source = F.when(F.col("ss").isNotNull(), "sidecar").when(F.col("es").isNotNull(), "embedded")
    used = F.when(F.col("ss").isNotNull(), F.col("sh")).otherwise(F.col("eh"))
    return rows.select("path", F.coalesce("ss", "es").alias("state"), source.alias("source"), F.coalesce(used != F.col("sha256"), F.lit(False)).alias("mismatch"))


def session_results(saved: DataFrame) -> DataFrame:
    """Sessions with read_result, detect_result, duplicate_result, ocr_result; an old one holds a single result, which counts as detected."""
    if "result" not in saved.columns:
        return saved
    return saved.withColumn("detect_result", F.coalesce("detect_result", F.when(F.col("read_result").isNull() & F.col("duplicate_result").isNull(), F.col("result")))).drop("result")
