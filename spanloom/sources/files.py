"""Readers and writers: files with metadata and digests, JSON results, CSV reports, page text."""

from __future__ import annotations

import fnmatch
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions import values

POSITION = "struct<page_num:int,block_num:int,offset:int>"
DETECTION = f"struct<start:{POSITION},end:{POSITION},entity:string,word:string,origin:string,manual:boolean,rects_pdf:array<array<double>>,mask_rects_pdf:array<array<double>>,selection_mode:string>"
READ_RESULT = f"metadata struct<pdf:struct<filename:string,path:string,size:bigint,page_count:int,sha256:string>,generated_at:string>, text array<array<string>>, detect array<{DETECTION}>, offset2coordsMap map<string,map<string,array<array<double>>>>, coords2offsetMap map<string,string>"
# Names of files that earlier runs wrote, and the report's header.
EXCLUDED = ("*_backup.*", "*_masked.*")
CSV_HEADER = ("ページ", "種別", "テキスト", "位置", "手動")


def files(spark: SparkSession, path: str, pattern: str = "*.pdf", content: bool = True) -> DataFrame:
    """(path, filename, size, modified_at, sha256) of files, recursively."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    digest = [F.sha2("content", 256).alias("sha256")] if content else []
    return rows.select("path", F.element_at(F.split("path", "/"), -1).alias("filename"), F.col("length").alias("size"), F.col("modificationTime").alias("modified_at"), *digest)


def extracted(rows: DataFrame, extract: Callable[[bytes], list[list[str]]]) -> DataFrame:
    """(path, page_count, text, error) of files with content: an adapter gives each file's pages of blocks; one that fails keeps its row.

    Spark has no reader for page documents, so the caller brings one; it runs in Arrow batches.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for path, content in zip(frame["path"], frame["content"]):
                try:
                    pages = extract(content)
                    out.append((path, len(pages), pages, None))
                except Exception as e:  # noqa: BLE001 - a file's failure is a row, not the job's
                    out.append((path, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["path", "page_count", "text", "error"])

    return rows.select("path", "content").mapInPandas(run, "path string, page_count int, text array<array<string>>, error string")


def write_json(results_: DataFrame, path: str) -> None:
    """One JSON document a row, nulls written, characters as they are."""
    results_.write.option("ignoreNullFields", "false").json(path)


def skipped(filename: Column, patterns=EXCLUDED) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | filename.rlike(fnmatch.translate(p).replace(r"(?s:", "(?s:").replace(r"\z", "$").replace(r"\Z", "$"))
    return out


def results(spark: SparkSession, path: str) -> DataFrame:
    """Result documents; a malformed one keeps its row, with its text in _corrupt_record."""
    return spark.read.schema(READ_RESULT + ", _corrupt_record string").option("multiLine", "true").option("mode", "PERMISSIVE").json(path)


def same_file(expected: Column, actual: Column, force: bool = False) -> Column:
    """Whether the digest fits; an absent one does."""
    return F.lit(True) if force else F.coalesce(expected == actual, F.lit(True))


def csv_rows(found: DataFrame) -> DataFrame:
    """The detection list as shown: page, type, text, place, mark of manual rows."""
    place = values.place_label(F.col("page_num"), F.col("block_num"), F.col("offset"))
    mark = F.when(F.col("origin") == "manual", "✓").otherwise("")
    cells = [(F.col("page_num") + 1).cast("string"), values.entity_name_ja(F.col("entity")), F.col("word"), place, mark]
    return found.select(*[c.alias(h) for c, h in zip(cells, CSV_HEADER)])


def write_csv(found: DataFrame, path: str, one_file: bool = False) -> None:
    """The detection list as CSV in UTF-8, each file with a byte order mark, which spreadsheets ask for; one_file writes through one task."""
    rows = csv_rows(found)
    rows = rows.withColumnRenamed(CSV_HEADER[0], "\ufeff" + CSV_HEADER[0])
    (rows.coalesce(1) if one_file else rows).write.option("header", "true").option("encoding", "UTF-8").csv(path)


def output_path(path: Column, suffix: str = "_masked", folder: str | None = None) -> Column:
    name = F.element_at(F.split(path, "/"), -1)
    stem, ext = F.regexp_replace(name, r"\.[^.]*$", ""), F.regexp_extract(name, r"\.[^.]*$", 0)
    where = F.lit(folder + "/") if folder else F.regexp_extract(path, r"^.*/", 0)
    return F.concat(where, stem, F.lit(suffix), ext)


def preferred(*results: Column) -> Column:
    """The first result that is there: duplicates resolved, else detections, else what was read."""
    return F.coalesce(*results)
