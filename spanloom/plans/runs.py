"""Runs over a corpus of files with a ledger: what was done already isn't read again, and no file's failure stops a run.

The ledger is a replaceable table by path.  A run takes the files whose path and digest have no finished row, leaves out
those whose names mark them as results of earlier runs, does the work, and commits one row a file: Success, Skipped or
Error with its reason.  Errors are tried again by the next run; a run that is lost before its commit has done nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.operators import reports
from spanloom.sources.files import EXCLUDED, skipped
from spanloom.sources.store import Table

SKIPPED = "excluded by name"
COLUMNS = ("path", "sha256", "status", "reason", "total_entities_found", "entities_by_type", "attempt", "run")


def ledger(spark, path: str) -> Table:
    return Table(spark, path, ("path",))


def pending(files: DataFrame, done: DataFrame | None) -> DataFrame:
    """files (path, sha256, ...) without those that a ledger's row finished at the same digest."""
    if done is None:
        return files
    finished = done.filter("status <> 'Error'").select("path", "sha256")
    return files.join(finished, ["path", "sha256"], "left_anti").select(*files.columns)


def run(files: DataFrame, table: Table, work: Callable[[DataFrame], DataFrame], excluded=EXCLUDED, name: str | None = None) -> str:
    """Does work on the pending files (path, filename, sha256, ...) and commits their rows; the run's name.

    work gives (path, total_entities_found, entities_by_type, error) of the files that it is given; one that it gives no row
    for counts as failed.
    """
    name = name or uuid.uuid4().hex
    done = table.read()
    todo = pending(files, done).withColumn("skip_", skipped(F.col("filename"), excluded))
    tried = todo.filter(~F.col("skip_")).drop("skip_")
    made = tried.select("path", "sha256").join(work(tried), "path", "left")
    made = reports.attempted(made, F.when(F.col("error").isNull(), F.col("total_entities_found")))
    none = F.lit(None).cast("map<string,bigint>")
    rows = made.select("path", "sha256", F.when(F.col("error").isNull(), "Success").otherwise("Error").alias("status"), F.col("error").alias("reason"), F.coalesce("result", F.lit(0)).cast("long").alias("total_entities_found"), F.when(F.col("error").isNull(), F.col("entities_by_type")).alias("entities_by_type"))
    left = todo.filter("skip_").select("path", "sha256", F.lit("Skipped").alias("status"), F.lit(SKIPPED).alias("reason"), F.lit(0).cast("long").alias("total_entities_found"), none.alias("entities_by_type"))
    out = rows.unionByName(left)
    if done is None:
        out = out.withColumn("attempt", F.lit(1))
    else:
        out = out.join(done.select("path", (F.col("attempt") + 1).alias("attempt")), "path", "left").fillna(1, ["attempt"])
    table.replace(out.withColumn("run", F.lit(name)).select(*COLUMNS))
    return name


def report(table: Table) -> DataFrame:
    """The run report's rows of all files in the ledger."""
    rows = table.read()
    return reports.run_report(rows.select("path", "total_entities_found", "entities_by_type", F.when(F.col("status") == "Error", F.col("reason")).alias("error"), (F.col("status") == "Skipped").alias("skipped")))


def detecting(read: Callable[[DataFrame], DataFrame], detect: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """Work that reads files and counts what is detected: read gives (path, text, error), detect a row a detection (doc_id, entity, ...) of (doc_id, text)."""

    def work(files: DataFrame) -> DataFrame:
        texts = read(files).select("path", "text", "error")
        found = detect(texts.filter("error IS NULL").select(F.col("path").alias("doc_id"), "text")).select(F.col("doc_id").alias("path"), "entity")
        return reports.file_summaries(texts.select("path", "error"), found)

    return work
