"""Exact de-duplication with a heavy-hitter split (DataFrame and SQL functions only).

A Misra-Gries type sketch (``approx_top_k``: counters that are decremented together, mergeable across tasks) names the
digests that may be frequent.  Their exact counts and winners are then computed for the named digests alone, combined
before the shuffle; those that are truly frequent are broadcast - at most ``tracked`` rows, whatever the input - and
their rows are resolved map-side.  All other digests are below the sketch's error bound, so a plain shuffle by digest
meets no hot key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.llm.common import SPACE, read, saved, unused

#: Counters of the sketch: the most rows that are ever broadcast.  A digest above 1/768 of the rows is always found.
TRACKED = 1024


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_sha256): the digest of the text with each run of ASCII white space as one blank; null counts as empty."""
    text = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), SPACE, " ")
    return docs.select(F.col(id_col).alias("doc_id"), F.sha2(text.cast("binary"), 256).alias("text_sha256"))


def heavy_winners(rows: DataFrame, tracked: int = TRACKED) -> DataFrame:
    """Digests that the sketch names and an exact count verifies, with winner and size; never over tracked rows."""
    half = tracked // 2
    named = rows.agg(F.expr(f"approx_top_k(text_sha256, {half}, {tracked})").alias("top")).select(F.explode("top").alias("x"))
    named = saved(named.select(F.col("x.item").alias("text_sha256")).filter("text_sha256 IS NOT NULL"))
    return (
        rows.join(F.broadcast(named), "text_sha256")
        .groupBy("text_sha256")
        .agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        .filter("group_size > 1")
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tracked: int = TRACKED) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the smallest id stays.  A null text equals the empty text.  Null ids sort last: such a row stays only
    if no row of its group has an id.  Rows that repeat the winner's id are that winner again and stay too.  Other
    columns, whatever their names, play no part.  An empty table gives no rows.
    """
    rows = saved(digests(docs, id_col, text_col))
    heavy = saved(heavy_winners(rows, tracked))
    group = W.partitionBy("text_sha256")
    light = rows.join(F.broadcast(heavy.select("text_sha256")), "text_sha256", "left_anti").select(
        "doc_id", "text_sha256", F.min("doc_id").over(group).alias("keep_id"), F.count("*").over(group).alias("group_size")
    )
    hot = rows.join(F.broadcast(heavy), "text_sha256").select("doc_id", "text_sha256", "keep_id", "group_size")
    return light.union(hot).select("doc_id", "keep_id", "group_size", F.expr("doc_id <=> keep_id").alias("kept"), "text_sha256")


def keep_first_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tracked: int = TRACKED) -> DataFrame:
    """docs without the rows that exact_dedup drops, all columns untouched."""
    lost = unused(docs.columns, "lost_id")
    dropped = exact_dedup(docs, id_col, text_col, tracked).filter("NOT kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias(lost)).distinct()
    return docs.join(dropped, docs[id_col] == dropped[lost], "left_anti")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read(spark, sf_dir, "documents"))


SQL = {
    "op8_exact_dedup": r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM t WINDOW g AS (PARTITION BY text_sha256)"""
}
