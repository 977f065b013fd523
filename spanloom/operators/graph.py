"""Connected components of links inside documents, by alternating large-star and small-star steps.

A step is a grouped minimum, combined before the shuffle, and an equi-join whose hot keys Spark can split: a document
with a third of all links meets no single task.  Each step's links are written to the checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.shipping import saved

KEYS = ["doc_id", "u"]


def _down(links: DataFrame) -> DataFrame:
    """Each link once, from its larger end to its smaller one."""
    return links.filter("u <> v").select("doc_id", F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select("doc_id", F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy(*KEYS).agg(F.min("v").alias("m")).select("doc_id", "u", F.least("m", "u").alias("m"))
    return _down(both.filter("v > u").join(least, KEYS).select("doc_id", F.col("v").alias("u"), F.col("m").alias("v")))


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy(*KEYS).agg(F.min("v").alias("m"))
    moved = links.join(least, KEYS).select("doc_id", F.col("v").alias("u"), F.col("m").alias("v"))
    return _down(moved.unionByName(least.select("doc_id", "u", F.col("m").alias("v"))))


def components(links: DataFrame) -> DataFrame:
    """(doc_id, u, v) -> (doc_id, id, root): the smallest id that links lead to, one row for each id but the roots themselves.

    Repeated links and loops change nothing; null ends link nothing; no links give no rows.
    """
    now, before = saved(_down(links.select("doc_id", "u", "v").dropna())), None
    while True:
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("doc_id", "u", "v").cast("decimal(38,0)"))).first())
        if mark == before or not mark[0]:
            return now.select("doc_id", F.col("u").alias("id"), F.col("v").alias("root"))
        now, before = saved(_small_star(_large_star(now))), mark
