"""Connected components by alternating large-star and small-star steps.

Every step is a grouped minimum (combined before the shuffle) and an equi-join whose hot keys Spark can split, so a
hub with a third of all links never meets one task.  No link or label is collected by the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import saved

#: Links that a task holds at least, where a step has fewer than a task for each: small steps don't write hundreds of files.
LINKS_A_TASK = 50_000


def _oriented(edges: DataFrame, tasks: int) -> DataFrame:
    out = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    return out.coalesce(tasks).distinct().coalesce(tasks)


def _large_star(edges: DataFrame, tasks: int) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return _oriented(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")), tasks)


def _small_star(edges: DataFrame, tasks: int) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return _oriented(moved.union(least.select("u", F.col("m").alias("v"))), tasks)


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(u, v) links of comparable ids -> (id, component_id), one row for each id in some link but the smallest of its component.

    Null ends and loops link nothing.  Repeated links count once.  No links give no rows; an id that is absent from
    the result is its own component.
    """
    now = saved(edges.select("u", "v").dropna().filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before, mark = None, _mark(now)
    while mark != before and mark[0]:
        tasks = 1 + mark[0] // LINKS_A_TASK
        now = saved(_small_star(_large_star(now.coalesce(tasks), tasks), tasks))
        before, mark = mark, _mark(now)
    return now.select(F.col("u").alias("id"), F.col("v").alias("component_id"))
