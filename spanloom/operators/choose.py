"""Choosing among spans that overlap, island by island: spans that overlap nothing are taken where they are.

An island is a maximal run of overlapping spans of a document (half-open).  Only islands of several spans are sent to Python,
each with its own spans alone, where sorted ends and bisection keep the choice near linear in their number.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.operators import sweep
from spanloom.shipping import apart, ship

Spans = list[tuple[int, int]]


def _by_island(found: DataFrame, order: list, pick: Callable[[Spans, list], list[int]], weight: str | None = None) -> DataFrame:
    """found's rows that pick takes of each island: it is given the spans in the wanted order and their weights, and gives indexes."""
    ship(found.sparkSession)
    names = found.columns
    rows = found.withColumn("seq_", F.row_number().over(W.partitionBy("doc_id").orderBy(*order)).cast("long"))
    keyed = rows.select("doc_id", "seq_", F.struct(*names).alias("row_"), F.col("seq_").alias("seq"), F.col("start").cast("long").alias("gstart"), (F.col("end") - 1).cast("long").alias("gend"), (F.col(weight) if weight else F.lit(0.0)).cast("double").alias("weight_"))
    placed = sweep.overlap_blocks(keyed, "doc_id").withColumn("size_", F.count("*").over(W.partitionBy("doc_id", "block")))
    kind = found.schema["doc_id"].dataType.simpleString()

    def choose(table: pa.Table) -> pa.Table:
        table = table.sort_by("seq_")
        spans = [(a, b + 1) for a, b in zip(table["gstart"].to_pylist(), table["gend"].to_pylist())]
        taken = table.take(pick(spans, table["weight_"].to_pylist()))
        return taken.select(["doc_id", "seq_"])

    crowded = placed.filter("size_ > 1").select("doc_id", "block", "seq_", "gstart", "gend", "weight_")
    won = crowded.groupBy("doc_id", "block").applyInArrow(choose, f"doc_id {kind}, seq_ bigint")
    alone = placed.filter("size_ = 1").select("row_.*")
    return alone.unionByName(placed.filter("size_ > 1").join(apart(won), ["doc_id", "seq_"], "left_semi").select("row_.*"))


def _first_free(spans: Spans, weights: list) -> list[int]:
    """In the given order, each span that overlaps none taken before; what is taken is kept sorted and never overlaps."""
    starts: list[int] = []
    ends: list[int] = []
    out = []
    for k, (a, b) in enumerate(spans):
        at = bisect_left(starts, b)
        if at == 0 or ends[at - 1] <= a:
            starts.insert(at, a)
            ends.insert(at, b)
            out.append(k)
    return out


def _heaviest(spans: Spans, weights: list) -> list[int]:
    """The spans without overlap of the greatest total weight; of equal totals one that ends earlier."""
    order = sorted(range(len(spans)), key=lambda k: (spans[k][1], k))
    ends = [spans[k][1] for k in order]
    total, link = [0.0], [(-1, -1)]
    for n, k in enumerate(order):
        before = bisect_right(ends, spans[k][0], 0, n)
        with_it = total[before] + (weights[k] or 0.0)
        if with_it > total[n] + 1e-12:
            total.append(with_it)
            link.append((before, k))
        else:
            total.append(total[n])
            link.append((n, -1))
    out, n = [], len(order)
    while n > 0:
        n, k = link[n]
        if k >= 0:
            out.append(k)
    return sorted(out)


def first_free(found: DataFrame, *order) -> DataFrame:
    """found's spans (doc_id, start, end) taken in the given order unless one that was taken before overlaps them."""
    return _by_island(found, list(order), _first_free)


def heaviest(found: DataFrame, weight: str = "score") -> DataFrame:
    """found's spans without overlaps of the greatest total weight; weights that are equal in sum favour spans that end first."""
    return _by_island(found, ["start", F.desc("end"), F.desc(weight), *[c for c in ("entity", "word") if c in found.columns]], _heaviest, weight)
