"""Containment of closed intervals by ranks, without comparing all pairs.

Order the intervals of a group by (start, widest first) and again by (end, narrowest first).  One contains another just
if it comes earlier in the first order and later in the second: containment is inversion of two rankings.  So

* components of containment are the stretches between cuts, a cut lying where the highest second rank so far equals the
  first rank: one running maximum;
* containment counts are numbers of inversions.  Groups of a few intervals compare them in an array of the window; larger
  ones are cut into strips of bounded size by either rank, each strip is counted by merging sorted halves, and whole
  strips are added up from a table of counts by strip and strip.

Rankings and running values are windows, which sort and spill; no group is held by a task beyond one strip.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.shipping import ship

#: Groups up to this size are compared in place, all of them with all.
SMALL = 64
#: Intervals that one task counts at a time.
STRIP = 65_536


def ranked(found: DataFrame, *keys: str) -> DataFrame:
    """found with its two ranks from 0 within the keys, r1 and r2; of equal spans the one that the first order takes first counts as the wider one."""
    group = W.partitionBy(*keys)
    out = found.withColumn("r1", F.row_number().over(group.orderBy("gstart", F.desc("gend"), "seq")) - 1)
    return out.withColumn("r2", F.row_number().over(group.orderBy("gend", F.desc("gstart"), F.desc("r1"))) - 1)


def contain_blocks(found: DataFrame, *keys: str) -> DataFrame:
    """found with block: the smallest seq of those that containment joins, directly or not, within the keys."""
    order = W.partitionBy(*keys).orderBy("r1")
    cut = ranked(found, *keys).withColumn("cut", (F.max("r2").over(order.rowsBetween(W.unboundedPreceding, 0)) == F.col("r1")).cast("int"))
    island = cut.withColumn("island", F.coalesce(F.sum("cut").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    return island.withColumn("block", F.min("seq").over(W.partitionBy(*keys, "island"))).drop("r1", "r2", "cut", "island")


def overlap_blocks(found: DataFrame, *keys: str) -> DataFrame:
    """The same for overlap: gaps and islands."""
    order = W.partitionBy(*keys).orderBy("gstart", "gend", "seq")
    reach = F.max("gend").over(order.rowsBetween(W.unboundedPreceding, -1))
    cut = found.withColumn("cut", F.coalesce((F.col("gstart") > reach).cast("int"), F.lit(1)))
    island = cut.withColumn("island", F.sum("cut").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return island.withColumn("block", F.min("seq").over(W.partitionBy(*keys, "island"))).drop("cut", "island")


def inversions(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of distinct values: how many later ones are smaller, and how many earlier ones are larger.  Halves are merged level by level."""
    n = len(values)
    after, before = np.zeros(n, np.int64), np.zeros(n, np.int64)
    order = np.argsort(values, kind="stable")
    for level in range(max(n - 1, 0).bit_length()):
        by_block = np.argsort(order >> (level + 1), kind="stable")
        at = order[by_block]
        right = (at >> level) & 1
        block = at >> (level + 1)
        first = np.searchsorted(block, block)
        last = np.searchsorted(block, block, side="right")
        rights = np.concatenate([[0], np.cumsum(right)])
        lefts = np.arange(n + 1) - rights
        here = np.arange(n)
        is_left = right == 0
        after[at[is_left]] += (rights[here] - rights[first])[is_left]
        before[at[~is_left]] += (lefts[last] - lefts[here])[~is_left]
    return after, before


def _strip_counts(rows: DataFrame, strip: str, sort: list[str]) -> DataFrame:
    """(doc_id, comp, r1, n_in, n_out) of inversions between rows of one strip, in the order of sort."""
    ship(rows.sparkSession)
    kind = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def count(table: pa.Table) -> pa.Table:
        order = np.lexsort([table[c].to_numpy() for c in reversed(sort)])
        after, before = inversions(table["r2"].to_numpy()[order])
        return pa.table({c: table[c].take(order) for c in ("doc_id", "comp", "r1")} | {"n_in": after, "n_out": before})

    return rows.groupBy("doc_id", "comp", strip).applyInArrow(count, f"doc_id {kind['doc_id']}, comp {kind['comp']}, r1 int, n_in bigint, n_out bigint")


def _whole_strips(rows: DataFrame) -> DataFrame:
    """(doc_id, comp, r1, n_in, n_out) of inversions between rows that differ in both strips, from counts by strip and strip."""
    keys = ["doc_id", "comp"]
    cells = rows.groupBy(*keys, "s", "t").agg(F.count("*").alias("m"))
    strips = rows.groupBy(*keys).agg(F.max("s").alias("top"))
    grid = strips.select(*keys, F.explode(F.sequence(F.lit(0), "top")).alias("s"), "top").select(*keys, "s", F.explode(F.sequence(F.lit(0), "top")).alias("t"))
    full = grid.join(cells, [*keys, "s", "t"], "left").fillna(0, ["m"])
    row, column = W.partitionBy(*keys, "s"), W.partitionBy(*keys, "t")
    full = full.withColumn("low", F.sum("m").over(row.orderBy("t").rowsBetween(W.unboundedPreceding, -1))).withColumn("high", F.sum("m").over(row.orderBy(F.desc("t")).rowsBetween(W.unboundedPreceding, -1)))
    full = full.withColumn("n_in", F.sum("low").over(column.orderBy(F.desc("s")).rowsBetween(W.unboundedPreceding, -1))).withColumn("n_out", F.sum("high").over(column.orderBy("s").rowsBetween(W.unboundedPreceding, -1)))
    some = full.select(*keys, "s", "t", F.coalesce("n_in", F.lit(0)).alias("n_in"), F.coalesce("n_out", F.lit(0)).alias("n_out")).filter("n_in + n_out > 0")
    return rows.join(some, [*keys, "s", "t"]).select(*keys, "r1", "n_in", "n_out")


def with_containment(found: DataFrame, small: int = SMALL, strip: int = STRIP) -> DataFrame:
    """found (with comp) and n_inside, n_around: how many others of its component a span contains and is contained by; equal spans contain each other.

    Rows that share a seq are one detection in several places: they don't count for each other, and their counts are added up.
    """
    group, mine = W.partitionBy("doc_id", "comp"), W.partitionBy("doc_id", "comp", "seq")
    sized = found.withColumn("size_", F.count("*").over(group))
    inside = lambda a, b: (a["gstart"] <= b["gstart"]) & (b["gend"] <= a["gend"])
    held = lambda spans, test: F.when(F.col("size_") > 1, F.size(F.filter(spans, test)).cast("long")).otherwise(F.lit(0).cast("long"))
    own = {c: F.col(c) for c in ("gstart", "gend", "seq")}

    few = sized.withColumn("spans_", F.collect_list(F.when(F.col("size_").between(2, small), F.struct("gstart", "gend", "seq"))).over(group)).filter(F.col("size_") <= small)
    few = few.withColumn("n_inside", held("spans_", lambda o: (o["seq"] != F.col("seq")) & inside(own, o)))
    few = few.withColumn("n_around", held("spans_", lambda o: (o["seq"] != F.col("seq")) & inside(o, own))).drop("spans_", "size_")

    # Of equal spans the ranks order one way; the other way is their place among themselves.
    equal = W.partitionBy("doc_id", "comp", "gstart", "gend")
    many = ranked(sized.filter(F.col("size_") > small), "doc_id", "comp")
    many = many.withColumn("nth_", F.row_number().over(equal.orderBy("r1"))).withColumn("of_", F.count("*").over(equal)).withColumn("spans_", F.collect_list(F.struct("gstart", "gend")).over(mine))
    cut = many.select("doc_id", "comp", "r1", "r2", (F.col("r1") / strip).cast("int").alias("s"), (F.col("r2") / strip).cast("int").alias("t"), "size_")
    across = cut.filter(F.col("size_") > strip).drop("size_")
    parts = _strip_counts(cut.drop("size_"), "s", ["r1"]).unionByName(_strip_counts(across, "t", ["s", "r2"])).unionByName(_whole_strips(across))
    counts = parts.groupBy("doc_id", "comp", "r1").agg(F.sum("n_in").alias("in_"), F.sum("n_out").alias("out_"))
    many = many.join(counts, ["doc_id", "comp", "r1"])
    mine_held = lambda test: F.size(F.filter("spans_", test)).cast("long")
    many = many.withColumn("n_inside", F.col("in_") + F.col("nth_") - mine_held(lambda o: inside(own, o)))
    many = many.withColumn("n_around", F.col("out_") + F.col("of_") - F.col("nth_") + 1 - mine_held(lambda o: inside(o, own)))

    # One shuffle by document serves the sums here and the choice of winners.
    out, detection = few.unionByName(many.select(few.columns)).repartition("doc_id"), W.partitionBy("doc_id", "seq")
    return out.withColumns({c: F.sum(c).over(detection) for c in ("n_inside", "n_around")})
