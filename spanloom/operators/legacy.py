"""The older duplicate resolution: half-open lengths, quads on pages, keep policies, and its own tie-break.

Rows are (doc_id, seq, entity, origin, start, end) for text, (doc_id, seq, page_num, entity, origin, quads) for rectangles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.functions import geometry as G
from spanloom.functions.values import entity_rank
from spanloom.operators import resolve
from spanloom.shipping import apart, spread

KEEP = ("widest", "first", "last", "entity-order")
TIE_BREAK = ("origin", "length", "entity", "position")
ORIGINS = ("manual", "addition", "auto")


def _rects(quads: Column) -> Column:
    return F.transform(quads, lambda q: G.rect(*[q[i] for i in range(4)]))


def quad_edges(found: DataFrame, overlap: str = "overlap") -> DataFrame:
    """(doc_id, i, j): rectangles of one page that are the same, contain each other, or share an area."""
    a = found.select("doc_id", "page_num", F.col("seq").alias("i"), _rects(F.col("quads")).alias("qa"), G.rounded_quads(F.col("quads")).alias("sa"))
    b = found.select(F.col("doc_id").alias("d"), F.col("page_num").alias("p"), F.col("seq").alias("j"), _rects(F.col("quads")).alias("qb"), G.rounded_quads(F.col("quads")).alias("sb"))
    on = (F.col("doc_id") == F.col("d")) & (F.col("page_num") == F.col("p")) & (F.col("i") < F.col("j"))
    if overlap == "exact":
        return a.join(b, on & (F.col("sa") == F.col("sb"))).select("doc_id", "i", "j")
    within = lambda x, y: F.forall(x, lambda q: F.exists(y, lambda r: G.contains(r, q)))
    meets = (within(F.col("qa"), F.col("qb")) | within(F.col("qb"), F.col("qa"))) if overlap == "contain" else F.exists("qa", lambda q: F.exists("qb", lambda r: G.intersects(q, r)))
    return a.join(b, on & meets).select("doc_id", "i", "j")


def _cell_edges(found: DataFrame) -> DataFrame:
    """quad_edges() of overlap, through grid cells: rectangles that share an area share the cell of its first corner."""
    cell = ["doc_id", "page_num", "gx", "gy"]
    r, q = F.col("r"), F.col("q")
    rects = found.select("doc_id", "page_num", F.col("seq").alias("i"), F.explode(_rects(F.col("quads"))).alias("r")).filter("r.x1 > r.x0 AND r.y1 > r.y0")
    cells = rects.select("doc_id", "page_num", "i", "r", F.explode(G.grid_cells(r)).alias("g")).select("doc_id", "page_num", "i", "r", "g.gx", "g.gy")
    cells = spread(cells, *cell)
    other = cells.select(*cell, F.col("i").alias("j"), r.alias("q"))
    first = (F.floor(F.greatest(r["x0"], q["x0"]) / 50.0) == F.col("gx")) & (F.floor(F.greatest(r["y0"], q["y0"]) / 50.0) == F.col("gy"))
    return cells.join(apart(other), cell).filter((F.col("i") < F.col("j")) & G.intersects(r, q) & first).select("doc_id", "i", "j")


def _quad_components(found: DataFrame, overlap: str) -> DataFrame:
    """Equal quads that meet themselves are one: their first stands for them, so that copies make no pairs."""
    q = _rects(F.col("quads"))
    extent = F.exists(q, lambda r: G.intersects(r, r)) if overlap == "overlap" else F.forall(q, lambda r: G.contains(r, r)) if overlap == "contain" else F.col("quads").isNotNull()
    alike = W.partitionBy("doc_id", "page_num", "quads", "own_")
    rows = found.withColumn("own_", F.when(~F.coalesce(extent, F.lit(False)) | F.col("page_num").isNull(), F.col("seq"))).withColumn("first_", F.min("seq").over(alike)).drop("own_")
    some = rows.filter("seq = first_").drop("first_")
    links = _cell_edges(some) if overlap == "overlap" else quad_edges(some, overlap)
    copies = rows.filter("seq <> first_").select("doc_id", F.col("first_").alias("i"), F.col("seq").alias("j"))
    return resolve.labelled(found, links.unionByName(copies))


def components(found: DataFrame, overlap: str = "overlap") -> DataFrame:
    """found with comp; text by its closed interval, rectangles page by page."""
    if "quads" in found.columns:
        return _quad_components(found, overlap)
    rows = found.withColumn("gstart", F.col("start").cast("long")).withColumn("gend", F.col("end").cast("long"))
    return resolve.components(rows, overlap, "any").drop("gstart", "gend")


def _size(found: DataFrame) -> Column:
    if "quads" in found.columns:
        return F.aggregate(_rects(F.coalesce("quads", F.array().cast("array<array<double>>"))), F.lit(0.0), lambda a, r: a + G.area(r))
    return F.greatest(F.lit(0), F.col("end") - F.col("start"))


def keep(found: DataFrame, overlap: str = "overlap", policy: str = "widest", entities: tuple = ()) -> DataFrame:
    """One row a component: the widest, the first, the last, or the first of the best entity."""
    if policy not in KEEP:
        raise ValueError(f"unknown policy {policy!r}; known: {', '.join(KEEP)}")
    keys = {"widest": [_size(found).desc()], "first": [], "last": [F.col("seq").desc()], "entity-order": [entity_rank(F.col("entity"), entities) if entities else F.lit(0)]}[policy]
    return _best(components(found, overlap), keys)


def tie_break(found: DataFrame, overlap: str = "overlap", keys: tuple = TIE_BREAK, origins: tuple = ORIGINS, entities: tuple = (), length: str = "long", position: str = "first") -> DataFrame:
    """One row a component by the named keys in turn, the input order at last; origins that aren't named follow in their usual order."""
    order = [*origins, *(o for o in ORIGINS if o not in origins)]
    bare = F.lower(F.trim(F.coalesce("origin", F.lit(""))))
    size = _size(found) if "quads" not in found.columns else F.floor(_size(found))
    by = {
        "origin": entity_rank(F.when(bare.isin("manual", "addition"), bare).otherwise("auto"), order).asc(),
        "length": size.desc() if length == "long" else size.asc(),
        "entity": (entity_rank(F.col("entity"), entities) if entities else F.lit(0)).asc(),
        "position": F.col("seq").asc() if position == "first" else F.col("seq").desc(),
    }
    return _best(components(found, overlap), [by[k] for k in keys])


def _best(rows: DataFrame, keys: list[Column]) -> DataFrame:
    return rows.withColumn("rn", F.row_number().over(W.partitionBy("doc_id", "comp").orderBy(*keys, "seq"))).filter("rn = 1").drop("rn", "comp")
