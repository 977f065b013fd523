"""Duplicate resolution: overlap graphs over closed intervals, components, winners, and keyed first-wins distincts.

Detections are rows (doc_id, seq, entity, gstart, gend, origin, ...), gend included; seq is the input order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.functions.values import ENTITIES, entity_rank, stripped
from spanloom.operators import graph, sweep

ORIGINS = ("manual", "custom", "auto")
TIE_BREAK = ("origin", "contain", "length", "position", "entity")


def related(a0: Column, a1: Column, b0: Column, b1: Column, mode: str) -> Column:
    """exact, contain (either way) or overlap of two closed intervals."""
    if mode == "exact":
        return (a0 == b0) & (a1 == b1)
    if mode == "contain":
        return ((a0 <= b0) & (b1 <= a1)) | ((b0 <= a0) & (a1 <= b1))
    return (a0 <= b1) & (b0 <= a1)


def edges(found: DataFrame, overlap: str = "overlap", entities: str = "any") -> DataFrame:
    """(doc_id, i, j) with i < j.  entities "same" asks for equal types, or containment where one is a proper noun."""
    a = found.select("doc_id", F.col("seq").alias("i"), F.col("entity").alias("ea"), F.col("gstart").alias("a0"), F.col("gend").alias("a1"))
    b = found.select(F.col("doc_id").alias("d"), F.col("seq").alias("j"), F.col("entity").alias("eb"), F.col("gstart").alias("b0"), F.col("gend").alias("b1"))
    spans = [F.col(c) for c in ("a0", "a1", "b0", "b1")]
    on = (F.col("doc_id") == F.col("d")) & (F.col("i") < F.col("j")) & related(*spans, overlap)
    if entities == "same":
        noun = (F.col("ea") == "PROPER_NOUN") | (F.col("eb") == "PROPER_NOUN")
        on = on & ((F.col("ea") == F.col("eb")) | (noun & related(*spans, "contain")))
    return a.join(b, on).select("doc_id", "i", "j")


def components(found: DataFrame, overlap: str = "overlap", entities: str = "any") -> DataFrame:
    """found with comp, the smallest seq of the component that edges() of these modes make, without making the edges.

    Exact is a group, overlap gaps and islands, containment a running maximum over ranks: windows.  Among the same entities
    a proper noun joins what it contains or lies in, so each entity is taken with the nouns beside it, and what several
    entities' blocks share through a noun is joined by a few links between blocks.
    """
    noun = F.col("entity") == "PROPER_NOUN"
    if overlap == "exact":
        keys = ["doc_id", "gstart", "gend"]
        if entities == "any":
            return found.withColumn("comp", F.min("seq").over(W.partitionBy(*keys)))
        # Equal spans: one noun joins them all.
        rows = found.withColumn("with_noun", F.max(noun).over(W.partitionBy(*keys)))
        same, all_ = F.min("seq").over(W.partitionBy(*keys, "entity")), F.min("seq").over(W.partitionBy(*keys))
        return rows.withColumn("comp", F.when(F.col("with_noun"), all_).otherwise(same)).drop("with_noun")
    if entities == "any":
        blocks = sweep.overlap_blocks if overlap == "overlap" else sweep.contain_blocks
        return blocks(found, "doc_id").withColumnRenamed("block", "comp")
    with_kinds = found.withColumn("kinds", F.collect_set("entity").over(W.partitionBy("doc_id")))
    if overlap == "contain":
        # Windows over documents throughout: the rows are dealt once, as the caller wants it.
        beside = with_kinds.select(*found.columns, F.posexplode(F.when(noun, F.col("kinds")).otherwise(F.array("entity"))).alias("nth_", "side"))
        named = sweep.contain_blocks(beside, "doc_id", "side").withColumn("first", F.min("block").over(W.partitionBy("doc_id", "seq")))
        links = named.filter("block <> first").select("doc_id", F.col("block").alias("u"), F.col("first").alias("v"))
        return _joined(named.filter("nth_ = 0").select(*found.columns, "first"), links)
    own = sweep.overlap_blocks(with_kinds, "doc_id", "entity").withColumnRenamed("block", "first")
    sides = F.when(noun, F.array_except("kinds", F.array(F.lit("PROPER_NOUN")))).otherwise(F.array("entity"))
    beside = own.select("doc_id", "seq", "gstart", "gend", "first", noun.alias("noun"), F.explode(sides).alias("side"))
    # All nouns that contain a span overlap there, so they are one block already: the furthest reaching one stands for them, and the other way round.
    upto = W.partitionBy("doc_id", "side").orderBy("gstart").rangeBetween(W.unboundedPreceding, W.currentRow)
    reach = lambda test: F.max(F.when(test, F.struct("gend", "first"))).over(upto)
    other = F.when(F.col("noun"), F.col("of_side")).otherwise(F.col("of_noun"))
    links = beside.withColumn("of_noun", reach(F.col("noun"))).withColumn("of_side", reach(~F.col("noun"))).withColumn("other", other)
    return _joined(own.drop("kinds"), links.filter(F.col("other.gend") >= F.col("gend")).select("doc_id", F.col("first").alias("u"), F.col("other.first").alias("v")))


def _joined(found: DataFrame, links: DataFrame) -> DataFrame:
    """found with comp from first, its block, where links join blocks."""
    roots = graph.components(links).select("doc_id", F.col("id").alias("first"), "root")
    return found.join(roots, ["doc_id", "first"], "left").withColumn("comp", F.coalesce("root", "first")).drop("first", "root")


def labelled(found: DataFrame, links: DataFrame) -> DataFrame:
    """found with comp, the smallest seq that links (doc_id, i, j) join each row to."""
    roots = graph.components(links.select("doc_id", F.col("i").alias("u"), F.col("j").alias("v"))).select("doc_id", F.col("id").alias("seq"), "root")
    return found.join(roots, ["doc_id", "seq"], "left").withColumn("comp", F.coalesce("root", "seq").cast("long")).drop("root")


def winners(found: DataFrame, tie_break=TIE_BREAK, origins=ORIGINS, entities=ENTITIES, length: str = "long", position: str = "first") -> DataFrame:
    """The best detection of each component, by the named keys in turn and the input order at last."""
    rows = sweep.with_containment(found) if "contain" in tie_break else found
    size = F.col("gend") - F.col("gstart") + 1
    origins = [*origins, *(o for o in ORIGINS if o not in origins)]
    keys = {
        "origin": [entity_rank(F.col("origin"), origins)],
        "contain": [F.col("n_inside").desc(), F.col("n_around").asc()] if "contain" in tie_break else [],
        "length": [size.desc() if length == "long" else size.asc()],
        "position": [F.col("gstart").asc() if position == "first" else F.col("gstart").desc()],
        "entity": [entity_rank(F.col("entity"), entities)],
    }
    order = W.partitionBy("doc_id", "comp").orderBy(*[k for t in tie_break for k in keys[t]], "seq")
    return rows.withColumn("rn", F.row_number().over(order)).filter("rn = 1").drop("rn", "n_inside", "n_around")


def resolve(found: DataFrame, overlap: str = "overlap", entities: str = "any", **options) -> DataFrame:
    """One detection a component; comp, the least seq of its component, gives the order for who wants one."""
    return winners(components(found, overlap, entities), **options)


def first_wins(found: DataFrame, *keys: str) -> DataFrame:
    """The earliest row of each key."""
    return found.withColumn("rn", F.row_number().over(W.partitionBy(*keys).orderBy("seq"))).filter("rn = 1").drop("rn")


def auto_over_custom(found: DataFrame) -> DataFrame:
    """Custom rows go where an automatic one has the same entity and span."""
    has_auto = F.max(F.col("origin") == "auto").over(W.partitionBy("doc_id", "entity", "gstart", "gend"))
    return found.withColumn("a", has_auto).filter("NOT (a AND origin = 'custom')").drop("a")


def span_key(entity: Column, start: Column, end: Column) -> Column:
    """(entity, six whole numbers) of a detection; a number that can't be read is -1."""
    whole = lambda p: [F.coalesce(p[c].cast("string").try_cast("int"), F.lit(-1)) for c in ("page_num", "block_num", "offset")]
    return F.struct(F.coalesce(entity, F.lit("")).alias("entity"), *[x.alias(f"k{i}") for i, x in enumerate([*whole(start), *whole(end)])])


def merged(*found: DataFrame) -> DataFrame:
    """The lists one after another: rows with seq anew, those of an earlier list first."""
    out = None
    for k, rows in enumerate(found):
        rows = rows.withColumn("turn", F.lit(k))
        out = rows if out is None else out.unionByName(rows)
    return out.withColumn("seq", F.row_number().over(W.partitionBy("doc_id").orderBy("turn", "seq")).cast("long")).drop("turn")


def detect_input(read: DataFrame, panel: DataFrame) -> DataFrame:
    """The panel's rows of documents that have some, what was read of the others."""
    return panel.unionByName(read.join(panel.select("doc_id").distinct(), "doc_id", "left_anti"))


def first_entities(found: DataFrame) -> DataFrame:
    """(doc_id, word, entity): the first entity of each word, OTHER where it has none; blank words are left out."""
    rows = first_wins(found.withColumn("word", stripped(F.col("word"))).filter("word <> ''"), "doc_id", "word")
    return rows.select("doc_id", "word", F.coalesce(F.nullif("entity", F.lit("")), F.lit("OTHER")).alias("entity"))


def scoped_replace(base: DataFrame, new: DataFrame, pages: DataFrame) -> DataFrame:
    """base outside the pages (doc_id, page_num), new inside them."""
    keys = ["doc_id", "page_num"]
    return base.join(pages, keys, "left_anti").unionByName(new.join(pages, keys, "left_semi"))


def without_automatic(found: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """Manual rows, and the automatic ones outside the scope."""
    manual = F.col("origin") == "manual"
    if pages is None:
        return found.filter(manual)
    scope = pages.select("doc_id", "page_num", F.lit(True).alias("in_scope"))
    return found.join(scope, ["doc_id", "page_num"], "left").filter(manual | F.col("in_scope").isNull()).drop("in_scope")


def without_words(found: DataFrame, words: list[str]) -> DataFrame:
    return found.filter((F.col("origin") == "manual") | ~F.col("word").isin(*words)) if words else found


def unmatched(new: DataFrame, existing: DataFrame) -> DataFrame:
    """new rows whose entity and span no existing row has."""
    return new.join(existing, ["doc_id", "entity", "gstart", "gend"], "left_anti")


def manual_additions(existing: DataFrame, new: DataFrame) -> DataFrame:
    """new rows, each once, that no existing row equals in word, entity and span."""
    keys = ["doc_id", "word", "entity", "gstart", "gend"]
    return first_wins(new, *keys).join(existing, keys, "left_anti")
