"""MinHash near-dedup with tensored banding.

A table's key is a pair: one key of a left collection and one of a right collection, each made of two minhashes.  With
10 + 10 half keys (40 minhashes) there are 100 tables of four-minhash keys, where plain banding would compute 400.  A pair
of similarity 0.85 misses all tables with probability 5e-6.

Candidates are verified on full shingle sets.  Buckets never emit all their pairs.  Equal sets are merged first.  The
(key, document) rows of all tables are sorted once, by ranges of both, so that a hot bucket spreads over tasks, and each
document is compared with the first one of its bucket there.  The links found form components.  Every pair of a bucket whose ends then
still lie in different components is compared as well, in one of two ways of the same result: as pairs where a bucket has
at most SMALL members, and beyond that, after PIVOTS members have met all others, block against block, from which only
links leave.  Blocks are dealt by families, that is buckets that share members.

Components join the table at one row a document, which holds its bucket keys as an array (HALVES * HALVES at most).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.llm.common import LOWER, UPPER, read, saved, ship, unused, written
from spanloom.llm.components import components

#: Half keys a side, minhashes in a half key, and rows up to which ids are broadcast rather than shuffled.
HALVES, PER_HALF, BROADCAST_IDS = 10, 2, 1_000_000
#: Members up to which a bucket pairs its components' members; further pivots of a large bucket; shingles in a block.
SMALL, PIVOTS, BLOCK = 16, 2, 200_000
_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word n-grams; of the whole sequence if it has fewer words; empty if none."""
    tokens = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not tokens:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, len(tokens))
    n = max(1, len(h) - words + 1)
    out = np.full(n, len(h) if len(h) < words else words, np.uint64)
    for i in range(min(words, len(h))):
        out = _mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n])
    return np.unique(out)


def _mixed(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of public-domain SplitMix."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def minhashes(shingles: np.ndarray, count: int, seed: int) -> np.ndarray:
    """count minima over the set, each under its own multiplication and shift."""
    rng = np.random.default_rng(seed)
    odd, plus = rng.integers(0, 1 << 63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, count, dtype=np.uint64)
    out = np.empty(count, np.uint64)
    for i in range(count):
        x = (shingles ^ plus[i]) * odd[i]
        out[i] = (x ^ (x >> np.uint64(32))).min()
    return out


def half_keys(shingles: np.ndarray, seed: int) -> np.ndarray:
    """2 * HALVES half keys, left collection first."""
    m = minhashes(shingles, 2 * HALVES * PER_HALF, seed).reshape(2 * HALVES, PER_HALF)
    out = np.arange(2 * HALVES, dtype=np.uint64)
    for i in range(PER_HALF):
        out = _mixed(out * np.uint64(0x9E3779B97F4A7C15) + m[:, i])
    return out.astype(np.int64)


def signatures(docs: DataFrame, words: int, seed: int) -> DataFrame:
    """(doc_id, n_shingles, fp, left, right) of (doc_id, text)."""
    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        longs = pa.list_(pa.int64())
        for batch in batches:
            sets = [shingle_set(t, words) for t in batch.column(1).to_pylist()]
            keys = [half_keys(s, seed) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).hexdigest() if len(s) else None for s in sets], pa.string()),
                    pa.array([None if k is None else k[:HALVES] for k in keys], longs),
                    pa.array([None if k is None else k[HALVES:] for k in keys], longs),
                ],
                ["doc_id", "n_shingles", "fp", "left", "right"],
            )

    return docs.mapInArrow(run, f"doc_id {kind}, n_shingles bigint, fp string, left array<bigint>, right array<bigint>")


def shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, s): the whole set as array<bigint>."""
    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t, words).view(np.int64) for t in batch.column(1).to_pylist()]
            ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            flat = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*sets, np.empty(0, np.int64)])))
            yield pa.RecordBatch.from_arrays([batch.column(0), flat], ["doc_id", "s"])

    return docs.mapInArrow(run, f"doc_id {kind}, s array<bigint>")


def only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs whose doc_id is among ids: by broadcast up to BROADCAST_IDS ids, by shuffle beyond."""
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", "left_semi")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(u, v) pairs whose sets have 100 * intersection >= percent * union."""
    a, b = sets.select(F.col("doc_id").alias("v"), F.col("s").alias("sv")), sets.select(F.col("doc_id").alias("u"), F.col("s").alias("su"))
    both = pairs.join(a, "v").join(b, "u")
    sizes = (F.size("su") * 100 >= F.size("sv") * percent) & (F.size("sv") * 100 >= F.size("su") * percent)
    both = both.filter(sizes).withColumn("n", F.size(F.array_intersect("su", "sv")))
    return both.filter(F.col("n") * (100 + percent) >= percent * (F.size("su") + F.size("sv"))).select("u", "v")


def bucketed(reps: DataFrame) -> DataFrame:
    """(key, doc_id, head): members of buckets of two or more, each but the first with its bucket's first one in the task.

    One sort by ranges of (key, doc_id) serves all tables.  A bucket cut by ranges' borders is joined again through the
    first and last row of each range, of which there are two a task.
    """
    tables = reps.select("doc_id", F.posexplode("left").alias("i", "l"), "right").select("doc_id", "i", "l", F.posexplode("right").alias("j", "r"))
    keys = tables.select(F.xxhash64("i", "j", "l", "r").alias("key"), "doc_id")
    kind = reps.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail, before, first = None, (None, None), True  # the row whose next isn't known, (key, head) of the one before it, whether it starts the range

        def put(rows: pa.Table, ahead: int | None) -> pa.RecordBatch:
            """Members among the rows and the range's borders; ahead is the next row's key, None at the range's end."""
            nonlocal before, first
            key, ids = rows.column("key").to_numpy(), rows.column("doc_id").combine_chunks()
            n = len(key)
            same = np.r_[before[0] is not None and before[0] == key[0], key[1:] == key[:-1]]
            edge = np.zeros(n, bool)
            edge[0], edge[-1] = first, ahead is None
            # Place of each row's head in (the head from before, ids).
            head = np.maximum.accumulate(np.where(same, 0, np.arange(1, n + 1)))
            heads = pa.concat_arrays([pa.array([before[1]], ids.type), ids])
            take = np.flatnonzero(same | np.r_[same[1:], ahead is not None and ahead == key[-1]] | edge)
            out = [pa.array(key[take]), ids.take(take), heads.take(pa.array(head[take], mask=~same[take])), pa.array(edge[take])]
            before, first = (int(key[-1]), heads[int(head[-1])].as_py()), False
            return pa.RecordBatch.from_arrays(out, ["key", "doc_id", "head", "edge"])

        for batch in batches:
            rows = pa.Table.from_batches([batch] if tail is None else [*tail.to_batches(), batch])
            n = rows.num_rows - 1
            if n > 0:
                yield put(rows.slice(0, n), rows.column("key")[n].as_py())
            tail = rows.slice(n) if n >= 0 else tail
        if tail is not None and tail.num_rows:
            yield put(tail, None)

    rows = written(keys.repartitionByRange("key", "doc_id").sortWithinPartitions("key", "doc_id").mapInArrow(run, f"key bigint, doc_id {kind}, head {kind}, edge boolean"))
    border = rows.filter("edge").withColumn("lag", F.lag("doc_id").over(Window.partitionBy("key").orderBy("doc_id")))
    return rows.filter("NOT edge").drop("edge").union(border.select("key", "doc_id", F.coalesce("head", "lag")))


def _labelled(per_doc: DataFrame, roots: DataFrame) -> DataFrame:
    """(key, doc_id, c, size, head) of buckets that hold several components; of buckets with the same members one stands for all.

    per_doc holds (doc_id, keys); components join it at one row a document, before its keys are spread.
    """
    rows = per_doc.join(roots.select(F.col("id").alias("doc_id"), "component_id"), "doc_id", "left").select("doc_id", F.coalesce("component_id", "doc_id").alias("c"), F.explode("keys").alias("key"))
    h = F.xxhash64("doc_id")
    mixed = rows.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("size"), F.bit_xor(h).alias("x"), F.sum(F.shiftrightunsigned(h, 33)).alias("y"), F.min("doc_id").alias("head")).filter("lo <> hi")
    mixed = saved(mixed.groupBy("lo", "hi", "size", "x", "y").agg(F.min(F.struct("key", "head")).alias("b")).select("b.key", "b.head", "size"))
    return rows.join(mixed, "key").select("key", "doc_id", "c", "size", "head")


def _unsettled(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """(doc_id, c, head) of the buckets (key, doc_id, head) that still hold several components of roots; nothing is joined to them a second time."""
    per_doc = rows.groupBy("doc_id").agg(F.collect_list(F.struct("key", "head")).alias("b"))
    now = per_doc.join(roots.select(F.col("id").alias("doc_id"), "component_id"), "doc_id", "left").select("doc_id", F.coalesce("component_id", "doc_id").alias("c"), F.inline("b"))
    mixed = now.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo <> hi").select("key")
    return now.join(saved(mixed), "key", "left_semi").select("doc_id", "c", "head").distinct()


def _cross(rows: DataFrame) -> DataFrame:
    """Pairs across components, for buckets of at most SMALL members."""
    a, b = rows.select("key", F.col("doc_id").alias("u"), F.col("c").alias("cu")), rows.select("key", F.col("doc_id").alias("v"), F.col("c").alias("cv"))
    return a.join(b, "key").filter("u < v AND cu <> cv").select("u", "v")


def _pivoted(rows: DataFrame) -> DataFrame:
    """Pairs of documents with the pivots of the largest bucket of each; the rest of large buckets is left to _rest."""
    rows = rows.groupBy("doc_id", "c").agg(F.max(F.struct("size", "key")).alias("x")).select("doc_id", "c", "x.key")
    out = None
    for r in range(PIVOTS):
        salt = F.xxhash64("doc_id", F.lit(r))
        pivot = rows.groupBy("key").agg(F.min(F.struct(salt.alias("h"), F.col("doc_id").alias("p"), F.col("c").alias("cp"))).alias("x")).select("key", "x.p", "x.cp")
        some = rows.join(pivot, "key").filter("cp <> c").select(F.least("p", "doc_id").alias("u"), F.greatest("p", "doc_id").alias("v"))
        out = some if out is None else out.union(some)
    return out


def _block_links(frame: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links of the block's queries with its members of other components: one for each query and component."""
    few, all_ = frame[frame["query"]], frame[~frame["query"]]
    us: list = []
    vs: list = []
    if len(few) and len(all_):
        ids, comps, sizes = all_["doc_id"].to_numpy(), all_["c"].to_numpy(), all_["s"].map(len).to_numpy()
        flat, owner = np.concatenate(list(all_["s"])), np.repeat(np.arange(len(all_)), sizes)
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        for u, c, s in zip(few["doc_id"], few["c"], few["s"]):
            lo, hi = np.searchsorted(flat, s, "left"), np.searchsorted(flat, s, "right")
            n = hi - lo
            at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            shared = np.bincount(owner[at], minlength=len(ids))
            hit = np.flatnonzero((shared * (100 + percent) >= percent * (len(s) + sizes)) & (comps != c))
            _, first = np.unique(comps[hit], return_index=True)
            us += [u] * len(first)
            vs += ids[hit[first]].tolist()
    return pd.DataFrame({"u": us, "v": vs})


def _rest(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The exact way for what is left of large buckets (doc_id, c, head): new links (u, v).  Buckets meet in their smallest member, the head."""
    families = components(rows.select(F.col("head").alias("u"), F.col("doc_id").alias("v")))
    members = rows.select("doc_id", "c").distinct().join(families.select(F.col("id").alias("doc_id"), "component_id"), "doc_id", "left")
    members = members.select("doc_id", "c", F.coalesce("component_id", "doc_id").alias("family"))
    members = saved(members.join(sets.select("doc_id", F.size("s").cast("long").alias("n")), "doc_id"))
    sizes = members.groupBy("family", "c").agg(F.sum("n").alias("n"))
    sizes = sizes.groupBy("family").agg(F.max(F.struct("n", "c")).alias("x"), F.sum("n").alias("n")).select("family", F.col("x.c").alias("top"), F.ceil(F.col("n") / BLOCK).cast("int").alias("nj"), F.ceil((F.col("n") - F.col("x.n")) / BLOCK).cast("int").alias("ni"))
    dealt = members.drop("n").join(sizes, "family").join(sets, "doc_id")
    at, kind = F.xxhash64("doc_id", F.lit("block")), rows.schema["doc_id"].dataType.simpleString()
    queries = dealt.filter("c <> top").select("family", F.pmod(at, "ni").cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("nj") - 1)).alias("j"), F.lit(True).alias("query"), "doc_id", "c", "s")
    against = dealt.filter("ni > 0").select("family", F.explode(F.sequence(F.lit(0), F.col("ni") - 1)).alias("i"), F.pmod(at, "nj").cast("int").alias("j"), F.lit(False).alias("query"), "doc_id", "c", "s")
    return queries.union(against).groupBy("family", "i", "j").applyInPandas(lambda frame: _block_links(frame, percent), f"u {kind}, v {kind}")


def _stars(roots: DataFrame) -> DataFrame:
    """Components as links."""
    return roots.select(F.col("id").alias("u"), F.col("component_id").alias("v"))


def near_links(reps: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """(id, component_id) over reps (doc_id, left, right), one for each distinct set."""
    members = bucketed(reps)
    tested = saved(members.filter("head IS NOT NULL").select(F.col("head").alias("u"), F.col("doc_id").alias("v")).distinct())
    per_doc = written(members.groupBy("doc_id").agg(F.collect_list("key").alias("keys")))
    sets = written(shingle_sets(only(docs, per_doc.select("doc_id")), words))
    roots = components(verified(tested, sets, percent))
    rows = written(_labelled(per_doc, roots))
    large = rows.filter(F.col("size") > SMALL)
    pairs = _cross(rows.filter(F.col("size") <= SMALL)).union(_pivoted(large)).distinct()
    found = saved(verified(pairs.join(tested, ["u", "v"], "left_anti"), sets, percent))
    if not found.isEmpty():
        roots = components(_stars(roots).union(found))
    if not large.isEmpty():
        left = written(_unsettled(large, roots))
        if not left.isEmpty():
            found = saved(_rest(left, sets, percent))
            if not found.isEmpty():
                roots = components(_stars(roots).union(found))
    return roots


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, seed: int = 11) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Null, empty and blank texts have the empty set and link with nothing, each other included.  Of a component the
    smallest doc_id is kept; rows that repeat it are that document again.  Null ids link with nothing (component null,
    kept).  Ids may be of any type that sorts; texts may be of any length, and their whole sets are compared.  Other columns
    play no part; an empty table gives no rows.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    sig = saved(signatures(texts, words, seed))
    full = sig.filter("fp IS NOT NULL AND doc_id IS NOT NULL")
    groups = saved(full.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    reps = saved(full.join(groups, "fp").filter("doc_id = rep").select("doc_id", "left", "right"))
    roots = near_links(reps, texts, words, percent)
    heads = saved(groups.join(roots.withColumnRenamed("id", "rep"), "rep", "left").select("fp", F.coalesce("component_id", "rep").alias("root")))
    out = sig.select("doc_id", "n_shingles", "fp").join(heads, "fp", "left").withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.expr("doc_id <=> component_id").alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with one document of each near-duplicate component, all columns untouched."""
    lost = unused(docs.columns, "lost_id")
    dropped = near_duplicates(docs, id_col, text_col, **options).filter("NOT kept").select(F.col("doc_id").alias(lost)).distinct()
    return docs.join(dropped, docs[id_col] == dropped[lost], "left_anti")


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), words=3, percent=85)
