"""Embedding near-dedup by sorted projection passes.

Equal vectors are merged first: one stands for all its copies.  In each pass vectors are ordered by a key of concatenated
random hashes (the signs under the pass's hyperplanes), and each is compared with the WINDOW vectors before and behind it.
The order is made by ranges, so dense places spread over tasks; windows that cross a range's border are compared from the
rows at the borders.  Links of all passes are joined to components.

Passes follow from the number of vectors: so many that a pair at the threshold shares a prefix of the key, which some
WINDOW / 2 vectors share where they lie evenly, in at least one pass but with probability MISS.  Where more vectors share a
prefix than a window holds, the window leaves pairs open.  These prefixes have an exact way: of those whose vectors lie in
several components, all that lie outside the largest are compared with all others, block against block.  So the promise
holds at any density, and dense places cost what their number of pairs costs.

Vectors travel in half precision, with a bound on what that can change in a cosine.  Pairs within the bound of the threshold
are compared again in double precision.  A task sends the links of a spanning forest, not all.  The links inside a
component are counted exactly afterwards, by block pairs, from which only counts leave.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.common import read, saved, ship, written
from spanloom.llm.components import components

#: Members of a block: from BLOCK on a group is dealt to up to SPREAD blocks, and no block is to hold more than MOST.
BLOCK, SPREAD, MOST, TILE = 256, 12, 4096, 1024
THRESHOLD = 0.95
#: Vectors that each is compared with on either side of the order; largest probability that a pair at the threshold meets in no pass.
WINDOW, MISS = 64, 1e-5
#: Bits of a key, and of the prefix that a pair is to share at least and at most.
KEY_BITS, LEAST_BITS, MOST_BITS = 62, 4, 24


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v, dim) without the vectors that link with nothing."""
    v = F.col(vec_col).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.filter(F.col(id_col).isNotNull() & v.isNotNull() & fine)
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"), F.size(vec_col).alias("dim"))


def packed(rows: DataFrame, kind: str) -> DataFrame:
    """(vec_id, dim, x) with the vector's bytes: f4 where the column holds no more than that, else f8; no negative zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([(np.array(v) + 0.0).astype(kind).tobytes() for v in lists], pa.binary())], ["vec_id", "dim", "x"])

    return rows.select("vec_id", "dim", "v").mapInArrow(run, "vec_id bigint, dim int, x binary")


def unit(raw: list[bytes], kind: str) -> np.ndarray:
    """Rows of unit length in double precision; scaled first, so that no square overflows."""
    x = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def hashes(x: np.ndarray, passes: int, bits: int, seed: int) -> np.ndarray:
    """One number of so many bits a vector and pass: the concatenated signs."""
    planes = np.random.default_rng([seed, x.shape[1]]).standard_normal((x.shape[1], passes * bits))
    signs = (x @ planes >= 0).reshape(len(x), passes, bits)
    return signs.astype(np.int64) @ (1 << np.arange(bits - 1, -1, -1, dtype=np.int64))


def plan(n: int, threshold: float, window: int = WINDOW, miss: float = MISS) -> tuple[int, int]:
    """(bits of a prefix, passes) for n different vectors."""
    bits = min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(max(1, 2 * n / window)))))
    meets = (1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi) ** bits
    return bits, 1 if meets > 1 - miss else math.ceil(math.log(miss) / math.log1p(-meets))


def slack(dim: int) -> float:
    """What half precision can change in a cosine of vectors with so many components, rounding in the product included."""
    off = 2**-11 + math.sqrt(dim) * 2**-25
    return 2 * off + off * off + dim * 2**-23


def dealt(rows: DataFrame, keys: list[str], block: int) -> DataFrame:
    """Rows of each group dealt to blocks ``own``, once for each pair of blocks (i, j) that holds them."""
    size = F.col("size")
    blocks = F.greatest(F.least(F.ceil(size / block), F.lit(SPREAD)), F.ceil(size / F.lit(MOST))).cast("int")
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("size")).select(*keys, blocks.alias("blocks")).filter("blocks > 1")
    out = rows.join(sizes, keys, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    out = out.withColumn("own", F.expr("int(pmod(xxhash64(vec_id), blocks))")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    out = out.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("blocks", "other")
    # Dealt by block pair: what is already dealt by its group alone would put a large one's pairs into a single task.
    return out.repartition(*keys, "i", "j")


def _tiles(table: pa.Table, kind: str, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places a, places b, whether each a is close to each b) over one pair of blocks; nothing is close to itself."""
    x, own = unit(table.column("x").to_pylist(), kind), table.column("own").to_numpy()
    i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
    left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
    for at in range(0, len(left), TILE):
        some = left[at : at + TILE]
        close = x[some] @ x[right].T >= threshold
        if i == j:
            close[np.arange(len(some)), np.arange(at, at + len(some))] = False
        yield some, right, close


def _joined(n: int, a: np.ndarray, b: np.ndarray, root: np.ndarray | None = None) -> np.ndarray:
    """The least place that links (a, b) join each of n places to, given what root has joined before."""
    root = np.arange(n) if root is None else root
    while len(a):
        a, b = root[a], root[b]
        apart = a != b
        a, b = a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
    return root


def in_windows(ids: np.ndarray, x: np.ndarray, window: int, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(u, v, sure) over rows in order: a forest of the links that half precision shows, then the pairs that it leaves open."""
    n, off = len(ids), slack(x.shape[1])
    place = np.argsort(np.argsort(ids, kind="stable"), kind="stable")  # so that forests grow from the smallest id
    root, open_ = np.arange(n), []
    for at in range(0, n, TILE):
        mine, theirs = x[at : at + TILE], x[at : at + TILE + window]
        cosine = mine @ theirs.T
        i, j = np.nonzero(cosine >= threshold - off)
        near = (j > i) & (j <= i + window)
        i, j = i[near], j[near]
        sure = cosine[i, j] >= threshold + off
        root = _joined(n, place[at + i[sure]], place[at + j[sure]], root)
        open_.append((at + i[~sure], at + j[~sure]))
    by_place = np.empty(n, ids.dtype)
    by_place[place] = ids
    moved = np.flatnonzero(root != np.arange(n))
    i, j = (np.concatenate([o[k] for o in open_] or [np.empty(0, np.int64)]) for k in (0, 1))
    apart = root[place[i]] != root[place[j]]
    u, v = np.r_[by_place[moved], ids[i[apart]]], np.r_[by_place[root[moved]], ids[j[apart]]]
    return np.maximum(u, v), np.minimum(u, v), np.arange(len(u)) < len(moved)


_LINK = [("u", pa.int64()), ("v", pa.int64()), ("sure", pa.bool_())]
_ROW = [("dim", pa.int32()), ("pass", pa.int32()), ("key", pa.int64()), ("vec_id", pa.int64()), ("h", pa.binary())]


def _links(table: pa.Table, window: int, threshold: float) -> list[np.ndarray]:
    """[u, v, sure] of rows in order, pass by pass."""
    found = []
    marks = np.stack([table.column("dim").to_numpy(), table.column("pass").to_numpy()])
    cuts = np.flatnonzero(np.r_[True, (marks[:, 1:] != marks[:, :-1]).any(axis=0)]).tolist()
    for a, b in zip(cuts, [*cuts[1:], table.num_rows]):
        if b - a > 1:
            some = table.slice(a, b - a)
            x = np.frombuffer(b"".join(some.column("h").to_pylist()), "<f2").reshape(b - a, -1).astype(np.float32)
            found.append(in_windows(some.column("vec_id").to_numpy(), x, window, threshold))
    return [np.concatenate([f[k] for f in found]) if found else np.empty(0, bool if k == 2 else np.int64) for k in range(3)]


def keyed(whole: DataFrame, kind: str, passes: int, seed: int) -> DataFrame:
    """(vec_id, dim, h, keys): the vector in half precision, of unit length, and its key in every pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(1).to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                for at in range(0, part.num_rows, 1024):
                    some = part.slice(at, 1024)
                    x = unit(some.column(2).to_pylist(), kind)
                    half = pa.array([h.tobytes() for h in x.astype("<f2")], pa.binary())
                    yield pa.RecordBatch.from_arrays([*some.columns[:2], half, pa.array(list(hashes(x, passes, KEY_BITS, seed)), pa.list_(pa.int64()))], ["vec_id", "dim", "h", "keys"])

    return whole.select("vec_id", "dim", "x").mapInArrow(run, "vec_id bigint, dim int, h binary, keys array<bigint>")


def passed(rows: DataFrame, window: int, threshold: float) -> DataFrame:
    """(u, v, sure) over all passes of keyed rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail, seen = None, 0  # the last rows, which the next ones are compared with, and the number of rows so far

        def put(links: list[np.ndarray], rows: pa.Table | None) -> pa.RecordBatch:
            n, m = len(links[0]), rows.num_rows if rows is not None else 0
            columns = [pa.concat_arrays([pa.array(x, t), pa.nulls(m, t)]) for x, (_, t) in zip(links, _LINK)]
            columns += [pa.concat_arrays([pa.nulls(n, t), *([c.cast(t) for c in rows.column(name).chunks] if m else [])]) for name, t in _ROW]
            return pa.RecordBatch.from_arrays(columns, [c for c, _ in _LINK + _ROW])

        for batch in batches:
            if batch.num_rows:
                table = pa.Table.from_batches([batch] if tail is None else [*tail.to_batches(), batch]).combine_chunks()
                first = batch.slice(0, max(0, min(batch.num_rows, window - seen)))
                yield put(_links(table, window, threshold), pa.Table.from_batches([first]))
                seen += batch.num_rows
                tail = table.slice(max(0, table.num_rows - window))
        if tail is not None and seen > window:
            yield put([np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)], tail.slice(max(0, tail.num_rows - (seen - window))))

    def border(table: pa.Table) -> pa.Table:
        links = _links(table.sort_by([("key", "ascending"), ("vec_id", "ascending")]), window, threshold)
        return pa.Table.from_arrays([pa.array(x, t) for x, (_, t) in zip(links, _LINK)], [c for c, _ in _LINK])

    order = ["dim", "pass", "key", "vec_id"]
    spread = rows.select("dim", F.posexplode("keys").alias("pass", "key"), "vec_id", "h")
    ddl = "u bigint, v bigint, sure boolean, dim int, pass int, key bigint, vec_id bigint, h binary"
    found = written(spread.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, ddl))
    # Two windows of rows a range meet here, pass by pass.
    borders = found.filter("pass IS NOT NULL").select(*(c for c, _ in _ROW)).groupBy("dim", "pass").applyInArrow(border, "u bigint, v bigint, sure boolean")
    return written(found.filter("pass IS NULL").select("u", "v", "sure").union(borders).groupBy("u", "v").agg(F.max("sure").alias("sure")))


def confirmed(pairs: DataFrame, whole: DataFrame, kind: str, threshold: float) -> DataFrame:
    """The (u, v) pairs whose vectors reach the threshold in double precision."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                dims = np.array([len(x.as_py()) for x in batch.column(2)])
                for dim in np.unique(dims):
                    some = batch.filter(pa.array(dims == dim))
                    cosine = np.einsum("ij,ij->i", unit(some.column(2).to_pylist(), kind), unit(some.column(3).to_pylist(), kind))
                    yield some.select(["u", "v"]).filter(pa.array(cosine >= threshold))

    a, b = (whole.select(F.col("vec_id").alias(c), F.col("x").alias(f"x{c}")) for c in "uv")
    return pairs.join(a, "u").join(b, "v").select("u", "v", "xu", "xv").mapInArrow(run, "u bigint, v bigint")


def crowded(rows: DataFrame, roots: DataFrame, whole: DataFrame, kind: str, bits: int, window: int, threshold: float) -> DataFrame:
    """The exact way for prefixes that more vectors share than a window holds: (u, v) links between components.

    Each vector outside a prefix's largest component is compared with all vectors of other components there.
    """
    labelled = rows.select("vec_id", "dim", "keys").join(roots.select(F.col("id").alias("vec_id"), "component_id"), "vec_id", "left")
    labelled = labelled.select("vec_id", "dim", F.coalesce("component_id", "vec_id").alias("c"), F.posexplode("keys").alias("pass", "key")).withColumn("key", F.shiftright("key", KEY_BITS - bits))
    keys = ["dim", "pass", "key"]
    mixed = labelled.groupBy(*keys).agg(F.count("*").alias("n"), F.min("c").alias("lo"), F.max("c").alias("hi")).filter(f"n > {window} AND lo <> hi").select(*keys)
    mixed = saved(mixed)
    members = written(labelled.join(mixed, keys))
    sizes = members.groupBy(*keys, "c").agg(F.count("*").alias("n")).groupBy(*keys).agg(F.max(F.struct("n", "c")).alias("x"), F.sum("n").alias("n"))
    sizes = sizes.select(*keys, F.col("x.c").alias("top"), F.ceil((F.col("n") - F.col("x.n")) / MOST).cast("int").alias("ni"), F.ceil(F.col("n") / MOST).cast("int").alias("nj"))
    placed = members.join(sizes, keys).withColumn("at", F.xxhash64("vec_id"))
    asking = placed.filter("c <> top").select(*keys, F.expr("int(pmod(at, ni))").alias("i"), F.explode(F.sequence(F.lit(0), F.col("nj") - 1)).alias("j"), F.lit(True).alias("asks"), "vec_id", "c")
    asked = placed.select(*keys, F.explode(F.sequence(F.lit(0), F.col("ni") - 1)).alias("i"), F.expr("int(pmod(at, nj))").alias("j"), F.lit(False).alias("asks"), "vec_id", "c")

    def links(table: pa.Table) -> pa.Table:
        ids, c, asks = table.column("vec_id").to_numpy(), table.column("c").to_numpy(), table.column("asks").to_numpy()
        us, vs = [], []
        few, all_ = np.flatnonzero(asks), np.flatnonzero(~asks)
        if len(few) and len(all_):
            x = unit(table.column("x").to_pylist(), kind)
            names, group = np.unique(c, return_inverse=True)
            root = np.arange(len(names))
            for at in range(0, len(few), TILE):
                some = few[at : at + TILE]
                for to in range(0, len(all_), TILE):
                    them = all_[to : to + TILE]
                    i, j = np.nonzero((x[some] @ x[them].T >= threshold) & (root[group[some]][:, None] != root[group[them]][None, :]))
                    a, b = group[some[i]], group[them[j]]
                    # One link for each pair of components; what they join needs no more.
                    _, one = np.unique(np.minimum(a, b) * len(names) + np.maximum(a, b), return_index=True)
                    us.append(ids[some[i[one]]])
                    vs.append(ids[them[j[one]]])
                    root = _joined(len(names), a[one], b[one], root)
        u, v = (np.concatenate(w) if w else np.empty(0, np.int64) for w in (us, vs))
        return pa.table({"u": pa.array(np.maximum(u, v), pa.int64()), "v": pa.array(np.minimum(u, v), pa.int64())})

    both = asking.union(asked).join(whole.select("vec_id", "x"), "vec_id")
    return saved(both.groupBy(*keys, "i", "j").applyInArrow(links, "u bigint, v bigint").distinct())


def count_links(members: DataFrame, kind: str, threshold: float, block: int) -> DataFrame:
    """(vec_id, component_id, dim, x, copies) -> (vec_id, n_links): exact links within each component, copies counted."""

    def counted(table: pa.Table) -> pa.Table:
        copies = table.column("copies").to_numpy().astype(np.float64)
        n = np.zeros(len(copies))
        within = table.column("i")[0].as_py() == table.column("j")[0].as_py()
        for left, right, close in _tiles(table, kind, threshold):
            close = close.astype(np.float64)
            n[left] += close @ copies[right]
            if not within:
                n[right] += copies[left] @ close
        return pa.table({"vec_id": table.column("vec_id"), "n": n.astype(np.int64)})

    keys = ["component_id", "dim"]
    out = dealt(members, keys, block).groupBy(*keys, "i", "j").applyInArrow(counted, "vec_id bigint, n bigint")
    own = members.select("vec_id", (F.col("copies") - 1).alias("n"))
    return out.union(own).groupBy("vec_id").agg(F.sum("n").alias("n_links"))


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = THRESHOLD, window: int = WINDOW, block: int = BLOCK, seed: int = 5, miss: float = MISS) -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept.

    Vectors that are null, empty, zero, or hold a null or non-finite component link with nothing: n_links 0, their own
    component, kept.  Vectors of different length never link.  Null ids give a row of their own (component null, kept).
    vec_id is taken to be unique; a repeated id counts as one more vector that shares the id's row values.  Other columns
    play no part.  An empty table gives no rows.  Every reported link has cosine >= threshold; each such pair is found but
    with probability miss.
    """
    spark = vectors.sparkSession
    ship(spark)
    kind = "f4" if vectors.schema[vec_col].dataType.simpleString() == "array<float>" else "f8"
    rows = packed(usable(vectors, id_col, vec_col), kind)
    whole = written(rows.groupBy("dim", "x").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies")))
    repeated = whole.filter("copies > 1").select("dim", "x", F.col("vec_id").alias("v"))
    copies = written(rows.join(repeated, ["dim", "x"]).filter("vec_id <> v").select(F.col("vec_id").alias("u"), "v"))
    bits, passes = plan(whole.count(), threshold, window, miss)
    with_keys = written(keyed(whole, kind, passes, seed))
    met = passed(with_keys, window, threshold)
    found = written(met.filter("sure").select("u", "v").union(confirmed(met.filter("NOT sure").select("u", "v"), whole, kind, threshold)))
    roots = components(found)
    more = crowded(with_keys, roots, whole, kind, bits, window, threshold)
    roots = components(roots.select(F.col("id").alias("u"), F.col("component_id").alias("v")).union(more).union(copies))
    roots = saved(roots.union(roots.select("component_id", "component_id")).distinct().toDF("vec_id", "component_id"))
    links = count_links(whole.join(roots, "vec_id").select("vec_id", "component_id", "dim", "x", "copies"), kind, threshold, block)
    stands = copies.groupBy(F.col("u").alias("vec_id")).agg(F.min("v").alias("one"))
    one = roots.join(stands, "vec_id", "left").withColumn("one", F.coalesce("one", "vec_id"))
    told = one.join(links.withColumnRenamed("vec_id", "one"), "one").drop("one")
    out = vectors.select(F.col(id_col).alias("vec_id")).join(told, "vec_id", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.expr("vec_id <=> coalesce(component_id, vec_id)").alias("kept"))


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "embeddings"))
