"""Suffix-array dedup: removes every byte that a string of ``length`` bytes covers which also starts elsewhere.

The suffix array is sparse.  Each window of ``length`` bytes picks an anchor by its content alone: the least hash of the
16-byte grams that start in its first SPREAD bytes.  Equal windows have equal anchors at equal offsets, so it is enough
to sort suffixes that start at anchors.  The bytes that an anchor's windows cover are its *context*: a left part, read
backwards from the anchor, and a right part.

1. Anchors whose next ``length - SPREAD + 1`` bytes occur once can't be repeated and go.  Equal contexts are merged (by
   128-bit digests); those that occur twice are repeated as a whole.
2. The contexts of which that leaves something open are sorted twice by a distributed merge sort, by right parts and by
   left parts.  A task sorts a run, front-codes it (length of the prefix shared with the suffix before, and the rest) and
   sends it to the ranges; each range merges its runs by a loser tree that compares known prefix lengths first and never
   reads a known prefix again.  Ranges are cut by whole keys, so a passage that very many texts hold spreads over many.
3. The prefix lengths of neighbours decide.  A window that starts l bytes before its anchor is repeated if some context
   shares l bytes to the left and ``length`` - l to the right.  Neighbours give the longest prefix shared to the right
   with any context, the longest one to the left, and windows that are repeated for certain.  Where these bounds are met,
   as for nearly all contexts, the context is settled.
4. The windows that are still open are themselves sorted the same way, together with those of all contexts that could
   equal them; a window is repeated if it shares ``length`` bytes with a neighbour.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.common import read, saved, ship, written

#: Bytes of a repeated string, starts that share an anchor.
LENGTH, SPREAD = 400, 256
#: Window starts that are hashed at once; bytes that a task sorts as one run, and about those of one range.
CHUNK, RUN_BYTES, RANGE_BYTES = 1 << 18, 1 << 25, 1 << 23
#: Keys sampled for each range, and ranges at most (the splitters are held by the driver); beyond, ranges grow.
SAMPLED, RANGES = 16, 1 << 14
_GRAM, _PLACE = 16, np.uint64((1 << 20) - 1)
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_END = b"\0\0"


def anchors(text: bytes, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window start, last window start) of a text, in order; none for a text shorter than length."""
    starts = len(text) - length + 1
    if starts <= 0:
        return (np.empty(0, np.int64),) * 3
    spread = min(SPREAD, length - _GRAM + 1)
    found = []
    for at in range(0, starts, CHUNK):
        n = min(CHUNK, starts - at)
        grams = n + spread - 1
        x = np.ndarray((grams,), "<u8", text, at, (1,)) * _A
        x ^= x >> np.uint64(29)
        x += np.ndarray((grams,), "<u8", text, at + 8, (1,))
        x *= _B
        x ^= x >> np.uint64(32)
        x *= _A
        x &= ~_PLACE
        x |= np.arange(grams, dtype=np.uint64)
        done = 1
        while done < spread:
            step = min(done, spread - done)
            x = np.minimum(x[:-step], x[step:])
            done += step
        found.append((x[:n] & _PLACE).astype(np.int64) + at)
    a = np.concatenate(found)
    first = np.flatnonzero(np.diff(a, prepend=-1))
    return a[first], first, np.append(first[1:], starts) - 1


def anchor_rows(texts: DataFrame, length: int) -> DataFrame:
    """(i, h, a, lo, hi, rk, c1, c2) of (i, h, text): every anchor, its least right part's hash and its context's."""
    right = max(_GRAM, length - SPREAD + 1)
    ints = ["i", "h", "a", "lo", "hi", "rk", "c1", "c2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, h, text in zip(*(batch.column(k) for k in range(3))):
                text = text.as_py()
                a, lo, hi = anchors(text, length)
                if not len(a):
                    continue
                rk = [xxhash.xxh3_64_intdigest(text[x : x + right]) for x in a.tolist()]
                ck = b"".join([xxhash.xxh3_128_digest(text[x : y + length], x - z + 1) for x, y, z in zip(lo.tolist(), hi.tolist(), a.tolist())])
                c = np.frombuffer(ck, "<i8").reshape(-1, 2)
                whose = (np.full(len(a), i.as_py(), np.int64), np.full(len(a), h.as_py(), np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in (*whose, a, lo, hi, np.array(rk, np.uint64).view(np.int64), c[:, 0], c[:, 1])], ints)

    return texts.select("i", "h", "text").mapInArrow(run, ", ".join(f"{c} bigint" for c in ints))


def front_coded(suffixes: list[bytes]) -> tuple[list[int], list[bytes]]:
    """Sorted suffixes -> shared prefix lengths with the one before, and the rests."""
    lcps, rests, before = [], [], b""
    for s in suffixes:
        n = common(before, s, 0)
        lcps.append(n)
        rests.append(s[n:])
        before = s
    return lcps, rests


def common(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix, of which known bytes are known."""
    most = min(len(a), len(b))
    step = 16
    while known < most and a[known : known + step] == b[known : known + step]:
        known += step
        step *= 2
    if known >= most:
        return most
    high = min(known + step, most)
    while step > 1:
        step //= 2
        if known + step <= high and a[known : known + step] == b[known : known + step]:
            known += step
    return min(known, most)


def decoded(lcps: list[int], rests: list[bytes]) -> Iterator[tuple[bytes, int]]:
    """Front-coded suffixes with the prefix length shared with the one before."""
    before = b""
    for n, rest in zip(lcps, rests):
        before = before[:n] + rest
        yield before, n


def merged(runs: list[list[tuple[bytes, int]]]) -> Iterator[tuple[int, int, int]]:
    """(run, index, shared prefix with the suffix before) in sorted order, by a loser tree of prefix lengths.

    Every waiting suffix carries the length of the prefix it shares with the last suffix put out.  The longer one is the
    smaller suffix; only equal lengths make a comparison, which starts behind the known prefix.
    """
    k = max(1, len(runs))
    place = [0] * k
    end = (b"", -1)

    def head(i: int) -> tuple[bytes, int]:
        return runs[i][place[i]] if i < len(runs) and place[i] < len(runs[i]) else end

    def play(a: tuple[int, int], b: tuple[int, int]) -> tuple[tuple[int, int], tuple[int, int]]:
        """(run, known prefix) of winner and loser; the loser's length is then the one it shares with the winner."""
        (i, x), (j, y) = a, b
        if y < 0 or x > y:
            return a, b
        if x < 0 or y > x:
            return b, a
        s, t = runs[i][place[i]][0], runs[j][place[j]][0]
        n = common(s, t, x)
        if n == len(s) or (n < len(t) and s[n] < t[n]):
            return (i, x), (j, n)
        return (j, y), (i, n)

    size = 1
    while size < k:
        size *= 2
    losers: list[tuple[int, int]] = [(0, -1)] * (2 * size)

    def build(node: int) -> tuple[int, int]:
        if node >= size:
            i = node - size
            return (i, 0 if i < k and head(i)[1] >= 0 else -1)
        winner, losers[node] = play(build(2 * node), build(2 * node + 1))
        return winner

    winner = build(1)
    while winner[1] >= 0:
        i, shared = winner
        yield i, place[i], shared
        place[i] += 1
        now = (i, head(i)[1])  # the run's own next suffix shares this much with the one put out
        node = (i + size) // 2
        while node:
            now, losers[node] = play(now, losers[node])
            node //= 2
        winner = now


def escaped(first: bytes, second: bytes) -> bytes:
    """Both as one key that sorts as the pair does."""
    return first.replace(b"\0", b"\0\xff") + _END + second


def parts(key: bytes, head: int) -> tuple[bytes, bytes]:
    """The pair in an escaped key that follows head bytes."""
    end = key.find(_END, head)
    return key[head:end].replace(b"\0\xff", b"\0"), key[end + 2 :]


def shared_bytes(key: bytes, n: int, head: int) -> int:
    """Bytes that the first parts of two escaped keys share, if the keys share n."""
    known = key[head:n]
    end = known.find(_END)
    return (len(known) if end < 0 else end) - known.count(b"\0", 0, None if end < 0 else end)


class Order:
    """One order of the contexts: its keys, and what two neighbours tell.

    ``right``: by right part, then left.  ``left``: by group (hash of the least right part), left part, then right.
    ``window``: by window.
    """

    def __init__(self, name: str, length: int):
        self.name, self.length, self.right = name, length, max(_GRAM, length - SPREAD + 1)

    def key(self, rk: int, right: bytes, left: bytes) -> bytes:
        if self.name == "window":
            return right
        return escaped(right, left) if self.name == "right" else rk.to_bytes(8, "big", signed=True) + escaped(left, right)

    def told(self, a: tuple, b: tuple, n: int) -> tuple[tuple, tuple] | None:
        """What neighbours (key, whole, l) that share n bytes tell of each: least and largest l of windows known to be
        repeated (None if none), longest shared right and left part.  None if they tell nothing."""
        if self.name == "window":
            return ((a[2], a[2], 0, 0), (b[2], b[2], 0, 0)) if n >= self.length else None
        if n < (self.right if self.name == "right" else 8):
            return None
        if self.name == "right":
            p = shared_bytes(a[0], n, 0)
            if p < self.right:
                return None
            (ra, la), (rb, lb) = parts(a[0], 0), parts(b[0], 0)
            s = common(la, lb, 0)
            bounds = (p, 0)
        else:
            s = shared_bytes(a[0], n, 8)
            (la, ra), (lb, rb) = parts(a[0], 8), parts(b[0], 8)
            p = common(ra, rb, 0)
            bounds = (0, s)

        def of(right: bytes, left: bytes) -> tuple:
            low, high = max(self.length - len(right), self.length - p), min(len(left), s)
            return (low, high, *bounds) if low <= high else (None, None, *bounds)

        return of(ra, la), of(rb, lb)


def _either(x: tuple | None, y: tuple | None) -> tuple | None:
    """What two neighbours tell together."""
    if x is None or y is None:
        return x or y
    low, high = [v for v in (x[0], y[0]) if v is not None], [v for v in (x[1], y[1]) if v is not None]
    return (min(low, default=None), max(high, default=None), max(x[2], y[2]), max(x[3], y[3]))


_TOLD = [("c1", pa.int64()), ("c2", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("p", pa.int32()), ("s", pa.int32())]
_EDGE = [("part", pa.int32()), ("last", pa.int32()), ("g", pa.int64()), ("whole", pa.bool_()), ("l", pa.int32()), ("key", pa.binary())]
_TOLD_DDL, _EDGE_DDL = "c1 bigint, c2 bigint, lo int, hi int, p int, s int", "part int, last int, g bigint, whole boolean, l int, key binary"


def neighbours(rows: DataFrame, order: Order, range_bytes: int) -> DataFrame:
    """(c1, c2, lo, hi, p, s): what the neighbours in the order tell of each context (c1, c2, rk, whole, l, right, left).

    Of contexts that are repeated as a whole only p and s are told, and of their windows nothing.  The rows are read three times
    (size, sample, runs), so they should be written ones.
    """
    spark = rows.sparkSession
    total, count = rows.agg(F.sum(F.length("right") + F.length("left") + 10), F.count("*")).first()
    ranges = min(RANGES, math.ceil((total or 0) / range_bytes) + 1)
    want = ranges * SAMPLED
    taken = rows.sample(min(1.0, want / max(1, count)), 3).select("rk", "right", "left").limit(4 * want).collect()
    sample = sorted(order.key(r[0], bytes(r[1]), bytes(r[2])) for r in taken)
    splitters = spark.sparkContext.broadcast([sample[len(sample) * k // ranges] for k in range(1, ranges)] if sample else [])

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def put() -> Iterator[pa.RecordBatch]:
            held.sort()
            at = 0
            while at < len(held):
                k = bisect_right(splitters.value, held[at][0])
                end = len(held) if k >= len(splitters.value) else next((j for j in range(at, len(held)) if held[j][0] >= splitters.value[k]), len(held))
                lcps, rests = front_coded([r[0] for r in held[at:end]])
                columns = [lcps, rests, *([r[j] for r in held[at:end]] for j in range(1, 6))]
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), *(pa.array([v], pa.list_(t)) for v, t in zip(columns, (pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32())))], ["part", "lcps", "rests", "c1", "c2", "g", "whole", "l"])
                at = end

        for batch in batches:
            for c1, c2, rk, whole, l, right, left in zip(*(c.to_pylist() for c in batch.columns)):
                key = order.key(rk, right, left)
                held.append((key, c1, c2, xxhash.xxh3_64_intdigest(key) - (1 << 63) if order.name == "window" else rk, whole, l))
                size += len(key)
                if size >= RUN_BYTES:
                    yield from put()
                    held, size = [], 0
        yield from put()

    sent = rows.select("c1", "c2", "rk", "whole", "l", "right", "left").mapInArrow(runs, "part int, lcps array<int>, rests array<binary>, c1 array<bigint>, c2 array<bigint>, g array<bigint>, whole array<boolean>, l array<int>")

    def of_whole(told: tuple, whole: bool) -> tuple:
        return (None, None, *told[2:]) if whole else told

    def merge(table: pa.Table) -> pa.Table:
        sides = [list(decoded(a, b)) for a, b in zip(table.column("lcps").to_pylist(), table.column("rests").to_pylist())]
        ids = list(zip(*(table.column(c).to_pylist() for c in ("c1", "c2", "g", "whole", "l"))))
        out: list[tuple] = []
        edges: list[tuple] = []
        before, known = None, None

        def close() -> None:
            if known and not (before[2] and order.name == "window"):
                out.append((*before[3], *of_whole(known, before[2])))

        for i, k, n in merged(sides):
            c1, c2, g, whole, l = (v[k] for v in ids[i])
            now = (sides[i][k][0], g, whole, (c1, c2), l)
            if before is None:
                edges.append((0, now))
            elif now[3] == before[3] and now[0] == before[0]:
                continue  # a repeated row's context is the same one again
            else:
                told = order.told((before[0], before[2], before[4]), (now[0], whole, l), n) or (None, None)
                known = _either(known, told[0])
                close()
                known = told[1]
            before = now
        if before is not None:
            close()
            edges.append((1, before))
        part = table.column("part")[0].as_py()
        rows = [(*r, *([None] * 6)) for r in out] + [(*x[3], None, None, None, None, part, last, x[1], x[2], x[4], x[0]) for last, x in edges]
        return pa.Table.from_arrays([pa.array([r[j] for r in rows], t) for j, (_, t) in enumerate(_TOLD + _EDGE)], [c for c, _ in _TOLD + _EDGE])

    def across(table: pa.Table) -> pa.Table:
        """The same for neighbours on both sides of a border between ranges: two rows a range at most."""
        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("part", "last", "key", "whole", "l", "c1", "c2"))), key=lambda r: r[:2])
        out = []
        for a, b in zip(rows, rows[1:]):
            if a[0] != b[0] and a[5:] != b[5:]:
                told = order.told(a[2:5], b[2:5], common(a[2], b[2], 0)) or (None, None)
                out += [(*x[5:], *of_whole(t, x[3])) for x, t in ((a, told[0]), (b, told[1])) if t and not (x[3] and order.name == "window")]
        return pa.Table.from_arrays([pa.array([r[j] for r in out], t) for j, (_, t) in enumerate(_TOLD)], [c for c, _ in _TOLD])

    found = written(sent.groupBy("part").applyInArrow(merge, f"{_TOLD_DDL}, {_EDGE_DDL}"))
    edges = found.filter("part IS NOT NULL").select("part", "last", "g", "whole", "l", "key", "c1", "c2")
    return found.filter("part IS NULL").select("c1", "c2", "lo", "hi", "p", "s").union(edges.groupBy("g").applyInArrow(across, _TOLD_DDL))


def _contexts(packed: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """(c1, c2, rk, whole, l, right, left) of the wanted (i, h, a, lo, hi, c1, c2, rk, whole); left is read backwards."""
    per_doc = wanted.groupBy("i", "h").agg(F.collect_list(F.struct("a", "lo", "hi", "c1", "c2", "rk", "whole")).alias("at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for z, at in zip(batch.column(0), batch.column(1)):
                text, at = unpack(z.as_py()), at.as_py()
                yield pa.RecordBatch.from_arrays(
                    [
                        *(pa.array([x[c] for x in at], pa.int64()) for c in ("c1", "c2", "rk")),
                        pa.array([x["whole"] for x in at], pa.bool_()),
                        pa.array([0] * len(at), pa.int32()),
                        pa.array([text[x["a"] : x["hi"] + length] for x in at], pa.binary()),
                        pa.array([text[x["lo"] : x["a"]][::-1] for x in at], pa.binary()),
                    ],
                    ["c1", "c2", "rk", "whole", "l", "right", "left"],
                )

    return packed.join(per_doc, ["i", "h"]).select("z", "at").mapInArrow(run, "c1 bigint, c2 bigint, rk bigint, whole boolean, l int, right binary, left binary")


def _windows(contexts: DataFrame, length: int) -> DataFrame:
    """Windows of contexts with (first, last), one row for each l in that range: l is how far before the anchor it starts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c1, c2, rk, whole, right, left, first, last in zip(*(c.to_pylist() for c in batch.columns)):
                at = range(max(first, length - len(right)), min(last, len(left)) + 1)
                if len(at):
                    text, n = left[::-1] + right, len(left)
                    windows = pa.array([text[n - l : n - l + length] for l in at], pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array([c1] * len(at), pa.int64()), pa.array([c2] * len(at), pa.int64()), pa.array([rk] * len(at), pa.int64()), pa.array([whole] * len(at)), pa.array(at, pa.int32()), windows, pa.array([b""] * len(at), pa.binary())], ["c1", "c2", "rk", "whole", "l", "right", "left"])

    return contexts.select("c1", "c2", "rk", "whole", "right", "left", "first", "last").mapInArrow(run, "c1 bigint, c2 bigint, rk bigint, whole boolean, l int, right binary, left binary")


def packed_texts(texts: DataFrame) -> DataFrame:
    """(doc_id, i, h, z): the texts compressed, as they are shuffled."""
    kind = texts.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                some = batch.slice(at, 64)
                yield pa.RecordBatch.from_arrays([*some.columns[:3], pa.array([pack(t.as_py()) for t in some.column(3)], pa.binary())], ["doc_id", "i", "h", "z"])

    return texts.select("doc_id", "i", "h", "text").mapInArrow(run, f"doc_id {kind}, i bigint, h bigint, z binary")


def repeated_spans(texts: DataFrame, packed: DataFrame, length: int = LENGTH, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(i, h, s, e) byte intervals that cover just the repeated bytes of texts (i, h, text as bytes)."""
    rows = written(anchor_rows(texts, length))
    several = saved(rows.groupBy("rk").agg(F.count("*").alias("n")).filter("n > 1").select("rk"))
    rows = written(rows.join(several, "rk", "left_semi"))
    same = written(rows.groupBy("c1", "c2").agg(F.count("*").alias("n"), F.first("rk").alias("rk"), F.min(F.struct("i", "h", "a", "lo", "hi")).alias("x")))
    groups = saved(same.groupBy("rk").agg(F.count("*").alias("size"), F.min("n").alias("least")).filter("size > 1 AND least = 1").select("rk"))
    wanted = same.join(groups, "rk").select("x.*", "c1", "c2", "rk", (F.col("n") > 1).alias("whole"))
    contexts = written(_contexts(packed, wanted, length))
    told = neighbours(contexts, Order("right", length), range_bytes).union(neighbours(contexts, Order("left", length), range_bytes))
    told = written(told.groupBy("c1", "c2").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("p").alias("p"), F.max("s").alias("s")))
    # A context shares windows from first to last at most, with whatever other: beyond them none of its windows is asked for.
    bounds = contexts.select("c1", "c2", "rk", "whole", F.length("right").alias("r"), F.length("left").alias("l")).join(told, ["c1", "c2"])
    bounds = written(bounds.select("c1", "c2", "rk", "whole", "lo", "hi", F.expr(f"greatest({length} - r, {length} - p)").alias("first"), F.least("l", "s").alias("last")).filter("first <= last"))
    open_ = bounds.filter("NOT whole AND (lo IS NULL OR first < lo OR hi < last)")
    open_ = open_.select("rk", F.expr("if(lo IS NULL OR first < lo, first, hi + 1)").alias("from"), F.expr("if(lo IS NULL OR hi < last, last, lo - 1)").alias("to"))
    open_ = saved(open_.groupBy("rk").agg(F.min("from").alias("from"), F.max("to").alias("to")))
    asked = bounds.join(open_, "rk").select("c1", "c2", F.greatest("first", "from").alias("first"), F.least("last", "to").alias("last")).filter("first <= last")
    windows = written(_windows(contexts.join(asked, ["c1", "c2"]), length))
    decided = told.select("c1", "c2", "lo", "hi").union(neighbours(windows, Order("window", length), range_bytes).select("c1", "c2", "lo", "hi"))
    decided = decided.filter("lo IS NOT NULL").groupBy("c1", "c2").agg(F.min("lo").alias("least"), F.max("hi").alias("most"))
    whole = same.filter("n > 1").select("c1", "c2", F.lit(None).cast("int").alias("least"), F.lit(None).cast("int").alias("most"))
    known = written(decided.union(whole))
    spans = rows.join(known, ["c1", "c2"]).select("i", "h", F.coalesce(F.col("a") - F.col("most"), "lo").alias("s"), (F.coalesce(F.col("a") - F.col("least"), "hi") + length).alias("e"))
    return spans


def merged_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """One row per input row: doc_id, kept (bytes that remain), n_bytes, spans (removed, maximal).

    Null and empty texts, and texts shorter than length, lose nothing; matches never cross rows; a row that repeats another
    is a second copy, so both lose all that is long enough; null ids are rows like others, ids may be of any type; texts of
    any length are read whole; columns of other names play no part; an empty table gives no rows.
    """
    ship(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    texts = texts.select("doc_id", F.xxhash64("doc_id").alias("i"), F.xxhash64("text").alias("h"), "text")
    packed = packed_texts(texts)
    spans = repeated_spans(texts, packed, length, range_bytes).groupBy("i", "h").agg(F.collect_set(F.struct("s", "e")).alias("spans"))
    rows = packed.join(spans, ["i", "h"], "left").select("doc_id", "z", "spans")
    kind = texts.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for i in range(batch.num_rows):
                text = unpack(batch.column(1)[i].as_py())
                cut = merged_spans([(x["s"], x["e"]) for x in batch.column(2)[i].as_py() or []])
                edges = [0, *(x for span in cut for x in span), len(text)]
                kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([kept], pa.binary()), pa.array([len(text)], pa.int64()), pa.array([[{"s": s, "e": e} for s, e in cut]], pair)], ["doc_id", "kept", "n_bytes", "spans"])

    return rows.mapInArrow(run, f"doc_id {kind}, kept binary, n_bytes bigint, spans array<struct<s:bigint,e:bigint>>")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup(read(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["e"] - x["s"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
