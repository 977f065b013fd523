"""Benchmark decontamination: one Aho-Corasick automaton over the benchmark's normalised questions and answers.

Normalising leaves words of ASCII digits, lower-cased letters and whatever lies beyond ASCII.  Each distinct word of the
benchmark is one symbol of the automaton's alphabet, so a window of ten words is a pattern of ten symbols, a document is
scanned once, symbol by symbol, and the place of a symbol is the place of its word, whose offsets lead back to the text.

The automaton is sent to the workers only while the benchmark's windows are few enough (counted first).
A larger benchmark is cut into pieces of bounded size, dealt to parts; the documents are scanned once for each part, and
what the parts find is added up row by row, without a shuffle of texts.
"""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Iterator
from itertools import repeat

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.common import read, ship, written

WORDS = 10
#: Benchmark words that one automaton takes, or twice as many before they are dealt: ten nodes a word, some 100 to 300 MB.
PART_WORDS = 100_000
#: So many bytes of words weigh as much as another word.
LONG_WORD = 64
#: Benchmark texts are cut into pieces of so many words, which overlap by a window but one.
PIECE_WORDS = 2_000
#: What a document's normalised bytes become: upper case lowered, everything between words a blank.
_NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
_SPANS = "array<struct<start:int,end:int>>"


def words(text: str | None) -> list[bytes]:
    """The words, lower-cased from A to Z, in UTF-8: runs of anything but ASCII control characters, blanks and punctuation."""
    return (text or "").encode().translate(_NORMAL).split()


def places(text: str) -> list[tuple[int, int]]:
    """Start and end of each of the words in the text, code points."""
    return [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)]


class Matcher:
    """The automaton of some items: (item, words) pairs, an item's words being one text or a piece of it."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WORDS):
        import ahocorasick

        self.symbols: dict[bytes, str] = {}
        owners: dict[str, set[int]] = {}
        self.names: list[str] = []
        number: dict[str, int] = {}
        for name, listed in items:
            if name not in number:
                number[name] = len(self.names)
                self.names.append(name)
            coded = "".join([self.symbols.setdefault(w, self._symbol(len(self.symbols))) for w in listed])
            for k in range(max(1, len(coded) - window + 1) if coded else 0):
                owners.setdefault(coded[k : k + window], set()).add(number[name])
        self.owners = list(owners.values())
        self.automaton = ahocorasick.Automaton()
        for k, pattern in enumerate(owners):
            self.automaton.add_word(pattern, (len(pattern), k))
        self.some = bool(owners)
        if self.some:
            self.automaton.make_automaton()

    @staticmethod
    def _symbol(k: int) -> str:
        """The k-th symbol, past the surrogates; U+0000 stands for words that no item has."""
        return chr(k + 1 if k + 1 < 0xD800 else k + 1 + 0x800)

    def scan(self, listed: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Maximal runs of words (first, past the last) that occurrences cover, and the numbers of the items that occur."""
        runs: list[tuple[int, int]] = []
        found: set[int] = set()
        if self.some:
            for end, (size, pattern) in self.automaton.iter("".join(map(self.symbols.get, listed, repeat("\0")))):
                found.add(pattern)
                start, after = end - size + 1, end + 1
                while runs and runs[-1][1] >= start:
                    start = min(start, runs.pop()[0])
                runs.append((start, after))
        return runs, {k for pattern in found for k in self.owners[pattern]}


_matchers: dict[str, Matcher] = {}


def _matcher(key: str, items: list[tuple[str, list[bytes]]], window: int) -> Matcher:
    """One automaton a worker, built when its part comes up."""
    if key not in _matchers:
        _matchers.clear()
        _matchers[key] = Matcher(items, window)
    return _matchers[key]


def pieces(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WORDS, piece_words: int = PIECE_WORDS) -> DataFrame:
    """(item, piece, listed): the items' words in pieces that hold every window of the item; items without words are left out."""
    listed = F.regexp_extract_all(F.translate(F.coalesce(text_col, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0))
    rows = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), listed.alias("w")).filter("size(w) > 0")
    steps = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("w") - window), F.lit(piece_words))
    cut = rows.select("item", "w", F.explode(steps).alias("piece"))
    return cut.select("item", "piece", F.slice("w", F.col("piece") + 1, piece_words + window - 1).alias("listed"))


def parts(benchmark: DataFrame, id_col: str, text_col: str, window: int, part_words: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """The pieces in lists of about part_words words at most, one after another: what the driver holds at a time."""
    cut = pieces(benchmark, id_col, text_col, window, max(1, min(PIECE_WORDS, part_words // 4))).distinct()
    # A word without end counts by its bytes.
    total = cut.agg(F.sum(F.size("listed") + F.octet_length(F.array_join("listed", " ")) / LONG_WORD)).first()[0] or 0
    many = math.ceil(total / part_words) if total > part_words * 2 else 1
    if many > 1:
        cut = written(cut)
    for k in range(many):
        mine = cut if many == 1 else cut.filter(F.pmod(F.xxhash64("item", "piece"), F.lit(many)) == k)
        yield [(r["item"], [w.encode() for w in r["listed"]]) for r in mine.select("item", "listed").collect()]


def _scanned(rows: DataFrame, items: list[tuple[str, list[bytes]]], window: int, last: bool) -> DataFrame:
    """rows with what these items hit added to runs (flat first and past-last words) and items; n_words, n_hit and spans with the last."""
    key = uuid.uuid4().hex
    shared = rows.sparkSession.sparkContext.broadcast(items)
    kept = [n for n in rows.columns if not last or n != "text"]
    kind = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    more = {"n_words": "bigint", "n_hit": "bigint", "spans": _SPANS} if last else {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _matcher(key, shared.value, window)
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            runs, names, sizes, hits, spans = [], [], [], [], []
            for k in range(batch.num_rows):
                text = batch.column("text")[k].as_py() or ""
                listed = words(text)
                found, numbers = own.scan(listed)
                before = batch.column("runs")[k].as_py()
                if before:
                    found = _union([*zip(before[::2], before[1::2]), *found])
                runs.append([x for r in found for x in r])
                names.append(sorted({*batch.column("items")[k].as_py(), *(own.names[i] for i in numbers)}))
                if last:
                    sizes.append(len(listed))
                    hits.append(sum(b - a for a, b in found))
                    at = places(text) if found else []
                    spans.append([{"start": at[a][0], "end": at[b - 1][1]} for a, b in found])
            made = {"runs": pa.array(runs, pa.list_(pa.int32())), "items": pa.array(names, pa.list_(pa.string()))}
            if last:
                made |= {"n_words": pa.array(sizes, pa.int64()), "n_hit": pa.array(hits, pa.int64()), "spans": pa.array(spans, span)}
            names_ = [*kept, *more]
            yield pa.RecordBatch.from_arrays([made[n] if n in made else batch.column(n) for n in names_], names_)

    return rows.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in ({n: kind[n] for n in kept} | more).items()))


def _union(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], b)
        else:
            out.append((a, b))
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WORDS, part_words: int = PART_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, items, spans: for each document its words, those inside an occurrence of a window, the items whose
    windows occur (their ids as strings, sorted), and the covered stretches of the text (code points, end exclusive).

    An item of fewer words than a window is one window; one without words is never found.  Null texts have no words.  Items
    that share an id count once, as do those without one, whose id is shown as an empty string.  Every row of docs gives
    one, repeated rows and null ids too; texts may be of any length; other columns play no part; an empty table of documents
    gives no rows, an empty benchmark hits nothing.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.array().cast("array<int>").alias("runs"), F.array().cast("array<string>").alias("items"))
    listed = parts(benchmark, item_col, item_text_col, window, part_words)
    mine = next(listed)
    for after in listed:
        rows, mine = written(_scanned(rows, mine, window, False)), after
    out = _scanned(rows, mine, window, True)
    return out.select("doc_id", "n_words", "n_hit", "items", "spans")


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    items = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), items.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
