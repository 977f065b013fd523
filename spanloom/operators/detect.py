"""Recognisers, chunking and detection filters."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions import patterns, values
from spanloom.operators import choose
from spanloom.shipping import apart, ship

# The built-in patterns.  Their recognisers report the whole match, whatever it captures (``whole``).
PATTERNS = {
    "INDIVIDUAL_NUMBER": r"(?<!\d)(?:\d{4}-?\d{4}-?\d{4})(?!\d)",
    "YEAR": r"([1-9][0-9]{3}年|(令和|平成|昭和|大正|明治)([1-9][0-9]?)年)",
    "PERSON": r"([\u4e00-\u9fff]+)(?:くん|さん|君|ちゃん|様)",
    "PHONE_NUMBER": r"(?<!\d)(?:0\d{1,4}[-]?\d{1,4}[-]?\d{4})(?!\d)",
}
MAX_CHARS, MAX_BYTES = 15_000, 48_125
#: Characters of a chunk up to which Java's engine cuts it, which may take a frame of its stack for each.
NATIVE_CHARS = 1_000
#: A character for private use.
MARK = "\uf8f1"
_SPAN = "array<struct<start:int,end:int,text:string>>"


def _python_spans(text: Column, pattern: str, whole: bool) -> Column:
    """Each match, or unless whole its first capture group that took part and isn't empty; empty ones are left out."""

    @F.pandas_udf(_SPAN)
    def marked(texts: pd.Series) -> pd.Series:
        compiled = re.compile(pattern)

        def of(t: str | None) -> list[dict]:
            out = []
            for m in compiled.finditer(t or ""):
                g = 0 if whole else next((k for k in range(1, compiled.groups + 1) if m.end(k) > m.start(k)), 0)
                if m.end(g) > m.start(g):
                    out.append({"start": m.start(g), "end": m.end(g), "text": m[g]})
            return out

        return texts.map(of)

    return marked(text)


def spans(text: Column, pattern: str, whole: bool = False) -> Column:
    """Leftmost non-overlapping matches as (start, end, text), half-open code points; the pattern is read as Python reads it.

    A pattern with capture groups marks the first non-empty one, unless whole; Spark tells no group's place, so Python marks those.
    """
    same = patterns.java(pattern)
    if same is None or patterns.may_be_empty(pattern) or not whole and patterns.has_groups(pattern):
        return _python_spans(text, pattern, whole)

    none = F.array().cast(_SPAN)

    def placed(gaps: Column, hits: Column) -> Column:
        return running_spans(F.zip_with(gaps, hits, lambda g, h: F.struct(F.length(g).alias("gap"), h.alias("hit"))))

    def of(hits: Column) -> Column:
        return F.when(F.size(hits) > 0, placed(F.slice(F.split(text, same, -1), F.lit(1), F.size(hits)), hits)).otherwise(none)

    def between(parts: Column) -> Column:
        length = lambda k: F.length(F.get(parts, k))
        one = lambda at, k: F.struct(at.alias("start"), (at + length(k)).alias("end"), F.get(parts, k).alias("text"))
        first, second = one(length(0), 1), one(length(0) + length(1) + length(2), 3)
        many = placed(F.filter(parts, lambda _, i: (i % 2 == 0) & (i < F.size(parts) - 1)), F.filter(parts, lambda _, i: i % 2 == 1))
        return F.when(F.size(parts) == 3, F.array(first)).when(F.size(parts) == 5, F.array(first, second)).when(F.size(parts) > 1, many).otherwise(none)

    # One run of the pattern marks its matches, and the marks are told without it; a text that holds the mark is read twice.
    marked = let(F.split(F.regexp_replace(text, F.lit(same), F.lit(f"{MARK}$0{MARK}")), MARK, -1), between)
    twice = let(F.regexp_extract_all(text, F.lit(same), F.lit(0)), of)
    return F.coalesce(F.when(F.contains(text, F.lit(MARK)), twice).otherwise(marked), none)


def let(value: Column, body) -> Column:
    """body(value), with the value computed once: Spark repeats an expression wherever it is written."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running_spans(pairs: Column, chunk: int = 128) -> Column:
    """(start, end, text) of hits and the lengths of the gaps before them, (gap, hit), in time about linear in their number.

    Spark has no running sum over an array.  A fold that grows an array copies it at every step, so folds run over chunks.
    """
    length = lambda x: x["gap"] + F.length(x["hit"])
    cuts = lambda p: F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / chunk).cast("int")), lambda k: F.slice(p, k * chunk + 1, F.lit(chunk)))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))

    def starts(cut: Column) -> Column:
        sums = F.transform(cut, lambda c: F.aggregate(c, F.lit(0), lambda n, x: n + length(x)))
        return F.aggregate(sums, begin, lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])

    def inside(c: Column, at: Column) -> Column:
        def add(acc: Column, x: Column) -> Column:
            a = acc["at"] + x["gap"]
            b = a + F.length(x["hit"])
            return F.struct(b.alias("at"), F.concat(acc["out"], F.array(F.struct(a.alias("start"), b.alias("end"), x["hit"].alias("text")))).alias("out"))

        return F.aggregate(c, F.struct(at.alias("at"), F.array().cast(_SPAN).alias("out")), add, lambda acc: acc["out"])

    some = lambda p: let(cuts(p), lambda cut: F.flatten(F.zip_with(cut, starts(cut), inside)))
    return let(pairs, lambda p: F.when(F.size(p) > chunk, some(p)).when(F.size(p) > 0, inside(p, F.lit(0))).otherwise(F.array().cast(_SPAN)))


def literal_spans(text: Column, word: str) -> Column:
    """Every occurrence of a literal, overlapping ones too: of each character that starts one, by looking ahead."""
    n = len(word)
    if not n:
        return F.array().cast(_SPAN)
    ahead = f"(?s){re.escape(word[0])}(?={re.escape(word[1:])})" if n > 1 else re.escape(word)
    found = F.transform(spans(text, ahead, whole=True), lambda s: F.struct(s["start"].alias("start"), (s["start"] + n).alias("end"), F.lit(word).alias("text")))
    # Most texts hold none: that is told at once.
    return F.when(F.contains(text, F.lit(word)), found).otherwise(F.array().cast(_SPAN))


def block_spans(block: DataFrame, word: str) -> DataFrame:
    """(doc_id, page_num, block_num, start, end) of a literal inside each block."""
    return block.select("doc_id", "page_num", "block_num", F.explode(literal_spans(F.col("text"), word)).alias("s")).select("doc_id", "page_num", "block_num", "s.start", "s.end")


def compile_patterns(listed: list[tuple[str, str]], strict: bool = False) -> list[tuple[str, str]]:
    """(entity, pattern) pairs that Python can read; a bad one is an error if strict, else left out, as are blank ones."""
    out = []
    for entity, pattern in listed:
        if not pattern.strip():
            continue
        if not patterns.readable(pattern):
            if strict:
                raise ValueError(f"bad pattern {pattern!r}")
            continue
        out.append((entity, pattern))
    return out


def recognise(docs: DataFrame, wanted: dict[str, str] | list[tuple[str, str]], origin: str = "auto", text_col: str = "text", whole: bool = False) -> DataFrame:
    """(doc_id, entity, start, end, word, origin, prio), one row a match, of its capture group unless whole; blank ones are left out."""
    listed = list(wanted.items()) if isinstance(wanted, dict) else list(wanted)
    text = F.coalesce(F.col(text_col), F.lit(""))

    def tagged(entity: str, prio: int):
        return lambda s: F.struct(F.lit(entity).alias("entity"), F.lit(prio).alias("prio"), s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("word"))

    found = F.concat(*[F.transform(spans(text, pattern, whole), tagged(entity, k)) for k, (entity, pattern) in enumerate(listed)])
    rows = docs.select("doc_id", F.explode(found).alias("x")).select("doc_id", "x.entity", "x.start", "x.end", "x.word", F.lit(origin).alias("origin"), "x.prio")
    return rows.filter(~values.blank(F.col("word")))


def refine(found: DataFrame) -> DataFrame:
    """Words refined by entity, their spans moved, invalid candidates out."""
    def of(better: Column) -> Column:
        at = F.instr(F.col("word"), better)
        start = F.when((F.length(better) > 0) & (at > 0), F.col("start") + at - 1).otherwise(F.col("start"))
        end = F.when(at > 0, start + F.length(better)).otherwise(F.col("end"))
        good = (F.length(better) > 0) & values.valid_candidate(F.col("entity"), better)
        return F.when(good, F.struct(start.alias("start"), end.alias("end"), better.alias("word")))

    # An array of one or none: explode() computes it once, and filters don't repeat it.
    moved = found.withColumn("better", F.explode(F.filter(F.array(let(values.refined(F.col("entity"), F.col("word")), of)), lambda x: x.isNotNull())))
    return moved.withColumns({c: F.col(f"better.{c}") for c in ("start", "end", "word")}).drop("better")


def without_overlaps(found: DataFrame, others: DataFrame) -> DataFrame:
    """found without the spans that overlap one of others (half-open) in the same document."""
    o = others.select(F.col("doc_id").alias("od"), F.col("start").alias("os"), F.col("end").alias("oe"))
    return found.join(apart(o), (F.col("doc_id") == F.col("od")) & (F.col("start") < F.col("oe")) & (F.col("os") < F.col("end")), "left_anti")


def greedy(found: DataFrame) -> DataFrame:
    """Non-overlapping spans of each document, taken by (prio, start): later ones that overlap a taken one go.

    prio is the pattern's place among its entity's.  Of equal ones the entity that was listed later is taken first.
    """
    late = -F.coalesce(F.col("place") if "place" in found.columns else F.lit(0), F.lit(0))
    taken = choose.first_free(found.withColumn("late", late), "prio", "start", "late", "end", "entity", "word")
    return taken.select("doc_id", "entity", "start", "end", "word", "origin", "prio")


def excluded(text: Column, substrings=(), searches=(), exact=()) -> Column:
    """Whether a word is excluded by a part, a pattern or as a whole."""
    t, out = values.stripped(text), F.lit(False)
    for s in substrings:
        out = out | t.contains(s)
    for s in searches:
        if patterns.readable(s):
            out = out | patterns.search(t, s)
    return out | t.isin(*exact) if exact else out


def added(docs: DataFrame, wanted: list[tuple[str, str]], origin: str = "custom") -> DataFrame:
    """Spans of added patterns, none overlapping: by the pattern's place among its entity's, then by start, later entities first."""
    entities = list(dict.fromkeys(e for e, _ in wanted))
    nth = [sum(e == f for f, _ in wanted[:k]) for k, (e, _) in enumerate(wanted)]
    at = F.array(*map(F.lit, nth))
    rows = recognise(docs, wanted, origin).withColumn("prio", F.element_at(at, F.col("prio") + 1))
    return greedy(rows.withColumn("place", (F.array_position(F.array(*map(F.lit, entities)), F.col("entity")) - 1).cast("int")))


def omit(found: DataFrame, docs: DataFrame, unwanted: list[str]) -> DataFrame:
    """Detections without those whose word or span a pattern hits; manual ones stay."""
    good = [p for _, p in compile_patterns([("", p) for p in unwanted])]
    if not good:
        return found
    manual = found.filter("origin = 'manual'")
    rest = found.filter("origin <> 'manual'").filter(~excluded(F.col("word"), searches=good))
    return manual.unionByName(without_overlaps(rest, recognise(docs, [("OMIT", p) for p in good], whole=True)))


def needs_chunks(text: Column, max_chars: int = MAX_CHARS, max_bytes: int = MAX_BYTES) -> Column:
    return (F.length(text) > max_chars) | (F.octet_length(text) > max_bytes)


def split_text(text: str, delimiter: str = "。", max_chars: int = MAX_CHARS, max_bytes: int = MAX_BYTES) -> list[tuple[str, int]]:
    """Chunks with their starts: whole segments (delimiter kept) while they fit; an oversize segment is cut at the limits, one character at least."""
    fits = lambda s: len(s) <= max_chars and len(s.encode()) <= max_bytes
    if not text:
        return []
    parts = [p for p in re.split(f"(?<={re.escape(delimiter)})", text) if p] if delimiter else [text]
    out: list[tuple[str, int]] = []
    held, start, at = "", 0, 0
    for part in parts:
        if held and not fits(held + part):
            out.append((held, start))
            held = ""
        if not held:
            start = at
        held += part
        at += len(part)
        while not fits(held):
            low, high = 1, min(len(held), max_chars)
            while low < high:
                mid = (low + high + 1) // 2
                low, high = (mid, high) if fits(held[:mid]) else (low, mid - 1)
            out.append((held[:low], start))
            held, start = held[low:], start + low
    return [*out, (held, start)] if held else out


def chunks(docs: DataFrame, text_col: str = "text", delimiter: str = "。", max_chars: int = MAX_CHARS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(doc_id, chunk, start_offset): one scan; only texts over a limit are sent to Python, in Arrow batches.

    Without a delimiter, and with a limit of bytes that so many characters can't reach, chunks are runs of max_chars characters
    and Python sees no text.
    """
    if not delimiter and max_chars <= NATIVE_CHARS and max_bytes >= 4 * max_chars:
        runs = F.regexp_extract_all(F.col("x"), F.lit(f"(?s).{{1,{max_chars}}}"), F.lit(0))
        return docs.select("doc_id", F.col(text_col).alias("x")).select("doc_id", F.posexplode(runs).alias("k", "chunk")).select("doc_id", "chunk", (F.col("k") * max_chars).alias("start_offset"))
    ship(docs.sparkSession)

    @F.pandas_udf("array<struct<text:string,start_offset:int>>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else [{"text": c, "start_offset": s} for c, s in split_text(t, delimiter, max_chars, max_bytes)])

    rows = docs.select("doc_id", F.coalesce(F.col(text_col), F.lit("")).alias("text")).filter("text <> ''")
    parts = rows.select("doc_id", "text", cut(F.when(needs_chunks(F.col("text"), max_chars, max_bytes), F.col("text"))).alias("parts"))
    whole = F.array(F.struct("text", F.lit(0).alias("start_offset")))
    return parts.select("doc_id", F.explode(F.coalesce("parts", whole)).alias("x")).select("doc_id", F.col("x.text").alias("chunk"), "x.start_offset")


def redact(docs: DataFrame, found: DataFrame, mark: str = "█") -> DataFrame:
    """Texts with every detected character replaced."""
    per_doc = found.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("cut"))
    text = F.col("text")
    # Every text is turned into characters once; the kept and marked parts are slices of them.
    reach = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<a:int,b:int,e:int>>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        a, b = F.greatest(s["start"], acc["at"]), F.greatest(s["end"], acc["at"])
        return F.struct(b.alias("at"), F.concat(acc["out"], F.array(F.struct(acc["at"].alias("a"), a.alias("b"), b.alias("e")))).alias("out"))

    chars = F.split(text, "")
    parts = F.aggregate("cut", reach, step, lambda acc: acc["out"])
    part = lambda c, a, b: F.array_join(F.slice(c, a + 1, b - a), "")
    out = F.concat(F.array_join(F.transform("parts", lambda p: F.concat(part(F.col("chars"), p["a"], p["b"]), F.repeat(F.lit(mark), p["e"] - p["b"]))), ""), part(F.col("chars"), F.col("last"), F.greatest(F.size("chars") - F.col("last"), F.lit(0)) + F.col("last")))
    joined = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(per_doc, "doc_id", "left")
    cut = joined.withColumn("chars", F.when(F.col("cut").isNotNull(), chars)).withColumn("parts", parts).withColumn("last", F.least(F.size("chars"), F.element_at("parts", -1)["e"]))
    return cut.select("doc_id", F.when(F.col("cut").isNull(), text).otherwise(out).alias("text"))


def chunked(docs: DataFrame, wanted: dict[str, str] | list[tuple[str, str]], text_col: str = "text", delimiter: str = "。", max_chars: int = MAX_CHARS, max_bytes: int = MAX_BYTES, whole: bool = True) -> DataFrame:
    """recognise() over chunks, spans moved to the text; what crosses a border between chunks is not found."""
    rows = chunks(docs, text_col, delimiter, max_chars, max_bytes)
    # One row a chunk stands for a document while patterns run.
    keyed = rows.select(F.struct("doc_id", "start_offset").alias("doc_id"), F.col("chunk").alias("text"))
    found = recognise(keyed, wanted, whole=whole)
    moved = {c: F.col(c) + F.col("doc_id.start_offset") for c in ("start", "end")}
    return found.withColumns(moved).withColumn("doc_id", F.col("doc_id.doc_id"))


def exact_words(docs: DataFrame, pairs: list[tuple[str, str]], existing: DataFrame) -> DataFrame:
    """Detections of (word, entity) pairs that no existing row has: words are read as patterns."""
    found = recognise(docs, compile_patterns([(e, w.strip()) for w, e in pairs if w.strip()]), "manual", whole=True)
    return found.join(existing.select("doc_id", "entity", "start", "end"), ["doc_id", "entity", "start", "end"], "left_anti")


def first_that_loads(loaders: list[tuple[str, Callable[[], object]]]) -> tuple[str, object]:
    """(name, model) of the first loader that works, in order; an error that names all if none does."""
    failed = []
    for name, load in loaders:
        try:
            return name, load()
        except Exception as e:  # noqa: BLE001 - the next one may work
            failed.append(f"{name}: {e}")
    raise RuntimeError("no model could be loaded: " + "; ".join(failed))


def model_spans(docs: DataFrame, loaders: list[tuple[str, Callable[[], object]]], entities: list[str], text_col: str = "text", delimiter: str = "。", max_chars: int = MAX_CHARS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(doc_id, entity, start, end, word, origin, prio): what a model finds, chunk by chunk, of the wanted entities.

    A model is a callable from text to (entity, start, end) spans; each worker loads one once.  A chunk that fails finds
    nothing.  Blank words are left out.
    """
    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        _, model = first_that_loads(loaders)
        for frame in frames:
            out = []
            for doc, chunk, shift in zip(frame["doc_id"], frame["chunk"], frame["start_offset"]):
                try:
                    found = list(model(chunk))
                except Exception:  # noqa: BLE001 - a chunk's failure loses that chunk
                    continue
                out += [(doc, e, a + shift, b + shift, chunk[a:b], "auto", 0) for e, a, b in found if e in entities and chunk[a:b].strip()]
            yield pd.DataFrame(out, columns=["doc_id", "entity", "start", "end", "word", "origin", "prio"])

    rows = chunks(docs, text_col, delimiter, max_chars, max_bytes)
    return rows.mapInPandas(run, f"doc_id {kind}, entity string, start int, end int, word string, origin string, prio int")
