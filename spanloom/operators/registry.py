"""A registry of scored recognisers: patterns with scores, checks that settle them, context words that raise them, and
conflicts removed by score.

A pattern's match has the pattern's score.  A check that holds makes it 1, one that fails drops it.  A context word that ends
at most ``WINDOW`` characters before a match raises it by ``RAISE``, to ``RAISED`` at least.  Of one entity's matches, one
that lies in a better one goes.  All of it is expressions and joins by document and place.
"""

from __future__ import annotations

import string
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.functions import values
from spanloom.operators import choose, detect
from spanloom.shipping import apart, dealt, written

#: Characters before a match in which a context word counts, what it adds, and the least score that it gives.
WINDOW, RAISE, RAISED = 50, 0.35, 0.4
#: Characters that lookups of places take together.
CELL = 256


@dataclass(frozen=True)
class Recogniser:
    entity: str
    patterns: tuple[tuple[str, float], ...]
    check: Callable[[Column], Column] | None = None
    context: tuple[str, ...] = ()


def luhn(text: Column) -> Column:
    """Whether the digits have a right check digit by doubling every second one from the right; null without any."""
    digits = values.digits_only(text)
    checked = lambda d: F.call_function("luhn_check", d)
    return F.when(text.rlike(r"^[0-9]+\z"), checked(text)).when(F.length(digits) > 0, checked(digits))


def mod97(text: Column) -> Column:
    """Whether an account number's letters and digits, the first four behind the rest, are 1 modulo 97."""
    bare = F.translate(F.regexp_replace(text, "[^0-9A-Za-z]", ""), string.ascii_lowercase, string.ascii_uppercase)
    # Up to nine digits a step, or one letter, which stands for two.
    powers = F.array(*[F.lit(10**n) for n in range(10)])
    step = lambda a, c: F.when(F.ascii(c) < 58, a * F.get(powers, F.length(c)) + c.cast("long")).otherwise(a * 100 + F.ascii(c) - 55) % 97
    moved = lambda b: F.concat(F.substring(b, F.lit(5), F.length(b)), F.substring(b, 1, 4))
    rest = lambda b: F.aggregate(F.regexp_extract_all(moved(b), F.lit("[0-9]{1,9}|[A-Z]"), F.lit(0)), F.lit(0).cast("long"), step)
    # Two letters and digits alone, up to 38 with two for a letter, are one number.
    two = lambda k: (F.ascii(F.substring(text, k, 1)) - 55).cast("string")
    number = F.concat(F.substring(text, F.lit(5), F.length(text)), two(1), two(2), F.substring(text, 3, 2)).cast("decimal(38,0)")
    return F.when(text.rlike(r"^[A-Z]{2}[0-9]{3,34}\z"), number % 97 == 1).otherwise(detect.let(bare, lambda b: (F.length(b) > 4) & (rest(b) == 1)))


def address_parts(text: Column) -> Column:
    """Whether four numbers between dots are each below 256."""
    return F.forall(F.split(text, r"\."), lambda p: p.try_cast("int").between(0, 255)) & (F.size(F.split(text, r"\.")) == 4)


#: Recognisers beside the built-in patterns; digits in groups, letters of any case.
DEFAULT = (
    Recogniser("EMAIL_ADDRESS", ((r"\b[\w.%+-]+@[\w-]+(?:\.[\w-]+){1,5}\b", 0.5),), lambda t: F.when(t.rlike(r"\.[A-Za-z]{2,24}$"), F.lit(True)).otherwise(F.lit(False)), ("mail", "email", "contact")),
    Recogniser("CREDIT_CARD", ((r"\b(?<![.-])\d(?:[ -]?\d){12,18}\b", 0.3),), luhn, ("card", "credit", "visa", "payment")),
    Recogniser("IBAN_CODE", ((r"\b[A-Z]{2}\d{2}(?:[ ]?[0-9A-Z]){11,30}\b", 0.5),), mod97, ("iban", "bank", "account")),
    Recogniser("IP_ADDRESS", ((r"\b(?<![.])\d{1,3}(?:\.\d{1,3}){3}\b(?![.]\d)", 0.6),), address_parts, ("ip", "host", "server")),
    Recogniser("INDIVIDUAL_NUMBER", ((detect.PATTERNS["INDIVIDUAL_NUMBER"], 0.9),), values.valid_individual_number, ("番号",)),
    Recogniser("PHONE_NUMBER", ((detect.PATTERNS["PHONE_NUMBER"], 0.8),), values.valid_phone_number, ("電話", "phone", "call")),
    Recogniser("YEAR", ((detect.PATTERNS["YEAR"], 0.8),)),
    Recogniser("PERSON", ((detect.PATTERNS["PERSON"], 0.7),)),
)


def scored(docs: DataFrame, recognisers: tuple[Recogniser, ...] = DEFAULT, entities: list[str] | None = None, text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(doc_id, entity, start, end, word, score, checked) of all matches of the wanted entities, before conflicts are removed.

    Null and empty texts give none; repeated documents' matches come as often.
    """
    wanted = [r for r in recognisers if entities is None or r.entity in entities]
    listed = [(r.entity, p, s, k) for k, r in enumerate(wanted) for p, s in r.patterns]
    if not listed:
        kind = docs.schema["doc_id"].dataType.simpleString()
        return docs.sparkSession.createDataFrame([], f"doc_id {kind}, entity string, start int, end int, word string, score double, checked boolean")
    found = detect.recognise(docs, [(e, p) for e, p, _, _ in listed], text_col=text_col, whole=True)
    by_pattern = lambda of: F.element_at(F.array(*map(F.lit, of)), F.col("prio") + 1)
    rows = found.withColumns({"which": by_pattern([k for *_, k in listed]), "score": by_pattern([s for _, _, s, _ in listed])})
    held = F.lit(None).cast("boolean")
    for k, r in enumerate(wanted):
        if r.check is not None:
            held = F.when(F.col("which") == k, r.check(F.col("word"))).otherwise(held)
    # Exploding an array of one keeps a check from being computed wherever it is asked for.
    rows = rows.withColumn("held", F.explode(F.array(held))).filter("held IS NULL OR held").withColumn("score", F.when(F.col("held"), 1.0).otherwise(F.col("score")))
    # Context and conflicts ask for the matches several times; written, they are found once.
    rows = written(rows)
    found = raised(rows, docs, {k: r.context for k, r in enumerate(wanted) if r.context}, text_col, window)
    return dealt(found, rows.count(), "doc_id", "entity").select("doc_id", "entity", "start", "end", "word", "score", F.col("held").isNotNull().alias("checked"))


def raised(rows: DataFrame, docs: DataFrame, context: dict[int, tuple[str, ...]], text_col: str, window: int) -> DataFrame:
    """rows (with which, the recogniser's number) whose score a context word of their recogniser raises; words are parts of text, whatever their case."""
    if not context:
        return rows
    open_, settled = rows.filter("score < 1"), rows.filter("score >= 1")
    # What was written tells its least score by file: where all is settled, no text is read for context words.
    if open_.isEmpty():
        return rows
    words = sorted({w for listed in context.values() for w in listed})
    pairs = [F.struct(F.lit(k).alias("k"), F.lit(words.index(w)).alias("w")) for k, listed in context.items() for w in listed]
    lowered = docs.select("doc_id", F.lower(F.coalesce(text_col, F.lit(""))).alias("text"))
    ends = lambda n: lambda s: F.struct(F.lit(n).alias("w"), s["end"].alias("e"))
    spots = F.flatten(F.array(*[F.transform(detect.literal_spans(F.col("text"), w), ends(n)) for n, w in enumerate(words)]))
    told = lowered.select(F.col("doc_id").alias("of_doc"), F.explode(spots).alias("x")).select("of_doc", "x.w", F.col("x.e").alias("e"), F.explode(F.array(*pairs)).alias("p")).filter("p.w = w")
    told = told.select("of_doc", "e", F.col("p.k").alias("k")).distinct()
    told = told.withColumn("cell", F.explode(F.sequence(F.floor(F.col("e") / CELL), F.floor((F.col("e") + window) / CELL))))
    on = (F.col("doc_id") == F.col("of_doc")) & (F.floor(F.col("start") / CELL) == F.col("cell")) & (F.col("which") == F.col("k")) & F.col("e").between(F.col("start") - window, F.col("start"))
    near = open_.join(apart(told), on, "left_semi").select("doc_id", "which", "start", "end").distinct().withColumn("near", F.lit(True))
    up = F.when(F.col("near"), F.least(F.lit(1.0), F.greatest(F.lit(RAISED), F.col("score") + RAISE))).otherwise(F.col("score"))
    return settled.unionByName(open_.join(apart(near), ["doc_id", "which", "start", "end"], "left").withColumn("score", up).drop("near"))


def without_contained(found: DataFrame) -> DataFrame:
    """found (doc_id, entity, start, end, score, ...) without what lies in a better match of its entity: a higher score, then an
    earlier start, then a greater length; of equal ones one stays."""
    group = W.partitionBy("doc_id", "entity", "cell")
    order = group.orderBy("start", F.desc("end"), F.desc("score"))
    span = F.struct("start", "end", "score")
    rows = found.withColumn("cell", F.explode(F.sequence(F.floor(F.col("start") / CELL), F.floor((F.col("end") - 1) / CELL))))
    # What lies in another one comes after it in this order, so the furthest end before tells most that lie in none.
    before = F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1))
    rows = rows.withColumns({"again": F.coalesce(F.lag(span).over(order) == span, F.lit(False)), "inside": F.coalesce(before >= F.col("end"), F.lit(False))}).filter("NOT again")
    # A cell holds few spans once each is there once: a pattern's own never overlap.
    rows = rows.withColumn("others", F.collect_list(span).over(group)).filter(F.floor(F.col("start") / CELL) == F.col("cell"))
    first = lambda o: (o["start"] < F.col("start")) | ((o["start"] == F.col("start")) & (o["end"] > F.col("end")))
    better = lambda o: (o["score"] > F.col("score")) | ((o["score"] == F.col("score")) & first(o))
    worse = F.exists("others", lambda o: (o["start"] <= F.col("start")) & (F.col("end") <= o["end"]) & better(o))
    return rows.filter(F.col("doc_id").isNull() | F.col("entity").isNull() | ~(F.col("inside") & worse)).select(*found.columns)


def analyse(docs: DataFrame, recognisers: tuple[Recogniser, ...] = DEFAULT, entities: list[str] | None = None, threshold: float = 0.0, apart: bool = False, text_col: str = "text") -> DataFrame:
    """Scored matches at or above the threshold without those that lie in a better one of their entity; with apart, those without any overlap whose scores sum highest."""
    rows = without_contained(scored(docs, recognisers, entities, text_col)).filter(F.col("score") >= threshold)
    return choose.heaviest(rows) if apart else rows
