"""Secret scans (DataFrame and SQL functions only).

Base spans come from three patterns.  The method adds spans: two character Markov chains, of random strings and of
ordinary identifiers, are compared by log-likelihood ratio over every long token and over its best stretches, since a
token may be an ordinary path or name with a random value behind it.  The chains are fitted on the driver
from labelled samples that rules below write out (a few hundred short strings, none from the corpus), then placed into
the plan as one literal row of quarter-nat steps for each first character.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.common import read
from spanloom.operators.detect import let, running_spans

# The three base patterns, in the order in which equal starts are listed.
ASSIGN = r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]+"
ASSIGN_HEAD = r"^[A-Za-z_]+[\"']?\x20*[:=]\x20*[\"']?"
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "markov")
#: Characters of a token that the chains judge, and the length from which they do.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
#: Quarter nats of evidence from which a token counts as random; characters that a random stretch of another token has at least.
EVIDENCE, STRETCH = 24, 20
_ZERO, _STEP, _MOST = 80, 4, 31

# Parts of ordinary identifiers, file names and prose.
_PARTS = (
    "account address after again always application array average background before between building button cache "
    "calendar change channel children client collection column command compare computer config connection container "
    "content context controller country create current customer database default delete description destination "
    "development device dictionary different directory document double element encoding environment error example "
    "exception execution factory feature field filter function general government handler header history identifier "
    "image important index information initial input instance interface international invoice keyboard language length "
    "library listener location manager maximum memory message method minimum monitor network notification number object "
    "operation option order output package parameter parser password people picture pointer position previous process "
    "product program project property protocol provider question random record reference register remote repository "
    "request resource response result returning schedule search section security selection sequence server service "
    "session setting something source standard statement storage string structure supplier support system table target "
    "template through together transaction translation transport understanding update user utility validation value "
    "version window without worker writer abschnitt arbeitszeit aufgabe bedeutung beispiel einheit entwicklung ergebnis "
    "geschwindigkeit gesellschaft nachricht schreiben verbindung wirtschaft zusammenarbeit appartement aujourdhui "
    "bibliotheque changement connaissance developpement enseignement environnement gouvernement maintenant naturellement "
    "quelquechose renseignement aplicacion conocimiento desarrollo direccion empresa informacion naturalmente pregunta "
    "respuesta sociedad trabajador universidad"
).split()


def labelled_samples() -> list[tuple[str, int]]:
    """(string, 1 if random else 0), by rule: digests in several alphabets; parts joined as identifiers are, dates, paths and numbers."""
    out = []
    for i in range(400):
        raw = hashlib.sha512(f"random string {i}".encode()).digest()
        sets = (ALPHABET[:62], ALPHABET[:64], ALPHABET[26:62], ALPHABET[:26] + ALPHABET[52:62], "0123456789abcdef")
        letters = sets[i % len(sets)]
        out.append(("".join(letters[b % len(letters)] for b in raw[: 24 + i % 40]), 1))
        a, b, c = (_PARTS[(i * k + k) % len(_PARTS)] for k in (1, 7, 31))
        joined = (
            f"{a}_{b}_{c}", f"{a}{b.title()}{c.title()}", f"{a.title()}{b.title()}{c.title()}", f"{a.upper()}_{b.upper()}_{c.upper()}", f"{a}-{b}-{c}-{i}",
            f"/{a}/{b}/{c}/{2000 + i % 30}/{1 + i % 12:02d}/{1 + i % 28:02d}", f"{a}{b}{c}", f"{2000 + i % 30}-{1 + i % 12:02d}-{1 + i % 28:02d}-{a}-{b}", f"{a}_{i}_{b}_v{i % 9}", f"{i * 7919 % 10**6:06d}{i * 104729 % 10**6:06d}{i * 1299709 % 10**8:08d}",
            "=" * 20 + "-" * 20, "_" * 12 + a + "_" * 12, (ALPHABET * 2)[i % len(ALPHABET) :][:24],
        )
        out.append((joined[i % len(joined)], 0))
    return out + [(c * 24, 0) for c in ALPHABET]


def log_ratios(samples: list[tuple[str, int]] | None = None) -> list[list[int]]:
    """Quarter nats by first and second character: how much likelier the step is in a random string.  Steps are smoothed by one half."""
    steps, firsts = (Counter(), Counter()), (Counter(), Counter())
    for text, label in samples or labelled_samples():
        for a, b in zip(text, text[1:]):
            steps[label][a, b] += 1
            firsts[label][a] += 1
    n = len(ALPHABET) / 2

    def ratio(a: str, b: str) -> int:
        p, q = ((steps[k][a, b] + 0.5) / (firsts[k][a] + n) for k in (1, 0))
        return max(-_MOST, min(_MOST, round(_STEP * math.log(p / q))))

    return [[ratio(a, b) for b in ALPHABET] for a in ALPHABET]


def random_parts(token: Column) -> Column:
    """Array of (a, b), the token's random parts: all of it if its whole evidence suffices, else each stretch whose own does.

    A stretch ends where its evidence is used up or has fallen by EVIDENCE; it is widened to the next / and = around it, or
    gives up the end of a part that lies outside it for the most.  The token, whose characters are all of ALPHABET, is
    turned into codes once, and every place is looked up by index: the time is linear in its length.
    """
    table = F.array(*[F.lit("".join(chr(_ZERO + x) for x in row)) for row in log_ratios()])
    ends_part = lambda c: c.isin(*[ALPHABET.index(x) + 1 for x in "/="])
    empty = F.array().cast("array<struct<a:int,b:int,ca:int,cb:int>>")

    def kept(acc: Column) -> Column:
        found = F.struct(acc["a"].alias("a"), acc["b"].alias("b"), acc["ca"].alias("ca"), acc["cb"].alias("cb"))
        return F.when((acc["best"] >= EVIDENCE) & (acc["b"] - acc["a"] >= STRETCH), F.concat(acc["found"], F.array(found))).otherwise(acc["found"])

    def step(acc: Column, x: Column) -> Column:
        """count: the / and = among the characters up to this step's first; ca and cb: those before a and b."""
        at, now = acc["at"] + 1, acc["now"] + x["x"]
        after = acc["count"] + x["c"]
        ends, best = (now <= 0) | (now <= acc["best"] - EVIDENCE), now > acc["best"]
        going = F.struct(at.alias("at"), now.alias("now"), after.alias("count"), acc["a"].alias("a"), acc["ca"].alias("ca"), F.greatest(acc["best"], now).alias("best"), F.when(best, at + 1).otherwise(acc["b"]).alias("b"), F.when(best, after).otherwise(acc["cb"]).alias("cb"), acc["found"].alias("found"))
        anew = F.struct(at.alias("at"), F.lit(0).alias("now"), after.alias("count"), at.alias("a"), acc["count"].alias("ca"), F.lit(0).alias("best"), at.alias("b"), acc["count"].alias("cb"), kept(acc).alias("found"))
        return F.when(ends, anew).otherwise(going)

    def widened(x: Column, t: Column) -> Column:
        cuts, n = t["cuts"], t["n"]
        at = lambda i: F.get(cuts, i)
        before = x["a"] - F.when(x["ca"] > 0, at(x["ca"] - 1) + 1).otherwise(0)
        next_ = F.coalesce(at(x["cb"]), n)
        head = F.when(at(x["ca"]) < x["b"], at(x["ca"]) - x["a"] + 1).otherwise(0)
        tail = F.when((x["cb"] > 0) & (at(x["cb"] - 1) >= x["a"]), x["b"] - at(x["cb"] - 1)).otherwise(0)
        a = F.when((head > 0) & (before >= head), x["a"] + head).otherwise(x["a"] - before)
        b = F.when((tail > 0) & (next_ - x["b"] >= tail), x["b"] - tail).otherwise(F.when(next_ >= t["bare"], n).otherwise(next_))
        return F.struct(a.alias("a"), b.alias("b"))

    def of(t: Column) -> Column:
        first = F.when(ends_part(F.get(t["codes"], F.lit(0))), 1).otherwise(0)
        start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("now"), first.alias("count"), F.lit(0).alias("a"), F.lit(0).alias("ca"), F.lit(0).alias("best"), F.lit(0).alias("b"), F.lit(0).alias("cb"), empty.alias("found"))
        stretches = F.aggregate(t["steps"], start, step, kept)
        total = F.aggregate(t["steps"], F.lit(0), lambda a, x: a + x["x"])
        whole = F.array(F.struct(F.lit(0).alias("a"), t["n"].alias("b")))
        return F.when(total >= EVIDENCE, whole).otherwise(F.array_distinct(F.transform(stretches, lambda x: widened(x, t))))

    def known(codes: Column) -> Column:
        n = F.size(codes)
        pair = lambda a, b: F.struct((F.ascii(F.substring(F.element_at(table, a), b, 1)) - _ZERO).alias("x"), F.when(ends_part(b), 1).otherwise(0).alias("c"))
        cuts = F.filter(F.transform(codes, lambda c, i: F.when(ends_part(c), i)), lambda i: i.isNotNull())
        steps = F.zip_with(F.slice(codes, 1, n - 1), F.slice(codes, 2, n - 1), pair)
        return F.struct(codes.alias("codes"), n.alias("n"), steps.alias("steps"), cuts.alias("cuts"), F.length(F.regexp_replace(token, "=+$", "")).alias("bare"))

    return let(F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c)), lambda codes: let(known(codes), of))


def _spans(text: Column, pattern: str, kind: str, keep=None, parts=None) -> Column:
    """Array of (start, rank, end) in code points, end exclusive, of the pattern's leftmost non-overlapping matches that keep() admits.

    With parts(), of those parts of each match.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    rank = F.lit(KINDS.index(kind)).alias("rank")

    def of(hits: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits))
        found = running_spans(F.zip_with(gaps, hits, lambda gap, hit: F.struct(F.length(gap).alias("gap"), hit.alias("hit"))))
        if parts:
            return F.flatten(F.transform(found, lambda x: F.transform(parts(x["text"]), lambda p: F.struct((x["start"] + p["a"]).alias("start"), rank, (x["start"] + p["b"]).alias("end")))))
        good = F.filter(found, lambda x: keep(x["text"])) if keep else found
        return F.transform(good, lambda x: F.struct(x["start"].alias("start"), rank, x["end"].alias("end")))

    empty = F.array().cast("array<struct<start:int,rank:int,end:int>>")
    return let(hits, lambda h: F.when(F.size(h) > 0, of(h)).otherwise(empty))


def _held(spans: Column, c: Column) -> Column:
    """Whether one of the spans, which are in order and don't overlap, contains c: only the last that starts at c or before can."""
    ends = F.struct(F.lit(-1).alias("lo"), F.size(spans).alias("hi"))

    def halve(x: Column) -> Column:
        mid = F.shiftright(x["lo"] + x["hi"], 1)
        before = F.get(spans, mid)["start"] <= c["start"]
        return F.when(x["hi"] - x["lo"] <= 1, x).otherwise(F.struct(F.when(before, mid).otherwise(x["lo"]).alias("lo"), F.when(before, x["hi"]).otherwise(mid).alias("hi")))

    last = F.aggregate(F.sequence(F.lit(1), F.lit(32)), ends, lambda x, _: halve(x), lambda x: x["lo"])
    return (F.size(spans) > 0) & F.coalesce(F.get(spans, F.greatest(last, F.lit(0)))["start"] <= c["start"], F.lit(False)) & F.coalesce(F.get(spans, F.greatest(last, F.lit(0)))["end"] >= c["end"], F.lit(False))


def _listed(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.element_at(kinds, x["rank"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, assign, access, hex, markov - arrays of (start, rank, end) in code points.

    Null and empty texts give empty arrays, repeated rows a row each, null ids stay null, an empty table no rows.
    markov holds tokens of 20 characters or more that the chains call random, or their random stretches, unless a base
    span contains them.
    """
    text = F.col("text")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    long_enough = lambda hit: F.length(F.regexp_replace(hit, ASSIGN_HEAD, "")) >= 6
    rows = rows.select(
        "doc_id",
        _spans(text, ASSIGN, "assign", long_enough).alias("assign"),
        _spans(text, ACCESS, "access").alias("access"),
        _spans(text, HEX, "hex").alias("hex"),
        _spans(text, TOKEN, "markov", parts=random_parts).alias("random"),
    )
    inside = lambda c: _held(F.col("assign"), c) | _held(F.col("access"), c) | _held(F.col("hex"), c)
    apart = F.filter("random", lambda c: ~inside(c))
    return rows.select("doc_id", "assign", "access", "hex", apart.alias("markov"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """(doc_id, text) with each base pattern's match replaced by mark, nulls kept."""
    text = F.col(text_col)
    for pattern in (ASSIGN, ACCESS, HEX):
        text = F.regexp_replace(text, pattern, mark)
    return docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(read(spark, sf_dir, "documents"))
    base = F.concat("assign", "access", "hex")
    return found.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(_listed(base).cast("binary"), 256).alias("base_sha256"),
        _listed(F.concat(base, "markov")).alias("spans"),
    )
