"""Patterns run by Spark's engine against Python's re, over random texts of several scripts."""

import random
import re

import pytest
from pyspark.sql import functions as F

from spanloom.functions import patterns
from spanloom.operators import detect, reports

PIECES = ["a", "B", "k", "K", "ſ", "S", "s", "ß", "İ", "ı", "i", "é", "É", "é", "1", "９", "０", "٣", "²", "Ⅷ", "一", "山", "田", "さん", "様", "々", "_", "-", ".", "\n", "\r\n", " ", "　", "\x1c", "\x85", "​", "𝟗", "𠮷", "Ａ", "ｂ", "令和", "年", "0９0-１234-5678", "１２３４５６７８９０１８", "Σ", "ς", "σ", " "]
NATIVE = [
    *detect.PATTERNS.values(), r"\d+", r"\D+", r"\w+さん", r"\W", r"\s+", r"\S{2,}", r"\bK?a", r"\B\w", r"^.", r".$", r"(?m)^.", r"(?m).$", r".\Z", r"\A.", r"(?s).{3}", r"[^\W\d]+", r"[^\s\d一]{2}", r"[^a-z]+?1", r"[\d\-.]{2,}", r"(?a)\w+", r"(?a)\d", r"(?a)\s", r"(?a)\bk",
    r"(?i)k", r"(?i)s+", r"(?i)[a-k]+", r"(?i)[^s]", r"(?i)ß", r"(?i)é", r"(?i)[à-ÿ]", r"(?i)σ", r"(?i)İ", r"(?i)i", r"(?i)ａ", r"(?ia)k", r"(?ia)[r-t]", r"(?i:k)K", r"(?x) \d  # a digit\n \w", r"(?<=山)田", r"(?<!山)田", r"田(?!さん)", r"一|\d|山田", r"(?>a|ab)\w", r"\w++", r"\d{2,3}?", r"(\w)\1", r"(?P<x>[a-z])(?P=x)", r"一", r"[一-鿿々]+", r"\x61", r"\N{LATIN SMALL LETTER A}", r"a{0,2}b", r"(?:ab|一){1,3}",
]
PYTHON_ONLY = [r"(?:ab|c)*d", r"(a)?(?(1)b|c)", r"(?i)(k)\1", r"(?:a|bc)+"]


def texts(seed, n):
    rng = random.Random(seed)
    return ["", *("".join(rng.choice(PIECES) for _ in range(rng.randrange(1, 14))) for _ in range(n))]


def marked(pattern, text, whole):
    out = []
    for m in re.finditer(pattern, text):
        g = 0 if whole else next((k for k in range(1, m.re.groups + 1) if m.end(k) > m.start(k)), 0)
        if m.end(g) > m.start(g):
            out.append((m.start(g), m.end(g), m[g]))
    return out


@pytest.mark.parametrize("whole", [True, False])
def test_spans_are_pythons(spark, whole):
    listed = texts(1, 200)
    rows = spark.createDataFrame(list(enumerate(listed)), "k int, text string").coalesce(1)
    wanted = [*NATIVE, *PYTHON_ONLY, r"\b", r"a*", r"x?"]
    for some in (wanted[k : k + 12] for k in range(0, len(wanted), 12)):
        got = rows.select("k", *[detect.spans(F.col("text"), p, whole).alias(f"p{j}") for j, p in enumerate(some)]).collect()
        for r in got:
            for j, p in enumerate(some):
                assert [tuple(s) for s in r[f"p{j}"]] == marked(p, listed[r["k"]], whole), (p, listed[r["k"]])


def test_search_is_pythons(spark):
    listed = texts(2, 150)
    rows = spark.createDataFrame([*enumerate(listed), (-1, None)], "k int, text string").coalesce(1)
    wanted = [*NATIVE, *PYTHON_ONLY, r"\B", r"$", r"^$", r"(?m)^$", r"\b"]
    got = rows.select("k", *[patterns.search(F.col("text"), p).alias(f"p{j}") for j, p in enumerate(wanted)]).collect()
    for r in got:
        for j, p in enumerate(wanted):
            want = None if r["k"] < 0 else re.search(p, listed[r["k"]]) is not None
            assert r[f"p{j}"] == want, (p, listed[r["k"]] if r["k"] >= 0 else None)


def test_what_is_translated():
    assert all(patterns.java(p) is not None for p in NATIVE)
    assert all(patterns.java(p) is None for p in PYTHON_ONLY)
    assert not patterns.readable("(") and not patterns.readable(r"\p{L}") and patterns.readable("(?P<n>a)")
    with pytest.raises(re.error):
        patterns.java("(")


def test_full_width_numbers_are_found(spark):
    docs = spark.createDataFrame([(1, "番号１２３４５６７８９０１８ 電話0３-５２１４-８０００"), (2, "山田太郎さん")], "doc_id long, text string")
    found = detect.recognise(docs, detect.PATTERNS, whole=True).collect()
    assert {(r["entity"], r["word"]) for r in found} == {("INDIVIDUAL_NUMBER", "１２３４５６７８９０１８"), ("PHONE_NUMBER", "0３-５２１４-８０００"), ("PERSON", "山田太郎さん")}
    assert [r["word"] for r in detect.recognise(docs, [("PERSON", r"\w+さん")]).collect()] == ["山田太郎さん"]
    assert [r["word"] for r in detect.recognise(docs, [("PERSON", r"(\w+)さん")]).collect()] == ["山田太郎"]


def test_patterns_that_only_one_engine_reads(spark):
    docs = spark.createDataFrame([(1, "abc def", "PERSON", 0, 3, "abc", "auto", 0, 0, 0)], "doc_id long, text string, entity string, start int, end int, word string, origin string, page_num int, block_num int, offset int")
    found = docs.select("doc_id", "entity", "start", "end", "word", "origin")
    assert detect.omit(found, docs, [r"(?P<n>a)", r"\p{L}"]).count() == 0
    assert reports.filtered(docs, text="(?P<n>a)", page="(").count() == 1 and reports.filtered(docs, text="(?P<n>x)").count() == 0
    assert {r["word"] for r in detect.exact_words(docs, [("(?P<n>d)e", "OTHER")], found).collect()} == {"de"}
    with pytest.raises(ValueError):
        detect.compile_patterns([("PERSON", "(")], strict=True)
