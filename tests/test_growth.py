"""What must not grow with the square of the input, or go whole to one machine: held against plans and brute force."""

import random
import re
import unicodedata

import duckdb
import pytest
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

import __spark_entry__ as entry
from spanloom.operators import detect, highlights, layout, legacy, maps, ocr, offsets, pages, registry, resolve
from spanloom.plans import queries, recognition, service

SMALL = "/root/testdata/sf0.001"


def _sent_after_explode(frame) -> list[str]:
    """Broadcasts of the plan whose rows come out of an explode."""
    lines = frame._jdf.queryExecution().executedPlan().toString().split("\n")
    depth = lambda x: len(re.match(r"[\s:+\-|]*", x).group(0))
    out = []
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            inside = []
            for x in lines[i + 1 :]:
                if depth(x) <= depth(line):
                    break
                inside.append(x)
            out += [line] if any("Generate" in x for x in inside) else []
    return out


@pytest.mark.parametrize("name", ["map_rects", "mask_dispatch", "page_rows", "service_mask", "visible_chars", "omitted", "text_colours"])
def test_exploded_rows_are_not_sent_to_all(spark, name):
    assert not _sent_after_explode(entry.queries()[name](spark, SMALL))


RECT = "doc_id long, page_num int, idx long, x0 double, y0 double, x1 double, y1 double"


def test_equal_rectangles_make_no_pairs(spark, monkeypatch):
    n = 20_000
    alike = spark.range(n).selectExpr("0L AS doc_id", "1 AS page_num", "id AS idx", "10d AS x0", "10d AS y0", "40d AS x1", "30d AS y1")
    monkeypatch.setattr(queries, "_rects", lambda spark, d: alike)
    assert [tuple(r) for r in queries.rect_pairs(spark, "").collect()] == [(1, n * (n - 1) // 2, n * (n - 1) // 2)]
    points = alike.selectExpr("idx AS pid", "doc_id", "page_num", "45d AS x", "20d AS y")
    assert layout.nearest_char(points, alike, 30.0).groupBy("idx").count().collect() == [(0, n)]
    marks = alike.selectExpr("doc_id", "idx AS seq", "page_num", "'OTHER' AS entity", "'auto' AS origin", "array(array(x0, y0, x1, y1)) AS quads")
    assert [r["seq"] for r in legacy.keep(marks).collect()] == [0]


def test_quads_join_as_their_pairs_do(spark):
    rng = random.Random(3)
    some = lambda: [float(a := rng.randrange(-60, 200)), float(b := rng.randrange(200)), float(a + rng.randrange(-1, 40)), float(b + rng.randrange(40))]
    pool = [[some() for _ in range(rng.randrange(1, 3))] for _ in range(60)] + [[], None]
    rows = [(rng.randrange(2), k, rng.choice([0, 1, None]), rng.choice(pool)) for k in range(300)]
    found = spark.createDataFrame(rows, "doc_id long, seq long, page_num int, quads array<array<double>>").withColumns({"entity": F.lit("OTHER"), "origin": F.lit("auto")})
    for mode in ("overlap", "contain", "exact"):
        got = {(r["doc_id"], r["seq"]): r["comp"] for r in legacy.components(found, mode).collect()}
        assert got == {(r["doc_id"], r["seq"]): r["comp"] for r in resolve.labelled(found, legacy.quad_edges(found, mode)).collect()}, mode


def test_new_marks_beside_many(spark):
    rng = random.Random(5)
    of = lambda n: [(rng.randrange(2), rng.randrange(2), rng.choice(["A", None]), rng.choice(["w", "", None]), *[rng.choice([0.0, 0.05, 0.1, 0.95, 1.0, 1.05, -0.05, None]) for _ in range(4)]) for _ in range(n)]
    kind = "doc_id long, page_num int, entity string, word string, x0 double, y0 double, x1 double, y1 double"
    planned, old = of(300), of(300)
    for by_entity in (False, True):
        for tolerance in (0.1, 0.0, 0.5):
            near = lambda a, b: all(p is not None and q is not None and abs(p - q) <= tolerance for p, q in zip(a[4:], b[4:])) and (not by_entity or (a[2] or "") == (b[2] or ""))
            left = sorted(map(repr, (a for a in planned if not any(a[:2] == b[:2] and (a[3] or "") == (b[3] or "") and near(a, b) for b in old))))
            got = highlights.new_ones(spark.createDataFrame(planned, kind), spark.createDataFrame(old, kind), tolerance, by_entity).collect()
            assert sorted(repr(tuple(r)) for r in got) == left
    many = spark.range(30_000).selectExpr("0L AS doc_id", "0 AS page_num", "'A' AS entity", "'w' AS word", "double(id) AS x0", "0d AS y0", "1d AS x1", "1d AS y1")
    assert highlights.new_ones(many.withColumn("x0", F.col("x0") + 0.5), many).count() == 30_000


def test_points_and_circles(spark):
    rng = random.Random(9)
    rects = [(rng.randrange(2), 0, k, float(a := rng.randrange(-80, 150)), float(b := rng.randrange(150)), float(a + rng.randrange(60)), float(b + rng.randrange(60))) for k in range(120)]
    points = [(k, rng.randrange(2), 0, float(rng.randrange(-90, 200)), float(rng.randrange(200)), float(rng.randrange(40))) for k in range(120)]
    chars, circles = spark.createDataFrame(rects, RECT), spark.createDataFrame(points, "pid long, doc_id long, page_num int, x double, y double, radius double")
    away = lambda p, r: max(r[3] - p[3], 0, p[3] - r[5]) ** 2 + max(r[4] - p[4], 0, p[4] - r[6]) ** 2
    same = lambda p, r: p[1] == r[0]
    got = sorted(map(tuple, layout.chars_in_circle(circles, chars).collect()))
    assert got == sorted((p[0], r[2]) for p in points for r in rects if same(p, r) and away(p, r) <= p[5] ** 2)
    best = {p[0]: min(d)[1] for p in points if (d := [(away(p, r), r[2]) for r in rects if same(p, r) and away(p, r) <= 900])}
    assert dict(map(tuple, layout.nearest_char(circles.drop("radius"), chars, 30.0).collect())) == best
    under = {p[0]: min(h) for p in points if (h := [r[2] for r in rects if same(p, r) and away(p, r) == 0])}
    assert dict(map(tuple, layout.char_at(circles, chars).collect())) == under


def test_read_items_meet_truth_page_by_page(spark, monkeypatch):
    rng = random.Random(11)
    word = lambda: rng.choice(["a", "ab", "b", "Ａ b", "", "abc", " c"])
    of = lambda n: [(rng.choice(["p", "q", None]), rng.randrange(2), k, word(), float(rng.randrange(9)), float(rng.randrange(9))) for k in range(n)]
    truth, read = of(60), of(80)
    norm = lambda t: "".join(unicodedata.normalize("NFKC", t).split())
    want = []
    for page in {r[:2] for r in read}:
        free = [t for t in truth if t[:2] == page]
        for o in (r for r in read if r[:2] == page):
            hit = next((g for g in free if norm(o[3]) and (norm(o[3]) in norm(g[3]) or norm(g[3]) in norm(o[3]))), None)
            if hit:
                free.remove(hit)
                want.append((*page, hit[2], o[2], o[4] - hit[4], o[5] - hit[5]))
    frame = lambda rows: spark.createDataFrame(rows, "doc_id string, page_num int, seq long, text string, x double, y double")
    # One call of Python a page would be too many: pages go through in batches.
    monkeypatch.delattr("pyspark.sql.pandas.group_ops.PandasCogroupedOps.applyInPandas")
    assert sorted(map(repr, map(tuple, ocr.pairs(frame(truth), frame(read)).collect()))) == sorted(map(repr, want))


@pytest.mark.parametrize("name", ["exact_groups", "winners", "contain_components", "legacy_tie_break"])
def test_documents_are_dealt_by_their_number(spark, monkeypatch, name):
    monkeypatch.setattr("spanloom.shipping.ROWS_A_TASK", 100)
    dealt = re.findall(r"hashpartitioning\(doc_id#\w+, (\d+)\), REPARTITION_BY_NUM", entry.queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString())
    assert dealt and min(map(int, dealt)) == spark.read.parquet(f"{SMALL}/lineitem.parquet").count() // 100


def test_a_result_is_read_a_few_times(spark):
    raw = spark.createDataFrame([(1, 0, '[["a", [1, 2, 3, 4], 0.5]]'), (1, 1, '{"lines":[{"text":"b","box":{"x":1,"y":2,"width":3,"height":4}}]}')], "doc_id long, page_num int, raw string")
    rows = ocr.items(raw)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("get_json_object") < 60 and plan.count("from_json") < 10
    assert sorted((r["text"], r["x"], r["y"], r["width"], r["height"]) for r in rows.collect()) == [("a", 1.0, 2.0, 2.0, 2.0), ("b", 1.0, 2.0, 3.0, 4.0)]


def test_pages_are_dealt_to_engines(spark):
    pages = spark.range(64).coalesce(1).selectExpr("id AS doc_id", "0 AS page_num", "100d AS width", "100d AS height", "binary('a') AS image")
    own = pages.selectExpr("doc_id", "page_num", "0d AS x0", "0d AS y0", "1d AS x1", "1d AS y1")
    written, failed = recognition.run_ocr(pages, own, lambda image, page, covered: '[["w", [1, 2, 30, 40]]]')
    assert written.count() == 64 and failed.rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism


def test_patterns_run_once_and_find_what_python_finds(spark):
    rng = random.Random(13)
    wanted = [r.patterns[0][0] for r in registry.DEFAULT[:4]] + [r"\b[a-c]+\b", r"\b_x?", r"\b(?<!-)\d", r"\b\u00e9", r"\b[\u4e00-\u9fff]", r"(?i)\bk", r"a|b$"]
    texts = ["".join(rng.choice("a b_x-.1é2山年@k\n\uf8f1$\\"[: 24 if k % 3 else 18]) for _ in range(40)) for k in range(120)] + ["", None, "ab\uf8f1ab"]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    rows = docs.select("text", *[detect.spans(F.col("text"), p, whole=True).alias(f"p{k}") for k, p in enumerate(wanted)]).collect()
    for r in rows:
        for k, p in enumerate(wanted):
            assert [tuple(s) for s in r[f"p{k}"]] == [(m.start(), m.end(), m[0]) for m in re.finditer(p, r["text"] or "")], (p, r["text"])
    once = registry.scored(spark.createDataFrame([(1, "1999年")], "doc_id long, text string"), entities=["YEAR", "PERSON"])
    assert "regexp" not in once._jdf.queryExecution().analyzed().toString()


def test_words_in_few_texts_are_looked_up_there_alone(spark):
    text = spark.createDataFrame([("aXaXa",), ("b",), (None,)], "text string").select("text", detect.literal_spans(F.col("text"), "aXa").alias("s"))
    assert [[(x["start"], x["end"]) for x in r["s"]] for r in text.collect()] == [[(0, 3), (2, 5)], [], []]


def test_documents_without_highlights_are_not_given_to_python(spark):
    text = "string(id) || ' ab ab'"
    docs = spark.range(200).selectExpr("id AS doc_id", f"{text} AS text")
    marks = docs.filter("doc_id < 2").crossJoin(spark.range(2)).selectExpr("doc_id", "id AS seq", "'Auto ' AS title", "'x' AS content", "'ab' AS detect_word", "'OTHER' AS entity_type")
    placed = highlights.to_detections(marks, docs)
    assert "LeftSemi" in placed._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r["doc_id"], r["seq"], r["start"], r["end"], r["origin"]) for r in placed.collect()) == [(d, k, 2 + 3 * k, 4 + 3 * k, "auto") for d in (0, 1) for k in (0, 1)]


@pytest.mark.parametrize("name, task_rows", [("text_colours", "p_partkey"), ("ocr_items", "p_partkey"), ("omitted", "o_orderkey")])
def test_few_bytes_that_make_much_are_dealt(spark, monkeypatch, name, task_rows):
    dealt_by = []
    whole = DataFrame.repartition
    monkeypatch.setattr(DataFrame, "repartition", lambda self, n, *keys: dealt_by.append(keys) or whole(self, n, *keys))
    entry.queries()[name](spark, SMALL)
    assert (task_rows,) in dealt_by


def test_check_digits_by_steps(spark):
    """Luhn by pairs and account numbers by runs of digits are what they are digit by digit, with few steps to a number."""
    rng = random.Random(6)
    words = ["", "a", "0", "18", "79927398713", "１８", "DE89370400440532013000", "GB82 WEST 1234 5698 7654 32", "DE", None] + ["".join(rng.choice("0123456789ABz -") for _ in range(rng.randrange(1, 36))) for _ in range(400)]

    def luhn(w):
        d = [int(x) for x in w if x.isdigit()]
        return None if not d else sum(x if i % 2 == 0 else 2 * x - (9 if x > 4 else 0) for i, x in enumerate(reversed(d))) % 10 == 0

    def mod97(w):
        b = "".join(c for c in w if c.isascii() and c.isalnum()).upper()
        return len(b) > 4 and int("".join(c if c.isdigit() else str(ord(c) - 55) for c in b[4:] + b[:4])) % 97 == 1

    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", registry.luhn(F.col("w")).alias("l"), registry.mod97(F.col("w")).alias("m")).collect()
    assert [(r["l"], r["m"]) for r in rows] == [(luhn(r["w"]), mod97(r["w"])) if r["w"] is not None else (None, None) for r in rows]
    plan = spark.range(1).select(registry.mod97(F.col("id").cast("string")).alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 1


def test_chunks_without_delimiter_need_no_python(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "a\n😀é" * 5), (4, "x" * 7), (5, "y" * 14), (6, "z" * 15)], "doc_id long, text string")
    cut = detect.chunks(docs, delimiter="", max_chars=7, max_bytes=28)
    assert "Python" not in cut._jdf.queryExecution().executedPlan().toString()
    want = sorted((r["doc_id"], c, s) for r in docs.collect() for c, s in detect.split_text(r["text"] or "", "", 7, 28))
    assert sorted(map(tuple, cut.select("doc_id", "chunk", "start_offset").collect())) == want
    assert "Python" in detect.chunks(docs, delimiter="", max_chars=7, max_bytes=27)._jdf.queryExecution().executedPlan().toString()


def test_target_is_made_once(spark):
    """Patterns, segments, blocks and exclusions read a written target: documents are read once for it."""
    from pyspark.sql import types as T

    made = spark.sparkContext.accumulator(0)
    pages_ = T.ArrayType(T.ArrayType(T.StringType()))

    @F.udf(pages_)
    def text(k):
        made.add(1)
        return [[f"aaa b{k}", "c"], ["dd d"]]

    docs = spark.range(5).select(F.col("id").alias("doc_id"), text("id").alias("text"))
    found = service.run_detect(docs, {"recognisers": {}, "ignore_whitespace": True, "add": [("OTHER", "a{3,}|d{3,}")], "exclude": ["zz"]})
    assert sorted((r["doc_id"], r["word"], r["last"]["offset"]) for r in found.collect()) == sorted((i, w, o) for i in range(5) for w, o in (("aaa", 2), ("ddd", 3)))
    assert made.value == 5


def test_hidden_characters_by_hash(spark):
    """Many hidden places of a page, repeated characters among them: each character goes just where its own place is hidden."""
    char = lambda k: {"c": "ab"[k % 2], "x": float(k % 40), "y": float(k // 40), "bbox": [0.0, 0.0, 1.0, 1.0]}
    page = {"blocks": [{"bbox": None, "lines": [{"spans": [{"chars": [char(k) for k in range(400)]}]}]}], "trace": [{"opacity": 0.0, "x": k % 40 + 0.0001, "y": float(k // 40), "c": "ab"[k % 2 if k % 3 else 0]} for k in range(0, 400, 7)]}
    hidden = {(k % 40, k // 40, "ab"[k % 2 if k % 3 else 0]) for k in range(0, 400, 7)}
    docs = spark.createDataFrame([(1, [page])], f"doc_id long, pages {pages.PAGES}")
    want = "".join("ab"[k % 2] for k in range(400) if (k % 40, k // 40, "ab"[k % 2]) not in hidden)
    p = F.col("pages")
    row = docs.select(pages.block_texts(p).alias("b"), pages.locator_texts(p)["full_text"].alias("t")).first()
    read = docs.select(pages.seen(p).alias("pages")).select(pages.locator_texts(p, drawn=False)["full_text"].alias("again"), pages.texts_of(pages.block_infos(p, drawn=False)).alias("infos")).first()
    assert row["b"] == [[want]] == read["infos"] and row["t"] == want == read["again"]


def test_spans_meet_their_characters_by_stretches(spark):
    """A span is a row a stretch, not one a character; its characters are all of those it covers, beside borders of stretches too."""
    spans = spark.createDataFrame([(1, 1, 5, 9), (1, 2, 1000, 2100), (1, 3, 1023, 1024), (1, 4, 7, 7), (2, 1, 0, 3000)], "doc_id long, det long, start long, end long")
    chars = spark.range(2500).select(F.explode(F.array(F.lit(1).cast("long"), F.lit(2).cast("long"))).alias("doc_id"), F.col("id").alias("goffset"), F.lit("x").alias("ch"))
    got = layout.chars_of_spans(spans, chars)
    want = {(d, n): [g for g in range(a, b) if g < 2500] for d, n, a, b in map(tuple, spans.collect())}
    found = {k: [] for k in want}
    for r in got.collect():
        found[r["doc_id"], r["det"]].append(r["goffset"])
    assert {k: sorted(v) for k, v in found.items()} == want
    assert "1024" in got._jdf.queryExecution().optimizedPlan().toString() and set(got.columns) == {"doc_id", "det", "goffset", "ch"}


def test_a_map_is_brought_together_once(spark):
    place = [F.col("id").cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")]
    rows = spark.range(400).select((F.col("id") % 7).alias("doc_id"), (F.col("id") % 3).alias("page_num"), (F.col("id") % 2).alias("block_num"), F.col("id").alias("offset"), *place)
    wire = maps.offset_map(rows)
    assert wire._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert sorted(map(tuple, maps.mapped(wire).select("doc_id", "page_num", "block_num", "x0").collect())) == sorted((i % 7, i % 3, i % 2, float(i)) for i in range(400))


def test_settled_matches_need_no_context_and_no_join(spark, monkeypatch):
    """Where every score is settled no text is read again, and what lies in a better match is told by windows over cells in tasks of few rows."""
    monkeypatch.setattr("spanloom.shipping.ROWS_A_TASK", 100)
    spots = []
    literal = detect.literal_spans
    monkeypatch.setattr(detect, "literal_spans", lambda text, word: spots.append(word) or literal(text, word))
    docs = spark.range(2000).selectExpr("id AS doc_id", "'visa 4111111111111111 and 1.2.3.4' AS text")
    found = registry.analyse(docs, entities=["CREDIT_CARD", "IP_ADDRESS"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not spots and "Join" not in plan and re.findall(r"hashpartitioning\(doc_id#\w+, entity#\w+, (\d+)\), REPARTITION_BY_NUM", plan) == ["40"]
    assert plan.count("Exchange") == 1 and found.count() == 4000
    registry.analyse(spark.createDataFrame([(1, "1999年")], "doc_id long, text string"), (registry.Recogniser("YEAR", ((detect.PATTERNS["YEAR"], 0.5),), None, ("x",)),))
    assert spots == ["x"]
    # Repeated spans stand once, whatever their number; a better one of another cell's beginning is met.
    kind = "doc_id long, entity string, start int, end int, score double"
    rows = [(1, "A", 5, 9, 0.5)] * 300 + [(1, "A", 0, 600, 0.9), (1, "A", 300, 310, 0.5), (1, "A", 520, 610, 0.5), (None, "A", 1, 2, 0.5), (None, "A", 0, 5, 0.5)]
    left = registry.without_contained(spark.createDataFrame(rows, kind)).collect()
    assert sorted(map(repr, map(tuple, left))) == sorted(map(repr, [rows[300], rows[302], rows[303], rows[304]]))


def test_patterns_look_at_few_first_characters(spark):
    from spanloom.functions import patterns

    assert patterns.java(r"\b(?<![.-])\d{3}").startswith(r"(?=[\p{Nd}])") and not patterns.java(r"\b[\w.]+").startswith("(?=") and not patterns.java("^a").startswith("(?=")
    texts = ["a12", "12 a", "1.23", "x-1", "ab cd", "éa", "", "１2", "12\n"]
    wanted = [r"\b(?<![.-])\d", r"\b[a-c]", r"\B[0-9]+", r"(?<=a)\d+", r"\b[\w.]+\b", r"(?i)\b[k-z]", r"(?<!x)-?\d"]
    row = lambda p: [[tuple(s) for s in r["s"]] for r in spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1).select(detect.spans(F.col("t"), p, whole=True).alias("s")).collect()]
    for p in wanted:
        assert row(p) == [[(m.start(), m.end(), m[0]) for m in re.finditer(p, t)] for t in texts], p


def test_direct_checks_read_no_line_feed(spark):
    rows = spark.createDataFrame([(w,) for w in ["18\n", "18", "DE89370400440532013000\n", "DE89370400440532013000", "DE89370400440532013001", "GB82WEST12345698765432", "ZZ" + "9" * 34, "ZZ" + "9" * 35]], "w string")
    got = [tuple(r) for r in rows.coalesce(1).select(registry.luhn(F.col("w")), registry.mod97(F.col("w"))).collect()]
    number = lambda b: int("".join(c if c.isdigit() else str(ord(c) - 55) for c in b[4:] + b[:4])) % 97 == 1
    assert [m for _, m in got][2:] == [number(r["w"].strip()) for r in rows.collect()][2:] and [x for x, _ in got][:2] == [True, True]


def test_rows_of_documents_are_joined_and_grouped_in_small_tasks(spark, monkeypatch):
    monkeypatch.setattr("spanloom.shipping.ROWS_A_TASK", 100)
    plan = entry.queries()["manual_and_rest"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    n = spark.read.parquet(f"{SMALL}/lineitem.parquet").count()
    dealt = [int(x) for x in re.findall(r"hashpartitioning\(doc_id#.*?, (\d+)\), REPARTITION_BY_NUM", plan)]
    assert min(dealt) == n // 100 and max(dealt) == 3 * n // 100
    # What is grouped is dealt once: the grouping itself exchanges nothing.
    assert plan.count("Exchange hashpartitioning(what") == 0


def test_page_documents_are_shuffled_as_texts_alone(spark):
    plan = entry.queries()["page_rows"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "ENSURE_REQUIREMENTS" not in plan
    below = [line for line in plan.split("\n") if "REPARTITION_BY_NUM" in line]
    assert below and "collect_list" not in plan.split(below[-1])[1]


def test_places_without_white_space_are_counted_by_pieces(spark, tmp_path, monkeypatch):
    rng = random.Random(17)
    texts = ["".join(rng.choice("ab 　\t\x1c\x85é山😀") for _ in range(rng.randrange(400))) for _ in range(80)] + ["", None, "a", " ", "a" * 64, " " * 64 + "b" + " " * 63 + "c", "\x1f"]
    texts = [t if t is None else t.replace("\n", "") for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, t string").withColumn("t", F.coalesce("t", F.lit("")))
    chars = offsets.target_chars(F.array(F.array("t")), True, True)
    rows = docs.select("doc_id", F.length("t").alias("n"), chars.alias("c"), offsets.pieces(F.col("t")).alias("p")).withColumn("size", offsets.unspaced_size(F.col("p")))
    spans = [(0, 1), (-3, 2), (5, 5), (7, 3), (40, 90), (63, 65), (64, 64), (0, 10**6), (10**6, 10**6), (None, 2), (2, None)]
    for a, b in spans:
        a, b = F.lit(a).cast("int"), F.lit(b).cast("int")
        places = F.transform("c", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
        got = rows.select("doc_id", F.col("size") == F.size("c"), offsets.base_span(a, b, places, F.col("n")) == offsets.unspaced_span(a, b, F.col("p"), F.col("size"), F.col("n"))).collect()
        assert all(r[1] and r[2] for r in got)
    monkeypatch.delattr(offsets, "target_chars")
    lines = spark.createDataFrame([(k, f"{t}\n \n{t}x" if t else t) for k, t in enumerate(t and re.sub("[\x1c-\x1f\x85\t]", "_", t) for t in texts)], "doc_id long, text string").withColumn("lang", F.lit("en"))
    lines.write.parquet(f"{tmp_path}/documents.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert sorted(map(tuple, entry.queries()["target_positions"](spark, str(tmp_path)).collect())) == sorted(db.execute(entry.oracle_sql()["target_positions"]).fetchall())
