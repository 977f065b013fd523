"""The span engine: registered queries against SQL, and small cases of the operators."""

import json

import duckdb
import pytest

import __spark_entry__ as entry
from pyspark.sql import functions as F
from spanloom.functions import geometry as G
from spanloom.functions import values as V
from spanloom.operators import detect, layout, masks, ocr, offsets, resolve
from spanloom.plans import chains, details, more, more_sql
from spanloom.plans import queries as plans
from spanloom.plans import config, steps
from spanloom.sources import files
from spanloom.streaming import arrivals

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def as_text(rows):
    return sorted(tuple("" if v is None else repr(round(v, 6)) if isinstance(v, float) else str(v) for v in r) for r in rows)


ALL, SQL = plans.QUERIES | more.QUERIES | chains.QUERIES | details.QUERIES, plans.SQL | more_sql.SQL | chains.SQL | details.SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, sql, name):
    out = ALL[name](spark, SF)
    columns = sorted(out.columns)
    want = sql.sql(f'SELECT {", ".join(chr(34) + c + chr(34) for c in columns)} FROM ({SQL[name]})').fetchall()
    assert as_text(out.select(*columns).collect()) == as_text(want)


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
    assert set(ALL) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def one(spark, expression):
    return spark.range(1).select(expression.alias("x")).first()["x"]


def test_positions(spark):
    text = F.array(F.array(F.lit("AB"), F.lit("CD")), F.array(F.lit("EF")))
    got = one(spark, offsets.span_positions(text, F.lit(1), F.lit(5)))
    assert (tuple(got["start"]), tuple(got["end"])) == ((0, 0, 1), (1, 0, 0))
    assert one(spark, offsets.target_text(text)) == "ABCDEF"
    assert one(spark, offsets.target_text(text, ignore_newlines=False)) == "AB\nCD\nEF"
    assert one(spark, offsets.target_text(text, pages=[1])) == "EF"
    assert one(spark, offsets.position_of(text, F.lit(6))) is None


def test_stand_in_offset(spark):
    block = spark.createDataFrame([], "doc_id long, page_num int, block_num int, block_start long")
    at = spark.createDataFrame([(1, 2, 1, 3)], "doc_id long, page_num int, block_num int, offset int")
    assert int(offsets.global_offset(block, at).first()["goffset"]) == 2000001000000003


@pytest.mark.parametrize(("text", "ok"), [("1234-5678-9018", True), ("000000000000", False), ("123456789012", False), (None, False), ("", False)])
def test_individual_number(spark, text, ok):
    assert one(spark, V.valid_individual_number(F.lit(text).cast("string"))) is ok


@pytest.mark.parametrize(("text", "ok"), [("03-5214-8000", True), ("0000000000000", False), ("000000000", False), ("090-1234-5678", True)])
def test_phone_number(spark, text, ok):
    assert one(spark, V.valid_phone_number(F.lit(text))) is ok


def test_colours(spark):
    got = [tuple(one(spark, V.colour(F.lit(c)))) for c in ("#F00", "rgba(0,0,255,.5)", "nope")]
    assert got == [(1, 0, 0, None), (0, 0, 1, 0.5), (0.9, 0.9, 0.9, None)]


def test_names(spark):
    assert [one(spark, V.entity_key(F.lit(x))) for x in (" address ", "person", "Pearson", "")] == ["LOCATION", "PERSON", "PEARSON", ""]
    assert V.config_entity("Pearson") == "PERSON" and V.config_entity("address") == "LOCATION" and V.normal_entity(" Address ") == "LOCATION"
    with pytest.raises(ValueError, match="unknown"):
        V.parse_entities("person,nothing")


def test_chunks():
    assert detect.split_text("あ。い。う", max_chars=4) == [("あ。い。", 0), ("う", 4)]
    for text in ("", "a" * 25, "ab。" * 9, "😀" * 11):
        parts = detect.split_text(text, max_chars=7, max_bytes=16)
        assert "".join(p for p, _ in parts) == text and all(text[s : s + len(p)] == p for p, s in parts)
        assert all(len(p) <= 7 and len(p.encode()) <= 16 for p, _ in parts)


def test_resolution(spark):
    rows = [(1, 1, "PERSON", 0, 3, "auto"), (1, 2, "PERSON", 2, 5, "auto"), (1, 3, "PERSON", 5, 7, "auto"), (2, 1, "PERSON", 0, 9, "auto"), (2, 2, "PERSON", 2, 3, "manual")]
    found = spark.createDataFrame(rows, "doc_id long, seq long, entity string, gstart long, gend long, origin string")
    got = sorted((r["doc_id"], r["seq"]) for r in resolve.resolve(found).collect())
    assert got == [(1, 1), (2, 2)]
    pair = spark.createDataFrame([(1, 1, "PERSON", 0, 5, "auto"), (1, 2, "PROPER_NOUN", 4, 8, "auto")], found.schema)
    assert resolve.resolve(pair, entities="same").count() == 2 and resolve.resolve(pair).count() == 1
    assert resolve.resolve(found.limit(0)).count() == 0


def test_detection_and_redaction(spark):
    docs = spark.createDataFrame([(1, "山田さん 03-5214-8000 2024年"), (2, None), (3, "")], "doc_id long, text string")
    found = detect.recognise(docs, detect.PATTERNS, whole=True)
    assert {(r["entity"], r["word"]) for r in found.collect()} == {("PERSON", "山田さん"), ("PHONE_NUMBER", "03-5214-8000"), ("YEAR", "2024年")}
    texts = {r["doc_id"]: r["text"] for r in detect.redact(docs, found, "x").collect()}
    assert texts == {1: "xxxx xxxxxxxxxxxx xxxxx", 2: "", 3: ""}
    assert detect.omit(found, docs, ["山田"]).count() == 2
    assert one(spark, F.transform(detect.literal_spans(F.lit("aaa"), "aa"), lambda s: s["start"])) == [0, 1]


def test_steps(spark):
    docs = spark.createDataFrame([(1, "tel 03-5214-8000")], "doc_id long, text string")
    out = steps.run(docs, [{"op": "read"}, {"op": "detect"}, {"op": "duplicate"}, {"op": "mask", "options": {"mark": "*"}}])
    assert out["docs"].first()["text"] == "tel " + "*" * 12
    with pytest.raises(ValueError, match="unknown steps"):
        steps.run(docs, [{"op": "nothing"}])


def test_lines(spark):
    rects = F.array(*[G.rect(*[F.lit(v) for v in r]) for r in ((0, 0, 5, 10), (6, 1, 9, 11), (0, 20, 5, 30))])
    assert [tuple(r) for r in one(spark, layout.grouped_lines(rects))] == [(0, 0, 9, 11), (0, 20, 5, 30)]
    assert one(spark, G.quad_bounds(F.array(*map(F.lit, (1.0, 2.0, 5.0, 2.0, 5.0, 9.0, 1.0, 9.0)))))["y1"] == 9
    assert one(spark, G.hex_colour(F.lit(1.0), F.lit(0.0), F.lit(0.5))) == "#ff007f"


def test_capture_groups(spark):
    """The first non-empty group is marked, in code points; excluding patterns still count whole."""
    docs = spark.createDataFrame([(1, "é😀 id: 77, id:  x=5 id:"), (2, None)], "doc_id long, text string")
    got = detect.recognise(docs, [("A", r"id:\s*(\d*)(?:\s*x=(\d))?"), ("B", r"x=\d")]).collect()
    assert sorted((r["entity"], r["start"], r["end"], r["word"]) for r in got) == [("A", 7, 9, "77"), ("A", 18, 19, "5"), ("A", 20, 23, "id:"), ("B", 16, 19, "x=5")]
    found = spark.createDataFrame([(1, "E", 16, 17, "x", "auto", 0)], "doc_id long, entity string, start int, end int, word string, origin string, prio int")
    assert detect.omit(found, docs, [r"x=(\d)"]).count() == 0


def test_css_colours(spark):
    got = {n: one(spark, V.colour(F.lit(n))) for n in ("red", " RoyalBlue ", "grey", "nosuch")}
    assert {n: tuple(round(255 * c[x], 3) for x in "rgb") for n, c in got.items()} == {"red": (255, 0, 0), " RoyalBlue ": (65, 105, 225), "grey": (128, 128, 128), "nosuch": (229.5, 229.5, 229.5)}
    assert len(V.CSS_COLOURS) == 21 and all(c["alpha"] is None for c in got.values())


def test_target_and_entity_spans(spark):
    target = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(a + 1).alias("end")) for a in (0, 2, 5)])
    none = F.array().cast("array<struct<start:int,end:int>>")
    cases = {(0, 3): (0, 6), (1, 2): (2, 3), (1, 1): (2, 2), (3, 4): (6, 6), (-2, 9): (0, 6), (2, 1): (5, 5)}
    assert {k: tuple(one(spark, offsets.base_span(F.lit(k[0]), F.lit(k[1]), target, F.lit(6)))) for k in cases} == cases
    assert tuple(one(spark, offsets.base_span(F.lit(4), F.lit(9), none, F.lit(6)))) == (4, 6)
    assert tuple(one(spark, offsets.base_span(F.lit(None).cast("int"), F.lit(9), target, F.lit(6)))) == (0, 0)
    assert tuple(one(spark, offsets.entity_span(F.lit(9), F.lit(4)))) == (4, 9)


def test_target_texts(spark):
    """Target texts and their way back, as the service's own examples have them."""
    text = lambda pages: F.from_json(F.lit(json.dumps(pages)), "array<array<string>>")
    chars = lambda pages, *options: [tuple(c) for c in one(spark, offsets.target_chars(text(pages), *options))]
    kept = chars([["AB", "CD"], ["EF"]], False, False)
    assert "".join(c for c, _, _ in kept) == "AB\nCD\nEF" and kept[2][1:] == (2, 2) and kept[5][1:] == (4, 4)
    bare = chars([["A B", " C"], ["D\tE"]], True, True)
    assert bare == [("A", 0, 1), ("B", 2, 3), ("C", 4, 5), ("D", 5, 6), ("E", 7, 8)]
    assert "".join(c for c, _, _ in chars([["AB", "CD"], ["EF"]], False, True)) == "ABCDEF"
    assert [c for c, _, _ in chars([["AB"], ["CD"], ["EF"]], False, False, [0, 2])] == ["A", "B", "\n", "E", "F"]
    back = lambda a, b, spans, n: tuple(one(spark, offsets.base_span(F.lit(a), F.lit(b), F.from_json(F.lit(json.dumps([{"start": x, "end": y} for _, x, y in spans])), "array<struct<start:int,end:int>>"), F.lit(n))))
    assert back(3, 5, kept, 6) == (2, 4) and back(1, 4, bare, 8) == (2, 6) and back(9, 12, bare, 8) == (8, 8)


def test_blanks_and_ties(spark):
    docs = spark.createDataFrame([(1, "a\u3000\tb xx")], "doc_id long, text string")
    assert detect.recognise(docs, [("OTHER", r"[\u3000\t]+")]).count() == 0
    tied = detect.added(docs, [("PERSON", "xx"), ("LOCATION", "xx"), ("PERSON", "x")])
    assert [(r["entity"], r["word"]) for r in tied.collect()] == [("LOCATION", "xx")]
    assert detect.compile_patterns([("A", "("), ("B", " "), ("C", "(?P<n>a)"), ("D", "a++")]) == [("C", "(?P<n>a)"), ("D", "a++")]
    with pytest.raises(ValueError):
        detect.compile_patterns([("A", "(")], strict=True)


def test_configuration():
    data = {"enabled_entities": [], "add_entity": {"pearson": ["田中", " 田中 ", "山田"], "own": "x"}, "omit_entity": ["a", "a", ""], "ocr_settings": {"font_color": [999, -20, "10"], "opacity": 5.5, "auto_color": "on", "offset_x": "invalid"}, "chunk_settings": {"max_chars": 3}, "keep": 1}
    out = config.normal(data)
    assert out["enabled_entities"] == [] and out["add_entity"]["PERSON"] == ["田中", "山田"] and out["add_entity"]["own"] == ["x"] and out["ommit_entity"] == ["a"] and out["keep"] == 1
    assert out["ocr_settings"]["font_color"] == [255, 0, 10] and out["ocr_settings"]["opacity"] == 1.0 and out["ocr_settings"]["auto_color"] is True and out["ocr_settings"]["offset_x"] == 0.0
    assert out["chunk_settings"]["max_chars"] == 100 and "omit_entity" not in out and config.enabled_entities({"entities": ["nothing"]}) == list(V.ENTITIES)
    assert config.without_words(data, ["田中"])["add_entity"]["PERSON"] == ["山田"] and config.with_omitted(data, ["山田"])["ommit_entity"] == ["a", "山田"]
    assert config.with_added({"ommit_entity": ["山田"]}, [("山田", "person")])["ommit_entity"] == [] and config.target_pages(3, ["2", 0, 2, 9, "x"]) == [2, 0]
    assert config.deep_merged({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}}) == {"a": {"b": 3, "c": 2}} and config.at({"a": {"b": 1}}, "a.b") == 1 and config.at({}, "a.b", 7) == 7
    listed = config.recogniser_patterns({"custom_recognizers": {"x": {"enabled": True, "entity_type": "YEAR", "patterns": [{"regex": "1"}, {}]}, "y": {"enabled": False, "entity_type": "YEAR", "patterns": [{"regex": "2"}]}}, "custom_names": {"enabled": True, "name_list": ["a.b"]}})
    assert listed == [("YEAR", "1"), ("PERSON", "a\\.b")]


def test_mask_specs_and_colours(spark):
    rows = {r["entity"]: (round(r["r"], 3), round(r["alpha"], 3)) for r in masks.mask_styles(spark, ["person=rgba(51,0,0,.5)@0.9", "YEAR=red@2", "address=#00000080"]).collect()}
    assert rows == {"PERSON": (0.2, 0.5), "YEAR": (1.0, 1.0), "LOCATION": (0.0, 0.502)}
    for bad in ("person", "=red", "person=red@x"):
        with pytest.raises(ValueError):
            masks.parse_mask_specs([bad])
    assert one(spark, V.colour(F.lit("rgb(1, 2, 3)")))["r"] == 0.9 and one(spark, V.colour(F.lit("RGB(300,0,0)")))["r"] == 1.0
    assert one(spark, V.is_manual(F.lit(None).cast("boolean"), F.lit("Manual"))) and one(spark, V.manual_entity(F.lit("year"), F.lit("ab"), F.lit(0), F.lit(1), F.lit(5)))["end"]["offset"] == 6


def test_text_colour_and_pages(spark):
    import numpy as np

    picture = np.full((10, 10, 3), 250, np.uint8)
    picture[3:6, 3:7] = (10, 20, 30)
    assert ocr.text_colour(picture) == (10, 20, 30) and ocr.text_colour(picture[:3]) == (0, 0, 0) and ocr.text_colour(picture[:0]) == (0, 0, 0)
    pages = spark.createDataFrame([(1, 0, b"x"), (1, 1, b"")], "doc_id long, page_num int, image binary")

    def engine(image, page):
        if not image:
            raise RuntimeError("no image")
        return '[["t", [0, 0, 2, 2]]]'

    raw = ocr.recognised(pages, engine)
    assert [(r["raw"] is None, r["error"]) for r in raw.orderBy("page_num").collect()] == [(False, None), (True, "no image")]
    assert ocr.items(raw).count() == 1
    notes = spark.createDataFrame([("FreeText", "ocr_text", None, None, 0), ("FreeText", None, None, "source=ocr", 1), ("Highlight", "ocr_text", None, None, 0), ("FreeText", None, None, "x", 0)], "annotation_type string, subject string, title string, content string, page_num int")
    assert ocr.without_written(notes).count() == 2 and ocr.without_written(notes, [1]).count() == 3


def test_files(spark, tmp_path):
    for name in ("a.pdf", "a_masked.pdf", "b.txt"):
        (tmp_path / name).write_bytes(name.encode())
    rows = {r["filename"]: r for r in files.files(spark, str(tmp_path)).withColumn("skip", files.skipped(F.col("filename"))).collect()}
    assert set(rows) == {"a.pdf", "a_masked.pdf"} and rows["a.pdf"]["size"] == 5 and rows["a_masked.pdf"]["skip"] and not rows["a.pdf"]["skip"]
    (tmp_path / "r.json").write_text('{"text": [["a"]], "detect": []}')
    (tmp_path / "bad.json").write_text("{")
    got = files.results(spark, str(tmp_path / "*.json")).cache()
    assert got.count() == 2 and got.filter("_corrupt_record IS NOT NULL").count() == 1


def test_arriving_files(spark, tmp_path):
    docs = spark.createDataFrame([(1, "tel 03-5214-8000")], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "in"))
    query = arrivals.start(spark, str(tmp_path / "in"), "doc_id long, text string", str(tmp_path / "out"), str(tmp_path / "state"), [{"op": "detect"}])
    query.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).filter("entity = 'PHONE_NUMBER'").count() == 1


def test_adapters(spark, tmp_path):
    """Models and extractors are the caller's; their failures are rows or lost chunks, not the job's end."""

    def broken():
        raise OSError("not here")

    def nouns(text):
        if "!" in text:
            raise ValueError(text)
        return [("PROPER_NOUN", i, i + 2) for i in range(0, len(text) - 1, 2)] + [("PERSON", 0, 1)]

    docs = spark.createDataFrame([(1, "ab。cd。  "), (2, "x!"), (3, None)], "doc_id long, text string")
    found = detect.model_spans(docs, [("large", broken), ("small", lambda: nouns)], ["PROPER_NOUN"], max_chars=3)
    assert sorted((r["doc_id"], r["start"], r["word"]) for r in found.collect()) == [(1, 0, "ab"), (1, 3, "cd")]
    with pytest.raises(RuntimeError, match="not here"):
        detect.first_that_loads([("large", broken)])
    files_ = spark.createDataFrame([("a", b"one\n\ntwo"), ("b", b"\xff")], "path string, content binary")
    rows = {r["path"]: r for r in files.extracted(files_, lambda c: [p.split("\n") for p in c.decode().split("\n\n")]).collect()}
    assert rows["a"]["text"] == [["one"], ["two"]] and rows["a"]["page_count"] == 2 and rows["b"]["text"] is None and "Unicode" in rows["b"]["error"]
    files.write_json(files_.select("path", F.lit(None).cast("string").alias("x")), str(tmp_path / "out"))
    assert '"x":null' in "".join(p.read_text() for p in (tmp_path / "out").glob("part-*"))
    old = spark.createDataFrame([(1, 0, "w", "A", 0, 1)], "doc_id long, seq long, word string, entity string, gstart long, gend long")
    new = spark.createDataFrame([(1, 0, "w", "A", 0, 1), (1, 1, "w", "A", 2, 3), (1, 2, "w", "A", 2, 3)], old.schema)
    assert [r["seq"] for r in resolve.manual_additions(old, new).collect()] == [1]
