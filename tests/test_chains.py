"""The chains: target texts with the way back, detection and masks as the service runs them, page documents, sessions, runs."""

import json
import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from spanloom.functions.values import ENTITIES
from spanloom.operators import highlights, offsets, pages
from spanloom.plans import runs, service
from spanloom.sources import store

TEXTS = "doc_id long, text array<array<string>>"


def test_target_and_the_way_back(spark):
    rng = random.Random(1)
    docs = [(1, [["AB", "CD"], ["EF"]]), (2, [["A B", " C"], ["D\tE"]]), (3, [[], ["x", ""], [], ["y　z\x1c"]]), (4, []), (5, [[]])]
    docs += [(k, [["".join(rng.choice("ab 　\n") for _ in range(rng.randrange(6))) for _ in range(rng.randrange(4))] for _ in range(rng.randrange(5))]) for k in range(10, 40)]
    frame = spark.createDataFrame(docs, TEXTS)
    for newlines in (True, False):
        for blanks in (True, False):
            for wanted in (None, [0, 2], [7]):
                got = {r["doc_id"]: r["t"] for r in frame.select("doc_id", offsets.target(F.col("text"), newlines, blanks, wanted).alias("t")).collect()}
                for k, text in docs:
                    out, base = [], 0
                    chosen = [i for i in range(len(text)) if wanted is None or i in wanted]
                    for i, page in enumerate(text):
                        for j, block in enumerate(page):
                            for c in block:
                                if i in chosen and not (blanks and c.isspace()):
                                    out.append((c, base, base + 1))
                                base += 1
                            if i in chosen and not newlines and not blanks and j < len(page) - 1:
                                out.append(("\n", base, base))
                        if i in chosen and not newlines and not blanks and i < max(chosen):
                            out.append(("\n", base, base))
                    assert got[k]["text"] == "".join(c for c, _, _ in out), (k, newlines, blanks, wanted)
                    spans = [(s["base"] + x, s["base"] + (x if s["feed"] else x + 1)) for s in got[k]["segments"] for x in range(s["n"])]
                    assert spans == [(a, b) for _, a, b in out]


def test_offsets_find_their_places(spark):
    text = [["ab" * 900, ""], [], ["c", "de" * 800]]
    docs = spark.createDataFrame([(1, text)], TEXTS).withColumn("target", offsets.target(F.col("text"), False))
    flat = [(i, j, o) for i, p in enumerate(text) for j, b in enumerate(p) for o in range(len(b))]
    rows = [(1, a, b) for a, b in ((0, 1), (0, 1800), (1799, 1800), (1799, 1806), (1800, 1803), (1803, 1806), (1900, 3404), (0, 3405))]
    found = offsets.positioned(offsets.mapped_back(spark.createDataFrame(rows, "doc_id long, start int, end int"), docs), docs).collect()
    joined = "\n".join("\n".join(p) for p in text)
    assert len(joined) == 3405
    seen, at = [], 0
    for c in joined:
        seen.append((at, at + (c != "\n")))
        at += c != "\n"
    for r in found:
        a, b = seen[r["start"]][0], seen[r["end"] - 1][1]
        assert (r["base_start"], r["base_end"]) == (a, b)
        assert tuple(r["first"]) == flat[a] and tuple(r["last"]) == flat[max(0, b - 1)]


def _spots(rows):
    return sorted((r["entity"], r["word"], r["origin"], tuple(r["first"]), tuple(r["last"])) for r in rows)


def test_detection_as_the_service_runs_it(spark):
    place = "struct<page_num:int,block_num:int,offset:int>"
    docs = spark.createDataFrame(
        [(1, [["山田", "様 令和3年"], ["03-1234", "-5678 X1"]], [((0, 0, 0), (0, 1, 0), "PERSON", "山田様", "manual"), ((1, 1, 6), (1, 1, 7), "CODE", "X1", "auto")]), (2, [], [((0, 0, 0), (0, 0, 0), "OTHER", "q", "auto")]), (3, None, None)],
        f"doc_id long, text array<array<string>>, detect array<struct<first:{place},last:{place},entity:string,word:string,origin:string>>",
    )
    found = _spots(service.run_detect(docs).collect())
    # What was there comes first: the same span found again doesn't stay beside it.
    assert ("PERSON", "山田様", "manual", (0, 0, 0), (0, 1, 0)) in found and ("PERSON", "山田様", "auto", (0, 0, 0), (0, 1, 0)) not in [f for f in found if f[2] == "auto"]
    assert ("PHONE_NUMBER", "03-1234-5678", "auto", (1, 0, 0), (1, 1, 4)) in found and ("YEAR", "令和3年", "auto", (0, 1, 2), (0, 1, 5)) in found and ("OTHER", "q", "auto", (0, 0, 0), (0, 0, 0)) in found
    only = _spots(service.run_detect(docs, {"pages": [1, "x", -1], "use_predetect": False}).collect())
    assert {f[0] for f in only} == {"PHONE_NUMBER"}
    kept = _spots(service.run_detect(docs, {"ignore_newlines": False, "exclude": ["山田", "1", "(", "年"], "add": [("CODE", r"X\d"), ("YEAR", "令和"), ("CODE", "[")]}).collect())
    # Line breaks part the number; manual rows stay whatever an exclusion finds, others go by word or by span.
    assert [f[1] for f in kept] == ["q", "山田様", "令和"] or {f[1] for f in kept} == {"q", "山田様", "令和"}
    assert not service.run_detect(docs, {"entities": ["CODE"], "recognisers": {}, "use_predetect": False}).collect()


def test_entities_of_added_patterns():
    assert [service.added_entity(e, on) for e, on in (("PERSON", ["PERSON"]), ("PEARSON", ["LOCATION"]), ("pearson", ["PERSON"]), ("MUHO", []), (" ", []), ("address", ["LOCATION"]))] == ["PERSON", None, "PERSON", "MUHO", None, "LOCATION"]
    o = service.options_of({"add_entity": {"PERSON": ["a"], "X": "b"}, "ommit_entity": ["c"], "text_preprocess_settings": {"ignore_newlines": "no"}})
    assert o["add"] == [("PERSON", "a"), ("X", "b")] and o["exclude"] == ["c"] and o["ignore_newlines"] is False and o["entities"] == list(ENTITIES)


def test_lines_come_from_the_first_source_that_knows(spark):
    place = "struct<page_num:int,block_num:int,offset:int>"
    found = spark.createDataFrame([(1, k, 0, (0, 0, k), (0, 0, k + 1), [[1.0, 1.0, 2.0, 2.0]] if k == 0 else [[3.0, 3.0, 3.0, 3.0]]) for k in range(3)], f"doc_id long, det int, page_num int, first {place}, last {place}, rects_pdf array<array<double>>")
    char = "doc_id long, page_num int, block_num int, offset int, line_num int, x0 double, y0 double, x1 double, y1 double"
    chars = spark.createDataFrame([(1, 0, 0, k, 0, k * 5.0, 0.0, k * 5.0 + 5, 9.0) for k in range(2)] + [(1, 0, 0, 2, 1, None, None, None, None)], char)
    mapped = spark.createDataFrame([(1, 0, 0, k, 0, 70.0, 0.0, 75.0, 9.0) for k in (2, 3)], char)
    assert sorted(map(tuple, service.text_lines(found, chars, mapped).collect())) == [(1, 0, 0, 1.0, 1.0, 2.0, 2.0), (1, 1, 0, 5.0, 0.0, 10.0, 9.0), (1, 2, 0, 70.0, 0.0, 75.0, 9.0)]
    with pytest.raises(ValueError):
        service.text_lines(found.drop("rects_pdf"))


def test_page_documents(spark, tmp_path):
    char = lambda c, x, box=True: {"c": c, "x": x, "y": 1.0, "bbox": [x, 0.0, x + 1, 9.0] if box else None}
    value = [
        {"blocks": [{"bbox": [0.0, 0.0, 1.0, 1.0], "lines": None}, {"bbox": None, "lines": [{"spans": [{"chars": [char("a", 1.0), char("h", 2.00004)]}, {"chars": []}]}, {"spans": [{"chars": [char("b", 3.0)]}]}]}, {"bbox": None, "lines": [{"spans": [{"chars": [char("x", 5.0, False)]}]}]}, {"bbox": [0.0, 0.0, 4.0, 4.0], "lines": []}], "trace": [{"opacity": 0.0, "x": 2.0, "y": 1.0, "c": "h"}, {"opacity": 1.0, "x": 1.0, "y": 1.0, "c": "a"}]},
        {"blocks": [], "trace": None},
        {"blocks": [{"bbox": None, "lines": [{"spans": [{"chars": [char(" ", 1.0)]}]}]}, {"bbox": None, "lines": [{"spans": [{"chars": [char("z", 1.0)]}]}]}], "trace": []},
    ]

    def extract(content):
        if content == b"bad":
            raise OSError("broken")
        return json.loads(content)

    files = spark.createDataFrame([("/a.pdf", "a.pdf", 5, None, "d", bytearray(json.dumps(value).encode())), ("/b.pdf", "b.pdf", 3, None, "e", bytearray(b"bad"))], "path string, filename string, size long, modified_at timestamp, sha256 string, content binary")
    read = pages.extracted(files, extract)
    p = F.col("pages")
    out = {r["path"]: r for r in read.select("path", "page_count", "error", pages.block_texts(p).alias("t"), pages.locator_texts(p).alias("l"), pages.structured(p).alias("s"), pages.block_infos(p).alias("i")).collect()}
    good = out["/a.pdf"]
    assert good["t"] == [["ab"], ["z"]] and good["page_count"] == 3 and good["error"] is None and out["/b.pdf"]["error"] == "OSError: broken"
    assert tuple(good["l"]) == ("a\nbx\n\n z", "abx z") and [b["page_block_id"] for b in good["i"][2]] == [0] and good["i"][0][0]["bbox"] == [1.0, 0.0, 4.0, 9.0]
    assert [[len(b["lines"]) for b in q["blocks"]] for q in good["s"]] == [[2, 1], [], [1, 1]] and good["s"][0]["blocks"][0]["lines"][0]["spans"][0]["text"] == "a"
    docs = read.select(F.col("path").alias("doc_id"), "pages").filter("pages IS NOT NULL")
    tables = [t.repartition(3) for t in pages.flattened(docs)]
    back = pages.rebuilt(*tables).join(docs.withColumnRenamed("pages", "was"), "doc_id")
    assert back.select(F.to_json("pages") == F.to_json("was")).first()[0]
    result = {r["path"]: json.loads(r["j"]) for r in pages.read_results(files, read).select("path", F.to_json("result", {"ignoreNullFields": "true"}).alias("j")).collect()}
    assert result["/b.pdf"] == {"metadata": {"error": "OSError: broken"}, "text": [], "detect": []}
    assert result["/a.pdf"]["text"] == [["ab"], ["z"]] and result["/a.pdf"]["metadata"]["pdf"]["sha256"] == "d" and "error" not in result["/a.pdf"]["metadata"]


def test_tables_are_replaced_key_by_key(spark, tmp_path, monkeypatch):
    table = store.Table(spark, str(tmp_path / "t"), ("doc_id", "page_num"))
    rows = lambda *r: spark.createDataFrame(list(r), "doc_id long, page_num int, word string")
    have = lambda t=table, v=None: sorted(map(tuple, t.read(v).collect()))
    assert table.read() is None
    first = table.replace(rows((1, 0, "a"), (1, 1, "b"), (2, 0, "c"), (2, 0, "d")))
    scope = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, page_num int")
    table.replace(rows((2, 0, "e"), (1, 0, "outside")), scope)
    assert have() == [(1, 0, "a"), (2, 0, "e")] and have(v=first) == [(1, 0, "a"), (1, 1, "b"), (2, 0, "c"), (2, 0, "d")]
    written = sorted(x.name for x in (tmp_path / "t" / "rows").iterdir())
    assert len(written) == 2 and spark.read.parquet(str(tmp_path / "t" / "rows" / f"part={table.parts()[-1]}")).count() == 1

    # A writer that is lost before its manifest changes nothing; neither does one lost while writing it.
    with monkeypatch.context() as m:
        m.setattr(store.Table, "_commit", lambda self, change: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            table.replace(rows((1, 0, "lost")))
    assert have() == [(1, 0, "a"), (2, 0, "e")]
    (tmp_path / "t" / "manifest" / "3.json").write_text('{"par')
    assert have() == [(1, 0, "a"), (2, 0, "e")]

    # Two writers that read the same manifest both get in.
    other = store.Table(spark, str(tmp_path / "t"), ("doc_id", "page_num"))
    real, met = store.Table.parts, []

    def late(self, version=None):
        out = real(self, version)
        if self is table and not met:
            met.append(1)
            other.replace(rows((3, 0, "other")))
        return out

    with monkeypatch.context() as m:
        m.setattr(store.Table, "parts", late)
        m.setattr(store, "PARTS", 10**6)
        table.replace(rows((1, 0, "mine")))
    assert have() == [(1, 0, "mine"), (2, 0, "e"), (3, 0, "other")]
    table.compact()
    assert have() == [(1, 0, "mine"), (2, 0, "e"), (3, 0, "other")] and len(table.parts()) == 1


def test_sessions(spark):
    old = json.dumps({"text": [["t"]], "detect": [{"word": "w"}], "metadata": {"pdf": {"path": "/was"}}})
    rows = [("/a", "h", json.dumps({"read_result": {"text": []}, "detect_result": None})), ("/b", "h", old), ("/c", "x", '{"text": []}'), ("/d", "h", "{no"), ("/e", "h", "[1]")]
    side = store.session_rows(spark.createDataFrame(rows, "path string, content_hash string, payload string"))
    known = {r["path"]: [r[n] is not None for n in store.RESULTS] for r in side.collect()}
    assert known == {"/a": [True, False, False, False], "/b": [True, True, False, False], "/c": [True, False, False, False], "/d": [False] * 4, "/e": [False] * 4}
    files = spark.createDataFrame([(p, "h") for p in ("/a", "/b", "/c", "/d", "/f")], "path string, content_hash string")
    inside = store.session_rows(spark.createDataFrame([("/d", None, old), ("/a", None, old)], "path string, content_hash string, payload string"))
    got = {r["path"]: (r["source"], r["changed"], r["read_result"] is not None) for r in store.restored(files, side, inside).collect()}
    assert got == {"/a": ("sidecar", False, True), "/b": ("sidecar", False, True), "/c": ("sidecar", True, True), "/d": ("embedded", False, True), "/f": (None, False, False)}
    assert {r["path"] for r in store.restored(files, side, inside, accept_changed=False).filter("read_result IS NOT NULL").collect()} == {"/a", "/b", "/d"}
    again = json.loads(store.restored(files, side, inside).filter("path = '/b'").withColumn("content_hash", F.lit('q"')).select(store.payload().alias("j")).first()[0])
    assert again["content_hash"] == 'q"' and again["read_result"] == json.loads(old) and again["ocr_result"] is None and again["pdf_path"] == "/b"
    typed = side.filter("path = '/b'").select(store.result_of(F.col("read_result"), "metadata struct<pdf:struct<path:string>>, text array<array<string>>", F.col("path")).alias("r")).first()["r"]
    assert typed["metadata"]["pdf"]["path"] == "/b" and typed["text"] == [["t"]]


def test_a_run_goes_on_where_the_last_one_ended(spark, tmp_path):
    table = runs.ledger(spark, str(tmp_path / "ledger"))
    files = lambda *r: spark.createDataFrame([(p, p[1:], d) for p, d in r], "path string, filename string, sha256 string")
    given = []

    def work(rows):
        listed = rows.collect()
        given.append(sorted(r["path"] for r in listed))
        if any(r["sha256"] == "stop" for r in listed):
            raise RuntimeError("the cluster went away")
        out = [(r["path"], 2, {"X": 2}, None if r["sha256"] != "bad" else "unreadable") for r in listed if r["sha256"] != "none"]
        return spark.createDataFrame(out, "path string, total_entities_found long, entities_by_type map<string,long>, error string")

    runs.run(files(("/a", "1"), ("/b", "bad"), ("/c_masked.pdf", "1"), ("/d", "none")), table, work)
    status = lambda: {r["path"]: (r["status"], r["reason"], r["attempt"]) for r in table.read().collect()}
    assert status() == {"/a": ("Success", None, 1), "/b": ("Error", "unreadable", 1), "/c_masked.pdf": ("Skipped", runs.SKIPPED, 1), "/d": ("Error", "no result", 1)}
    with pytest.raises(RuntimeError):
        runs.run(files(("/a", "1"), ("/e", "stop")), table, work)
    assert "/e" not in status()
    runs.run(files(("/a", "1"), ("/b", "2"), ("/c_masked.pdf", "1"), ("/d", "none"), ("/e", "1")), table, work)
    assert given[-1] == ["/b", "/d", "/e"] and status()["/b"] == ("Success", None, 2) and status()["/d"][2] == 2 and status()["/a"][2] == 1
    runs.run(files(("/a", "new")), table, work)
    assert given[-1] == ["/a"]
    report = {r["File"]: (r["Status"], r["Entities Found"], r["Entity Types"]) for r in runs.report(table).collect()}
    assert report["/a"] == ("Success", 2, "X:2") and report["/c_masked.pdf"] == ("Skipped", 0, "") and report["/d"] == ("Error", 0, "")


def test_dispatch_copies_what_it_cannot_mask(spark):
    row = "doc_id long, page_num int, entity string, word string, annotation_type string, title string, content string, x0 double, y0 double, x1 double, y1 double"
    marks = [(d, 0, "E", "w", kind, "t", "c", 0.0, 0.0, 9.0, 9.0) for d in (1, 2, 3, 4, 5) for kind in ("Highlight", "Square")]
    asked = spark.createDataFrame([(1, "both", "append"), (2, "highlight", "clear_all"), (3, "annotation", "reset_and_append"), (4, "paint", "append"), (5, "both", "never"), (6, "both", "append")], "doc_id long, method string, mode string")
    moved = [(*m[:7], 20.0, 20.0, 29.0, 29.0) for m in marks]
    out = {r["doc_id"]: (r["action"], sorted((a["annotation_type"], a["new"]) for a in r["annotations"] or [])) for r in service.dispatch(spark.createDataFrame(moved, row), spark.createDataFrame(marks, row), asked).collect()}
    old, new = [("Highlight", False), ("Square", False)], [("Highlight", True), ("Square", True)]
    assert out == {1: ("masked", sorted(old + new)), 2: ("masked", [new[0], old[1]]), 3: ("masked", [old[0], new[1]]), 4: ("copied", old), 5: ("copied", old), 6: ("masked", [])}
    assert highlights.MODES == ("clear_all", "append", "reset_and_append")


def test_recognition_is_the_same_when_repeated(spark):
    from spanloom.plans import recognition

    def engine(image, page, covered):
        if not image:
            raise RuntimeError("no image")
        return json.dumps([[w, [0, 50 * k, 90, 50 * k + 40]] for k, w in enumerate(bytes(image).decode().split()) if not any(y0 <= 50 * k < y1 for _, y0, _, y1 in covered)])

    pages_ = spark.createDataFrame([(1, 0, b"own one two"), (1, 1, b"X9 three"), (1, 2, b""), (2, 0, b"")], "doc_id long, page_num int, image binary").withColumn("width", F.lit(500.0)).withColumn("height", F.lit(500.0))
    own = spark.createDataFrame([(1, 0, 0, "own", 0.0, 0.0, 20.0, 9.0)], "doc_id long, page_num int, block_num int, text string, x0 double, y0 double, x1 double, y1 double")
    docs = pages_.select("doc_id").distinct()
    texts = lambda w: {r["doc_id"]: r["text"] for r in recognition.read_again(docs, own, w).collect()}
    once, failed = recognition.run_ocr(pages_, own, engine)
    assert sorted(map(tuple, failed.collect())) == [(1, 2, "no image"), (2, 0, "no image")]
    assert texts(once) == {1: [["own", "one", "two"], ["X9", "three"]], 2: []}
    twice, _ = recognition.run_ocr(pages_, own, engine, once)
    assert sorted(map(repr, twice.collect())) == sorted(map(repr, once.collect()))
    part, _ = recognition.run_ocr(pages_.withColumn("image", F.lit(b"new")), own, engine, once, wanted=[1, "x", 9])
    assert texts(part) == {1: [["own", "one", "two"], ["new"]], 2: []}
    left, removed = recognition.cleared(part, [1])
    assert texts(left) == {1: [["own", "one", "two"]], 2: []} and [tuple(r) for r in removed.collect()] == [(1, 1)]
    assert recognition.cleared(part)[0].count() == 0
    _, _, found = recognition.ocr_then_detect(docs, pages_, own, engine, options={"recognisers": {}, "pages": [1], "add": [("CODE", r"X\d"), ("CODE", "own")]})
    assert [(r["doc_id"], r["word"], tuple(r["first"])) for r in found.collect()] == [(1, "X9", (1, 0, 0))] or [(r["word"], tuple(r["first"])) for r in found.collect()] == [("X9", (0, 0, 0))]
    with pytest.raises(ValueError):
        recognition.run_ocr(pages_, own, engine, dpi=0)


def test_colours_of_boxes_are_those_of_the_arrays(spark):
    import numpy as np

    from spanloom.operators import ocr

    rng = np.random.default_rng(3)
    rows, boxes, want = [], [], {}
    for d in range(12):
        picture = np.full((9, 11, 3), rng.integers(0, 256), np.uint8)
        picture[2:6, 3:9] = rng.integers(0, 256, 3)
        if d % 3 == 0:
            picture = rng.integers(0, 256, (9, 11, 3)).astype(np.uint8)
        rows.append((d, 0, 11, 9, bytearray(picture.tobytes())))
        for b, (x, y, w, h) in enumerate([(0, 0, 11, 9), (-3.5, 1.2, 9.9, 5.1), (4, 2, 1, 7), (2, 5, 6, 1), (20, 20, 2, 2), (3, 3, 0, 4)]):
            boxes.append((d, 0, b, float(x), float(y), float(w), float(h)))
            x0, y0, x1, y1 = max(0, int(x)), max(0, int(y)), min(11, int(x + w)), min(9, int(y + h))
            want[d, b] = ocr.text_colour(picture[y0:y1, x0:x1]) if x1 > x0 and y1 > y0 else (0, 0, 0)
    images = spark.createDataFrame(rows, "doc_id long, page_num int, width int, height int, pixels binary")
    got = ocr.text_colours(images, spark.createDataFrame(boxes, "doc_id long, page_num int, box int, x double, y double, width double, height double"))
    assert {(r["doc_id"], r["box"]): (r["r"], r["g"], r["b"]) for r in got.collect()} == want


def test_colours_of_marks(spark):
    row = spark.range(1).select(highlights.mark_colours(F.array(F.lit(1.0), F.lit(0.5), F.lit(0.0)), F.array().cast("array<double>")).alias("c"), highlights.mark_colours(F.lit(None).cast("array<double>"), F.array(F.lit(1.0))).alias("d")).first()
    assert row["c"]["stroke_color"]["hex"] == "#ff7f00" and row["c"]["fill_color"] is None and row["d"]["fill_color"]["hex"] == "#000000"


def test_reports_open_in_spreadsheets(spark, tmp_path):
    from spanloom.sources import files

    found = spark.createDataFrame([(1, "PERSON", "山田", "manual", 0, 0, 2)], "doc_id long, entity string, word string, origin string, page_num int, block_num int, offset int")
    files.write_csv(found, str(tmp_path / "out"), one_file=True)
    parts = list((tmp_path / "out").glob("part-*.csv"))
    assert len(parts) == 1 and parts[0].read_bytes().decode("utf-8-sig").splitlines() == ["ページ,種別,テキスト,位置,手動", "1,人名,山田,p1:b1:3,✓"] and parts[0].read_bytes().startswith(b"\xef\xbb\xbf")


def test_maps_are_embedded_by_a_step(spark, tmp_path):
    from spanloom.plans import steps

    wire = spark.createDataFrame([(k, {"0": {"0": [[1.0, 2.0, 3.0, 4.0]]}}) for k in (1, 2)], "doc_id long, offset2coordsMap map<string,map<string,array<array<double>>>>")
    state = {"maps": wire, "hashes": spark.createDataFrame([(1, "a", "a"), (2, "a", "b")], "doc_id long, expected string, sha256 string")}
    path = str(tmp_path / "maps")
    assert [r["doc_id"] for r in steps.embed_step(state, {"path": path})["maps"].collect()] == [1]
    assert sorted(r["doc_id"] for r in steps.embed_step(state, {"path": path, "force": True})["maps"].collect()) == [1, 2]
    empty = spark.createDataFrame([(3, {})], wire.schema)
    with pytest.raises(Exception, match="no coordinate map"):
        steps.embed_step({"maps": empty}, {"path": path})


@pytest.mark.parametrize("name", ["page_rows", "page_scan"])
def test_long_sentences_keep_their_places(spark, tmp_path, name):
    texts = ["a" * 1100 + ". b. c. " + "a" * 90, ("ab 山😀" * 300 + ". ") * 5 + "ab 山😀" * 20, "z" * 1007 + ". y. \t. " + "z" * 30, "\n. 　.  . x", "", None]
    rows = spark.createDataFrame([(k // 2, k % 2, "user", t) for k, t in enumerate(texts)], "conv_id long, turn long, role string, text string")
    rows.write.parquet(f"{tmp_path}/conversations.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    assert sorted(map(tuple, entry.queries()[name](spark, str(tmp_path)).collect())) == sorted(db.execute(entry.oracle_sql()[name]).fetchall())
