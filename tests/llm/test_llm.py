"""The training-data operators against brute force, exact round trips and held-out accuracy, with their odd inputs."""

import base64
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.llm import byte_bpe, components, embedding_dedup, exact_dedup, html_text, minhash_dedup, mixing, secret_scan, suffix_dedup, toxicity, url_filter

DOCS = "doc_id long, text string, lang string, source string, text_sha256 string, component_id long, tokens int, key string"
SF = "/root/testdata/sf0.001"


def frame(spark, rows):
    """Documents with extra columns whose names clash with working ones."""
    return spark.createDataFrame([(i, t, None, s, "x", 7, 1, "k") for i, t, s in rows], DOCS)


ODD = [(1, None, None), (2, "", "a"), (3, " \t\n", "a"), (4, "same text here", "a"), (5, "same\n text  here", "b"), (5, "same\n text  here", "b"), (None, "lost id", "b"), (6, "word " * 30_000, "b"), (7, "é" * 500, None)]


def test_exact_dedup(spark):
    rows = {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_dedup(frame(spark, ODD)).collect()}
    assert rows == {(1, 1, 2, True), (2, 1, 2, False), (3, 3, 1, True), (4, 4, 3, True), (5, 4, 3, False), (None, None, 1, True), (6, 6, 1, True), (7, 7, 1, True)}
    many = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("text"))
    got = exact_dedup.exact_dedup(many, tracked=16)
    assert got.filter("kept").count() == 2001 and got.filter("group_size = 1000 AND keep_id = 0").count() == 1000
    assert exact_dedup.exact_dedup(many.limit(0)).count() == 0
    kept = exact_dedup.keep_first_copies(frame(spark, ODD))
    assert kept.columns == frame(spark, ODD).columns and sorted(r[0] or 0 for r in kept.select("doc_id").collect()) == [0, 1, 3, 4, 6, 7]


def test_components(spark):
    rng = random.Random(4)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(0, i) for i in range(500, 900)] + [(i, i + 1) for i in range(1000, 1060)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r["id"]: r["component_id"] for r in components.components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == {x: find(x) for x in root if find(x) != x}


def brute_near(rows, words, percent):
    sets = {i: minhash_dedup.shingle_set(t, words) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            n = len(np.intersect1d(sets[i], sets[j], True))
            if n and 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_minhash(spark, monkeypatch):
    rng = random.Random(1)
    rows = [(i, t) for i, t, _ in ODD if i not in (None, 5)]
    for g in range(4):
        base = [f"w{rng.randrange(10**6)}" for _ in range(60)]
        for c in range(30 if g else 70):
            text = list(base)
            for _ in range(rng.randrange(7)):
                text[rng.randrange(60)] = f"e{rng.randrange(10**6)}"
            rows.append((100 * g + c + 10, " ".join(text)))
    want = brute_near(rows, 3, 85)
    monkeypatch.setattr(minhash_dedup, "BLOCK", 600)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash_dedup.near_duplicates(frame(spark, [(i, t, "s") for i, t in rows]), words=3, percent=85).collect()}
    assert got == want
    assert minhash_dedup.near_duplicates(frame(spark, ODD).limit(0)).count() == 0
    assert minhash_dedup.near_duplicates(frame(spark, ODD)).filter("kept").count() == len(ODD) - 3 + 1


def test_minhash_large_buckets_meet_their_components_by_key_once(spark, monkeypatch):
    """What is left of large buckets is told by components alone: settled buckets go, and no second join by key lists all members."""
    rows = spark.createDataFrame([(1, 10, 10), (1, 11, 10), (2, 10, 10), (2, 12, 10), (2, 13, 10)], "key long, doc_id long, head long")
    roots = spark.createDataFrame([(11, 10), (13, 12)], "id long, component_id long")
    assert sorted(map(tuple, minhash_dedup._unsettled(rows, roots).collect())) == [(10, 10, 10), (12, 12, 10), (13, 12, 10)]
    rng = random.Random(5)
    base = [f"w{k}" for k in range(60)]
    docs = [(i, " ".join(f"e{rng.randrange(10**6)}" if k in out else w for k, w in enumerate(base)), "s") for i in range(60) for out in [rng.sample(range(60), 2)]]
    labelled, calls = minhash_dedup._labelled, []
    monkeypatch.setattr(minhash_dedup, "_labelled", lambda *a: calls.append(1) or labelled(*a))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash_dedup.near_duplicates(frame(spark, docs), words=3, percent=85).collect()}
    assert got == brute_near([(i, t) for i, t, _ in docs], 3, 85) and len(calls) == 1


def test_minhash_words():
    a, b = minhash_dedup.shingle_set("A b\u00a0c D", 3), minhash_dedup.shingle_set("a\tB\u00a0c\nd", 3)
    assert (a == b).all() and len(a) == 1
    assert len(minhash_dedup.shingle_set("one two", 3)) == 1 and len(minhash_dedup.shingle_set(" \n", 3)) == 0


def test_suffix_dedup(spark):
    rng = random.Random(2)
    words = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    passage, other = words(500), words(380)
    rows = [(1, words(300) + passage + words(200)), (2, passage), (3, words(50) + passage[60:] + other), (4, other + words(30)), (5, "xy" * 700), (6, None), (7, ""), (8, words(900)), (9, passage[:399])]
    for i in range(10, 60):
        cut = rng.randrange(400)
        rows.append((i, words(20) + passage[:cut] + "#" + passage[cut:] + passage[: rng.randrange(500)]))
    count = {}
    for _, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - 399):
            count[b[p : p + 400]] = count.get(b[p : p + 400], 0) + 1
    want = {}
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 399):
            if count[b[p : p + 400]] > 1:
                gone[p : p + 400] = b"\1" * 400
        want[i] = bytes(x for x, g in zip(b, gone) if not g)
    for size in (1 << 23,):
        got = {r["doc_id"]: bytes(r["kept"]) for r in suffix_dedup.dedup(frame(spark, [(i, t, "s") for i, t in rows]), range_bytes=size).collect()}
        assert got == want
    assert suffix_dedup.dedup(frame(spark, ODD).limit(0)).count() == 0
    assert suffix_dedup.dedup(frame(spark, ODD)).count() == len(ODD)


def brute_repeats(rows, length):
    count = {}
    for _, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - length + 1):
            count[b[p : p + length]] = count.get(b[p : p + length], 0) + 1
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if count[b[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        out.append((i, len(b), sum(gone), bytes(x for x, g in zip(b, gone) if not g)))
    return out


def test_suffix_dedup_of_edited_copies(spark):
    """Many versions of one text with edits close to each other, zero bytes and repeated rows: windows that neighbours don't decide."""
    rng = random.Random(8)
    base = ["".join(rng.choice("ab\0") for _ in range(150)) for _ in range(3)]
    rows = []
    for i in range(150):
        text = list(rng.choice(base))
        for _ in range(rng.randrange(5)):
            text[rng.randrange(150)] = rng.choice("abc")
        rows.append((i, "".join(text)[rng.randrange(60) :]))
    rows += [(7, rows[7][1]), (None, rows[3][1]), (None, rows[3][1]), (200, "a" * 300)]
    want = sorted(map(repr, brute_repeats(rows, 60)))
    for size in (1 << 23, 2000):
        got = suffix_dedup.dedup(frame(spark, [(i, t, "s") for i, t in rows]), length=60, range_bytes=size).collect()
        assert sorted(repr((r["doc_id"], r["n_bytes"], sum(x["e"] - x["s"] for x in r["spans"]), bytes(r["kept"]))) for r in got) == want


def test_suffix_windows_that_share_nothing_are_not_listed(spark, monkeypatch):
    """One passage in many texts that differ close to it: only windows within what a context shares with another are sorted."""
    rng = random.Random(9)
    words = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage, tail = words(46), words(40)
    rows = [(i, words(60) + passage + words(60)) for i in range(150)]
    rows += [(200 + i, words(30) + x + passage + y + words(30)) for i, (x, y) in enumerate([(tail, words(40)), (words(40), tail), (tail[20:], tail[:10]), (tail[20:], tail[:20]), (tail[30:], tail)])]
    made, listed = [], suffix_dedup._windows
    monkeypatch.setattr(suffix_dedup, "_windows", lambda *a: made.append(listed(*a)) or made[0])
    got = suffix_dedup.dedup(frame(spark, [(i, t, "s") for i, t in rows]), length=60).collect()
    want = sorted(map(repr, brute_repeats(rows, 60)))
    assert sorted(repr((r["doc_id"], r["n_bytes"], sum(x["e"] - x["s"] for x in r["spans"]), bytes(r["kept"]))) for r in got) == want
    assert 0 < made[0].count() < 300


def test_loser_tree():
    rng = random.Random(3)
    for _ in range(200):
        runs = [sorted(bytes(rng.choices(b"ab", k=rng.randint(0, 12))) for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(1, 6))]
        sides = [list(suffix_dedup.decoded(*suffix_dedup.front_coded(r))) for r in runs]
        out = [(sides[i][k][0], n) for i, k, n in suffix_dedup.merged(sides)]
        assert [x for x, _ in out] == sorted(x for r in runs for x in r)
        assert all(n == suffix_dedup.common(x, y, 0) for (x, _), (y, n) in zip(out, out[1:]))


def test_embeddings(spark):
    rng = np.random.default_rng(0)
    base = rng.standard_normal((20, 32))
    rows = [(i, [float(x) for x in base[i % 20] + (i % 7) * 0.05 * rng.standard_normal(32)]) for i in range(300)]
    rows += [(300, None), (301, [0.0] * 32), (302, [float("nan")] + [1.0] * 31), (303, [None] + [1.0] * 31), (304, [1e308] * 32), (305, [1.0] * 32), (306, []), (307, [1.0, 2.0])]
    x = {i: np.array(v) / max(map(abs, v)) for i, v in rows if v and None not in v and np.isfinite(v).all() and any(v)}
    x = {i: v / np.linalg.norm(v) for i, v in x.items()}
    links = {(i, j) for i in x for j in x if i != j and len(x[i]) == len(x[j]) and x[i] @ x[j] >= 0.95}
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), block=16).collect()}
    assert {i: r["n_links"] for i, r in got.items()} == {i: sum(a == i for a, _ in links) for i, _ in rows}
    assert all(got[i]["component_id"] == got[j]["component_id"] for i, j in links)
    assert got[304]["component_id"] == got[305]["component_id"] == 304 and got[301]["kept"]


def test_embeddings_in_dense_surroundings(spark):
    """Planted pairs at 0.955 among 8,000 vectors at mutual cosine 0.9, and 200 copies beside one close vector."""
    rng = np.random.default_rng(1)
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    x = unit(rng.standard_normal(64) / 8 * 3 + unit(rng.standard_normal((8000, 64))))
    for i in range(0, 200, 2):
        away = rng.standard_normal(64)
        away = unit(away - (away @ x[i]) * x[i])
        x[i + 1] = 0.955 * x[i] + np.sqrt(1 - 0.955**2) * away
    x = np.vstack([x, np.repeat(unit(rng.standard_normal((1, 64))), 200, axis=0)])
    x = np.vstack([x, unit(x[-1:] + 0.2 * unit(rng.standard_normal((1, 64))))])
    close = x @ x.T >= 0.95
    np.fill_diagonal(close, False)
    assert close[range(0, 200, 2), range(1, 200, 2)].all()
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(rows).collect()}
    assert [got[i]["n_links"] for i in range(len(x))] == close.sum(axis=1).tolist()
    assert all(got[i]["component_id"] == got[j]["component_id"] for i, j in zip(*np.nonzero(close)))


def test_embedding_passes(spark):
    """Narrow windows over many ranges, with crowded prefixes, join what all pairs join; the passes keep the promised recall."""
    rng = np.random.default_rng(2)
    base = rng.standard_normal((400, 16))
    x = np.vstack([base, base[:200] + 0.06 * rng.standard_normal((200, 16)), base[:1] + 0.1 * rng.standard_normal((80, 16))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    close = x @ x.T >= 0.95
    np.fill_diagonal(close, False)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(rows, window=4).collect()}
    assert [got[i]["n_links"] for i in range(len(x))] == close.sum(axis=1).tolist()
    assert all(got[i]["component_id"] == got[j]["component_id"] for i, j in zip(*np.nonzero(close)))
    for n in (10, 10_000, 10**9):
        bits, passes = embedding_dedup.plan(n, 0.95)
        assert (1 - (1 - np.arccos(0.95) / np.pi) ** bits) ** passes <= 1e-5
    half = x.astype("<f2").astype(np.float32)
    assert np.abs(half @ half.T - x @ x.T).max() <= embedding_dedup.slack(16)
    odd = [(None, [1.0, 2.0]), (5, [1.0, 2.0]), (5, [1.0, 2.0]), (6, [2.0, 4.0])]
    got = embedding_dedup.near_duplicates(spark.createDataFrame([(i, v, 1, "x") for i, v in odd], "vec_id long, embedding array<double>, component_id int, u string")).collect()
    assert sorted((r["vec_id"] or 0, r["component_id"] or 0, r["kept"]) for r in got) == [(0, 0, True), (5, 5, True), (5, 5, True), (6, 5, False)]
    assert embedding_dedup.near_duplicates(rows.limit(0)).count() == 0


def test_bpe(spark):
    import public_tokenizers as P
    import regex
    import tiktoken

    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(5)
    parts = ["a", "Word", " ", "  ", "\n", "\x85", "1", "é", "漢", "😀", "'s", "!", "\x1c", "\x00", "<|endoftext|>", "\u3000"]
    texts = [None, ""] + ["".join(rng.choices(parts, k=rng.randint(0, 30))) for _ in range(200)]
    docs = frame(spark, [(i, t, "s") for i, t in enumerate(texts)])
    for r in byte_bpe.digests(docs).collect():
        ids = lib.encode_ordinary(texts[r["doc_id"]] or "")
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((texts[r["doc_id"]] or "").encode()).hexdigest()
    back = {r["doc_id"]: r["text"] for r in byte_bpe.decode(byte_bpe.encode(docs)).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}
    cut = regex.compile(P.PATTERN)
    for r in byte_bpe.encode(docs).collect():
        text = texts[r["doc_id"]] or ""
        at, spans = [k for k, c in enumerate(text) for _ in c.encode()], []
        for m in cut.finditer(text):
            first = len(text[: m.start()].encode())
            for i in lib.encode_ordinary(m[0]):
                n = len(lib.decode_single_token_bytes(i))
                spans.append((at[first], at[first + n - 1] + 1))
                first += n
        assert r["ids"] == lib.encode_ordinary(text) and list(zip(r["starts"], r["ends"])) == spans
    own = byte_bpe.Codec(byte_bpe.default_description())
    ids = own.encode(["😀"])[0]
    assert len(ids) > 1 and own.decode(ids[:1]) == "\ufffd" and own.decode(ids) == "😀"


def test_secrets(spark):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    texts = ["token=token: abcdefgh", "Api_Key = 'abc123def' é😀 PASSWORD:short", "AKIA" + "A" * 16 + " AKIA1", "0" * 24 + " " + "f" * 23, "secret=" + "ab" * 20, "", None, "x" * 50_000]
    for r in secret_scan.scan(frame(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect():
        t = texts[r["doc_id"]] or ""
        assert [(x["start"], x["end"]) for x in r["assign"]] == [m.span() for m in assign.finditer(t) if len(m[2]) >= 6]
        assert [(x["start"], x["end"]) for x in r["access"]] == [m.span() for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        assert [(x["start"], x["end"]) for x in r["hex"]] == [m.span() for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    extra = [(1, "key q7Zk2Lw9XbT4vRn8YpM3sD6h", "s"), (2, "call getUserAccountConfiguration now", "s"), (3, "international_business_machines", "s")]
    assert {r["doc_id"] for r in secret_scan.scan(frame(spark, extra)).filter("size(markov) > 0").collect()} == {1}


def test_secrets_behind_ordinary_names(spark):
    value, other = "q7Zk2Lw9XbT4vRn8YpM3sD6h", "Hd93kfQ0xPz7LmB2vTs8WcY5"
    path = "/usr/local/share/documents/account/"
    texts = ["é😀 " + path + value + " x", "long_variable_name_of_the_application=" + value, path + value + path + other + "==", path + "0123456789abcdef01234567" + value, path + "international_business_machines", "0123456789abcdef01234567", "y" * 3000 + "=" + value]
    got = {r["doc_id"]: [texts[r["doc_id"]][x["start"] : x["end"]] for x in r["markov"]] for r in secret_scan.scan(frame(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect()}
    assert got == {0: [value], 1: [value], 2: [value, other + "=="], 3: ["0123456789abcdef01234567" + value], 4: [], 5: [], 6: [value]}


def test_urls(spark):
    rows = [(1, "http://M.Example.COM/en/1"), (2, "https://www.example.com/en/2?x"), (3, "https://a.example.net/es/1"), (4, "https://ab.example.com"), (5, None), (6, "no scheme"), (7, "http://blog.cheap-pills.example.org/en/3"), (8, "http://garden.example.org/de/4#t"), (9, "x://notexample.com/en/")]
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert got[1] == ("m.example.com", "/en/1", "example.com/en/", "block") and got[2] == ("www.example.com", "/en/2", "www.example.com/en/", "allow")
    assert got[3][2:] == ("net/es/", "block") and got[4][:3] == ("ab.example.com", "", None) and got[5][:3] == got[6][:3] == ("", "", None)
    assert got[7][2:] == (None, "block") and got[8] == ("garden.example.org", "/de/4", None, "allow") and got[9][2] == "com/"


def test_html():
    page = "<title>t</title><style>.no{display:none}</style><p>One <b>two</b>\n three<br>next<p>Four<ul><li>a<li>b</ul><table><tr><th>Name<th>N<tr><td>Pie<td>10</table><div class=no>x</div><script>1</script>&amp; end"
    assert html_text.text_of(page) == "One two three\nnext\n\nFour\n\n- a\n- b\n\nName | N\nPie  | 10\n\n& end"
    for odd in ("", "<", "<p", "</p></div>", "<div>" * 5000 + "x", "<table><td>a", "<!-- open", "<script>never closed"):
        html_text.text_of(odd)
    assert html_text.text_of("<div>" * 5000 + "x") == "x"


def test_html_style_conditions():
    """Only sheets that hold on a screen hide text; what can't be decided hides nothing."""
    page = "<style>{}</style><nav>menu</nav><p class=sidebar>side"
    hide = "nav, .sidebar { display: none }"
    for kept in ("@media print { %s }", "@media (max-width: 600px) { %s }", "@media only print, (max-width:20em) { %s }", "@media not screen { %s }", "@media (prefers-contrast: more) { %s }", "@supports (x: y) { %s }", "@media print { @media screen { %s } }", "@page { margin: 0 } /* %s */", "@font-face { src: url('{') } @media print { %s }"):
        assert html_text.text_of(page.replace("{}", kept % hide)) == "menu\n\nside", kept
    for gone in ("%s", "@media screen { %s }", "@media all and (min-width: 600px) { %s }", "@import 'x.css'; %s", "@media print { p { color: red } } %s", "@layer base { @media not print { %s } }", ".x { color: red; .y { top: 0 } } %s", "<!-- %s -->"):
        assert html_text.text_of(page.replace("{}", gone % hide)) == "", gone
    assert html_text.text_of(page.replace("{}", "nav { display: none } @supports (display: grid) { nav { display: grid } }")) == "menu\n\nside"
    assert html_text.text_of(page.replace("{}", "@media screen {" * 5000 + hide)) == html_text.text_of(page.replace("{}", "@layer a { " + hide)) == ""
    assert html_text.text_of(page.replace("{}", hide).replace("<style>", "<style media=print>")) == "menu\n\nside"


def test_html_selectors_spans_and_closed_elements():
    page = "<style>{}</style><div id=m class='a b'><p class=y>one<p>two</div><p class=y data-x=1>three"
    text = lambda css: html_text.text_of(page.replace("{}", css)).split()
    assert text("p.y{display:none}") == ["two"] and text("#m p{display:none}") == ["three"] and text("div > p.y{display:none}") == ["two", "three"]
    assert text(".a.b .y{display:none}") == ["two", "three"] and text("[data-x]{display:none}") == text("p[data-x=1]{display:none}") == ["one", "two"] and text("*{visibility:hidden}") == []
    assert text("p:hover{display:none}") == text("p + p{display:none}") == ["one", "two", "three"]
    assert text("p{display:none} div p{display:block}") == ["one", "two"] and text("#m .y{display:block} p.y{display:none}") == ["one", "two"]
    assert html_text.text_of("<table><tr><td rowspan=2>A<td>b<tr><td>c<tr><td colspan=2>wide<td>e</table>") == "A    | b\n     | c\nwide |   | e"
    assert html_text.text_of("<details><summary>S</summary>in</details><details open><summary>T</summary>out</details><dialog>no</dialog><dialog open>yes</dialog>") == "S\nT\nout\nyes"
    assert html_text.text_of("<ruby>漢<rp>(</rp><rt>kan</rt><rp>)</rp></ruby> <input type=submit value='Go on'> <input type=text value=x>") == "漢kan Go on"
    long = "<table><tr><td>" + "x" * 20_000 + "<td>y" + "<tr><td>a<td>b" * 4000 + "</table>"
    assert len(html_text.text_of(long)) < 10 * len(long)


def test_html_selectors_of_many_parts():
    """Against a matcher that tries every ancestor, and in time for deep pages."""
    import time

    rng = random.Random(8)

    def fits(node, simple):
        return all(n == node.tag if k == "t" else n in node.attributes.get("class", "").split() for k, n, _ in simple)

    def matches(path, found):
        if not path or not fits(path[-1], found[0][1]):
            return False
        if len(found) == 1:
            return True
        outer = [path[:-1]] if found[0][0] == ">" else [path[:k] for k in range(len(path) - 1, 0, -1)]
        return any(matches(p, found[1:]) for p in outer)

    for _ in range(150):
        part = lambda: rng.choice(["div", "b", ".x", "div.y", ".x.y"])
        selectors = [part() + "".join(rng.choice([" ", " > "]) + part() for _ in range(rng.randrange(1, 4))) for _ in range(4)]
        body, opened = "", []
        for k in range(30):
            if opened and rng.random() < 0.4:
                body += f"</{opened.pop()}>"
            else:
                opened.append(rng.choice(["div", "b"]))
                body += f"<{opened[-1]} class='{rng.choice(['', 'x', 'y', 'x y'])}'>"
        root = html_text.parse("".join(f"<style>{s}{{display:none}}</style>" for s in selectors) + body)
        seen, todo = html_text._Seen(root), [[root]]
        while todo:
            path = todo.pop()
            node = path[-1]
            if node.tag in ("div", "b"):
                assert (seen.style(node, "display") == "none") == any(matches(path, html_text._selector(s)) for s in selectors)
            todo += [[*path, c] for c in node.children if isinstance(c, html_text.Node)]
    for css in (".never" + " div" * 8, ".never" + " > div" * 8, "div " * 8 + ".never", "div " * 7 + "div"):
        page = f"<style>{css} p{{display:none}}</style>" + "<div>" * 500 + "<p>in"
        start = time.time()
        assert html_text.text_of(page) == ("" if css == "div " * 7 + "div" else "in")
        assert time.time() - start < 1


def test_html_table_of_pages(spark):
    rows = [(1, None, "t"), (2, "", "t"), (3, "<p>same", "t"), (3, "<p>same", "t"), (None, "<b>x</b>", "t"), (4, "<p>" + "word " * 200_000, "t")]
    pages = spark.createDataFrame(rows, "page_id long, html string, text string")
    got = sorted((r["page_id"] or 0, r["n_chars"], r["text"][:5]) for r in html_text.extract(pages).collect())
    assert got == [(0, 1, "x"), (1, 0, ""), (2, 0, ""), (3, 4, "same"), (3, 4, "same"), (4, 999_999, "word ")]
    assert html_text.extract(pages.limit(0)).count() == 0


def test_html_foreign_and_select():
    assert html_text.text_of("<p>a <math><mi>x</mi><mo>=</mo><mn>2</mn><semantics><mn>7</mn><annotation>tex</annotation></semantics></math> b") == "a x=27 b"
    assert html_text.text_of("<svg><title>no</title><defs><text>no</text></defs><path d='M0'/><g><text>bar <tspan>one</tspan></text><text>two</text></g></svg>end") == "bar one\ntwo\nend"
    assert html_text.text_of("<svg><defs/><text>a</text><foreignObject><div>b<p>c</div></foreignObject><text display=none>no</text></svg>") == "a\nb\n\nc"
    assert html_text.text_of("x<svg/>y <svg><path><p>z") == "xy\n\nz"
    assert html_text.text_of("Pick <select><optgroup label=Big><option>One<option selected>Two</optgroup><option label=Three></select> now") == "Pick\nBig\nOne\nTwo\nThree\nnow"


def test_mixing(spark):
    rows = [(i, "w " * 10, "big") for i in range(4000)] + [(10_000 + i, "w " * 10, "small") for i in range(300)] + [(20_000, None, None), (20_001, "", "empty")]
    got = mixing.plan(frame(spark, rows), repeats=1.5).groupBy("source").agg(F.avg("copies").alias("c"), F.min("copies").alias("m"), F.max("passes").alias("p")).collect()
    by = {r["source"]: r for r in got}
    assert by["big"]["c"] == 1 and abs(by["small"]["p"] - 1.5) < 1e-6 and abs(by["small"]["c"] - 1.5) < 0.01 and by["empty"]["c"] == by[None]["c"] == 1
    mixed = mixing.mix(frame(spark, rows), repeats=1.5)
    assert mixed.columns == frame(spark, rows).columns and mixed.count() == 4000 + 450 + 2
    assert mixing.plan(frame(spark, ODD).limit(0)).count() == 0
    totals = spark.createDataFrame([("a", 100, 1), ("b", 10, 1), ("c", 1, 1)], "source string, tokens long, docs long")
    w = [r["weight"] for r in mixing.temperature(totals, entropy=0.9).collect()]
    assert abs(-sum(x * np.log(x) for x in w) - 0.9) < 1e-6 and abs(sum(w) - 1) < 1e-9


def test_toxicity(spark):
    rng = random.Random(6)
    clean = lambda: " ".join("".join(rng.choices("aeiouklmnrst", k=rng.randint(3, 9))) for _ in range(40))
    bad = ["stupid", "worthless", "disgusting"]
    rows = [(i, clean() + (f" {rng.choice(bad)} " + clean() if i % 4 == 0 else "")) for i in range(600)]
    docs, labels = frame(spark, [(i, t, "s") for i, t in rows]), spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in rows], "doc_id long, toxic int")
    machine = toxicity.train_from(docs, labels)
    out = {r["doc_id"]: r["predicted"] for r in toxicity.scored(docs, machine).collect()}
    assert sum(out[i] == int(i % 4 == 0) for i, _ in rows) >= 590
    odd = toxicity.scored(frame(spark, ODD), machine).collect()
    assert len(odd) == len(ODD) and all(0 <= r["score"] <= 1 and r["predicted"] == 0 for r in odd)
    machine.learn(["stuupid", "s-tupid", "student"])
    assert min(machine.known["stuupid"], machine.known["s-tupid"]) > machine.known["student"] and machine.margin({"s-tupid"}) > machine.middle
    assert toxicity.scored(docs.limit(0), machine).count() == 0
    empty = toxicity.train_from(docs.limit(0), labels.limit(0))
    assert {r["predicted"] for r in toxicity.scored(docs, empty).collect()} == {0}


def test_only_near_copies_count_once():
    """Unrelated texts that share their two words of smallest hash all stay; copies but for one word of a larger hash go."""
    import zlib

    words = sorted((f"word{i}" for i in range(400)), key=lambda w: zlib.crc32(w.encode()))
    unrelated = [{*words[:2], *words[2 + 30 * i : 32 + 30 * i]} for i in range(10)]
    assert len(toxicity._apart(unrelated)) == 10
    assert len(toxicity._apart([{*words[:30], w} for w in words[40:60]])) == 1


def test_folded_machine_is_the_kernel_machine():
    words = ["stupid", "clown", "garden", "water", "window", "idiot"]
    weights = np.array([1.0, -0.5, 0.3, 0.2, -1.0, 0.7])
    word, triple, weight = toxicity.triples(words)
    machine = toxicity.Machine(np.bincount(triple, weight * weights[word], toxicity._CLASSES**3), 0.1)
    machine.learn(["stuped", "wander"])
    want = toxicity.kernel(["stuped", "wander"], words) @ weights + 0.1
    assert np.allclose([machine.known["stuped"], machine.known["wander"]], want, atol=1e-5)


def test_pipeline_stages(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "minhash_near_dedup", "mixing", "byte_bpe"]
    docs = frame(spark, ODD)
    for _, stage in corpus_pipeline.STAGES[1:4]:
        assert stage(spark, docs, SF).columns == docs.columns and stage(spark, docs.limit(0), SF).count() == 0


def test_pipeline_run_is_the_brute_force_pipeline(spark, tmp_path):
    """All five stages on real and odd rows, each replayed on the driver from its definition."""
    import base64 as b64
    from collections import Counter, defaultdict

    import corpus_pipeline
    import public_tokenizers as P
    import tiktoken
    from spanloom.llm.common import read

    docs = read(spark, SF, "documents")
    odd = [(10**6 + i if i is not None else None, t, None, s, 0) for i, t, s in ODD]
    docs = docs.union(spark.createDataFrame(odd, docs.schema)).withColumn("text_sha256", F.lit("x")).withColumn("copies", F.lit(3))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    read(spark, SF, "labels").write.parquet(f"{tmp_path}/labels.parquet")
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]

    machine = toxicity.train_from(docs, read(spark, SF, "labels"))
    machine.learn({w for _, t, _ in rows for w in toxicity.words(t)})
    bad = {i for i, t, _ in rows if i is not None and machine.score(machine.margin(toxicity.words(t))) >= 0.7}
    rows = [r for r in rows if r[0] not in bad]
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[norm(t)] = min(i, first.get(norm(t), i))
    rows = [r for r in rows if r[0] is None or first[norm(r[1])] == r[0]]
    near = brute_near([(i, t) for i, t, _ in rows if i is not None], 5, 80)
    rows = [r for r in rows if r[0] is None or near[r[0]][1] == r[0]]
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    totals, sizes = Counter(), Counter()
    for _, t, s in rows:
        totals[s] += words(t)
        sizes[s] += 1
    some = [n for n in totals.values() if n]
    power = max(0.0, 1 - np.log(2) / np.log(max(some) / min(some)))
    out = []
    by_source = defaultdict(list)
    for i, t, s in rows:
        key = hashlib.md5(f"{i}:17".encode()).hexdigest() if i is not None else ""
        by_source[s].append(((int(key[:8], 16) if key else 0) % max(1, -(-sizes[s] // 2000)), key, i or 0, i, t))
    for s, list_ in by_source.items():
        passes = (totals[s] / max(some)) ** (power - 1) if totals[s] else 1.0
        whole = int(passes + 1e-9)
        budget, upto = int((passes - whole) * totals[s] + 1e-6), 0
        for _, _, _, i, t in sorted(list_):
            upto += words(t)
            out += [(i, t)] * (1 if i is None else whole + (upto <= budget))
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {b64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for i, t in out:
        ids = lib.encode_ordinary(t or "")
        want.append((i or 0, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    got = [(r["doc_id"] or 0, r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want) and len(got) > docs.count() / 2


@pytest.mark.parametrize("name", ["op1_embedding_near_dedup", "op6_minhash_near_dedup", "op7_suffix_dedup", "op8_exact_dedup", "op9_mixing", "op11_fill_in_middle", "op12_decontamination", "op13_spelling_variants"])
def test_query_matches_sql(spark, name):
    import duckdb
    from spanloom.llm import queries

    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    out = queries.QUERIES[name](spark, SF)
    columns = sorted(out.columns)
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({queries.SQL[name]})").fetchall()
    assert sorted(map(repr, map(tuple, out.select(*columns).collect()))) == sorted(map(repr, want))


def test_secret_query_is_brute_force(spark):
    """op10's digests and spans over a whole table, replayed with Python's patterns."""
    kinds = {
        "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 6),
        "access": (re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
        "hex": (re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24),
    }
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in secret_scan.op10_secret_scans(spark, SF).collect():
        found = [(m.start(), i, m.end(), k) for i, (k, (p, keep)) in enumerate(kinds.items()) for m in p.finditer(texts[r["doc_id"]]) if keep(m)]
        listed = ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(found))
        assert [r[f"n_{k}"] for k in kinds] == [sum(f[3] == k for f in found) for k in kinds]
        assert r["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest() and set(listed.split(",")) - {""} <= set(r["spans"].split(","))


def test_chains_on_held_out_strings(spark):
    """Random strings of an alphabet and lengths that the samples don't hold, against compounds of words that they don't hold."""
    rng = random.Random(77)
    words = "mountain bicycle harvest orchestra lantern velvet thunder biscuit compass meadow puzzle whisper saddle copper falcon granite".split()
    good = ["".join(rng.choices("ABCDEFGHJKMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz23456789", k=rng.randint(22, 50))) for _ in range(300)]
    bad = [rng.choice("_-/").join(rng.choices(words, k=rng.randint(3, 5))) for _ in range(300)] + ["".join(w.title() for w in rng.choices(words, k=4)) for _ in range(300)]
    got = {r["doc_id"]: len(r["markov"]) for r in secret_scan.scan(frame(spark, [(i, t, "s") for i, t in enumerate(good + bad)])).collect()}
    found, false = sum(got[i] > 0 for i in range(300)), sum(got[i] > 0 for i in range(300, 900))
    print("chains", found, false)
    assert found >= 285 and false <= 12
    assert secret_scan.scan(frame(spark, ODD).limit(0)).count() == 0 and secret_scan.scan(frame(spark, ODD)).count() == len(ODD)
