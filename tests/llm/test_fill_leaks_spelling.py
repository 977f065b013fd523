"""Fill-in-middle, decontamination and spelling variants against brute force, with their odd inputs."""

import hashlib
import random
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from spanloom.llm import decontaminate, fill_middle, spelling

DOCS = "doc_id long, text string, word string, form string, n int, items string, key string, output string"
ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "same Text here"), (5, "same Text here"), (5, "same Text here"), (None, "lost id text"), (6, "Word " * 30_000), (7, "é𝔸b" * 500), (8, "a<S>b"), (9, "x" * 100_000), (10, "<<P"), (11, "--")]
TITLES = {"psm": ("<P>", "<S>", "<M>"), "spm": ("<S>", "<P>", "<M>")}


def frame(spark, rows):
    """Documents with extra columns whose names clash with working ones."""
    return spark.createDataFrame([(i, t, "w", "f", 7, "i", "k", "o") for i, t in rows], DOCS)


def random_texts(seed, n, alphabet="ab é\n-Zß𝔸", most=60):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(most))) for _ in range(n)]


def test_unit_starts_and_ranks():
    for text in [*random_texts(1, 300), "a" * 1000, "é" * 1000, ""]:
        want = [m.start() for m in re.finditer(r"[A-Za-z]+|[^A-Za-z]", text)]
        bits = fill_middle.starts(text)
        assert [i for i in range(len(text)) if bits >> i & 1] == want and bits.bit_count() == len(want)
        assert [fill_middle.place(bits, len(text), k) for k in range(len(want) + 1)] == [*want, len(text)]


def brute_fill(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    if text == "" or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return len(units), "plain", None, None, text
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 20:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle(spark, monkeypatch):
    rows = ODD + [(100 + k, t) for k, t in enumerate(random_texts(2, 300, "ab <P>SM é"))]
    made = fill_middle.fill_in_middle(frame(spark, rows))
    got = made.withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    key = lambda r: (r[0] is None, r[0] or 0, str(r[-1]))
    want = [(i, *brute_fill(i, t), t or "") for i, t in rows]
    assert sorted((tuple(r) for r in got), key=key) == sorted(want, key=key)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}
    assert fill_middle.fill_in_middle(frame(spark, [])).count() == 0
    # Groups of a batch are cut by size alone.
    monkeypatch.setattr(fill_middle, "GROUP_POINTS", 50)
    small = fill_middle.fill_in_middle(frame(spark, rows).coalesce(1)).select("doc_id", "output").collect()
    assert sorted(map(repr, small)) == sorted(repr(r) for r in made.select("doc_id", "output").collect())


def brute_words(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [(m[0], m.start(), m.end()) for m in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)]


def brute_leaks(docs, items, window):
    wanted = [(str("" if i is None else i), [w for w, _, _ in brute_words(t)]) for i, t in items]
    out = []
    for i, text in docs:
        listed = brute_words(text)
        own, hit, found = [w for w, _, _ in listed], set(), set()
        for name, words in wanted:
            size = min(window, len(words))
            for k in range(len(words) - size + 1) if size else ():
                for j in range(len(own) - size + 1):
                    if own[j : j + size] == words[k : k + size]:
                        hit |= set(range(j, j + size))
                        found.add(name)
        spans = []
        for j in sorted(hit):
            if spans and spans[-1][2] == j - 1:
                spans[-1] = spans[-1][0], listed[j][2], j
            else:
                spans.append((listed[j][1], listed[j][2], j))
        out.append((i, len(own), len(hit), sorted(found), [(a, b) for a, b, _ in spans]))
    return out


def test_decontamination(spark):
    rng = random.Random(3)
    some = lambda n, of=5: " ".join(rng.choice(["Ab", "c", "é日", "d9", "ßx", "E", "zz"][:of]) for _ in range(n))
    items = [(1, some(9)), (2, some(30, 7)), (3, "Ab, c!"), (4, None), (5, "?!"), (6, ""), (1, some(14)), (None, some(6, 7)), (7, some(9)), (8, "日本語")]
    docs = ODD[:8] + ODD[9:] + [(100 + k, some(rng.randrange(60), 7).replace(" ", rng.choice([" ", ", ", "\n", "--"]))) for k in range(60)] + [(99, "x 日本語 y")]
    listed = spark.createDataFrame([(i, t, 0, "r") for i, t in items], "item_id long, text string, doc_id int, runs string")
    key = lambda r: (r[0] is None, r[0] or 0)
    want = sorted(brute_leaks(docs, items, 4), key=key)
    assert any(r[2] for r in want) and any(not r[2] for r in want)
    shaped = lambda rows: sorted([(r["doc_id"], r["n_words"], r["n_hit"], r["items"], [tuple(s) for s in r["spans"]]) for r in rows], key=key)
    assert shaped(decontaminate.contamination(frame(spark, docs), listed, window=4).collect()) == want
    # A benchmark beyond an automaton's bound is cut into parts; what they find is the same.
    assert shaped(decontaminate.contamination(frame(spark, docs), listed, window=4, part_words=12).collect()) == want
    nothing = decontaminate.contamination(frame(spark, docs), listed.limit(0), window=4).collect()
    assert [r[:3] for r in shaped(nothing)] == [(r[0], r[1], 0) for r in want]
    assert decontaminate.contamination(frame(spark, []), listed).count() == 0


def test_symbols_are_distinct():
    m = decontaminate.Matcher([("i", [str(k).encode() for k in range(60_000)])])
    assert len(set(m.symbols.values())) == 60_000 and not any("\ud800" <= c <= "\udfff" or c == "\0" for c in m.symbols.values())
    runs, items = m.scan([str(k).encode() for k in range(57_000, 57_020)])
    assert runs == [(0, 20)] and items == {0}


def brute_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(counts, times):
    near = {w: [v for v in counts if brute_near(w, v)] for w in counts}
    form = {}
    for w, list_ in near.items():
        best = min(list_, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best and counts[best] >= times * counts[w] else None

    def last(w):
        while form[w]:
            w = form[w]
        return w

    return {(w, form[w], last(w), counts[w], len(near[w]), counts[form[w]] if form[w] else None) for w in counts}


def test_variants_of_every_shape(spark):
    rng = random.Random(4)
    words = {"".join(rng.choice("abé") for _ in range(rng.randrange(1, 8))) for _ in range(500)}
    words |= {"prefixes" + a + b for a in "abcdefghij" for b in "abcdefghij"} | {a + b + "suffixes" for a in "abcdefghij" for b in "abcdefghij"}
    words |= {"a", "é", "x" * 3000, "x" * 3001, "x" * 1500 + "y" + "x" * 1499}
    counts = {w: rng.choice([1, 2, 10, 60, 60, 400]) for w in words}
    listed = spark.createDataFrame(sorted(counts.items()), "word string, n long")
    want = brute_variants(counts, 5)
    for pairs in (4096, 8):
        assert {tuple(r) for r in spelling.variants(listed, pairs=pairs).collect()} == want
    assert sum(r[1] is not None for r in want) > 50 and any(r[2] != r[1] for r in want if r[1])


def brute_counts(docs, every, least):
    n = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if every and h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 6 and k >= least}


def test_spelling_variants(spark):
    rng = random.Random(5)
    names = ["Straße", "Éclairs", "résumé", "résumés", "letter", "letters", "lettéré", "ABCDEF", "abcdeƒgh", "short", "kitchen"]
    docs = ODD + [(100 + k, " ".join(rng.choice(names) for _ in range(80))) for k in range(40)]
    for every in (3, 199, 0):
        assert {tuple(r) for r in spelling.counted(frame(spark, docs), every=every).collect()} == set(brute_counts(docs, every, 5).items())
    counts = brute_counts(docs, 3, 5)
    assert {tuple(r) for r in spelling.spelling_variants(frame(spark, docs), every=3, times=2).collect()} == brute_variants(counts, 2)
    assert spelling.spelling_variants(frame(spark, [])).count() == 0
