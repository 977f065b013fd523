"""Scored recognisers and choices among overlapping spans, against plain versions."""

import random

from pyspark.sql import functions as F

from spanloom.operators import choose, detect, registry

SPAN = "doc_id long, entity string, start int, end int, word string, origin string, prio int, place int, score double"


def some(seed, docs=6, most=40, width=120):
    rng = random.Random(seed)
    rows = []
    for d in range(docs):
        for k in range(rng.randrange(most)):
            a = rng.randrange(width)
            rows.append((d, rng.choice("AB"), a, a + rng.randrange(1, 14), f"w{k}", "auto", rng.randrange(3), rng.randrange(2), rng.choice([0.2, 0.5, 0.5, 0.9])))
    return rows


def test_first_free_is_the_plain_choice(spark):
    rows = some(1) + [(9, "A", 5, 6, "x", "auto", 0, 0, 0.1)]
    got = sorted(tuple(r)[:5] for r in detect.greedy(spark.createDataFrame(rows, SPAN)).select("doc_id", "entity", "start", "end", "word").collect())
    want = []
    for d in {r[0] for r in rows}:
        taken = []
        for r in sorted((r for r in rows if r[0] == d), key=lambda r: (r[6], r[2], -r[7], r[3], r[1], r[4])):
            if not any(r[2] < t[3] and t[2] < r[3] for t in taken):
                taken.append(r)
        want += [t[:5] for t in taken]
    assert got == sorted(want)


def test_one_crowded_document(spark):
    n = 60_000
    k = F.col("id")
    found = spark.range(n).select(F.lit(1).cast("long").alias("doc_id"), F.lit("A").alias("entity"), (k * 3).cast("int").alias("start"), (k * 3 + 4).cast("int").alias("end"), F.lit("w").alias("word"), F.lit("auto").alias("origin"), F.lit(0).alias("prio"))
    assert detect.greedy(found).count() == n // 2


def test_heaviest_has_the_greatest_total(spark):
    rows = some(2, docs=8, most=12, width=40)
    got = choose.heaviest(spark.createDataFrame(rows, SPAN)).collect()
    for d in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == d]
        best = 0.0
        for mask in range(1 << len(mine)):
            chosen = sorted((r for i, r in enumerate(mine) if mask >> i & 1), key=lambda r: r[2])
            if all(a[3] <= b[2] for a, b in zip(chosen, chosen[1:])):
                best = max(best, sum(r[8] for r in chosen))
        taken = sorted((r["start"], r["end"], r["score"]) for r in got if r["doc_id"] == d)
        assert all(a[1] <= b[0] for a, b in zip(taken, taken[1:])) and abs(sum(t[2] for t in taken) - best) < 1e-9


def test_contained_matches_go(spark):
    rows = some(3)
    got = sorted(tuple(r) for r in registry.without_contained(spark.createDataFrame(rows, SPAN)).select("doc_id", "entity", "start", "end", "score").collect())
    want = set()
    for d, e, a, b, *_, s in rows:
        better = [r for r in rows if r[:2] == (d, e) and r[2] <= a and b <= r[3] and (-r[8], r[2], r[2] - r[3]) < (-s, a, a - b)]
        if not better:
            want.add((d, e, a, b, s))
    assert got == sorted(want)


def test_scores(spark):
    texts = ["visa 4111111111111111", "4111 1111 1111 1111", "4111111111111112", "call 03-1234-5678", "GB82 WEST 1234 5698 7654 32", "GB82 WEST 1234 5698 7654 33", "1.2.3.4", "1.2.3.400", "1.2.3.4.5", "mail a.b@c-d.org now", "a@b.c", "", None, "番号 1234-5678-9018 と", "太郎さん"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r["doc_id"], r["entity"], r["word"], round(r["score"], 2)) for r in registry.analyse(docs).collect()}
    assert got == {
        (0, "CREDIT_CARD", "4111111111111111", 1.0), (1, "CREDIT_CARD", "4111 1111 1111 1111", 1.0), (3, "PHONE_NUMBER", "03-1234-5678", 1.0), (4, "IBAN_CODE", "GB82 WEST 1234 5698 7654 32", 1.0),
        (6, "IP_ADDRESS", "1.2.3.4", 1.0), (9, "EMAIL_ADDRESS", "a.b@c-d.org", 1.0), (13, "INDIVIDUAL_NUMBER", "1234-5678-9018", 1.0), (14, "PERSON", "太郎さん", 0.7),
    }
    own = (registry.Recogniser("CODE", ((r"X\d", 0.1), (r"X\d\d", 0.5)), None, ("code",)),)
    said = spark.createDataFrame([(1, "X12"), (2, "the CODE is X12"), (3, "code" + " " * 60 + "X1"), (4, "code" + " " * 50 + "X1"), (5, "X1 code")], "doc_id long, text string")
    assert {(r["doc_id"], r["word"], round(r["score"], 2)) for r in registry.analyse(said, own).collect()} == {(1, "X12", 0.5), (2, "X12", 0.85), (3, "X1", 0.1), (4, "X1", 0.45), (5, "X1", 0.1)}
    two = (registry.Recogniser("CODE", ((r"X\d", 0.1),), None, ("code", "der")), registry.Recogniser("Y", ((r"Y\d", 0.1),), None, ("abc",)))
    both = spark.createDataFrame([(1, "Der der X1 Y1"), (2, "abc X1 Y1 code")], "doc_id long, text string")
    assert {(r["doc_id"], r["word"], round(r["score"], 2)) for r in registry.analyse(both, two).collect()} == {(1, "X1", 0.45), (1, "Y1", 0.1), (2, "X1", 0.1), (2, "Y1", 0.45)}
    assert registry.analyse(said, own, threshold=0.5).count() == 2 and registry.analyse(said, own, ["ELSE"]).count() == 0
    assert {(r["doc_id"], r["word"]) for r in registry.analyse(said, own, apart=True).filter("doc_id < 3").collect()} == {(1, "X12"), (2, "X12")}
