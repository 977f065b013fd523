"""Containment counts and components by ranks and contraction, against all pairs."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.operators import graph, resolve, sweep

ROWS = "doc_id long, seq long, entity string, gstart long, gend long, origin string"


def spans(seed, docs, most, width):
    rng = random.Random(seed)
    out = []
    for d in range(docs):
        for k in range(rng.randrange(1, most)):
            a = rng.randrange(width)
            out.append((d, k, rng.choice(["PERSON", "YEAR", "OTHER", "PROPER_NOUN", "PROPER_NOUN"]), a, a + int(rng.random() ** 3 * width / 3), "auto"))
    return out


def test_inversions():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 7, 64, 200):
        v = rng.permutation(n)
        after, before = sweep.inversions(v)
        assert after.tolist() == [int((v[i + 1 :] < v[i]).sum()) for i in range(n)]
        assert before.tolist() == [int((v[:i] > v[i]).sum()) for i in range(n)]


@pytest.mark.parametrize("small,strip", [(64, 65536), (2, 65536), (2, 7), (0, 3)])
def test_counts_are_those_of_all_pairs(spark, small, strip):
    rows = spans(2, 12, 60, 40)
    found = resolve.components(spark.createDataFrame(rows, ROWS))
    got = {(r["doc_id"], r["seq"]): (r["n_inside"], r["n_around"]) for r in sweep.with_containment(found, small, strip).collect()}
    comp = {(r["doc_id"], r["seq"]): r["comp"] for r in found.collect()}
    for d, k, _, a, b, _ in rows:
        mine = [(x, y) for e, j, _, x, y, _ in rows if e == d and j != k and comp[d, j] == comp[d, k]]
        assert got[d, k] == (sum(a <= x and y <= b for x, y in mine), sum(x <= a and b <= y for x, y in mine))
    assert len(got) == len(rows)


@pytest.mark.parametrize("overlap", ["exact", "contain", "overlap"])
@pytest.mark.parametrize("entities", ["any", "same"])
def test_components_are_those_of_the_edges(spark, overlap, entities):
    rows = [r for seed, width in ((3, 12), (4, 60), (5, 300)) for r in ((d + 100 * seed, *rest) for d, *rest in spans(seed, 25, 14, width))]
    found = spark.createDataFrame(rows, ROWS)
    got = {(r["doc_id"], r["seq"]): r["comp"] for r in resolve.components(found, overlap, entities).collect()}
    by_links = resolve.labelled(found, resolve.edges(found, overlap, entities)).collect()
    assert got == {(r["doc_id"], r["seq"]): r["comp"] for r in by_links}
    root = {k: k for k in got}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for r in resolve.edges(found, overlap, entities).collect():
        x, y = find((r["doc_id"], r["i"])), find((r["doc_id"], r["j"]))
        root[max(x, y)] = min(x, y)
    assert got == {k: find(k)[1] for k in got}
    assert len(set(got.values())) < len(got)


def test_links_of_long_chains(spark):
    links = [(1, i, i + 1) for i in range(300)] + [(2, 0, i) for i in range(1, 200)] + [(3, 5, 5), (3, 7, 6), (3, 6, 7)] + [(4, None, 1)]
    got = {(r["doc_id"], r["id"]): r["root"] for r in graph.components(spark.createDataFrame(links, "doc_id long, u long, v long")).collect()}
    assert got == {**{(1, i): 0 for i in range(1, 301)}, **{(2, i): 0 for i in range(1, 200)}, (3, 7): 6}


def test_one_document_of_many_nested_spans(spark):
    n = 200_000
    k = F.col("id")
    found = spark.range(n, numPartitions=4).select(F.lit(1).cast("long").alias("doc_id"), k.alias("seq"), F.lit("PERSON").alias("entity"), k.alias("gstart"), (2 * n - k - k % 2).alias("gend"), F.lit("auto").alias("origin"), F.lit(0).cast("long").alias("comp"))
    start = time.time()
    out = sweep.with_containment(found)
    # 2i and 2i + 1 end at 2n - 2i and 2n - 2i - 2: each span lies in all before it.
    wrong = out.filter((F.col("n_around") != F.col("seq")) | (F.col("n_inside") != n - 1 - F.col("seq")))
    assert out.count() == n and wrong.count() == 0
    assert [r["seq"] for r in resolve.winners(found).collect()] == [0]
    assert resolve.components(found.drop("comp"), "contain", "same").select("comp").distinct().count() == 1
    assert time.time() - start < 240
