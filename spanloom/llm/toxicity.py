"""Toxicity by a subsequence string kernel, a support vector machine and Nystroem landmarks.

The kernel compares two words by their gapped letter triples: a triple that spans s letters weighs DECAY^s, so inserted
and dropped letters cost a part of the similarity only.  A linear SVM is trained on Nystroem features against landmark
words.  Since the kernel's own features (triples) are few, the trained machine folds into one weight a triple - the
same function, without one kernel evaluation a landmark.

Labels mark texts, not words, so training is multiple-instance: a toxic text's witnesses are positive, all words of
clean texts negative; witnesses are chosen by log-odds first and by the machine itself afterwards.  A text's margin weighs
those of its TOP most toxic words and the number of its words, by a logistic regression on the training texts, since some
insults come as several milder words; its score is a logistic curve whose 0.7 lies at the best F1 over these texts.
"""

from __future__ import annotations

import heapq
import math
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.common import give_back, read, ship, unused

#: Training texts of each label at most (the bounded sample of labelled rows), landmarks, clean words in a fit.
TEXTS, LANDMARKS, NEGATIVES = 2500, 256, 6000
#: Words of smallest hash that near copies of a training text share.
SIGNATURE = 8
#: Toxic training texts from which a word that no clean one has is a witness.
SURE = 12
#: Words of a text, the most toxic ones, that its margin is made of.
TOP = 4
#: Kernel: weight of each spanned letter, longest span.  Score from which a text is toxic.
DECAY, SPAN, TOXIC_FROM = 0.6, 6, 0.7
_CLASSES = 40
_GAPS = [(a, b) for a in range(1, SPAN - 1) for b in range(a + 1, SPAN)]
# Digits and signs that stand for letters.
_LOOKALIKE = str.maketrans("0134578@$!", "oleastbasi")
_EDGES, _INNER = " .,;:!?\"'()[]{}|<>*_-~#%/\\", re.compile(r"[\W\d_]+")
_SPELLED = re.compile(r"(?<!\S)(?:\S[ \t]){3,}\S(?!\S)")


def words(text: str | None) -> set[str]:
    """The text's distinct words in lower case without signs at their edges; letters spelled one by one make a word too."""
    low = (text or "").lower()
    out = {w.strip(_EDGES) for w in low.split()}
    out.update(m[0].replace(" ", "").replace("\t", "") for m in _SPELLED.finditer(low))
    out.discard("")
    return out


def letters(word: str) -> str:
    """The letters that the kernel sees: look-alikes turned, signs out, accents composed."""
    if not word.isalpha():
        word = _INNER.sub("", word.translate(_LOOKALIKE))
    return "^" + (word if word.isascii() else unicodedata.normalize("NFC", word))


def _codes(word: str) -> bytes:
    return bytes([ord(c) - 96 if "a" <= c <= "z" else 27 if c == "^" else 28 + ord(c) % 12 for c in letters(word)])


def triples(batch: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Kernel features as (word, triple, weight), each word's weights of unit length, sorted by word."""
    raw = [_codes(w) for w in batch]
    text = np.frombuffer(b"".join(r + bytes(SPAN) for r in raw), np.uint8).astype(np.int64)
    owner = np.repeat(np.arange(len(raw)), [len(r) + SPAN for r in raw])
    keys, weights = [], []
    for a, b in _GAPS:
        x, y, z = text[: len(text) - b], text[a : len(text) - b + a], text[b:]
        at = np.flatnonzero((x > 0) & (y > 0) & (z > 0) & (owner[: len(text) - b] == owner[b:]))
        keys.append((owner[at] * _CLASSES + x[at]) * _CLASSES**2 + y[at] * _CLASSES + z[at])
        weights.append(np.full(len(at), DECAY ** (b + 1)))
    key, back = np.unique(np.concatenate(keys), return_inverse=True)
    weight = np.bincount(back, np.concatenate(weights), len(key))
    word, triple = key // _CLASSES**3, key % _CLASSES**3
    norm = np.sqrt(np.bincount(word, weight**2, len(raw)))
    return word, triple, weight / norm[word]


def kernel(a: list[str], b: list[str]) -> np.ndarray:
    """Normalised kernel of all words of a with all of b; a word too short for a triple is similar to none."""
    right = np.zeros((_CLASSES**3, len(b)), np.float32)
    word, triple, weight = triples(b)
    right[triple, word] = weight
    out = np.zeros((len(a), len(b)), np.float32)
    for at in range(0, len(a), 500):
        word, triple, weight = triples(a[at : at + 500])
        if len(word):
            first = np.flatnonzero(np.diff(word, prepend=-1))
            out[at + word[first]] = np.add.reduceat(right[triple] * weight[:, None].astype(np.float32), first)
    return out


#: Words that a worker remembers with their margins; workers live on beside later stages, so this is memory that they share.
KEPT = 1 << 18


class Machine:
    """One weight for each triple, a bias, and the logistic curve for texts."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias, self.slope, self.middle = weights, bias, 1.0, 0.0
        #: Mean, deviation and weight of a text's features; at first the most toxic word alone counts.
        self.text = np.zeros(TOP + 1), np.ones(TOP + 1), np.r_[1.0, np.zeros(TOP)]
        self.known: dict[str, float] = {}

    def learn(self, batch: Iterable[str]) -> None:
        """Scores words that aren't known yet; the memory starts afresh when it is large."""
        if len(self.known) > KEPT:
            self.known.clear()
        new = [w for w in batch if w not in self.known]
        for at in range(0, len(new), 4000):
            some = new[at : at + 4000]
            word, triple, weight = triples(some)
            values = np.bincount(word, weight * self.weights[triple], len(some)) + self.bias
            self.known.update(zip(some, values.tolist()))

    def features(self, found: set[str]) -> np.ndarray:
        """The TOP largest margins, not a number where words are missing, and the words' number; no words count as one without letters."""
        values = heapq.nlargest(TOP, map(self.known.__getitem__, found)) or [self.bias]
        return np.array([*values, *[np.nan] * (TOP - len(values)), math.log1p(len(found))])

    def margin(self, found: set[str]) -> float:
        mean, spread, weights = self.text
        z = (self.features(found) - mean) / spread
        z[-1] = max(z[-1], -2.5)  # a very short text is no more suspect than a short one
        return float(np.where(np.isnan(z), 0.0, z) @ weights)  # what is missing tells nothing

    def score(self, margin: float) -> float:
        z = self.slope * (margin - self.middle) + math.log(TOXIC_FROM / (1 - TOXIC_FROM))
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def support_vectors(x: np.ndarray, y: np.ndarray, cost: np.ndarray, ridge: float = 1.0, steps: int = 25) -> tuple[np.ndarray, float]:
    """Linear SVM with squared hinge loss, by Newton steps on the rows inside the margin."""
    x = np.hstack([x, np.ones((len(x), 1))]).astype(np.float64)
    w, keep = np.zeros(x.shape[1]), np.r_[np.full(x.shape[1] - 1, ridge), 1e-3]
    for _ in range(steps):
        inside = y * (x @ w) < 1
        a = x[inside] * cost[inside, None]
        new = np.linalg.solve(np.diag(keep) + x[inside].T @ a, a.T @ y[inside])
        if np.allclose(new, w, atol=1e-6):
            break
        w = new
    return w[:-1], float(w[-1])


def fit_words(positive: list[str], negative: list[str], landmarks: list[str]) -> Machine:
    """The SVM over Nystroem features, folded into one weight a triple."""
    values, vectors = np.linalg.eigh(kernel(landmarks, landmarks).astype(np.float64))
    good = values > 1e-4
    root = vectors[:, good] / np.sqrt(values[good])
    x = kernel(positive + negative, landmarks) @ root
    y = np.r_[np.ones(len(positive)), -np.ones(len(negative))]
    w, bias = support_vectors(x, y, np.r_[np.full(len(positive), 60.0 / max(1, len(positive))), np.full(len(negative), 60.0 / max(1, len(negative)))] * 20)
    alpha = root @ w
    word, triple, weight = triples(landmarks)
    return Machine(np.bincount(triple, weight * alpha[word], _CLASSES**3), bias)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.01, steps: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, deviation and weight of each feature, by Newton steps; the rarer label counts more, by the root of the odds."""
    known = ~np.isnan(x)
    count = np.maximum(1, known.sum(axis=0))
    mean = np.where(known, x, 0.0).sum(axis=0) / count
    spread = np.sqrt((np.where(known, x - mean, 0.0) ** 2).sum(axis=0) / count) + 1e-9
    z = np.hstack([np.where(known, (x - mean) / spread, 0.0), np.ones((len(x), 1))])
    w, cost = np.zeros(z.shape[1]), np.where(y > 0, math.sqrt((y == 0).sum() / max(1, (y > 0).sum())), 1.0)
    keep = ridge * np.r_[np.ones(len(w) - 1), 1e-4]
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -500, 500)))
        w -= np.linalg.solve((z * (cost * p * (1 - p))[:, None]).T @ z / len(y) + np.diag(keep), z.T @ (cost * (p - y)) / len(y) + keep * w)
    return mean, spread, w[:-1]


def _spread(items: Iterable[str], n: int) -> list[str]:
    """n items in the order of a fixed hash."""
    return sorted(items, key=lambda w: (zlib.crc32(w.encode("utf-8", "replace")), w))[:n]


def variants(word: str) -> list[str]:
    """The word with one letter doubled, or one strange letter put in: what the machine shall see through."""
    out = []
    for i in range(1, len(word)):
        out.append(word[:i] + word[i - 1] + word[i:])
        out.append(word[:i] + "abcdefghijklmnopqrstuvwxyz"[(7 * i + 11 * len(word)) % 26] + word[i:])
    return out if len(word) > 3 else []


def _apart(texts: list[set[str]]) -> list[set[str]]:
    """One word set of those that share their SIGNATURE words of smallest hash: near copies count once."""
    out: dict[tuple, set[str]] = {}
    for t in texts:
        out.setdefault(tuple(sorted(zlib.crc32(w.encode("utf-8", "replace")) for w in t)[:SIGNATURE]), t)
    return list(out.values())


def train(toxic: list[set[str]], clean: list[set[str]], rounds: int = 3) -> Machine:
    """From the word sets of labelled texts.  Without texts of both labels every text scores as clean does."""
    if not toxic or not clean:
        out = Machine(np.zeros(_CLASSES**3), -1.0)
        return out
    toxic, clean = _apart(toxic), _apart(clean)
    in_toxic, in_clean = Counter(w for t in toxic for w in t), Counter(w for t in clean for w in t)
    odds = {w: math.log((n + 0.5) / (len(toxic) + 1)) - math.log((in_clean[w] + 0.1) / (len(clean) + 1)) for w, n in in_toxic.items() if len(w) > 2}
    witnesses = Counter(max(t, key=lambda w: (odds.get(w, -9.0), w)) for t in toxic if t)
    positive = [w for w, n in witnesses.items() if n > 1 and in_clean[w] * 20 < in_toxic[w]] or list(witnesses)
    positive = list({*positive, *(w for w, n in in_toxic.items() if n >= SURE and not in_clean[w] and len(w) > 2)})
    pool, hard = list(in_clean), []
    machine = None
    for _ in range(rounds):
        negative = list({*_spread(pool, NEGATIVES), *hard})
        half = LANDMARKS // 2
        ranked = sorted(positive, key=lambda w: (-in_toxic[w], w))
        seen = [*positive, *(v for w in positive for v in variants(w) if v not in in_clean)]
        machine = fit_words(seen, negative, list(dict.fromkeys([*ranked[:half], *hard[: half // 2], *_spread(negative, LANDMARKS)]))[:LANDMARKS])
        machine.learn(in_toxic)
        machine.learn(pool)
        hard = sorted(pool, key=lambda w: (-machine.known[w], w))[:1500]
        found = Counter(max(t, key=lambda w: (machine.known[w], w)) for t in toxic if t)
        positive = list({*positive, *(w for w, n in found.items() if machine.known[w] > 0 and not in_clean[w])})
        positive += [w for w, n in in_toxic.items() if n > 1 and not in_clean[w] and machine.known[w] > 0.5 and w not in set(positive)]
    rows = np.array([machine.features(t) for t in [*toxic, *clean]])
    labels = np.r_[np.ones(len(toxic)), np.zeros(len(clean))]
    machine.text = logistic(rows, labels)
    if machine.text[2][-1] > 0:
        # Length explains mild words away; by itself it is no sign of toxicity.
        machine.text = logistic(np.hstack([rows[:, :TOP], np.zeros((len(rows), 1))]), labels)
    margins = sorted([(machine.margin(t), 1) for t in toxic] + [(machine.margin(t), 0) for t in clean], reverse=True)
    best, at, hits = -1.0, margins[0][0], 0
    for i, (m, label) in enumerate(margins):
        hits += label
        after = margins[i + 1][0] if i + 1 < len(margins) else m - 1.0
        f1 = 2 * hits / (i + 1 + len(toxic))
        if after < m and f1 > best:
            best, at = f1, (m + after) / 2
    machine.middle, machine.slope = at, 4.0
    machine.known = {}
    return machine


def in_training(doc_id: Column) -> Column:
    """Whether a labelled row may be learnt from: crc32 of the id as text, modulo 3, is not 1."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 != 1


def train_from(docs: DataFrame, labels: DataFrame, texts: int = TEXTS, id_col: str = "doc_id", text_col: str = "text") -> Machine:
    """Trains from at most ``texts`` labelled texts of each label, those with the smallest hash of their id."""
    known = labels.filter("toxic IN (0, 1) AND doc_id IS NOT NULL").filter(in_training(F.col("doc_id"))).groupBy(F.col("doc_id").alias("id")).agg(F.max("toxic").alias("toxic"))
    picked = []
    for label in (1, 0):
        picked.append(known.filter(F.col("toxic") == label).orderBy(F.xxhash64("id"), "id").limit(texts))
    chosen = picked[0].union(picked[1])
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("id")).select("id", "toxic", F.xxhash64("text").alias("same"), "text")
    sides: dict[int, dict[int, set[str]]] = {0: {}, 1: {}}
    once: dict[str, str] = {}
    for row in rows.toLocalIterator():
        # One string stands for a word in all texts.
        sides[row["toxic"]].setdefault(row["same"], {once.setdefault(w, w) for w in words(row["text"])})
    key = lambda side: [side[k] for k in sorted(side)]
    machine = train(key(sides[1]), key(sides[0]))
    del sides, once, key
    give_back()
    return machine


def scored(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, score, predicted.

    Null texts score as empty ones, which hold no toxic word; texts of any length are read whole; repeated rows and equal
    texts have equal scores; other columns play no part; an empty table gives no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast((machine.weights, machine.bias, machine.slope, machine.middle, machine.text))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = machine_of(shared.value)
        for batch in batches:
            scores = []
            for at in range(0, batch.num_rows, 200):
                found = [words(t) for t in batch.column(1).slice(at, 200).to_pylist()]
                own.learn({w for f in found for w in f})
                scores += [own.score(own.margin(f)) for f in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array([int(x >= TOXIC_FROM) for x in scores], pa.int32())], ["doc_id", "score", "predicted"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, score double, predicted int")


_machines: list[tuple[bytes, Machine]] = []


def machine_of(state: tuple) -> Machine:
    """A worker's machine, kept with what it knows from task to task."""
    mark = state[0].tobytes() + repr(state[1:4]).encode() + b"".join(x.tobytes() for x in state[4])
    if not _machines or _machines[0][0] != mark:
        machine = Machine(state[0], state[1])
        machine.slope, machine.middle, machine.text = state[2:]
        _machines[:] = [(mark, machine)]
    return _machines[0][1]


def keep_clean(docs: DataFrame, labels: DataFrame, training_docs: DataFrame | None = None) -> DataFrame:
    """docs without the rows that the machine calls toxic, all columns untouched; rows with a null id stay."""
    machine = train_from(docs if training_docs is None else training_docs, labels)
    lost = unused(docs.columns, "toxic_id")
    bad = scored(docs, machine).filter("predicted = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").alias(lost)).distinct()
    return docs.join(bad, docs["doc_id"] == bad[lost], "left_anti")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    out = scored(docs, train_from(docs, read(spark, sf_dir, "labels")))
    return out.select("doc_id", F.coalesce(~in_training(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted")
