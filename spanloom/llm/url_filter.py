"""URL filters: explicit host and path rules first, then logistic regression on hashed character n-grams of host and path.

The regression is trained on the driver from the small labelled table below; its weights (a fixed number of buckets)
travel with the plan, and URLs are scored in Arrow batches.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.common import lower_ascii, read, ship

#: Hash buckets of the regression, n-gram lengths, and the probability from which a URL is blocked.
BUCKETS, GRAMS, BLOCK_FROM = 1 << 14, (3, 4, 5), 0.5

# The rules of the contract (verdict, host, path).
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)

# Words of the labelled table's sites, by kind, and what their pages are called.  They are common words of
# their kind; no site is taken from any data.
_BAD_WORDS = (
    "casino poker slots jackpot roulette blackjack betting bets bookie lottery bingo wager pills pharmacy viagra meds steroids slimming diet "
    "adult porn xxx sex cams escort hookup nude payday loans replica fakes crack warez torrent keygen spam links backlinks adserver ads "
    "tracker popunder clicks banner phishing giveaway prize win bonus cheap free hot live best"
).split()
_GOOD_WORDS = (
    "library museum university school college hospital theatre railway weather news radio garden travel history science music cooking "
    "recipes books nature birds astronomy language grammar chess painting gallery council city village farm forest river mountain winter "
    "software manual archive journal research health family kitchen bicycle camera photo poetry market bakery coffee design "
    "letters stories sports football orchestra church castle island harbour bridge"
).split()
_SUBDOMAINS, _ENDS = ("", "www.", "m.", "blog."), (".test", ".example", ".invalid", ".localhost")
_BAD_PAGES, _GOOD_PAGES = ("/", "/offer", "/play", "/click", "/buy", "/join"), ("/", "/about", "/contact", "/articles", "/events", "/archive")


def labelled_urls() -> list[tuple[str, str, int]]:
    """(host, path, 1 if bad): sites of two words of one kind, joined or hyphenated, by rule; paths of either kind, and neutral ones in several languages."""
    out = []
    for label, words, pages in ((1, _BAD_WORDS, _BAD_PAGES), (0, _GOOD_WORDS, _GOOD_PAGES)):
        for i, word in enumerate(words):
            for step in (5, 13, 29, 0):
                chance = zlib.crc32(f"{word} {step}".encode())
                pick = lambda listed, turn: listed[(chance >> turn) % len(listed)]  # noqa: B023, E731
                site = (word + pick(("-", "-", ""), 3) + words[(i + step) % len(words)]) if step else word
                path = pick(pages, 9) if step == 5 else f"/{pick(('en', 'de', 'fr', 'es'), 12)}/{chance % 5000}"
                out.append((pick(_SUBDOMAINS, 15) + site + pick(_ENDS, 18), path, label))
    return out


def features(host: str, path: str) -> np.ndarray:
    """Buckets of the n-grams of ^host$ and of ^path$, digits as one class so that page numbers say nothing."""
    out = []
    for side, text in (("h", host), ("p", path)):
        text = "^" + "".join("0" if c.isdigit() else c for c in text) + "$"
        out += [zlib.crc32((side + text[i : i + n]).encode()) % BUCKETS for n in GRAMS for i in range(len(text) - n + 1)]
    return np.unique(np.array(out, dtype=np.int64))


@lru_cache(maxsize=1)
def model() -> tuple[np.ndarray, float]:
    return fitted(labelled_urls())


def fitted(rows: list[tuple[str, str, int]]) -> tuple[np.ndarray, float]:
    """Weights and bias: full-batch gradient steps with a ridge penalty from zero, so the fit has no chance in it."""
    x = np.zeros((len(rows), BUCKETS))
    for i, (host, path, _) in enumerate(rows):
        f = features(host, path)
        x[i, f] = 1 / np.sqrt(max(1, len(f)))
    y, w, b = np.array([r[2] for r in rows], dtype=float), np.zeros(BUCKETS), 0.0
    for _ in range(400):
        g = 1 / (1 + np.exp(-(x @ w + b))) - y
        w -= 2.0 * (x.T @ g / len(y) + 1e-4 * w)
        b -= 0.2 * g.mean()
    return w, float(b)


def score(host: str, path: str, weights: np.ndarray, bias: float) -> float:
    f = features(host, path)
    return float(1 / (1 + np.exp(-(weights[f].sum() / np.sqrt(max(1, len(f))) + bias))))


def host_of(url: Column) -> Column:
    return lower_ascii(F.coalesce(F.nullif(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as (rule, verdict); null where none does."""
    out = None
    for verdict, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        found = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, found) if out is None else out.when(fits, found)
    return out


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """One row per input row: page_id, host, path, rule, verdict, score.

    A null url, or one without ``://``, has empty host and path and is judged by the regression like any other (its score
    is that of two empty strings).  score is null where a rule decides, which Python then never sees.  Of rules that are
    equally long the first listed counts.  Urls may be of any length; other columns play no part; repeated rows give a row
    each; an empty table gives none.
    """
    weights, bias = model()
    ship(pages.sparkSession)

    @F.pandas_udf("double")
    def scored(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for hosts, paths in batches:
            yield pd.Series([None if h is None else score(h, p, weights, bias) for h, p in zip(hosts, paths)], dtype=float)

    url = F.col(url_col)
    rows = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    rows = rows.withColumn("found", rule_of(F.col("host"), F.col("path"), rules))
    open_ = lambda c: F.when(F.col("found").isNull(), F.col(c))
    rows = rows.withColumn("score", scored(open_("host"), open_("path")))
    by_model = F.when(F.col("score") >= BLOCK_FROM, F.lit("block")).otherwise(F.lit("allow"))
    return rows.select("page_id", "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.verdict", by_model).alias("verdict"), "score")


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "pages"))
