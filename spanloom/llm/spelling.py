"""Spelling variants: words one edit apart, by an even-partition pigeonhole join.

A word of length l is cut evenly into two segments.  One inserted, deleted or replaced character leaves one of the two
whole, so of two words one edit apart the longer one (or either, if they are of one length) has the other's first segment
at its start or its second segment at its end, shifted by the difference in length.  Words are indexed by their two
segments; each word probes the segments of its own length and of words one shorter; candidates are verified and counted
once.

A segment that very many words share (a frequent prefix) would be compared with all its words.  Where a bucket asks for
more than ``PAIRS`` comparisons, the same principle cuts the part that is still open in two again, and so on until the
bucket is small or one open character is left, which bounds it by the square of the alphabet.  No candidate is dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.common import lower_ascii, read, saved

LETTERS = r"[A-Za-zÀ-ÿ]"
LEAST_CHARS, LEAST_COUNT = 6, 5
#: A word's form has at least so many times its occurrences.
TIMES = 5
#: One run in so many loses a character, by the checksum of its document's id and itself; 0: none does.
EVERY = 199
#: Comparisons that a bucket may ask for before it is cut further.
PAIRS = 4096


def counted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int = EVERY, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): the words of all texts with at least so many characters and occurrences, counted before they are shuffled.

    Words are maximal runs of letters up to U+00FF, lower-cased from A to Z.  If every divides the unsigned crc32 of
    ``<id>:<run>``, the character at that checksum modulo the run's length goes.  Null texts have no words; a null id counts
    as an empty one.
    """
    # Shorter runs never count: a character may go, none is added.
    found = F.regexp_extract_all(F.col(text_col), F.lit(LETTERS + f"{{{least_chars},}}"), F.lit(0))
    runs = docs.select(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":")).alias("k"), F.explode(found).alias("run"))
    rows = runs.select("k", lower_ascii(F.col("run")).alias("run"))
    word = F.col("run")
    if every:
        rows = rows.select("run", F.crc32(F.concat("k", "run").cast("binary")).alias("h"))
        at = (F.col("h") % F.length("run")).cast("int")
        word = F.when(F.col("h") % every == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))).otherwise(F.col("run"))
    words = rows.select(word.alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return words.filter((F.length("word") >= least_chars) & (F.col("n") >= least_count))


def _key(rows: DataFrame) -> DataFrame:
    """rows with key: the length l of the indexed word and its first a and last b characters."""
    size = F.length("word")
    head, tail = F.substring("word", F.lit(1), F.col("a")), F.substring("word", size - F.col("b") + 1, F.col("b"))
    return rows.withColumn("key", F.xxhash64("l", "a", "b", head, tail))


def _halves(rows: DataFrame) -> DataFrame:
    """Each row twice: the open part's first half known too, or its second half."""
    half = F.floor((F.col("l") - F.col("a") - F.col("b")) / 2).cast("int")
    first = F.struct((F.col("a") + half).alias("a"), F.col("b").alias("b"))
    second = F.struct(F.col("a").alias("a"), (F.col("l") - F.col("a") - half).alias("b"))
    return _key(rows.withColumn("x", F.explode(F.array(first, second))).withColumn("a", F.col("x.a")).withColumn("b", F.col("x.b")).drop("x"))


def one_edit(a: Column, b: Column) -> Column:
    """Whether two strings differ by exactly one inserted, deleted or replaced character."""
    return F.levenshtein(a, b, 1) == 1


def near_words(words: DataFrame, pairs: int = PAIRS) -> DataFrame:
    """(word, n, near, near_n): every pair of the distinct words (word, n) that are one edit apart, in both orders, once each."""
    own = words.select("word", "n", F.length("word").alias("size"))
    none = F.lit(0)
    indexed = own.select("word", "n", F.col("size").alias("l"), none.alias("a"), none.alias("b"), F.lit(True).alias("index"))
    probing = own.select("word", "n", F.explode(F.array("size", F.col("size") - 1)).alias("l"), none.alias("a"), none.alias("b"), F.lit(False).alias("index")).filter("l > 0")
    rows, found = saved(_halves(indexed.unionByName(probing))), None
    while True:
        sizes = rows.groupBy("key").agg(F.count_if("index").alias("i"), F.count_if(~F.col("index")).alias("p"), F.max(F.col("l") - F.col("a") - F.col("b")).alias("open"))
        # An indexed word probes its own bucket: one probe is the word itself.
        sizes = saved(sizes.filter("i > 0 AND p > 1"))
        hot = (F.col("i") * F.col("p") > pairs) & (F.col("open") > 1)
        small = rows.join(sizes.filter(~hot).select("key"), "key", "left_semi")
        x = small.filter("index").select("key", "word", "n")
        y = small.filter("NOT index").select("key", F.col("word").alias("near"), F.col("n").alias("near_n"))
        # Of two words of one length each finds the other; one order is enough.
        once = (F.length("word") != F.length("near")) | (F.col("word") < F.col("near"))
        links = x.join(y, "key").filter(once & one_edit(F.col("word"), F.col("near"))).select("word", "n", "near", "near_n")
        found = links if found is None else found.union(links)
        if sizes.filter(hot).isEmpty():
            break
        rows = saved(_halves(rows.join(sizes.filter(hot).select("key"), "key", "left_semi").drop("key")))
    found = saved(found.distinct())
    return found.union(found.select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): forms followed to the last, twice as far in each round.  A form occurs at least ``TIMES`` times as often, so rounds are few."""
    reach = saved(forms.select("word", F.col("form").alias("root")))
    while True:
        step = reach.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = saved(reach.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        reach = further.select("word", "root")
        if further.filter("moved").isEmpty():
            return reach


def variants(words: DataFrame, times: int = TIMES, pairs: int = PAIRS) -> DataFrame:
    """word, n, n_near, form, form_n, root for distinct words with their counts.

    form is the near word of the largest n (of equal ones the first in code-point order) if that is at least times the
    word's, else null; root is where following forms ends, the word itself if it has none.
    """
    words = saved(words)
    near = near_words(words, pairs).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("best"))
    rows = saved(words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(-F.col("best.less") >= times * F.col("n"), F.col("best")).alias("best")))
    rows = rows.select("word", "n", "n_near", F.col("best.near").alias("form"), (-F.col("best.less")).alias("form_n"))
    last = roots(rows.filter("form IS NOT NULL"))
    return rows.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int = EVERY, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT, times: int = TIMES, pairs: int = PAIRS) -> DataFrame:
    """word, form, root, n, n_near, form_n for the words of all documents.

    Null and empty texts have no words; repeated rows count again; runs may be of any length; ties of n go to the first word
    in code-point order; other columns, whatever their names, play no part; an empty table gives no rows.
    """
    return variants(counted(docs, id_col, text_col, every, least_chars, least_count), times, pairs)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(read(spark, sf_dir, "documents"))
