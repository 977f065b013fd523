"""Fill-in-middle transformation, with a text's units as bits of one big integer.

A unit is a run of ASCII letters or any other single code point.  ``bytes.translate`` makes the class mask of a text, one
bit a code point; a unit starts wherever a letter does not follow a letter, so the starts are ``all & ~(mask & mask << 1)``:
a few operations on whole machine words for a text of any length.  ``bit_count`` gives the number of units, and the place
of the k-th start is found by halving the integer, counting the lower half, and going on in the half that holds it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.common import read, ship

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 texts so many stay plain, and of 100 others so many put the suffix first.
PLAIN, SPM = 10, 20
SEED = 1
#: A batch's texts come back in groups of about so many code points.
GROUP_POINTS = 4_000_000

#: One byte a code point: 1 for an ASCII letter, else 0, as binary figures.
_LETTERS = bytes(49 if chr(b).isascii() and chr(b).isalpha() else 48 for b in range(256))


def starts(text: str) -> int:
    """Bit i is set where a unit starts at code point i."""
    if not text:
        return 0
    # What isn't Latin-1 becomes a question mark: one byte a code point, and no letter.  The first code point is the lowest bit.
    mask = int(text.encode("latin-1", "replace")[::-1].translate(_LETTERS), 2)
    return ((1 << len(text)) - 1) & ~(mask & mask << 1)


def place(bits: int, width: int, k: int) -> int:
    """Index of the k-th set bit, from 0; width where there are no more than k."""
    if k >= bits.bit_count():
        return width
    at = 0
    while width > 1:
        half = width >> 1
        low = bits & ((1 << half) - 1)
        below = low.bit_count()
        if k < below:
            bits, width = low, half
        else:
            bits, k, at, width = bits >> half, k - below, at + half, width - half
    return at


def draws(doc_id: int | None, seed: int = SEED) -> list[int]:
    """Four numbers of 32 bits from seed and id; no id counts as an empty one."""
    listed = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(listed[k : k + 8], 16) for k in (0, 8, 16, 24)]


def transform(text: str, doc_id: int | None, plain: int = PLAIN, spm: int = SPM, seed: int = SEED) -> tuple[int, str, int | None, int | None, str]:
    """(n, form, prefix_chars, middle_chars, output)."""
    bits = starts(text)
    n = bits.bit_count()
    h = draws(doc_id, seed)
    if not text or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)) or h[2] % 100 >= 100 - plain:
        return n, "plain", None, None, text
    first, second = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    a, b = place(bits, len(text), first), place(bits, len(text), second)
    before, within, after = text[:a], text[a:b], text[b:]
    if h[3] % 100 < spm:
        return n, "spm", a, b - a, f"{SUFFIX}{after}{PREFIX}{before}{MIDDLE}{within}"
    return n, "psm", a, b - a, f"{PREFIX}{before}{SUFFIX}{after}{MIDDLE}{within}"


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", plain: int = PLAIN, spm: int = SPM, seed: int = SEED) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output: one row a document, in Arrow batches.

    Null and empty texts, texts that hold one of the marks, and plain of 100 others stay as they are, with null sizes.  A
    null id draws as an empty one; rows that repeat an id and text give the same row again; texts may be of any length;
    other columns, whatever their names, play no part; an empty table gives no rows.
    """
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    fields = [("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows, first, points = batch.column(0), [], 0, 0
            for k, doc_id in enumerate(ids.to_pylist()):
                text = batch.column(1)[k].as_py() or ""
                rows.append(transform(text, doc_id, plain, spm, seed))
                points += len(text)
                if points >= GROUP_POINTS or k + 1 == batch.num_rows:
                    columns = [pa.array([r[i] for r in rows], type=t) for i, (_, t) in enumerate(fields)]
                    yield pa.RecordBatch.from_arrays([ids.slice(first, len(rows)), *columns], ["doc_id", *(name for name, _ in fields)])
                    rows, first, points = [], k + 1, 0

    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(run, f"doc_id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that an output of this form was made of.  A mark is never made where two parts meet, so cutting at the marks is exact."""
    part = lambda mark, upto: F.substring_index(F.substring_index(output, mark, -1), upto, 1)
    psm = F.concat(part(PREFIX, SUFFIX), F.substring_index(output, MIDDLE, -1), part(SUFFIX, MIDDLE))
    spm = F.concat(part(PREFIX, MIDDLE), F.substring_index(output, MIDDLE, -1), part(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(read(spark, sf_dir, "documents"))
    back = restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"), F.sha2(back.cast("binary"), 256).alias("restored_sha256"))
