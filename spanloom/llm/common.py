"""Helpers that the operators of this subpackage share.

Lineage is cut with reliable checkpoints only.  Their folder is the one that the session names in
``spark.checkpoint.dir``; a folder of our own is used only where that setting is absent and Spark runs on one machine
(tests).
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the contracts define it: blank and U+0009 to U+000D.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.match(r"local(\[|$)", context.master or ""):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spanloom-"))


def saved(df: DataFrame) -> DataFrame:
    """df, written to the shared checkpoint folder; survives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package where they don't find it themselves: its sources go out once a context."""
    context = spark.sparkContext
    if getattr(context, "_spanloom_shipped", False):
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="spanloom-"), "spanloom_sources.zip")
    with zipfile.ZipFile(path, "w") as z:
        for at, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    z.write(f"{at}/{name}", os.path.relpath(f"{at}/{name}", os.path.dirname(top)))
    context.addPyFile(path)
    context._spanloom_shipped = True


def give_back() -> None:
    """Returns what a finished fit has freed to the system, where the C library can: the driver's process lives on."""
    import ctypes
    import gc

    gc.collect()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def lower_ascii(column: Column) -> Column:
    return F.translate(column, UPPER, LOWER)


def unused(columns: list[str], stem: str) -> str:
    """A column name from stem that differs from all given ones, whatever their letters' case."""
    taken, name = {c.lower() for c in columns}, stem
    while name.lower() in taken:
        name += "_"
    return name


def written(df: DataFrame) -> DataFrame:
    """df as Parquet in the shared checkpoint folder, read again: columnar and compressed, for large working tables."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
