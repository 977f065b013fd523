"""What every machine must see: the package's sources for Python workers, and working tables in the shared checkpoint folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Sends the sources out, once a context."""
    context = spark.sparkContext
    if getattr(context, "_spanloom_shipped", False):
        return
    top = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="spanloom-"), "spanloom_sources.zip")
    with zipfile.ZipFile(path, "w") as z:
        for at, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    z.write(f"{at}/{name}", os.path.relpath(f"{at}/{name}", os.path.dirname(top)))
    context.addPyFile(path)
    context._spanloom_shipped = True


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the session names in ``spark.checkpoint.dir``; one of our own only where that is unset and Spark runs on one machine."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.match(r"local(\[|$)", context.master or ""):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spanloom-"))
    return context.getCheckpointDir()


def saved(df: DataFrame) -> DataFrame:
    """df, written to the shared checkpoint folder; survives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """df as Parquet in the shared checkpoint folder, read again: columnar and compressed, for tables that are read several times."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def apart(rows: DataFrame) -> DataFrame:
    """rows that came out of texts or lists, for a join: they are sorted beside the other side, never sent whole to the driver and all machines.

    Spark's guess at their size knows the file they came from, not how many rows a text or a list gives, so it would send them.
    """
    return rows.hint("merge")


#: Rows that a task sorts for windows over documents, about.
ROWS_A_TASK = 200_000


def dealt(rows: DataFrame, total: int, *keys: str) -> DataFrame:
    """rows, of which there are total, dealt by the keys to as many tasks as they need: what a task holds doesn't grow with the input."""
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, total // ROWS_A_TASK), *keys)


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """rows dealt by the keys to several tasks a core, for joins that make much of few bytes: by bytes alone Spark would put them into one or two tasks."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, *keys)
