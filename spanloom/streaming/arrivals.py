"""Documents that arrive as files: the batch steps for each micro-batch, results appended as Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from spanloom.plans import steps as plan


def start(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, steps: list[dict]) -> StreamingQuery:
    """Runs the steps on every arriving file's rows; a batch that is repeated after a failure overwrites its own output."""

    def each(batch: DataFrame, number: int) -> None:
        plan.run(batch, steps)["found"].write.mode("overwrite").parquet(f"{target}/batch={number}")

    rows = spark.readStream.schema(schema).parquet(source)
    return rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
