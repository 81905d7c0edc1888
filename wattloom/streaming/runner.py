"""Run a stream over everything available and hand back its result as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wattloom.session import scratch_path


def run_available(stream: DataFrame, name: str, mode: str = "append", keys: list[str] | None = None) -> DataFrame:
    """Process all available input and read the sink back.

    Each batch overwrites its own folder, so a repeated batch leaves no duplicates. complete keeps
    the last batch, update the newest row per key, append everything.
    """
    out = scratch_path(stream.sparkSession, name)
    checkpoint = scratch_path(stream.sparkSession, f"{name}-checkpoint")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    run = (
        stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    run.awaitTermination()
    found = stream.sparkSession.read.option("basePath", out).schema(
        stream.schema.add("batch", "long")
    ).parquet(out)
    if mode == "complete":
        return found.where(F.col("batch") == found.agg(F.max("batch")).scalar()).drop("batch")
    if mode == "update":
        newest = W.partitionBy(*keys).orderBy(F.col("batch").desc())
        return found.withColumn("__r", F.row_number().over(newest)).where("__r = 1").drop("__r", "batch")
    return found.drop("batch")
