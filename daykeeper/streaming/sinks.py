"""Running a stream to a table in a shared folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daykeeper.session import scratch_path


def run_available(stream: DataFrame, write: Callable[[DataFrame, int], None], mode: str, checkpoint: str) -> None:
    """Processes what the source has now, one ``write(batch, batch_id)`` per micro-batch."""
    query = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
    )
    query.awaitTermination()


def append_to_table(stream: DataFrame, name: str) -> DataFrame:
    """Runs an append-mode stream into a fresh Parquet table and reads it back."""
    spark = stream.sparkSession
    path, checkpoint = scratch_path(spark, name), scratch_path(spark, f"{name}-state")
    query = (
        stream.writeStream.outputMode("append")
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def upsert_to_table(stream: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """Runs an update-mode stream; the result is the newest row of each key.

    A replayed micro-batch overwrites its own folder, so a restart repeats no row.
    """
    spark = stream.sparkSession
    path, checkpoint = scratch_path(spark, name), scratch_path(spark, f"{name}-state")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    run_available(stream, write, "update", checkpoint)
    values = [column for column in stream.columns if column not in keys]
    rows = spark.read.option("basePath", path).parquet(path)
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), F.col("batch")).alias("_row"))
    return newest.select(*keys, "_row.*")
