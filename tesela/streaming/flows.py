"""The standard tables over files that arrive one by one; the batch expressions are reused as they are."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesela.operators import flows


def file_stream(spark: SparkSession, folder: str, columns: tuple[str, ...], files_per_batch: int = 16) -> DataFrame:
    """Raw rows of pipe-separated files that appear in folder; all have the given header."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    reader = spark.readStream.schema(schema).options(sep="|", header="true", escape='"')
    raw = reader.option("maxFilesPerTrigger", files_per_batch).csv(folder)
    return raw.withColumn(flows.FILE, F.col("_metadata.file_path"))


def write_by_date(
    raw: DataFrame, transform: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, available_now: bool = True
):
    """Start a query that transforms each micro-batch and appends it to a Parquet folder by date.

    A file is whole within one micro-batch, so facts and sums of a file are those of the batch tables.
    A batch that is repeated after a failure replaces its own folder.
    """

    def put(batch: DataFrame, number: int) -> None:
        transform(batch).write.mode("overwrite").partitionBy("date").parquet(f"{path}/batch={number}")

    writer = raw.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
