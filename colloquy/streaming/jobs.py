"""Streams of files, and coding batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def file_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def code_stream(stream: DataFrame, code: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, review: Callable[[DataFrame], DataFrame] | None = None, reviews: str | None = None) -> StreamingQuery:
    """Code posts as they come; the checkpoint remembers what is done, and each batch has a folder of its own, so a retry replaces it.

    A batch is what is saved at once: ``file_stream`` bounds its files. With
    ``review`` each batch also leaves the rows that a person should look at in
    ``reviews``, taken from what was saved.
    """

    def write(batch: DataFrame, number: int) -> None:
        code(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")
        if review is not None:
            review(batch.sparkSession.read.parquet(f"{out}/batch={number}")).write.mode("overwrite").parquet(f"{reviews}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
