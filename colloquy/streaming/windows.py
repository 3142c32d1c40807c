"""Counts of a stream by event time, with state, and what a stream reports about itself as a table."""

from __future__ import annotations

import threading
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from colloquy.operators.tables import last_of
from colloquy.streaming import folders


def count_windows(stream: DataFrame, at: str, kind: str, out: str, checkpoint: str, width: str = "1 day", late: str = "1 hour", slide: str | None = None, fold_every: int = 20) -> StreamingQuery:
    """Counts by event-time window and ``kind``, kept as state and written as they change.

    The watermark is the latest time seen by the batches before, less ``late``. A row
    is late, and left out, if all its windows end at or before the watermark; their
    state is dropped. Every other row counts however the stream is cut into batches. A
    restarted stream goes on with the state of its checkpoint, and a batch that runs
    again replaces what it wrote.
    """
    window = F.window(at, width, slide) if slide else F.window(at, width)
    counted = stream.withWatermark(at, late).groupBy(window.alias("w"), kind).agg(F.count("*").alias("n"))
    rows = counted.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), kind, "n")
    schema, keys = rows.schema, ["window_start", kind]

    def write(batch: DataFrame, number: int) -> None:
        folders.write_batch(batch, out, number)
        if (number + 1) % fold_every == 0:
            folders.fold(batch.sparkSession, out, schema, keys, number)

    return rows.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def window_counts(spark: SparkSession, out: str, stream: DataFrame, kind: str) -> DataFrame:
    """(window_start, window_end, kind, n) as ``count_windows`` left them; ``stream`` gives the types."""
    schema = stream.sparkSession.createDataFrame([], f"window_start timestamp, window_end timestamp, `{kind}` {dict(stream.dtypes)[kind]}, n long").schema
    return folders.newest(spark, out, schema, ["window_start", kind])


def closed(counts: DataFrame, watermark: str) -> DataFrame:
    """Windows that no later row can change, at a watermark as the progress table has it."""
    return counts.where(F.col("window_end") <= F.lit(watermark).cast("timestamp"))


PROGRESS = (
    "run_id string, name string, batch long, at string, rows_in long, rows_per_second double, duration_ms long, watermark string, state_rows long, state_rows_dropped long, ended boolean, error string"
)


class ProgressTable(StreamingQueryListener):
    """Writes a row for each batch of the session's streams to a table, ``every`` rows at a time and when a stream ends."""

    def __init__(self, spark: SparkSession, path: str, every: int = 20) -> None:
        self.spark, self.path, self.every = spark, path, every
        self.rows: list[tuple] = []
        self.open: set[str] = set()
        self.changed = threading.Condition()

    def onQueryStarted(self, event) -> None:
        with self.changed:
            self.open.add(str(event.runId))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        state = p.stateOperators
        dropped, kept = (sum(getattr(s, f) for s in state) for f in ("numRowsDroppedByWatermark", "numRowsTotal"))
        row = (str(p.runId), p.name, p.batchId, p.timestamp, p.numInputRows, p.processedRowsPerSecond, p.batchDuration, p.eventTime.get("watermark"), kept, dropped, False, None)
        with self.changed:
            self.rows.append(row)
            full = len(self.rows) >= self.every
        if full:
            self.flush()

    def onQueryTerminated(self, event) -> None:
        with self.changed:
            self.rows.append((str(event.runId), None, None, None, 0, None, None, None, None, 0, True, event.exception))
        self.flush()
        with self.changed:
            self.open.discard(str(event.runId))
            self.changed.notify_all()

    def flush(self) -> None:
        with self.changed:
            rows, self.rows = self.rows, []
        if rows:
            self.spark.createDataFrame(rows, PROGRESS).coalesce(1).write.mode("append").parquet(self.path)

    def wait(self, seconds: float = 60) -> bool:
        """Until every stream that began has ended and its rows are written."""
        with self.changed:
            return self.changed.wait_for(lambda: not self.open, seconds)


@contextmanager
def progress_table(spark: SparkSession, path: str, every: int = 20) -> Iterator[ProgressTable]:
    """Streams that begin and end inside report to the table at ``path``."""
    listener = ProgressTable(spark, path, every)
    spark.streams.addListener(listener)
    try:
        yield listener
        listener.wait()
    finally:
        spark.streams.removeListener(listener)
        listener.flush()


def read_progress(spark: SparkSession, path: str) -> DataFrame:
    """The rows of batches; a row that was reported twice counts once."""
    rows = spark.read.schema(PROGRESS).parquet(path).where("batch is not null")
    return last_of(rows, ["run_id", "batch"], "at")


def collection_progress(batches: DataFrame, expected: DataFrame) -> DataFrame:
    """For each stream (name) its rows so far, their share of the expected number and the seconds that the rest will take.

    ``expected`` has (name, expected). Without rows or speed there is no estimate.
    """
    done = batches.groupBy("name").agg(F.sum("rows_in").alias("rows_in"), F.count("*").alias("batches"), (F.sum("rows_in") / (F.sum("duration_ms") / 1000)).alias("_speed"))
    share = F.when(F.col("expected") > 0, F.least(F.col("rows_in") / F.col("expected"), F.lit(1.0)))
    rest = F.greatest(F.col("expected") - F.col("rows_in"), F.lit(0))
    return done.join(expected, "name").select("name", "rows_in", "batches", share.alias("progress_percentage"), F.try_divide(rest, F.col("_speed")).alias("eta_seconds"))


def speed_by_batch(batches: DataFrame) -> DataFrame:
    """Each batch with the rows of its run up to it."""
    return batches.withColumn("rows_so_far", F.sum("rows_in").over(W.partitionBy("run_id").orderBy("batch")))
