"""Ingest that looks only into files which may hold a batch's keys.

The stored table has one folder for each batch, its files sorted into ranges of
keys, and an index with a row for each file: its least and greatest key and a Bloom
filter of its keys. A batch first meets the index: files whose range has none of its
keys, or whose filter knows none of them, are not opened. What is left is compared
exactly, so the index decides about work, never about rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from colloquy.operators.tables import first_of
from colloquy.streaming import folders

#: Bits of a filter for each key, and how many of them a key sets: one in 20,000 foreign keys passes.
BITS, PROBES = 24, 11
#: Keys in a file at most, about: their filter is made by one task.
FILE_KEYS = 1 << 18
#: Ranges into which a batch's keys are cut for the first look; their number bounds what is broadcast.
CELLS = 64
#: A batch of more keys than this is not held against filters, whose every answer would be "perhaps".
PROBED_KEYS = 1 << 20


def _places(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The bits of each hash, one row for each probe; ``bits`` is a power of two."""
    h = hashes.view(np.uint64)
    step = (h >> np.uint64(17) | h << np.uint64(47)) | np.uint64(1)
    with np.errstate(over="ignore"):
        return np.stack([(h + np.uint64(k) * step) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - int(math.log2(bits))) for k in range(PROBES)])


def make_filter(hashes: np.ndarray) -> bytes:
    bits = 1 << max(6, (len(hashes) * BITS - 1).bit_length())
    held = np.zeros(bits, bool)
    held[_places(hashes, bits).ravel()] = True
    return np.packbits(held).tobytes()


def may_hold(made: bytes, hashes: np.ndarray) -> np.ndarray:
    held = np.unpackbits(np.frombuffer(made, np.uint8)).view(bool)
    return held[_places(hashes, len(held))].all(0)


def index_of(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(file, least, greatest, n, filter) of rows read from files; a file is as large as its writer made it, so its keys fit a task."""
    key = F.struct(*keys)
    of = rows.select(F.col("_metadata.file_path").alias("file"), key.alias("key"), F.xxhash64(*keys).alias("hash"))
    ranges = of.groupBy("file").agg(F.min("key").alias("least"), F.max("key").alias("greatest"), F.count("*").alias("n"))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"file": [pdf["file"].iloc[0]], "filter": [make_filter(pdf["hash"].to_numpy(np.int64))]})

    filters = of.select("file", "hash").groupBy("file").applyInPandas(build, "file string, filter binary")
    return ranges.join(filters, "file")


def candidate_files(index: DataFrame, batch: DataFrame, keys: list[str], cells: int = CELLS, probed_keys: int = PROBED_KEYS) -> list[str]:
    """Files that may hold a key of ``batch`` (one row for each key, no nulls)."""
    parts = batch.select(F.struct(*keys).alias("key")).repartitionByRange(cells, "key").withColumn("cell", F.spark_partition_id())
    spans = parts.groupBy("cell").agg(F.min("key").alias("low"), F.max("key").alias("high"), F.count("*").alias("n")).collect()  # at most ``cells`` rows
    if not spans:
        return []
    kind = index.schema["least"].dataType
    schema = T.StructType([T.StructField("low", kind), T.StructField("high", kind)])
    met = batch.sparkSession.createDataFrame([(s.low, s.high) for s in spans], schema)
    near = index.join(F.broadcast(met), (F.col("least") <= F.col("high")) & (F.col("greatest") >= F.col("low")), "left_semi")
    if sum(s.n for s in spans) > probed_keys:
        return sorted(r.file for r in near.select("file").collect())
    hashes = batch.sparkSession.sparkContext.broadcast(np.array([r.h for r in batch.select(F.xxhash64(*keys).alias("h")).collect()], np.int64))  # at most ``probed_keys`` numbers

    def probe(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pdf.loc[[bool(may_hold(f, hashes.value).any()) for f in pdf["filter"]], ["file"]]

    return sorted(r.file for r in near.select("file", "filter").mapInPandas(probe, "file string").collect())


def _index(spark: SparkSession, table: str, rows: DataFrame, keys: list[str], but: str | None = None) -> DataFrame:
    key = T.StructType([rows.schema[k] for k in keys])
    schema = T.StructType([T.StructField("file", T.StringType()), T.StructField("least", key), T.StructField("greatest", key), T.StructField("n", T.LongType()), T.StructField("filter", T.BinaryType())])
    paths = [f"{table}/index/{n}" for n in folders.written(spark, f"{table}/index") if n != but]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def add_batch(rows: DataFrame, number: int, table: str, keys: list[str], order: str, files: int = 8, stream: str = "") -> None:
    """Add the rows of batch ``number`` whose key is not in the table; of equal keys the first by ``order``. Rows without a key are left out.

    A batch (of the ``stream``, for a table may have several) that runs again sees the
    table without what it wrote before, and replaces that.
    """
    spark, name = rows.sparkSession, f"{stream}batch-{number}"
    given = rows.dropna(subset=keys)
    fresh = first_of(given.withColumn("_order", F.col(order)), keys, "_order").drop("_order").persist()
    try:
        index = _index(spark, table, rows, keys, name)
        opened = candidate_files(index, fresh.select(*keys), keys)
        new = fresh.join(spark.read.schema(rows.schema).parquet(*opened).select(*keys), keys, "left_anti") if opened else fresh
        parts = max(files, math.ceil(fresh.count() / FILE_KEYS))  # a large batch has more files, not larger ones
        new.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).write.mode("overwrite").parquet(f"{table}/data/{name}")
        written = spark.read.schema(rows.schema).parquet(f"{table}/data/{name}")
        index_of(written, keys).write.mode("overwrite").parquet(f"{table}/index/{name}")
        log = spark.createDataFrame([(stream, number, index.count(), len(opened))], "stream string, batch long, files long, files_opened long")
        counts = rows.agg(F.count("*").alias("rows_in")).join(written.agg(F.count("*").alias("rows_added")))  # one row by one row
        log.join(counts).coalesce(1).write.mode("overwrite").parquet(f"{table}/log/{name}")
    finally:
        fresh.unpersist()


def ingest(stream: DataFrame, table: str, checkpoint: str, keys: list[str], order: str, at: str | None = None, late: str | None = None, files: int = 8) -> StreamingQuery:
    """Append the rows of ``stream`` whose key is not in ``table`` yet.

    The checkpoint names the stream: its batches go on where it stopped, and a stream
    with another checkpoint adds batches of its own. With ``late`` the stream also drops
    rows that repeat a key within that time before they reach the table; Spark then
    leaves out rows that come later than the watermark on ``at``.
    """
    once = stream.withWatermark(at, late).dropDuplicatesWithinWatermark(keys) if at and late else stream
    name = hashlib.md5(checkpoint.encode()).hexdigest()[:12] + "-"
    add = lambda batch, number: add_batch(batch, number, table, keys, order, files, name)
    return once.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stored(spark: SparkSession, table: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{table}/data")


def ingest_log(spark: SparkSession, table: str) -> DataFrame:
    """(stream, batch, files, files_opened, rows_in, rows_added) of every batch."""
    return spark.read.option("recursiveFileLookup", True).parquet(f"{table}/log")
