"""Token ids in ORC files.

Texts are dealt into ranges of doc_id and sorted, then encoded and written in
that order: stripes with run-length encoded integers, row indexes and a Bloom
filter on doc_id, so that readers take stripes in parallel and skip those that
cannot hold the documents they ask for.

Edge cases: a null text counts as empty and holds only the end id, null doc_ids
come first, rows with one doc_id are ordered by text, rows repeated keep a place
each, extra columns are ignored, an empty table gives files without rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colloquy.llm.encoding import encoder, vocabulary
from colloquy.llm.storage import shared_path

VOCABULARY = "byte_bpe_50k.json"
END = 0
SLICE = 256
#: Writers hold a stripe in memory, readers take one at a time.
STRIPE_BYTES = 16 << 20


def write_tokens(docs: DataFrame, path: str | None = None, vocabulary_path: str | None = None, stripe_bytes: int = STRIPE_BYTES) -> str:
    """Write doc_id, shard, place, n_tokens, ids; returns the path."""
    path = path or shared_path(docs.sparkSession, "tokens")
    vocabulary_path = vocabulary_path or vocabulary(VOCABULARY)
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, shard, place = encoder(vocabulary_path, False), TaskContext.get().partitionId(), 0
        end = np.array([END], "<u4").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                coded = [ids + end for ids in encode([t or "" for t in part.column(1).to_pylist()])]
                sizes = np.fromiter(map(len, coded), np.int64, len(coded)) // 4
                offsets = np.zeros(len(coded) + 1, np.int32)
                np.cumsum(sizes, out=offsets[1:])
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(coded), "<i4")))
                places = np.arange(place, place + len(coded))
                place += len(coded)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.full(len(coded), shard, np.int32)), pa.array(places), pa.array(sizes), ids], ["doc_id", "shard", "place", "n_tokens", "ids"])

    # The beginning of the text deals out rows that share a doc_id, or have none.
    by_id = F.col("doc_id").asc_nulls_first()
    ordered = docs.select("doc_id", "text").repartitionByRange(by_id, F.substring("text", 1, 32).asc_nulls_first()).sortWithinPartitions(by_id, F.col("text").asc_nulls_first())
    coded = ordered.mapInArrow(run, f"doc_id {kind}, shard int, place long, n_tokens long, ids array<int>")
    options = {"compression": "snappy", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.create.index": "true", "orc.stripe.size": str(stripe_bytes), "orc.row.index.stride": "1000"}
    coded.write.options(**options).orc(path)
    return path


def read_digest(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files at ``path``."""
    files = spark.read.orc(path)
    kind = dict(files.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(3)
            offsets = ids.offsets.to_numpy()
            flat = np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), "<i4").view(np.uint8)
            sums = [zlib.crc32(flat[4 * a : 4 * b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            sizes = pa.array(np.diff(offsets).astype(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], sizes, pa.array(sums, pa.int64())], ["doc_id", "shard", "place", "n_tokens", "ids_crc32"])

    rows = files.select("doc_id", "shard", "place", "ids").mapInArrow(run, f"doc_id {kind}, shard int, place long, n_tokens long, ids_crc32 long")
    # One row for each file: the ids of all files before it.
    totals = files.groupBy("shard").agg(F.sum("n_tokens").alias("ids"))
    ahead = totals.select("shard", F.coalesce(F.sum("ids").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    inside = W.partitionBy("shard").orderBy("place").rowsBetween(W.unboundedPreceding, -1)
    placed = rows.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return placed.join(ahead, "shard").select("doc_id", (F.col("ahead") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def read_documents(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """doc_id, n_tokens, ids of the documents asked for, by the metadata of the files: ranges of doc_id skip whole files,
    stripes and groups of rows, and Bloom filters those in range that do not hold an id. ``doc_ids`` is a stated list."""
    files = spark.read.orc(path)
    return files.where(F.col("doc_id").isin(doc_ids)).select("doc_id", "n_tokens", "ids")
