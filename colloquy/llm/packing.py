"""Packing documents into token sequences.

A document longer than a sequence is cut into full sequences and a rest. A full
sequence needs no search and gets a number of its own. The rests, at most one for a
document, are dealt at random into groups of about ``RESTS_PER_GROUP`` (their number
is that of the documents, so a group of long documents is no larger than one of short
ones), and each group is packed on its own by first-fit decreasing: a tournament tree
over the capacities of its bins leads from the root to the first bin that still has
room.

Edge cases: a null text counts as empty and holds only the end id, null doc_ids
are packed like others, rows repeated are packed each, extra columns are
ignored, an empty table gives no pieces.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.encoding import encoder, vocabulary
from colloquy.llm.storage import spool

VOCABULARY = "word_bpe_49k.json"
END = 2
LENGTH = 4096
RESTS_PER_GROUP = 4_000
SLICE = 256


def first_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece; ``lengths`` must be decreasing."""
    leaves = 1 << max(0, int(len(lengths) - 1).bit_length())
    room = [capacity] * (2 * leaves)
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i, size in enumerate(lengths.tolist()):
        at = 1
        while at < leaves:
            at *= 2
            at += room[at] < size
        bins[i], offsets[i] = at - leaves, capacity - room[at]
        room[at] -= size
        while at > 1:
            at //= 2
            most = max(room[2 * at], room[2 * at + 1])
            if room[at] == most:
                break
            room[at] = most
    return bins, offsets


def cut(docs: DataFrame, vocabulary_path: str, length: int) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, deal (random)."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, end = encoder(vocabulary_path, True), np.array([END], "<u4").tobytes()
        deal = np.random.default_rng(TaskContext.get().partitionId())
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                row, start, size, crc, total = [], [], [], [], []
                for i, ids in enumerate(encode([t or "" for t in part.column(1).to_pylist()])):
                    ids += end
                    for a in range(0, len(ids), 4 * length):
                        piece = ids[a : a + 4 * length]
                        row.append(i)
                        start.append(a // 4)
                        size.append(len(piece) // 4)
                        crc.append(zlib.crc32(piece))
                        total.append(len(ids) // 4)
                numbers = [pa.array(x, pa.int64()) for x in (start, size, crc, total)]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row, pa.int32())), *numbers, pa.array(deal.random(len(row)))], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "deal"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, deal double")


def pack(docs: DataFrame, vocabulary_path: str | None = None, length: int = LENGTH, rests_per_group: int = RESTS_PER_GROUP) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset for every piece."""
    kind = dict(docs.dtypes)["doc_id"]
    groups = max(1, math.ceil(docs.select(F.lit(1)).count() / rests_per_group))
    pieces = cut(docs, vocabulary_path or vocabulary(VOCABULARY), length)
    # Full sequences are numbered below 0, from the task and row that made them; groups number theirs from 0 on.
    full = F.when(F.col("length") == length, -1 - F.monotonically_increasing_id())
    pieces = spool(pieces.withColumns({"full": full, "pack": F.floor(F.col("deal") * groups).cast("long")}).drop("deal"), "pieces")
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

    def fit(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending")])
        bins, offsets = first_fit(table.column("length").to_numpy(), length)
        sequence = (table.column("pack")[0].as_py() << 32) + bins
        return table.drop_columns("pack").append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offsets))

    rests = pieces.where("full is null").drop("full").groupBy("pack").applyInArrow(fit, schema)
    alone = pieces.where("full is not null").withColumnRenamed("full", "sequence_id").drop("pack")
    return rests.unionByName(alone.withColumn("offset", F.lit(0).cast("long")))
