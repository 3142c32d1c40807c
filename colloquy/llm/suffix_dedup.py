"""Removal of every byte under a string of ``LENGTH`` bytes that also starts elsewhere in the corpus.

No task can hold a suffix array of the corpus, and nearly all of its suffixes
are alone. So each window of ``LENGTH`` bytes is served by an anchor, the
substring of ``GRAMS[0]`` bytes in it with the least hash: equal windows have
equal anchors, wherever they stand. Anchors that occur once serve no repeats. For
the others, the stretch of text whose windows an anchor serves is its context (a
run or a short pattern that goes on is one context, of ``LONGEST`` windows at most):

* equal contexts of one anchor (64 bits each of anchor and context) are repeats
  as a whole, and one of them stands for all in what follows;
* different contexts of one anchor go to the same shard, whose suffix array is
  built by induced sorting; permuted common prefixes of ``LENGTH`` or more mark
  the repeated windows;
* the windows of an anchor with more than ``MOST_CONTEXTS`` different contexts
  would not fit a shard; they are served anew by longer anchors, the next of
  ``GRAMS``, which are rarer. The last are whole windows, whose contexts differ in
  nothing but the length of a run, so there are ``LONGEST`` at most.

Edge cases: a null text counts as empty, texts under ``LENGTH`` bytes lose
nothing, rows are told apart by doc_id and text (128 bits), so null and repeated
doc_ids do no harm and repeated rows are copies of each other, of equal strings
all are removed, long texts are served stretch by stretch, extra columns are
ignored, an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.rows import row_key
from colloquy.llm.storage import spool
from colloquy.llm.suffix_arrays import permuted_common_prefixes, suffix_array
from colloquy.llm.textscan import CHUNK_BYTES, gram_hashes, pieces

LENGTH = 200
GRAMS = (64, 132, 200)
MOST_CONTEXTS = 2_000
SHARD_BYTES = 1_000_000
#: Windows of one context: a passage that repeats a short pattern has one least hash all along.
LONGEST = 4_096


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive keys."""
    n = len(keys) - width + 1
    padded = np.full(-(-len(keys) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(keys)] = keys
    table = padded.reshape(-1, width)
    forward = np.minimum.accumulate(table, axis=1).ravel()
    backward = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[:n], forward[width - 1 : width - 1 + n])


def serve(data: np.ndarray, off: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """For each anchor: row, anchor and context (hashes), start of the first window served, number of further windows, and whether the anchor stands in them more than once."""
    none = tuple(np.zeros(0, np.int64) for _ in range(6))
    if len(data) < length:
        return none
    grams = gram_hashes(data, gram)
    place, low, high = np.arange(len(grams), dtype=np.uint64), np.uint64(0xFFFFFFFF), np.uint64(0xFFFFFFFF00000000)
    leftmost = (_least((grams & high) | place, length - gram + 1) & low).astype(np.int64)
    rightmost = (low - (_least((grams & high) | (low - place), length - gram + 1) & low)).astype(np.int64)
    row_end = np.repeat(off[1:], np.diff(off))
    window = np.flatnonzero(np.arange(len(leftmost)) + length <= row_end[: len(leftmost)])
    if not len(window):
        return none
    # Wherever in a window its least hash stands, equal windows have the same; consecutive ones that share it are served together.
    anchor, at = grams[leftmost[window]], np.arange(len(window))
    new = np.ones(len(window), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (np.diff(window) != 1)
    new |= (at - np.maximum.accumulate(np.where(new, at, 0))) % LONGEST == 0
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(window)) - 1
    again = leftmost[window[first]] != rightmost[window[last]]
    start, more = window[first], window[last] - window[first]
    raw, digest = memoryview(np.ascontiguousarray(data)), xxhash.xxh3_64_intdigest
    context = np.array([digest(raw[a:b]) for a, b in zip(start.tolist(), (start + more + length).tolist(), strict=True)], np.uint64)
    return np.searchsorted(off, start, "right") - 1, anchor[first].view(np.int64), context.view(np.int64), start, more, again


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, row_key (128 bits), base, bytes: the whole text from its first byte on."""
    return docs.select("doc_id", row_key().alias("row_key"), F.lit(0).alias("base"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("bytes"))


def anchors(stretches: DataFrame, length: int, gram: int, limit: int = CHUNK_BYTES) -> DataFrame:
    """(row_key, base, anchor, context, start, more, again): one row for each anchor that serves windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, off in pieces(batches, "bytes", limit):
            # One long text is served in parts that share no window.
            for a in range(0, max(1, len(data) - length + 1), limit if len(off) == 2 else len(data) + 1):
                here = (data[a : a + limit + length - 1], np.array([0, min(limit + length - 1, len(data) - a)])) if len(off) == 2 else (data, off)
                row, anchor, context, start, more, again = serve(*here, length, gram)
                numbers = [pa.array(anchor), pa.array(context), pa.array((start - here[1][row] + a).astype(np.int32)), pa.array(more.astype(np.int32)), pa.array(again.astype(bool))]
                yield pa.RecordBatch.from_arrays([*(part.column(i).take(pa.array(row)) for i in (0, 1)), *numbers], ["row_key", "base", "anchor", "context", "start", "more", "again"])

    return stretches.select("row_key", "base", "bytes").mapInArrow(run, "row_key binary, base int, anchor long, context long, start int, more int, again boolean")


def _runs(flags: np.ndarray) -> Iterator[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)


def repeated_in_shard(contexts: list[bytes], length: int) -> list[np.ndarray]:
    """For each context: which of its windows start elsewhere in the shard too."""
    sizes = np.array([len(c) + 1 for c in contexts])
    starts = np.concatenate([[0], np.cumsum(sizes)])
    text = np.zeros(starts[-1] + 1, np.int64)
    text[:-1] = np.frombuffer(b"\0".join(contexts) + b"\0", np.uint8).astype(np.int64) + 2
    text[starts[1:] - 1] = 1  # ends a context; the last sign of all, 0, is the least
    array = suffix_array(text)
    common = permuted_common_prefixes(text, array) >= length
    after = np.zeros(len(text), bool)
    after[array[:-1]] = common[array[1:]]
    repeated = common | after
    return [repeated[a : a + n - length] for a, n in zip(starts[:-1], sizes, strict=True)]


def _cut(stretches: DataFrame, mixed: DataFrame, length: int, most_contexts: int) -> DataFrame:
    """row_key, anchor, copies, base, many, bytes: the contexts that ``mixed`` names, base counted in their text."""
    ask = F.struct("anchor", F.col("n").alias("copies"), F.col("contexts"), "start", "more").alias("ask")
    asked = mixed.select("row_key", "base", ask).groupBy("row_key", "base").agg(F.collect_list("ask").alias("asks"))
    texts = stretches.select("row_key", "base", "bytes").join(asked.hint("merge"), ["row_key", "base"]).dropDuplicates(["row_key", "base"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary()]
        for batch in batches:
            out: list[tuple] = []
            for key, base, raw, asks in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for a in asks:
                    out.append((key, a["anchor"], a["copies"], base + a["start"], a["contexts"] > most_contexts, raw[a["start"] : a["start"] + a["more"] + length]))
            columns = list(zip(*out, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["row_key", "anchor", "copies", "base", "many", "bytes"])

    return texts.mapInArrow(run, "row_key binary, anchor long, copies long, base int, many boolean, bytes binary")


def repeated_spans(docs: DataFrame, length: int = LENGTH, grams: tuple[int, ...] = GRAMS, most_contexts: int = MOST_CONTEXTS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(row_key, begin, end): bytes of a text that repeats cover; spans may overlap. The last of ``grams`` must be ``length``."""
    schema = "row_key binary, begin int, end int"

    def in_shard(table: pa.Table) -> pa.Table:
        key, copies, base = (table.column(c).to_pylist() for c in ("row_key", "copies", "base"))
        out = []
        for i, flags in enumerate(repeated_in_shard(table.column("bytes").to_pylist(), length)):
            if copies[i] == 1:  # contexts that occur more than once are repeats already
                out += [(key[i], base[i] + a, base[i] + b - 1 + length) for a, b in _runs(flags)]
        columns = list(zip(*out, strict=True)) or [()] * 3
        return pa.table({n: pa.array(c, k) for n, c, k in zip(("row_key", "begin", "end"), columns, (pa.binary(), pa.int32(), pa.int32()), strict=True)})

    stretches, spans = keyed(docs), None
    for gram in grams:
        found = spool(anchors(stretches, length, gram), "found")
        # Tables of their own, so that Spark can split the partition of an anchor or context that very many rows share.
        shared = spool(found.groupBy("anchor").agg(F.count("*").alias("n"), F.max("again").alias("again")).where("n > 1 or again").select("anchor"), "shared")
        served = spool(found.join(shared, "anchor"), "anchors")
        groups = spool(served.groupBy("anchor", "context").agg(F.count("*").alias("n"), F.max("again").alias("again"), F.min(F.struct("row_key", "base", "start", "more")).alias("lead")), "contexts")
        whole = served.join(groups.where("n > 1").select("anchor", "context").hint("merge"), ["anchor", "context"], "left_semi")
        begin = F.col("base") + F.col("start")
        settled = whole.select("row_key", begin.alias("begin"), (begin + F.col("more") + length).alias("end"))
        spans = settled if spans is None else spans.union(settled)

        # One context is enough where it may repeat itself.
        variety = groups.groupBy("anchor").agg(F.count("*").alias("contexts"), F.max(F.col("again") & (F.col("n") == 1)).alias("again"))
        variety = spool(variety.where("contexts > 1 or again").select("anchor", "contexts"), "variety")
        most = most_contexts if gram < length else LONGEST
        cut = spool(_cut(stretches, groups.join(variety, "anchor").select("anchor", "n", "contexts", "lead.*"), length, most), "stretches")
        few, many = cut.where("not many"), cut.where("many")
        shards = max(1, math.ceil(few.agg(F.coalesce(F.sum(F.length("bytes")), F.lit(0))).first()[0] / shard_bytes))
        spans = spans.union(few.withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards))).groupBy("shard").applyInArrow(in_shard, schema))
        if many.isEmpty():
            break
        stretches = many
    return spans


def remove_repeats(docs: DataFrame, length: int = LENGTH, grams: tuple[int, ...] = GRAMS, most_contexts: int = MOST_CONTEXTS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of ``docs``."""
    kind = dict(docs.dtypes)["doc_id"]
    spans = repeated_spans(docs, length, grams, most_contexts, shard_bytes)
    lists = spool(spans.groupBy("row_key").agg(F.collect_set(F.struct("begin", "end")).alias("spans")), "spans")
    joined = keyed(docs).join(lists.hint("merge"), "row_key", "left").select("doc_id", "bytes", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for raw, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                runs: list[list[int]] = []
                for begin, end in sorted((s["begin"], s["end"]) for s in found or ()):
                    if runs and begin <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], end)
                    else:
                        runs.append([begin, end])
                edges = [0, *(x for r in runs for x in r), len(raw)]
                kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                out.append((len(raw), len(raw) - len(kept), len(runs), hashlib.sha256(kept).hexdigest()))
            columns = list(zip(*out, strict=True)) or [()] * 4
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return joined.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
