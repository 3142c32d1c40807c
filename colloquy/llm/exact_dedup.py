"""Exact deduplication of a new batch against an immutable snapshot.

A snapshot is written once, to a folder of its own, and only read from then on:
exact buckets, one row per digest, and a static binary-fuse filter for each shard
of digests (Graf and Lemire 2022). Duplicates inside a new batch are grouped on
their own. The batch's digests meet the filter of their shard. What it answers
"no" to is new, and its class is the batch's own group; positives are looked up
in the exact buckets, and those found there share a class with the snapshot's
rows. The rows of a class are then compared byte by byte with the row that would
stay; rows that differ form classes of their own.

Edge cases: a null text counts as empty, empty texts are equal to one another,
null doc_ids sort first, of rows repeated with the same doc_id and text one is
kept, ties in length go to the least doc_id, extra columns are ignored, an empty
table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm.rows import row_key
from colloquy.llm.storage import spool
from colloquy.shared import shared_path

WHITE = r"[\x20\x09-\x0D]+"
KEYS_PER_SHARD = 500_000


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, "")


# -- the static filter ---------------------------------------------------------------------------


def _spread(keys: np.ndarray, seed: int) -> np.ndarray:
    x = keys ^ np.uint64(seed * 0x9E3779B97F4A7C15 % 2**64)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _slots(hashes: np.ndarray, segment: int, segments: int) -> np.ndarray:
    """Three slots of each key, in three consecutive segments."""
    first = ((hashes >> np.uint64(32)) * np.uint64(segments)) >> np.uint64(32)
    low = np.uint64(segment - 1)
    inside = (hashes & low, (hashes >> np.uint64(18)) & low, (hashes >> np.uint64(36)) & low)
    return np.stack([((first + np.uint64(i)) * np.uint64(segment) + x).astype(np.int64) for i, x in enumerate(inside)])


def _fingerprints(hashes: np.ndarray) -> np.ndarray:
    return ((hashes ^ (hashes >> np.uint64(32))) & np.uint64(255)).astype(np.uint8)


def build_filter(keys: np.ndarray) -> bytes:
    """A binary-fuse filter of distinct 64-bit keys: no false negatives, false positives about 1 in 256."""
    n = max(2, len(keys))
    segment = 1 << max(2, int(math.log(n) / math.log(3.33) + 2.25))
    grow = max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(n))
    segments = max(1, math.ceil(n * grow / segment) - 2)
    for seed in range(1, 1000):
        hashes = _spread(keys, seed)
        slots = _slots(hashes, segment, segments)
        size = (segments + 2) * segment
        load = np.bincount(slots.ravel(), minlength=size)
        owner = np.zeros(size, np.int64)
        for i in range(3):
            np.bitwise_xor.at(owner, slots[i], np.arange(len(keys)))
        rounds, left = [], len(keys)
        ready = np.flatnonzero(load == 1)
        while len(ready):
            key, at = np.unique(owner[ready], return_index=True)
            rounds.append((key, ready[at]))
            left -= len(key)
            touched = slots[:, key]
            np.subtract.at(load, touched.ravel(), 1)
            for i in range(3):
                np.bitwise_xor.at(owner, touched[i], key)
            touched = np.unique(touched.ravel())
            ready = touched[load[touched] == 1]
        if left == 0:
            table, prints = np.zeros(size, np.uint8), _fingerprints(hashes)
            for key, at in reversed(rounds):
                a, b, c = table[slots[:, key]]
                table[at] = prints[key] ^ a ^ b ^ c ^ table[at]
            return np.array([seed, segment, segments], np.int64).tobytes() + table.tobytes()
        segments += max(1, segments // 16)
    raise ValueError("the keys of a filter must be distinct")


def probe_filter(data: bytes, keys: np.ndarray) -> np.ndarray:
    seed, segment, segments = (int(x) for x in np.frombuffer(data[:24], np.int64))
    table, hashes = np.frombuffer(data, np.uint8, offset=24), _spread(keys, seed)
    a, b, c = table[_slots(hashes, segment, segments)]
    return (a ^ b ^ c) == _fingerprints(hashes)


# -- snapshot and batch --------------------------------------------------------------------------


def digests(docs: DataFrame, *more: str) -> DataFrame:
    """One small row per row of ``docs``; what follows shuffles these, not texts."""
    length = F.length(F.coalesce(F.col("text"), F.lit("")))
    digest = F.unhex(F.sha2(normalised(F.col("text")), 256))
    return docs.select("doc_id", length.alias("n"), digest.alias("digest"), row_key().alias("row_key"), *more)


def _order() -> Column:
    """The least of these is the row that stays."""
    return F.struct((-F.col("n")).alias("n"), "doc_id", "rid", "row_key")


def buckets(rows: DataFrame) -> DataFrame:
    """The row that stays and the number of rows, for each digest."""
    return rows.groupBy("digest").agg(F.min(_order()).alias("keep"), F.count("*").alias("size"))


def _keyed(buckets: DataFrame, shards: int) -> DataFrame:
    key = F.conv(F.hex(F.substring("digest", 1, 8)), 16, -10).cast("long")
    return buckets.select("digest", key.alias("key")).withColumn("shard", F.pmod("key", F.lit(shards)).cast("int"))


def fuse_filters(exact: DataFrame, shards: int) -> DataFrame:
    """(shard, shards, filter): one static filter for each shard of the snapshot's digests."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = np.unique(pdf["key"].to_numpy(np.int64).view(np.uint64))
        return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "shards": [shards], "filter": [build_filter(keys)]})

    return _keyed(exact, shards).select("key", "shard").groupBy("shard").applyInPandas(build, "shard int, shards int, filter binary")


def screen(batch: DataFrame, filters: DataFrame) -> DataFrame:
    """(digest) of ``batch`` (one row per digest) that the snapshot may hold."""
    shards = (filters.agg(F.max("shards")).first()[0]) or 1

    def probe(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        keys = left["key"].to_numpy(np.int64).view(np.uint64)
        hit = probe_filter(right["filter"].iloc[0], keys) if len(right) else np.zeros(len(keys), bool)
        return left.loc[hit, ["digest"]]

    return _keyed(batch, shards).groupBy("shard").cogroup(filters.groupBy("shard")).applyInPandas(probe, "digest binary")


def write_snapshot(rows: DataFrame, path: str, keys_per_shard: int = KEYS_PER_SHARD) -> None:
    """Write the buckets and filters of ``rows`` (digests with rid) to ``path``, which must not exist yet."""
    buckets(rows).write.option("compression", "zstd").parquet(f"{path}/buckets")
    exact = rows.sparkSession.read.parquet(f"{path}/buckets")
    shards = max(1, math.ceil(exact.count() / keys_per_shard))
    fuse_filters(exact, shards).write.parquet(f"{path}/filters")


def match_batch(rows: DataFrame, spark: SparkSession, path: str) -> DataFrame:
    """(digest, old, keep, size): classes of the batch ``rows`` (old is false) and of the snapshot at ``path`` (old is true)."""
    exact, filters = spark.read.parquet(f"{path}/buckets"), spark.read.schema("shard int, shards int, filter binary").parquet(f"{path}/filters")
    new = spool(buckets(rows), "batch")
    maybe = screen(new, filters)
    theirs = exact.select("digest", F.col("keep").alias("keep_old"), F.col("size").alias("size_old"))
    hits = new.join(maybe, "digest", "left_semi").join(theirs, "digest")
    hits = spool(hits.select("digest", F.least("keep", "keep_old").alias("hit_keep"), (F.col("size") + F.col("size_old")).alias("hit_size")), "hits")
    sides = [side.withColumn("old", F.lit(old)).join(hits, "digest", "left") for side, old in ((new, False), (exact, True))]
    return sides[0].unionByName(sides[1]).select("digest", "old", F.coalesce("hit_keep", "keep").alias("keep"), F.coalesce("hit_size", "size").alias("size"))


def deduplicate(docs: DataFrame, in_snapshot: Column, keys_per_shard: int = KEYS_PER_SHARD) -> DataFrame:
    """Classes of equal texts over a snapshot (rows where ``in_snapshot``) and a new batch (the others).

    Returns one row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, row_key.
    """
    spark = docs.sparkSession
    rows = digests(docs.withColumn("_old", F.coalesce(in_snapshot, F.lit(False))).select("doc_id", "text", F.col("_old").alias("old")), "old")
    rows = spool(rows.withColumn("rid", F.monotonically_increasing_id()), "digests")
    path = shared_path(spark, "snapshot")
    write_snapshot(rows.where("old"), path, keys_per_shard)
    classes = spool(match_batch(rows.where("not old"), spark, path), "classes")

    # Byte checks: only rows of classes with company meet their text again, by 128 bits of doc_id and text.
    company = classes.where("size > 1").select("digest", "old", F.col("keep.row_key").alias("lead"))
    members = rows.join(company.hint("merge"), ["digest", "old"]).select("row_key", "digest", "lead").distinct()
    texts = docs.select(row_key().alias("row_key"), "text").join(members.hint("merge"), "row_key")
    held = spool(texts.select("row_key", "digest", "lead", normalised(F.col("text")).alias("norm")), "texts")
    leads = spool(held.where("row_key = lead").groupBy("lead").agg(F.min("norm").alias("lead_norm")), "leads")
    clash = spool(held.join(leads, "lead").where("norm <> lead_norm").select("digest", "row_key", F.col("norm").alias("other")).distinct(), "clashes")

    def result(rows: DataFrame) -> DataFrame:
        kept = F.col("rid") == F.col("keep.rid")
        return rows.select("doc_id", F.col("keep.doc_id").alias("keep_id"), F.col("size").alias("group_size"), kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), "row_key")

    if clash.isEmpty():
        return result(rows.join(classes.hint("merge"), ["digest", "old"]))
    # Where a digest has several texts, those other than its lead's put the text itself into the key of their class.
    torn = rows.join(clash.select("digest").distinct(), "digest", "left_semi").join(clash.select("row_key", "other"), "row_key", "left")
    torn = spool(torn.withColumn("other", F.coalesce("other", F.lit(""))), "torn")
    own = spool(torn.groupBy("digest", "other").agg(F.min(_order()).alias("keep"), F.count("*").alias("size")), "own")
    rest = rows.join(clash.select("digest").distinct(), "digest", "left_anti")
    return result(rest.join(classes.hint("merge"), ["digest", "old"])).unionByName(result(torn.join(own, ["digest", "other"])))


def keep_first(docs: DataFrame, in_snapshot: Column) -> DataFrame:
    """The rows of ``docs`` that stay, with their own columns."""
    kept = deduplicate(docs, in_snapshot).where("kept").select(F.col("row_key").alias("stays"))
    keyed = docs.select(F.struct("*").alias("row"), row_key().alias("id"))
    # Of rows repeated with the same doc_id and text one stays.
    return keyed.join(kept.hint("merge"), F.col("id") == F.col("stays"), "left_semi").dropDuplicates(["id"]).select("row.*")
