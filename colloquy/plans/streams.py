"""Streams over the given tables: ingest, coding with saves and reviews, counts by event time, progress."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.plans.registry import query, table
from colloquy.shared import shared_path as scratch
from colloquy.streaming import coding, ingest, jobs, windows


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _stream(spark: SparkSession, sf_dir: str, copies: bool = False) -> DataFrame:
    """The events as a file stream of several files; if asked, every event comes twice."""
    rows = _events(spark, sf_dir)
    path = scratch(spark, "stream")
    (rows.union(rows) if copies else rows).repartition(4).write.parquet(path)
    return jobs.file_stream(spark, path, rows.schema, 2)


@query("SELECT event_id, user_id FROM events")
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event twice, over several batches; each is stored once."""
    out, stream = scratch(spark, "ingested"), _stream(spark, sf_dir, copies=True)
    ingest.ingest(stream, out, scratch(spark, "offsets"), ["event_id"], "ts").awaitTermination()
    return ingest.stored(spark, out, stream.schema).select("event_id", "user_id")


@query("SELECT event_id, user_id FROM events")
def stream_ingest_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, with repeats dropped inside the stream as well: two months of state hold all times of the table."""
    out, stream = scratch(spark, "ingested"), _stream(spark, sf_dir, copies=True)
    ingest.ingest(stream, out, scratch(spark, "offsets"), ["event_id"], "ts", "ts", "60 days").awaitTermination()
    return ingest.stored(spark, out, stream.schema).select("event_id", "user_id")


@query(
    "WITH h AS (SELECT (max(event_id) + 1) // 2 AS half FROM events) SELECT count(*) FILTER (event_id < half) AS first_added, count(*) FILTER (event_id >= half) AS second_added, 0 AS again_added, "
    "0 AS first_opened, 0 AS second_opened, true AS again_opened FROM events, h"
)
def stream_ingest_pruning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two halves of the events, then the first again: new keys open no stored file, known ones open theirs, and nothing comes in twice."""
    rows, out = _events(spark, sf_dir), scratch(spark, "ingested")
    half = rows.agg(((F.max("event_id") + 1) / 2).cast("long").alias("half"))
    low, high = (rows.join(half, c).drop("half") for c in (F.col("event_id") < F.col("half"), F.col("event_id") >= F.col("half")))
    for number, part in enumerate((low, high, low)):
        ingest.add_batch(part, number, out, ["event_id"], "ts")
    log = ingest.ingest_log(spark, out)
    of = lambda c, n: F.sum(F.when(F.col("batch") == n, F.col(c)))
    named = {"first": 0, "second": 1, "again": 2}
    added = [of("rows_added", n).alias(f"{k}_added") for k, n in named.items()]
    return log.agg(*added, of("files_opened", 0).alias("first_opened"), of("files_opened", 1).alias("second_opened"), (of("files_opened", 2) > 0).alias("again_opened"))


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN 'PUSH' WHEN event_type = 'purchase' THEN 'PULL' ELSE 'NONE' END AS code FROM events")
def stream_coding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch(spark, "coded")
    code = lambda df: df.select("event_id", F.when(F.col("event_type") == "error", "PUSH").when(F.col("event_type") == "purchase", "PULL").otherwise("NONE").alias("code"))
    jobs.code_stream(_stream(spark, sf_dir), code, out, scratch(spark, "offsets")).awaitTermination()
    return spark.read.parquet(out).select("event_id", "code")


@query("SELECT event_id, event_type = 'error' AS flagged FROM events WHERE event_type = 'error' OR user_id % 10 = 0")
def stream_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows for review that every batch of a coding stream leaves: all flagged ones and those of some users."""
    out, reviews = scratch(spark, "coded"), scratch(spark, "reviews")
    code = lambda df: df.select("event_id", "user_id", (F.col("event_type") == "error").alias("flagged"))
    pick = lambda df: df.where("flagged or user_id % 10 = 0").select("event_id", "flagged")
    jobs.code_stream(_stream(spark, sf_dir), code, out, scratch(spark, "offsets"), pick, reviews).awaitTermination()
    return spark.read.parquet(reviews).select("event_id", "flagged")


def _coded(spark: SparkSession, sf_dir: str) -> str:
    """The events in order of their ids, coded in two runs of one stream on four lanes."""
    rows = _events(spark, sf_dir)
    path, out, offsets = scratch(spark, "stream"), scratch(spark, "coded"), scratch(spark, "offsets")
    half = rows.agg(((F.max("event_id") + 1) / 2).cast("long").alias("half"))
    for part in (F.col("event_id") < F.col("half"), F.col("event_id") >= F.col("half")):
        rows.join(half, part).drop("half").write.mode("append").parquet(path)
        stream = jobs.file_stream(spark, path, rows.schema, 1000)
        numbered = coding.number_posts(stream, F.pmod("user_id", F.lit(4)), "event_id", "event_id", F.col("event_type") == "error", save_every=25, review_every=60)
        coding.code_with_reviews(numbered, out, offsets).awaitTermination()
    return out


_NUMBERED = (
    "WITH n AS (SELECT (user_id % 4)::VARCHAR AS lane, event_id::VARCHAR AS id, event_type = 'error' AS flagged, md5('0:' || event_id) AS draw, row_number() OVER (PARTITION BY user_id % 4 ORDER BY event_id) AS number FROM events), "
    "g AS (SELECT *, (number - 1) // 25 + 1 AS save, (number - 1) // 60 + 1 AS review FROM n) "
)


@query(_NUMBERED + "SELECT lane, id, number, save, review FROM g")
def stream_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number, save and review of every post, over two runs of a stream."""
    return coding.coded(spark, _coded(spark, sf_dir), "post")


@query(
    _NUMBERED + "SELECT lane, id, review FROM (SELECT *, count(*) OVER (PARTITION BY lane, review) AS size, row_number() OVER (PARTITION BY lane, review ORDER BY flagged DESC, CASE WHEN flagged THEN number END, draw, number) AS place FROM g) WHERE size = 60 AND place <= 12"
)
def stream_review_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fifth of each complete review, flagged posts first."""
    return coding.coded(spark, _coded(spark, sf_dir), "review").select("lane", "id", "review")


def _windowed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, str]:
    """Counts by day and type in two runs: events from January 11 on, then those before, with 22 days' patience."""
    rows = _events(spark, sf_dir)
    path, out, offsets = scratch(spark, "stream"), scratch(spark, "windows"), scratch(spark, "offsets")
    for part in ("ts >= '2024-01-11'", "ts < '2024-01-11'"):
        rows.where(part).write.mode("append").parquet(path)
        stream = jobs.file_stream(spark, path, rows.schema, 2)
        windows.count_windows(stream, "ts", "event_type", out, offsets, "1 day", "22 days", fold_every=2).awaitTermination()
    return rows, out


@query(
    "WITH m AS (SELECT max(ts) - INTERVAL 22 DAY AS mark FROM events WHERE ts >= '2024-01-11') SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events, m "
    "WHERE ts >= '2024-01-11' OR date_trunc('day', ts) + INTERVAL 1 DAY > mark GROUP BY 1, 2"
)
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Late rows, whose day ended before the watermark, are left out; the others count, whichever run brings them."""
    rows, out = _windowed(spark, sf_dir)
    return windows.window_counts(spark, out, rows, "event_type").select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "n")


@query("SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by day and type; two months' patience leaves nothing out."""
    stream, out = _stream(spark, sf_dir), scratch(spark, "progress")
    windows.count_windows(stream, "ts", "event_type", out, scratch(spark, "offsets"), "1 day", "60 days").awaitTermination()
    return windows.window_counts(spark, out, stream, "event_type").select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "n")


@query("SELECT 'collection' AS name, count(*) AS rows_in, 0.5::DOUBLE AS progress_percentage FROM events")
def stream_run_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a listener wrote about a stream of all events, where twice as many were expected."""
    stream, path = _stream(spark, sf_dir), scratch(spark, "reports")
    with windows.progress_table(spark, path, every=1):
        named = stream.groupBy("event_type").count().writeStream.queryName("collection").outputMode("complete").format("noop")
        named.option("checkpointLocation", scratch(spark, "offsets")).trigger(availableNow=True).start().awaitTermination()
    expected = table(spark, sf_dir, "events").agg(F.lit("collection").alias("name"), (F.count("*") * 2).alias("expected"))
    return windows.collection_progress(windows.read_progress(spark, path), expected).select("name", "rows_in", "progress_percentage")
