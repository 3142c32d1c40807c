"""Readers of exported posts and replies, rating sheets, summaries and bundles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.config import CODES, COMMUNITY_IDS
from colloquy.functions import clean
from colloquy.operators.tables import first_of, last_of
from colloquy.schemas import CODED_POSTS, SAMPLE_CSV
from colloquy.shared import children, shared_path
from colloquy.sources import split, split_json


def _csv(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """All columns as texts, with ``seq``: the place of a row by file, then inside it. A large file is read by many tasks."""
    rows = split.read_csv(spark, paths)
    return rows.toDF(*(c.lstrip("﻿").strip() for c in rows.columns))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """An export as it was written, all columns as texts."""
    return split.read_csv(spark, path).drop("seq")


def _get(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


def named_community(df: DataFrame, name: Column, key: Column) -> Column:
    ids = F.create_map(*(F.lit(x) for pair in COMMUNITY_IDS.items() for x in pair))
    return clean.first_filled(name, ids[key], key)


def clean_posts(raw: DataFrame) -> DataFrame:
    """Typed posts; of equal ids the last row stays. Authors are not kept."""
    g = lambda n: _get(raw, n)
    kept = last_of(raw.where(F.coalesce(clean.trimmed(g("id")), F.lit("")) != ""), ["id"], "seq")
    meta = {
        "corpus_layer": clean.text_field(g("corpus_layer")), "source": F.lit("export"), "tertile": clean.tertile(g("tertile")), "upvote_ratio": clean.ratio(g("upvote_ratio")),
        "nsfw": clean.flag(g("nsfw")), "locked": clean.flag(g("locked")), "flair_text": clean.text_field(g("flair_text")), "subreddit_id": g("subreddit_id"),
    }
    return kept.select(
        clean.with_prefix(F.col("id")).alias("reddit_id"), F.lit("submission").alias("type"), named_community(raw, g("subreddit_name"), g("subreddit_id")).alias("subreddit"),
        clean.text_field(g("title")).alias("title"), clean.text_field(g("body")).alias("text"), F.lit(None).cast("string").alias("author"),
        clean.permalink(g("permalink")).alias("permalink"), clean.score(g("score")).alias("score"), clean.utc_seconds(g("post_date")).alias("created_utc"),
        F.col("id").alias("post_id"), clean.tertile(g("tertile")).alias("tertile"), clean.post_metadata(F.lit("submission"), meta).alias("extra_metadata"), "seq",
    )


def read_posts(spark: SparkSession, path: str) -> DataFrame:
    return clean_posts(_csv(spark, path))


def clean_comments(raw: DataFrame, posts: DataFrame) -> DataFrame:
    """Typed replies with the third of their post; of equal ids the first row stays, over all files in order."""
    key = clean.first_filled(_get(raw, "comment_id"), _get(raw, "id"))
    g = lambda n: _get(raw, n)
    kept = first_of(raw.withColumn("_key", key).where("_key is not null"), ["_key"], "seq")
    rows = kept.join(posts.select(F.col("post_id").alias("_post"), F.col("tertile").alias("_third")), F.col("post_id") == F.col("_post"), "left")
    meta = {
        "corpus_layer": clean.text_field(g("corpus_layer")), "source": F.lit("export"), "tertile": F.col("_third"), "gilded": clean.flag(g("gilded")),
        "parent_id": clean.parent_id(g("parent_id")), "subreddit_id": g("subreddit_id"),
    }
    return rows.select(
        clean.with_prefix(F.col("_key"), "t1_").alias("reddit_id"), F.lit("comment").alias("type"), named_community(raw, g("subreddit_name"), g("subreddit_id")).alias("subreddit"),
        clean.text_field(g("body")).alias("text"), F.lit(None).cast("string").alias("author"), clean.permalink(g("permalink")).alias("permalink"),
        clean.score(g("score")).alias("score"), clean.utc_seconds(g("comment_date")).alias("created_utc"), "post_id", F.col("_post").isNull().alias("orphan"),
        clean.post_metadata(F.lit("comment"), meta).alias("extra_metadata"), "seq",
    )


def read_comments(spark: SparkSession, paths: list[str], posts: DataFrame) -> DataFrame:
    return clean_comments(_csv(spark, paths), posts)


def posts_and_comments(posts: DataFrame, comments: DataFrame) -> DataFrame:
    return posts.unionByName(comments, allowMissingColumns=True)


def read_coded_posts(spark: SparkSession, path: str) -> DataFrame:
    """The export that profiles are made from, by its declared schema."""
    return split.read_csv(spark, path, CODED_POSTS).drop("seq")


def read_sample(spark: SparkSession, path: str) -> DataFrame:
    """A sample file by its declared schema: cleaned and typed, ``synthetic`` as a flag, without authors; of equal ids the last row stays."""
    rows = last_of(split.read_csv(spark, path, SAMPLE_CSV).where(F.coalesce(clean.trimmed(F.col("id")), F.lit("")) != ""), ["id"], "seq")
    is_comment = F.lower(clean.trimmed(F.col("type"))) == "comment"
    return rows.select(
        F.when(is_comment, clean.with_prefix(F.col("id"), "t1_")).otherwise(clean.with_prefix(F.col("id"))).alias("reddit_id"), "type", "subreddit", clean.text_field(F.col("title")).alias("title"),
        clean.text_field(F.col("text")).alias("text"), "score", "num_comments", "created_utc", clean.permalink(F.col("permalink")).alias("permalink"), "url", "data_source",
        "content_type", "language_flag", "word_count", F.lower(clean.trimmed(F.col("ppm_hint"))).alias("ppm_hint"), F.col("collected_at").try_cast("timestamp").alias("collected_at"),
        F.upper(clean.trimmed(F.col("SYNTHETIC"))).isin("TRUE", "1", "YES", "SYNTHETIC").alias("synthetic"), "seq",
    )


def rater_sheet(raw: DataFrame, key: str = "reddit_id", codes: tuple[str, ...] = CODES) -> DataFrame:
    """(id, codes) of a one-hot sheet; a row without marks is a rated text without codes."""
    raw = raw.toDF(*(c.lstrip("﻿").strip() for c in raw.columns))
    marks = [F.when(clean.marked(F.col(f"`{c}`")), F.lit(c)) for c in codes if c in raw.columns]
    return raw.select(F.col(key).alias("id"), F.array_compact(F.array(*marks)).alias("codes"))


def read_rater_sheet(spark: SparkSession, path: str) -> DataFrame:
    return rater_sheet(spark.read.option("header", True).csv(path))


def _json_lists(spark: SparkSession, path: str, keys: tuple[tuple[str, ...], ...]) -> dict[str, DataFrame]:
    """Rows of each list by its name, with the schema that Spark infers from all of them; lists without items are not there."""
    lines = shared_path(spark, "items")
    split_json.as_lines(split_json.json_items(spark, path, keys), lines)
    return {n.removeprefix("name="): spark.read.json(f"{lines}/{n}") for n in children(spark, lines) if n.startswith("name=")}


def read_dataset_json(spark: SparkSession, path: str) -> DataFrame:
    """Items of files that are a list or an object with ``collected``, in any mixture; a file may hold several objects. A large file is read by many tasks."""
    lists = list(_json_lists(spark, path, split_json.DATASET).values())
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), lists) if lists else spark.createDataFrame([], "id string")


def read_bundle(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Collected rows, coded rows and codes of a saved session. A large file is read by many tasks."""
    lists = _json_lists(spark, path, split_json.BUNDLE)
    names = {"collected": "collected_data", "coded": "coded_data", "codebook": "codes"}
    return {name: lists.get(key, spark.createDataFrame([], "id string")) for name, key in names.items()}


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    """(community, n, push, pull, moor_f, moor_i, mooring) of a JSON summary; keys that begin with ``_`` are about the file."""
    text = spark.read.text(path, wholetext=True)
    entries = text.select(F.explode(F.from_json("value", "map<string,string>")).alias("community", "body")).where(~F.startswith("community", F.lit("_")))
    n = F.coalesce(F.get_json_object("body", "$.submissions_n"), F.get_json_object("body", "$.total_units")).cast("long")
    fields = {"push": "PUSH_count", "pull": "PULL_count", "moor_f": "MOOR_F_count", "moor_i": "MOOR_I_count", "mooring": "MOOR_present_count"}
    return entries.select("community", n.alias("n"), *(F.get_json_object("body", f"$.{f}").cast("long").alias(a) for a, f in fields.items()))


def scan(df: DataFrame, session: str | None = None, community: str | None = None, limit: int | None = None, order: str = "collected_at", tie: str = "reddit_id") -> DataFrame:
    """Stored rows by session and community, newest first; both filters reach the files."""
    if session is not None:
        df = df.where(F.col("session_id") == session)
    if community is not None:
        df = df.where(F.col("subreddit") == community)
    df = df.orderBy(F.col(order).desc_nulls_last(), F.desc(tie))
    return df if limit is None else df.limit(limit)
