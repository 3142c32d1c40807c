"""Joins of posts, replies, codes and references."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_collected(coded: DataFrame, collected: DataFrame, key: str = "reddit_id") -> DataFrame:
    return coded.join(collected, key, "left")


def named(df: DataFrame, names: DataFrame, key: str, into: str) -> DataFrame:
    """The name of an id, or the id itself. ``names`` is a table of fixed size."""
    return df.join(F.broadcast(names), key, "left").withColumn(into, F.coalesce(into, F.col(key).cast("string")))


def enrich_replies(replies: DataFrame, posts: DataFrame, post_key: str, inherited: list[str]) -> DataFrame:
    """Replies with columns of their post, null for orphans."""
    return replies.join(posts.select(post_key, *inherited, F.lit(True).alias("has_post")), post_key, "left").withColumn("has_post", F.coalesce("has_post", F.lit(False)))


def orphans(replies: DataFrame, posts: DataFrame, post_key: str) -> DataFrame:
    return replies.join(posts.select(post_key), post_key, "left_anti").select(post_key).distinct()


def replies_in_corpus(replies: DataFrame, posts: DataFrame, post_key: str, layer: str) -> DataFrame:
    return replies.join(posts.select(post_key, layer), post_key)


def uncoded(collected: DataFrame, coded: DataFrame, key: str = "reddit_id") -> DataFrame:
    """What is still to be coded; unlike NOT IN, a null id among the coded does not hide everything."""
    return collected.join(coded.select(key).where(F.col(key).isNotNull()), key, "left_anti")


def for_review(coded: DataFrame, collected: DataFrame, key: str, order: str, n: int) -> DataFrame:
    return coded.join(collected, key).orderBy(F.desc(order)).limit(n)


def rated_texts(ratings: DataFrame, collected: DataFrame, key: str, at: str, tie: str) -> DataFrame:
    """One rating for each text: the newest."""
    one = ratings.groupBy(key).agg(F.max_by(F.struct("*"), F.struct(at, tie)).alias("r")).select("r.*")
    return one.join(collected, key)


def new_items(items: DataFrame, known: DataFrame, key: str) -> DataFrame:
    return items.join(known.select(key), key, "left_anti")


def code_usage(codebook: DataFrame, coded: DataFrame, codes: str) -> DataFrame:
    """The codebook with its frequency raised by the use of each code."""
    used = coded.select(F.explode(codes).alias("code")).groupBy("code").agg(F.count("*").alias("used"))
    return codebook.join(used, "code", "left").withColumn("used", F.coalesce("used", F.lit(0))).withColumn("frequency", F.col("frequency") + F.col("used"))


def linked_references(links: DataFrame, references: DataFrame, key: str) -> DataFrame:
    return links.join(references, key, "left")


def used_references(references: DataFrame, links: DataFrame, key: str) -> DataFrame:
    return references.join(links.select(key), key, "left_semi")
