"""Themes that posts bring up beyond the codebook."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.functions import jsonx


def emergent_rows(coded: DataFrame, themes: str = "themes", layer: str = "corpus_layer") -> DataFrame:
    """One row for each labelled theme of a layer B post; ``themes`` is JSON."""
    held = F.col(themes).isNotNull() & ~F.trim(themes).isin("[]", "null", "")
    rows = coded.where((F.col(layer) == "B_emergent") & held).withColumn("_themes", jsonx.parse_themes(F.col(themes)))
    return jsonx.explode_themes(rows.drop(themes), "_themes").drop("_themes")


def _first(value: str, seq: str, filled: bool = False) -> Column:
    given = F.col(value).isNotNull() & (F.trim(value) != "") if filled else F.lit(True)
    return F.min_by(value, F.when(given, F.col(seq)))


def theme_catalogue(rows: DataFrame, canon: DataFrame, label: str, community: str, post: str, seq: str, least_posts: int = 2) -> DataFrame:
    """Themes by canonical label that occur in at least ``least_posts`` posts.

    ``rows`` has definition, evidence_quote, partial_overlap_with and
    distinct_dimension; the first non-blank definition and quote stand for a
    theme, the other two come from its first row.
    """
    joined = rows.join(canon.withColumnRenamed("label", label), label)
    out = joined.groupBy("canonical").agg(
        F.count("*").alias("frequency"),
        F.count_distinct(post).alias("n_posts"),
        F.array_join(F.array_sort(F.collect_set(community)), ", ").alias("communities"),
        F.coalesce(_first("definition", seq, True), F.lit("")).alias("definition"),
        F.coalesce(_first("evidence_quote", seq, True), F.lit("")).alias("evidence_quote"),
        _first("partial_overlap_with", seq).alias("partial_overlap_with"),
        _first("distinct_dimension", seq).alias("distinct_dimension"),
        F.lit("PENDING").alias("status"),
    )
    return out.where(F.col("n_posts") >= least_posts).orderBy(F.desc("frequency"), "canonical")
