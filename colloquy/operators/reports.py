"""Counts and distributions for progress and quality reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colloquy.operators.agreement import percent_agreement
from colloquy.operators.sampling import head


def distribution(df: DataFrame, column: str) -> DataFrame:
    """Rows and share of each value."""
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    return counts.withColumn("pct", F.col("n") * 100.0 / F.sum("n").over(W.partitionBy(F.lit(1))))


def distributions(df: DataFrame, columns: list[str]) -> DataFrame:
    """Counts of the values of several columns, from one pass (grouping sets)."""
    sets = ", ".join(f"({c})" for c in columns)
    df.createOrReplaceTempView("_distributions")
    name = " ".join(f"WHEN grouping({c}) = 0 THEN '{c}'" for c in columns)
    value = ", ".join(f"CAST({c} AS STRING)" for c in columns)
    return df.sparkSession.sql(f"SELECT CASE {name} END AS field, coalesce({value}) AS value, count(*) AS n FROM _distributions GROUP BY GROUPING SETS ({sets})")


def top(df: DataFrame, column: str, k: int) -> DataFrame:
    """The k most frequent values; of equal ones the lesser."""
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(k)


def top_of_array(df: DataFrame, column: str, k: int, into: str = "value") -> DataFrame:
    return top(df.select(F.explode(column).alias(into)).where(F.coalesce(F.col(into), F.lit("")) != ""), into, k)


def progress(collected: DataFrame, coded: DataFrame, key: str, kind: str, codes: str, targets: dict[str, int]) -> DataFrame:
    """For each kind: collected, coded, coded with a code, share done of the target (at most 1) and what remains."""
    marks = coded.groupBy(key).agg(F.max((F.size(codes) > 0).cast("int")).alias("_coded"))
    rows = collected.join(marks, key, "left").groupBy(kind).agg(
        F.count("*").alias("n_collected"), F.count("_coded").alias("n_coded"), F.coalesce(F.sum("_coded"), F.lit(0)).alias("n_with_codes")
    )
    target = reduce(lambda w, t: w.when(F.col(kind) == t[0], t[1]), targets.items(), F.when(F.lit(False), 0)).otherwise(0)
    rows = rows.withColumn("target", target)
    return rows.withColumns(
        {
            "done": F.least(F.lit(1.0), F.coalesce(F.try_divide(F.col("n_collected").cast("double"), F.col("target")), F.lit(0.0))),
            "remaining": F.greatest(F.lit(0), F.col("target") - F.col("n_collected")),
            "with_codes_pct": F.col("n_with_codes") * 100.0 / F.col("n_collected"),
        }
    )


def temporal_matrix(df: DataFrame, row: str, year: str, years: list[int]) -> DataFrame:
    return df.groupBy(row).pivot(year, years).count().fillna(0)


def date_range(df: DataFrame, kind: str, at: str) -> DataFrame:
    return df.groupBy(kind).agg(F.min(at).alias("first_at"), F.max(at).alias("last_at"), F.count("*").alias("n"))


def quality_counts(df: DataFrame, meta: str) -> DataFrame:
    """Items that are adult, removed, or likely not English by their metadata (JSON)."""
    get = lambda f: F.get_json_object(meta, f"$.{f}")
    return df.agg(
        F.count("*").alias("total_items"),
        F.count_if(get("nsfw") == "true").alias("nsfw_items"),
        F.count_if(get("content_status").isin("removed", "author_deleted")).alias("removed_items"),
        F.count_if(get("language_flag") == "likely_non_english").alias("non_english_items"),
    )


def quality_appendix(df: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """Items under each condition and their percentage; an empty table has zeros."""
    counts = df.agg(F.count("*").alias("total"), *(F.count_if(c).alias(n) for n, c in conditions.items()))
    rows = F.array(*(F.struct(F.lit(n).alias("condition"), F.col(n).alias("n")) for n in conditions))
    return counts.select("total", F.inline(rows)).withColumn("pct", F.col("n") * 100.0 / F.greatest("total", F.lit(1)))


def session_stats(collected: DataFrame, coded: DataFrame, runs: DataFrame, community: str, at: str) -> DataFrame:
    """One row for each session that collected or ran something, newest first.

    ``runs`` has session_id, started_at, label, status. Two groupings and the
    newest run of each session, joined: no query for each session.
    """
    named = lambda df: df.where(F.coalesce(F.col("session_id").cast("string"), F.lit("")) != "")
    items = named(collected).groupBy("session_id").agg(
        F.count("*").alias("n_items"), F.array_join(F.array_sort(F.collect_set(community)), ",").alias("communities"), F.min(at).alias("first_at"), F.max(at).alias("last_at")
    )
    codes = named(coded).groupBy("session_id").agg(F.count("*").alias("n_coded"))
    last = named(runs).groupBy("session_id").agg(F.max_by(F.struct("label", "status"), F.struct("started_at", "label")).alias("run"), F.max("started_at").alias("started_at"))
    ids = items.select("session_id").union(last.select("session_id")).distinct()
    rows = ids.join(items, "session_id", "left").join(codes, "session_id", "left").join(last, "session_id", "left")
    rows = rows.select("session_id", F.coalesce("n_items", F.lit(0)).alias("n_items"), F.coalesce("n_coded", F.lit(0)).alias("n_coded"), F.coalesce("communities", F.lit("")).alias("communities"), "first_at", "last_at", "started_at", F.col("run.label").alias("label"), F.col("run.status").alias("status"))
    return rows.orderBy(F.coalesce("first_at", "started_at").desc_nulls_last(), "session_id")


def codebook_statistics(codebook: DataFrame, categories: DataFrame) -> DataFrame:
    """Codes and use of each category, zeros kept, and in total (category ``ALL``)."""
    own = codebook.groupBy("category").agg(F.count("*").alias("n_codes"), F.sum("frequency").alias("frequency"))
    rows = categories.join(own, "category", "left").fillna(0, ["n_codes", "frequency"])
    return rows.unionByName(rows.agg(F.lit("ALL").alias("category"), F.sum("n_codes").alias("n_codes"), F.sum("frequency").alias("frequency")))


def literature_counts(references: DataFrame, links: DataFrame, keywords: str) -> DataFrame:
    refs = references.agg(F.count("*").alias("n_references"))
    linked = links.agg(F.count("*").alias("n_links"), F.count_distinct("collection_hash").alias("n_collections"))
    words = references.select(F.explode(keywords).alias("k")).agg(F.count_distinct("k").alias("n_keywords"))
    return refs.crossJoin(linked).crossJoin(words)  # one row each


def appendix_tables(collected: DataFrame, coded: DataFrame, counts: DataFrame, references: DataFrame, links: DataFrame, kind: str, community: str, at: str, codes: str, key: str, conditions: dict[str, Column], n_sample: int = 20, n_top: int = 15) -> dict[str, DataFrame]:
    """The data of a report's appendices, by name: collection (A), codes (C), a sample of coded rows (D), agreement (E), quality (F), literature (G).

    ``coded`` has category, confidence and the array ``codes``; ``counts`` are the pair counts of raters.
    """
    return {
        "A_periods": date_range(collected, kind, at),
        "A_communities": distribution(collected, community),
        "C_categories": distribution(coded, "category"),
        "C_confidences": distribution(coded, "confidence"),
        "C_top_codes": top_of_array(coded, codes, n_top),
        "D_sample": head(coded.select(key, "category", "confidence"), n_sample, key),
        "E_agreement": percent_agreement(counts),
        "F_quality": quality_appendix(collected, conditions),
        "G_literature": literature_counts(references, links, "keywords"),
    }
