"""Profiles of communities from coded posts.

Every table starts from one row per post with a flag for each code, so a count
of posts is a sum of flags: one aggregation with partial sums, no distinct counts.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colloquy.config import CODES, DIMENSION_OF, DIMENSIONS, Thresholds
from colloquy.functions.clean import percent
from colloquy.functions.jsonx import all_low
from colloquy.operators.tables import observed, write_observed


def _column(name: str) -> str:
    return name.replace("-", "_")


def is_eligible(model_prefix: str = "llama") -> Column:
    """Whether a coded post counts: not quarantined, by the model, of a machine partition, not test data."""
    machine = F.coalesce("machine_partition", F.lit(""))
    ok = F.col("quarantine_reason").isNull() & F.col("model").startswith(model_prefix) & ~machine.isin("", "None")
    return ok & ~F.col("data_source").eqNullSafe(F.lit("json_endpoint"))


def eligible(df: DataFrame, model_prefix: str = "llama") -> DataFrame:
    return df.where(is_eligible(model_prefix))


def write_eligible(df: DataFrame, path: str, key: str = "post_id", model_prefix: str = "llama") -> dict[str, int]:
    """Write the posts that count, and what ``filter_counts`` tells of them, counted while they are filtered and written."""
    rows, seen = observed(df, f"filter-{uuid.uuid4().hex}", n_initial=F.count("*"))
    kept = write_observed(rows.where(is_eligible(model_prefix)), path, {"n_kept": F.count("*"), "n_posts": F.count_if(F.col(key).startswith("t3_")), "n_replies": F.count_if(F.col(key).startswith("t1_"))})
    return {**seen.get, **kept, "n_excluded": seen.get["n_initial"] - kept["n_kept"]}


def stratum(df: DataFrame, name: str, key: str = "post_id") -> DataFrame:
    return df.where(F.col(key).startswith("t3_")) if name == "submissions_only" else df


def filter_counts(df: DataFrame, kept: DataFrame, key: str = "post_id") -> DataFrame:
    """Rows before and after the filters, and posts and replies among those kept."""
    before = df.agg(F.count("*").alias("n_initial"))
    after = kept.agg(F.count("*").alias("n_kept"), F.count_if(F.col(key).startswith("t3_")).alias("n_posts"), F.count_if(F.col(key).startswith("t1_")).alias("n_replies"))
    return before.crossJoin(after).withColumn("n_excluded", F.col("n_initial") - F.col("n_kept"))


def post_flags(coded: DataFrame, key: str, community: str, codes: str = "deductive_codes", extra: tuple[str, ...] = ()) -> DataFrame:
    """One row per post and community: a 0/1 column for each code and dimension, MOOR, NONE and ``all_low``.

    A bare dimension name counts for its dimension; an unknown code for none.
    """
    # A column of its own, so that the names are taken from the codes once for all flags.
    named = coded.select(key, community, *extra, F.transform(F.col(codes), lambda c: c["code"]).alias("_names"), all_low(F.col(codes)).cast("int").alias("all_low"))
    names = F.col("_names")
    has = {c: F.coalesce(F.array_contains(names, c), F.lit(False)) for c in CODES}
    dims = {d: reduce(Column.__or__, [has[c] for c in CODES if DIMENSION_OF[c] == d], F.coalesce(F.array_contains(names, d), F.lit(False))) for d in DIMENSIONS}
    flags = {_column(c): v.cast("int") for c, v in has.items()} | {f"{_column(d)}_any": v.cast("int") for d, v in dims.items()}
    rows = named.select(key, community, *extra, *(v.alias(n) for n, v in flags.items()), "all_low", F.lit(1).alias("n_rows"))
    # A post that occurs more than once is one post: any of its rows may carry a code.
    measures = [F.max(n).alias(n) for n in flags] + [F.sum("all_low").alias("all_low"), F.sum("n_rows").alias("n_rows")]
    posts = rows.groupBy(key, community, *extra).agg(*measures)
    moor = F.greatest("MOOR_F_any", "MOOR_I_any")
    none = 1 - F.greatest("PUSH_any", "PULL_any", "MOOR_F_any", "MOOR_I_any")
    return posts.withColumns({"MOOR_any": moor, "NONE_any": none})


_DIMS = ("PUSH", "PULL", "MOOR_F", "MOOR_I", "MOOR", "NONE")


def community_profile(flags: DataFrame, community: str) -> DataFrame:
    """Posts of each community by dimension and code, percentages, and the dominant dimension."""
    counts = [F.sum(f"{d}_any").cast("long").alias(f"{d}_count") for d in _DIMS] + [F.sum(_column(c)).cast("long").alias(_column(c)) for c in CODES]
    rows = flags.groupBy(community).agg(F.count("*").alias("total"), *counts)
    best = F.greatest(*(F.col(f"{_column(d)}_count") for d in DIMENSIONS))
    dominant = reduce(lambda w, d: w.when(F.col(f"{_column(d)}_count") == best, d), DIMENSIONS, F.when(best == 0, "N/A"))
    return rows.withColumns({f"{d}_pct": percent(F.col(f"{d}_count"), F.col("total")) for d in _DIMS} | {"dominant": dominant})


def tertile_sensitivity(flags: DataFrame, community: str, tertile: str, body_length: str, limits: Thresholds | None = None) -> DataFrame:
    """Community and third: counts, percentages and four flags. ``flags`` has the third and the body length of each post."""
    t = limits or Thresholds()
    counts = [F.sum(f"{d}_any").cast("long").alias(f"{d}_count") for d in _DIMS]
    cells = flags.groupBy(community, tertile).agg(F.count("*").alias("total"), *counts, F.sum("all_low").alias("low"), F.coalesce(F.avg(body_length), F.lit(0.0)).alias("mean_length"))
    cells = cells.withColumns({f"{d}_pct": percent(F.col(f"{d}_count"), F.col("total")) for d in _DIMS})
    whole = W.partitionBy(community)

    def rate(d: str, third: int) -> Column:
        return F.coalesce(F.max(F.when(F.col(tertile) == third, F.col(f"{d}_count") / F.col("total"))).over(whole), F.lit(0.0))

    low = F.col("low") / F.col("total") > t.low_confidence
    return cells.withColumns(
        {
            "flag_push_bias": rate("PUSH", 1) > rate("PUSH", 3) + t.push_bias,
            "flag_moor_lower": rate("MOOR_I", 3) > rate("MOOR_I", 1) + t.moor_lower,
            "flag_low_confidence": low,
            "flag_body_length": low & (F.col("mean_length") < t.body_length),
        }
    ).drop("low", "mean_length")


def _combinations() -> list[str]:
    sets = [[d for i, d in enumerate(DIMENSIONS) if n >> i & 1] for n in range(1, 16)]
    return ["+".join(s) for s in sorted(sets, key=lambda s: (len(s), [DIMENSIONS.index(d) for d in s]))] + ["NONE"]


def cooccurrence(coded: DataFrame, community: str, communities: list[str], codes: str = "deductive_codes") -> DataFrame:
    """Rows of posts by the set of dimensions of their codes, for each community and in total; a bare dimension name is no code here."""
    names = F.transform(F.col(codes), lambda c: c["code"])
    parts = [F.when(F.arrays_overlap(names, F.array(*(F.lit(c) for c in CODES if DIMENSION_OF[c] == d))), d) for d in DIMENSIONS]
    combo = F.nullif(F.concat_ws("+", *parts), F.lit(""))
    counted = coded.select(F.coalesce(combo, F.lit("NONE")).alias("combination"), community).groupBy("combination").pivot(community, communities).count()
    frame = coded.sparkSession.createDataFrame(list(enumerate(_combinations())), "place int, combination string")
    rows = frame.join(counted, "combination", "left").fillna(0)
    return rows.withColumn("total", reduce(Column.__add__, (F.col(f"`{c}`") for c in communities)))


def subcode_frequency(flags: DataFrame) -> DataFrame:
    """Posts with each code, zero rows kept, and their share of all posts."""
    sums = flags.agg(F.count("*").alias("total"), *(F.sum(_column(c)).cast("long").alias(_column(c)) for c in CODES))
    pairs = F.array(*(F.struct(F.lit(c).alias("code"), F.coalesce(_column(c), F.lit(0)).alias("n_posts")) for c in CODES))
    return sums.select("total", F.inline(pairs)).select("code", "n_posts", percent(F.col("n_posts"), F.col("total")).alias("pct"))


def code_heatmap(flags: DataFrame, community: str, communities: DataFrame) -> DataFrame:
    """Posts of each community with each code; communities without posts have zeros."""
    counts = flags.groupBy(community).agg(*(F.sum(_column(c)).cast("long").alias(_column(c)) for c in CODES))
    return communities.join(counts, community, "left").fillna(0)


def coordinates(counts: DataFrame) -> DataFrame:
    """``counts`` (push, pull, mooring, n) with x = (pull - push) / (pull + push) and y = 100 mooring / n; null on a zero divisor."""
    x = F.try_divide((F.col("pull") - F.col("push")).cast("double"), F.col("pull") + F.col("push"))
    return counts.withColumns({"x": x, "y": F.try_divide(100.0 * F.col("mooring"), F.col("n"))})


def with_archetype(points: DataFrame, archetypes: DataFrame, community: str) -> DataFrame:
    """The archetype of each community, with or without ``r/`` before its name; an unknown one is an error."""
    bare = F.regexp_replace(community, "^r/", "")
    rows = points.withColumn("_bare", bare).join(F.broadcast(archetypes.withColumnRenamed(community, "_bare")), "_bare", "left")
    known = F.when(F.col("archetype").isNull(), F.raise_error(F.concat(F.lit("no archetype for "), F.col("_bare")))).otherwise(F.col("archetype"))
    return rows.withColumn("archetype", known).drop("_bare")


def quadrants(points: DataFrame) -> DataFrame:
    """Points by side of x = 0 and of the median of y."""
    middle = points.agg(F.median("y").alias("middle"))
    side = F.when(F.col("x") > 0, "right").otherwise("left")
    height = F.when(F.col("y") >= F.col("middle"), "high").otherwise("low")
    rows = points.crossJoin(middle).withColumn("quadrant", F.concat_ws("_", height, side))  # one row of medians
    return rows.groupBy("quadrant").agg(F.count("*").alias("n_points"), F.min("middle").alias("median_y"))
