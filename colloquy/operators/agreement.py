"""Agreement of raters: Cohen's kappa and shares of agreement from four counts for each code."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pair_counts(ratings: DataFrame, pairs: DataFrame, codes: DataFrame) -> DataFrame:
    """(left, right, code, n, pos1, pos2, both) for every pair of raters and code.

    ``ratings``: rater, id, codes (array; empty for a rated text without codes).
    A pair is compared on the ids that both have rated.
    """
    one = ratings.join(pairs, F.col("rater") == F.col("left")).select("left", "right", "id", F.col("codes").alias("c1"))
    two = ratings.select(F.col("rater").alias("right"), "id", F.col("codes").alias("c2"))
    both = one.join(two, ["right", "id"])
    totals = both.groupBy("left", "right").agg(F.count("*").alias("n"))
    long = both.select("left", "right", "c1", "c2", F.explode(F.array_union("c1", "c2")).alias("code"))
    in1, in2 = F.array_contains("c1", F.col("code")), F.array_contains("c2", F.col("code"))
    counts = long.groupBy("left", "right", "code").agg(F.count_if(in1).alias("pos1"), F.count_if(in2).alias("pos2"), F.count_if(in1 & in2).alias("both"))
    grid = pairs.crossJoin(codes.select("code"))  # both tables have a fixed, small size
    filled = grid.join(totals, ["left", "right"], "left").join(counts, ["left", "right", "code"], "left")
    return filled.fillna(0, ["n", "pos1", "pos2", "both"])


def kappa(counts: DataFrame, least_positive: int = 5) -> DataFrame:
    """``counts`` with n_pos, agreement, kappa (null where it has no meaning) and status."""
    n, p1, p2, a = (F.col(c).cast("double") for c in ("n", "pos1", "pos2", "both"))
    observed = F.try_divide(n - p1 - p2 + 2 * a, n)
    expected = F.try_divide(p1 * p2 + (n - p1) * (n - p2), n * n)
    status = (
        F.when(F.col("n") == 0, "zero overlap")
        .when(F.least("pos1", "pos2") < least_positive, F.format_string("low presence (<%d)", F.lit(least_positive)))
        .when((F.col("pos1") == F.col("n")) | (F.col("pos2") == F.col("n")) | (F.col("pos1") == 0) | (F.col("pos2") == 0), "constant margin")
        .otherwise("estimable")
    )
    rows = counts.withColumns({"n_pos": F.col("pos1") + F.col("pos2") - F.col("both"), "agreement": observed, "status": status})
    return rows.withColumn("kappa", F.when(F.col("status") == "estimable", F.try_divide(observed - expected, 1 - expected)))


def mean_kappa(rows: DataFrame, without: tuple[str, ...] = ("NONE",)) -> DataFrame:
    kept = rows.where((F.col("status") == "estimable") & ~F.col("code").isin(*without))
    return rows.select("left", "right").distinct().join(kept.groupBy("left", "right").agg(F.avg("kappa").alias("mean_kappa"), F.count("*").alias("n_codes")), ["left", "right"], "left").fillna(0, ["n_codes"])


def percent_agreement(counts: DataFrame) -> DataFrame:
    """Share of equal judgements for each code, and pooled over codes (code ``ALL``)."""
    equal = F.col("n") - F.col("pos1") - F.col("pos2") + 2 * F.col("both")
    own = counts.select("left", "right", "code", F.try_divide(equal.cast("double"), F.col("n")).alias("agreement"))
    pooled = counts.groupBy("left", "right").agg(F.lit("ALL").alias("code"), F.try_divide(F.sum(equal).cast("double"), F.sum("n")).alias("agreement"))
    return own.unionByName(pooled)
