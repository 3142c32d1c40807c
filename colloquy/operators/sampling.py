"""Gates, keyword filters and stratified samples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colloquy.config import KEYWORD_GROUPS, Caps, QualityGate
from colloquy.shared import shared_path


def in_scope(df: DataFrame, ids: list[str], first: str, last: str, key: str = "subreddit_id", day: str = "post_date") -> DataFrame:
    """Listed communities within a range of dates, both ends included."""
    return df.where(F.col(key).isin(*ids) & F.col(day).between(first, last))


def quality_gate(score: Column, body: Column, community: Column, gate: QualityGate) -> Column:
    length = F.length(F.trim(body))
    lenient = community.isin(*gate.lenient) if gate.lenient else F.lit(False)
    general = (score >= gate.score) & (length >= gate.length)
    return F.coalesce(body.isNotNull() & (general | (lenient & (score >= gate.lenient_score) & (length >= gate.lenient_length))), F.lit(False))


def matched_groups(title: Column, body: Column, groups: dict[str, str] | None = None) -> Column:
    """Names of the keyword groups that title or body match."""
    groups = groups or KEYWORD_GROUPS
    both = F.lower(F.concat_ws("\n", title, body))
    return F.array_compact(F.array(*(F.when(both.rlike(p), F.lit(name)) for name, p in groups.items())))


def steered(value: Column, kind: str) -> Column:
    """A number that grows with ``value``: of a text, its first six bytes. Null is the least."""
    number = F.conv(F.rpad(F.hex(F.substring(value.cast("binary"), 1, 6)), 12, "0"), 16, 10) if kind == "string" else value
    return F.coalesce(number.cast("double"), F.lit(float("-inf")))


def thirds(df: DataFrame, community: str, value: str, key: str, into: str = "tertile", buckets: int = 3, ranges: int = 64) -> DataFrame:
    """``ntile`` by falling ``value``, then ``key``, without a task that holds a whole community.

    Values are dealt into ranges by approximate quantiles, the values on a cut
    further by quantiles of ``key``. Rows are numbered inside each range, and
    the sizes of the ranges ahead complete the number. The bounds only steer the
    dealing, so approximate ones leave the numbers exact, as long as all who read them
    read the same: they are written down, for quantiles depend on the order in which
    tasks are merged.
    """
    kinds = dict(df.dtypes)
    v, k = steered(F.col(value), kinds[value]), steered(F.col(key), kinds[key])
    steps = F.array(*(F.lit(i / ranges) for i in range(1, ranges)))
    cuts = df.groupBy(F.col(community).alias("_community")).agg(F.percentile_approx(v, steps, 10_000).alias("_cuts"), F.percentile_approx(k, steps, 10_000).alias("_key_cuts"), F.count("*").alias("_n"))
    path = shared_path(df.sparkSession, "cuts")  # two hundred numbers for each community
    cuts.write.parquet(path)
    cuts = df.sparkSession.read.schema(cuts.schema).parquet(path)
    rows = df.withColumns({"_v": v, "_k": k}).join(cuts, F.col(community).eqNullSafe(F.col("_community")))
    above = F.size(F.filter("_cuts", lambda c: c > F.col("_v")))
    below = F.size(F.filter("_key_cuts", lambda c: c < F.col("_k")))
    on_cut = F.array_contains("_cuts", F.col("_v"))
    # Rows on a cut may be very many: they follow the rows above it in ranges of their own, by key.
    rows = rows.withColumn("_range", F.struct(above.alias("a"), F.when(on_cut, 1).otherwise(0).alias("b"), F.when(on_cut, below).otherwise(0).alias("c")))
    sizes = rows.groupBy("_community", "_range").agg(F.count("*").alias("_rows"))
    ahead = W.partitionBy("_community").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(F.col("_community").alias("_c"), F.col("_range").alias("_r"), F.coalesce(F.sum("_rows").over(ahead), F.lit(0)).alias("_ahead"))
    inside = F.row_number().over(W.partitionBy("_community", "_range").orderBy(F.desc(value), key))
    placed = rows.withColumn("_inside", inside).join(offsets, F.col("_community").eqNullSafe(F.col("_c")) & (F.col("_range") == F.col("_r")))
    number = F.col("_inside") + F.col("_ahead")
    q, r = F.floor(F.col("_n") / buckets), F.col("_n") % buckets
    long = r * (q + 1)
    tile = F.when(number <= long, F.ceil(number / (q + 1))).otherwise(r + F.ceil((number - long) / F.greatest(q, F.lit(1))))
    return placed.select(*df.columns, tile.cast("int").alias(into))


def capped(df: DataFrame, community: str, caps: tuple[int, ...], order: list[Column], tertile: str = "tertile") -> DataFrame:
    """The best rows of each third of each community."""
    rank = F.row_number().over(W.partitionBy(community, tertile).orderBy(*order))
    limit = reduce(lambda c, t: c.when(F.col(tertile) == t[0], t[1]), enumerate(caps[1:], 2), F.when(F.col(tertile) == 1, caps[0]))
    # The constant bound lets Spark drop the rest before it shuffles.
    return df.withColumn("rank", rank).where(F.col("rank") <= max(caps)).where(F.col("rank") <= limit)


def best_of_community(df: DataFrame, community: str, order: list[Column], n: int = Caps.per_community) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(W.partitionBy(community).orderBy(*order))).where(F.col("rank") <= n)


def layered_sample(posts: DataFrame, community: str, key: str, score: str, eligible: Column, keyword: Column, caps: Caps | None = None) -> DataFrame:
    """Layer A from eligible posts with a keyword; layer B from eligible posts that are not in layer A, ranked after they are taken out."""
    caps, order = caps or Caps(), [F.desc(score), F.asc(key)]
    gated = posts.where(eligible)
    a = capped(thirds(gated.where(keyword), community, score, key), community, caps.layer_a, order).withColumn("corpus_layer", F.lit("A_keyword"))
    rest = gated.join(a.select(key), key, "left_anti")
    b = capped(thirds(rest, community, score, key), community, caps.layer_b, order).withColumn("corpus_layer", F.lit("B_emergent"))
    return a.unionByName(b)


def tertile_ranges(df: DataFrame, community: str, score: str, tertile: str = "tertile") -> DataFrame:
    return df.groupBy(community, tertile).agg(F.min(score).alias("least_score"), F.max(score).alias("most_score"), F.count("*").alias("pool"))


def review_sample(df: DataFrame, batch: str, key: str, flagged: str, seed: int = 0, share: float = 0.2, most: int = 20) -> DataFrame:
    """A fifth of each batch, 1 to ``most`` rows: flagged rows first, then rows by a draw that depends on seed and key alone.

    Each task keeps its own first ``most`` rows of a batch before any are shuffled, so
    no task holds a batch.
    """
    draw = F.md5(F.concat_ws(":", F.lit(seed), F.col(key)))
    order = W.partitionBy(batch).orderBy(F.desc(flagged), F.when(F.col(flagged), F.col(key)).asc_nulls_last(), draw, key)
    first = df.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)
    sizes = df.groupBy(F.col(batch).alias("_batch")).agg(F.least(F.greatest(F.floor(F.count("*") * share), F.lit(1)), F.lit(most)).alias("_take"))
    return first.join(sizes, F.col(batch).eqNullSafe(F.col("_batch"))).where("place <= _take").drop("_batch", "_take")


def head(df: DataFrame, n: int, order: str) -> DataFrame:
    """The first ``n`` rows by ``order``; each task keeps its own first ones, so no task sorts all."""
    return df.orderBy(order).limit(n)


def coverage(replies: DataFrame, posts: DataFrame, post_key: str) -> DataFrame:
    """Replies, posts with a reply, and their share of all posts."""
    total = posts.agg(F.count("*").alias("n_posts"))
    seen = replies.agg(F.count("*").alias("n_replies"), F.count_distinct(post_key).alias("posts_with_replies"))
    return seen.crossJoin(total).withColumn("share", F.round(F.try_divide(F.col("posts_with_replies").cast("double"), F.col("n_posts")), 3))


def stage_reconciliation(stages: list[tuple[str, DataFrame]]) -> DataFrame:
    """Rows of each stage and the difference to the stage before."""
    counted = [df.agg(F.lit(i).alias("step"), F.lit(name).alias("stage"), F.count("*").alias("n_rows")) for i, (name, df) in enumerate(stages)]
    rows = reduce(DataFrame.unionByName, counted)
    return rows.withColumn("change", F.col("n_rows") - F.lag("n_rows").over(W.orderBy("step")))
