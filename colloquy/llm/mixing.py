"""Mixing sources to target weights, with DataFrame functions only.

Every row gets a hash-random key. A source's rows are dealt into key ranges,
sorted inside each range, and the sums of the ranges before give each row the
exact number of words ahead of it: a prefix sum without a task that holds a
whole source. A source is taken in whole epochs while its target allows, then
cut at the exact word that fills the target.

Edge cases: a null text has size 0, a null source is a source of its own (last
in the order), a source without words has target 0, rows repeated in full are
rows of their own, a row without a doc_id has a key made of its text, of rows with
one key the smaller one comes first, extra columns are ignored, an empty table
gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colloquy.llm.storage import spool

WORD = r"[^\x20\x09-\x0D]+"
ROWS_PER_RANGE = 2_000
MOST_EPOCHS = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _placed(totals: DataFrame) -> DataFrame:
    """``totals`` with ``place``, the number of sources before each in their order; the ranges of a sort are counted one by one."""
    ordered = spool(totals.orderBy(F.col("source").asc_nulls_last()).withColumn("at", F.monotonically_increasing_id()), "sources")
    ordered = ordered.withColumn("part", F.shiftright("at", 33))
    # One row for each range of the sort.
    before = F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    sizes = ordered.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(before, F.lit(0)).alias("before"))
    return ordered.join(sizes, "part").select("source", "total", (F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1)).alias("place"))


def targets(totals: DataFrame) -> DataFrame:
    """(source, total) to (source, total, target).

    Weights are 1, 2, 3, repeating, in the order of sources. The shares of the
    grand total stop at ``MOST_EPOCHS`` times a source; what is shared again gives
    every open source the same level for each unit of weight. A source is closed
    where its cap is below that level, which raises the level for the others,
    until no more sources close. Only sums over the sources reach the driver.
    """
    t = _placed(totals).withColumn("weight", (F.col("place") % 3 + 1).cast("double")).withColumn("cap", (F.col("total") * MOST_EPOCHS).cast("double"))
    t = spool(t.withColumn("ratio", F.col("cap") / F.col("weight")), "targets")
    level, closed = 0.0, -1
    while True:
        is_closed = F.col("ratio") < level
        sums = t.agg(
            F.coalesce(F.sum("total"), F.lit(0)).cast("double").alias("words"),
            F.coalesce(F.sum(F.when(is_closed, F.col("cap"))), F.lit(0.0)).alias("cap"),
            F.coalesce(F.sum(F.when(~is_closed, F.col("weight"))), F.lit(0.0)).alias("weight"),
            F.count(F.when(is_closed, 1)).alias("closed"),
        ).first()
        if sums.closed == closed or not sums.weight:
            break
        level, closed = (sums.words - sums.cap) / sums.weight, sums.closed
    return t.select("source", "total", F.least("cap", level * F.col("weight")).alias("target"))


def mix_sources(docs: DataFrame, seed: int = 0, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of ``docs``."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce(F.col("text"), F.lit(""))))
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), name))
    rows = spool(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), key.alias("key")), "mix")
    digits = max(1, math.ceil(math.log(max(1, rows.count() / rows_per_range), 16)))
    rows = rows.withColumn("range", F.substring("key", 1, digits))
    plan = targets(rows.groupBy("source").agg(F.sum("size").alias("total")))

    # Sums of the ranges before, in two steps, so that no task holds all ranges of a source.
    wide = F.substring("range", 1, (digits + 1) // 2).alias("wide")
    sums = rows.groupBy("source", "range").agg(F.sum("size").alias("words")).select("source", "range", wide, "words")
    in_wide = W.partitionBy("source", "wide").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    of_wide = W.partitionBy("source").orderBy("wide").rowsBetween(W.unboundedPreceding, -1)
    near = sums.select("source", "range", "wide", F.coalesce(F.sum("words").over(in_wide), F.lit(0)).alias("near"))
    far = sums.groupBy("source", "wide").agg(F.sum("words").alias("words"))
    far = far.select("source", "wide", F.coalesce(F.sum("words").over(of_wide), F.lit(0)).alias("far"))
    offsets = near.alias("n").join(far.alias("f"), F.col("n.source").eqNullSafe(F.col("f.source")) & (F.col("n.wide") == F.col("f.wide")))
    offsets = offsets.select("n.source", "n.range", (F.col("near") + F.col("far")).alias("offset"))
    inside = W.partitionBy("source", "range").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    placed = rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))

    p = placed.alias("p").join(offsets.alias("o"), F.col("p.source").eqNullSafe(F.col("o.source")) & (F.col("p.range") == F.col("o.range")))
    p = p.join(plan.alias("t"), F.col("p.source").eqNullSafe(F.col("t.source")))
    budget = F.round("t.target").cast("long")
    epochs = F.when(F.col("t.total") > 0, F.floor(budget / F.col("t.total"))).otherwise(F.lit(0))
    rest = budget - epochs * F.col("t.total")
    begins = F.col("o.offset") + F.col("p.inside")
    cut = F.least(F.col("p.size"), F.greatest(F.lit(0), rest - begins))
    return p.select(
        F.col("p.doc_id").alias("doc_id"),
        F.col("p.size").alias("size"),
        F.col("t.total").alias("source_size"),
        F.col("t.target").alias("target"),
        (epochs * F.col("p.size") + cut).cast("long").alias("taken"),
    )


def mixed_documents(docs: DataFrame, seed: int = 0) -> DataFrame:
    """The rows of the mix with the columns of ``docs``: each as often as its taken words need it, whole."""
    times = F.ceil(F.col("taken") / F.col("size")).cast("int")
    taken = mix_sources(docs, seed).where("taken > 0").select(F.col("doc_id").alias("d"), F.col("size").alias("s"), times.alias("times"))
    # Rows that repeat a doc_id share what they take together.
    per_row = taken.groupBy("d", "s").agg(F.ceil(F.sum("times") / F.count("*")).cast("int").alias("times"))
    keyed = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), word_count(F.col("text")).alias("words"))
    out = keyed.join(per_row, F.col("id").eqNullSafe(F.col("d")) & (F.col("words") == F.col("s")))
    return out.select("row", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")
