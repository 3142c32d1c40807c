"""Merging of labels that are nearly the same."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.functions.similarity import label_score
from colloquy.shared import shared_folder


def _settled(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder."""
    context, folder = df.sparkSession.sparkContext, shared_folder(df.sparkSession)
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return df.checkpoint()


def _tidy(label: Column) -> Column:
    return F.array_join(F.array_sort(F.split(F.trim(F.regexp_replace(label, r"\s+", " ")), " ")), " ")


def most_edits(short: int, long: int, threshold: float, metric: str = "indel") -> int:
    """Edits between labels of two lengths that a score at the threshold allows; an indel edit inserts or removes a character."""
    room = short + long if metric == "indel" else long
    return math.floor(room * (100 - threshold) / 100 + 1e-9)


def segments(length: int, edits: int) -> list[tuple[int, int]]:
    """(start, end) of ``edits`` + 1 segments of a label: with so many edits at most, one of them is left alone."""
    cuts = [length * k // (edits + 1) for k in range(edits + 2)]
    return list(zip(cuts, cuts[1:], strict=False))


def _keys_of(label: str, threshold: float, metric: str, longest: int) -> Iterator[tuple[int, int, int, str]]:
    """Keys of a label as the shorter of a pair: its length, the number of edits, a segment's number and its text."""
    size = len(label)
    ways = {most_edits(size, other, threshold, metric) for other in range(size, longest + 1) if other - size <= most_edits(size, other, threshold, metric)}
    for edits in ways:
        if size <= edits:
            yield size, edits, -1, ""
        else:
            for k, (at, end) in enumerate(segments(size, edits)):
                yield size, edits, k, label[at:end]


def _probes_of(label: str, threshold: float, metric: str, lengths: set[int]) -> Iterator[tuple[int, int, int, str]]:
    """Keys that a label has in common with every shorter or equal one it may be similar to.

    If the edits before segment k are as many as k and those after it no more than are
    left, the segment is moved by at most so many places; some untouched segment is so.
    """
    size = len(label)
    for other in lengths:
        edits, extra = most_edits(other, size, threshold, metric), size - other
        if not 0 <= extra <= edits:
            continue
        if other <= edits:
            yield other, edits, -1, ""
            continue
        for k, (at, end) in enumerate(segments(other, edits)):
            for move in range(max(-k, extra - (edits - k)), min(k, extra + edits - k) + 1):
                if 0 <= at + move and end + move <= size:
                    yield other, edits, k, label[at + move : end + move]


def label_candidates(labels: DataFrame, threshold: float, metric: str = "indel") -> DataFrame:
    """(a, b, ta, tb): pairs of distinct labels that may reach the threshold, each once; t* are the labels with their words in order."""
    tidy = labels.select("label").where("label is not null").distinct().withColumn("tidy", _tidy(F.col("label")))
    lengths = {r.n for r in tidy.select(F.length("tidy").alias("n")).distinct().collect()}  # as many as there are lengths of labels
    longest = max(lengths, default=0)
    schema = "label string, tidy string, size int, edits int, segment int, piece string"

    def keyed(make, *rest):
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in frames:
                rows = [(label, text, *key) for label, text in zip(pdf["label"], pdf["tidy"], strict=True) for key in dict.fromkeys(make(text, threshold, metric, *rest))]
                yield pd.DataFrame(rows, columns=["label", "tidy", "size", "edits", "segment", "piece"])

        return tidy.mapInPandas(run, schema)

    a, b = keyed(_keys_of, longest).alias("a"), keyed(_probes_of, lengths).alias("b")
    same = reduce(Column.__and__, (F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("size", "edits", "segment", "piece")))
    once = (F.length("b.tidy") > F.col("a.size")) | (F.col("a.label") < F.col("b.label"))
    pairs = a.join(b, same & once & (F.col("a.label") != F.col("b.label")))
    return pairs.select(F.col("a.label").alias("a"), F.col("b.label").alias("b"), F.col("a.tidy").alias("ta"), F.col("b.tidy").alias("tb")).distinct()


def similar_pairs(labels: DataFrame, threshold: float = 85.0, metric: str = "indel") -> DataFrame:
    """(a, b, score) of distinct labels that reach the threshold (over 0), both ways.

    Labels meet on segments: of the few edits that the threshold leaves between two
    lengths, one more segment than edits must keep one of them whole, about where it
    was. The lower the threshold, the shorter the segments and the more labels meet.
    """
    if threshold <= 0:
        raise ValueError("similar_pairs needs a threshold over 0")
    pairs = label_candidates(labels, threshold, metric)
    if metric == "levenshtein":
        longest = F.greatest(F.length("ta"), F.length("tb"))
        score = F.when(longest == 0, 100.0).otherwise((1 - F.levenshtein("ta", "tb") / longest) * 100)
    else:
        score = label_score("ta", "tb")
    scored = pairs.withColumn("score", score).where(F.col("score") >= threshold).select("a", "b", "score")
    return scored.unionByName(scored.select(F.col("b").alias("a"), F.col("a").alias("b"), "score"))


def canonical_labels(rows: DataFrame, label: str, seq: str, threshold: float = 85.0, metric: str = "indel") -> DataFrame:
    """(label, canonical) for every distinct label.

    Taken in order of ``seq``, a label joins the best similar label that leads,
    or leads itself: the lexicographically first maximal independent set of the
    similarity graph, found in parallel rounds (Blelloch et al. 2012). A label
    leads once all similar ones before it do not, and does not once one of them
    does. A member goes to its most similar leader among those seen no later
    than its own last place; of equals to the shorter, then the earlier.
    """
    named = rows.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("label")).agg(F.min(seq).alias("first"), F.max(seq).alias("last"))
    pairs = _settled(similar_pairs(named, threshold, metric))
    state = _settled(named.withColumn("leads", F.lit(None).cast("boolean")))
    order = named.select("label", "first")
    ahead = pairs.join(order.withColumnsRenamed({"label": "a", "first": "fa"}), "a").join(order.withColumnsRenamed({"label": "b", "first": "fb"}), "b").where("fb < fa or (fb = fa and b < a)").select("a", "b")
    ahead = _settled(ahead)
    while not state.where("leads is null").isEmpty():
        known = state.select(F.col("label").alias("b"), F.col("leads").alias("other"))
        votes = ahead.join(known, "b").groupBy("a").agg(F.bool_or(F.coalesce("other", F.lit(False))).alias("led"), F.bool_and(F.coalesce(~F.col("other"), F.lit(False))).alias("free"))
        turn = state.join(votes, state.label == votes.a, "left")
        decided = F.when(F.col("leads").isNotNull(), F.col("leads")).when(F.coalesce("led", F.lit(False)), False).when(F.coalesce("free", F.lit(True)), True)
        state = _settled(turn.select("label", "first", "last", decided.alias("leads")))
    leaders = state.where("leads").select(F.col("label").alias("b"), F.col("first").alias("lead_first"))
    options = state.where("not leads").join(pairs, F.col("label") == F.col("a")).join(leaders, "b").where("lead_first <= last")
    best = options.groupBy("label").agg(F.max_by("b", F.struct("score", (-F.length("b")).alias("short"), (-F.col("lead_first")).alias("early"))).alias("canonical"))
    return state.where("leads").select("label", F.col("label").alias("canonical")).unionByName(best)
