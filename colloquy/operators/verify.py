"""Verification of quotes against the text they are said to come from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.config import CODES, EMPTY_CODES
from colloquy.functions import clean, jsonx
from colloquy.functions.similarity import quote_score

THRESHOLD = 90.0


def quote_parts(quote: Column) -> Column:
    """Normalised parts of a quote between ellipses."""
    return F.filter(F.transform(F.split(clean.normalised_text(quote), r"\.\.\."), lambda p: F.trim(p)), lambda p: p != "")


def _grams(text: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - 2, F.lit(1))), lambda i: F.substring(text, i, F.lit(3)))


def score_parts(pairs: DataFrame, part: str = "part", body: str = "body_norm", threshold: float = THRESHOLD) -> DataFrame:
    """``pairs`` with ``score``: 100 where the body holds the part, 0 where too few character 3-grams are shared.

    A score at the threshold leaves at most (1 - t) * 2m edits of a part of m
    characters, and one edit destroys at most three 3-grams, so the early
    rejection loses nothing. Only the texts that are left reach the Arrow function.
    """
    p, b = F.col(part), F.col(body)
    m, n = F.length(p), F.length(b)
    least = F.lit(1 - 6 * (1 - threshold / 100)) * m - 2
    shared = F.size(F.filter(F.array_distinct(_grams(p)), lambda g: F.contains(b, g)))
    distinct = F.size(F.array_distinct(_grams(p)))
    # Repeated 3-grams count once, so the bound is lowered by the repeats.
    hopeless = (m <= n) & (shared < least - (m - 2 - distinct))
    state = F.when(F.contains(b, p), 100.0).when((n == 0) | hopeless, 0.0)
    marked = pairs.withColumn("_sure", state)
    asked = (F.when(F.col("_sure").isNull(), c).otherwise("") for c in (p, b))
    return marked.withColumn("score", F.coalesce("_sure", quote_score(*asked))).drop("_sure")


def verify_quotes(rows: DataFrame, key: str, quote: str, body: str, threshold: float = THRESHOLD) -> DataFrame:
    """(key, quote, verified): an empty quote holds, an empty body holds no quote, every part must reach the threshold."""
    base = rows.select(key, quote, F.coalesce(body, F.lit("")).alias("_body"))
    free = base.where(F.coalesce(quote, F.lit("")) == "").select(key, quote, F.lit(True).alias("verified")).distinct()
    asked = base.where(F.coalesce(quote, F.lit("")) != "").withColumn("_parts", quote_parts(F.col(quote)))
    blank = asked.where("_body = '' or size(_parts) = 0").select(key, quote, (F.col("_body") != "").alias("verified")).distinct()
    parts = asked.where("_body <> '' and size(_parts) > 0").select(key, quote, clean.normalised_text(F.col("_body")).alias("body_norm"), F.explode("_parts").alias("part"))
    scored = score_parts(parts, threshold=threshold).groupBy(key, quote).agg(F.bool_and(F.col("score") >= threshold).alias("verified"))
    return free.unionByName(blank).unionByName(scored)


def clean_rows(rows: DataFrame, key: str, codes: str, quotes: str, body: str, threshold: float = THRESHOLD) -> DataFrame:
    """key, codes_clean, quotes_clean, quarantine_reason of rows with JSON lists of codes and quotes.

    No code at all is an abstention and stays, with an empty set. Otherwise some
    code must be known (``hallucinated_label``) and some known code's quote must
    be found in the body (``unverifiable_quote``).
    """
    pairs = jsonx.paired(jsonx.json_items(F.col(codes)), jsonx.json_items(F.col(quotes)))
    kept = F.filter(F.transform(pairs, lambda p: F.struct(clean.trimmed(p["code"]).alias("code"), p["quote"].alias("quote"))), lambda p: p["code"].isNotNull() & ~F.lower(p["code"]).isin(*EMPTY_CODES))
    base = rows.select(key, F.col(body).alias("_body"), kept.alias("_pairs")).withColumn("_known", F.filter("_pairs", lambda p: clean.valid_code(p["code"], CODES)))
    long = base.select(key, "_body", F.explode("_known").alias("p")).select(key, "_body", F.upper("p.code").alias("code"), F.col("p.quote").alias("quote"))
    checked = verify_quotes(long, key, "quote", "_body", threshold).where("verified")
    good = long.join(checked, [key, "quote"], "left_semi").groupBy(key).agg(F.array_sort(F.collect_set(F.struct("code", "quote"))).alias("_good"))
    out = base.join(good, key, "left")
    reason = F.when(F.size("_pairs") == 0, F.lit(None)).when(F.size("_known") == 0, "hallucinated_label").when(F.col("_good").isNull(), "unverifiable_quote")
    got = F.coalesce("_good", F.array().cast("array<struct<code:string,quote:string>>"))
    return out.select(key, F.array_distinct(F.transform(got, lambda p: p["code"])).alias("codes_clean"), F.transform(got, lambda p: p["quote"]).alias("quotes_clean"), reason.alias("quarantine_reason"))
