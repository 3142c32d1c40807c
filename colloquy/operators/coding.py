"""Coding of posts by phrases of a codebook, and what follows from the codes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.config import SAFE_ENTITIES
from colloquy.functions import clean, jsonx

QUOTE_CHARS = 60
URL = r"(?i)https?://\S+|\bwww\.\S+"
USERNAME = r"\bu/[A-Za-z0-9_]{3,20}\b"


def lowered(text: Column) -> Column:
    """A text in lower case, character for character: the one letter that would become two (U+0130) becomes a plain i."""
    return F.lower(F.replace(text, F.lit("\u0130"), F.lit("i")))


def code_by_rules(posts: DataFrame, rules: dict[str, tuple[str, ...]], text: str = "text", evidence: bool = True) -> DataFrame:
    """``posts`` with ``deductive_codes``: a code for each rule with a phrase in the text.

    Three distinct phrases or more make the confidence HIGH, two MED, one LOW;
    the evidence is the text from the first phrase of the rule on (null for those
    who only count, with ``evidence`` off). The phrases are constants of the plan,
    so a post is read once by the scan that holds it, and once for each phrase.
    """
    phrases = list(dict.fromkeys(p for of in rules.values() for p in of))
    held = {p: f"_held_{i}" for i, p in enumerate(phrases)}
    low, codes = F.col("_low"), []
    rows = posts.withColumn("_low", lowered(F.coalesce(F.col(text), F.lit("")))).withColumns({c: F.contains(low, F.lit(p)) for p, c in held.items()})
    for code, of in rules.items():
        hits = reduce(Column.__add__, (F.col(held[p]).cast("int") for p in of))
        places = [F.when(F.col(held[p]), F.instr(low, F.lit(p))) for p in of]
        place = F.least(*places) if len(places) > 1 else places[0]
        quote = F.substring(F.col(text), place, F.lit(QUOTE_CHARS)) if evidence else F.lit(None).cast("string")
        level = F.when(hits >= 3, "HIGH").when(hits == 2, "MED").otherwise("LOW")
        one = F.struct(F.lit(code).alias("code"), quote.alias("evidence_quote"), level.alias("confidence"))
        codes.append(F.when(hits > 0, one))
    return rows.withColumn("deductive_codes", F.array_compact(F.array(*codes))).drop("_low", *held.values())


def emergent_phrases(posts: DataFrame, known: list[str], key: str, text: str = "text", codes: str = "deductive_codes", size: int = 2, least_posts: int = 3, most_codes: int = 1) -> DataFrame:
    """Phrases of ``size`` words that recur in posts with few codes and are not in the codebook: phrase, n_posts, first_post."""
    tokens = F.filter(F.split(clean.normalised_text(F.col(text)), " "), lambda w: F.length(w) > 2)
    grams = F.transform(F.sequence(F.lit(1), F.size("_t") - size + 1), lambda i: F.array_join(F.slice("_t", i, size), " "))
    rows = posts.where(F.size(codes) <= most_codes).select(key, tokens.alias("_t")).where(F.size("_t") >= size)
    exploded = rows.select(key, F.explode(F.array_distinct(grams)).alias("phrase"))
    counted = exploded.groupBy("phrase").agg(F.count("*").alias("n_posts"), F.min(key).alias("first_post")).where(F.col("n_posts") >= least_posts)
    return counted.where(~F.col("phrase").isin(*known)) if known else counted


def route(posts: DataFrame, title: str | None, body: str) -> DataFrame:
    """``posts`` with ``route``: why a post is not coded, or ``code``."""
    head = F.col(title) if title else F.lit("")
    skip = F.when(clean.too_short(F.col(body)), "skipped_short_form").when(clean.only_filler(head, F.col(body)), "skipped_filler_content")
    return posts.withColumn("route", skip.when(clean.non_latin(F.concat_ws(" ", head, F.col(body))), "skipped_non_latin").otherwise("code"))


def partition_of(df: DataFrame, machine: str | None, meta: str = "extra_metadata") -> DataFrame:
    """Rows of one machine; rows without a mark belong to machine A."""
    if machine is None:
        return df
    mark = F.get_json_object(meta, "$.machine_partition")
    return df.where(F.coalesce(mark, F.lit("A")) == machine)


def entity_candidates(quotes: Column, safe: tuple[str, ...] | list[str] = SAFE_ENTITIES) -> Column:
    """Capitalised words inside sentences, handles and links in quotes, without names known to be safe."""
    found = F.flatten(F.transform(quotes, lambda q: F.regexp_extract_all(q, F.lit(rf"(?<=[a-z,] )([A-Z][A-Za-z-]{{2,}}(?:'s)?)|({USERNAME})|({URL})"), F.lit(0))))
    bare = F.transform(found, lambda e: F.regexp_replace(e, "'s$", ""))
    return F.array_distinct(F.filter(bare, lambda e: ~F.lower(e).isin(*safe)))


def identifying(quote: Column) -> Column:
    """Whether a quote holds a link, a permalink or a handle."""
    return F.coalesce(quote.rlike(URL) | quote.rlike(USERNAME) | quote.rlike(r"/r/[A-Za-z0-9_]+/comments/"), F.lit(False))


def circuit_breaker(body: Column, codes: Column, layer: Column, n_emergent: Column, entities: Column) -> Column:
    """Flags of a post that a person should look at."""
    length = clean.body_length(body)
    return F.array_compact(
        F.array(
            F.when(length < 100, "SHORT_FORM_BODY"),
            F.when((F.size(codes) == 0) & (length > 250), "NO_CODES_LONG_BODY"),
            F.when(jsonx.all_low(F.transform(codes, lambda c: F.struct(F.upper(c["confidence"]).alias("confidence")))), "ALL_LOW_CONFIDENCE"),
            F.when((layer == "B_emergent") & (n_emergent > 3), "HIGH_EMERGENT_COUNT"),
            F.when(F.size(entities) > 0, "PII_ENTITY_MATCH"),
        )
    )


def assemble(posts: DataFrame, body: str, layer: Column, themes: Column | None = None) -> DataFrame:
    """Coded rows: category, confidence, codes, evidence and flags; ``audit_ok`` tells whether the audit row may be written."""
    codes = F.col("deductive_codes")
    themes = themes if themes is not None else F.array().cast("array<struct<evidence_quote:string>>")
    rows = posts.withColumns(
        {
            "ppm_subcodes": F.transform(codes, lambda c: c["code"]),
            "evidence_quotes": F.concat(F.transform(codes, lambda c: c["evidence_quote"]), F.transform(themes, lambda t: t["evidence_quote"])),
            "confidence": clean.overall_confidence(F.transform(codes, lambda c: F.upper(c["confidence"]))),
        }
    )
    rows = rows.withColumns({"ppm_category": F.when(F.size("ppm_subcodes") == 0, "NONE").otherwise(clean.category(F.col("ppm_subcodes"))), "entities": entity_candidates(F.col("evidence_quotes"))})
    rows = rows.withColumn("circuit_breaker_flags", circuit_breaker(F.col(body), codes, layer, F.size(themes), F.col("entities")))
    return rows.withColumn("audit_ok", ~F.exists("evidence_quotes", lambda q: F.coalesce(q.rlike(USERNAME), F.lit(False))))


def apply_overrides(coded: DataFrame, overrides: DataFrame, batch: str, key: str) -> DataFrame:
    """Notes of a reviewer on the flagged rows of a reviewed batch."""
    notes = overrides.select(batch, F.col("note").alias("_note"))
    hit = F.col("_note").isNotNull() & (F.size("circuit_breaker_flags") > 0)
    return coded.join(notes, batch, "left").withColumns({"override_notes": F.when(hit, F.col("_note")), "researcher_override": hit}).drop("_note")
