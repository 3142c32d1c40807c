"""Cleaning of single values, as column expressions."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from colloquy.config import CODES, EMPTY_CODES, FILLER_PHRASES, NULL_WORDS


def trimmed(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def score(x: Column) -> Column:
    """Whole number of a text, towards zero; 0 for what is no finite number in range."""
    return F.coalesce(x.try_cast("double").try_cast("int"), F.lit(0))


def ratio(x: Column) -> Column:
    return F.round(trimmed(x).try_cast("double"), 6)


def flag(x: Column) -> Column:
    return F.coalesce(F.lower(trimmed(x)) == "true", F.lit(False))


def text_field(x: Column) -> Column:
    return F.when(~trimmed(x).isin(*NULL_WORDS), trimmed(x))


def permalink(x: Column) -> Column:
    return F.regexp_replace(x, "^/+", "")


def parent_id(x: Column) -> Column:
    return text_field(x)


def utc_seconds(x: Column) -> Column:
    """Midnight UTC of an ISO date, 0.0 for anything else."""
    iso = F.when(trimmed(x).rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), trimmed(x))
    return F.coalesce(F.unix_date(F.try_to_date(iso, "yyyy-MM-dd")).cast("double") * 86400.0, F.lit(0.0))


def tertile(x: Column, default: int | None = None) -> Column:
    parsed = F.when(x.rlike("^[0-9]+$"), x.try_cast("int"))
    return parsed if default is None else F.coalesce(parsed, F.lit(default))


def first_filled(*columns: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns))


def post_metadata(kind: Column, meta: dict[str, Column]) -> Column:
    """JSON of the metadata that rows of a kind carry."""
    post = ("corpus_layer", "source", "tertile", "upvote_ratio", "nsfw", "locked", "flair_text", "subreddit_id")
    reply = ("corpus_layer", "source", "tertile", "gilded", "parent_id", "subreddit_id")

    def pack(names: tuple[str, ...]) -> Column:
        return F.to_json(F.struct(*(meta[n].alias(n) for n in names if n in meta)))

    return F.when(kind == "submission", pack(post)).otherwise(pack(reply))


def defaulted(x: Column, default: str) -> Column:
    return F.coalesce(x, F.lit(default))


def iso_date(seconds: Column) -> Column:
    return F.when(seconds > 0, F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd"))


def year_of(seconds: Column) -> Column:
    return F.when(seconds > 0, F.year(F.timestamp_seconds(seconds)))


def with_prefix(x: Column, prefix: str = "t3_") -> Column:
    return F.when(x.startswith(prefix), x).otherwise(F.concat(F.lit(prefix), x))


def without_prefix(x: Column, prefix: str = "t3_") -> Column:
    return F.regexp_replace(x, f"^{prefix}", "")


def kind_of(x: Column) -> Column:
    return F.when(x.startswith("t3_"), "submission").when(x.startswith("t1_"), "comment")


def body_length(x: Column) -> Column:
    return F.length(F.coalesce(x, F.lit("")))


def shortened(x: Column, most: int, mark: str = "…") -> Column:
    return F.when(F.length(x) > most, F.concat(F.left(x, F.lit(most)), F.lit(mark))).otherwise(x)


def word_count(x: Column) -> Column:
    """Words between runs of white space."""
    return F.when(trimmed(x) == "", 0).otherwise(F.size(F.split(trimmed(x), r"\s+")))


def space_parts(x: Column) -> Column:
    """Parts between single spaces, empty ones too: the count that the quality gate uses."""
    return F.size(F.split(x, " "))


def percent(n: Column, total: Column) -> Column:
    return F.coalesce(F.try_divide(n * 100.0, total), F.lit(0.0))


def rounded(x: Column, digits: int) -> Column:
    """A number from 0 to 1000 rounded to 0 to 2 digits by its binary value: the nearer one, and the even one only of exact ties.

    The value is a whole number over a power of two, so integers decide.
    """
    bits = F.greatest(F.least(F.lit(52) - F.floor(F.log2(F.greatest(x, F.lit(1e-9)))), F.lit(62)), F.lit(1)).cast("int")
    scaled = (x * F.pow(F.lit(2.0), bits)).cast("long") * 10**digits
    low = F.call_function("shiftright", scaled, bits)
    rest = scaled - F.call_function("shiftleft", low, bits)
    half = F.call_function("shiftleft", F.lit(1).cast("long"), bits - 1)
    return (low + F.when((rest > half) | ((rest == half) & (low % 2 == 1)), 1).otherwise(0)) / 10**digits


def cell(n: Column, total: Column, suppress_below: int = 10) -> Column:
    """Count and percentage for display, starred when the count is small."""
    shown = F.format_string("%d (%.1f%%)", n, rounded(percent(n, total), 1))
    return F.concat(shown, F.when(n < suppress_below, "*").otherwise(""))


def percent_text(n: Column, total: Column) -> Column:
    return F.format_string("%.2f%%", rounded(percent(n, total), 2))


def filled_codes(codes: Column) -> Column:
    return F.filter(F.transform(codes, trimmed), lambda c: c.isNotNull() & ~F.lower(c).isin(*EMPTY_CODES))


def valid_code(code: Column, codes: tuple[str, ...] = CODES) -> Column:
    upper = F.upper(trimmed(code))
    return F.coalesce(upper.isin("NONE", "", *codes) | upper.startswith("EMER-") | upper.startswith("EMERGENT"), F.lit(False)) & (code != "")


def marked(x: Column) -> Column:
    return F.coalesce(F.lower(trimmed(x)).isin("1", "1.0", "x", "true", "yes"), F.lit(False))


def agreement_band(kappa: Column) -> Column:
    return (
        F.when(kappa.isNull() | F.isnan(kappa), "N/A")
        .when(kappa < 0, "Poor")
        .when(kappa < 0.20, "Slight")
        .when(kappa <= 0.40, "Fair")
        .when(kappa <= 0.60, "Moderate")
        .when(kappa <= 0.80, "Substantial")
        .otherwise("Almost perfect")
    )


def category(codes: Column) -> Column:
    """One category for a row's codes, by what stands before the first hyphen."""
    heads = F.array_distinct(F.transform(codes, lambda c: F.split_part(c, F.lit("-"), F.lit(1))))
    head = F.get(heads, F.lit(0))
    named = F.when(head == "PUSH", "Push").when(head == "PULL", "Pull").when(head == "MOOR", "Mooring").otherwise("Unknown")
    return F.when(F.size(heads) > 1, "Mixed").otherwise(named)


def overall_confidence(levels: Column) -> Column:
    return F.when(F.array_contains(levels, "LOW"), "LOW").when(F.array_contains(levels, "MED"), "MED").when(F.size(levels) > 0, "HIGH").otherwise("N/A")


def pseudonymous(author: Column) -> Column:
    """Whether an author name is one that may be stored."""
    known = author.isin("[deleted]", "[removed]") | author.rlike("^[0-9a-fA-F]{32,}$") | author.startswith("anon_") | author.startswith("pseudonym_")
    return author.isNull() | known


def pseudonym(author: Column, policy: str = "null") -> Column:
    return F.sha2(author, 256) if policy == "hash" else F.lit(None).cast("string")


def fingerprint(parameters: dict) -> str:
    """16 hex digits that name a set of parameters, whatever the order of its keys."""
    return hashlib.sha256(json.dumps(parameters, sort_keys=True, default=str).encode()).hexdigest()[:16]


def row_fingerprint(*columns: str) -> Column:
    return F.left(F.sha2(F.to_json(F.struct(*sorted(columns))), 256), F.lit(16))


def fenced_json(response: Column) -> Column:
    """The JSON of a model's answer: what the last fenced block holds, or the whole; ``{}`` if that is no JSON."""
    parts = F.split(response, "```(?:json)?")
    inner = F.when(F.size(parts) >= 3, F.element_at(parts, -2)).otherwise(response)
    return F.when(F.try_parse_json(trimmed(inner)).isNotNull(), trimmed(inner)).otherwise("{}")


# -- text ----------------------------------------------------------------------------------------


def normalised_text(x: Column) -> Column:
    """Lower case, plain quotes and dashes, nothing but ``[a-z0-9 '.-]``, single spaces."""
    plain = F.translate(F.lower(x), "’‘“”—–é ", "''\"\"--e ")
    for many, few in (("…", "..."), ("æ", "ae"), ("œ", "oe")):
        plain = F.replace(plain, F.lit(many), F.lit(few))
    return F.coalesce(F.trim(F.regexp_replace(F.regexp_replace(plain, r"[^a-z0-9\s'.-]", " "), r"\s+", " ")), F.lit(""))


def too_short(body: Column, least: int = 40) -> Column:
    return F.length(F.coalesce(trimmed(body), F.lit(""))) < least


def only_filler(title: Column, body: Column) -> Column:
    """Whether title and body (without labels) hold nothing but a stock phrase or emoji."""
    text = F.concat_ws(" ", title, body)
    plain = F.regexp_replace(F.regexp_replace(text, r"[\x{10000}-\x{10FFFF}]", ""), r"(?U)[^\w\s]", "")
    words = F.trim(F.regexp_replace(F.lower(plain), r"(?U)\s+", " "))
    return words.isin("", *FILLER_PHRASES)


def ascii_share(x: Column) -> Column:
    return F.try_divide(F.length(F.regexp_replace(x, r"[^\x00-\x7F]", "")).cast("double"), F.length(x))


def non_latin(x: Column, least: float = 0.70) -> Column:
    return F.coalesce(ascii_share(x) < least, F.lit(False))
