"""Personal data: patterns propose spans, checksums confirm them, context scores them.

DataFrame functions only. The patterns are written so that a matcher never reads
a run of characters twice: a run is entered at its start (or where the last match
ended) and never given back. The places of matches are sums of the lengths before
them, taken in blocks of ``BLOCK`` matches and then over blocks, so that the work
on a text grows with its length, however many matches it has.

Edge cases: a null text counts as empty and has no spans, matches of one kind
never overlap, matches of different kinds may, of matches that begin at one place
each kind lists its own, repeated rows are rows of their own, extra columns are
ignored, an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_LOCAL = "A-Za-z0-9._%+-"


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    #: A cheap test that every text with a match passes.
    hint: str
    #: Score of a confirmed span, and the words in the characters around it that add to it.
    score: float
    context: str
    base: bool = False


# The four base kinds, in the order in which spans are listed.
BASE_KINDS = (
    Kind("email", rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.8, "mail|contact|write|reach", True),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".", 0.6, "ip|host|server|address|login", True),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", "", 0.7, "card|visa|credit|payment|account", True),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", 0.7, "tel|phone|call|mobile|fax", True),
)
ADDED_KINDS = (
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", "", 0.8, "iban|account|bank|konto|compte|cuenta"),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "-", 0.4, "ssn|social security|tax"),
    Kind("secret", r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}(?![A-Za-z0-9])|(?:password|passwd|secret|token|api_key)\x20?=\x20?\"?[A-Za-z0-9_-]{8,}+\"?)", "", 0.7, "key|password|token|secret"),
)
CONTEXT_CHARS = 40
BLOCK = 256
CONTEXT_GAIN = 0.3
LEAST_SCORE = 0.6


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _mod97(text: Column) -> Column:
    """Remainder of an account number, letters read as 10 to 35 and the first four signs moved to the end."""
    plain = F.replace(text, F.lit(" "), F.lit(""))
    signs = F.split(F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4)), "")

    def step(rest: Column, sign: Column) -> Column:
        letter = sign.rlike("[A-Z]")
        value = F.when(letter, F.ascii(sign) - 55).when(sign == "", 0).otherwise(F.ascii(sign) - 48)
        return F.when(sign == "", rest).otherwise((rest * F.when(letter, 100).otherwise(10) + value) % 97)

    return F.aggregate(signs, F.lit(0), step)


def confirmed(kind: str, text: Column) -> Column:
    """Whether a proposed match holds."""
    if kind == "ip":
        return F.forall(F.split(text, r"\."), lambda part: part.cast("double") <= 255)
    if kind == "card":
        return F.length(_digits(text)).between(16, 19) & F.call_function("luhn_check", _digits(text))
    if kind == "phone":
        return F.length(_digits(text)).between(8, 15)
    if kind == "iban":
        return _mod97(text) == 1
    return F.lit(True)


def _steps(found: Column, gaps: Column) -> Column:
    """Matches in order, each with the text between it and the one before, and with the text up to the next."""
    zipped = F.arrays_zip(found.alias("match"), gaps.alias("gap"), F.slice(gaps, 2, F.greatest(F.size(gaps), F.lit(1))).alias("after"))
    near = F.filter(zipped, lambda z: z["match"].isNotNull())
    return F.transform(near, lambda z: F.struct(z["match"], z["gap"], F.substring(z["after"], 1, CONTEXT_CHARS).alias("after")))


def _blocks(steps: Column) -> Column:
    """For each block of matches: its length in code points, its last characters, and for each match its start and what precedes it, seen from the block."""

    def last(text: Column) -> Column:
        return F.when(F.length(text) > CONTEXT_CHARS, F.substring(text, -CONTEXT_CHARS, CONTEXT_CHARS)).otherwise(text)

    def step(state: Column, one: Column) -> Column:
        start = state["at"] + F.length(one["gap"])
        before = last(F.concat(state["tail"], one["gap"]))
        place = F.struct(start.alias("start"), before.alias("before"))
        return F.struct((start + F.length(one["match"])).alias("at"), last(F.concat(before, one["match"])).alias("tail"), F.concat(state["places"], F.array(place)).alias("places"))

    first = F.struct(F.lit(0).alias("at"), F.lit("").alias("tail"), F.array().cast("array<struct<start:int,before:string>>").alias("places"))
    numbers = F.when(F.size(steps) > 0, F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / BLOCK).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.transform(numbers, lambda b: F.aggregate(F.slice(steps, b * BLOCK + 1, BLOCK), first, step))


def _places(blocks: Column) -> Column:
    """The start of every match in its text, and the characters before it. A full block is longer than what is asked of the one before."""
    ends = F.aggregate(blocks, F.array(F.lit(0)), lambda sums, b: F.concat(sums, F.array(F.element_at(sums, -1) + b["at"])))
    tails = F.concat(F.array(F.lit("")), F.transform(blocks, lambda b: b["tail"]))
    zipped = F.filter(F.arrays_zip(blocks.alias("block"), ends.alias("end"), tails.alias("tail")), lambda z: z["block"].isNotNull())

    def place(z: Column, p: Column) -> Column:
        return F.struct((z["end"] + p["start"]).alias("start"), F.lower(F.substring(F.concat(z["tail"], p["before"]), -CONTEXT_CHARS, CONTEXT_CHARS)).alias("before"))

    return F.flatten(F.transform(zipped, lambda z: F.transform(z["block"]["places"], lambda p: place(z, p))))


def _spans(steps: Column, places: Column, kind: Kind) -> Column:
    """array<struct<kind, start, end, match, score>> of one kind; base spans stay whatever their score."""
    valid = F.filter(F.arrays_zip(steps.alias("step"), places.alias("place")), lambda z: confirmed(kind.name, z["step"]["match"]))

    def scored(z: Column) -> Column:
        near = z["place"]["before"].rlike(kind.context) | F.lower(z["step"]["after"]).rlike(kind.context)
        score = F.lit(kind.score) + F.when(near, CONTEXT_GAIN).otherwise(0.0)
        start, match = z["place"]["start"], z["step"]["match"]
        return F.struct(F.lit(kind.name).alias("kind"), start.alias("start"), (start + F.length(match)).alias("end"), match.alias("match"), F.least(score, F.lit(1.0)).alias("score"))

    spans = F.transform(valid, scored)
    return spans if kind.base else F.filter(spans, lambda s: s["score"] >= LEAST_SCORE)


def find_spans(docs: DataFrame) -> DataFrame:
    """``docs`` with one array column of spans for each kind, named ``pii_<kind>``."""
    kinds, text = (*BASE_KINDS, *ADDED_KINDS), F.coalesce(F.col("text"), F.lit(""))
    none = F.array().cast("array<string>")

    def each(prefix: str, make) -> dict[str, Column]:
        return {f"{prefix}{k.name}": make(k) for k in kinds}

    def possible(k: Kind) -> Column:
        return F.contains(text, F.lit(k.hint)) & text.rlike(k.pattern) if k.hint else text.rlike(k.pattern)

    # Columns of their own, so that nothing is worked out again for every match.
    found = docs.withColumns(each("_found_", lambda k: F.when(possible(k), F.regexp_extract_all(text, F.lit(k.pattern), F.lit(0))).otherwise(none)))
    found = found.withColumns(each("_gaps_", lambda k: F.when(F.size(f"_found_{k.name}") > 0, F.split(text, k.pattern, -1)).otherwise(none)))
    found = found.withColumns(each("_steps_", lambda k: _steps(F.col(f"_found_{k.name}"), F.col(f"_gaps_{k.name}"))))
    found = found.withColumns(each("_blocks_", lambda k: _blocks(F.col(f"_steps_{k.name}"))))
    found = found.withColumns(each("_places_", lambda k: _places(F.col(f"_blocks_{k.name}"))))
    found = found.withColumns(each("pii_", lambda k: _spans(F.col(f"_steps_{k.name}"), F.col(f"_places_{k.name}"), k)))
    return found.select(*docs.columns, *each("pii_", str))


def joined(kinds: tuple[Kind, ...]) -> Column:
    parts = [F.transform(F.col(f"pii_{k.name}"), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))) for k in kinds]
    return F.array_join(F.concat(*parts), ",")


def pii_digest(docs: DataFrame) -> DataFrame:
    counts = [F.size(f"pii_{k.name}").cast("long").alias(f"n_{k.name}") for k in BASE_KINDS]
    found = find_spans(docs.select("doc_id", "text"))
    return found.select("doc_id", *counts, F.lower(F.sha2(joined(BASE_KINDS), 256)).alias("base_sha256"), joined((*BASE_KINDS, *ADDED_KINDS)).alias("spans"))
