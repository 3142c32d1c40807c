"""Codes, communities, thresholds and caps. Operators take them as parameters; these are the defaults."""

from __future__ import annotations

from dataclasses import dataclass, field

# The active codes, in report order, and the four dimensions.
DIMENSIONS = ("PUSH", "PULL", "MOOR-F", "MOOR-I")
CODES_PER_DIMENSION = {"PUSH": 7, "PULL": 7, "MOOR-F": 4, "MOOR-I": 6}
CODES = tuple(f"{d}-{i:02d}" for d in DIMENSIONS for i in range(1, CODES_PER_DIMENSION[d] + 1))
DIMENSION_OF = {c: c[:-3] for c in CODES} | {d: d for d in DIMENSIONS}

# The communities that the default configuration reports on, and their ids in exports.
COMMUNITY_IDS = {
    "t5_2r81c": "Nootropics",
    "t5_2qhb8": "Supplements",
    "t5_2v89v": "Decaf",
    "t5_2vnoe": "Biohackers",
    "t5_4aoxhu": "NooTopics",
    "t5_2ttk1": "StackAdvice",
}
ARCHETYPES = {
    "NooTopics": "Facilitator-Embedded Wellness Seeker",
    "Supplements": "Facilitator-Embedded Wellness Seeker",
    "Biohackers": "Self-Directed Natural Optimiser",
    "Nootropics": "Self-Directed Natural Optimiser",
    "StackAdvice": "Self-Directed Natural Optimiser",
    "Decaf": "Caffeine/Stimulant Escapee",
}

# Texts that stand for "no value", phrases that say nothing, names that are no persons.
NULL_WORDS = ("", "NaN", "nan", "None", "none", "null", "NULL")
EMPTY_CODES = ("[empty]", "empty", "none", "")
FILLER_PHRASES = ("thanks", "thank you", "lol", "lmao", "rofl", "bump", "agree", "disagree", "this", "same", "same here", "me too", "so true", "true", "yes", "no", "exactly", "interesting", "cool", "nice", "wow", "following", "upvoted", "upvote")
SAFE_ENTITIES = (
    "modafinil", "adderall", "vyvanse", "ritalin", "valium", "strattera", "sertraline", "pregabalin", "phenibut", "l-theanine", "theanine",
    "sulforaphane", "cdp", "nac", "alcar", "sam-e", "selegiline", "armodafinil", "lion", "mango", "gi", "ect", "legit", "datablood", "kratom", "kw",
    "alphagpc", "ashwagandha", "rhodiola", "boswellia", "frankincense", "sulbutiamine", "pyridoxine", "ldx", "adaptogens", "invicorp", "fda", "nih",
    "alpha gpc",
)
FORBIDDEN_COLUMNS = ("raw_prompt", "raw_response", "text", "title", "selftext", "author", "author_id", "username", "body")
COLLECTION_META = ("id", "session_id", "collected_at", "extra_metadata")
OLD_SOURCES = ("PRAW", "JSON_endpoint", "praw", "json_endpoint")

# The patterns of the keyword filter, by group.
KEYWORD_GROUPS = {
    "switching": r"switched from|quit caffeine|started nootropics|replacing adderall|moved to|instead of|alternative to|gave up",
    "push": r"caffeine crash|jitters|anxiety from|tolerance|side effects|dependency|withdrawal|energy crash",
    "pull": r"cognitive benefits|focus improvement|mental clarity|natural alternative|lion'?s mane|rhodiola|bacopa|ashwagandha|omega[- ]?3|l[- ]?theanine|matcha|mushroom coffee|ginkgo|creatine",
    "mooring": r"is this safe|interaction|dosage|rate my stack|combine|negative interaction|how long|too much|tolerance break|cycling|am i taking|where to buy|is it worth",
}


@dataclass(frozen=True)
class Thresholds:
    push_bias: float = 0.20
    moor_lower: float = 0.15
    low_confidence: float = 0.30
    body_length: int = 150
    label_score: float = 85.0
    quote_score: float = 90.0
    least_posts_of_theme: int = 2
    suppress_below: int = 10


@dataclass(frozen=True)
class QualityGate:
    """Least score and trimmed length in general, and for communities that are treated leniently."""

    score: int = 50
    length: int = 250
    lenient_score: int = 25
    lenient_length: int = 50
    lenient: tuple[str, ...] = field(default_factory=tuple)


@dataclass(frozen=True)
class Caps:
    """Posts kept from each third of a community, best first."""

    layer_a: tuple[int, int, int] = (20, 20, 20)
    layer_b: tuple[int, int, int] = (17, 16, 17)
    per_community: int = 35
