"""JSON texts, arrays and maps, as column expressions that never raise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.functions.clean import trimmed
from colloquy.schemas import DEDUCTIVE_CODE, EMERGENT_CANDIDATE


def json_items(x: Column) -> Column:
    """Elements of a JSON list as JSON texts; an empty array for anything else."""
    return F.coalesce(F.from_json(x, "array<string>"), F.array().cast("array<string>"))


def _objects(x: Column, kind: str) -> Column:
    objects = F.filter(json_items(x), lambda e: F.coalesce(F.try_parse_json(e), F.parse_json(F.lit("0"))).isNotNull() & e.startswith("{"))
    return F.transform(objects, lambda e: F.from_json(e, kind))


def parse_codes(x: Column) -> Column:
    """array<deductive code>; elements that are no objects are dropped."""
    return _objects(x, DEDUCTIVE_CODE)


def parse_themes(x: Column) -> Column:
    return _objects(x, EMERGENT_CANDIDATE)


def json_or(x: Column, default: str) -> Column:
    return F.when(F.try_parse_json(x).isNotNull(), x).otherwise(default)


def json_list_or_empty(x: Column) -> Column:
    return json_or(x, "[]")


def json_is(x: Column, path: str, value: str) -> Column:
    return F.coalesce(F.get_json_object(x, path) == value, F.lit(False))


def code_set(x: Column) -> Column:
    """Distinct upper-case codes of a JSON list of texts or of objects with a code."""

    def one(e: Column) -> Column:
        return F.upper(trimmed(F.when(e.startswith("{"), F.get_json_object(e, "$.code")).otherwise(e)))

    return F.array_distinct(F.filter(F.transform(json_items(x), one), lambda c: c.isNotNull() & (c != "")))


def paired(codes: Column, quotes: Column) -> Column:
    """array<struct<code, quote>> by place; missing quotes are empty, spare ones are left out."""
    held = F.coalesce(quotes, F.array().cast("array<string>"))
    return F.transform(codes, lambda c, i: F.struct(c.alias("code"), F.coalesce(F.get(held, i), F.lit("")).alias("quote")))


def confidence_of(code: Column, pairs: Column, default: str = "HIGH") -> Column:
    """The last confidence that a list of (code, confidence) gives a code."""
    own = F.filter(pairs, lambda p: p["code"] == code)
    return F.coalesce(F.get(own, F.size(own) - 1)["confidence"], F.lit(default))


def explode_codes(df: DataFrame, dimensions: DataFrame, codes: str = "codes") -> DataFrame:
    """One row for each code of a post, and one with a null code for a post without any."""
    rows = df.withColumn("code", F.explode_outer(codes))
    # The code table has one row for each code of the codebook.
    return rows.join(F.broadcast(dimensions), "code", "left")


def explode_themes(df: DataFrame, themes: str = "themes") -> DataFrame:
    """One row for each theme with a label; texts trimmed, missing ones empty."""
    rows = df.withColumn("theme", F.explode(themes)).where(F.coalesce(trimmed(F.col("theme.label")), F.lit("")) != "")
    names = [f.name for f in rows.schema["theme"].dataType.fields]
    return rows.select(*df.columns, *(F.coalesce(trimmed(F.col(f"theme.{n}")), F.lit("")).alias(n) for n in names))


def all_low(codes: Column) -> Column:
    return (F.size(codes) > 0) & F.forall(codes, lambda c: c["confidence"].eqNullSafe(F.lit("LOW")))


def in_dimension(codes: Column, members: tuple[str, ...]) -> Column:
    return F.coalesce(F.exists(codes, lambda c: c.isin(*members)), F.lit(False))


def with_dimensions(codes: Column, active: tuple[str, ...], dimensions: tuple[str, ...]) -> Column:
    """Codes and the dimensions they belong to; NONE if no active code is there."""
    found = F.filter(F.array(*map(F.lit, dimensions)), lambda d: F.exists(codes, lambda c: c.startswith(d)))
    named = F.array_union(codes, found)
    return F.when(F.exists(codes, lambda c: c.isin(*active)), named).otherwise(F.array_union(named, F.array(F.lit("NONE"))))


def flattened(df: DataFrame) -> DataFrame:
    """Complex columns as JSON texts."""
    complex_ = (T.ArrayType, T.MapType, T.StructType)
    return df.select(*(F.to_json(f.name).alias(f.name) if isinstance(f.dataType, complex_) else F.col(f.name) for f in df.schema.fields))


def phrases(codebook: DataFrame) -> DataFrame:
    """(category, place, phrase): distinct phrases of a codebook's ``include`` texts in order, placeholders left out."""
    rows = codebook.where(~F.col("name").startswith("[")).select("category", "seq", F.posexplode(F.split("include", ",")).alias("at", "raw"))
    phrase = F.trim(F.replace(F.lower("raw"), F.lit('"'), F.lit("")))
    return rows.withColumn("phrase", phrase).groupBy("category", "phrase").agg(F.min(F.struct("seq", "at")).alias("place"))


def sorted_keywords(df: DataFrame, column: str = "keywords") -> DataFrame:
    return df.select(F.explode(column).alias("keyword")).where("keyword <> ''").distinct().orderBy("keyword")


def forbidden_in_json(df: DataFrame, names: tuple[str, ...] = ("body", "text", "author", "author_id", "username", "selftext")) -> Column:
    """Whether a row names a forbidden field, as a column or inside its JSON."""
    columns = [c for c in df.columns if c.lower() in names]
    pattern = "\"(?:" + "|".join(names) + ")\"\\s*:|\\\\\"(?:" + "|".join(names) + ")\\\\\"\\s*:"
    held = [F.col(c).isNotNull() for c in columns]
    nested = F.to_json(F.struct(*(c for c in df.columns if c not in columns))).rlike("(?i)" + pattern)
    out = nested
    for c in held:
        out = out | c
    return out


def spilled(df: DataFrame, known: tuple[str, ...], into: str = "details") -> DataFrame:
    """Columns that a table does not know, packed into one JSON column."""
    unknown = [c for c in df.columns if c not in known]
    packed = F.to_json(F.struct(*unknown)) if unknown else F.lit("{}")
    return df.select(*(c for c in df.columns if c in known), packed.alias(into))
