"""Privacy: what may be written, and what is wrong with what was written."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.config import FORBIDDEN_COLUMNS
from colloquy.functions.jsonx import forbidden_in_json, spilled
from colloquy.operators.coding import USERNAME
from colloquy.operators.tables import observed

LONG_TEXT = 500


def without_forbidden(df: DataFrame, names: tuple[str, ...] = FORBIDDEN_COLUMNS) -> DataFrame:
    return df.drop(*(c for c in df.columns if c.lower() in names))


def forbidden_columns(df: DataFrame, names: tuple[str, ...] = FORBIDDEN_COLUMNS) -> list[str]:
    return sorted(c for c in df.columns if c.lower() in names)


def username_in(quotes: Column) -> Column:
    return F.coalesce(F.exists(quotes, lambda q: q.rlike(USERNAME)), F.lit(False))


def privacy_verdict(df: DataFrame, quotes: str) -> DataFrame:
    """``df`` with ``violations``, the reasons why a row must not be written."""
    found = [
        F.when(forbidden_in_json(df.drop(quotes)), "FORBIDDEN_FIELD"),
        F.when(username_in(F.col(quotes)), "USERNAME"),
        F.when(F.to_json(F.struct(*df.columns)).contains("author_id"), "AUTHOR_ID"),
    ]
    return df.withColumn("violations", F.array_compact(F.array(*found)))


def accepted_and_rejected(df: DataFrame, quotes: str) -> tuple[DataFrame, DataFrame]:
    judged = privacy_verdict(df, quotes)
    return judged.where("size(violations) = 0").drop("violations"), judged.where("size(violations) > 0")


def audit_records(coded: DataFrame, known: tuple[str, ...] = ()) -> DataFrame:
    """Audit rows of coded posts: codes, quotes and confidences as JSON lists; the body is never selected."""
    codes = F.col("deductive_codes")
    record = coded.select(
        "post_id", "corpus_layer", "tertile", "body_length",
        F.to_json(F.transform(codes, lambda c: c["code"])).alias("codes_assigned"),
        F.to_json(F.transform(codes, lambda c: c["evidence_quote"])).alias("evidence_quotes"),
        F.to_json(F.transform(codes, lambda c: c["confidence"])).alias("confidence_ratings"),
        "model", "session_hash", "researcher_override",
        F.when(F.col("researcher_override"), F.col("override_notes")).alias("override_notes"),
    )
    return spilled(record, known) if known else record


def write_summary(judged: DataFrame) -> DataFrame:
    bad = F.size("violations") > 0
    return judged.agg(F.count_if(~bad).alias("n_written"), F.count_if(bad).alias("n_failed"))


def write_audited(judged: DataFrame, path: str) -> dict[str, int]:
    """Write the rows that break no rule, and count those written and those held back in the same pass."""
    bad = F.size("violations") > 0
    rows, seen = observed(judged, f"audit-{uuid.uuid4().hex}", n_written=F.count_if(~bad), n_failed=F.count_if(bad))
    rows.where(~bad).drop("violations").write.mode("append").parquet(path)
    return dict(seen.get)


def privacy_scan(df: DataFrame, key: str, free: tuple[str, ...] = ("evidence_quotes", "details")) -> DataFrame:
    """Flagged fields by kind: long texts (but in ``free`` columns), author ids, usernames. One row counts once for each field."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name != key]
    pairs = F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in texts))
    long = df.select(key, F.inline(pairs)).where("value is not null")
    kinds = F.array_compact(
        F.array(
            F.when((F.length("value") > LONG_TEXT) & ~F.col("field").isin(*free), "LONG_TEXT"),
            F.when(F.contains("value", F.lit("author_id")), "AUTHOR_ID"),
            F.when(F.col("value").rlike(USERNAME), "USERNAME"),
        )
    )
    return long.select(key, "field", F.explode(kinds).alias("kind")).groupBy("field", "kind").agg(F.count("*").alias("n_flags"), F.min(key).alias("first_key"))


def profile_schema(df: DataFrame, names: tuple[str, ...] = FORBIDDEN_COLUMNS) -> DataFrame:
    """Column, type, whether it is forbidden, rows and nulls."""
    counts = df.agg(F.count("*").alias("n_rows"), *(F.count_if(F.col(c).isNull()).alias(f"_{c}") for c in df.columns))
    rows = F.array(*(F.struct(F.lit(c).alias("column"), F.lit(t).alias("type"), F.lit(c.lower() in names).alias("forbidden"), F.col(f"_{c}").alias("n_nulls")) for c, t in df.dtypes))
    return counts.select("n_rows", F.inline(rows))


def validate_export(df: DataFrame, required: tuple[str, ...], json_columns: tuple[str, ...], key: str) -> DataFrame:
    """Checks of an exported table: name, value, passed. One pass over the rows."""
    missing = [c for c in required if c not in df.columns]
    forbidden = forbidden_columns(df)
    jsons = [c for c in json_columns if c in df.columns]
    sums = df.agg(
        F.count("*").alias("rows"),
        F.count_if(F.col(key).isNull()).alias("null_keys"),
        *(F.count_if(F.col(c).isNotNull() & F.try_parse_json(c).isNull()).alias(f"bad_json_{c}") for c in jsons),
        *(F.count_if(F.try_parse_json(c).isNotNull() & ~F.col(c).isin("[]", "{}", "null")).alias(f"filled_json_{c}") for c in jsons),
    )
    check = lambda name, value, ok: F.struct(F.lit(name).alias("check"), value.cast("long").alias("value"), ok.alias("passed"))
    rows = [
        check("missing_columns", F.lit(len(missing)), F.lit(not missing)),
        check("forbidden_columns", F.lit(len(forbidden)), F.lit(not forbidden)),
        check("rows", F.col("rows"), F.col("rows") > 0),
        check("null_keys", F.col("null_keys"), F.col("null_keys") == 0),
        *(check(f"bad_json_{c}", F.col(f"bad_json_{c}"), F.col(f"bad_json_{c}") == 0) for c in jsons),
        *(check(f"filled_json_{c}", F.col(f"filled_json_{c}"), F.lit(True)) for c in jsons),
    ]
    return sums.select(F.inline(F.array(*rows)))


def require_empty(df: DataFrame, what: str) -> None:
    """An error if ``df`` has a row."""
    if not df.isEmpty():
        raise ValueError(f"{what}: {df.limit(1).collect()[0]}")


def require_rows(df: DataFrame, what: str) -> None:
    if df.isEmpty():
        raise ValueError(f"{what}: no rows")


def gates(df: DataFrame, leaked: Column) -> DataFrame:
    """(gate, value, passed): no row fell back to raw values, and there are rows. One pass over the rows."""
    sums = df.agg(F.count_if(leaked).alias("leaks"), F.count("*").alias("rows"))
    line = lambda name, value, ok: F.struct(F.lit(name).alias("gate"), F.col(value).alias("value"), ok.alias("passed"))
    return sums.select(F.inline(F.array(line("fallback_leaks", "leaks", F.col("leaks") == 0), line("rows", "rows", F.col("rows") > 0))))


def require_gates(df: DataFrame, leaked: Column, what: str) -> None:
    """An error that names the gates that ``df`` does not pass."""
    closed = [r.gate for r in gates(df, leaked).collect() if not r.passed]
    if closed:
        raise ValueError(f"{what}: {', '.join(closed)}")


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, n): rows that break each rule."""
    sums = df.agg(*(F.count_if(~F.coalesce(c, F.lit(False))).alias(n) for n, c in rules.items()))
    return sums.select(F.inline(F.array(*(F.struct(F.lit(n).alias("rule"), F.col(n).alias("n")) for n in rules))))


def any_of(*conditions: Column) -> Column:
    return reduce(Column.__or__, conditions)
