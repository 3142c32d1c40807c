"""Exports. No writer lets a forbidden column out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.config import COLLECTION_META
from colloquy.functions import clean, jsonx
from colloquy.operators.audit import without_forbidden
from colloquy.operators.tables import ensure_columns
from colloquy.schemas import CODED_POSTS_COLUMNS, EMERGENT_COLUMNS


def coded_posts(coded: DataFrame, collected: DataFrame, key: str = "reddit_id") -> DataFrame:
    """The export of coded posts: cleaned columns where there are any, metadata taken apart, third and layer with defaults.

    ``coded``: key, ppm_category, confidence, coded_by, coding_approach,
    session_id, rationale, coded_at, ppm_subcodes, evidence_quotes, themes,
    extra_metadata and, if present, the cleaned columns. ``collected``: key,
    text, score, created_utc, permalink, subreddit, data_source, extra_metadata.
    """
    coded = ensure_columns(coded, {"ppm_subcodes_clean": "null:string", "evidence_quotes_clean": "null:string", "quarantine_reason": "null:string"})
    right = collected.select(key, "text", "score", "created_utc", "permalink", "subreddit", "data_source", F.col("extra_metadata").alias("_post"))
    rows = coded.join(right, key, "left").where(F.col(key).isNotNull())
    get = lambda column, field: F.get_json_object(column, f"$.{field}")
    codes = jsonx.json_items(F.coalesce("ppm_subcodes_clean", "ppm_subcodes"))
    quotes = jsonx.json_items(F.coalesce("evidence_quotes_clean", "evidence_quotes"))
    given = jsonx.parse_codes(get("extra_metadata", "deductive_codes"))
    full = F.transform(jsonx.paired(codes, quotes), lambda p: F.struct(p["code"].alias("code"), p["quote"].alias("evidence_quote"), jsonx.confidence_of(p["code"], given).alias("confidence")))
    out = {
        "post_id": F.col(key), "subreddit_name": F.col("subreddit"), "corpus_layer": clean.first_filled(get("_post", "corpus_layer"), F.col("coding_approach")),
        "tertile": clean.tertile(get("_post", "tertile"), 2), "body_length": clean.body_length(F.col("text")), "deductive_codes": F.to_json(full),
        "overall_confidence": F.col("confidence"), "ppm_category": F.col("ppm_category"), "circuit_breaker_flags": F.coalesce(get("extra_metadata", "circuit_breaker_flags"), F.lit("[]")),
        "override_notes": get("extra_metadata", "override_notes"), "model": F.col("coded_by"), "session_id": F.col("session_id"), "coded_at": F.col("coded_at").cast("string"),
        "post_score": F.col("score"), "post_created_utc": F.col("created_utc"), "permalink": F.col("permalink"), "data_source": F.col("data_source"),
        "machine_partition": get("extra_metadata", "machine_partition"), "quarantine_reason": F.col("quarantine_reason"), "ppm_subcodes": F.to_json(codes),
        "evidence_quotes_flat": F.array_join(quotes, " | "), "rationale": F.col("rationale"),
    }
    return without_forbidden(rows.select(*(out[c].alias(c) for c in CODED_POSTS_COLUMNS)))


def emergent_candidates(rows: DataFrame) -> DataFrame:
    """The export of themes, one row each; see ``operators.emergent.emergent_rows``."""
    full = ensure_columns(rows, dict.fromkeys(EMERGENT_COLUMNS, "null:string"))
    return without_forbidden(full.select(*EMERGENT_COLUMNS))


def write_csv(df: DataFrame, path: str) -> None:
    """Rows as CSV with a header, also when there are none; nested values as JSON, blanks at the ends of texts as they are."""
    blanks = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    jsonx.flattened(without_forbidden(df)).write.mode("overwrite").options(header=True, escape='"', **blanks).csv(path)


def append_coded(df: DataFrame, path: str) -> None:
    """Coded rows added to a table as they are; who appends has taken out what is there (``linking.uncoded``)."""
    without_forbidden(df).write.mode("append").parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    without_forbidden(df).write.mode("overwrite").json(path)


def write_tables(tables: dict[str, DataFrame], folder: str) -> None:
    for name, df in tables.items():
        write_csv(df, f"{folder}/{name}")


def write_bundle(folder: str, collected: DataFrame, coded: DataFrame, codebook: DataFrame) -> None:
    """A session as three JSON outputs and a manifest of their sizes."""
    parts = {"collected_data": collected, "coded_data": coded, "codebook": codebook}
    for name, df in parts.items():
        write_json(df, f"{folder}/{name}")
    rows = [df.agg(F.lit(name).alias("part"), F.count("*").alias("n_rows")) for name, df in parts.items()]
    rows[0].unionByName(rows[1]).unionByName(rows[2]).coalesce(1).write.mode("overwrite").json(f"{folder}/manifest")


def selection(parts: dict[str, DataFrame], metadata: bool = True) -> DataFrame:
    """Several tables in one, told apart by ``category``; nested values as JSON; without metadata columns if asked."""
    out = None
    for name, df in parts.items():
        df = jsonx.flattened(df if metadata else df.drop(*COLLECTION_META)).withColumn("category", F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def kappa_tables(rows: DataFrame, dimensions: tuple[str, ...]) -> dict[str, DataFrame]:
    """Results by code and by dimension, in report order."""
    place = F.array_position(F.array(*(F.lit(d) for d in dimensions)), F.regexp_replace("code", "-[0-9]+$", ""))
    is_dimension: Column = F.col("code").isin(*dimensions, "NONE")
    return {"codes": rows.where(~is_dimension).orderBy(place, "code"), "dimensions": rows.where(is_dimension).orderBy(place)}
