"""Where queries put themselves, with the SQL that each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: A text as ``functions.clean.normalised_text`` leaves it.
SQL_NORM = (
    "trim(regexp_replace(regexp_replace(replace(replace(replace(translate(lower({0}), '’‘“”—–é' || chr(160), '''''\"\"--e '), '…', '...'), 'æ', 'ae'), 'œ', 'oe'), "
    "'[^a-z0-9\\s''.-]', ' ', 'g'), '\\s+', ' ', 'g'))"
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
