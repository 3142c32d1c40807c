"""Tables laid out for reuse: folders by date, buckets by id inside them."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.shared import shared_path


#: Rows of the larger table in a bucket of a join: what one task sorts.
BUCKET_ROWS = 1_000_000


def buckets_for(df: DataFrame, least: int, rows: int | None = None) -> int:
    """Buckets for a table, at least so many, that grow with its rows, so that the work of a task does not."""
    return max(least, math.ceil(df.count() / (rows or BUCKET_ROWS)))


def store(df: DataFrame, key: str, day: str, buckets: int, name: str | None = None, path: str | None = None) -> DataFrame:
    """``df`` as a table of the session's catalog, with a folder for each ``day`` and ``buckets`` buckets of ``key``.

    Rows are dealt by the bucket's own hash first, so each folder has at most one file
    for a bucket. Joins and aggregations by ``key`` of tables with as many buckets need no
    shuffle, and filters or joins on ``day`` decide which folders are read. ``buckets``
    is to be chosen by size (a bucket of a join is the work of one task), see ``buckets_for``.
    """
    name = name or f"layout_{uuid.uuid4().hex}"
    writer = df.repartition(buckets, key).write.mode("overwrite").format("parquet").partitionBy(day).bucketBy(buckets, key).sortBy(key)
    writer.option("path", path or shared_path(df.sparkSession, "layout")).saveAsTable(name)
    return df.sparkSession.table(name)


def scope(table: DataFrame, folder: str, day: str, community: str, ids: list[str], first: str, last: str, unit: str = "month") -> DataFrame:
    """Listed communities from ``first`` to ``last``, both included; only the folders (``unit`` of ``day``) in that range are read."""
    low = F.date_trunc(unit, F.lit(first).cast("timestamp")).cast("date")
    return table.where(F.col(folder).between(low, F.lit(last).cast("date")) & F.col(day).between(first, last) & F.col(community).isin(*ids))
