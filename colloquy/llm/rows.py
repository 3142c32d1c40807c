"""How rows of documents are told apart."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def row_key() -> Column:
    """128 bits of a row's doc_id and text. Null and repeated doc_ids do no harm; only rows with both the same share it."""
    sides = [F.lpad(F.hex(F.xxhash64(*c)), 16, "0") for c in (("doc_id", "text"), ("text", "doc_id"))]
    return F.unhex(F.concat(*sides))
