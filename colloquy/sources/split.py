"""Large quoted files read by many tasks.

Spark reads a CSV with line breaks inside its fields (``multiLine``) one file to a
task. Here the lines of a file are read in splits, as Spark splits any text, and put
together afterwards: a line begins a record if an even number of quotes comes before
it in its file. The quotes of each split are counted first, their running sum tells
for each split whether it begins inside a field, and the few records that reach over
a split's end are joined by file. Quotes inside fields must be doubled and fields with
quotes or line breaks quoted (RFC 4180), as CSV writers do.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

_FIELDS = [("file", pa.string()), ("block", pa.int64()), ("row", pa.int64()), ("record", pa.string()), ("continues", pa.bool_()), ("open", pa.bool_())]
_RECORDS = "file string, block long, row long, record string, continues boolean, open boolean"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(_FIELDS)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, _FIELDS, strict=True)], [n for n, _ in _FIELDS])


def _lines(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """(file, block, line) in the order of the file; block is where the line's split begins."""
    rows = spark.read.option("lineSep", "\n").text(paths)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line"))


def _inside(lines: DataFrame) -> DataFrame:
    """(file, block) of splits that begin inside a quoted field: a row or none for each split, not for each line."""
    quotes = lines.groupBy("file", "block").agg(F.sum(F.length("line") - F.length(F.replace("line", F.lit('"')))).alias("quotes"))
    before = F.sum("quotes").over(W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1))
    return quotes.select("file", "block", (F.coalesce(before, F.lit(0)) % 2 == 1).alias("inside")).where("inside")


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of each split. ``continues``: it begins inside a field, and this is the end of a record of splits before; ``open``: the record goes on in the next split."""
    at, inside, row = None, False, 0
    held: list[str] = []
    continues = False

    def flush(is_open: bool) -> tuple:
        nonlocal row, continues, held
        out = (*at, row, "\n".join(held), continues, is_open)
        row, continues, held = row + 1, False, []
        return out

    for b in batches:
        out = []
        quotes = pc.count_substring(b.column(2), '"').to_pylist()
        for file, block, line, starts, n in zip(*(b.column(k).to_pylist() for k in range(4)), quotes, strict=True):
            if (file, block) != at:
                if held:
                    out.append(flush(True))
                at, inside, row = (file, block), bool(starts), 0
                continues = inside
            held.append(line)
            inside ^= n % 2 == 1
            if not inside:
                out.append(flush(False))
        yield _batch(out)
    if held:
        yield _batch([flush(True)])


def csv_records(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """(file, block, row, record): the records of CSV files as texts, with their place; blank lines between records are none."""
    lines = _lines(spark, paths)
    marked = lines.join(F.broadcast(_inside(lines)), ["file", "block"], "left")  # one small row for each split that begins inside a field
    pieces = marked.select("file", "block", "line", F.coalesce("inside", F.lit(False)).alias("inside")).mapInArrow(_assemble, _RECORDS)
    whole = pieces.where("not continues and not open").select("file", "block", "row", "record")
    # At most two pieces of each split are left: its head, if it continues a record, and its tail.
    torn = pieces.where("continues or open")
    order = W.partitionBy("file").orderBy("block", "row")
    begins = F.max(F.when(~F.col("continues"), F.struct("block", "row"))).over(order)
    joined = torn.withColumn("_begin", begins).groupBy("file", "_begin").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "row", "record"))), lambda p: p["record"]), "\n").alias("record"))
    records = whole.unionByName(joined.select("file", F.col("_begin.block").alias("block"), F.col("_begin.row").alias("row"), "record"))
    bare = F.regexp_replace("record", "\r$", "")
    return records.withColumn("record", bare).where(F.col("record") != "")


def read_csv(spark: SparkSession, paths: list[str] | str, schema: T.StructType | str | None = None) -> DataFrame:
    """Rows of CSV files whose first record is a header, all columns as texts unless a schema names their types, with ``seq``: file, block and row, in the order of the files."""
    options = {"quote": '"', "escape": '"', "multiLine": "true"}
    names = spark.read.options(header="true", **options).csv(paths).columns  # reads the head of one file
    declared = spark.createDataFrame([], schema).schema if schema else []
    types = {f.name: f.dataType.simpleString() for f in declared}
    seq = "seq struct<file:string,block:long,row:long>"
    ddl = ", ".join(f"`{n}` {types.get(n, 'string')}" for n in names)
    if not names:
        return spark.createDataFrame([], seq)
    body = csv_records(spark, paths).where("not (block = 0 and row = 0)")
    return body.select(F.from_csv("record", ddl, options).alias("_r"), F.struct("file", "block", "row").alias("seq")).select("_r.*", "seq")
