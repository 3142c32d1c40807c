"""Tables that streams write: one folder for each batch, folded into one from time to time.

A batch that runs again replaces its own folder, so the table holds every batch once.
Folding writes the state after batch N to ``upto=N``; readers take the newest complete
one and the batches after it, so what they open does not grow with the stream's age.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.operators.tables import last_of
from colloquy.shared import children, file_system


def written(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders under ``path`` whose writing ended."""
    fs, _ = file_system(spark, path)
    return [n for n in children(spark, path) if fs.exists(file_system(spark, f"{path}/{n}/_SUCCESS")[1])]


def complete(spark: SparkSession, path: str, prefix: str) -> list[int]:
    """Numbers N of the complete folders ``prefix``N under ``path``."""
    return sorted(int(n[len(prefix) :]) for n in written(spark, path) if n.startswith(prefix))


def remove(spark: SparkSession, path: str) -> None:
    fs, at = file_system(spark, path)
    fs.delete(at, True)


def write_batch(df: DataFrame, path: str, number: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/batch={number}")


def parts(spark: SparkSession, path: str, schema: T.StructType, before: int | None = None) -> DataFrame:
    """Rows of the newest folded state and of later batches (all of them, or those before a number), with ``batch``."""
    past = lambda ns: [n for n in ns if before is None or n < before]
    upto = past(complete(spark, path, "upto="))
    base = upto[-1] if upto else -1
    paths = [f"{path}/upto={base}"] * bool(upto) + [f"{path}/batch={n}" for n in past(complete(spark, path, "batch=")) if n > base]
    if not paths:
        return spark.createDataFrame([], T.StructType([*schema.fields, T.StructField("batch", T.LongType())]))
    rows = spark.read.schema(schema).parquet(*paths).withColumn("_in", F.col("_metadata.file_path"))
    number = F.regexp_extract("_in", r"/(?:batch|upto)=(\d+)/", 1).cast("long")
    return rows.withColumn("batch", number).drop("_in")


def newest(spark: SparkSession, path: str, schema: T.StructType, keys: list[str], before: int | None = None) -> DataFrame:
    """The last row that any batch wrote for each key."""
    return last_of(parts(spark, path, schema, before), keys, "batch").drop("batch")


def fold(spark: SparkSession, path: str, schema: T.StructType, keys: list[str], upto: int) -> None:
    """Write the state after batch ``upto``. The state before it and the folded batches stay for readers that have begun; older ones go."""
    states = [n for n in complete(spark, path, "upto=") if n < upto]
    newest(spark, path, schema, keys, upto + 1).write.mode("overwrite").parquet(f"{path}/upto={upto}")
    for n in states[:-1]:
        remove(spark, f"{path}/upto={n}")
    if states:
        for n in complete(spark, path, "batch="):
            if n <= states[-1]:
                remove(spark, f"{path}/batch={n}")
