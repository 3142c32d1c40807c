"""Changes of stored tables as functions from the current rows and the changes to the new rows."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colloquy.shared import shared_path


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    return reduce(Column.__and__, (left[k].eqNullSafe(right[k]) for k in keys))


def first_of(df: DataFrame, keys: list[str], order: str, last: bool = False) -> DataFrame:
    """One row for each key: the first, or the last, by ``order``."""
    place = F.desc(order) if last else F.asc(order)
    return df.withColumn("_place", F.row_number().over(W.partitionBy(*keys).orderBy(place))).where("_place = 1").drop("_place")


def last_of(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    return first_of(df, keys, order, last=True)


def insert_ignore(current: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows of ``new`` whose key is not there yet; of equal keys in ``new`` the first."""
    fresh = first_of(new, keys, order).drop(order)
    return fresh.join(current.select(*keys), keys, "left_anti")


def with_inserts(current: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    return current.unionByName(insert_ignore(current, new, keys, order), allowMissingColumns=True)


def insert_stats(current: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row: inserted, skipped (key known, or not the first of its key), errors (no key)."""
    good = new.where(reduce(Column.__and__, (F.col(k).isNotNull() for k in keys)))
    known = current.select(*keys, F.lit(True).alias("_known")).distinct()
    marked = good.withColumn("_place", F.row_number().over(W.partitionBy(*keys).orderBy(order))).join(known, keys, "left")
    counts = marked.agg(F.count_if((F.col("_place") == 1) & F.col("_known").isNull()).alias("inserted"), F.count_if((F.col("_place") > 1) | F.col("_known").isNotNull()).alias("skipped"))
    errors = new.where(reduce(Column.__or__, (F.col(k).isNull() for k in keys))).agg(F.count("*").alias("errors"))
    return counts.crossJoin(errors)  # one row by one row


def observed(df: DataFrame, name: str, **counts: Column) -> tuple[DataFrame, Observation]:
    """``df`` with counts that are taken while it is written."""
    seen = Observation(name)
    return df.observe(seen, *(c.alias(n) for n, c in counts.items())), seen


def write_observed(df: DataFrame, path: str, counts: dict[str, Column], mode: str = "append") -> dict[str, int]:
    """Write ``df`` and return counts that were taken by the tasks that wrote it; the rows are read once."""
    rows, seen = observed(df, f"write-{uuid.uuid4().hex}", **counts)
    rows.write.mode(mode).parquet(path)
    return dict(seen.get)


def insert_observed(current: DataFrame, new: DataFrame, keys: list[str], order: str, path: str) -> dict[str, int]:
    """Write the rows of ``new`` whose key is not in ``current`` to ``path``, and count on the way: inserted, skipped (key known, or not the first of its key), errors (no key).

    ``new`` is counted where it is read and the fresh rows where they are written, so
    each table is read once, where ``insert_stats`` reads them for the counts alone.
    """
    keyless = reduce(Column.__or__, (F.col(k).isNull() for k in keys))
    given, seen = observed(new, f"given-{uuid.uuid4().hex}", rows=F.count("*"), errors=F.count_if(keyless))
    inserted = write_observed(insert_ignore(current, given.where(~keyless), keys, order), path, {"inserted": F.count("*")})["inserted"]
    rows, errors = seen.get["rows"], seen.get["errors"]
    return {"inserted": inserted, "skipped": rows - errors - inserted, "errors": errors}


def upsert(current: DataFrame, new: DataFrame, keys: list[str], order: str, keep: tuple[str, ...] = (), stamp: str | None = None) -> DataFrame:
    """Rows of ``new`` replace those with their key; the last of equal keys wins.

    Columns in ``keep`` hold the current value where there is one; ``stamp`` is
    set to the current time on every row that comes in.
    """
    fresh = last_of(new, keys, order).drop(order)
    if stamp:
        fresh = fresh.withColumn(stamp, F.current_timestamp())
    if keep:
        old = current.select(*keys, *(F.col(c).alias(f"_{c}") for c in keep))
        fresh = fresh.join(old, keys, "left").withColumns({c: F.coalesce(f"_{c}", c) for c in keep}).drop(*(f"_{c}" for c in keep))
    return current.join(fresh.select(*keys), keys, "left_anti").unionByName(fresh, allowMissingColumns=True)


def prune(current: DataFrame, given: DataFrame, keys: list[str], session: str, allowed: bool = True) -> DataFrame:
    """Without this session's rows that ``given`` lacks; nothing happens unless it is allowed."""
    if not allowed:
        return current
    mine = current.where(F.col("session_id").eqNullSafe(F.lit(session)))
    return current.where(~F.col("session_id").eqNullSafe(F.lit(session))).unionByName(mine.join(given.select(*keys), keys, "left_semi"))


def edit_codebook(current: DataFrame, edits: DataFrame, order: str, default_ids: tuple[str, ...] = ()) -> DataFrame:
    """Add, change and delete codes by id: a change needs name and definition, default codes stay."""
    full = edits.where("not coalesce(deleted, false)").where("coalesce(trim(name), '') <> '' and coalesce(trim(definition), '') <> ''").drop("deleted")
    gone = edits.where("deleted").where(~F.col("id").isin(*default_ids)) if default_ids else edits.where("deleted")
    return upsert(current, full, ["id"], order).join(gone.select("id"), "id", "left_anti")


def set_status(current: DataFrame, ids: DataFrame, status: str, key: str = "id") -> DataFrame:
    hit = ids.select(key).distinct().withColumn("_hit", F.lit(True))
    return current.join(hit, key, "left").withColumn("status", F.when(F.col("_hit"), status).otherwise(F.col("status"))).drop("_hit")


def delete_ids(current: DataFrame, ids: DataFrame, key: str, prefix: str | None = None) -> DataFrame:
    """Without the rows whose key is listed, with or without ``prefix``."""
    bare = (lambda c: F.regexp_replace(c, f"^{prefix}", "")) if prefix else (lambda c: c)
    gone = ids.select(bare(F.col(key)).alias("_key")).distinct()
    return current.join(gone, bare(current[key]) == gone["_key"], "left_anti")


def delete_session(table: DataFrame, session: str | None) -> DataFrame:
    """Without a session's rows; an empty session deletes nothing."""
    return table.where(~F.col("session_id").eqNullSafe(F.lit(session))) if session else table


def ensure_columns(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Columns that are not there yet, with their default: a literal, or a type by name for nulls."""
    missing = {c: F.lit(None).cast(v[5:]) if isinstance(v, str) and v.startswith("null:") else F.lit(v) for c, v in defaults.items() if c not in df.columns}
    return df.withColumns(missing) if missing else df


def remap_source(df: DataFrame, old: tuple[str, ...], new: str, column: str = "data_source") -> DataFrame:
    c = F.col(column)
    return df.withColumn(column, F.when(c.isNull() | c.isin(*old), new).otherwise(c))


def numbered(df: DataFrame, order: str, into: str) -> DataFrame:
    """``df`` with ``into``: 1, 2, 3, ... by ``order``. The ranges of a sort are counted, so no task holds all rows."""
    path = shared_path(df.sparkSession, "sorted")
    df.orderBy(order).withColumn("_at", F.monotonically_increasing_id()).write.parquet(path)
    rows = df.sparkSession.read.parquet(path).withColumn("_range", F.shiftright("_at", 33))
    # One row for each range.
    before = F.coalesce(F.sum("_size").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes = rows.groupBy("_range").agg(F.count("*").alias("_size")).select("_range", before.alias("_before"))
    return rows.join(sizes, "_range").withColumn(into, F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1).drop("_range", "_at", "_before")


def next_codes(current: DataFrame, new: DataFrame, order: str, prefix: str = "EMER-") -> DataFrame:
    """``new`` with ``code``: the next free numbers after the highest of the codebook; a code that cannot be read is passed over."""
    number = F.regexp_extract("code", f"^{prefix}([0-9]+)$", 1).try_cast("int")
    top = current.agg(F.max(number)).first()[0] or 0
    digits = (F.col("_n") + top).cast("string")
    return numbered(new, order, "_n").withColumn("code", F.concat(F.lit(prefix), F.lpad(digits, F.greatest(F.lit(2), F.length(digits)), F.lit("0")))).drop("_n")


def approve_candidates(codebook: DataFrame, candidates: DataFrame, order: str) -> DataFrame:
    """Codes made of approved candidates; the example is the first 200 characters of the evidence."""
    coded = next_codes(codebook, candidates.where("status = 'approved'"), order)
    return coded.select("code", "name", "definition", F.left("evidence", F.lit(200)).alias("examples"))


def latest(df: DataFrame, keys: list[str], order: str, tie: str) -> DataFrame:
    """The newest row of each key; ``tie`` decides between equal times."""
    rows = W.partitionBy(*keys).orderBy(F.col(order).desc_nulls_last(), F.desc(tie))
    return df.withColumn("_place", F.row_number().over(rows)).where("_place = 1").drop("_place")


def run_states(changes: DataFrame, terminal: tuple[str, ...] = ("completed", "failed", "cancelled")) -> DataFrame:
    """Current state of each run from its changes (job_id, seq, at, status, items_collected, error_message): an empty status changes nothing, a terminal one stamps the end."""
    status = F.max_by(F.nullif("status", F.lit("")), F.when(F.nullif("status", F.lit("")).isNotNull(), F.col("seq")))
    items = F.max_by("items_collected", F.when(F.col("items_collected").isNotNull(), F.col("seq")))
    error = F.max_by("error_message", F.when(F.col("error_message").isNotNull(), F.col("seq")))
    done = F.max(F.when(F.col("status").isin(*terminal), F.col("at")))
    return changes.groupBy("job_id").agg(status.alias("status"), items.alias("items_collected"), error.alias("error_message"), F.min("at").alias("started_at"), done.alias("completed_at"))


def update_latest_run(runs: DataFrame, session: str, tie: str, label: str | None = None, is_test: bool | None = None) -> DataFrame:
    """Label and test mark of a session's newest run; what is not given stays. ``extra`` is a struct with both."""
    mine = F.col("session_id") == session
    newest = runs.where(mine).agg(F.max(F.struct("started_at", tie))[tie]).first()[0]  # of this session alone
    changed = F.col("extra")
    if label is not None:
        changed = changed.withField("label", F.lit(label))
    if is_test is not None:
        changed = changed.withField("is_test", F.lit(is_test))
    return runs.withColumn("extra", F.when(mine & (F.col(tie) == F.lit(newest)), changed).otherwise(F.col("extra")))


def newest(df: DataFrame, n: int, order: str, tie: str, where: Column | None = None) -> DataFrame:
    rows = df if where is None else df.where(where)
    return rows.orderBy(F.col(order).desc_nulls_last(), F.desc(tie)).limit(n)


def audit_rows(df: DataFrame, action: str, session: Column, details: list[str], at: Column) -> DataFrame:
    """One audit row for each row of ``df``."""
    return df.select(at.alias("timestamp"), F.lit(action).alias("action"), session.alias("session_id"), F.to_json(F.struct(*details)).alias("details"))
