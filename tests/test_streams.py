"""Streams against batches: however rows are cut into files and runs, the tables are the same."""

import os
import random
import time
from collections import Counter
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from colloquy.streaming import coding, folders, ingest, jobs, windows

SCHEMA = "id long, at timestamp, kind string"
START = datetime(2024, 3, 1)


def row(i, minutes, kind="a"):
    return (i, START + timedelta(minutes=minutes), kind)


def add_files(spark, path, files):
    """One file for each list of rows, in this order."""
    for k, rows in enumerate(files):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)
        at = time.time() - 1000 + k + 10 * len(os.listdir(path))
        for name in os.listdir(path):
            full = f"{path}/{name}"
            if name.startswith("part-") and name not in seen_files:
                os.utime(full, (at, at))
                seen_files.add(name)


seen_files = set()


def counted(spark, tmp, runs, late="1 hour", fold_every=20, per_batch=1):
    path, out, offsets = f"{tmp}/in", f"{tmp}/out", f"{tmp}/offsets"
    for files in runs:
        add_files(spark, path, files)
        stream = jobs.file_stream(spark, path, spark.createDataFrame([], SCHEMA).schema, per_batch)
        windows.count_windows(stream, "at", "kind", out, offsets, "10 minutes", late, fold_every=fold_every).awaitTermination()
    rows = windows.window_counts(spark, out, stream, "kind").collect()
    return {((r.window_start - START).total_seconds() / 60, r.kind): r.n for r in rows}


def batch_counts(rows):
    return dict(Counter(((at - START).total_seconds() // 600 * 10, kind) for _, at, kind in rows))


@pytest.mark.parametrize(("cuts", "fold_every"), [([40], 20), ([7, 20, 33, 40], 1), ([1, 2, 3, 40], 2)])
def test_windows_equal_a_batch_count(spark, tmp_path, cuts, fold_every):
    r = random.Random(2)
    rows = [row(i, 4 * i - r.randint(0, 50), r.choice("ab")) for i in range(40)]
    runs = [[rows[a:b]] for a, b in zip([0, *cuts], cuts, strict=False)]
    assert counted(spark, tmp_path, runs, "2 hours", fold_every) == batch_counts(rows)


def test_late_rows_are_left_out(spark, tmp_path):
    """The watermark is 100 - 60: the window 30-40 has ended by then, 40-50 has not."""
    runs = [[[row(1, 5), row(2, 100)]], [[row(3, 31), row(4, 39), row(5, 41), row(6, 100)]]]
    assert counted(spark, tmp_path, runs) == {(0, "a"): 1, (100, "a"): 2, (40, "a"): 1}


def test_folded_state_is_all_that_is_read(spark, tmp_path):
    rows = [[row(i, 3 * i)] for i in range(9)]
    assert counted(spark, tmp_path, [rows], "5 hours", 2) == batch_counts([x[0] for x in rows])
    out = str(tmp_path / "out")
    assert len(folders.complete(spark, out, "upto=")) == 2
    assert len(folders.complete(spark, out, "batch=")) <= 4
    state = folders.complete(spark, out, "upto=")[-1]
    again = folders.newest(spark, out, spark.read.parquet(f"{out}/upto={state}").schema, ["window_start", "kind"], state + 1)
    assert again.count() == spark.read.parquet(f"{out}/upto={state}").count()


def test_closed_windows(spark, tmp_path):
    add = [[row(1, 5), row(2, 100)]]
    counted(spark, tmp_path, [add])
    counts = spark.read.parquet(f"{tmp_path}/out")
    assert [r.n for r in windows.closed(counts, "2024-03-01T00:40:00.000Z").collect()] == [1]


def test_progress_lands_in_a_table(spark, tmp_path):
    path = str(tmp_path / "reports")
    with windows.progress_table(spark, path, every=2):
        counted(spark, tmp_path, [[[row(i, i)] for i in range(5)], [[row(9, 300)]]])
    rows = windows.read_progress(spark, path).collect()
    assert sum(r.rows_in for r in rows) == 6 and len({r.run_id for r in rows}) == 2
    assert any(r.state_rows for r in rows) and max(r.watermark for r in rows if r.watermark) == "2024-03-01T04:00:00.000Z"
    ends = spark.read.schema(windows.PROGRESS).parquet(path).where("ended").collect()
    assert len(ends) == 2 and all(e.error is None for e in ends)
    by = windows.speed_by_batch(windows.read_progress(spark, path)).collect()
    assert max(r.rows_so_far for r in by) == 5


def test_estimates(spark):
    done = spark.createDataFrame([("r", "x", 0, 40, 2000), ("r", "x", 1, 20, 1000), ("s", "y", 0, 0, 10)], "run_id string, name string, batch long, rows_in long, duration_ms long")
    expected = spark.createDataFrame([("x", 100), ("y", 0)], "name string, expected long")
    rows = {r.name: r for r in windows.collection_progress(done, expected).collect()}
    assert rows["x"].progress_percentage == pytest.approx(0.6) and rows["x"].eta_seconds == pytest.approx(2.0)
    assert rows["y"].progress_percentage is None and rows["y"].eta_seconds is None


# -- coding ---------------------------------------------------------------------------------------


def numbered(spark, tmp, runs, per_batch):
    path, out = f"{tmp}/in", f"{tmp}/out"
    for files in runs:
        add_files(spark, path, files)
        stream = jobs.file_stream(spark, path, spark.createDataFrame([], SCHEMA).schema, per_batch)
        posts = coding.number_posts(stream, F.col("id") % 3, "id", "at", F.col("kind") == "flag", save_every=4, review_every=10, share=0.5, most=4)
        coding.code_with_reviews(posts, out, f"{tmp}/offsets").awaitTermination()
    return sorted(map(tuple, coding.coded(spark, out, "post").collect())), sorted(map(tuple, coding.coded(spark, out, "review").collect())), sorted(map(tuple, coding.complete_saves(spark, out, 4).collect()))


def plain(rows):
    import hashlib

    lanes = {}
    for i, at, kind in sorted(rows, key=lambda x: (x[1], str(x[0]))):
        lanes.setdefault(i % 3, []).append((i, kind == "flag"))
    posts, reviews, saves = [], [], []
    for lane, of in lanes.items():
        for n, (i, _) in enumerate(of):
            posts.append((str(lane), str(i), n + 1, n // 4 + 1, n // 10 + 1))
        for a in range(0, len(of) // 10 * 10, 10):
            flagged = [(n, i) for n, (i, f) in enumerate(of[a : a + 10], a) if f]
            others = sorted((hashlib.md5(f"0:{i}".encode()).hexdigest(), n, i) for n, (i, f) in enumerate(of[a : a + 10], a) if not f)
            for n, i in (flagged + [(n, i) for _, n, i in others])[:4]:
                reviews.append((str(lane), str(i), n + 1, n // 4 + 1, a // 10 + 1))
        saves += [(str(lane), a // 4 + 1, len(of[a : a + 4]), len(of[a : a + 4]) == 4) for a in range(0, len(of), 4)]
    return sorted(posts), sorted(reviews), sorted(saves)


@pytest.mark.parametrize(("cuts", "per_batch", "restarts"), [([80], 1, False), ([5, 6, 31, 50, 80], 1, False), ([5, 6, 31, 50, 80], 2, True), ([40, 80], 5, True)])
def test_reviews_do_not_depend_on_files_and_runs(spark, tmp_path, cuts, per_batch, restarts):
    r = random.Random(8)
    rows = [row(i, i, "flag" if r.random() < 0.15 or 20 < i < 40 else "a") for i in range(80)]
    files = [rows[a:b] for a, b in zip([0, *cuts], cuts, strict=False)]
    assert numbered(spark, tmp_path, [[f] for f in files] if restarts else [files], per_batch) == plain(rows)


# -- ingest ---------------------------------------------------------------------------------------


def added(spark, table, number, rows):
    ingest.add_batch(spark.createDataFrame(rows, SCHEMA), number, table, ["id"], "at", files=2)
    return next(r for r in ingest.ingest_log(spark, table).collect() if r.batch == number)


def test_new_keys_open_few_files(spark, tmp_path):
    table = str(tmp_path / "table")
    for k in range(4):
        log = added(spark, table, k, [row(i, i) for i in range(100 * k, 100 * k + 100)])
        assert (log.files, log.files_opened, log.rows_added) == (2 * k, 0, 100)
    # Keys inside a file's range that it does not have: its filter says no.
    for k, i in enumerate((10_000, 20_000)):
        added(spark, table, 4 + k, [row(i + 2 * j, 0) for j in range(50)])
    log = added(spark, table, 6, [row(10_000 + 2 * j + 1, 0) for j in range(40)])
    assert log.files == 12 and log.files_opened <= 1 and log.rows_added == 40
    # Known keys open the file that has them.
    log = added(spark, table, 7, [row(250, 0), row(251, 0), row(999_999, 0)])
    assert 1 <= log.files_opened <= 2 and log.rows_added == 1
    assert ingest.stored(spark, table, spark.createDataFrame([], SCHEMA).schema).count() == 400 + 100 + 40 + 1


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    table, schema = str(tmp_path / "table"), spark.createDataFrame([], SCHEMA).schema
    one, two = [row(1, 0), row(2, 9), row(2, 3), (None, START, "a")], [row(2, 0), row(3, 0)]
    for number, rows in ((0, one), (1, two), (1, two), (0, one)):
        added(spark, table, number, rows)
    found = sorted((r.id, (r.at - START).seconds // 60) for r in ingest.stored(spark, table, schema).collect())
    assert found == [(1, 0), (2, 3), (3, 0)]


@pytest.mark.parametrize("probed", [0, 1 << 20])
def test_candidates_lose_no_file(spark, tmp_path, probed):
    r = random.Random(3)
    table, schema = str(tmp_path / "table"), spark.createDataFrame([], SCHEMA).schema
    for number in range(3):
        ingest.add_batch(spark.createDataFrame([row(r.randint(0, 10**9), 0) for _ in range(200)], SCHEMA), number, table, ["id", "kind"], "at", files=4)
    stored = ingest.stored(spark, table, schema).select("id", "kind", F.col("_metadata.file_path").alias("file")).collect()
    some = r.sample(stored, 30)
    index = ingest._index(spark, table, spark.createDataFrame([], SCHEMA), ["id", "kind"])
    batch = spark.createDataFrame([(x.id, x.kind) for x in some] + [(-5, "z")], "id long, kind string")
    files = ingest.candidate_files(index, batch, ["id", "kind"], cells=5, probed_keys=probed)
    assert {x.file for x in some} <= set(files)
    assert ingest.candidate_files(index, batch.where("id < 0"), ["id", "kind"]) == []


def test_filters():
    r = np.random.default_rng(0)
    keys, others = r.integers(-(2**63), 2**63, 20_000), r.integers(-(2**63), 2**63, 200_000)
    made = ingest.make_filter(keys)
    assert ingest.may_hold(made, keys).all() and ingest.may_hold(made, others).mean() < 1e-4
    assert not ingest.may_hold(ingest.make_filter(keys[:0]), others).any()


@pytest.mark.parametrize("at_once", [1, 25, 50_000])
def test_reviews_of_a_large_batch_are_picked_together(spark, tmp_path, monkeypatch, at_once):
    r = random.Random(4)
    rows = [row(i, i, "flag" if r.random() < 0.3 else "a") for i in range(150)]
    best = []
    given = coding.Numbering._best
    monkeypatch.setattr(coding, "ROWS_AT_ONCE", at_once)
    assert numbered(spark, tmp_path, [[rows[:77], rows[77:]]], 1) == plain(rows)

    class State:
        exists, update, clear, put = (lambda self: False), (lambda self, x: None), (lambda self: None), (lambda self, x: None)

    one = coding.Numbering(4, 10, 0.5, 4)
    one.count = one.due = State()
    monkeypatch.setattr(coding.Numbering, "_best", lambda self, rows: best.append(1) or given(self, rows))
    batch = pd.DataFrame({"id": [str(x[0]) for x in rows], "order": range(150), "flagged": False, "draw": [str(x[0]) for x in rows]})
    list(one.handleInputRows(("0",), iter([batch]), None))
    assert len(best) == -(-150 // max(10, at_once // 10 * 10))  # once for a block, not for each of the 15 reviews


def test_a_large_batch_has_more_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ingest, "FILE_KEYS", 30)
    table = str(tmp_path / "table")
    ingest.add_batch(spark.createDataFrame([row(i, i) for i in range(200)], SCHEMA), 0, table, ["id"], "at", files=2)
    index = ingest._index(spark, table, spark.createDataFrame([], SCHEMA), ["id"]).collect()
    assert len(index) == 7 and sum(r.n for r in index) == 200
