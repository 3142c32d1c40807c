import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.llm import exact_dedup

from .helpers import edge_docs, edge_rows, empty_docs, in_order


def half():
    return F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0



@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 1_000, 50_000])
def test_filter_has_no_false_negative(n):
    keys = np.random.default_rng(n).integers(0, 2**64, n, dtype=np.uint64)
    keys = np.unique(keys)
    data = exact_dedup.build_filter(keys)
    assert exact_dedup.probe_filter(data, keys).all()
    others = np.random.default_rng(n + 1).integers(0, 2**64, 20_000, dtype=np.uint64)
    assert exact_dedup.probe_filter(data, others).mean() < 0.02


def brute(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t in rows]
    out = []
    for (i, _), g in zip(rows, norm, strict=True):
        of = [(-len(t or ""), -1 if j is None else j) for (j, t), h in zip(rows, norm, strict=True) if h == g]
        keep = min(of)[1]
        out.append((i, None if keep == -1 else keep, len(of), hashlib.sha256(g.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("old", ["pmod(xxhash64(doc_id), 2) = 0", "true", "false", "cast(null as boolean)", "source = 'src1'"])
def test_edge_cases(spark, old):
    found = exact_dedup.deduplicate(edge_docs(spark), F.expr(old)).collect()
    assert in_order((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found) == in_order(brute([r[:2] for r in edge_rows()]))
    kept = {}
    for r in found:
        kept[r.text_sha256] = kept.get(r.text_sha256, 0) + r.kept
    assert set(kept.values()) == {1}


def test_empty_table(spark):
    assert exact_dedup.deduplicate(empty_docs(spark), half()).count() == 0
    assert exact_dedup.keep_first(empty_docs(spark), half()).count() == 0


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = exact_dedup.deduplicate(docs, half(), keys_per_shard=20)
    assert in_order((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found.collect()) == in_order(brute([tuple(r) for r in docs.select("doc_id", "text").collect()]))


def test_kept_rows_have_all_columns(spark):
    docs = edge_docs(spark)
    kept = exact_dedup.keep_first(docs, half())
    assert kept.columns == docs.columns
    assert kept.count() == len({h for *_, h in brute([r[:2] for r in edge_rows()])})


def test_equal_digests_of_different_texts_stay_apart(spark, monkeypatch):
    """A digest of one bit: only the byte checks tell texts apart."""
    real = F.sha2
    monkeypatch.setattr(exact_dedup.F, "sha2", lambda c, n: F.when(F.col(c) == "", real(F.lit("e"), 256)).otherwise(real(F.lit("x"), 256)) if isinstance(c, str) else F.when(c == "", real(F.lit("e"), 256)).otherwise(real(F.lit("x"), 256)))
    rows = [(1, "a"), (2, "b"), (3, "a "), (4, "c"), (5, "b")]
    found = exact_dedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"), half()).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size) for r in found) == [(1, 3, 2), (2, 2, 2), (3, 3, 2), (4, 4, 1), (5, 2, 2)]


def test_result_passes_through_the_filters(spark, monkeypatch):
    """A filter that answers "no" to everything tears classes of snapshot and batch apart."""
    rows = [(1, "a"), (2, "a"), (3, "b"), (4, "b"), (5, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    old = F.col("doc_id").isin(1, 3, 4)
    right = sorted((r.doc_id, r.keep_id, r.group_size) for r in exact_dedup.deduplicate(docs, old).collect())
    assert right == [(1, 1, 2), (2, 1, 2), (3, 3, 2), (4, 3, 2), (5, 5, 1)]
    monkeypatch.setattr(exact_dedup, "probe_filter", lambda data, keys: np.zeros(len(keys), bool))
    wrong = sorted((r.doc_id, r.keep_id, r.group_size) for r in exact_dedup.deduplicate(docs, old).collect())
    assert wrong == [(1, 1, 1), (2, 2, 1), (3, 3, 2), (4, 3, 2), (5, 5, 1)]


def test_snapshot_is_written_once_and_read_by_many_batches(spark, tmp_path):
    def rows(*texts):
        docs = spark.createDataFrame([(i, t) for i, t in texts], "doc_id long, text string")
        return exact_dedup.digests(docs).withColumn("rid", F.monotonically_increasing_id())

    path = f"{tmp_path}/snapshot"
    exact_dedup.write_snapshot(rows((1, "a"), (2, "b"), (3, "b ")), path, 2)
    files = {p: p.stat().st_mtime_ns for p in (tmp_path / "snapshot").rglob("*")}
    for batch, want in ((((10, "a  "), (11, "x"), (12, "x")), {(10, 2), (11, 2), (1, 1)}), (((20, "b"),), {(3, 3), (1, 1)})):
        found = exact_dedup.match_batch(rows(*batch), spark, path)
        sizes = {(r.keep.doc_id, r["size"]) for r in found.collect()}
        assert {w for w in want if w != (1, 1)} <= sizes
    assert files == {p: p.stat().st_mtime_ns for p in (tmp_path / "snapshot").rglob("*")}
