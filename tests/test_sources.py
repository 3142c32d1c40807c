"""Readers, writers and streams on files with awkward content."""

import csv
import json

import pytest
from pyspark.sql import functions as F

from colloquy.sources import readers, writers
from colloquy.streaming import ingest, jobs

POSTS = [
    {"id": "a", "subreddit_id": "t5_2v89v", "subreddit_name": "", "title": "T", "body": 'line\nbreak, "quoted"', "score": "1525.0", "upvote_ratio": "", "nsfw": "TRUE ", "post_date": "2024-01-02", "tertile": "2", "permalink": "//r/a"},
    {"id": "a", "subreddit_id": "t5_zzz", "subreddit_name": "", "title": "T2", "body": "NaN", "score": "nan", "upvote_ratio": "0.5", "nsfw": "", "post_date": "2024-02-30", "tertile": "x", "permalink": ""},
    {"id": "b", "subreddit_id": "t5_2v89v", "subreddit_name": "Named", "title": "null", "body": "b", "score": "-3.9", "upvote_ratio": "x", "nsfw": "false", "post_date": "", "tertile": "", "permalink": "/x"},
    {"id": "", "body": "no id"},
]


def write(path, rows, encoding="utf-8"):
    with open(path, "w", newline="", encoding=encoding) as f:
        out = csv.DictWriter(f, sorted({k for r in rows for k in r}))
        out.writeheader()
        out.writerows(rows)
    return str(path)


def test_posts(spark, tmp_path):
    rows = {r.post_id: r for r in readers.read_posts(spark, write(tmp_path / "p.csv", POSTS)).collect()}
    assert sorted(rows) == ["a", "b"]
    a, b = rows["a"], rows["b"]
    assert (a.title, a.text, a.score, a.subreddit, a.created_utc, a.tertile, a.reddit_id) == ("T2", None, 0, "t5_zzz", 0.0, None, "t3_a")
    assert (b.title, b.score, b.subreddit, b.permalink) == (None, -3, "Named", "x")
    assert json.loads(a.extra_metadata)["upvote_ratio"] == 0.5


def test_comments_of_several_files(spark, tmp_path):
    posts = readers.read_posts(spark, write(tmp_path / "p.csv", [POSTS[0]]))
    one = write(tmp_path / "1.csv", [{"comment_id": "c1", "post_id": "a", "subreddit_id": "t5_2v89v", "body": "first", "score": "2", "parent_id": ""}])
    two = write(tmp_path / "2.csv", [{"comment_id": "c1", "post_id": "a", "subreddit_id": "t5_2v89v", "body": "again", "score": "9", "parent_id": "x"}, {"comment_id": "c2", "post_id": "gone", "subreddit_id": "t5_q", "body": "b", "score": "", "parent_id": "nan"}])
    rows = {r.reddit_id: r for r in readers.read_comments(spark, [one, two], posts).collect()}
    assert (rows["t1_c1"].text, rows["t1_c1"].score, rows["t1_c1"].orphan, rows["t1_c1"].subreddit) == ("first", 2, False, "Decaf")
    assert rows["t1_c2"].orphan and rows["t1_c2"].subreddit == "t5_q"
    both = readers.posts_and_comments(posts, readers.read_comments(spark, [one, two], posts))
    assert both.count() == 3


def test_rating_sheet(spark, tmp_path):
    sheet = [{"reddit_id": "1", " PUSH-01 ": "x", "MOOR-I-06": "0"}, {"reddit_id": "2", " PUSH-01 ": "", "MOOR-I-06": ""}, {"reddit_id": "3", " PUSH-01 ": "1.0", "MOOR-I-06": " YES"}]
    rows = readers.read_rater_sheet(spark, write(tmp_path / "s.csv", sheet, "utf-8-sig")).collect()
    assert {r.id: sorted(r.codes) for r in rows} == {"1": ["PUSH-01"], "2": [], "3": ["MOOR-I-06", "PUSH-01"]}


@pytest.mark.parametrize("content", [[{"id": 1}, {"id": 2}], {"collected": [{"id": 1}, {"id": 2}], "other": 3}])
def test_dataset(spark, tmp_path, content):
    path = tmp_path / "d.json"
    path.write_text(json.dumps(content))
    assert sorted(r.id for r in readers.read_dataset_json(spark, str(path)).collect()) == [1, 2]


def test_summary(spark, tmp_path):
    path = tmp_path / "s.json"
    path.write_text(json.dumps({"_stratum": "x", "_n_total": 5, "A": {"submissions_n": 4, "PUSH_count": 1, "PULL_count": 3, "MOOR_present_count": 2}, "B": {"total_units": 7}}))
    rows = {r.community: r for r in readers.read_summary(spark, str(path)).collect()}
    assert sorted(rows) == ["A", "B"] and rows["A"].pull == 3 and rows["B"].n == 7 and rows["B"].push is None


def test_exports_keep_a_header_and_nothing_forbidden(spark, tmp_path):
    df = spark.createDataFrame([], "label string, text string, nested array<string>")
    writers.write_csv(df, str(tmp_path / "out"))
    back = spark.read.option("header", True).csv(str(tmp_path / "out"))
    assert back.columns == ["label", "nested"] and back.count() == 0


def test_scan_pushes_its_filters_down(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(10).select(F.lit("s").alias("session_id"), F.lit("x").alias("subreddit"), "id", F.current_timestamp().alias("collected_at")).write.parquet(path)
    plan = readers.scan(spark.read.parquet(path), "s", "x", 5, tie="id")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(session_id,s)" in plan and "EqualTo(subreddit,x)" in plan and "TakeOrderedAndProject" in plan


def test_ingest_run_twice_adds_nothing(spark, tmp_path):
    rows = spark.range(100).select(F.col("id"), F.timestamp_seconds(F.col("id")).alias("at"))
    rows.union(rows).repartition(3).write.parquet(str(tmp_path / "in"))
    for checkpoint in ("c1", "c1", "c2"):  # the same stream again, and one that has forgotten everything
        stream = jobs.file_stream(spark, str(tmp_path / "in"), rows.schema, 1)
        ingest.ingest(stream, str(tmp_path / "out"), str(tmp_path / checkpoint), ["id"], "at").awaitTermination()
        assert ingest.stored(spark, str(tmp_path / "out"), rows.schema).count() == 100
