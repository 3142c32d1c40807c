"""Stored layouts save shuffles and reads, and counts are taken by the pass that writes."""

import re

import pytest
from pyspark.sql import functions as F

from colloquy.operators import audit, layout, profile, tables


def plan_of(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    given = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", given)


def stored(spark, n=400, buckets=4):
    rows = spark.range(n).select(F.col("id"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 10).cast("int")).alias("day"), (F.col("id") * 3).alias("v"))
    return rows, layout.store(rows, "id", "day", buckets)


def test_buckets_join_and_add_up_without_a_shuffle(spark, no_broadcast):
    rows, a = stored(spark)
    _, b = stored(spark)
    joined = a.join(b.withColumnRenamed("v", "w"), "id").groupBy("id").agg(F.sum("w").alias("w"))
    assert "Exchange" not in plan_of(joined)
    plain = rows.join(rows.withColumnRenamed("v", "w"), "id").groupBy("id").agg(F.sum("w").alias("w"))
    assert "Exchange" in plan_of(plain)
    assert sorted(map(tuple, joined.collect())) == sorted(map(tuple, plain.collect()))


def test_days_are_pruned(spark):
    _, a = stored(spark)
    some = a.where("day between '2024-01-03' and '2024-01-04'")
    assert "PartitionFilters: [isnotnull(day" in plan_of(some) and some.count() == 80
    assert len(some.select(F.input_file_name()).distinct().collect()) == 8 and len(a.select(F.input_file_name()).distinct().collect()) == 40


def test_a_join_prunes_days_as_it_runs(spark):
    _, a = stored(spark)
    wanted = spark.createDataFrame([("2024-01-05",)], "day string").select(F.col("day").cast("date")).groupBy("day").count().where("count > 0").select("day")
    other = stored(spark)[1].where("v = 12").select("day")
    for few in (other,):
        joined = a.join(few, "day")
        assert "dynamicpruning" in plan_of(joined) and joined.count() == 40
    assert a.join(wanted, "day").count() == 40


def test_scope_opens_its_months(spark):
    rows = spark.range(365).select(F.timestamp_seconds(1704067200 + F.col("id") * 86400).alias("at"), F.col("id"), F.lit("x").alias("community"))
    table = layout.store(rows.withColumn("month", F.date_trunc("month", "at").cast("date")), "id", "month", 1)
    found = layout.scope(table, "month", "at", "community", ["x"], "2024-02-10", "2024-04-02")
    assert [r.id for r in found.orderBy("id").collect()] == list(range(40, 93))
    assert len(found.select(F.input_file_name()).distinct().collect()) == 3


def scans(spark, run):
    """Rows that Spark's file scans gave while ``run`` ran, from the tasks' own metrics."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    stages = lambda: seq(spark.sparkContext._jsc.sc().statusStore().stageList(jvm.java.util.ArrayList(), False, False, gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList()))
    before = {s.stageId() for s in stages()}
    out = run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    return out, sum(s.inputRecords() for s in stages() if s.stageId() not in before)


def seq(of):
    return [of.apply(i) for i in range(of.size())]


def test_inserts_are_counted_as_they_are_written(spark, tmp_path):
    now = spark.createDataFrame([(1,), (2,)], "k int")
    new = spark.createDataFrame([(1, 0), (3, 1), (3, 2), (None, 3), (4, 4), (None, 5)], "k int, seq int")
    now.coalesce(1).write.parquet(str(tmp_path / "now"))
    new.coalesce(1).write.parquet(str(tmp_path / "new"))
    now, new = spark.read.parquet(str(tmp_path / "now")), spark.read.parquet(str(tmp_path / "new"))
    counts, read = scans(spark, lambda: tables.insert_observed(now, new, ["k"], "seq", str(tmp_path / "out")))
    assert counts == {"inserted": 2, "skipped": 2, "errors": 2} and read == 8
    assert counts == tables.insert_stats(now, new, ["k"], "seq").first().asDict()
    assert sorted(r.k for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [3, 4]


def test_filters_and_audits_are_counted_as_they_are_written(spark, tmp_path):
    rows = [("t3_a", "llama3", "A", None, None), ("t1_b", "llama3", "A", None, None), ("t1_c", "other", "A", None, None), ("t3_d", "llama3", None, None, None)]
    df = spark.createDataFrame(rows, "post_id string, model string, machine_partition string, data_source string, quarantine_reason string")
    counts = profile.write_eligible(df, str(tmp_path / "eligible"))
    assert counts == profile.filter_counts(df, profile.eligible(df)).first().asDict() == {"n_initial": 4, "n_kept": 2, "n_posts": 1, "n_replies": 1, "n_excluded": 2}
    judged = spark.createDataFrame([(1, []), (2, ["x"]), (3, [])], "id int, violations array<string>")
    assert audit.write_audited(judged, str(tmp_path / "audit")) == {"n_written": 2, "n_failed": 1}
    assert re.findall("id|violations", str(spark.read.parquet(str(tmp_path / "audit")).columns)) == ["id"]


def test_review_sample_keeps_few_rows_before_the_shuffle(spark):
    from colloquy.operators import sampling

    df = spark.range(5000).select("id", (F.col("id") % 2).alias("batch"), (F.col("id") % 100 == 7).alias("flagged"))
    found = sampling.review_sample(df, "batch", "id", "flagged", 1)
    assert plan_of(found).count("WindowGroupLimit") >= 2 and found.count() == 40


def test_buckets_grow_with_rows(spark, monkeypatch):
    monkeypatch.setattr(layout, "BUCKET_ROWS", 100)
    assert [layout.buckets_for(spark.range(n), 4) for n in (0, 400, 401, 2000)] == [4, 4, 5, 20]
