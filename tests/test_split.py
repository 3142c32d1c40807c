"""Files read in splits have the rows that they have read whole."""

import json
import random

import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from colloquy.plans import texts
from colloquy.sources import readers, split, split_json


@pytest.fixture
def small_splits(spark):
    given = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "97")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for k, v in given.items():
        spark.conf.set(k, v)


def whole(spark, path):
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)


@pytest.mark.parametrize("seed", range(4))
def test_splits_against_whole_files(spark, tmp_path, small_splits, seed):
    r = random.Random(seed)
    atoms = ["a", "é", ",", "\n", '"', '""', " ", "\n\n", "日本", "x,y\n", 'said "no"', "'"]
    some = lambda: r.choice([None, "", "plain", "".join(r.choice(atoms) for _ in range(r.randint(0, 12))), "long\n" * r.choice([1, 1, 60])])
    rows = [(str(i), some(), some(), some()) for i in range(60)]
    path = str(tmp_path / "in")
    spark.createDataFrame(rows, "id string, one string, `two b` string, three string").repartition(3).write.option("header", True).option("escape", '"').csv(path)
    found = split.read_csv(spark, path)
    assert found.rdd.getNumPartitions() > 3
    assert found.columns == ["id", "one", "two b", "three", "seq"]
    want = whole(spark, path)
    assert sorted(map(str, found.drop("seq").collect())) == sorted(map(str, want.collect()))
    # The order of the rows is the order in the files.
    by_file = {}
    for x in found.collect():
        by_file.setdefault(x.seq.file, []).append((x.seq.block, x.seq.row, x.id))
    order = {}
    for x in want.select("id", "_metadata.file_path").collect():
        order.setdefault(x.file_path, []).append(x.id)
    assert {f: [i for *_, i in sorted(v)] for f, v in by_file.items()} == order


def test_other_line_ends_and_types(spark, tmp_path, small_splits):
    text = 'id,n,body\r\n1,5,"two\r\nlines"\r\n2,x,plain\r\n\r\n3,,"a ""b"" c"'
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_bytes(text.encode())
    schema = spark.createDataFrame([], "n int").schema
    rows = split.read_csv(spark, str(tmp_path / "in"), schema).orderBy("seq").collect()
    assert [(x.id, x.n, x.body) for x in rows] == [("1", 5, "two\r\nlines"), ("2", None, "plain"), ("3", None, 'a "b" c')]


def test_heads_alone_and_no_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("id,body\n")
    (tmp_path / "in" / "b.csv").write_text("")
    rows = split.read_csv(spark, str(tmp_path / "in"))
    assert rows.columns == ["id", "body", "seq"] and rows.count() == 0


def test_one_field_over_many_splits(spark, tmp_path, small_splits):
    body = "\n".join(f"line {i}, with \"quotes\"" for i in range(200))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text('id,body\n1,"' + body.replace('"', '""') + '"\n2,after\n')
    rows = split.read_csv(spark, str(tmp_path / "in")).orderBy("seq").collect()
    assert [(x.id, x.body) for x in rows] == [("1", body), ("2", "after")]


# -- JSON -----------------------------------------------------------------------------------------


def random_item(r, depth=0):
    texts = ["a", "", '"quoted"', "{[}]", "back\\slash", "é日", "line\nbreak", "}", ':"x":', "tail\\"]
    kinds = [lambda: r.choice(texts), lambda: r.randint(0, 99), lambda: None, lambda: True, lambda: [r.choice(texts) for _ in range(r.randint(0, 3))]]
    if depth < 2:
        kinds += [lambda: random_item(r, depth + 1), lambda: [random_item(r, depth + 1) for _ in range(r.randint(0, 2))]]
    return {r.choice(["id", "collected", "codes", "x", "y"]) + str(k): r.choice(kinds)() for k in range(r.randint(0, 4))}


def items_of(spark, folder, keys):
    rows = split_json.json_items(spark, str(folder), keys).orderBy("file", "block", "row").collect()
    return [(x.file.rsplit("/", 1)[1], x.name, json.loads(x.item)) for x in rows]


@pytest.mark.parametrize(("seed", "indent"), [(0, None), (1, 2), (2, None), (3, 1)])
def test_json_lists_in_splits(spark, tmp_path, small_splits, seed, indent):
    r = random.Random(seed)
    want = []
    for k in range(4):
        items, more = ([random_item(r) for _ in range(r.choice([0, 1, 30]))] for _ in range(2))
        body = items if k % 2 else {"saved": 'at "noon" }', "other": more, "collected": items, "meta": {"codes": more, "collected": 3}, "last": [[1], "x"]}
        (tmp_path / f"{k}.json").write_text(json.dumps(body, indent=indent, ensure_ascii=k == 0))
        want += [(f"{k}.json", "" if k % 2 else "collected", x) for x in items]
    assert items_of(spark, tmp_path, split_json.DATASET) == want


@pytest.mark.parametrize("indent", [None, 2])
def test_json_bundles_in_splits(spark, tmp_path, small_splits, indent):
    r = random.Random(5)
    parts = {n: [random_item(r) for _ in range(25)] for n in ("collected_data", "coded_data", "codes")}
    body = {"session_id": "s", "collected_data": parts["collected_data"], "coded_data": parts["coded_data"], "codebook": {"name": "n", "notes": [random_item(r)], "codes": parts["codes"], "about": {"x": 1}}, "log": [random_item(r)]}
    (tmp_path / "a.json").write_text(json.dumps(body, indent=indent))
    assert items_of(spark, tmp_path, split_json.BUNDLE) == [("a.json", n, x) for n in ("collected_data", "coded_data", "codes") for x in parts[n]]


def test_lists_beside_objects(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"id": 1, "t": "x"},\n {"id": 2, "t": "y\\nz"}]')
    (tmp_path / "b.json").write_text('{"collected": [{"id": 3, "more": true}]}')
    (tmp_path / "c.json").write_text("[]")
    rows = readers.read_dataset_json(spark, str(tmp_path)).orderBy("id").collect()
    assert [(x.id, x.t, x.more) for x in rows] == [(1, "x", None), (2, "y\nz", None), (3, None, True)]


def test_a_large_file_is_read_by_many_tasks(spark, tmp_path, small_splits):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    (tmp_path / "a.json").write_text(json.dumps([{"id": k, "text": "some text } " * 5} for k in range(20_000)]))
    found = split_json.json_items(spark, str(tmp_path))
    tasks = found.withColumn("task", F.spark_partition_id()).groupBy("task").count().count()
    assert found.count() == 20_000 and tasks > 10


def test_objects_behind_each_other_in_a_file(spark, tmp_path, small_splits):
    (tmp_path / "in").mkdir()
    made = [{"note": "}{", "collected": [{"id": f"{k}-{j}", "text": 'a } { "b' * (j % 7)} for j in range(k % 9)]} for k in range(40)]
    for f in range(2):
        (tmp_path / "in" / f"{f}.json").write_text("\n".join(json.dumps(x) for x in made[f::2]))
    found = readers.read_dataset_json(spark, str(tmp_path / "in")).collect()
    assert sorted((x.id, x.text) for x in found) == sorted((x["id"], x["text"]) for m in made for x in m["collected"])


def test_dataset_has_no_file_for_each_user(spark, sf_dir, tmp_path, monkeypatch):
    monkeypatch.setattr(texts, "scratch", lambda spark, label: str(tmp_path / label))
    users = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id").distinct().count()
    texts.dataset_files(spark, sf_dir)
    assert len(list((tmp_path / "dataset").glob("part-*"))) <= 4 < users


def test_pieces_are_taken_by_bytes(monkeypatch):
    batch = pa.RecordBatch.from_pydict({"piece": ["x" * 1000] * 50})
    monkeypatch.setattr(split_json, "SLICE_BYTES", 10_000)
    sizes = [b.num_rows for b in split_json._slices(batch)]
    assert sum(sizes) == 50 and max(sizes) <= 10
    assert list(split_json._slices(batch.slice(0, 0))) == []
