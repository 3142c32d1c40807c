import random

import pytest

from colloquy.llm import near_join
from colloquy.llm.components import components

from .helpers import edge_docs, edge_rows, empty_docs, in_order, near_classes


def planted(n=400):
    r = random.Random(1)
    hub = [f"{r.choice('abcdefgh')}{r.randint(0, 10**6)}" for _ in range(120)]
    out = []
    for i in range(n):
        text = list(hub)
        for _ in range(r.randint(0, 4)):
            text[r.randrange(120)] = f"zz{r.randint(0, 9999)}"
        out.append((10**6 + i, " ".join(text)))
    return out


def test_share_that_is_found():
    assert near_join.found_share(0.8, 8) < near_join.found_share(0.8, 6) and near_join.found_share(0.8, 6) >= near_join.RECALL
    assert near_join.shortest_prefix(0.8, near_join.RECALL) == 6 and near_join.shortest_prefix(0.8, 0.99) == 8 and near_join.shortest_prefix(0.01, 0.99) == 1
    assert 0.5 < near_join.least_estimate(0.8) < 0.6


def open_texts(spark, monkeypatch, rows, recall):
    """How many texts are open at each prefix length, among those that share a node of the shortest one."""
    seen, real = [], near_join._matches
    monkeypatch.setattr(near_join, "_matches", lambda members, *rest: seen.append(members.where("open").select("id").distinct().count()) or real(members, *rest))
    near_join.near_classes(spark.createDataFrame(rows, "doc_id long, text string"), recall=recall).count()
    return seen


def test_prefixes_shorten_text_by_text(spark, monkeypatch):
    """Close copies are done with whole labels; texts with partners near the threshold go on until the recall is reached."""
    r = random.Random(3)
    alone = [(i, " ".join(f"{r.randint(0, 10**6)}" for _ in range(60))) for i in range(30)]
    base = [f"{r.randint(0, 10**6)}" for _ in range(400)]
    close = [(100 + i, " ".join(base[:-1] + [f"x{i}"])) for i in range(20)]
    far = [f"{r.randint(0, 10**6)}" for _ in range(400)]
    border = [(200, " ".join(far)), (201, " ".join(far[:355] + [f"y{i}" for i in range(45)]))]
    with monkeypatch.context() as m:
        assert open_texts(spark, m, alone + close + border, near_join.RECALL) == [22, 2, 2]
    with monkeypatch.context() as m:
        assert open_texts(spark, m, alone + close, 0.99) == [20]


def test_edge_cases(spark):
    found = near_join.near_classes(edge_docs(spark)).collect()
    assert in_order(found) == in_order(near_classes([r[:2] for r in edge_rows()]))


def test_empty_table(spark):
    assert near_join.near_classes(empty_docs(spark)).count() == 0
    assert near_join.one_of_each(empty_docs(spark)).count() == 0


def test_large_set_in_blocks(spark, sf_dir):
    """Links within and across blocks of one set of near copies, beside the documents."""
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()] + planted()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert in_order(near_join.near_classes(docs, block=64).collect()) == in_order(near_classes(rows))


def test_blocks_travel_not_texts(spark, monkeypatch):
    """A set of 900 near copies in blocks of 128: fewer rows are shuffled for its pairs than it has texts, and they are compressed together."""
    seen, real = [], near_join._units
    monkeypatch.setattr(near_join, "_units", lambda *args: seen.append(real(*args).cache()) or seen[-1])
    rows = planted(900)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert in_order(near_join.near_classes(docs, block=128).collect()) == in_order(near_classes(rows))
    assert 0 < seen[0].count() < 900
    packed, plain = seen[0].selectExpr("sum(octet_length(shingles))", "sum(8 * aggregate(sizes, 0, (a, b) -> a + b))").first()
    assert packed < 0.3 * plain


def test_blocks_of_few_shingles(spark, monkeypatch):
    """Blocks bounded by shingles, nodes dealt to several tasks, and texts of very different sizes in one set."""
    monkeypatch.setattr(near_join, "NODE", 16)
    r = random.Random(8)
    base = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(base[: r.randint(150, 400)])) for i in range(120)]
    rows += [(200 + i, " ".join(base[: 150 + 20 * i] * 3)) for i in range(10)]  # a shingle that repeats counts once
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert in_order(near_join.near_classes(docs, block_shingles=1_500).collect()) == in_order(near_classes(rows))


def test_one_of_each(spark):
    docs = edge_docs(spark)
    kept = near_join.one_of_each(docs)
    assert kept.columns == docs.columns
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    leads = {c for _, c, *_ in near_classes([r[:2] for r in edge_rows()])}
    assert {i for i, _ in rows} == leads
    # Documents without ids have no lead; each text of theirs stays once.
    assert sorted(i for i, _ in rows if i is not None) == sorted(i for i in leads if i is not None)


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 100), (7, 7)]
    found = components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert sorted(map(tuple, found)) == [(i, 1) for i in range(1, 41)] + [(100, 100), (101, 100)]
    with pytest.raises(RuntimeError, match="settle"):
        components(spark.createDataFrame(edges, "u long, v long"), most_rounds=2)
