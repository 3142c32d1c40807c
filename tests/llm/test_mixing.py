from collections import defaultdict

import duckdb
import pytest

from colloquy.llm import mixing
from colloquy.llm.queries import oracle_sql

from .helpers import edge_docs, edge_rows, empty_docs, in_order, words


def shared_targets(totals):
    """Shares by weight 1, 2, 3; what exceeds three times a source is shared again until none does."""
    names = sorted(totals, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, open_, left = dict.fromkeys(names, 0.0), set(names), float(sum(totals.values()))
    while open_ and left > 1e-9:
        unit = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if target[s] + unit * weight[s] >= 3 * totals[s]}
        if not full:
            for s in open_:
                target[s] += unit * weight[s]
            break
        for s in full:
            target[s] = 3.0 * totals[s]
        left = sum(totals.values()) - sum(target[s] for s in names if s not in open_ or s in full)
        open_ -= full
        for s in open_:
            target[s] = 0.0
    return target


@pytest.mark.parametrize("totals", [{"a": 10, "b": 10, "c": 10}, {"a": 1000, "b": 1, "c": 1, None: 50}, {"a": 0, "b": 0}, {"x": 5}, {f"s{i}": i * i for i in range(30)}])
def test_targets(spark, totals):
    rows = spark.createDataFrame(list(totals.items()), "source string, total long")
    found = {r.source: r.target for r in mixing.targets(rows).collect()}
    assert found == pytest.approx(shared_targets(totals))


def test_edge_cases(spark):
    docs = edge_docs(spark)
    rows = mixing.mix_sources(docs).collect()
    assert in_order((r.doc_id, r.size) for r in rows) == in_order((i, len(words(t))) for i, t, *_ in edge_rows())
    assert all(0 <= r.taken <= 3 * r.size for r in rows)
    wanted = {(r.source_size, r.target) for r in rows}
    assert sum(r.taken for r in rows) == sum(round(t) for _, t in wanted)
    assert in_order(rows) == in_order(mixing.mix_sources(docs.repartition(3)).collect())
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert {r.text for r in mixed.collect()} <= {r[1] for r in edge_rows()}


def test_empty_table(spark):
    assert mixing.mix_sources(empty_docs(spark)).count() == 0
    assert mixing.mixed_documents(empty_docs(spark)).count() == 0


@pytest.mark.parametrize("per_range", [3, 2_000])
def test_budgets_are_met_to_the_word(spark, sf_dir, per_range):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = mixing.mix_sources(docs, rows_per_range=per_range).join(docs.select("doc_id", "source"), "doc_id").collect()
    by_source = defaultdict(lambda: [0, 0.0])
    for r in rows:
        by_source[r.source][0] += r.taken
        by_source[r.source][1] = r.target
    assert all(taken == round(target) for taken, target in by_source.values())


def test_agrees_with_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    found = mixing.mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"), rows_per_range=20)
    want = con.execute(oracle_sql()["op4_source_mixing"])
    columns = [c[0] for c in want.description]
    assert in_order(found.select(*columns).collect()) == in_order(want.fetchall())
