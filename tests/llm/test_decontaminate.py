import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from colloquy.llm import decontaminate as dc
from colloquy.llm.textscan import pieces

from .helpers import edge_docs, empty_docs, in_order

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, window=10):
    held = {}
    for i, t in items:
        ws = words(t)
        for k in range(max(1, len(ws) - window + 1) if ws else 0):
            held.setdefault(tuple(ws[k : k + window]), set()).add("" if i is None else str(i))
    sizes = {len(w) for w in held}
    out = []
    for i, t in docs:
        ws, hit, ids = words(t), set(), set()
        for size in sizes:
            for k in range(len(ws) - size + 1):
                if (of := held.get(tuple(ws[k : k + size]))) is not None:
                    hit.update(range(k, k + size))
                    ids |= of
        out.append((i, len(ws), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return out


def random_tables(seed, n=120):
    r = random.Random(seed)
    atoms = ["a", "B", "é", "c9", "longer-word", "ÀÉ", "x_y", "7", "verylongwordindeed", "日本"]
    some = lambda k, of: r.choice([" ", "\n", ", "]).join(r.choice(atoms[:of]) for _ in range(k))
    items = [(k, some(r.choice([1, 2, 3, 4, 5, 9, 10, 11, 14, 30]), r.choice([2, 4, 10]))) for k in range(25)] + [(3, "another text of item three that has rather more than ten words in it"), (None, "a b"), (None, None), (90, ""), (91, "- -")]
    docs = []
    for k in range(n):
        parts = [some(r.randint(0, 40), r.choice([2, 4, 10])) for _ in range(3)]
        if r.random() < 0.5:
            parts.insert(1, r.choice(items)[1] or "")
        docs.append((k, " ".join(parts)))
    return docs + [(500, None), (501, ""), (None, "a b a b"), (None, "a b a b")], items


@pytest.mark.parametrize("seed", range(4))
def test_scan_against_every_window(seed):
    docs, items = random_tables(seed)
    given = [("" if i is None else str(i), " ".join(words(t)).encode()) for i, t in items if words(t)]
    tables = dc.searches(dc.windows_of(given))
    assert len(tables) == 4
    found = []
    for part, data, off in pieces([pa.RecordBatch.from_arrays([pa.array([i for i, _ in docs]), pa.array([t for _, t in docs])], ["doc_id", "text"])], limit=3000):
        for i, n, spans, ids in zip(part.column(0).to_pylist(), *dc.scan(tables, data, off), strict=True):
            hit = sum(b - a for a, b in spans)
            assert all(a[1] < b[0] for a, b in zip(spans, spans[1:], strict=False))
            found.append((i, int(n), hit, len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), hit > 0))
    assert found == brute(docs, items)


def test_most_places_are_skipped():
    r = random.Random(1)
    item = " ".join(f"w{r.randint(0, 999)}" for _ in range(200)).encode()
    (table,) = dc.searches(dc.windows_of([("1", item)]))
    codes = np.random.default_rng(1).integers(0, 2**63, 100_000, dtype=np.uint64)
    looked, real = [0], dc._block
    dc._block = lambda c, last, size, mask: (looked.__setitem__(0, looked[0] + len(last)), real(c, last, size, mask))[1]
    try:
        list(table.ends(codes, np.array([0, len(codes)])))
    finally:
        dc._block = real
    assert looked[0] < 0.15 * len(codes)


@pytest.mark.parametrize("shard_bytes", [dc.SHARD_BYTES, 120])
def test_shards_change_nothing(spark, shard_bytes):
    docs, items = random_tables(9, 60)
    long = " ".join(words(" ".join(t for _, t in docs if t)))
    items.append((77, long))  # in pieces
    docs += [(600, "x " + long + " y"), (601, " ".join(long.split()[4090:4130]))]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert in_order(dc.decontaminate(d, b, shard_bytes).collect()) == in_order(brute(docs, items))


def test_edge_cases_and_empty_tables(spark):
    items = spark.createDataFrame([(1, "one", 0)], "item_id long, text string, spans int")
    rows = dc.decontaminate(edge_docs(spark), items).collect()
    docs = [(r.doc_id, r.text) for r in edge_docs(spark).collect()]
    assert in_order(rows) == in_order(brute(docs, [(1, "one")]))
    assert dc.decontaminate(empty_docs(spark), items).count() == 0
    assert {r.n_hit for r in dc.decontaminate(edge_docs(spark), items.limit(0)).collect()} == {0}
