import hashlib
import random

import numpy as np
import pytest

from colloquy.llm import suffix_arrays, suffix_dedup
from colloquy.llm.suffix_arrays import permuted_common_prefixes, suffix_array

from .helpers import edge_docs, edge_rows, empty_docs, in_order


@pytest.mark.parametrize("small", [1024, 2])
def test_suffix_arrays_and_common_prefixes(small, monkeypatch):
    """Bucket by bucket, and sign by sign as for large alphabets."""
    monkeypatch.setattr(suffix_arrays, "SMALL_ALPHABET", small)
    r = random.Random(2)
    for _ in range(300):
        text = [r.randint(1, r.choice([1, 2, 3, 5])) for _ in range(r.randint(0, 60))] + [0]
        order = sorted(range(len(text)), key=lambda i: text[i:])
        assert suffix_array(np.array(text)).tolist() == order
        common = permuted_common_prefixes(np.array(text), np.array(order))
        for a, b in zip(order, order[1:], strict=False):
            k = 0
            while a + k < len(text) and b + k < len(text) and text[a + k] == text[b + k]:
                k += 1
            assert common[b] == k


def test_suffix_array_of_text(spark, sf_dir):
    """A long text with deep recursion: neighbours are in order, and their common prefixes are right."""
    raw = "\n".join(r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()).encode()[:200_000]
    text = np.append(np.frombuffer(raw, np.uint8).astype(np.int64) + 1, 0)
    array = suffix_array(text)
    common = permuted_common_prefixes(text, array)
    assert sorted(array.tolist()) == list(range(len(text)))
    for a, b in zip(array[:-1].tolist(), array[1:].tolist(), strict=True):
        k = int(common[b])
        assert np.array_equal(text[a : a + k], text[b : b + k]) and text[a + k] < text[b + k]


def brute(rows, length):
    raws = [(t or "").encode() for _, t in rows]
    seen = {}
    for raw in raws:
        for s in range(len(raw) - length + 1):
            window = raw[s : s + length]
            seen[window] = seen.get(window, 0) + 1
    out = []
    for (i, _), raw in zip(rows, raws, strict=True):
        gone, reach = bytearray(len(raw)), 0
        for s in range(len(raw) - length + 1):
            if seen[raw[s : s + length]] > 1:
                for x in range(max(s, reach), s + length):
                    gone[x] = 1
                reach = s + length
        kept = bytes(c for c, g in zip(raw, gone, strict=True) if not g)
        runs = sum(g and (j == 0 or not gone[j - 1]) for j, g in enumerate(gone))
        out.append((i, len(raw), len(raw) - len(kept), runs, hashlib.sha256(kept).hexdigest()))
    return out


def planted():
    r = random.Random(1)
    passage = "".join(r.choice("abcdé fgh") for _ in range(120))
    out = [(8, "a" * 500), (9, "ab" * 150)]
    for i in range(120):
        around = ["".join(r.choice("abcdefgh ") for _ in range(r.randint(0, 150))) for _ in range(2)]
        out.append((10**6 + i, around[0] + passage[r.randint(0, 40) : r.randint(80, 120)] + around[1]))
    return out


@pytest.mark.parametrize("most_contexts", [2_000, 10, 1])
def test_against_all_windows(spark, most_contexts):
    """Shards, and the longer anchors that take over where an anchor has too many contexts."""
    rows = [r[:2] for r in edge_rows() if r[0] != 7] + planted()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = suffix_dedup.remove_repeats(docs, length=50, grams=(12, 30, 50), most_contexts=most_contexts, shard_bytes=5_000)
    assert in_order(found.collect()) == in_order(brute(rows, 50))


def test_edge_cases(spark):
    found = suffix_dedup.remove_repeats(edge_docs(spark)).collect()
    assert in_order(found) == in_order(brute([r[:2] for r in edge_rows()], 200))


def test_empty_table(spark):
    assert suffix_dedup.remove_repeats(empty_docs(spark)).count() == 0


def test_long_texts_are_served_in_parts(spark):
    """The stretches of a long text share no window and leave none out."""
    r = random.Random(9)
    text = "".join(r.choice("abcd") for _ in range(5_000))
    docs = spark.createDataFrame([(1, text), (2, text[1_000:3_000])], "doc_id long, text string")
    found = suffix_dedup.anchors(suffix_dedup.keyed(docs), 50, 12, 400).collect()
    assert sum(x.more + 1 for x in found) == 5_000 - 49 + 2_000 - 49
    assert len({x.anchor for x in found if x.more}) < len(found)


def test_long_runs_make_few_contexts(spark):
    """A run of one sign or of a short pattern is a few contexts, not one for each byte."""
    rows = [(1, "x" + "-" * 60_000 + "y"), (2, "ab" * 20_000), (3, "q" * 150 + "r")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert suffix_dedup.anchors(suffix_dedup.keyed(docs), 200, 64).count() < 400
    assert in_order(suffix_dedup.remove_repeats(docs).collect()) == in_order(brute(rows, 200))
