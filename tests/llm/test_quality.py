import random
import re
import subprocess
import sys
from collections import Counter
from pathlib import Path

import pyarrow as pa
import pytest

from colloquy.llm import quality
from colloquy.llm.textscan import pieces

from .helpers import LONG, edge_docs, edge_rows, empty_docs, words


def brute(text, least):
    ws = words(text)
    n = len(ws)
    best = [0] * n
    for i in range(n):
        for j in range(n):
            k = 0
            while i != j and i + k < n and j + k < n and ws[i + k] == ws[j + k]:
                k += 1
            best[i] = max(best[i], k)
    covered = {x for i in range(n) if best[i] >= least for x in range(i, i + best[i])}
    windows = Counter(zip(ws, ws[1:], ws[2:], strict=False))
    repeated = {x for i in range(n - 2) if windows[tuple(ws[i : i + 3])] > 1 for x in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return (n, sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(repeated), len(covered), max(best, default=0))


@pytest.mark.parametrize("limit", [1 << 20, 200])
def test_against_all_pairs(limit):
    r = random.Random(4)
    atoms = ["a", "b", "é#", "c d", "e\nf", "a\na"]
    texts = ["", "a", "a b", "x\n", "\n\n", "é é é é é é"]
    texts += [r.choice([" ", "\n", "  "]).join(r.choice(atoms[: r.randint(1, 6)]) for _ in range(r.randint(0, 60))) for _ in range(250)] + [""]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    found = []
    for _, data, off in pieces([batch], limit=limit):
        found += zip(*(v.tolist() for v in quality.measure(data, off, 4).values()), strict=True)
    assert found == [brute(t, 4) for t in texts]


def test_edge_cases(spark):
    rows = {(r.doc_id, r.n_words): r for r in quality.repetition_rules(edge_docs(spark)).collect()}
    assert len(rows) <= len(edge_rows())
    assert rows[4, 0].base_failed and not rows[4, 0].kept and rows[4, 0].longest_repeat == 0
    long = rows[7, len(words(LONG))]
    assert long.n_repeat_words == long.n_words and long.longest_repeat == long.n_words - 7 and not long.kept


def test_empty_table(spark):
    assert quality.repetition_rules(empty_docs(spark)).count() == 0


def test_repeats_are_limited(spark):
    own = " ".join(f"w{i}" for i in range(300))
    twice = " ".join(f"v{i}" for i in range(60))
    rows = [(1, own), (2, f"{own} {twice} and {twice}"), (3, f"{twice} and {twice} {' '.join(f'u{i}' for i in range(150))}"), (4, f"{own} {own}")]
    found = {r.doc_id: r for r in quality.repetition_rules(spark.createDataFrame(rows, "doc_id long, text string"), most_covered=0.35).collect()}
    assert found[1].kept and found[1].n_covered_words == 0
    assert found[2].kept and found[2].n_covered_words == 120 and found[2].longest_repeat == 60
    assert not found[3].base_failed and not found[3].kept
    assert not found[4].kept and found[4].longest_repeat == 300


def test_a_long_text_stays_within_memory():
    """16 MB of one text, measured in a process of its own: what is held beside it is bounded by its words."""
    code = (
        "import resource, numpy as np; from colloquy.llm import quality; r = np.random.default_rng(1); "
        "data = np.frombuffer(b' '.join(b'w%d' % i for i in r.integers(0, 50000, 2_700_000).tolist()), np.uint8); "
        "before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss; m = quality.measure(data, np.array([0, len(data)])); "
        "assert m['n_words'][0] == 2_700_000; print(len(data) / 1e6, (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1e3)"
    )
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=Path(__file__).resolve().parents[2]).stdout.split()
    assert float(out[0]) > 15 and float(out[1]) < 450
