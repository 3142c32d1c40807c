import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from colloquy.llm import queries, spelling

from .helpers import edge_docs, empty_docs, in_order

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def brute_counts(docs):
    n = Counter()
    for i, t in docs:
        for run in RUN.findall(t or ""):
            w = lower(run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 199 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    return {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}


def brute_near(words):
    """Near pairs through the words with one letter left out (with its place, for replaced letters)."""
    out = {w: set() for w in words}
    cut = {}
    for w in words:
        for i in range(len(w)):
            cut.setdefault((i, w[:i] + w[i + 1 :]), set()).add(w)
            if (v := w[:i] + w[i + 1 :]) in out:
                out[w].add(v)
                out[v].add(w)
    for of in cut.values():
        for w in of:
            out[w] |= of - {w}
    return out


def brute(n):
    near = brute_near(n)
    form = {}
    for w, of in near.items():
        best = min(of, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return [(w, form[w], root(w), k, len(near[w]), n[form[w]] if form[w] is not None else None) for w, k in n.items()]


def variants(r, base, most):
    out = set(base)
    while len(out) < most:
        w = r.choice(sorted(out))
        i = r.randrange(len(w))
        out.add(r.choice([w[:i] + w[i + 1 :], w[:i] + r.choice("abeé") + w[i:], w[:i] + r.choice("abeé") + w[i + 1 :]]) or "a")
    return sorted(out)


@pytest.mark.parametrize("depth", [0, 2])
def test_search_against_all_pairs(monkeypatch, depth):
    monkeypatch.setattr(spelling, "STATES", 50)
    r = random.Random(depth)
    words = variants(r, ["letters", "abababab", "q" * 63, "x" * 70], 300)
    n = {w: r.randint(5, 60) for w in words}
    near = brute_near(words)
    counts = np.array([n[w] for w in words])
    vec = spelling.vectors(*spelling.letters(pa.array(words)))
    met = Counter()
    for top in {tuple(v[:depth]) for v in vec.tolist()}:  # each subtree, with the words that may go there
        mine = [i for i, v in enumerate(vec.tolist()) if tuple(v[:depth]) == top]
        d = np.array(top, int) - vec[:, :depth] if depth else np.zeros((len(vec), 1), int)
        more, less = np.clip(d, 0, None).sum(1), np.clip(-d, 0, None).sum(1)
        who = np.flatnonzero((more <= 1) & (less <= 1))
        k, best, best_n = spelling.search(pa.array([words[i] for i in mine]), counts[mine], depth, pa.array([words[i] for i in who]), more[who], less[who])
        for x, i in enumerate(who.tolist()):
            met[words[i]] += int(k[x])
            here = near[words[i]] & {words[m] for m in mine}
            assert k[x] == len(here)
            assert (words[mine[best[x]]] if k[x] else None) == min(here, key=lambda v: (-n[v], v), default=None)
            assert best_n[x] == max((n[v] for v in here), default=0)
    assert {w: met[w] for w in words} == {w: len(of) for w, of in near.items()}


def random_docs(seed, n_words=150):
    r = random.Random(seed)
    words = variants(r, ["letter", "grouping", "éclairer", "abababa"], n_words)
    text = [w.upper() if r.random() < 0.1 else w for w in words for _ in range(r.choice([1, 4, 5, 6, 30, 31, 160]))]
    r.shuffle(text)
    docs = [(i, r.choice([" ", "-", "1"]).join(text[a : a + 50])) for i, a in enumerate(range(0, len(text), 50))]
    return docs + [(None, "letters letters"), (None, None), (9000, ""), (9001, "mixedÀÈ×÷word " * 7), (9002, "y" * 5000 + " " + ("z" * 200 + " ") * 6 + ("z" * 201 + " ") * 6)]


@pytest.mark.parametrize(("members", "visitors"), [(4000, 20_000), (3, 5)])
def test_against_brute_force(spark, members, visitors):
    docs = random_docs(3)
    found = spelling.group_variants(spark.createDataFrame(docs, "doc_id long, text string"), members, visitors).collect()
    plain = brute(brute_counts(docs))
    assert len(plain) > 100 and any(r[1] != r[2] and r[1] for r in plain)
    assert in_order(found) == in_order(plain)


def test_query_against_brute_force(spark, sf_dir):
    found = queries.op12_spelling_variants(spark, sf_dir)
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert in_order(found.collect()) == in_order(brute(brute_counts(docs)))


def test_edge_cases_and_empty_table(spark):
    docs = [(r.doc_id, r.text) for r in edge_docs(spark).collect()]
    assert in_order(spelling.group_variants(edge_docs(spark)).collect()) == in_order(brute(brute_counts(docs)))
    assert spelling.group_variants(empty_docs(spark)).count() == 0
