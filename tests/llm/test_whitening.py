import math
from fractions import Fraction

import numpy as np
import pytest

from colloquy.llm import queries, spectrum, whitening


def rotated(values, seed=0):
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))
    a = (q * np.array(values)) @ q.T
    return (a + a.T) / 2


@pytest.mark.parametrize("shift", [-3.0, 0.0, 0.5, 1.0, 2.5, 9.0])
def test_inertia_counts(shift):
    values = [-2.0, -2.0, 0.25, 0.75, 2.0, 2.0 + 1e-9, 7.0]
    assert spectrum.above(rotated(values), shift) == sum(v > shift for v in values)


def test_factor_of_awkward_matrices():
    assert spectrum.Factor(np.array([[0.0, 1.0], [1.0, 0.0]])).above() == 1
    assert spectrum.Factor(np.zeros((3, 3))).above() == 0
    a = rotated(list(np.linspace(-1, 1, 30)), 3)
    b = np.arange(30.0)
    assert np.allclose(a @ spectrum.Factor(a).solve(b, 1e-18), b, atol=1e-9)


@pytest.mark.parametrize(
    "values", [[5, 4, 3, 2, 1], [5, 5, 5, 1, 0.5], [1 + 1e-7, 1, 1 - 1e-7, 0.2, 0.1, 0.0], [3.0] * 6, [1e6, 1, 1e-6, 0, 0], list(np.linspace(1, 1.001, 64)), [2.0], [2.0, -8.0]]
)
def test_leading_pairs(values):
    values = np.sort(np.array(values, float))[::-1]
    a = rotated(values, len(values))
    found, vectors = spectrum.leading(a, 4)
    scale = np.abs(values).max()
    assert len(found) == min(4, len(values))
    assert np.allclose(found, values[:4], atol=1e-13 * scale * len(values))
    assert np.allclose(vectors @ vectors.T, np.eye(len(found)), atol=1e-12)
    assert np.abs(a @ vectors.T - vectors.T * found).max() <= 1e-13 * scale * len(values)


def brute(rows):
    xs = [(i, [math.floor(256 * float(c)) for c in e]) for i, e in rows if e is not None and all(c is not None and math.isfinite(c) for c in e)]
    fit = sorted({tuple(x) for _, x in xs})
    n, d = len(fit), len(fit[0])
    s = [sum(x[j] for x in fit) for j in range(d)]
    y = [[Fraction(n * x[j] - s[j], n) for j in range(d)] for x in fit]
    v = np.array([[float(sum(r[i] * r[j] for r in y) / n) for j in range(d)] for i in range(d)])
    return xs, n, s, v


def held_to(found, rows):
    xs, n, s, v = brute(rows)
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1].T
    k = min(4, len(v))
    assert len(found) == k * len(xs)
    # The sign of a component is free, but the same for all rows.
    signs = {}
    want = {}
    for i, x in xs:
        middle = np.array([(n * c - t) / n for c, t in zip(x, s, strict=True)])
        want.setdefault(i, []).append((sum((n * c - t) ** 2 for c, t in zip(x, s, strict=True)), middle))
    for r in found:
        match = [m for dev, m in want[r.vec_id] if dev == r.deviation]
        assert r.n == n and match
        assert abs(r.explained - values[r.component - 1] / np.trace(v)) < 1e-9
        plain = min((match[0] @ vectors[r.component - 1] / math.sqrt(values[r.component - 1]) * g for g in ([signs[r.component]] if r.component in signs else [1, -1])), key=lambda w: abs(w - r.whitened))
        assert abs(plain - r.whitened) < 1e-8 + 1e-14 * values[0] / values[k - 1]
        if r.component not in signs and abs(plain) > 1e-3:
            signs[r.component] = 1 if plain * (match[0] @ vectors[r.component - 1]) > 0 else -1
        assert r.identity_error < 1e-12 + 1e-14 * values[0] / values[k - 1]  # what doubles can give
    assert len({r.identity_error for r in found}) == 1


def test_query_against_plain_numbers(spark, sf_dir):
    df = queries.op13_embedding_whitening(spark, sf_dir)
    held_to(df.collect(), [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()])


def test_awkward_rows(spark):
    r = np.random.default_rng(5)
    rows = [(i, [1000 + float(c) for c in r.standard_normal(5) * [4, 3, 2, 1, 0.5]]) for i in range(40)]
    rows += [rows[3], (3, rows[4][1]), (None, rows[5][1]), (50, None), (51, [1.0, None, 1.0, 1.0, 1.0]), (52, [float("nan")] * 5), (53, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (54, [1.5e4, -2.0, 0.0, 1.0, 3.0])]
    short = [(60, [1.0]), (61, [])]
    df = spark.createDataFrame([(*x, "n", 1.0) for x in rows + short], "vec_id long, embedding array<float>, n string, x double")
    as_float = [(i, e if e is None else [None if c is None else float(np.float32(c)) for c in e]) for i, e in rows]
    held_to(whitening.whiten(df).collect(), as_float)


def test_little_variance(spark):
    same = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>")
    rows = whitening.whiten(same).collect()
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in rows] == [(1, 0, None, None, None)] * 4
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 0.0]) for i in range(3)], "vec_id long, embedding array<double>")
    rows = whitening.whiten(line).collect()
    assert {r.component: r.whitened is None for r in rows} == {1: False, 2: True, 3: True}
    assert max(abs(r.explained - (r.component == 1)) for r in rows) < 1e-12 and rows[0].identity_error < 1e-12


def test_empty_table(spark):
    for rows in ([], [(1, None), (2, [])]):
        df = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
        assert df.count() == 0 and "identity_error" in df.columns
