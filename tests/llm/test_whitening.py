"""Whitening against numpy's eigenvectors and whole-number arithmetic in plain Python."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from runlake.llm import queries, whitening as w

CLASH = "vec_id long, embedding array<double>, label int, x string, n string, component string, id string, v string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, e, 0, "x", "n", "c", "i", "v") for i, e in rows], CLASH)


def plain(rows, k=4):
    """The contract by brute force: (vec_id, deviation, whitened of each component, explained)."""
    kept = [(i, [math.floor(256 * c) for c in e]) for i, e in rows if e is not None and all(c is not None and math.isfinite(c) for c in e)]
    fit = [list(t) for t in {tuple(x) for _, x in kept}]
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    x = np.array(fit, float) - np.array([s / n for s in sums])
    values, basis = np.linalg.eigh(x.T @ x / n)
    values, basis = values[::-1][:k], basis[:, ::-1][:, :k]
    out = []
    for i, row in kept:
        white = (np.array(row) - np.array([s / n for s in sums])) @ basis / np.sqrt(values)
        out.append((i, sum((n * c - s) ** 2 for c, s in zip(row, sums)), white))
    return n, values / np.trace(x.T @ x / n), out


def check(found, rows, k=4):
    n, explained, expected = plain(rows, k)
    by_row = {}
    for r in found:
        by_row.setdefault((r["vec_id"], r["deviation"]), []).append(r)
        assert r["n"] == n and r["identity_error"] < 1e-9 and abs(r["explained"] - explained[r["component"] - 1]) < 1e-9
    white = np.array([x for _, _, x in expected])
    signs = None
    for i, deviation, x in expected:
        own = {r["component"]: r["whitened"] for r in by_row[(i, deviation)]}
        got = np.array([own[c + 1] for c in range(len(x))])
        signs = np.where(got * x < 0, -1, 1) if signs is None else signs  # the first row is far from the mean
        assert np.allclose(got, x * signs, atol=1e-8)
    assert len(found) == white.size


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 24), st.integers(0, 10_000), st.sampled_from(["free", "spread", "low rank", "equal"]))
def test_components_are_eigenvectors(d, seed, kind):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((40, d)) * (np.exp(3 * rng.standard_normal(d)) if kind == "spread" else 1)
    if kind == "low rank":
        x = x[:, :1] @ rng.standard_normal((1, d)) + 0
    v = np.eye(d) * 2.5 if kind == "equal" else x.T @ x / 40
    values, basis = w.leading(v, 4)
    assert np.allclose(values, np.linalg.eigvalsh(v)[::-1][:4], atol=1e-12 * np.abs(v).max() * d)
    assert np.allclose(basis.T @ basis, np.eye(len(values)), atol=1e-12)
    assert np.linalg.norm(v @ basis - basis * values) <= 1e-12 * d * np.linalg.norm(v)


def test_polar_factor_is_the_sign():
    rng = np.random.default_rng(3)
    a = rng.standard_normal((30, 30))
    a = a + a.T
    values, basis = np.linalg.eigh(a)
    assert np.allclose(w.polar(a), basis * np.sign(values) @ basis.T, atol=1e-12)
    near = basis * np.where(np.arange(30) == 4, 1e-13, values) @ basis.T  # almost singular
    assert np.allclose(w.polar(near) @ w.polar(near), np.eye(30), atol=1e-10)


def test_rows_nulls_repeats_and_odd_entries(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.standard_normal(6) * [3, 2, 1, 1, 0.5, 0.2]).tolist()) for i in range(200)]
    rows[0] = (0, [9.0, 9.0, 9.0, 9.0, 3.0, 2.0])
    rows += rows[5:9] + [(7, [0.001] * 6), (None, rows[3][1]), (900, [-0.0] * 6)] + [(1000 + i, rows[11][1]) for i in range(120)]
    bad = [(901, None), (902, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (903, [float("nan")] * 6), (904, [1.0, float("inf"), 0.0, 0.0, 0.0, 0.0])]
    found = w.whiten(vectors(spark, rows + bad).repartition(5)).collect()
    check(sorted(set(map(lambda r: r, found)), key=repr), list({(i, tuple(e)): (i, e) for i, e in rows}.values()))
    assert len(found) == 4 * len(rows)


def test_a_row_of_another_length_stays_without_values(spark):
    rows = [(i, [float(i % 7), float(i * i % 5), 1.0 * i]) for i in range(30)] + [(99, [1.0, 2.0])]
    found = w.whiten(vectors(spark, rows)).where("vec_id = 99").collect()
    assert found and all(r["deviation"] is None and r["whitened"] is None and r["n"] == 30 for r in found)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [])], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]])
def test_without_variance_there_are_no_rows(spark, rows):
    found = w.whiten(vectors(spark, rows))
    assert found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and not found.collect()


def test_fewer_components_than_wanted(spark):
    rows = [(i, [float(i), 2.0 * i]) for i in range(9)]
    assert {r["component"] for r in w.whiten(vectors(spark, rows)).collect()} == {1}


def test_deviations_are_exact_beyond_double():
    x = np.array([[10**6, -(10**6)], [3, 4]])
    assert w.deviations(x, 2001, [7, -9]) == [(2001 * 10**6 - 7) ** 2 + (-2001 * 10**6 + 9) ** 2, (6003 - 7) ** 2 + (8004 + 9) ** 2]
    assert w.deviations(x, 10**7, [0, 0]) == [None, 10**14 * 25]


def test_query_over_whole_embeddings(spark, tiny):
    rows = [(r["vec_id"], [float(c) for c in r["embedding"]]) for r in queries.table(spark, tiny, "embeddings").collect()]
    check(queries.op11_whitening(spark, tiny).collect(), rows)
