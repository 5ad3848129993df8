"""Relabellings against sorting, draws of any size against exact probabilities, and the tests that use them."""

import hashlib
import math
from collections import Counter

import numpy as np
import pytest

from plumbline.operators import relabelling, shift


def plain(rows, n, count, seed):
    """(replicate, label) -> sums over the first n rows by hash."""
    out = {}
    for b in range(1, count + 1):
        order = sorted(rows, key=lambda r: (hashlib.sha256(f"{seed}|{b}|{r[0]}".encode()).hexdigest(), str(r[0])))
        for _, label, x in order[:n]:
            out[b, label] = np.asarray(out.get((b, label), 0.0)) + np.asarray([*x, 1.0])
    return out


@pytest.mark.parametrize("n", [0, 1, 70, 199, 200])
def test_sums_equal_those_of_sorted_rows(spark, n):
    rng = np.random.default_rng(n)
    rows = [(i, None if i % 11 == 0 else "abc"[i % 3], [float(v) for v in rng.normal(size=3)]) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, label string, x array<double>").repartition(3)
    got = {}
    for r in relabelling.relabelled_sums(df, n, 200, 12, "s").collect():
        got.setdefault((r.replicate, r.label), np.zeros(4))[r["at"]] = r.value
    want = plain(rows, n, 12, "s")
    assert {k for k, v in got.items() if v[3]} == set(want)
    for k, v in want.items():
        np.testing.assert_allclose(got[k], v, atol=1e-9)


def test_a_missed_strip_is_widened(spark, monkeypatch):
    monkeypatch.setattr(relabelling, "DEVIATIONS", 0.01)
    rows = [(i, "a", []) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, label string, x array<double>")
    assert {r.value for r in relabelling.relabelled_sums(df, 120, 300, 20, "t").collect() if r["at"] == 0} == {120.0}


def test_large_draws_follow_the_distribution(monkeypatch):
    monkeypatch.setattr(relabelling, "MOST_DRAWN", 10)
    rng = np.random.default_rng(3)
    good, bad, take = 30, 50, 20
    seen = Counter(relabelling.hypergeometric(rng, good, bad, take) for _ in range(20_000))
    for k in range(2, 14):
        share = math.comb(good, k) * math.comb(bad, take - k) / math.comb(good + bad, take)
        assert abs(seen[k] / 20_000 - share) < 5 * math.sqrt(share / 20_000) + 1e-4
    totals = np.array([5, 0, 40, 7, 100])
    for b in range(50):
        drawn = relabelling.drawn_counts(totals, 60, 1, b)
        assert drawn.sum() == 60 and (drawn <= totals).all() and (drawn >= 0).all()


def test_draws_beyond_the_generators_bound():
    totals = np.array([2 * 10**9, 10**9, 10**6, 3 * 10**9])
    take = 2 * 10**9
    for b in range(5):
        drawn = relabelling.drawn_counts(totals, take, 7, b)
        assert drawn.sum() == take and (drawn <= totals).all()
        assert np.abs(drawn / totals - take / totals.sum()).max() < 5e-3


def test_a_column_of_any_size_is_tested(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(c, i, "reference" if i % 2 else "current", float(rng.integers(0, 40) + (9 if c == "moved" and i % 2 else 0))) for c in ("moved", "same") for i in range(800)]
    df = spark.createDataFrame(rows, "column string, id long, side string, value double")
    monkeypatch.setattr(shift, "DRAWN_ROWS", 100)
    for most in (10**9, 300):
        monkeypatch.setattr(relabelling, "MOST_DRAWN", most)
        got = {r.column: r for r in shift.psi_permutation_test(df, count=99).collect()}
        assert got["moved"].p == pytest.approx(0.01) and got["same"].p > 0.02
