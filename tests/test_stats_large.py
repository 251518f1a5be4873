"""Chance baselines beyond pools that whole numbers can carry, against the exact ones."""

import numpy as np
import pytest

from kinsieve.operators import stats


@pytest.mark.parametrize("pool, bench, sample", [(40, 12, 9), (7, 3, 0), (6, 4, 6), (1, 1, 1), (5000, 700, 900), (3000, 1, 2999)])
def test_distribution_equals_exact_ways(pool, bench, sample):
    first, p = stats.distribution(pool, bench, sample)
    ways = stats._ways(pool, bench, sample)
    exact = np.array([w / sum(ways) for w in ways])
    got = np.zeros(len(exact))
    got[first : first + len(p)] = p
    assert np.allclose(got, exact, rtol=1e-9, atol=1e-22)


def test_tails_equal_exact_ones(monkeypatch):
    strata = [(300, 40, 31, 3), (25, 10, 5, 40), (1200, 300, 200, 2), (9, 9, 4, 1), (6, 4, 6, 2)]
    for observed in (150, 220, 240, 300):
        exact = stats.stratified(strata, observed)
        monkeypatch.setattr(stats, "EXACT_POOL", 0)
        free = stats.stratified(strata, observed)
        monkeypatch.undo()
        for k in ("p_at_least", "p_at_most", "expected", "sd", "z"):
            assert free[k] == pytest.approx(exact[k], abs=1e-9), (observed, k)


def test_long_distributions_are_convolved_by_transforms(monkeypatch):
    strata = [(400_000, 90_000, 60_000, 3), (900_000, 100_000, 300_000, 1)]
    fast = stats.stratified(strata, 74_100)
    monkeypatch.setattr(stats, "LONG", 10**9)
    slow = stats.stratified(strata, 74_100)
    assert fast["p_at_least"] == pytest.approx(slow["p_at_least"], abs=1e-9) and 0.01 < fast["p_at_least"] < 0.99
    assert fast["p_at_least"] + fast["p_at_most"] > 1


def test_pools_of_hundreds_of_millions_and_many_strata():
    one = stats.hypergeom(400_000_000, 30_000_000, 2_000_000, 150_200)
    assert one["expected"] == 150_000 and one["p_at_least"] == pytest.approx(0.2953, abs=2e-3)
    many = stats.stratified([(50 + k % 400, 10 + k % 30, 5 + k % 17, 1000) for k in range(2000)], 4_000_000)
    assert 0 <= many["p_at_least"] <= 1 and many["sd"] > 0
    nothing = stats.stratified([], 0)
    assert nothing["p_at_least"] == nothing["p_at_most"] == 1 and nothing["z"] is None
