"""Tails against exact sums and known values."""

import math
from fractions import Fraction

import numpy as np
import pytest

from quillon.functions import distributions as d


def test_log_gamma():
    x = np.array([0.1, 0.5, 1, 2.5, 10, 100.5, 1e6])
    assert np.allclose(d.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-13, atol=1e-13)


@pytest.mark.parametrize("k,m,g,n", [(3, 50, 10, 12), (0, 20, 5, 5), (6, 20, 5, 5), (5, 20, 5, 5), (40, 2000, 300, 150), (1, 5, 5, 5)])
def test_hypergeometric(k, m, g, n):
    exact = sum(Fraction(math.comb(g, j) * math.comb(m - g, n - j), math.comb(m, n)) for j in range(max(k, 0), min(g, n) + 1))
    assert d.hypergeometric_sf([k], [m], [g], [n])[0] == pytest.approx(float(exact), rel=1e-10, abs=1e-300)


def test_nb_tail_small_and_large():
    alpha, mean = 0.5, 3.0
    n = 1 / alpha
    p = n / (n + mean)
    pmf = [math.exp(math.lgamma(x + n) - math.lgamma(n) - math.lgamma(x + 1) + n * math.log(p) + x * math.log(1 - p)) for x in range(400)]
    for x in (0, 2, 10):
        assert d.nb_sf(np.array([x]), np.array([mean]), np.array([alpha]))[0] == pytest.approx(1 - sum(pmf[: x + 1]), rel=1e-9)
    tail = d.nb_sf(np.array([5000.0]), np.array([4000.0]), np.array([0.001]))[0]
    assert 0 < tail < 1e-10
    assert d.nb_sf(np.array([-1.0]), np.array([1.0]), np.array([1.0]))[0] == 1


def test_known_values():
    assert d.normal_isf(np.array([0.025, 0.5, 0.975]))[0] == pytest.approx(1.959963984540054, abs=1e-12)
    assert d.normal_isf(np.array([0.5]))[0] == pytest.approx(0, abs=1e-12)
    assert d.normal_isf(d.normal_sf(np.array([9.0])))[0] == pytest.approx(9, abs=1e-9)
    assert d.chi2_sf(np.array([3.841458820694124]), np.array([1.0]))[0] == pytest.approx(0.05, abs=1e-12)
    assert d.chi2_sf(np.array([0.0]), np.array([4.0]))[0] == 1
    assert d.t_two_sided(np.array([2.2281388519649385]), np.array([10.0]))[0] == pytest.approx(0.05, abs=1e-10)
    assert d.beta_inc(np.array([2.0]), np.array([3.0]), np.array([0.4]))[0] == pytest.approx(0.5248, abs=1e-12)
