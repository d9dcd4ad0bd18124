"""The two-component Jacobian against complex steps of the same formula, written out again."""

import numpy as np
import pytest

from duochron.plans.models import Heterodyne
from duochron.plans.parameters import TWO_COMPONENT

T = np.arange(12) * 0.5 + 0.5
Q, PHI = np.array([0.004, 0.006]), np.array([10.0, 90.0])


def complex_model(p, a, i, j):
    """offset + contrast * shape for complex parameters away from floors."""
    k = (len(p) - 14) // 2
    v = p[2 * k :]

    def running(scale, power, offset):
        rate = scale * np.exp(power * np.log(T)) + offset
        return np.concatenate([[0], np.cumsum((rate[1:] + rate[:-1]) / 2 * 0.5)])

    def soft(x):
        return np.log(1 + np.exp(50 * x)) / 50

    q = Q[a]
    cr, cm, cv = running(*v[0:3]), running(*v[3:6]), running(*v[6:9])
    hr, hs = (np.exp(-0.5 * q * q * np.sqrt((c[j] - c[i]) ** 2 + 1e-12)) for c in (cr, cm))
    fs = 1 - soft(1 - soft(v[9] * np.exp(v[10] * (T - v[11])) + v[12]))
    fr = 1 - fs
    beat = np.cos(q * np.cos((PHI[a] + v[13]) * np.pi / 180) * (cv[j] - cv[i]))
    x, y = fr[i] * fr[j] * hr, fs[i] * fs[j] * hs
    own = fs**2 + fr**2
    s = a if k > 1 else np.zeros_like(a)
    return p[k : 2 * k][s] + p[:k][s] * (x * x + y * y + 2 * x * y * beat) / (own[i] * own[j])


VALUES = {"D0_ref": 8000.0, "alpha_ref": 0.2, "D_offset_ref": 100.0, "D0_sample": 12000.0, "alpha_sample": -0.1, "D_offset_sample": 50.0, "v0": 90.0, "v_beta": 0.7, "v_offset": 3.0, "f0": 0.4, "f1": 0.05, "f2": 0.5, "f3": 0.1, "phi0_het": 2.0}


@pytest.mark.parametrize("shared", [True, False])
def test_jacobian_equals_complex_steps(shared):
    rng = np.random.default_rng(3)
    a, i, j = rng.integers(0, 2, 300), rng.integers(0, 12, 300), rng.integers(0, 12, 300)
    keep = i != j
    a, i, j = a[keep], i[keep], j[keep]
    model = Heterodyne(T, Q, PHI, 0.5, shared)
    p = np.array([0.3] * model.n_scaling + [1.1] * model.n_scaling + [VALUES[n] for n in TWO_COMPONENT])
    value, jac = model.evaluate(p, a, i, j)
    np.testing.assert_allclose(value, complex_model(p.astype(complex), a, i, j).real, rtol=1e-12)
    for k in range(len(p)):
        step = p.astype(complex)
        step[k] += 1e-30j
        exact = complex_model(step, a, i, j).imag / 1e-30
        np.testing.assert_allclose(jac[:, k], exact, rtol=1e-9, atol=1e-12 * max(1.0, np.abs(exact).max()), err_msg=str(k))


def test_floors_have_no_slope():
    """Rates below zero count as none, and so do their derivatives; nothing is infinite at a time of 0."""
    model = Heterodyne(np.arange(6.0), np.array([0.005]), np.array([0.0]), 1.0, True)
    p = np.array([0.3, 1.0, *(dict(VALUES, D0_ref=10.0, D_offset_ref=-1e5)[n] for n in TWO_COMPONENT)])
    i, j = np.array([0, 1, 2]), np.array([3, 4, 5])
    value, jac = model.evaluate(p, np.zeros(3, int), i, j)
    assert np.isfinite(value).all() and np.isfinite(jac).all() and not jac[:, 2:5].any()
