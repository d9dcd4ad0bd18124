"""Descent from hard starts, and evolution with restarts."""

import numpy as np
import pytest

from duochron.plans import evolution as E
from duochron.plans.hybrid import descend, gradient_of, hybrid, two_loop
from duochron.plans.models import Homodyne
from duochron.plans.solve import accumulate, levenberg_marquardt

N = 12
TRUE = np.array([0.3, 1.0, 3000.0, 0.4, 20.0])
LOW, HIGH = np.array([0.0, 0.5, 100.0, -2.0, -1e5]), np.array([1.0, 1.5, 1e5, 2.0, 1e5])
MODEL = Homodyne(np.arange(N, dtype=float), np.array([0.004, 0.007]), np.array([0.0, 90.0]), 1.0, shared_scaling=True)


def made(spark, model, p, n_angles=2, noise=0.001):
    a, i, j = (x.ravel() for x in np.meshgrid(np.arange(n_angles), np.arange(N), np.arange(N), indexing="ij"))
    off = i != j
    a, i, j = a[off], i[off], j[off]
    y = model.evaluate(p, a, i, j, False)[0] + np.random.default_rng(2).normal(0, noise, len(a))
    return spark.createDataFrame([(int(x), int(k), int(m), float(c), 0.01) for x, k, m, c in zip(a, i, j, y)], "angle_idx int, i int, j int, c2 double, sigma double").repartition(2)


@pytest.fixture(scope="module")
def cells(spark):
    return made(spark, MODEL, TRUE).cache()


def test_gradient_is_that_of_the_normal_equations(cells):
    p = TRUE * 1.1
    _, jtr, cost, n = accumulate(cells, MODEL, p)
    g, c, m = gradient_of(cells, MODEL, p)
    np.testing.assert_allclose(g, -2 * jtr, rtol=1e-9)
    assert c == pytest.approx(cost) and m == n


def test_two_loop_solves_a_quadratic():
    rng = np.random.default_rng(0)
    root = rng.normal(size=(4, 4))
    h = root @ root.T + np.eye(4)
    x, g = rng.normal(size=4), None
    steps, changes = [], []
    for _ in range(60):
        g = h @ x
        d = two_loop(g, steps, changes)
        s = d * (-(g @ d) / (d @ h @ d))
        steps, changes, x = [*steps, s][-4:], [*changes, h @ s][-4:], x + s
        if np.linalg.norm(h @ x) < 1e-12:
            break
    assert np.linalg.norm(h @ x) < 1e-8


class Plateau:
    """A model whose Gauss-Newton step is refused far out: an arctangent of a steep slope beside a flat direction."""

    names = ("u",)
    size = 2

    def evaluate(self, p, a, i, j, jacobian=True):
        x = (i + 1.0) / N
        z = 40 * (p[0] - 0.3) * x
        value = np.arctan(z) + (p[1] - 0.6) * (1 - x)
        return value, np.stack([40 * x / (1 + z * z), 1 - x], axis=1) if jacobian else None


def test_hybrid_converges_from_a_start_on_a_plateau(spark):
    model, low, high = Plateau(), np.zeros(2), np.ones(2)
    rows = made(spark, model, np.array([0.3, 0.6]), 1, 0.0)
    start = np.array([0.98, 0.05])
    plain = levenberg_marquardt(rows, model, start, low, high, 1)  # its first steps leave the box
    fit = hybrid(rows, model, start, low, high)
    assert fit.converged and fit.chi_squared < 1e-12 < plain.chi_squared
    np.testing.assert_allclose(fit.parameters, [0.3, 0.6], atol=1e-5)
    assert fit.history == sorted(fit.history, reverse=True)


def test_a_descent_leads_gauss_newton_to_the_optimum(cells):
    start = np.array([0.9, 0.6, 20000.0, -0.5, 5000.0])
    p, cost, history, status = descend(cells, MODEL, start, LOW, HIGH, 15)
    assert cost < history[0] and status in ("converged", "max_iterations")
    fit = levenberg_marquardt(cells, MODEL, p, LOW, HIGH, 200)
    assert fit.converged
    np.testing.assert_allclose(fit.parameters[:2], TRUE[:2], rtol=0.02)


def two_basins(vectors):
    """A wide basin at 0.8, and the least one, narrow, at 0.2."""
    u, v = vectors.T
    wide = (u - 0.8) ** 2 + 0.3
    return np.minimum(wide, wide * (1 - 1.2 * np.exp(-(((u - 0.2) / 0.06) ** 2)))) + (v - 0.5) ** 2


def test_restarts_find_the_least_basin():
    low, high, start = np.zeros(2), np.ones(2), np.array([0.85, 0.5])
    once = E.restarted(two_basins, start, low, high, restarts=0, sigma=0.05)
    found = E.restarted(two_basins, start, low, high, budget=3000, sigma=0.05)
    again = E.restarted(two_basins, start, low, high, budget=3000, sigma=0.05)
    assert abs(once.parameters[0] - 0.8) < 0.01 and abs(found.parameters[0] - 0.2) < 0.05 and found.chi_squared < 0 < once.chi_squared
    assert {k for k, *_ in found.runs} == {"first", "large", "small"} and found.evaluations <= 3000 and found.runs == again.runs


def test_trigger_population_and_covariance(spark, cells):
    assert E.worth_it(LOW, HIGH) and not E.worth_it(np.zeros(2), np.array([1.0, 900.0]))
    assert E.scale_ratio(np.array([0.0, 3.0, 1.0]), np.array([1.0, 3.0, 5.0])) == 4.0
    assert E.population_of(5, 10) == 8 and E.population_of(5, 1e4) == 16 and E.population_of(5, 1e7) == 32
    held = LOW.copy(), HIGH.copy()
    held[0][3] = held[1][3] = 0.4
    fit = E.bipop(cells, MODEL, TRUE * 1.2, *held, budget=64, restarts=0, population=8)
    assert fit.parameters[3] == 0.4 and not fit.covariance[3].any() and (np.diag(fit.covariance)[[0, 1, 2, 4]] > 0).all()
    np.testing.assert_allclose(fit.covariance, fit.covariance.T)
