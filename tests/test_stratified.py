"""The arrow of per-angle blocks, its trust region, and angles in lockstep, against dense and single fits."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from duochron.operators.aggregates import combine_estimates
from duochron.plans import stratified as St
from duochron.plans.models import Heterodyne, Homodyne
from duochron.plans.solve import accumulate, levenberg_marquardt

N = 14
Q, PHI = np.array([0.004, 0.006, 0.008]), np.array([5.0, 60.0, 120.0])
TRUE = np.array([0.2, 0.3, 0.4, 1.0, 1.02, 1.05, 3000.0, 0.4, 20.0])
LOW = np.array([0.0] * 3 + [0.5] * 3 + [100.0, -2.0, -1e5])
HIGH = np.array([1.0] * 3 + [1.5] * 3 + [1e5, 2.0, 1e5])


def homodyne(shared):
    return Homodyne(np.arange(N, dtype=float), Q, PHI, 1.0, shared_scaling=shared)


@pytest.fixture(scope="module")
def cells(spark):
    a, i, j = (x.ravel() for x in np.meshgrid(np.arange(3), np.arange(N), np.arange(N), indexing="ij"))
    off = i != j
    a, i, j = a[off], i[off], j[off]
    y = homodyne(False).evaluate(TRUE, a, i, j, False)[0] + np.random.default_rng(1).normal(0, 0.002, len(a))
    rows = [(int(x), int(k), int(m), float(c), 0.002) for x, k, m, c in zip(a, i, j, y)]
    return spark.createDataFrame(rows, "angle_idx int, i int, j int, c2 double, sigma double").repartition(3).cache()


def test_arrow_equals_the_dense_normal_matrix(cells):
    p = TRUE * 1.03
    jtj, jtr, cost, n = accumulate(cells, homodyne(False), p)
    sums = St.angle_sums(cells, homodyne(True), p[:3], p[3:6], p[6:])
    arrow, at = St.Arrow.of(sums, 3), St._places(3)
    np.testing.assert_allclose(arrow.physics, jtj[6:, 6:], rtol=1e-10)
    for a in range(3):
        np.testing.assert_allclose(arrow.blocks[a], jtj[np.ix_([a, 3 + a], [a, 3 + a])], rtol=1e-10)
        np.testing.assert_allclose(arrow.coupling[a], jtj[[a, 3 + a], 6:], rtol=1e-9)
    np.testing.assert_allclose(sums[:, at["cost"]].sum(), cost, rtol=1e-12)
    assert sums[:, at["n"]].sum() == n
    s, v = arrow.solve(np.stack([jtr[:3], jtr[3:6]], axis=1), jtr[6:])
    np.testing.assert_allclose(np.concatenate([s.T.ravel(), v]), np.linalg.solve(jtj, jtr), rtol=1e-5)
    scaling, physics, _ = arrow.inverse_diagonal()
    np.testing.assert_allclose(np.concatenate([scaling.T.ravel(), physics]), np.diag(np.linalg.inv(jtj)), rtol=1e-5)


@pytest.mark.parametrize("loss", ["linear", "soft_l1"])
def test_trust_region_reaches_the_optimum_of_levenberg_marquardt(cells, loss):
    start = np.array([0.5] * 3 + [1.0] * 3 + [1000.0, 0.5, 10.0])
    one = levenberg_marquardt(cells, homodyne(False), start, LOW, HIGH, 200, tolerance=1e-10, loss=loss)
    other = St.trust_region(cells, homodyne(True), start, LOW, HIGH, loss=loss)
    assert other.converged and other.chi_squared <= one.chi_squared * (1 + 1e-6)
    np.testing.assert_allclose(other.parameters[:8], one.parameters[:8], rtol=2e-3)
    np.testing.assert_allclose(other.uncertainties, one.uncertainties, rtol=0.05)
    assert (abs(other.parameters - TRUE) < 6 * other.uncertainties + 1e-9).all()


def test_an_optimum_on_a_bound_and_held_parameters(cells):
    high, low = HIGH.copy(), LOW.copy()
    high[6] = 2500.0  # below the true value
    low[8] = high[8] = 20.0
    start = np.array([0.5] * 3 + [1.0] * 3 + [1000.0, 0.5, 20.0])
    one = levenberg_marquardt(cells, homodyne(False), start, low, high, 200, tolerance=1e-10)
    other = St.trust_region(cells, homodyne(True), start, low, high)
    assert other.chi_squared <= one.chi_squared * (1 + 1e-4)
    assert other.parameters[6] <= 2500 and other.parameters[6] > 2495 and other.parameters[8] == 20.0 and other.uncertainties[8] == 0


def test_many_angles_of_two_components(spark):
    """23 angles and 14 physics parameters: a vector of 60, of which no task sums a square."""
    t, q, phi = np.arange(8) + 1.0, np.full(23, 0.005), np.linspace(0, 150, 23)
    whole, shared = Heterodyne(t, q, phi, 1.0), Heterodyne(t, q, phi, 1.0, True)
    physics = np.array([8000.0, 0.2, 100.0, 12000.0, -0.1, 50.0, 90.0, 0.7, 3.0, 0.4, 0.0, 0.0, 0.1, 0.0])
    true = np.concatenate([np.linspace(0.2, 0.4, 23), np.linspace(0.95, 1.05, 23), physics])
    a, i, j = (x.ravel() for x in np.meshgrid(np.arange(23), np.arange(8), np.arange(8), indexing="ij"))
    off = (i != j) & (i > 0) & (j > 0)
    a, i, j = a[off], i[off], j[off]
    y = whole.evaluate(true, a, i, j, False)[0]
    cells = spark.createDataFrame([(int(x), int(k), int(m), float(c), 0.01) for x, k, m, c in zip(a, i, j, y)], "angle_idx int, i int, j int, c2 double, sigma double").repartition(4)
    low, high = np.concatenate([np.zeros(23), np.full(23, 0.5), physics]), np.concatenate([np.ones(23), np.full(23, 1.5), physics])
    for k, (lo, hi) in {0: (0, 1e6), 3: (0, 1e6), 6: (0, 1e6), 9: (0, 1)}.items():
        low[46 + k], high[46 + k] = lo, hi
    start = np.where(low < high, true * 1.1, true)
    fit = St.trust_region(cells, shared, np.minimum(start, high), low, high)
    assert fit.converged and fit.chi_squared < 1e-6
    np.testing.assert_allclose(fit.parameters, true, rtol=1e-3)


def test_lockstep_equals_single_fits(spark, cells):
    low, high, start = LOW[[0, 3, 6, 7, 8]], HIGH[[0, 3, 6, 7, 8]], np.array([0.5, 1.0, 1000.0, 0.5, 10.0])
    more = cells.union(cells.limit(3).withColumn("angle_idx", F.lit(3)))  # an angle of three cells
    model = Homodyne(np.arange(N, dtype=float), np.append(Q, 0.005), np.append(PHI, 0.0), 1.0, shared_scaling=True)
    fits = St.lockstep(more, model, start, low, high, 4)
    assert fits[3] is None
    for a in range(3):
        single = levenberg_marquardt(cells.where(F.col("angle_idx") == a), model, start, low, high, 200, tolerance=1e-10)
        assert fits[a].converged and fits[a].chi_squared == pytest.approx(single.chi_squared, rel=1e-7) and fits[a].n == single.n
        np.testing.assert_allclose(fits[a].parameters[:2], single.parameters[:2], rtol=1e-3)
    combined, again = St.sequential(more, model, start, low, high, 4)
    table = St.estimates_table(spark, again, ["contrast", "offset", *model.names])
    want = {r.param: r.value for r in combine_estimates(table).collect()}
    assert {r.param: r.value for r in combined.collect()} == {k: want[k] for k in model.names}
    with pytest.raises(ValueError, match="converged"):
        St.sequential(more, model, start, low, high, 4, least_share=0.9)
