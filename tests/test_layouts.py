from dataclasses import replace

import numpy as np
import pytest

from duochron import fits
from duochron.plans.layouts import Log, ScalingMap, Shift, Stack, gradient_ratio, hierarchical, recover, shear_weighted, variation_penalty
from duochron.plans.models import Homodyne
from duochron.plans.solve import FitResult, levenberg_marquardt
from duochron.sources.events import angle_table

PHI = np.array([-170.0, -90.0, 5.0, 85.0, 175.0])


@pytest.mark.parametrize("layout,size", [("individual", 5), ("averaged", 1), ("fourier", 5)])
def test_scaling_maps(layout, size):
    m = ScalingMap(layout, PHI)
    assert m.basis.shape == (5, size)
    p = np.concatenate([np.full(5, 0.3), np.full(5, 1.1), [7.0]])
    np.testing.assert_allclose(m.forward(m.inverse(p)), p, atol=1e-12)


def test_mapped_and_log_jacobians():
    base = Homodyne(np.arange(8.0), np.full(5, 0.006), PHI, 1.0, length=2e3, flow=True)
    rng = np.random.default_rng(0)
    a, i, j = rng.integers(0, 5, 40), rng.integers(0, 8, 40), rng.integers(0, 8, 40)
    mapped, log = Stack(base, [ScalingMap("fourier", PHI)]), Stack(base, [Log([10, 13])])
    both = Stack(base, [Shift(14, 0.3), Log([13]), ScalingMap("fourier", PHI)])
    full = np.concatenate([np.full(5, 0.3), np.full(5, 1.0), [2000.0, 0.4, 12.0, 0.02, 0.3, 0.002, 4.0]])
    for model, p in ((mapped, mapped.to_fit(full)), (log, log.to_fit(full)), (both, both.to_fit(full))):
        _, jac = model.evaluate(p, a, i, j)
        for k in range(len(p)):
            h = 1e-6 * max(abs(p[k]), 1e-3)
            d = np.zeros(len(p))
            d[k] = h
            np.testing.assert_allclose(jac[:, k], (model.evaluate(p + d, a, i, j, False)[0] - model.evaluate(p - d, a, i, j, False)[0]) / (2 * h), rtol=2e-3, atol=1e-6)
    np.testing.assert_allclose(log.to_model(log.to_fit(full)), full)
    np.testing.assert_allclose(both.to_model(both.to_fit(full)), full)


def test_penalty_gradient():
    x = np.array([0.2, 0.3, 0.5])
    g, h, r2 = variation_penalty(x, 2.0)
    f = lambda v: 2.0 * (v.std() / abs(v.mean())) ** 2
    assert np.isclose(r2, f(x))
    for k in range(3):
        d = np.zeros(3)
        d[k] = 1e-6
        assert np.isclose(-2 * h[k], (f(x + d) - f(x - d)) / 2e-6, rtol=1e-4)
    np.testing.assert_allclose(g, g.T)


def test_alternating_fit_lowers_chi_squared_and_recovery_keeps_the_better(spark):
    cells = fits.synthetic_cells(spark, 24).cache()
    model = fits._model(spark, 24)
    start = np.array([0.4, 1.05, 2500.0, 0.45, 15.0])
    first = levenberg_marquardt(cells, model, start, fits.LOWER, fits.UPPER, 1)
    alternating = hierarchical(cells, model, start, fits.LOWER, fits.UPPER, 1, rounds=2)
    assert alternating.chi_squared < first.history[0]
    broken = FitResult(start, start * 0, np.eye(5), first.history[0], first.n, 1, False)
    # A fit that converges, but worse, doesn't make the failed one a success.
    low = replace(broken, chi_squared=-1.0)
    assert recover(cells, model, low, fits.LOWER, fits.UPPER, tries=1, max_iterations=3) is low and not low.converged
    assert recover(cells, model, broken, fits.LOWER, fits.UPPER, tries=1).chi_squared <= broken.chi_squared
    assert gradient_ratio(cells, model, start, 1) >= 0
    w = shear_weighted(cells, angle_table(spark), 5.0).groupBy("angle_idx").agg({"sigma": "min"}).collect()
    assert len({round(r[1], 9) for r in w}) > 1


def _flow_cells(spark, noise=0.0, outliers=0):
    from duochron.plans.models import Homodyne

    phi, q = np.array([-60.0, -20.0, 5.0, 30.0, 70.0]), np.full(5, 0.006)
    m = Homodyne(np.arange(14.0), q, phi, 1.0, 2e3)
    a, i, j = (x.ravel() for x in np.meshgrid(range(5), range(14), range(14), indexing="ij"))
    off = i != j
    a, i, j = a[off], i[off], j[off]
    contrast, offset = 0.3 + 0.05 * np.cos(np.radians(phi)), 1 + 0.02 * np.sin(np.radians(phi))
    y = m.evaluate(np.concatenate([contrast, offset, [3000.0, 0.4, 20.0]]), a, i, j, False)[0]
    rng = np.random.default_rng(0)
    y = y + noise * rng.standard_normal(len(y))
    y[rng.choice(len(y), outliers, replace=False)] += 3.0
    cells = spark.createDataFrame([(int(x), int(k), int(l), float(v)) for x, k, l, v in zip(a, i, j, y)], "angle_idx int, i int, j int, c2 double")
    angle = spark.createDataFrame([(k, "", float(q[k]), float(phi[k])) for k in range(5)], "angle_idx int, name string, q double, phi double")
    frame = spark.createDataFrame([(k, float(k)) for k in range(14)], "i int, t double")
    return cells, angle, frame, contrast, offset


def test_public_fit_by_fourier_scaling(spark):
    from duochron import api
    from duochron.schema import Dataset

    cells, angle, frame, contrast, offset = _flow_cells(spark)
    result, names = api.fit(spark, Dataset(cells, angle, frame, 1.0, 2e3), {"optimization": {"per_angle_mode": "fourier", "max_iterations": 40}})
    got = dict(zip(names, result.parameters))
    assert result.status == "converged" and len(names) == 13 and result.covariance.shape == (13, 13)
    np.testing.assert_allclose([got[f"contrast_{k}"] for k in range(5)], contrast, rtol=2e-2)
    assert abs(got["D0"] / 3000 - 1) < 0.05 and abs(got["alpha"] - 0.4) < 0.05


def test_soft_loss_withstands_outliers(spark):
    from duochron.plans.models import Homodyne
    from duochron.plans.solve import levenberg_marquardt

    cells, angle, frame, *_ = _flow_cells(spark, noise=0.002, outliers=12)
    m = Homodyne(np.arange(14.0), np.full(5, 0.006), np.array([-60.0, -20.0, 5.0, 30.0, 70.0]), 1.0, 2e3)
    low, high = np.concatenate([np.zeros(5), np.full(5, 0.5), [100, -2, -1e5]]), np.concatenate([np.ones(5), np.full(5, 1.5), [1e5, 2, 1e5]])
    start = np.concatenate([np.full(5, 0.4), np.ones(5), [2500.0, 0.3, 10.0]])
    cells = cells.selectExpr("*", "0.002D AS sigma")
    off = {loss: levenberg_marquardt(cells, m, start, low, high, 40, loss=loss).parameters[10] / 3000 - 1 for loss in ("linear", "soft_l1")}
    assert abs(off["soft_l1"]) < 0.05 and abs(off["soft_l1"]) < abs(off["linear"])


def test_refused_steps_are_no_convergence(spark):
    from duochron.plans.solve import levenberg_marquardt

    class Broken:
        names = ("x",)

        def evaluate(self, p, a, i, j, jacobian=True):
            value = np.full(len(a), 0.0 if p[0] == 1.0 else np.nan)
            return value, (np.ones((len(a), 1)) if jacobian else None)

    cells = spark.createDataFrame([(0, 0, 1, 5.0, 1.0), (0, 1, 0, 5.0, 1.0)], "angle_idx int, i int, j int, c2 double, sigma double")
    r = levenberg_marquardt(cells, Broken(), np.array([1.0]), np.array([-9.0]), np.array([9.0]))
    assert r.status == "no_step" and not r.converged


def test_reduced_model_factors_and_checks(spark):
    from duochron.plans.checks import Reduced, factors, fit_issues, gradient_and_hessian
    from duochron.plans.models import Heterodyne, Homodyne
    from duochron.plans.parameters import REGISTRY, TWO_COMPONENT
    from duochron.plans.solve import FitResult, chi_squared_of

    m = Heterodyne(np.arange(8.0) + 1, np.array([0.006]), np.array([20.0]), 1.0, shared_scaling=True)
    small = Reduced(m, ("v0", "f0"), {"f3": 0.2})
    full = small.expand(np.array([0.3, 1.0, 500.0, 0.4]))
    named = dict(zip(TWO_COMPONENT, full[2:]))
    assert named["v0"] == 500 and named["f0"] == 0.4 and named["f3"] == 0.2 and named["D0_ref"] == REGISTRY["D0_ref"].default
    a, i, j = np.zeros(5, int), np.array([1, 2, 3, 4, 5]), np.array([2, 4, 1, 6, 7])
    value, jac = small.evaluate(np.array([0.3, 1.0, 500.0, 0.4]), a, i, j)
    whole = m.evaluate(full, a, i, j)
    np.testing.assert_array_equal(value, whole[0])
    np.testing.assert_array_equal(jac, whole[1][:, [0, 1, 2 + TWO_COMPONENT.index("v0"), 2 + TWO_COMPONENT.index("f0")]])
    with pytest.raises(ValueError):
        Reduced(m, ("speed",))
    f = factors(0.006, 2e6, 0.5)
    assert f.diffusion == 0.5 * 0.006**2 * 0.5 and abs(f.shear - 0.006 * 2e6 * 0.5 / (2 * np.pi)) < 1e-9
    with pytest.raises(ValueError):
        factors(0.0, 2e6, 0.5)
    low, high = np.zeros(2), np.ones(2)
    sound = FitResult(np.array([0.5, 0.4]), np.ones(2), np.eye(2), 1.0, 50, 3, True, [], "converged")
    assert fit_issues(sound, low, high) == []
    wrong = FitResult(np.array([1.0, np.nan]), np.ones(2), -np.eye(2), np.inf, 1, 3, False, [], "no_step")
    assert {s for s, _ in fit_issues(wrong, low, high)} == {"error", "warning"} and len(fit_issues(wrong, low, high)) >= 4
    h = Homodyne(np.arange(6.0), np.array([0.006]), np.array([20.0]), 1.0, shared_scaling=True)
    p = np.array([0.3, 1.0, 2000.0, 0.4, 10.0])
    c = Stack(h, [Shift(3, 0.3)])
    np.testing.assert_allclose(c.evaluate(c.to_fit(p), a, i % 6, j % 6)[0], h.evaluate(p, a, i % 6, j % 6)[0], rtol=1e-14)
    lo, hi = Log([2]).bounds(np.array([0, 0.5, 100, -2, -1e5]), np.array([1, 1.5, 1e5, 2, 1e5]))
    assert abs(lo[2] - np.log(100)) < 1e-12 and abs(hi[2] - np.log(1e5)) < 1e-12
    cells = spark.createDataFrame([(0, int(x), int(y), 1.2, 0.1) for x in range(6) for y in range(6) if x != y], "angle_idx int, i int, j int, c2 double, sigma double")
    g, _ = gradient_and_hessian(cells, h, p)
    step = np.array([0, 1e-5, 0, 0, 0])
    up, down = chi_squared_of(cells, h, np.stack([p + step, p - step]))
    assert abs(g[1] / ((up - down) / 2e-5) - 1) < 1e-5


@pytest.mark.parametrize("method", ["trust_region", "hybrid"])
def test_public_fit_by_other_methods_and_transforms(spark, method):
    from duochron import api
    from duochron.schema import Dataset

    cells, angle, frame, contrast, offset = _flow_cells(spark, noise=0.001)
    d = Dataset(cells, angle, frame, 1.0, 2e3)
    base = {"analysis_mode": "laminar_flow", "initial_parameters": {"gamma_dot_t0": 0.02, "beta": 0.2}, "optimization": {"per_angle_mode": "individual", "max_iterations": 12, "recover": False}}
    plain, names = api.fit(spark, d, base)
    again, _ = api.fit(spark, d, {**base, "optimization": {**base["optimization"], "method": method, "transforms": {"log_shear": True, "centred_shear": True}}})
    assert again.parameters.shape == plain.parameters.shape == (17,) and again.chi_squared <= plain.chi_squared * 1.05
    np.testing.assert_allclose(again.parameters[:10], plain.parameters[:10], rtol=0.05)


def test_covariance_comes_back_through_the_transforms(spark):
    cells = fits.synthetic_cells(spark, 20).cache()
    model = fits._model(spark, 20)
    start = np.array([0.4, 1.0, 2500.0, 0.45, 15.0])
    low, high = fits.LOWER.copy(), fits.UPPER.copy()
    low[4] = high[4] = 20.0
    start[4] = 20.0
    plain = levenberg_marquardt(cells, model, start, low, high, 60)
    stack = Stack(model, [Shift(3, 0.5), Log([2])])
    seen = stack.back(levenberg_marquardt(cells, stack, stack.to_fit(start), *stack.bounds(low, high), 60))
    np.testing.assert_allclose(seen.parameters, plain.parameters, rtol=1e-6)
    at = plain.parameters  # both covariances at one point, scaled alike
    for p, c in ((plain, plain.covariance / plain.reduced_chi_squared), (seen, seen.covariance / seen.reduced_chi_squared)):
        np.testing.assert_allclose(np.diag(c)[:4], np.diag(plain.covariance / plain.reduced_chi_squared)[:4], rtol=1e-5)
    assert at[4] == 20.0


def test_the_monitor_fires_on_a_degenerate_fit_and_the_layout_changes(spark):
    from duochron import api
    from duochron.plans.monitor import Collapsed, GradientMonitor
    from duochron.plans.stratified import _places, angle_sums
    from duochron.schema import Dataset

    # Cells that only differ between angles: scaling explains them, physics doesn't matter.
    rows = [(a, i, j, 1.0 + 0.1 * a) for a in range(3) for i in range(8) for j in range(8) if i != j]
    cells = spark.createDataFrame(rows, "angle_idx int, i int, j int, c2 double")
    watch = GradientMonitor(3, patience=2)
    sums = np.zeros((3, _places(3)["gradient_square"].stop))
    sums[:, _places(3)["scaling_gradient"]] = 5.0
    sums[:, _places(3)["cost"]] = 1.0
    watch(sums, np.ones(9))
    with pytest.raises(Collapsed):
        watch(sums, np.ones(9))
    angle = spark.createDataFrame([(k, "", 1e-4, 10.0 * k) for k in range(3)], "angle_idx int, name string, q double, phi double")
    frame = spark.createDataFrame([(k, float(k)) for k in range(8)], "i int, t double")
    options = {"per_angle_mode": "individual", "method": "trust_region", "max_iterations": 20, "recover": False, "anti_degeneracy": {"monitor": True}}
    result, names = api.fit(spark, Dataset(cells, angle, frame), {"optimization": options})
    assert names[:2] == ["contrast_0", "offset_0"] and len(result.parameters) == 5
    own = Homodyne(np.arange(8.0), np.full(3, 1e-4), np.zeros(3), 1.0, shared_scaling=True)
    sums = angle_sums(cells.selectExpr("*", "1D AS sigma"), own, np.full(3, 0.3), np.ones(3), np.array([1000.0, 0.5, 10.0]))
    assert sums.shape[0] == 3
