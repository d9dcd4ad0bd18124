import math

import numpy as np
import pytest

from duochron.functions import kernels as K
from duochron.plans.models import Heterodyne, Homodyne
from duochron.plans.parameters import REGISTRY, clip_to_bounds, mode_from_count, mode_of, scaling_layout, split
from duochron.plans.solve import FitResult, accumulate, basins, centre_distance, chi_squared_of, jacobian_statistics, keep_better, latin_hypercube
from duochron.sources.events import angle_table, frame_table

TWO = dict(D0_ref=5000.0, alpha_ref=0.5, D_offset_ref=100.0, D0_sample=5000.0, alpha_sample=0.5, D_offset_sample=100.0, v0=50.0, v_beta=0.5, v_offset=5.0, f0=0.5, f1=0.01, f2=1.0, f3=0.5, phi0_het=2.0)
# The first residuals of the published case (8 frames, two angles, data uniform(1, 1.5) of seed 1234).
RESIDUALS = [0.7692913261922738, 0.6721462447323274, 0.5306634565535187, 0.5144649490627777, 0.5915187503607111, 0.5805952246342216, 0.878417558153336, 0.5519492449612635, 0.9423298327911569, 0.6142586887690034]


def _case():
    t = np.linspace(0, 0.07, 8)
    data = np.random.default_rng(1234).uniform(1.0, 1.5, size=(2, 8, 8))
    a, i, j = (x.ravel() for x in np.meshgrid([0, 1], range(8), range(8), indexing="ij"))
    keep = (i > 0) & (j > 0) & (i != j)
    return t, data, a[keep], i[keep], j[keep]


def test_two_component_residuals_equal_the_published_ones():
    t, data, a, i, j = _case()
    m = Heterodyne(t, np.full(2, 0.0054), np.array([10.0, 90.0]), 0.5)
    p = np.array([1, 1, 1, 1, *TWO.values()], float)
    r = m.evaluate(p, a, i, j, False)[0] - data[a, i, j]
    assert len(r) == 84
    np.testing.assert_allclose(r[:10], RESIDUALS, rtol=1e-10, atol=1e-12)


def test_spark_surface_equals_numpy(spark):
    t, data, a, i, j = _case()
    frames = spark.createDataFrame([(k, float(v)) for k, v in enumerate(t)], "i int, t double")
    angles = spark.createDataFrame([(0, "x", 0.0054, 10.0), (1, "y", 0.0054, 90.0)], "angle_idx int, name string, q double, phi double")
    got = {(r[0], r[1], r[2]): r[3] for r in K.heterodyne_surface(frames, angles, TWO, 0.5).collect()}
    m = Heterodyne(t, np.full(2, 0.0054), np.array([10.0, 90.0]), 0.5)
    want = m.evaluate(np.array([1, 1, 0, 0, *TWO.values()], float), a, i, j, False)[0]
    np.testing.assert_allclose([got[k] for k in zip(a.tolist(), i.tolist(), j.tolist())], want, rtol=1e-12)


@pytest.mark.parametrize("flow", [False, True])
def test_homodyne_jacobian_is_the_central_difference(flow):
    rng = np.random.default_rng(3)
    m = Homodyne(np.arange(12.0), np.array([0.005, 0.007]), np.array([3.0, 80.0]), 1.0, length=2e3, flow=flow)
    p = np.array([0.3, 0.4, 1.0, 1.1, 2000.0, 0.4, 12.0] + ([0.02, 0.3, 0.002, 4.0] if flow else []))
    a, i, j = rng.integers(0, 2, 60), rng.integers(0, 12, 60), rng.integers(0, 12, 60)
    _, jac = m.evaluate(p, a, i, j)
    for k in range(len(p)):
        h = 1e-6 * max(abs(p[k]), 1e-3)
        up, down = p.copy(), p.copy()
        up[k] += h
        down[k] -= h
        d = (m.evaluate(up, a, i, j, False)[0] - m.evaluate(down, a, i, j, False)[0]) / (2 * h)
        np.testing.assert_allclose(jac[:, k], d, rtol=2e-4, atol=1e-9)


def test_homodyne_numpy_equals_spark(spark):
    p = {"D0": 1000.0, "alpha": 0.5, "D_offset": 10.0, "gamma_dot_t0": 0.01, "beta": 0.3, "gamma_dot_t_offset": 0.001, "phi0": 5.0}
    rows = K.homodyne_surface(frame_table(spark, 10), angle_table(spark), p, 1.0).collect()
    angles = sorted(angle_table(spark).collect())
    m = Homodyne(np.arange(10.0), np.array([x["q"] for x in angles]), np.array([x["phi"] for x in angles]), 1.0, flow=True, shared_scaling=True)
    a, i, j = (np.array([r[k] for r in rows]) for k in ("angle_idx", "i", "j"))
    got = m.evaluate(np.array([1.0, 0.0, *p.values()]), a, i, j, False)[0]
    np.testing.assert_allclose(got, [r["g1"] ** 2 for r in rows], rtol=1e-9, atol=1e-300)


def test_accumulated_sums_do_not_depend_on_partitions(spark):
    m = Homodyne(np.arange(6.0), np.array([0.005]), np.array([0.0]), 1.0)
    rows = [(0, i, j, 1 + 0.01 * i * j, 0.1) for i in range(6) for j in range(6)]
    p = np.array([0.3, 1.0, 1000.0, 0.5, 10.0])
    one, many = (accumulate(spark.createDataFrame(rows, "angle_idx int, i int, j int, c2 double, sigma double").repartition(n), m, p) for n in (1, 5))
    np.testing.assert_allclose(one[0], many[0], rtol=1e-10)
    np.testing.assert_allclose(one[0], one[0].T)
    assert one[3] == many[3] == 36 and math.isclose(one[2], many[2], rel_tol=1e-12)
    assert math.isclose(chi_squared_of(spark.createDataFrame(rows, "angle_idx int, i int, j int, c2 double, sigma double"), m, np.stack([p, p * 1.1]))[0], one[2], rel_tol=1e-12)
    assert jacobian_statistics(one[0])["column_norms"].shape == (5,)


def test_fits_of_noiseless_cells_recover_the_parameters(spark):
    from duochron import fits
    from duochron.plans.solve import levenberg_marquardt
    from duochron.plans.stratified import lockstep

    cells, model = fits.synthetic_cells(spark, 30).cache(), fits._model(spark, 30)
    whole = levenberg_marquardt(cells, model, fits.START, fits.LOWER, fits.UPPER)
    np.testing.assert_allclose(whole.parameters, fits._TRUTH, rtol=0.02)
    for fit in lockstep(cells, model, fits.START, fits.LOWER, fits.UPPER, 5):
        assert fit.converged
        np.testing.assert_allclose(fit.parameters[:4], fits._TRUTH[:4], rtol=0.02)


def test_starts_and_guards():
    low, high = np.zeros(3), np.array([1.0, 2.0, 3.0])
    s = latin_hypercube(10, low, high)
    for k in range(3):
        assert sorted((s[:, k] / high[k] * 10).astype(int)) == list(range(10))
    assert (latin_hypercube(10, low, high) == s).all()
    assert centre_distance(np.array([[0.5, 1.0, 1.5], [0.0, 1.0, 1.5]]), low, high).tolist() == [0.0, 1e20]
    a, b, c = (FitResult(np.array(p), np.zeros(2), np.eye(2), x, 10, 1, True) for p, x in (([1.0, 1.0], 1.0), ([1.01, 1.0], 1.05), ([5.0, 1.0], 1.02)))
    assert basins([a, b, c]) == [[0, 1], [2]]
    assert keep_better(a, b) is a and keep_better(b, a) is a
    assert mode_of("heterodyne") == "two_component" and mode_of("Laminar Flow") == "laminar_flow"
    with pytest.raises(ValueError):
        mode_of("static")
    assert mode_from_count(5, 3) == ("static_anisotropic", False) and mode_from_count(13, 3) == ("laminar_flow", True)
    assert split(np.array([0.3, 1.0, 1.0, 2.0, 3.0]), 3)[0].tolist() == [0.3] * 3
    assert scaling_layout("auto", 3) == "averaged" and scaling_layout("auto", 2) == "individual"
    assert all(p.lower <= p.default <= p.upper for p in REGISTRY.values()) and len(REGISTRY) == 23
    assert clip_to_bounds({"alpha": 9.0}) == {"alpha": 2.0}
