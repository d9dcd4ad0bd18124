import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from duochron.operators import aggregates as A
from duochron.operators import filters as Fl
from duochron.operators import matrix as M
from duochron.operators import scaling as Sc
from duochron.operators import windows as W
from duochron.plans.parameters import mode_of


@pytest.fixture(scope="module")
def cells(spark):
    x = np.random.default_rng(42).uniform(0.5, 1.5, (2, 16, 16))
    x = (x + x.transpose(0, 2, 1)) / 2
    x[:, range(16), range(16)] = 5.0
    rows = [(a, i, j, float(x[a, i, j])) for a in range(2) for i in range(16) for j in range(16)]
    return spark.createDataFrame(rows, "angle_idx int, i int, j int, c2 double").cache(), x


def matrix(df, n=16, angles=2):
    out = np.full((angles, n, n), np.nan)
    for r in df.collect():
        out[r["angle_idx"], r["i"], r["j"]] = r["c2"]
    return out


@pytest.mark.parametrize("method", ["basic", "statistical", "interpolation"])
def test_diagonal_is_replaced_and_the_rest_stays(cells, method):
    df, x = cells
    y = matrix(M.correct_diagonal(df, method))
    off = ~np.eye(16, dtype=bool)
    assert (y[:, off] == x[:, off]).all() and np.abs(y[:, range(16), range(16)]).max() < 2.5


def test_basic_diagonal_by_hand(cells):
    df, x = cells
    y = matrix(M.diagonal_basic(df))
    s = (x[0, range(15), range(1, 16)] + x[0, range(1, 16), range(15)]) / 2
    np.testing.assert_allclose(np.diag(y[0]), np.concatenate([[s[0]], (s[1:] + s[:-1]) / 2, [s[-1]]]))


def test_median_and_gaussian_reflect(cells):
    df, x = cells
    pad = np.pad(x[1], 1, mode="symmetric")
    want = np.array([[np.median(pad[i : i + 3, j : j + 3]) for j in range(16)] for i in range(16)])
    np.testing.assert_allclose(matrix(M.median_filter(df))[1], want)
    w = np.exp(-0.5 * np.arange(-4, 5) ** 2.0)
    w /= w.sum()
    pad = np.pad(x[1], 4, mode="symmetric")
    want = np.array([[(w[:, None] * w * pad[i : i + 9, j : j + 9]).sum() for j in range(16)] for i in range(16)])
    np.testing.assert_allclose(matrix(M.gaussian_filter(df))[1], want)


def test_savgol_keeps_parabolas(spark):
    rows = [(0, i, j, float(1 + 0.2 * i + 0.1 * j * j)) for i in range(9) for j in range(9)]
    df = spark.createDataFrame(rows, "angle_idx int, i int, j int, c2 double")
    np.testing.assert_allclose(matrix(M.savgol_filter(df), 9, 1)[0].ravel(), [r[3] for r in rows], rtol=1e-9)


@pytest.mark.parametrize("method", ["baseline", "statistical", "minmax", "robust", "physics_based"])
def test_normalisations(cells, method):
    df, x = cells
    y, m = matrix(M.normalise(df, method))[0], x[0]
    lo, hi = np.percentile(m, [25, 75])
    want = {"baseline": m / m[0, 0], "statistical": (m - m.mean()) / m.std(), "minmax": (m - m.min()) / (m.max() - m.min()), "robust": (m - np.median(m)) / (hi - lo), "physics_based": m / m.max()}[method]
    np.testing.assert_allclose(y, want, rtol=1e-12, atol=1e-12)


def test_symmetrise_and_halves(cells):
    df, x = cells
    skew = df.withColumn("c2", F.col("c2") + F.col("i"))
    np.testing.assert_allclose(matrix(Fl.symmetrise(skew))[0], (x[0] + np.arange(16)[:, None] / 2 + np.arange(16) / 2))
    assert (matrix(Fl.half_to_full(Fl.upper_triangle(df))) == x).all()
    assert A.correlation_checks(df).where("symmetric").count() == 2


def test_repair_and_empty_tables(spark):
    bad = spark.createDataFrame([(0, 0, 0, float("nan")), (0, 0, 1, 2.0), (0, 1, 0, float("inf")), (0, 1, 1, -1.0)], "angle_idx int, i int, j int, c2 double")
    got = {(r.i, r.j): r.c2 for r in A.repair(bad, "aggressive").collect()}
    assert got == {(0, 0): 0.5, (0, 1): 2.0, (1, 0): 0.5, (1, 1): 1e-6}
    assert {r["category"] for r in A.issues(bad).collect()} >= {"finite", "sign"}
    none = bad.limit(0)
    for df in (M.diagonal_basic(none), M.normalise(none, "minmax"), A.matrix_quality(none), M.median_filter(none), A.repair(none), Fl.symmetrise(none)):
        assert df.count() == 0


def test_angles_wrap_and_fall_back(spark):
    a = spark.createDataFrame([(0, 175.0), (1, -175.0), (2, 0.0)], "angle_idx int, phi double")
    assert {r.angle_idx for r in Fl.select_angles(a, [(170.0, -170.0)]).collect()} == {0, 1}
    assert Fl.select_angles(a, [(60.0, 70.0)]).count() == 3
    assert Fl.select_angles(a, [(60.0, 70.0)], fallback=False).count() == 0
    with pytest.raises(ValueError):
        Fl.frame_stride(2)


def test_chunks_are_a_permutation(spark):
    points = spark.range(103).select((F.col("id") % 3).cast("int").alias("angle_idx"), F.col("id").alias("point_id"))
    sizes = W.allocate_chunks(points, 4).groupBy("angle_idx", "chunk").count().collect()
    assert sum(r["count"] for r in sizes) == 103
    for a in range(3):
        own = sorted((r["count"] for r in sizes if r["angle_idx"] == a), reverse=True)
        assert own[0] - own[-1] <= 1
    assert W.shuffled_chunks(points, 4).count() == 103


def _matrix(spark, a, angle=0):
    n = len(a)
    return spark.createDataFrame([(angle, i, j, float(a[i, j])) for i in range(n) for j in range(n)], "angle_idx int, i int, j int, c2 double")


@pytest.mark.parametrize("n", [1, 5, 13, 17])
def test_stencils_in_tiles_equal_whole_matrices(spark, n):
    rng = np.random.default_rng(n)
    a = rng.random((n, n))
    for r, got in ((1, M.stencil(_matrix(spark, a), 1, lambda x: np.median(np.lib.stride_tricks.sliding_window_view(x, (3, 3)), axis=(2, 3)), tile=4)), (2, M.stencil(_matrix(spark, a), 2, lambda x: np.median(np.lib.stride_tricks.sliding_window_view(x, (5, 5)), axis=(2, 3)), tile=6))):
        if n < r:
            continue
        padded = np.pad(a, r, mode="symmetric")
        want = np.median(np.lib.stride_tricks.sliding_window_view(padded, (2 * r + 1, 2 * r + 1)), axis=(2, 3))
        rows = got.collect()
        assert len(rows) == n * n and all(abs(row.c2 - want[row.i, row.j]) < 1e-12 for row in rows)


def test_quality_ignores_a_cell_that_is_not_finite(spark):
    rng = np.random.default_rng(4)
    a = 1 + rng.random((8, 8)) * 0.01
    skew = a.copy()
    skew[0, 5] = np.nan
    one = np.array([[1.2]])
    cells = _matrix(spark, skew).union(_matrix(spark, one, 1)).union(_matrix(spark, np.full((3, 3), np.nan), 2))
    got = {r.angle_idx: r.score for r in A.matrix_quality(cells).collect()}
    gap = np.nanmean(np.abs(skew - skew.T))
    assert abs(got[0] - (0.4 * 63 / 64 + 0.3 + 0.2 * max(0, 1 - 100 * gap) + 0.1)) < 1e-9 and abs(got[1] - 1) < 1e-12 and got[2] == 0
    assert {r.angle_idx for r in A.quality_filter(cells, 0.99).select("angle_idx").distinct().collect()} == {1}
    s = {r.angle_idx: r.symmetry for r in A.symmetry_and_decay(cells).collect()}
    assert abs(s[0] - 100 * (1 - gap / np.nanmax(skew))) < 1e-9 and s[1] == 100 and s[2] is None


def test_repairs_one_by_one(spark):
    a = np.array([[1.0, np.nan, np.inf], [2.0, 3.0, -np.inf], [4.0, 5.0, -6.0]])
    cells = _matrix(spark, a)

    def fixed(only):
        return {(r.i, r.j): r.c2 for r in A.repair(cells, only=only).collect()}

    both = fixed(("nan", "infinite"))
    assert both[0, 1] == both[0, 2] == both[1, 2] == 2.5 and both[2, 2] == -6
    edge = fixed(("infinite",))
    assert np.isnan(edge[0, 1]) and edge[0, 2] == 5 and edge[1, 2] == -6
    nan = fixed(("nan",))
    assert nan[0, 1] == 2.5 and nan[0, 2] == np.inf
    assert fixed(("negative",))[2, 2] == 1e-6 and A.repair(cells, "disabled") is cells


def test_percentiles_are_exact_beyond_the_sketch(spark, monkeypatch):
    import duochron.operators.quantiles as Q

    monkeypatch.setattr(Q, "SMALL", 50)
    monkeypatch.setattr(Q, "MARGIN", 0.02)
    rng = np.random.default_rng(5)
    v = np.concatenate([rng.lognormal(0, 2, 3000), np.full(700, 1.5)])
    rows = spark.createDataFrame([(0, float(x), k % 3 == 0) for k, x in enumerate(v)] + [(1, 4.0, True), (1, 5.0, False), (1, None, True), (2, None, True)], "g int, v double, third boolean").repartition(4)
    shares = {f"p{k}": q for k, q in enumerate((0.0, 0.05, 0.2, 0.5, 0.61, 0.9, 0.99, 1.0))}
    got = {r.g: r for r in Q.exact_percentiles(rows, ["g"], "v", shares | {"own": (0.3, "third")}).collect()}
    for k, q in shares.items():
        assert abs(got[0][k] - np.quantile(v, q)) < 1e-12, k
    assert abs(got[0].own - np.quantile(v[::3], 0.3)) < 1e-12 and got[1].p3 == 4.5 and got[1].own == 4.0 and 2 not in got
    none = Sc.colour_limits(rows.where("g = 2").select(F.col("v").alias("c2"))).first()
    assert (none.lo, none.hi) == (1.0, 1.5)


def test_ordered_ranges_equal_one_window(spark, monkeypatch):
    import pandas as pd

    rng = np.random.default_rng(6)
    step = np.sort(rng.choice(10**6, 9000, replace=False))
    on = rng.random(9000) < 0.9
    on[2000:5000] = True  # a run over several ranges
    h = spark.createDataFrame([(int(s), bool(o), float(v)) for s, o, v in zip(step, on, rng.random(9000))], "step long, triggered boolean, value double").repartition(5)
    monkeypatch.setattr(W, "RANGE_ROWS", 700)
    assert W.with_ranges(h, "step").select("range").distinct().count() > 3
    run, want = 0, {}
    for s, o in zip(step.tolist(), on.tolist()):
        run = run + 1 if o else 0
        want[s] = run
    got = {r.step: (r.run, r.fires) for r in W.consecutive_triggers(h).collect()}
    assert got == {s: (r, r >= 5) for s, r in want.items()}
    pdf = h.toPandas().sort_values("step").reset_index(drop=True)
    rolled = W.ring_statistics(h.select(F.col("step").alias("batch"), F.col("triggered").alias("success"), F.col("value").alias("loss"), F.col("step").alias("iterations"))).toPandas().sort_values("batch")
    np.testing.assert_allclose(rolled["mean_loss"].to_numpy(), pdf["value"].rolling(100, min_periods=1).mean().to_numpy(), rtol=1e-9)
    numbers = W.numbered(h.select("step"), "step", "k").toPandas().sort_values("step")
    assert (numbers["k"].to_numpy() == np.arange(1, 9001)).all() and isinstance(pdf, pd.DataFrame)


def test_a_changed_pair_of_repeated_rows_changes_the_hash(spark):
    a = spark.createDataFrame([(1, 2.0), (1, 2.0), (3, 4.0)], "k int, v double")
    b = spark.createDataFrame([(7, 2.0), (7, 2.0), (3, 4.0)], "k int, v double")
    assert A.component_hash(a).first().hash != A.component_hash(b).first().hash
    assert A.component_hash(a).first().hash == A.component_hash(a.orderBy("v", ascending=False)).first().hash


@pytest.mark.parametrize("name, mode", [("Heterodyne", "two_component"), ("two-component", "two_component"), ("laminar", "laminar_flow"), ("static_anisotropic", "static_anisotropic"), ("Static-Isotropic", "static_isotropic")])
def test_mode_names(name, mode):
    assert mode_of(name) == mode


@pytest.mark.parametrize("name", ["static", "isotropic", "flow", ""])
def test_mode_names_that_are_none(name):
    with pytest.raises(ValueError):
        mode_of(name)
    if name == "static":
        assert mode_of(name, allow_bare_static=True) == "static_anisotropic"


def test_components_are_validated_once(spark):
    from duochron.operators import validation as Va
    from duochron.schema import Dataset

    c2 = np.full((3, 3), 1.2)
    c2[0, 0] = -1
    angle = spark.createDataFrame([(0, "", 5.0, 10.0), (1, "", 0.01, 400.0)], "angle_idx int, name string, q double, phi double")
    frame = spark.createDataFrame([(0, 0.0), (1, 2.0), (2, 1.0)], "i int, t double")
    d = Dataset(_matrix(spark, c2), angle, frame, 1e5)
    rows, hashes = Va.validate(d)
    assert {(r.component, r.parameter) for r in rows.collect()} >= {("c2", "c2"), ("angle", "q"), ("angle", "phi"), ("frame", "t"), ("frame", "dt")}
    assert Va.validate(d, hashes)[0].count() == 0
    other = Dataset(_matrix(spark, c2 + 1), angle, frame, 1e5)
    assert {r.component for r in Va.validate(other, hashes)[0].collect()} <= {"c2"}
    with pytest.raises(ValueError):
        Va.component_issues(d, "q")


def test_stages_are_the_operators_in_turn(spark, cells):
    from duochron.operators import validation as Va

    df, _ = cells
    keep = spark.createDataFrame([(1,)], "angle_idx int")
    at = Va.stages(df, keep, "basic", "minmax", None)
    want = M.diagonal_basic(M.normalise(M.diagonal_basic(df.where("angle_idx = 1")), "minmax"))
    np.testing.assert_allclose(matrix(at["final"])[1], matrix(want)[1])
    report = {r.stage: r for r in Va.stage_report(at).collect()}
    assert list(at) == list(Va.STAGES) and report["raw"].n == 512 and report["final"].n == 256 and report["final"].finite_fraction == 1


@pytest.mark.parametrize("side", ["ceiling", "floor"])
@pytest.mark.parametrize("small", [True, False])
def test_lookup_on_an_uneven_grid(spark, monkeypatch, side, small):
    """Both routes against a binary search: ends, equal values, repeated and null points, an extra column."""
    from duochron.operators import asof

    monkeypatch.setattr(W, "RANGE_ROWS", 40)
    monkeypatch.setattr(asof, "GRID_POINTS", 4096 if small else 0)
    rng = np.random.default_rng(8)
    grid = np.unique(np.round(rng.random(150) * 100, 1))
    at = np.concatenate([rng.random(200) * 120 - 10, grid[::7], grid[:3], [-50.0, 500.0]])
    rows = [(k, float(v), k) for k, v in enumerate(at)] + [(9999, None, 1)]
    points = spark.createDataFrame(rows, "k int, at double, index int").repartition(4)
    table = spark.createDataFrame([(float(t), k) for k, t in enumerate(grid)], "t double, index int")
    got = {r.k: r.found for r in asof.nearest_on_grid(points, table, "at", "found", side).collect()}
    want = np.searchsorted(grid, at, "left") if side == "ceiling" else np.searchsorted(grid, at, "right") - 1
    assert got == {**{k: int(v) for k, v in enumerate(np.clip(want, 0, len(grid) - 1))}, 9999: None}
    assert {r.found for r in asof.nearest_on_grid(points, table.limit(0), "at", "found", side).collect()} == {None}


@pytest.mark.parametrize("side", ["ceiling", "floor"])
def test_lookup_reads_no_frame_anew_for_each_row(spark, monkeypatch, side):
    from duochron.operators import asof

    monkeypatch.setattr(asof, "GRID_POINTS", 0)
    monkeypatch.setattr(W, "RANGE_ROWS", 40)
    points = spark.range(100).select("id", F.col("id").cast("double").alias("at"))
    grid = spark.range(50).select((F.col("id") * 2.0).alias("t"), F.col("id").alias("index"))
    plan = asof.nearest_on_grid(points, grid, "at", "found", side)._jdf.queryExecution().optimizedPlan().toString()
    frames = re.findall(r"specifiedwindowframe\((.*?)\)\)", plan)
    assert frames and not [f for f in frames if "unboundedfollowing" in f and "unboundedpreceding" not in f]


def test_best_starts_are_ranked_over_ranges(spark, monkeypatch):
    monkeypatch.setattr(W, "RANGE_ROWS", 10)
    rows = [(k, float(k * 7 % 11)) for k in range(60)]  # ties
    got = sorted((r.rank, r.start) for r in W.keep_best(spark.createDataFrame(rows, "start int, cost double").repartition(3)).collect())
    assert got == [(n, k) for n, (_, k) in enumerate(sorted((c, k) for k, c in rows)[:30], 1)]


def test_symmetry_by_pairs(spark):
    rows = [(0, 0, 0, 1.0), (0, 0, 1, 1.2), (0, 1, 0, 1.2), (1, 0, 1, 1.2), (1, 1, 0, 1.3), (2, 0, 1, 3.0), (2, 1, 0, 3.0), (3, 0, 1, float("nan")), (3, 1, 0, 1.0), (4, 0, 1, 1.0), (4, 2, 3, 7.0)]
    got = {r.angle_idx: (r.symmetric, r.near_zero_lag_ok) for r in A.correlation_checks(spark.createDataFrame(rows, "angle_idx int, i int, j int, c2 double")).collect()}
    assert got == {0: (True, True), 1: (False, True), 2: (True, False), 3: (False, False), 4: (None, True)}


@pytest.mark.parametrize("n", [3, 5, 6, 23])
def test_tiles_of_savgol_and_wiener_equal_whole_matrices(spark, monkeypatch, n):
    """Small tiles against NumPy on the whole matrix, ends included."""
    rng = np.random.default_rng(n)
    a = rng.random((n, n))
    rows = [(0, i, j, float(a[i, j])) for i in range(n) for j in range(n)]
    df = spark.createDataFrame(rows, "angle_idx int, i int, j int, c2 double").repartition(3)
    monkeypatch.setattr(M.stencil, "__defaults__", (7, *M.stencil.__defaults__[1:]))
    v = np.vander(np.arange(5), 3, increasing=True).astype(float)
    hat = v @ np.linalg.pinv(v)
    taps = np.eye(n)
    if n >= 5:
        for k in range(n):
            lo = min(max(k - 2, 0), n - 5)
            taps[k] = 0
            taps[k, lo : lo + 5] = hat[k - lo]
    np.testing.assert_allclose(matrix(M.savgol_filter(df), n, 1)[0], taps @ a @ taps.T, rtol=1e-9)
    wide = np.pad(a, 1)
    box = lambda x: sum(x[k : k + n, m : m + n] for k in range(3) for m in range(3)) / 9
    m, var = box(wide), box(wide * wide) - box(wide) ** 2
    want = np.where(var < var.mean(), m, m + (1 - var.mean() / var) * (a - m))
    np.testing.assert_allclose(matrix(M.wiener_filter(df), n, 1)[0], want, rtol=1e-8)
