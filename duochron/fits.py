"""Fit queries: iterative, so without SQL; tests hold them against the parameters that their cells were made with.

The cells are the event table's own correlations, taken as noise, on top of a
model with known parameters. So a fit reads, joins and fits all cells of the
table, and what it should find is known.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import kernels as K
from .plans.evolution import bipop
from .plans.hybrid import hybrid
from .plans.models import Heterodyne, Homodyne
from .plans.parameters import REGISTRY, STATIC, TWO_COMPONENT
from .plans.solve import FitResult, levenberg_marquardt, multistart
from .plans.stratified import estimates_table, lockstep, sequential, trust_region
from .sources.events import STEPS, angle_table, events_dataset, frame_table

TRUTH = {"D0": 3000.0, "alpha": 0.4, "D_offset": 20.0}
LOWER, UPPER = np.array([0.0, 0.5, 100.0, -2.0, -1e5]), np.array([1.0, 1.5, 1e5, 2.0, 1e5])
START = np.array([0.5, 1.0, 1000.0, 0.5, 10.0])
CONTRAST, OFFSET = 0.3, 1.0
#: How much of the events' own fluctuations is added, and the sigma that fits are told.
NOISE, SIGMA = 0.002, 0.01


def synthetic_cells(spark: SparkSession, frames: int = 60) -> DataFrame:
    """Noiseless model cells of all angles, contrast 0.3 and offset 1."""
    s = K.homodyne_surface(frame_table(spark, frames), angle_table(spark), TRUTH, 1.0).where(F.col("i") != F.col("j"))
    return s.select("angle_idx", "i", "j", K.scaled(F.col("g1"), F.lit(CONTRAST), F.lit(OFFSET)).alias("c2"), F.lit(SIGMA).alias("sigma"))


def observed(spark: SparkSession, sf_dir: str, step: str = "day", contrast=None) -> DataFrame:
    """Off-diagonal cells of the events on top of the one-component model; ``contrast`` is a column, 0.3 where it isn't given."""
    d = events_dataset(spark, sf_dir, step)
    points = d.c2.where(F.col("i") != F.col("j")).withColumnRenamed("c2", "raw")
    at = K.homodyne_at(points, d.frame, d.angle, TRUTH, 1.0)
    c2 = K.scaled(F.col("g1"), F.lit(CONTRAST) if contrast is None else contrast, F.lit(OFFSET)) + NOISE * (F.col("raw") - 1)
    return at.select("angle_idx", "i", "j", c2.alias("c2"), F.lit(SIGMA).alias("sigma"))


def _model(spark: SparkSession, frames: int, shared: bool = True) -> Homodyne:
    angles = angle_table(spark).orderBy("angle_idx").collect()  # one row an angle
    return Homodyne(np.arange(frames, dtype=float), np.array([a["q"] for a in angles]), np.array([a["phi"] for a in angles]), 1.0, shared_scaling=shared)


def _rows(spark: SparkSession, fit: FitResult, names: list[str], truth: list[float]) -> DataFrame:
    rows = [(n, float(v), float(u), float(t), fit.status) for n, v, u, t in zip(names, fit.parameters, fit.uncertainties, truth)]
    return spark.createDataFrame(rows, "param string, value double, uncertainty double, truth double, status string")


_NAMES, _TRUTH = ["contrast", "offset", *STATIC], [CONTRAST, OFFSET, *TRUTH.values()]


def fit_homodyne(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All hourly cells, one scaling for all angles."""
    return _rows(spark, levenberg_marquardt(observed(spark, sf_dir, "hour"), _model(spark, STEPS["hour"][1]), START, LOWER, UPPER), _NAMES, _TRUTH)


def fit_stratified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All hourly cells, contrast and offset for each angle: the arrow's trust region."""
    model = _model(spark, STEPS["hour"][1])
    n = len(model.phi)
    cells = observed(spark, sf_dir, "hour", F.lit(0.2) + 0.05 * F.col("angle_idx"))
    low, high, start = (np.concatenate([np.full(n, x[0]), np.full(n, x[1]), x[2:]]) for x in (LOWER, UPPER, START))
    names = [f"{k}_{a}" for k in ("contrast", "offset") for a in range(n)] + list(STATIC)
    return _rows(spark, trust_region(cells, model, start, low, high), names, [*(0.2 + 0.05 * np.arange(n)), *[OFFSET] * n, *TRUTH.values()])


def fit_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily cells from a far start: a descent, then Gauss-Newton."""
    far = np.array([0.9, 0.7, 30000.0, -0.5, 3000.0])
    return _rows(spark, hybrid(observed(spark, sf_dir), _model(spark, STEPS["day"][1]), far, LOWER, UPPER, 10), _NAMES, _TRUTH)


def fit_multistart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily cells from the best of eight sampled starts and a given one."""
    return _rows(spark, multistart(observed(spark, sf_dir), _model(spark, STEPS["day"][1]), LOWER, UPPER, n_starts=8, custom=START[None, :])[0], _NAMES, _TRUTH)


def _with_truth(rows: DataFrame) -> DataFrame:
    known = rows.sparkSession.createDataFrame(list(zip(_NAMES, _TRUTH)), "param string, truth double")
    return rows.join(F.broadcast(known), "param")


def fit_per_angle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily cells, every angle on its own, all in the same jobs."""
    model = _model(spark, STEPS["day"][1])
    return _with_truth(estimates_table(spark, lockstep(observed(spark, sf_dir), model, START, LOWER, UPPER, len(model.phi)), _NAMES))


def fit_sequential(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The angles' own fits combined by their variances."""
    model = _model(spark, STEPS["day"][1])
    return _with_truth(sequential(observed(spark, sf_dir), model, START, LOWER, UPPER, len(model.phi))[0])


HETERODYNE = {"D0_ref": 8000.0, "alpha_ref": 0.2, "D_offset_ref": 100.0, "D0_sample": 12000.0, "alpha_sample": -0.1, "D_offset_sample": 50.0, "v0": 80.0, "v_beta": 0.0, "v_offset": 0.0, "f0": 0.4, "f1": 0.0, "f2": 0.0, "f3": 0.1, "phi0_het": 0.0}
#: Fitted beside contrast and offset; the others are held.
FREE = ("D0_ref", "D0_sample", "v0")


def fit_heterodyne(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two-component model jointly over all angles' daily cells; rates and velocity free, the fraction held, which trades with the contrast."""
    d = events_dataset(spark, sf_dir)
    angles = d.angle.orderBy("angle_idx").collect()  # one row an angle
    n = STEPS["day"][1]
    model = Heterodyne(np.arange(n) * 1.0 + 1.0, np.array([a["q"] for a in angles]), np.array([a["phi"] for a in angles]), 1.0, shared_scaling=True)
    points = d.c2.where((F.col("i") > 0) & (F.col("j") > 0) & (F.col("i") != F.col("j"))).withColumnRenamed("c2", "raw")
    at = K.heterodyne_at(points, frame_table(spark, n, first=1), d.angle, HETERODYNE, 1.0)
    c2 = OFFSET + CONTRAST * F.col("model") + NOISE * (F.col("raw") - 1)
    cells = at.select("angle_idx", "i", "j", c2.alias("c2"), F.lit(SIGMA).alias("sigma"))
    truth = np.array([CONTRAST, OFFSET, *HETERODYNE.values()])
    free = np.array([True, True, *(x in FREE for x in TWO_COMPONENT)])
    low = np.array([0.0, 0.5, *(REGISTRY[x].lower for x in TWO_COMPONENT)])
    high = np.array([1.0, 1.5, *(REGISTRY[x].upper for x in TWO_COMPONENT)])
    start = np.where(free, truth * 1.1, truth)
    low, high = np.where(free, low, truth), np.where(free, high, truth)
    fit = levenberg_marquardt(cells, model, start, low, high, 40)
    rows = _rows(spark, fit, ["contrast", "offset", *TWO_COMPONENT], truth.tolist())
    return rows.where(F.col("param").isin("contrast", "offset", *FREE))


def fit_cmaes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily cells: evolution with restarts from the middle of the box, finished by Levenberg-Marquardt."""
    cells, model = observed(spark, sf_dir).persist(), _model(spark, STEPS["day"][1])
    low, high = np.array([0.0, 0.5, 100.0, -1.0, -100.0]), np.array([1.0, 1.5, 1e4, 1.0, 100.0])
    try:
        best = bipop(cells, model, (low + high) / 2, low, high, budget=600, restarts=2)
        return _rows(spark, levenberg_marquardt(cells, model, best.parameters, low, high), _NAMES, _TRUTH)
    finally:
        cells.unpersist()


def queries() -> dict:
    return {f.__name__: f for f in (fit_homodyne, fit_stratified, fit_hybrid, fit_multistart, fit_per_angle, fit_sequential, fit_heterodyne, fit_cmaes)}
