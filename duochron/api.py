"""The public entry points: load, fit, and the tables behind plots."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import load_config
from .functions import kernels as K
from .operators import filters as Fl
from .operators import matrix as M
from .operators import scaling as Sc
from .operators import views as V
from .operators import aggregates as A
from .plans.evolution import bipop, worth_it
from .plans.hybrid import hybrid
from .plans.layouts import Log, ScalingMap, Shift, Stack, hierarchical, recover, shear_weighted, variation_penalty
from .plans.models import Heterodyne, Homodyne
from .plans.monitor import Collapsed, GradientMonitor
from .plans.parameters import MODES, REGISTRY, mode_of, scaling_layout
from .plans.solve import FitResult, keep_better, levenberg_marquardt, multistart
from .plans.stratified import trust_region
from .schema import Dataset
from .sources.files import load


def load_data(spark: SparkSession, source: str | Dataset, config: dict | str | None = None, cache: str | None = None) -> Dataset:
    """Read, filter angles, slice frames, preprocess: the cells ready for a fit."""
    c = load_config(config or {})
    a, f = c["analyzer_parameters"], c["phi_filtering"]
    d = source if isinstance(source, Dataset) else load(spark, source, cache, a["wavevector_q"], a["dt"], finite=c["preprocessing"]["repair"] == "disabled")
    cells, angle = d.c2, d.angle
    if f["enabled"]:
        angle = Fl.select_angles(angle, f["target_ranges"] or Fl.DEFAULT_RANGES, normalise=True, fallback=f["fallback_on_empty"])
        cells = cells.join(F.broadcast(angle.select("angle_idx")), "angle_idx", "left_semi")  # one row an angle
    if a["start_frame"] > 1 or a["end_frame"] >= 0:
        cells = Fl.slice_frames(cells, a["start_frame"], a["end_frame"])
    p = c["preprocessing"]
    cells = A.repair(cells, p["repair"])
    return Dataset(M.preprocess(cells, p["diagonal"], p["normalisation"], p["noise"]), angle, d.frame, a["dt"], a["stator_rotor_gap"])


def fit(spark: SparkSession, d: Dataset, config: dict | str | None = None) -> tuple[FitResult, list[str]]:
    """Fit the configured model; (result, parameter names). The cells stay distributed throughout."""
    c = load_config(config or {})
    mode = mode_of(c["analysis_mode"])
    angles = d.angle.orderBy("angle_idx").collect()  # a dimension: one row an angle
    n_frames = d.c2.agg(F.max("i")).first()[0] + 1
    position = {a["angle_idx"]: k for k, a in enumerate(angles)}
    q, phi = (np.array([a[k] for a in angles], float) for k in ("q", "phi"))
    layout = scaling_layout(c["optimization"]["per_angle_mode"], len(angles))
    order = min(2, (len(angles) - 1) // 2)
    if layout == "fourier" and order < 1:
        raise ValueError("fourier scaling needs three angles")
    shared = layout in ("averaged", "constant")
    if mode == "two_component":
        model = Heterodyne((np.arange(n_frames) + 1.0) * d.dt, q, phi, d.dt, shared)
        cells = Fl.off_diagonal(d.c2)
    else:
        model = Homodyne(np.arange(n_frames) * d.dt, q, phi, d.dt, d.length, mode == "laminar_flow", shared)
        cells = Fl.off_diagonal(d.c2, drop_first_frame=False)
    lookup = F.create_map(*(F.lit(x) for pair in position.items() for x in pair))
    cells = Fl.with_defaults(cells).select(lookup[F.col("angle_idx")].alias("angle_idx"), "i", "j", "c2", "sigma")
    k = model.n_scaling
    names = [f"contrast_{i}" for i in range(k)] + [f"offset_{i}" for i in range(k)] + list(MODES[mode])
    estimate = {r["angle_idx"]: r for r in Sc.quantile_scaling(d.c2).collect()}  # one row an angle
    contrasts, offsets = (np.array([estimate[a["angle_idx"]][n] for a in angles]) for n in ("contrast", "offset"))
    if shared:
        contrasts, offsets = contrasts.mean(keepdims=True), offsets.mean(keepdims=True)
    own = c["initial_parameters"]
    physics = np.array([own.get(n, REGISTRY[n].default) for n in MODES[mode]])
    start = np.concatenate([np.clip(contrasts, 0.01, 1.0), offsets, physics])
    low = np.concatenate([np.full(k, REGISTRY["contrast"].lower), np.full(k, REGISTRY["offset"].lower), [REGISTRY[n].lower for n in MODES[mode]]])
    high = np.concatenate([np.full(k, REGISTRY["contrast"].upper), np.full(k, REGISTRY["offset"].upper), [REGISTRY[n].upper for n in MODES[mode]]])
    if layout == "constant":
        low[: 2 * k], high[: 2 * k] = start[: 2 * k], start[: 2 * k]
    o, guard = c["optimization"], c["optimization"]["anti_degeneracy"]
    if guard["shear_weighting"] and mode == "laminar_flow":
        turned = d.angle.select(lookup[F.col("angle_idx")].alias("angle_idx"), "phi")
        cells = shear_weighted(cells, turned, own.get("phi0", REGISTRY["phi0"].default))
    # From the fit's vector to the model's: what the physics are measured in, then the scaling.
    steps: list = []
    waves = 1 + 2 * order if layout == "fourier" else k
    if mode == "laminar_flow":
        place = {n: 2 * waves + m for m, n in enumerate(MODES[mode])}
        if o["transforms"]["log_shear"]:
            steps.append(Log([place["gamma_dot_t0"]]))
        if o["transforms"]["centred_shear"]:
            steps.append(Shift(place["beta"], float(physics[list(MODES[mode]).index("beta")])))
    in_arrow = o["method"] == "trust_region" and layout == "individual" and guard["variation_penalty"] <= 0
    if in_arrow:
        # Of shared scaling, for sums that are kept per angle; positions count from two scaling parameters.
        shared_model = Heterodyne(model.t, q, phi, d.dt, True) if mode == "two_component" else Homodyne(model.t, q, phi, d.dt, d.length, mode == "laminar_flow", True)
        near = [Log([x - 2 * k + 2 for x in s.positions]) if isinstance(s, Log) else Shift(s.position - 2 * k + 2, s.reference) for s in steps]
        arrow_model = Stack(shared_model, near) if near else shared_model
    if layout == "fourier":
        steps.append(ScalingMap("fourier", phi, order))
    stack = Stack(model, steps) if steps else None
    if stack is not None:
        model, start = stack, stack.to_fit(start)
        low, high = stack.bounds(low, high)
        k = waves
    strength = guard["variation_penalty"]

    def penalty(p: np.ndarray) -> tuple:
        total = np.zeros((len(p), len(p))), np.zeros(len(p)), 0.0
        for at in (slice(0, k), slice(k, 2 * k)):
            h, g, r2 = variation_penalty(p[at], strength)
            total[0][at, at] += h
            total[1][at] += g
            total = total[0], total[1], total[2] + r2
        return total

    options = {"max_iterations": o["max_iterations"], "loss": o["loss"], "penalty": penalty if strength > 0 and k > 1 and layout != "fourier" else None}
    if guard["hierarchical"]:
        start = hierarchical(cells, model, start, low, high, k).parameters
    if in_arrow:
        watch = GradientMonitor(len(MODES[mode])) if guard["monitor"] else None
        try:
            found = trust_region(cells, arrow_model, start, low, high, o["max_iterations"], loss=o["loss"], on_step=watch)
        except Collapsed:
            # The angles' own scaling takes over: one scaling for all can't.
            return fit(spark, d, {**c, "optimization": {**o, "per_angle_mode": "averaged"}})
        # The arrow gives the physics' covariance; the scaling's part of the whole one is its variances.
        covariance = np.diag(found.uncertainties**2)
        covariance[2 * k :, 2 * k :] = found.covariance
        result = replace(found, covariance=covariance)
    elif o["method"] == "hybrid":
        result = hybrid(cells, model, start, low, high, **options)
    else:
        result = levenberg_marquardt(cells, model, start, low, high, **options)
    if not result.converged and o["recover"]:
        result = recover(cells, model, result, low, high, **options)
    evolved = o["cmaes"]["enable"]
    if evolved is True or evolved == "auto" and worth_it(low, high):
        own = bipop(cells, model, result.parameters, low, high, budget=o["cmaes"]["budget"], restarts=o["cmaes"]["restarts"], seed=o["cmaes"]["seed"])
        result = keep_better(result, levenberg_marquardt(cells, model, own.parameters, low, high, **options))
    elif o["multi_start"]["enable"]:
        m = o["multi_start"]
        best, groups = multistart(cells, model, low, high, m["n_starts"], m["seed"], custom=start[None, :], **options)
        result = replace(keep_better(result, best), basins=groups)
    return (stack.back(result) if stack is not None else result), names


def plot_tables(d: Dataset, contrast: float, offset: float, physics: dict[str, float], mode: str = "static_isotropic", pixels: int = 512) -> dict[str, DataFrame]:
    """The DataFrames behind the figures: comparison, residual histogram, rasters."""
    if mode == "two_component":
        surface = K.heterodyne_surface(d.frame, d.angle, physics, d.dt).withColumn("model", F.lit(offset) + F.lit(contrast) * F.col("model"))
    else:
        surface = K.homodyne_surface(d.frame, d.angle, physics, d.dt, d.length).withColumn("model", K.scaled(F.col("g1"), F.lit(contrast), F.lit(offset))).drop("g1")
    cells = d.c2.join(surface, ["angle_idx", "i", "j"])
    n = d.frame.count()
    return {"comparison": V.comparison(cells), "histogram": V.residual_histogram(cells, -0.5, 0.5, 100), "raster": V.rasterise(d.c2, n, min(pixels, n), min(pixels, n))}
