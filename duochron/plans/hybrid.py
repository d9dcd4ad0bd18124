"""Gradient descent with memory, then Gauss-Newton: fits from starts where a damped Gauss-Newton step fails.

The first phase needs a gradient and a cost only (parameters + 2 doubles a
task), so it also serves vectors too long for a normal matrix. Parameters are
normalised by their bounds. A line search tries all its step lengths in one job.
The second phase and the covariance are the damped Gauss-Newton fit's.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .solve import FitResult, chi_squared_of, levenberg_marquardt


def gradient_of(cells: DataFrame, model, p: np.ndarray) -> tuple[np.ndarray, float, int]:
    """(gradient of the sum of squared weighted residuals by the parameters, that sum, cells), from one aggregation without J^T J."""
    size = len(p)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size + 2)
        for batch in batches:
            a, i, j = (batch.column(k).to_numpy() for k in range(3))
            y, s = batch.column(3).to_numpy(), batch.column(4).to_numpy()
            w = np.where(s > 0, 1.0 / np.where(s > 0, s, 1.0), 0.0)
            value, jac = model.evaluate(p, a, i, j)
            r = (y - value) * w
            total[:size] -= 2 * jac.T @ (r * w)
            total[size] += r @ r
            total[size + 1] += len(r)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size + 2), pa.int32()), pa.array(total)], ["k", "v"])

    rows = cells.select("angle_idx", "i", "j", "c2", "sigma").mapInArrow(fold, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()  # parameters + 2 rows
    out = np.zeros(size + 2)
    for row in rows:
        out[row["k"]] = row["v"]
    return out[:size], float(out[size]), int(out[size + 1])


def two_loop(gradient: np.ndarray, steps: list[np.ndarray], changes: list[np.ndarray]) -> np.ndarray:
    """The quasi-Newton direction of limited memory for steps and gradient changes, oldest first."""
    q = gradient.copy()
    weights = []
    for s, y in zip(steps[::-1], changes[::-1]):
        a = (s @ q) / (y @ s)
        weights.append(a)
        q -= a * y
    if steps:
        q *= (steps[-1] @ changes[-1]) / (changes[-1] @ changes[-1])
    for s, y, a in zip(steps, changes, weights[::-1]):
        q += s * (a - (y @ q) / (y @ s))
    return -q


def descend(cells: DataFrame, model, start: np.ndarray, lower: np.ndarray, upper: np.ndarray, max_iterations: int = 60, memory: int = 8, tolerance: float = 1e-6, trials: int = 8) -> tuple[np.ndarray, float, list[float], str]:
    """(parameters, cost, costs by step, status) by projected limited-memory quasi-Newton steps in the unit box of the bounds.

    A step is the longest of ``trials`` lengths that falls enough; they are
    evaluated in one job. Status: converged, no_step, max_iterations or not_finite.
    """
    free = lower < upper
    width = np.where(free, upper - lower, 1.0)
    x = (np.clip(np.asarray(start, float), lower, upper) - lower) / width
    gradient, cost, n = gradient_of(cells, model, lower + x * width)
    history, status = [cost], "max_iterations"
    steps: list[np.ndarray] = []
    changes: list[np.ndarray] = []
    for _ in range(max_iterations):
        g = gradient * width
        if not np.isfinite(cost) or not np.isfinite(g).all():
            status = "not_finite"
            break
        moving = free & ~((x <= 0) & (g > 0)) & ~((x >= 1) & (g < 0))
        if np.max(np.abs(g[moving]), initial=0.0) <= tolerance * max(cost, 1e-300) or cost < 1e-25 * max(n, 1):
            status = "converged"
            break
        direction = np.where(moving, two_loop(np.where(moving, g, 0.0), [np.where(moving, s, 0) for s in steps], [np.where(moving, y, 0) for y in changes]) if all((s * y)[moving].sum() > 0 for s, y in zip(steps, changes)) else -g, 0.0)
        if not np.isfinite(direction).all() or direction @ g >= 0:
            direction = np.where(moving, -g, 0.0)
            steps, changes = [], []
        longest = 1.0 if steps else 0.5 / max(np.max(np.abs(direction)), 1e-300)  # the first step crosses half the box at most
        lengths = longest * 0.25 ** np.arange(trials)
        tried = np.clip(x + lengths[:, None] * direction, 0, 1)
        costs = chi_squared_of(cells, model, lower + tried * width)
        enough = np.isfinite(costs) & (costs <= cost + 1e-4 * ((tried - x) @ g)) & (costs < cost)
        if not enough.any():
            if steps:
                steps, changes = [], []  # once more along the gradient
                continue
            status = "no_step"
            break
        # Of the lengths that fall enough, the one that falls most.
        best = int(np.flatnonzero(enough)[np.argmin(costs[enough])])
        before, x, old = x, tried[best], g
        gradient, cost, _ = gradient_of(cells, model, lower + x * width)
        history.append(cost)
        s, y = x - before, gradient * width - old
        if s @ y > 1e-12 * np.linalg.norm(s) * np.linalg.norm(y):
            steps, changes = [*steps, s][-memory:], [*changes, y][-memory:]
        if history[-2] - cost <= tolerance * history[-2]:
            status = "converged"
            break
    return lower + x * width, cost, history, status


def hybrid(cells: DataFrame, model, start: np.ndarray, lower: np.ndarray, upper: np.ndarray, max_iterations: int = 60, **options) -> FitResult:
    """Descend, then damped Gauss-Newton from there with its covariance; where that accepts no step, the descent's own end and status stay."""
    cells = cells.persist()
    try:
        p, cost, history, status = descend(cells, model, start, lower, upper, max_iterations)
        fit = levenberg_marquardt(cells, model, p, lower, upper, **options)
        converged = fit.converged or (status == "converged" and fit.status == "no_step")
        return replace(fit, history=[*history, *fit.history[1:]], iterations=len(history) - 1 + fit.iterations, converged=converged, status="converged" if converged else fit.status)
    finally:
        cells.unpersist()
