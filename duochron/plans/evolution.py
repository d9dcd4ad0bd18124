"""Covariance matrix adaptation with restarts of two kinds, a generation to a job."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from .solve import chi_squared_of

#: From this ratio of scales on, evolution is worth its price; and the population's steps by that ratio.
TRIGGER_RATIO = 1000.0
POPULATIONS = ((1e6, 4), (1e4, 2), (0.0, 1))


@dataclass
class Evolved:
    parameters: np.ndarray
    chi_squared: float
    evaluations: int
    #: Of the last distribution, in the parameters' own units.
    covariance: np.ndarray
    #: (kind, population, evaluations, least chi-squared) of each run.
    runs: list[tuple[str, int, int, float]]


def scale_ratio(lower: np.ndarray, upper: np.ndarray) -> float:
    """The largest over the smallest width of the bounds of free parameters."""
    width = (upper - lower)[upper > lower]
    return float(width.max() / width.min()) if len(width) else 1.0


def worth_it(lower: np.ndarray, upper: np.ndarray, trigger: float = TRIGGER_RATIO) -> bool:
    return scale_ratio(lower, upper) >= trigger


def population_of(n: int, ratio: float) -> int:
    """The usual population of n parameters, more where their scales differ much."""
    return next(f for least, f in POPULATIONS if ratio >= least) * (4 + int(3 * np.log(max(n, 1))))


def evolve(cost: Callable[[np.ndarray], np.ndarray], mean: np.ndarray, sigma: float, population: int, rng: np.random.Generator, budget: int, tolerance: float = 1e-10) -> tuple[np.ndarray, float, int, np.ndarray]:
    """One run in the unit box: (best point, its cost, evaluations, covariance), until the budget is spent, the spread is tiny or costs no longer differ."""
    n = len(mean)
    parents = population // 2
    weights = np.log(parents + 0.5) - np.log(np.arange(1, parents + 1))
    weights /= weights.sum()
    mass = 1 / (weights**2).sum()
    c_sigma, c_path = (mass + 2) / (n + mass + 5), (4 + mass / n) / (n + 4 + 2 * mass / n)
    c_one = 2 / ((n + 1.3) ** 2 + mass)
    c_many = min(1 - c_one, 2 * (mass - 2 + 1 / mass) / ((n + 2) ** 2 + mass))
    brake = 1 + c_sigma + 2 * max(0.0, np.sqrt((mass - 1) / (n + 1)) - 1)
    usual = np.sqrt(n) * (1 - 1 / (4 * n) + 1 / (21 * n * n))
    covariance, path_sigma, path = np.eye(n), np.zeros(n), np.zeros(n)
    best, least, used, generation = mean.copy(), np.inf, 0, 0
    recent: list[float] = []
    while used + population <= budget:
        values, axes = np.linalg.eigh(covariance)
        roots = np.sqrt(np.maximum(values, 1e-20))
        points = mean + sigma * (rng.standard_normal((population, n)) * roots) @ axes.T
        inside = np.clip(points, 0, 1)
        costs = cost(inside)
        used, generation = used + population, generation + 1
        costs = np.where(np.isfinite(costs), costs, np.inf)
        # Outside the box a point costs by its distance, so that the mean comes back.
        ranked = np.argsort(costs * (1 + ((points - inside) ** 2).sum(axis=1)), kind="stable")[:parents]
        if costs[ranked[0]] < least:
            best, least = inside[ranked[0]], float(costs[ranked[0]])
        old, mean = mean, weights @ points[ranked]
        step = (mean - old) / sigma
        path_sigma = (1 - c_sigma) * path_sigma + np.sqrt(c_sigma * (2 - c_sigma) * mass) * (axes @ ((axes.T @ step) / roots))
        length = np.linalg.norm(path_sigma)
        on = length / np.sqrt(1 - (1 - c_sigma) ** (2 * generation)) < (1.4 + 2 / (n + 1)) * usual
        path = (1 - c_path) * path + on * np.sqrt(c_path * (2 - c_path) * mass) * step
        spread = (points[ranked] - old) / sigma
        covariance = (1 - c_one - c_many) * covariance + c_one * np.outer(path, path) + c_many * (weights[:, None] * spread).T @ spread
        sigma = min(sigma * float(np.exp(c_sigma / brake * (length / usual - 1))), 1.0)
        recent = [*recent, float(costs[ranked[0]])][-(10 + 30 * n // population) :]
        if sigma * roots.max() < tolerance or len(recent) >= 10 + 30 * n // population and max(recent) - min(recent) <= 1e-12 * max(abs(least), 1e-300):
            break
    return best, least, used, sigma**2 * covariance


def restarted(cost: Callable[[np.ndarray], np.ndarray], start: np.ndarray, lower: np.ndarray, upper: np.ndarray, budget: int = 4000, restarts: int = 9, population: int | None = None, sigma: float = 0.3, seed: int = 42) -> Evolved:
    """Evolution from ``start``, then restarts from random points: some with a population that doubles, some with a small one and a random spread.

    Of the two kinds, the one that has spent fewer evaluations goes next.
    ``cost`` takes the rows of a generation. Parameters with equal bounds are held.
    """
    rng = np.random.default_rng(seed)
    free = np.flatnonzero(upper > lower)
    base = np.clip(np.asarray(start, float), lower, upper)
    width = (upper - lower)[free]
    small = population or population_of(len(free), scale_ratio(lower, upper))

    def full(x: np.ndarray) -> np.ndarray:
        out = np.tile(base, (len(x), 1))
        out[:, free] = lower[free] + x * width
        return out

    best = ((base[free] - lower[free]) / width, np.inf, np.eye(len(free)))
    runs: list[tuple[str, int, int, float]] = []
    spent = {"large": 0, "small": 0}
    doubled = 0
    for run in range(restarts + 1):
        left = budget - sum(r[2] for r in runs)
        if run == 0:
            kind, size, spread, mean = "first", small, sigma, best[0]
        else:
            kind = "small" if spent["small"] < spent["large"] else "large"
            mean = rng.random(len(free))
            if kind == "large":
                doubled += 1
                size, spread = small * 2**doubled, sigma
            else:
                size, spread = max(4, int(small * (0.5 * 2**doubled) ** (rng.random() ** 2))), sigma * 10 ** (-2 * rng.random())
        if left < size:
            break
        share = left if kind != "small" else min(left, max(size, spent["large"] // 2))
        x, least, used, covariance = evolve(lambda x: cost(full(x)), mean, spread, size, rng, share)
        runs.append((kind, size, used, least))
        if kind in spent:
            spent[kind] += used
        if least < best[1]:
            best = (x, least, covariance)
    covariance = np.zeros((len(base), len(base)))
    covariance[np.ix_(free, free)] = best[2] * np.outer(width, width)
    return Evolved(full(best[0][None, :])[0], best[1], sum(r[2] for r in runs), covariance, runs)


def bipop(cells: DataFrame, model, start: np.ndarray, lower: np.ndarray, upper: np.ndarray, **options) -> Evolved:
    """``restarted`` by chi-squared over cells: a generation's vectors are evaluated over all cells in one job."""
    cells = cells.persist()
    try:
        return restarted(lambda vectors: chi_squared_of(cells, model, vectors), start, lower, upper, **options)
    finally:
        cells.unpersist()
