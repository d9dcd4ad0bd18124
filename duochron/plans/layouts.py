"""Scaling layouts, regularisation and reparametrisation that keep per-angle scaling from absorbing the physics."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .solve import FitResult, accumulate, levenberg_marquardt


class ScalingMap:
    """A linear map from few scaling coefficients to a contrast and offset per angle.

    ``individual`` has one of each per angle, ``averaged`` one for all,
    ``fourier`` 1 + 2 * order cosines and sines of the angle. Physics pass through.
    """

    def __init__(self, layout: str, phi: np.ndarray, order: int = 2):
        n = len(phi)
        if layout == "individual":
            basis = np.eye(n)
        elif layout == "averaged":
            basis = np.ones((n, 1))
        elif layout == "fourier":
            r = np.radians(phi)
            basis = np.stack([np.ones(n)] + [f(k * r) for k in range(1, order + 1) for f in (np.cos, np.sin)], axis=1)
        else:
            raise ValueError(f"no such layout: {layout}")
        self.basis, self.n = basis, n

    def forward(self, p: np.ndarray) -> np.ndarray:
        k = self.basis.shape[1]
        return np.concatenate([self.basis @ p[:k], self.basis @ p[k : 2 * k], p[2 * k :]])

    def inverse(self, full: np.ndarray) -> np.ndarray:
        """The coefficients nearest to given per-angle values."""
        fit = [np.linalg.lstsq(self.basis, x, rcond=None)[0] for x in (full[: self.n], full[self.n : 2 * self.n])]
        return np.concatenate([*fit, full[2 * self.n :]])

    def matrix(self, p: np.ndarray) -> np.ndarray:
        k = self.basis.shape[1]
        physics = len(p) - 2 * k
        out = np.zeros((2 * self.n + physics, len(p)))
        out[: self.n, :k] = out[self.n : 2 * self.n, k : 2 * k] = self.basis
        out[2 * self.n :, 2 * k :] = np.eye(physics)
        return out

    def bounds(self, lower: np.ndarray, upper: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The mean keeps the bounds of the scaling; waves may take half their width either way."""
        n, waves = self.n, self.basis.shape[1] - 1
        reach = (upper - lower) / 2
        ends = [np.concatenate([e[:1], s * reach[:1].repeat(waves), e[n : n + 1], s * reach[n : n + 1].repeat(waves), e[2 * n :]]) for e, s in ((lower, -1), (upper, 1))]
        return ends[0], ends[1]


class Log:
    """Positive parameters as logarithms: the vector's ``positions`` are exponentiated for the model."""

    def __init__(self, positions: list[int]):
        self.positions = positions

    def forward(self, p: np.ndarray) -> np.ndarray:
        out = p.copy()
        out[self.positions] = np.exp(p[self.positions])
        return out

    def inverse(self, p: np.ndarray) -> np.ndarray:
        """A value that isn't positive becomes the least one there is."""
        out = p.copy()
        out[self.positions] = np.log(np.maximum(p[self.positions], 1e-300))
        return out

    def matrix(self, p: np.ndarray) -> np.ndarray:
        slope = np.ones(len(p))
        slope[self.positions] = np.exp(p[self.positions])
        return np.diag(slope)

    def bounds(self, lower: np.ndarray, upper: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.inverse(lower), self.inverse(upper)


class Shift:
    """A power measured from a reference: the vector's ``position`` is the model's parameter less ``reference``."""

    def __init__(self, position: int, reference: float):
        self.position, self.reference = position, reference

    def forward(self, p: np.ndarray) -> np.ndarray:
        out = p.copy()
        out[self.position] += self.reference
        return out

    def inverse(self, p: np.ndarray) -> np.ndarray:
        out = p.copy()
        out[self.position] -= self.reference
        return out

    def matrix(self, p: np.ndarray) -> np.ndarray:
        return np.eye(len(p))

    def bounds(self, lower: np.ndarray, upper: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.inverse(lower), self.inverse(upper)


class Stack:
    """A model seen through steps that turn the fit's vector into the model's, the first step first; derivatives by the chain rule."""

    def __init__(self, model, steps: list):
        self.model, self.steps, self.names = model, steps, model.names

    def to_model(self, p: np.ndarray) -> np.ndarray:
        for s in self.steps:
            p = s.forward(p)
        return p

    def to_fit(self, p: np.ndarray) -> np.ndarray:
        for s in self.steps[::-1]:
            p = s.inverse(p)
        return p

    def matrix(self, p: np.ndarray) -> np.ndarray:
        """Derivatives of the model's vector by the fit's."""
        out = np.eye(len(p))
        for s in self.steps:
            out, p = s.matrix(p) @ out, s.forward(p)
        return out

    def bounds(self, lower: np.ndarray, upper: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        for s in self.steps[::-1]:
            lower, upper = s.bounds(lower, upper)
        return lower, upper

    def evaluate(self, p, a, i, j, jacobian=True):
        value, jac = self.model.evaluate(self.to_model(p), a, i, j, jacobian)
        return value, None if jac is None else jac @ self.matrix(p)

    def back(self, fit: FitResult) -> FitResult:
        """The fit in the model's own parameters."""
        turn = self.matrix(fit.parameters)
        covariance = turn @ fit.covariance @ turn.T
        return replace(fit, parameters=self.to_model(fit.parameters), covariance=covariance, uncertainties=np.sqrt(np.maximum(np.diag(covariance), 0)))


def variation_penalty(values: np.ndarray, strength: float) -> tuple[np.ndarray, np.ndarray, float]:
    """(J^T J, J^T r, r**2) of the residual sqrt(strength) * std / |mean| of a group of parameters; added on the driver after the merge."""
    n, mean, std = len(values), values.mean(), values.std()
    scale = abs(mean) if abs(mean) > 1e-10 else 1.0
    r = -np.sqrt(strength) * std / scale
    d = np.zeros(n)
    if std > 0:
        d = (values - mean) / (n * std) / scale
        if abs(mean) > 1e-10:
            d = d - std * np.sign(mean) / (n * mean * mean)
    j = np.sqrt(strength) * d
    return np.outer(j, j), j * r, float(r * r)


def hierarchical(cells: DataFrame, model, start: np.ndarray, lower: np.ndarray, upper: np.ndarray, n_scaling: int, rounds: int = 5, tolerance: float = 1e-6) -> FitResult:
    """Alternate between physics and scaling, each fitted with the other held, until chi-squared settles."""
    p, best = np.clip(start, lower, upper), None
    for _ in range(rounds):
        before = np.inf if best is None else best.chi_squared
        for physics in (True, False):
            lo, hi = lower.copy(), upper.copy()
            held = slice(0, 2 * n_scaling) if physics else slice(2 * n_scaling, None)
            lo[held] = hi[held] = p[held]
            best = levenberg_marquardt(cells, model, p, lo, hi, 15)
            p = best.parameters
        if before - best.chi_squared <= tolerance * before:
            break
    return best


#: Ways to try a fit again, in this order.
RECOVERIES = ("perturbed", "shrunk", "relaxed")


def recover(cells: DataFrame, model, failed: FitResult, lower: np.ndarray, upper: np.ndarray, tries: int = 3, seed: int = 42, **options) -> FitResult:
    """Fit again: from slightly perturbed starts, in a box of half the width about the best so far, at last with a tolerance a hundred times as large.

    The best result stays, and counts as converged only if it did so itself.
    ``options`` are those of the first fit, so that costs are of one kind.
    """
    rng = np.random.default_rng(seed)
    options = {"max_iterations": 100, **options}
    best = failed
    for way in [RECOVERIES[0]] * tries + list(RECOVERIES[1:]):
        if best.converged and np.isfinite(best.chi_squared):
            break
        start, low, high, own = best.parameters, lower, upper, dict(options)
        if way == "perturbed":
            start = start * (1 + 0.05 * rng.uniform(-1, 1, len(start)))
        elif way == "shrunk":
            quarter = (upper - lower) / 4
            low, high = np.maximum(lower, start - quarter), np.minimum(upper, start + quarter)
        else:
            own["tolerance"] = 100 * own.get("tolerance", 1e-6)
        again = levenberg_marquardt(cells, model, start, low, high, **own)
        if np.isfinite(again.chi_squared) and (again.chi_squared <= best.chi_squared or not np.isfinite(best.chi_squared)):
            best = again
    return best


def gradient_ratio(cells: DataFrame, model, p: np.ndarray, n_scaling: int) -> float:
    """Norm of the physics gradient over that of the scaling's: near 0 the scaling absorbs the physics."""
    g = accumulate(cells, model, p)[1]
    scaling = np.linalg.norm(g[: 2 * n_scaling])
    return float(np.linalg.norm(g[2 * n_scaling :]) / max(scaling, 1e-300))


def shear_weighted(cells: DataFrame, angles: DataFrame, phi0: float, least: float = 0.3, exponent: float = 1.0) -> DataFrame:
    """Cells with sigma scaled so that angles along the flow weigh more; the weights' mean is 1."""
    from ..functions.scalars import shear_weight

    w = angles.select("angle_idx", shear_weight(F.col("phi"), phi0, least, exponent).alias("w"))
    w = w.crossJoin(F.broadcast(w.agg(F.avg("w").alias("mean")))).select("angle_idx", (F.col("w") / F.col("mean")).alias("w"))
    return cells.join(F.broadcast(w), "angle_idx").withColumn("sigma", F.col("sigma") / F.sqrt("w")).drop("w")
