"""Checks of physical factors, fits and their inputs; the two-component model with only some of its parameters."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

from .parameters import REGISTRY, TWO_COMPONENT
from .solve import FitResult


@dataclass(frozen=True)
class Factors:
    """What every evaluation multiplies by: q**2 * dt / 2 of the diffusion, q * L * dt / (2 pi) of the shear."""

    diffusion: float
    shear: float


def factors(q: float, length: float, dt: float) -> Factors:
    """The factors of one wavevector; raises ValueError where an input isn't positive and finite."""
    for name, x in (("q", q), ("length", length), ("dt", dt)):
        if not (math.isfinite(x) and x > 0):
            raise ValueError(f"{name} = {x} isn't positive")
    return Factors(0.5 * q * q * dt, q * length * dt / (2 * math.pi))


def fit_issues(fit: FitResult, lower: np.ndarray, upper: np.ndarray) -> list[tuple[str, str]]:
    """(severity, message) of what is wrong with a fit; nothing for a sound one."""
    out = []
    p, free = fit.parameters, lower < upper
    if not (np.isfinite(p).all() and math.isfinite(fit.chi_squared)):
        out.append(("error", "parameters or chi-squared aren't finite"))
    if ((p < lower) | (p > upper)).any():
        out.append(("error", "a parameter lies beyond its bounds"))
    at = free & ((p <= lower) | (p >= upper))
    out += [("warning", f"parameter {k} lies on a bound") for k in np.flatnonzero(at).tolist()]
    c = fit.covariance
    if c.shape != (len(p), len(p)):
        out.append(("error", "the covariance has another size"))
    elif not np.isfinite(c).all() or not np.allclose(c, c.T, rtol=1e-6, atol=1e-300):
        out.append(("error", "the covariance isn't finite and symmetric"))
    elif (np.diag(c)[free] <= 0).any():
        out.append(("warning", "a free parameter has no uncertainty"))
    if fit.n <= int(free.sum()):
        out.append(("error", "no more cells than parameters"))
    if not fit.converged:
        out.append(("warning", f"not converged: {fit.status}"))
    return out


class Reduced:
    """A two-component model of which only some parameters are fitted; the others keep their defaults or given values."""

    def __init__(self, model, active: tuple[str, ...], held: dict[str, float] | None = None):
        unknown = [n for n in (*active, *(held or {})) if n not in TWO_COMPONENT]
        if unknown:
            raise ValueError(f"no such parameters: {', '.join(unknown)}")
        self.model, self.names = model, tuple(active)
        self.values = np.array([(held or {}).get(n, REGISTRY[n].default) for n in TWO_COMPONENT])
        self.places = np.array([TWO_COMPONENT.index(n) for n in active], int)
        self.n_scaling = model.n_scaling

    def expand(self, p: np.ndarray) -> np.ndarray:
        k = 2 * self.n_scaling
        full = self.values.copy()
        full[self.places] = p[k:]
        return np.concatenate([p[:k], full])

    def evaluate(self, p, a, i, j, jacobian=True):
        value, jac = self.model.evaluate(self.expand(p), a, i, j, jacobian)
        if jac is None:
            return value, None
        k = 2 * self.n_scaling
        return value, np.concatenate([jac[:, :k], jac[:, k + self.places]], axis=1)


def gradient_and_hessian(cells, model, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of chi-squared by the parameters: -2 J^T r, and the Gauss-Newton Hessian 2 J^T J, from one aggregation."""
    from .solve import accumulate

    jtj, jtr, _, _ = accumulate(cells, model, p)
    return -2 * jtr, 2 * jtj
