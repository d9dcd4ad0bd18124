"""Bounded Levenberg-Marquardt over cells that stay distributed.

Each iteration is one job: every task folds its cells into J^T J, J^T r and
chi-squared (p * p doubles, whatever the number of cells), Spark merges those
in a tree, the driver solves p equations. Parameters travel in the closure, so
the plan is the same in every iteration.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 64


@dataclass
class FitResult:
    parameters: np.ndarray
    uncertainties: np.ndarray
    covariance: np.ndarray
    chi_squared: float
    n: int
    iterations: int
    converged: bool
    history: list[float] = field(default_factory=list)
    #: converged, no_step (every trial was refused), max_iterations or not_finite.
    status: str = ""
    #: Of a fit from several starts: groups of starts that end alike; more than one means that the data don't decide.
    basins: list[list[int]] = field(default_factory=list)

    @property
    def reduced_chi_squared(self) -> float:
        return self.chi_squared / max(self.n - len(self.parameters), 1)


LOSSES = ("linear", "soft_l1")


def accumulate(cells: DataFrame, model, p: np.ndarray, jacobian: bool = True, loss: str = "linear") -> tuple[np.ndarray, np.ndarray, float, int]:
    """(J^T J, J^T r, cost, n) with r = (data - model) / sigma, over (angle_idx, i, j, c2, sigma).

    The cost is the sum of r**2 or, for ``soft_l1``, of 2 * (sqrt(1 + r**2) - 1), of which residuals are weighted
    by the root of its derivative.
    """
    if loss not in LOSSES:
        raise ValueError(f"no such loss: {loss}")
    size = len(p)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size * size + size + 2)
        for batch in batches:
            a, i, j = (batch.column(k).to_numpy() for k in range(3))
            y, s = batch.column(3).to_numpy(), batch.column(4).to_numpy()
            w = np.where(s > 0, 1.0 / np.where(s > 0, s, 1.0), 0.0)
            value, jac = model.evaluate(p, a, i, j, jacobian)
            r = (y - value) * w
            total[-1] += len(r)
            if loss == "linear":
                total[-2] += r @ r
            else:
                root = np.sqrt(1 + r * r)
                total[-2] += (2 * (root - 1)).sum()
                w, r = w / np.sqrt(root), r / np.sqrt(root)
            if jacobian:
                jac *= w[:, None]
                total[: size * size] += (jac.T @ jac).ravel()
                total[size * size : -2] += jac.T @ r
        from pyspark import TaskContext

        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % SALTS], pa.int32()), pa.array([total.tolist()], pa.list_(pa.float64()))], ["salt", "sums"])

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"salt": rows["salt"].iloc[:1], "sums": [np.sum([np.array(x, float) for x in rows["sums"]], axis=0)]})

    partial = cells.select("angle_idx", "i", "j", "c2", "sigma").mapInArrow(fold, "salt int, sums array<double>")
    merged = partial.groupBy("salt").applyInPandas(merge, "salt int, sums array<double>").collect()  # SALTS rows at most
    total = np.sum([np.array(r["sums"], float) for r in sorted(merged, key=lambda r: r["salt"])], axis=0) if merged else np.zeros(size * size + size + 2)
    return total[: size * size].reshape(size, size), total[size * size : -2], float(total[-2]), int(total[-1])


def levenberg_marquardt(cells: DataFrame, model, start: np.ndarray, lower: np.ndarray, upper: np.ndarray, max_iterations: int = 50, damping: float = 0.01, tolerance: float = 1e-6, loss: str = "linear", penalty: Callable[[np.ndarray], tuple] | None = None) -> FitResult:
    """Steps are clipped to the bounds and kept only if the cost falls.

    Converged is what moves and falls by less than the tolerance, or can't: where no step is accepted, the
    reduction that the linear model promises must be below the tolerance too. ``penalty`` gives (J^T J, J^T r,
    cost) of what the driver adds to the merged sums.
    """
    p = np.clip(np.asarray(start, float), lower, upper)

    def summed(p: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, int]:
        jtj, jtr, cost, n = accumulate(cells, model, p, loss=loss)
        if penalty is not None:
            more = penalty(p)
            jtj, jtr, cost = jtj + more[0], jtr + more[1], cost + more[2]
        return jtj, jtr, cost, n

    cells = cells.persist()
    try:
        jtj, jtr, chi2, n = summed(p)
        history, status, k = [chi2], "max_iterations", 0
        for k in range(1, max_iterations + 1):
            if not np.isfinite(chi2):
                status = "not_finite"
                break
            accepted = False
            for _ in range(10):
                free = (lower < upper) & ~((p <= lower) & (jtr < 0)) & ~((p >= upper) & (jtr > 0))
                step = np.zeros_like(p)
                left = (jtj + damping * np.diag(np.maximum(np.diag(jtj), 1e-300)))[np.ix_(free, free)]
                scale = 1 / np.sqrt(np.maximum(np.diag(left), 1e-300))
                step[free] = scale * np.linalg.lstsq(left * np.outer(scale, scale), jtr[free] * scale, rcond=1e-12)[0]
                trial = np.clip(p + step, lower, upper)
                now = summed(trial)
                if np.isfinite(now[2]) and now[2] < chi2:
                    accepted = True
                    break
                damping *= 10
            if not accepted:
                g, h = jtr[free], jtj[np.ix_(free, free)]
                promised = float(g @ np.linalg.lstsq(h, g, rcond=1e-12)[0]) if np.isfinite(h).all() else np.inf
                status = "converged" if promised <= tolerance * chi2 or chi2 < 1e-16 * n else "no_step"
                break
            moved = np.max(np.abs(trial - p) / np.maximum(np.abs(p), 1e-8))
            fell = (chi2 - now[2]) / max(chi2, 1e-300)
            p, (jtj, jtr, chi2, n) = trial, now
            history.append(chi2)
            damping = max(damping * 0.1, 1e-7)
            if moved < tolerance and fell < tolerance or chi2 < 1e-25 * n:
                status = "converged"
                break
        free = lower < upper
        covariance = np.zeros_like(jtj)
        s2 = chi2 / max(n - int(free.sum()), 1)
        covariance[np.ix_(free, free)] = s2 * np.linalg.pinv(jtj[np.ix_(free, free)])
        return FitResult(p, np.sqrt(np.maximum(np.diag(covariance), 0)), covariance, chi2, n, k, status == "converged", history, status)
    finally:
        cells.unpersist()


def latin_hypercube(n: int, lower: np.ndarray, upper: np.ndarray, seed: int = 42) -> np.ndarray:
    rng = np.random.default_rng(seed)
    u = np.stack([(rng.permutation(n) + rng.random(n)) / n for _ in lower], axis=1)
    return lower + u * (upper - lower)


def centre_distance(starts: np.ndarray, lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """Screening cost: normalised distance to the middle of the box; a start on the boundary costs 1e20."""
    width = np.where(upper > lower, upper - lower, 1.0)
    cost = np.sqrt((((starts - (lower + upper) / 2) / width) ** 2).sum(axis=1))
    return np.where(((starts <= lower) | (starts >= upper)).any(axis=1), 1e20, cost)


def chi_squared_of(cells: DataFrame, model, candidates: np.ndarray, loss: str = "linear") -> np.ndarray:
    """The cost of many parameter vectors in one job: a generation of a population, or all starts."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(candidates))
        for batch in batches:
            a, i, j = (batch.column(k).to_numpy() for k in range(3))
            y, s = batch.column(3).to_numpy(), batch.column(4).to_numpy()
            w = np.where(s > 0, 1.0 / np.where(s > 0, s, 1.0), 0.0)
            for k, p in enumerate(candidates):
                r = (y - model.evaluate(p, a, i, j, False)[0]) * w
                total[k] += r @ r if loss == "linear" else (2 * (np.sqrt(1 + r * r) - 1)).sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(candidates)), pa.int32()), pa.array(total)], ["k", "chi2"])

    rows = cells.select("angle_idx", "i", "j", "c2", "sigma").mapInArrow(fold, "k int, chi2 double").groupBy("k").agg(F.sum("chi2").alias("chi2")).collect()
    out = np.zeros(len(candidates))
    for r in rows:
        out[r["k"]] = r["chi2"]
    return out


def multistart(cells: DataFrame, model, lower: np.ndarray, upper: np.ndarray, n_starts: int = 10, seed: int = 42, custom: np.ndarray | None = None, keep: int | None = None, **options) -> tuple[FitResult, list[list[int]]]:
    """Latin-hypercube starts, screened, evaluated in one job; all of them (or the best ``keep``) fitted in full, with ``options`` of the fit. (best fit, basins of start numbers)."""
    starts = latin_hypercube(n_starts, lower, upper, seed)
    starts = starts[np.argsort(centre_distance(starts, lower, upper), kind="stable")[: max(3, n_starts // 2)]]
    if custom is not None:
        starts = np.concatenate([custom[((custom >= lower) & (custom <= upper)).all(axis=1)], starts])
    order = np.argsort(chi_squared_of(cells, model, starts, options.get("loss", "linear")), kind="stable")[:keep]
    fits = [levenberg_marquardt(cells, model, starts[k], lower, upper, **options) for k in order]
    return min(fits, key=lambda f: f.chi_squared), basins(fits)


def basins(fits: list[FitResult], gap: float = 0.1, distance: float = 0.2) -> list[list[int]]:
    """Degeneracy: fits nearly as good as the best, grouped by distance to each group's first."""
    best = min(f.chi_squared for f in fits)
    groups: list[list[int]] = []
    for k in sorted(range(len(fits)), key=lambda k: (fits[k].chi_squared, k)):
        if fits[k].chi_squared > best * (1 + gap):
            continue
        p = fits[k].parameters
        for g in groups:
            first = fits[g[0]].parameters
            if np.linalg.norm(p - first) / max(np.linalg.norm(first), 1e-12) < distance:
                g.append(k)
                break
        else:
            groups.append([k])
    return groups


def keep_better(warm: FitResult, candidate: FitResult) -> FitResult:
    """The candidate only if it is finite and no worse."""
    return candidate if np.isfinite(candidate.chi_squared) and candidate.chi_squared <= warm.chi_squared * (1 + 1e-12) else warm


def jacobian_statistics(jtj: np.ndarray, gradient: np.ndarray | None = None, gradient_square: np.ndarray | None = None, n: int = 0) -> dict:
    """Column norms and condition of the Jacobian; with sums over the n cells of each cell's gradient and its square, the mean's noise as well.

    Sensitivity is a column's root mean square; noise the standard error of the mean gradient over the mean gradient.
    """
    values = np.linalg.eigvalsh(jtj)
    more = {}
    if gradient is not None and gradient_square is not None and n > 1:
        mean = gradient / n
        error = np.sqrt(np.maximum(gradient_square / n - mean * mean, 0) / n)
        more = {"sensitivity": np.sqrt(np.maximum(np.diag(jtj), 0) / n), "noise": error / np.maximum(np.abs(mean), 1e-300)}
    return more | {"column_norms": np.sqrt(np.maximum(np.diag(jtj), 0)), "condition": float(np.sqrt(values.max() / values.min())) if values.min() > 0 else float("inf")}
