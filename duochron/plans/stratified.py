"""Fits whose scaling is per angle, from sums that are kept per angle.

A task folds its cells into one short record an angle (scaling and physics of
that angle only), and Spark adds the records of an angle. So the work and what
travels grow with the number of angles and the square of the physics
parameters, never with the square of all parameters. Two fits are built on it:

``trust_region``  physics shared by all angles. The normal matrix is an arrow:
                  a 2x2 block an angle, their coupling to the physics, and the
                  physics block. The driver eliminates the small blocks.
``lockstep``      every angle has its own physics. All angles advance together,
                  one job a step, each with its own damping.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .solve import LOSSES, SALTS, FitResult


def _places(p: int) -> dict[str, slice]:
    """Where an angle's record of ``p`` physics parameters has its sums."""
    sizes = {"scaling": 4, "coupling": 2 * p, "physics": p * p, "scaling_gradient": 2, "gradient": p, "cost": 1, "n": 1, "gradient_square": p}
    ends = np.cumsum(list(sizes.values()))
    return {k: slice(int(e - n), int(e)) for (k, n), e in zip(sizes.items(), ends)}


def angle_sums(cells: DataFrame, model, contrast: np.ndarray, offset: np.ndarray, physics: np.ndarray, loss: str = "linear", jacobian: bool = True, only: np.ndarray | None = None) -> np.ndarray:
    """(angles, record): sums over (angle_idx, i, j, c2, sigma) at the given scaling of each angle and physics (shared, or a row an angle).

    ``model`` has shared scaling; it is evaluated with contrast 1 and offset 0. ``only`` leaves out other angles' cells.
    The residual is (data - model) / sigma; gradients are of J^T r, Jacobians those of the model.
    """
    if loss not in LOSSES:
        raise ValueError(f"no such loss: {loss}")
    p = physics.shape[-1]
    at, width = _places(p), _places(p)["gradient_square"].stop
    taken = None if only is None else np.isin(np.arange(len(contrast)), only)

    def add(record: np.ndarray, which: int, a: np.ndarray, i: np.ndarray, j: np.ndarray, y: np.ndarray, s: np.ndarray, v: np.ndarray) -> None:
        shape, jac = model.evaluate(np.concatenate([[1.0, 0.0], v]), a, i, j, jacobian)
        w = np.where(s > 0, 1.0 / np.where(s > 0, s, 1.0), 0.0)
        r = (y - offset[which] - contrast[which] * shape) * w
        record[at["n"]] += len(r)
        if loss == "linear":
            record[at["cost"]] += r @ r
        else:
            root = np.sqrt(1 + r * r)
            record[at["cost"]] += (2 * (root - 1)).sum()
            w, r = w / np.sqrt(root), r / np.sqrt(root)
        if jacobian:
            scaling = np.stack([shape * w, w], axis=1)
            slopes = contrast[which] * jac[:, 2:] * w[:, None]
            record[at["scaling"]] += (scaling.T @ scaling).ravel()
            record[at["coupling"]] += (scaling.T @ slopes).ravel()
            record[at["physics"]] += (slopes.T @ slopes).ravel()
            record[at["scaling_gradient"]] += scaling.T @ r
            record[at["gradient"]] += slopes.T @ r
            record[at["gradient_square"]] += (slopes * slopes).T @ (r * r)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        records: dict[int, np.ndarray] = {}
        for batch in batches:
            a, i, j, y, s = (batch.column(k).to_numpy() for k in range(5))
            for which in np.unique(a).tolist():
                if taken is None or taken[which]:
                    own = np.flatnonzero(a == which)
                    record = records.setdefault(which, np.zeros(width))
                    add(record, which, a[own], i[own], j[own], y[own], s[own], physics if physics.ndim == 1 else physics[which])
        salt = TaskContext.get().partitionId() % SALTS
        yield pa.RecordBatch.from_arrays([pa.array(list(records), pa.int32()), pa.array([salt] * len(records), pa.int32()), pa.array([x.tolist() for x in records.values()], pa.list_(pa.float64()))], ["angle_idx", "salt", "sums"])

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"angle_idx": rows["angle_idx"].iloc[:1], "salt": rows["salt"].iloc[:1], "sums": [np.sum([np.array(x, float) for x in rows["sums"]], axis=0)]})

    schema = "angle_idx int, salt int, sums array<double>"
    partial = cells.select("angle_idx", "i", "j", "c2", "sigma").mapInArrow(fold, schema)
    merged = partial.groupBy("angle_idx", "salt").applyInPandas(merge, schema).groupBy("angle_idx").applyInPandas(merge, schema)
    out = np.zeros((len(contrast), width))
    for row in merged.collect():  # one row an angle
        out[row["angle_idx"]] = row["sums"]
    return out


@dataclass
class Arrow:
    """A normal matrix of per-angle scaling and shared physics: blocks (angles, 2, 2), coupling (angles, 2, p), physics (p, p)."""

    blocks: np.ndarray
    coupling: np.ndarray
    physics: np.ndarray

    @classmethod
    def of(cls, sums: np.ndarray, p: int) -> Arrow:
        at = _places(p)
        return cls(sums[:, at["scaling"]].reshape(-1, 2, 2), sums[:, at["coupling"]].reshape(-1, 2, p), sums[:, at["physics"]].sum(axis=0).reshape(p, p))

    def scaled(self, scaling: np.ndarray, physics: np.ndarray) -> Arrow:
        """With rows and columns multiplied by (angles, 2) and (p,) factors."""
        return Arrow(self.blocks * scaling[:, :, None] * scaling[:, None, :], self.coupling * scaling[:, :, None] * physics, self.physics * np.outer(physics, physics))

    def shifted(self, scaling: np.ndarray, physics: np.ndarray) -> Arrow:
        """With more on the diagonal."""
        return Arrow(self.blocks + scaling[:, :, None] * np.eye(2), self.coupling, self.physics + np.diag(physics))

    def times(self, s: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.einsum("akl,al->ak", self.blocks, s) + self.coupling @ v, np.einsum("akp,ak->p", self.coupling, s) + self.physics @ v

    def _reduced(self) -> tuple[np.ndarray, np.ndarray]:
        inverse = np.linalg.pinv(self.blocks, hermitian=True)
        return inverse, self.physics - np.einsum("akp,akl,alq->pq", self.coupling, inverse, self.coupling)

    def solve(self, s: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The solution for right sides (angles, 2) and (p,): the angles' blocks go first."""
        inverse, schur = self._reduced()
        right = v - np.einsum("akp,akl,al->p", self.coupling, inverse, s)
        physics = np.linalg.lstsq(schur, right, rcond=1e-14)[0]
        return np.einsum("akl,al->ak", inverse, s - self.coupling @ physics), physics

    def inverse_diagonal(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(diagonal of the inverse for the scaling, that for the physics, the physics block of the inverse)."""
        inverse, schur = self._reduced()
        block = np.linalg.pinv(schur, hermitian=True)
        through = inverse @ self.coupling
        return np.einsum("akk->ak", inverse) + np.einsum("akp,pq,akq->ak", through, block, through), np.diag(block), block


def _to_bound(x: np.ndarray, step: np.ndarray, lower: np.ndarray, upper: np.ndarray) -> float:
    """How often the step fits until a bound is met."""
    with np.errstate(divide="ignore", invalid="ignore"):
        room = np.where(step > 0, (upper - x) / step, np.where(step < 0, (lower - x) / step, np.inf))
    return float(np.min(room, initial=np.inf))


def trust_region(cells: DataFrame, model, start: np.ndarray, lower: np.ndarray, upper: np.ndarray, max_iterations: int = 100, tolerance: float = 1e-9, loss: str = "linear", on_step=None) -> FitResult:
    """Bounded least squares of contrast and offset per angle and shared physics, as one vector (contrasts, offsets, physics).

    Coleman-Li scaling by the distance to the bound that a variable moves to;
    inside a ball of scaled variables the arrow is solved for the damping that
    keeps the step in it; a step that meets a bound is cut just before it, and
    the steepest scaled descent is taken where it promises more. Parameters with
    equal bounds are held. The covariance is that of the physics; uncertainties
    cover all parameters. ``on_step(record sums, vector)`` may watch the fit.
    """
    n_angles = (len(start) - len(model.names)) // 2
    p = len(model.names)
    at = _places(p)
    free = lower < upper
    low, high = np.where(free, lower, -np.inf), np.where(free, upper, np.inf)
    x = np.clip(np.asarray(start, float), lower, upper)
    margin = 1e-10 * np.maximum(1.0, np.abs(x))
    x = np.where(free, np.clip(x, np.minimum(low + margin, (lower + upper) / 2), np.maximum(high - margin, (lower + upper) / 2)), x)

    def parts(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return v[: 2 * n_angles].reshape(2, n_angles).T, v[2 * n_angles :]

    def whole(s: np.ndarray, v: np.ndarray) -> np.ndarray:
        return np.concatenate([s.T.ravel(), v])

    def summed(v: np.ndarray) -> tuple[np.ndarray, Arrow, np.ndarray, float, int]:
        sums = angle_sums(cells, model, v[:n_angles], v[n_angles : 2 * n_angles], v[2 * n_angles :], loss)
        gradient = whole(sums[:, at["scaling_gradient"]], sums[:, at["gradient"]].sum(axis=0))
        return sums, Arrow.of(sums, p), gradient, float(sums[:, at["cost"]].sum()), int(sums[:, at["n"]].sum())

    cells = cells.persist()
    try:
        sums, arrow, gradient, cost, n = summed(x)
        history, status, radius, k = [cost], "max_iterations", None, 0
        for k in range(1, max_iterations + 1):
            if not np.isfinite(cost):
                status = "not_finite"
                break
            if on_step is not None:
                on_step(sums, x)
            # The cost falls along the gradient; a variable is measured by its distance to the bound on that side.
            room = np.where(gradient > 0, high - x, x - low)
            bounded = np.isfinite(room)
            d = np.where(free, np.sqrt(np.where(bounded, room, 1.0)), 0.0)
            # Variables without a bound on their side are measured by their own curvature.
            curvature = whole(np.einsum("akk->ak", arrow.blocks), np.diag(arrow.physics))
            d = np.where(free & ~bounded, 1 / np.sqrt(np.maximum(curvature, 1e-300)), d)
            g = d * gradient
            scaled = arrow.scaled(*parts(d))
            extra = np.where(bounded & free, np.abs(gradient), 0.0)  # the scaling's own slope
            # Held variables get a unit diagonal, so that blocks stay solvable; their right side is 0.
            system = scaled.shifted(*parts(np.where(free, extra, 1.0)))
            size = np.linalg.norm(g)
            if np.max(np.abs(g), initial=0.0) <= tolerance * max(cost, 1e-300) or cost < 1e-25 * max(n, 1):
                status = "converged"
                break
            if radius is None:
                radius = max(1.0, float(np.linalg.norm(x[free] / d[free])))

            def step_of(damping: float) -> np.ndarray:
                shift = np.where(free, damping, 0.0)
                return whole(*system.shifted(*parts(shift)).solve(*parts(np.where(free, g, 0.0))))

            def promised(s: np.ndarray) -> float:
                return float(2 * (g @ s) - s @ whole(*system.times(*parts(s))))

            accepted, tried = False, None
            for _ in range(12):
                s = step_of(0.0)
                if not np.isfinite(s).all() or np.linalg.norm(s) > radius:
                    least, most = 0.0, size / radius
                    for _ in range(60):  # the damped step shrinks as the damping grows
                        mid = np.sqrt(least * most) if least > 0 else most * 1e-3
                        if np.linalg.norm(step_of(mid)) > radius:
                            least = mid
                        else:
                            most = mid
                        if least > 0 and most / least < 1.05:
                            break
                    s = step_of(most)
                inside = max(0.995, 1 - size / max(cost, 1e-300))
                s = s * min(1.0, inside * _to_bound(x, d * s, low, high))
                bend = g @ whole(*system.times(*parts(g)))
                along = g * min(size**2 / max(bend, 1e-300), radius / size)
                along = along * min(1.0, inside * _to_bound(x, d * along, low, high))
                if promised(along) > promised(s):
                    s = along
                trial = np.where(free, x + d * s, x)
                tried = summed(trial)
                gain = (cost - tried[3]) / max(promised(s) - 0.0, 1e-300) if np.isfinite(tried[3]) else -1.0
                length = np.linalg.norm(s)
                if gain < 0.25:
                    radius = 0.25 * length
                elif gain > 0.75 and length > 0.9 * radius:
                    radius = 2 * radius
                if np.isfinite(tried[3]) and tried[3] < cost:
                    accepted = True
                    break
                if radius < 1e-14 or promised(s) <= 1e-14 * cost:
                    break
            if not accepted:
                status = "converged" if promised(s) <= 1e-8 * cost else "no_step"
                break
            fell, moved = cost - tried[3], float(np.max(np.abs(trial - x) / np.maximum(np.abs(x), 1e-8)))
            x, (sums, arrow, gradient, cost, n) = trial, tried
            history.append(cost)
            if fell <= tolerance * cost and gain > 0.25 or moved <= 1e-12:
                status = "converged"
                break
        held = np.where(free, 1.0, 0.0)
        scaled = arrow.scaled(*parts(held)).shifted(*parts(1 - held))
        scaling, own, block = scaled.inverse_diagonal()
        s2 = cost / max(n - int(free.sum()), 1)
        errors = np.sqrt(np.maximum(whole(scaling, own) * held, 0) * s2)
        return FitResult(x, errors, block * s2 * np.outer(held[2 * n_angles :], held[2 * n_angles :]), cost, n, k, status == "converged", history, status)
    finally:
        cells.unpersist()


def lockstep(cells: DataFrame, model, start: np.ndarray, lower: np.ndarray, upper: np.ndarray, n_angles: int, least: int = 10, max_iterations: int = 100, tolerance: float = 1e-10, loss: str = "linear") -> list[FitResult | None]:
    """A fit of (contrast, offset, physics) for each angle on its own, all in the same jobs; None for an angle with fewer than ``least`` cells.

    A job adds up the records of all angles that still move, each at its own
    parameters. The driver then damps, steps and accepts for each apart.
    """
    p = len(model.names)
    at = _places(p)
    x = np.tile(np.clip(np.asarray(start, float), lower, upper), (n_angles, 1))
    free = lower < upper

    def summed(v: np.ndarray, only: np.ndarray) -> np.ndarray:
        return angle_sums(cells, model, v[:, 0], v[:, 1], v[:, 2:], loss, only=only)

    def normal(record: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = np.empty((p + 2, p + 2))
        h[:2, :2], h[2:, 2:] = record[at["scaling"]].reshape(2, 2), record[at["physics"]].reshape(p, p)
        h[:2, 2:] = record[at["coupling"]].reshape(2, p)
        h[2:, :2] = h[:2, 2:].T
        return h, np.concatenate([record[at["scaling_gradient"]], record[at["gradient"]]])

    cells = cells.persist()
    try:
        moving = np.arange(n_angles)
        now = summed(x, moving)
        count = now[:, at["n"]][:, 0].astype(int)
        damping, refused = np.full(n_angles, 0.01), np.zeros(n_angles, int)
        status = np.where(count >= least, "max_iterations", "too_few").astype(object)
        steps = np.zeros(n_angles, int)
        history = [[float(c)] for c in now[:, at["cost"]][:, 0]]
        moving = moving[count >= least]
        while len(moving) and steps.max() < max_iterations:
            trial = x.copy()
            for a in moving:
                h, g = normal(now[a])
                ok = free & ~((x[a] <= lower) & (g < 0)) & ~((x[a] >= upper) & (g > 0))
                left = (h + damping[a] * np.diag(np.maximum(np.diag(h), 1e-300)))[np.ix_(ok, ok)]
                scale = 1 / np.sqrt(np.maximum(np.diag(left), 1e-300))
                trial[a, ok] = np.clip(x[a, ok] + scale * np.linalg.lstsq(left * np.outer(scale, scale), g[ok] * scale, rcond=1e-14)[0], lower[ok], upper[ok])
            tried = summed(trial, moving)
            still = []
            for a in moving:
                before, after = now[a, at["cost"]][0], tried[a, at["cost"]][0]
                if np.isfinite(after) and after < before:
                    x[a], now[a], damping[a], refused[a] = trial[a], tried[a], max(damping[a] * 0.1, 1e-9), 0
                    steps[a] += 1
                    history[a].append(float(after))
                    done = before - after <= tolerance * before or after < 1e-25 * count[a]
                    if done:
                        status[a] = "converged"
                else:
                    damping[a], refused[a] = damping[a] * 10, refused[a] + 1
                    done = refused[a] >= 10 or not np.isfinite(before)
                    if done:
                        h, g = normal(now[a])
                        hopes = float(g @ np.linalg.lstsq(h, g, rcond=1e-12)[0]) if np.isfinite(h).all() else np.inf
                        status[a] = "converged" if hopes <= 1e-6 * before else "no_step"
                if not done:
                    still.append(a)
            moving = np.array(still, int)
        out: list[FitResult | None] = []
        for a in range(n_angles):
            if status[a] == "too_few":
                out.append(None)
                continue
            h, _ = normal(now[a])
            cost = float(now[a, at["cost"]][0])
            covariance = np.zeros_like(h)
            covariance[np.ix_(free, free)] = cost / max(count[a] - int(free.sum()), 1) * np.linalg.pinv(h[np.ix_(free, free)])
            out.append(FitResult(x[a], np.sqrt(np.maximum(np.diag(covariance), 0)), covariance, cost, int(count[a]), int(steps[a]), status[a] == "converged", history[a], str(status[a])))
        return out
    finally:
        cells.unpersist()


def estimates_table(spark, fits: list[FitResult | None], names: list[str]) -> DataFrame:
    """(angle_idx, param, value, variance, n_points, chi2, success) of the angles that were fitted: what ``combine_estimates`` takes."""
    rows = [(a, n, float(v), float(u) ** 2, f.n, f.chi_squared, bool(f.converged)) for a, f in enumerate(fits) if f is not None for n, v, u in zip(names, f.parameters, f.uncertainties)]
    return spark.createDataFrame(rows, "angle_idx int, param string, value double, variance double, n_points long, chi2 double, success boolean")


def sequential(cells: DataFrame, model, start: np.ndarray, lower: np.ndarray, upper: np.ndarray, n_angles: int, weighting: str = "inverse_variance", least_share: float = 0.5, **options) -> tuple[DataFrame, list[FitResult | None]]:
    """All angles in lockstep, then one estimate of each physics parameter over those that converged: (param, value, variance), and the fits.

    Raises ValueError where fewer than ``least_share`` of the angles converged.
    """
    from ..operators.aggregates import combine_estimates

    fits = lockstep(cells, model, start, lower, upper, n_angles, **options)
    good = [f if f is not None and f.converged else None for f in fits]
    if sum(f is not None for f in good) < least_share * n_angles:
        raise ValueError(f"only {sum(f is not None for f in good)} of {n_angles} angles converged")
    table = estimates_table(cells.sparkSession, good, ["contrast", "offset", *model.names])
    return combine_estimates(table.where(F.col("param").isin(list(model.names))), weighting), fits
