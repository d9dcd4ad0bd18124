"""Watches the gradients of a fit for scaling that takes over what the physics should explain."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from .stratified import _places


class Collapsed(RuntimeError):
    """The physics gradient stayed far below that of the scaling."""


@dataclass
class GradientMonitor:
    """Called with a step's sums by angle and the vector; raises ``Collapsed`` after ``patience`` steps in a row below ``threshold``.

    Gradients are per relative change of a parameter, so that units don't
    matter. The ratio is the physics' root mean square over the scaling's. A
    step whose scaling gradient is itself ``settled`` doesn't count: near the
    optimum both vanish.
    """

    physics: int
    threshold: float = 1e-3
    patience: int = 3
    settled: float = 1e-8
    ratios: list[float] = field(default_factory=list)
    noise: list[np.ndarray] = field(default_factory=list)
    run: int = 0

    def __call__(self, sums: np.ndarray, vector: np.ndarray) -> None:
        at, n_angles = _places(self.physics), len(sums)
        cost, n = float(sums[:, at["cost"]].sum()), float(sums[:, at["n"]].sum())
        scaling = sums[:, at["scaling_gradient"]].T.ravel() * vector[: 2 * n_angles]
        gradient, square = sums[:, at["gradient"]].sum(axis=0), sums[:, at["gradient_square"]].sum(axis=0)
        own = gradient * vector[2 * n_angles :]
        self.noise.append(np.sqrt(np.maximum(square - gradient**2 / max(n, 1), 0)) / np.maximum(np.abs(gradient), 1e-300))
        ratio = float(np.sqrt(np.mean(own**2)) / max(np.sqrt(np.mean(scaling**2)), 1e-300))
        self.ratios.append(ratio)
        busy = np.max(np.abs(scaling), initial=0.0) > self.settled * max(cost, 1e-300)
        self.run = self.run + 1 if busy and ratio < self.threshold else 0
        if self.run >= self.patience:
            raise Collapsed(f"physics gradients at {ratio:.1e} of the scaling's for {self.run} steps")
