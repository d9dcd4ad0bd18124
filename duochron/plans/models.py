"""Models and their Jacobians over batches of cells, in NumPy, for the accumulators.

Per-frame vectors are computed once per call from the parameters (a few
thousand frames); a batch only gathers them.
"""

from __future__ import annotations

import math

import numpy as np

from .parameters import FLOW, STATIC, TWO_COMPONENT


def _integral(rate: np.ndarray, step: float = 1.0) -> np.ndarray:
    return np.concatenate([[0.0], np.cumsum((rate[1:] + rate[:-1]) / 2 * step)])


def _power(t: np.ndarray, a: float) -> np.ndarray:
    return np.where(t > 0, np.maximum(t, 1e-30) ** a, 0.0)


class Homodyne:
    """offset_a + contrast_a * g1**2 with analytic derivatives; the scaling is per angle or shared."""

    def __init__(self, t: np.ndarray, q: np.ndarray, phi: np.ndarray, dt: float, length: float = 2e6, flow: bool = False, shared_scaling: bool = False):
        self.t, self.q, self.phi, self.dt, self.length, self.flow = t, q, phi, dt, length, flow
        self.names = FLOW if flow else STATIC
        self.n_scaling = 1 if shared_scaling else len(phi)

    @property
    def size(self) -> int:
        return 2 * self.n_scaling + len(self.names)

    def _rate(self, scale: float, power: float, offset: float):
        """(integral, its derivatives by scale, power and offset); those are 0 where the floor holds."""
        t = np.maximum(self.t, max(self.dt / 2, 1e-8))
        base = t**power
        value = scale * base + offset
        free = value > 1e-10
        return _integral(np.maximum(value, 1e-10)), [_integral(np.where(free, d, 0.0)) for d in (base, scale * base * np.log(t), np.ones_like(t))]

    def evaluate(self, p: np.ndarray, a: np.ndarray, i: np.ndarray, j: np.ndarray, jacobian: bool = True):
        """(model, (cell, parameter) derivatives) at cells (a, i, j)."""
        k = self.n_scaling
        s = a if k > 1 else np.zeros_like(a)
        c, o = p[:k][s], p[k : 2 * k][s]
        phys = p[2 * k :]
        q = self.q[a]
        off = i != j

        def span(cum):
            return cum[i] - cum[j]

        cum, dcum = self._rate(*phys[:3])
        d = span(cum)
        length = np.where(off, np.sqrt(d * d + 1e-12), 0.0)
        slope = np.where(off, d / np.sqrt(d * d + 1e-12), 0.0)
        u = -0.5 * q * q * self.dt
        log_g = np.clip(u * length, -700.0, 0.0)
        g = np.exp(log_g)
        dg = [np.where((log_g > -700), g * u * slope * span(x), 0.0) for x in dcum]
        if self.flow:
            cum, dcum = self._rate(*phys[3:6])
            d = span(cum)
            length = np.where(off, np.sqrt(d * d + 1e-12), 0.0)
            slope = np.where(off, d / np.sqrt(d * d + 1e-12), 0.0)
            angle = np.radians(phys[6] - self.phi[a])
            f = q * self.length * self.dt / (2 * math.pi)
            x = f * np.cos(angle) * length
            small = np.abs(x) < 1e-4
            safe = np.where(small, 1.0, x)
            sinc = np.where(small, 1 - x * x / 6 + x**4 / 120, np.sin(safe) / safe)
            dsinc = np.where(small, -x / 3 + x**3 / 30, (np.cos(safe) - np.sin(safe) / safe) / safe)
            s2, ds = sinc * sinc, 2 * sinc * dsinc
            dg = [v * s2 for v in dg] + [g * ds * f * np.cos(angle) * slope * span(v) for v in dcum] + [g * ds * f * -np.sin(angle) * math.pi / 180 * length]
            g = g * s2
        free = g > 1e-10
        g = np.maximum(g, 1e-10)
        model = o + c * g * g
        if not jacobian:
            return model, None
        out = np.zeros((len(a), self.size))
        rows = np.arange(len(a))
        out[rows, s] = g * g
        out[rows, k + s] = 1.0
        for m, v in enumerate(dg):
            out[:, 2 * k + m] = np.where(free, 2 * c * g * v, 0.0)
        return model, out


def _soft(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smooth positive part of x and its derivative."""
    return np.logaddexp(0, 50 * x) / 50, 1 / (1 + np.exp(-np.clip(50 * x, -700, 700)))


class Heterodyne:
    """Two components, with exact derivatives: each parameter's derivative is a vector along frames, which a cell gathers."""

    def __init__(self, t: np.ndarray, q: np.ndarray, phi: np.ndarray, dt: float, shared_scaling: bool = False):
        self.t, self.q, self.phi, self.dt = t, q, phi, dt
        self.names = TWO_COMPONENT
        self.n_scaling = 1 if shared_scaling else len(phi)

    @property
    def size(self) -> int:
        return 2 * self.n_scaling + len(self.names)

    def _running(self, scale: float, power: float, offset: float, floor: bool) -> tuple[np.ndarray, list[np.ndarray]]:
        """The running integral of scale * t**power + offset and of its three derivatives; with ``floor`` negative rates count as 0."""
        base = _power(self.t, power)
        log = np.where(self.t > 0, np.log(np.maximum(self.t, 1e-30)), 0.0)
        rate = scale * base + offset
        kept = rate > 0 if floor else np.ones(len(rate), bool)
        parts = (base, scale * base * log, np.ones_like(rate))
        return _integral(np.where(kept, rate, 0.0), self.dt), [_integral(np.where(kept, d, 0.0), self.dt) for d in parts]

    def _fraction(self, f0: float, f1: float, f2: float, f3: float) -> tuple[np.ndarray, list[np.ndarray]]:
        """The sample's fraction along frames, kept in [0, 1] smoothly, and its four derivatives."""
        x = f1 * (self.t - f2)
        inside = np.abs(x) < 700
        e = np.exp(np.clip(x, -700, 700))
        low, d_low = _soft(f0 * e + f3)
        high, d_high = _soft(1 - low)
        slope = d_high * d_low
        return 1 - high, [slope * d for d in (e, np.where(inside, f0 * e * (self.t - f2), 0.0), np.where(inside, -f0 * f1 * e, 0.0), np.ones_like(e))]

    def shape(self, v: np.ndarray, a: np.ndarray, i: np.ndarray, j: np.ndarray, derivatives: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """(the model without scaling, its (cell, parameter) derivatives)."""
        q = self.q[a]

        def span(along: np.ndarray) -> np.ndarray:
            return along[j] - along[i]

        def half(cum: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """The decay over a cell's interval, and its derivative by that interval's integral."""
            d = span(cum)
            length = np.sqrt(d * d + 1e-12)
            exponent = -0.5 * q * q * length
            h = np.exp(np.maximum(exponent, -700.0))
            return h, np.where(exponent > -700.0, -0.5 * q * q * d / length * h, 0.0)

        cr, dcr = self._running(*v[0:3], floor=True)
        cm, dcm = self._running(*v[3:6], floor=True)
        cv, dcv = self._running(*v[6:9], floor=False)
        fs, dfs = self._fraction(*v[9:13])
        fr = 1 - fs
        (hr, sr), (hs, ss) = half(cr), half(cm)
        turn = np.radians(self.phi[a] + v[13])
        across = q * np.cos(turn)
        shift = span(cv)
        beat = np.cos(across * shift)
        ref, sample = fr[i] * fr[j], fs[i] * fs[j]
        x, y = ref * hr, sample * hs
        top = x * x + y * y + 2 * x * y * beat
        own = fs * fs + fr * fr
        norm = own[i] * own[j]
        below = np.maximum(norm, 1e-10)
        if not derivatives:
            return top / below, None
        out = np.empty((len(a), len(v)))
        by_x, by_y = 2 * (x + y * beat) / below, 2 * (y + x * beat) / below
        by_beat = -2 * x * y * np.sin(across * shift) / below
        for m in range(3):
            out[:, m] = by_x * ref * sr * span(dcr[m])
            out[:, 3 + m] = by_y * sample * ss * span(dcm[m])
            out[:, 6 + m] = by_beat * across * span(dcv[m])
        for m, d in enumerate(dfs):
            slope = 2 * (fs - fr) * d  # of a frame's norm
            d_norm = np.where(norm > 1e-10, slope[i] * own[j] + own[i] * slope[j], 0.0)
            out[:, 9 + m] = by_x * -(d[i] * fr[j] + fr[i] * d[j]) * hr + by_y * (d[i] * fs[j] + fs[i] * d[j]) * hs - top / (below * below) * d_norm
        out[:, 13] = by_beat * -q * np.sin(turn) * (math.pi / 180) * shift
        return top / below, out

    def evaluate(self, p: np.ndarray, a: np.ndarray, i: np.ndarray, j: np.ndarray, jacobian: bool = True):
        k = self.n_scaling
        s = a if k > 1 else np.zeros_like(a)
        c, o = p[:k][s], p[k : 2 * k][s]
        shape, slopes = self.shape(p[2 * k :], a, i, j, jacobian)
        model = o + c * shape
        if not jacobian:
            return model, None
        out = np.zeros((len(a), self.size))
        rows = np.arange(len(a))
        out[rows, s], out[rows, k + s] = shape, 1.0
        out[:, 2 * k :] = c[:, None] * slopes
        return model, out
