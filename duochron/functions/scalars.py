"""Scalar functions of the models as Column expressions; they stay in whole-stage codegen."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def finite(x: Column) -> Column:
    """The value, or null where it is NaN or infinite: for use inside aggregates."""
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(math.inf)), x)


def clip(x: Column, lower, upper) -> Column:
    return F.greatest(F.least(x, _c(upper)), _c(lower))


def safe_exp(x: Column) -> Column:
    return F.exp(clip(x, -700.0, 700.0))


def sinc_taylor(x: Column) -> Column:
    """sin(x)/x with its series near 0 (one-component models)."""
    return F.when(F.abs(x) < 1e-4, 1 - x * x / 6 + F.pow(x, F.lit(4.0)) / 120).otherwise(F.sin(x) / x)


def sinc_plain(x: Column) -> Column:
    """sin(x)/x, 1 at 0 (two-component models)."""
    return F.when(F.abs(x) <= 1e-10, F.lit(1.0)).otherwise(F.sin(x) / x)


def safe_power(base: Column, exponent) -> Column:
    """0 for a base that isn't positive."""
    return F.when(base > 0, F.pow(F.greatest(base, F.lit(1e-30)), _c(exponent))).otherwise(F.lit(0.0))


def safe_divide(a: Column, b: Column, fill: float = 0.0) -> Column:
    return F.when(F.abs(b) > 1e-30, a / b).otherwise(F.lit(fill))


def safe_log(x: Column) -> Column:
    return F.ln(F.greatest(x, F.lit(1e-30)))


def safe_sqrt(x: Column) -> Column:
    return F.sqrt(F.greatest(x, F.lit(0.0)))


def smooth_abs(x: Column) -> Column:
    return F.sqrt(x * x + 1e-12)


def softplus(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def smooth_clip(x: Column, lower: float = 0.0, upper: float = 1.0, sharpness: float = 50.0) -> Column:
    """A differentiable clip: a softplus at the lower bound, then one at the upper."""
    low = lower + softplus(sharpness * (x - lower)) / sharpness
    return upper - softplus(sharpness * (upper - low)) / sharpness


def relative_difference(a: Column, b: Column) -> Column:
    return F.abs(a - b) / F.greatest(F.abs(a), F.abs(b), F.lit(1e-10))


def rate(t: Column, scale, exponent, offset, dt: float, floor: float = 1e-10) -> Column:
    """scale * max(t, eps)**exponent + offset, at least ``floor``: diffusion and shear rates."""
    return F.greatest(_c(scale) * F.pow(F.greatest(t, F.lit(max(dt / 2, 1e-8))), _c(exponent)) + _c(offset), F.lit(floor))


def transport_rate(t: Column, scale, exponent, offset) -> Column:
    return F.greatest(_c(scale) * safe_power(t, exponent) + _c(offset), F.lit(0.0))


def velocity_rate(t: Column, scale, exponent, offset) -> Column:
    """Signed."""
    return _c(scale) * safe_power(t, exponent) + _c(offset)


def sample_fraction(t: Column, f0, f1, f2, f3) -> Column:
    return smooth_clip(_c(f0) * safe_exp(_c(f1) * (t - _c(f2))) + _c(f3))


def correlation_time(q: Column, d0, alpha) -> Column:
    return 1.0 / (q * q * _c(d0)) * (1 + F.abs(_c(alpha)))


def normalise_angle(a: Column) -> Column:
    """To (-180, 180]; floor modulus, as Spark's % keeps the sign."""
    m = F.pmod(a, F.lit(360.0))
    return F.when(m > 180, m - 360).otherwise(m)


def angle_between(a: Column, low, high) -> Column:
    """Inclusive; a range whose low end exceeds its high end wraps around."""
    low, high = _c(low), _c(high)
    return F.when(low <= high, a.between(low, high)).otherwise((a >= low) | (a <= high))


def to_unit(x: Column, lower, upper) -> Column:
    return (x - _c(lower)) / (_c(upper) - _c(lower))


def from_unit(x: Column, lower, upper) -> Column:
    return _c(lower) + x * (_c(upper) - _c(lower))


def weight(kind: str, c2: Column, sigma: Column | None = None) -> Column:
    """uniform, inverse_variance or inverse_c2."""
    if kind == "uniform":
        return F.lit(1.0)
    if kind == "inverse_variance":
        return 1.0 / F.greatest(sigma * sigma, F.lit(1e-30))
    if kind == "inverse_c2":
        return 1.0 / F.greatest(F.abs(c2), F.lit(1e-30))
    raise ValueError(f"no such weight: {kind}")


def shear_weight(phi: Column, phi0: float, least: float, exponent: float) -> Column:
    """Before division by its mean."""
    return least + (1 - least) * F.pow(F.abs(F.cos(F.radians(F.lit(phi0) - phi))), F.lit(exponent))
