"""Model surfaces over the long table: per-frame vectors once, then one expression per cell."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scalars import rate, sample_fraction, safe_exp, sinc_taylor, smooth_abs, transport_rate, velocity_rate

#: Frames whose per-frame vectors may be broadcast; the table has one row a frame.
BROADCAST_FRAMES = 100_000


def cumulative_trapezoid(frames: DataFrame, value: str, out: str, step: float = 1.0, by: tuple[str, ...] = ()) -> DataFrame:
    """Add ``out``: 0, then the running sum of step * (v[k] + v[k+1]) / 2 along i.

    Frames are a dimension (thousands of rows per data set), so one ordered
    window per data set is what this costs; the cells never pass through it.
    """
    w = Window.partitionBy(*by).orderBy("i")
    mid = F.coalesce((F.lag(value).over(w) + F.col(value)) / 2 * step, F.lit(0.0))
    return frames.withColumn("__mid", mid).withColumn(out, F.sum("__mid").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__mid")


def frame_pairs(frames: DataFrame, columns: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """Every (i, j) of frames with ``columns`` of both as name_i and name_j; ``by`` are keys that both sides share."""
    a = frames.select(*by, "i", *(F.col(c).alias(f"{c}_i") for c in columns))
    b = F.broadcast(frames.select(*by, F.col("i").alias("j"), *(F.col(c).alias(f"{c}_j") for c in columns)))
    return a.join(b, list(by)) if by else a.crossJoin(b)


def time_integral(difference):
    """sqrt(d**2 + 1e-12): |C_i - C_j| without a cusp."""
    return F.sqrt(difference * difference + 1e-12)


def homodyne_frames(frames: DataFrame, p: dict[str, float], dt: float) -> DataFrame:
    """The frames with their running diffusion (cd) and shear (cs) integrals."""
    out = frames.withColumn("__d", rate(F.col("t"), p["D0"], p["alpha"], p["D_offset"], dt))
    out = cumulative_trapezoid(out, "__d", "cd")
    if "gamma_dot_t0" in p:
        out = cumulative_trapezoid(out.withColumn("__s", rate(F.col("t"), p["gamma_dot_t0"], p["beta"], p["gamma_dot_t_offset"], dt)), "__s", "cs").drop("__s")
    else:
        out = out.withColumn("cs", F.lit(0.0))
    return out.drop("__d")


def homodyne_surface(frames: DataFrame, angles: DataFrame, p: dict[str, float], dt: float, length: float = 2e6) -> DataFrame:
    """(angle_idx, i, j, g1): diffusion times shear for every angle and pair of frames.

    Parameters D0, alpha, D_offset, and for flow gamma_dot_t0, beta,
    gamma_dot_t_offset, phi0. The diagonal's integrals are 0.
    """
    pairs = frame_pairs(homodyne_frames(frames, p, dt).select("i", "cd", "cs"), ["cd", "cs"])
    cells = pairs.crossJoin(F.broadcast(angles.select("angle_idx", "phi", "q")))
    return cells.select("angle_idx", "i", "j", _homodyne_g1(p, dt, length).alias("g1"))


def homodyne_at(points: DataFrame, frames: DataFrame, angles: DataFrame, p: dict[str, float], dt: float, length: float = 2e6) -> DataFrame:
    """``points`` (angle_idx, i, j, ...) with g1: the model of ``homodyne_surface`` at scattered cells, by equi-joins with the frames."""
    at = _at(points, homodyne_frames(frames, p, dt).select("i", "cd", "cs"), angles, ["cd", "cs"])
    return at.select(*points.columns, _homodyne_g1(p, dt, length).alias("g1"))


def _homodyne_g1(p: dict[str, float], dt: float, length: float):
    """g1 from q, phi and both frames' integrals."""
    off = F.col("i") != F.col("j")
    diffusion = F.when(off, time_integral(F.col("cd_i") - F.col("cd_j"))).otherwise(0.0)
    g1 = F.exp(F.greatest(F.least(-0.5 * F.col("q") * F.col("q") * dt * diffusion, F.lit(0.0)), F.lit(-700.0)))
    if "gamma_dot_t0" in p:
        shear = F.when(off, time_integral(F.col("cs_i") - F.col("cs_j"))).otherwise(0.0)
        s = sinc_taylor(F.col("q") * length * dt / (2 * math.pi) * F.cos(F.radians(F.lit(p["phi0"]) - F.col("phi"))) * shear)
        g1 = g1 * s * s
    return F.greatest(g1, F.lit(1e-10))


def _at(points: DataFrame, frames: DataFrame, angles: DataFrame, columns: list[str]) -> DataFrame:
    """Points with both frames' columns and their angle's q and phi; frames and angles are dimensions."""
    frames = F.broadcast(frames) if frames.limit(BROADCAST_FRAMES + 1).count() <= BROADCAST_FRAMES else frames
    first = frames.select("i", *(F.col(c).alias(f"{c}_i") for c in columns))
    second = frames.select(F.col("i").alias("j"), *(F.col(c).alias(f"{c}_j") for c in columns))
    return points.join(first, "i").join(second, "j").join(F.broadcast(angles.select("angle_idx", "phi", "q")), "angle_idx")


def scaled(g1, contrast, offset):
    """offset + contrast * g1**2; never clipped."""
    return offset + contrast * g1 * g1


def heterodyne_frames(frames: DataFrame, p: dict[str, float], dt: float) -> DataFrame:
    """The frames with running integrals of both transports (cr, cm) and the velocity (cv), and the sample fraction (fs)."""
    t = F.col("t")
    out = frames.withColumns({
        "__r": transport_rate(t, p["D0_ref"], p["alpha_ref"], p["D_offset_ref"]),
        "__m": transport_rate(t, p["D0_sample"], p["alpha_sample"], p["D_offset_sample"]),
        "__v": velocity_rate(t, p["v0"], p["v_beta"], p["v_offset"]),
        "fs": sample_fraction(t, p["f0"], p["f1"], p["f2"], p["f3"]),
    })
    for rate_of, name in (("__r", "cr"), ("__m", "cm"), ("__v", "cv")):
        out = cumulative_trapezoid(out, rate_of, name, dt)
    return out.drop("__r", "__m", "__v")


def heterodyne_surface(frames: DataFrame, angles: DataFrame, p: dict[str, float], dt: float) -> DataFrame:
    """(angle_idx, i, j, model): the two-component correlation before contrast and offset.

    Reference and sample parts and their beat, divided by the intensities'
    normalisation. Parameters as in the two-component registry.
    """
    names = ["cr", "cm", "cv", "fs"]
    cells = frame_pairs(heterodyne_frames(frames, p, dt).select("i", *names), names).crossJoin(F.broadcast(angles.select("angle_idx", "phi", "q")))
    return cells.select("angle_idx", "i", "j", _heterodyne_c2(p).alias("model"))


def heterodyne_at(points: DataFrame, frames: DataFrame, angles: DataFrame, p: dict[str, float], dt: float) -> DataFrame:
    """``points`` (angle_idx, i, j, ...) with model: that of ``heterodyne_surface`` at scattered cells."""
    names = ["cr", "cm", "cv", "fs"]
    at = _at(points, heterodyne_frames(frames, p, dt).select("i", *names), angles, names)
    return at.select(*points.columns, _heterodyne_c2(p).alias("model"))


def _heterodyne_c2(p: dict[str, float]):
    q, fi, fj = F.col("q"), F.col("fs_i"), F.col("fs_j")
    ri, rj = 1 - fi, 1 - fj

    def half(name):
        return F.exp(F.greatest(F.least(-0.5 * q * q * smooth_abs(F.col(f"{name}_j") - F.col(f"{name}_i")), F.lit(0.0)), F.lit(-700.0)))

    hr, hs = half("cr"), half("cm")
    beat = F.cos(q * F.cos(F.radians(F.col("phi") + F.lit(p["phi0_het"]))) * (F.col("cv_j") - F.col("cv_i")))
    top = F.pow(ri * rj * hr, F.lit(2.0)) + F.pow(fi * fj * hs, F.lit(2.0)) + 2 * ri * fi * rj * fj * hr * hs * beat
    norm = F.greatest((fi * fi + ri * ri) * (fj * fj + rj * rj), F.lit(1e-10))
    return top / norm


__all__ = ["cumulative_trapezoid", "frame_pairs", "heterodyne_at", "heterodyne_frames", "heterodyne_surface", "homodyne_at", "homodyne_frames", "homodyne_surface", "safe_exp", "scaled", "time_integral"]
