"""Selections of angles, frames and cells."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import angle_between, normalise_angle

# The preset target ranges (degrees).
DEFAULT_RANGES = ((-10.0, 10.0), (170.0, 190.0))
ANISOTROPIC_RANGES = ((-10.0, 10.0), (80.0, 100.0), (170.0, 190.0), (260.0, 280.0))
ISOTROPIC_RANGES = ((-10.0, 10.0), (170.0, 190.0))


def q_range(column: Column, low: float | None = None, high: float | None = None) -> Column:
    """Inclusive on both sides; a side of None is open."""
    keep = F.lit(True)
    if low is not None:
        keep = keep & (column >= low)
    if high is not None:
        keep = keep & (column <= high)
    return keep


def filter_statistics(df: DataFrame, column: str, keep: Column) -> DataFrame:
    """One row: selected, total, fraction, and the range of the data."""
    chosen = F.sum(keep.cast("long"))
    return df.agg(chosen.alias("selected"), F.count(F.lit(1)).alias("total"), (chosen / F.count(F.lit(1))).alias("fraction"), F.min(column).alias("data_min"), F.max(column).alias("data_max"))


def in_any_range(phi: Column, ranges: Sequence[tuple[float, float]], normalise: bool = False) -> Column:
    """Whether the angle lies in any of the ranges (each may wrap around)."""
    if normalise:
        phi = normalise_angle(phi)
        ranges = [tuple(_wrapped(x) for x in r) for r in ranges]
    return reduce(lambda a, b: a | b, (angle_between(phi, lo, hi) for lo, hi in ranges), F.lit(False))


def _wrapped(a: float) -> float:
    m = a % 360.0
    return m - 360.0 if m > 180.0 else m


def combine(masks: dict[str, Column], how: str = "AND") -> Column:
    """All or any of the masks."""
    if how not in ("AND", "OR"):
        raise ValueError(f"combine with AND or OR, not {how}")
    return reduce((lambda a, b: a & b) if how == "AND" else (lambda a, b: a | b), masks.values())


def or_all(df: DataFrame, keep: Column, fallback: bool = True) -> DataFrame:
    """The selected rows; all of them if none is selected and ``fallback``.

    The count is one aggregate joined back, so rows are never gathered in one window.
    """
    if not fallback:
        return df.where(keep)
    any_kept = df.agg(F.coalesce(F.max(keep.cast("int")), F.lit(0)).alias("__any"))
    return df.crossJoin(F.broadcast(any_kept)).where(keep | (F.col("__any") == 0)).drop("__any")


def select_angles(angles: DataFrame, ranges: Sequence[tuple[float, float]] = DEFAULT_RANGES, normalise: bool = False, fallback: bool = True) -> DataFrame:
    return or_all(angles, in_any_range(F.col("phi"), ranges, normalise), fallback)


def semi_join_ranges(angles: DataFrame, ranges: DataFrame) -> DataFrame:
    """Angles in any row of a (min_angle, max_angle) table: a theta join with a small side."""
    r = F.broadcast(ranges)
    return angles.join(r, angle_between(angles["phi"], r["min_angle"], r["max_angle"]), "left_semi")


def frame_stride(stride: int) -> None:
    """Subsampling frames is refused: it would break the time integrals."""
    if stride > 1:
        raise ValueError("frames can't be subsampled")


def slice_frames(cells: DataFrame, start: int, end: int) -> DataFrame:
    """Frames ``start`` (counted from 1) to ``end`` (inclusive; negative: to the last), counted anew from 0."""
    keep = (F.col("i") >= start - 1) & (F.col("j") >= start - 1)
    if end >= 0:
        keep = keep & (F.col("i") < end) & (F.col("j") < end)
    return cells.where(keep).withColumns({"i": F.col("i") - (start - 1), "j": F.col("j") - (start - 1)})


def nearest(df: DataFrame, column: str, value: float, key: str) -> DataFrame:
    """The row of least |column - value|, the least key on ties."""
    return df.orderBy(F.abs(F.col(column) - value), key).limit(1)


def nearest_k(df: DataFrame, column: str, value: float, key: str, k: int = 10) -> DataFrame:
    return df.orderBy(F.abs(F.col(column) - value), key).limit(k)


def near_q(angles: DataFrame, q0: float, tolerance: float = 0.1, least: int = 5, fallback: int = 10) -> DataFrame:
    """Rows within ``tolerance`` of the nearest q; with fewer than ``least`` of them, the ``fallback`` nearest."""
    best = F.broadcast(nearest(angles, "q", q0, "angle_idx").select(F.col("q").alias("__q")))
    w = angles.crossJoin(best).withColumn("__near", F.abs(F.col("q") - F.col("__q")) <= tolerance * F.col("__q"))
    total = F.broadcast(w.agg(F.sum(F.col("__near").cast("long")).alias("__n")))
    closest = nearest_k(angles, "q", q0, "angle_idx", fallback).select("angle_idx", F.lit(True).alias("__close"))
    return w.crossJoin(total).join(F.broadcast(closest), "angle_idx", "left").where(((F.col("__n") >= least) & F.col("__near")) | ((F.col("__n") < least) & F.col("__close"))).drop("__q", "__near", "__n", "__close")


def decode_bins(bins: DataFrame, n_q: int, n_phi: int) -> DataFrame:
    """processed_bin (from 1) to (q_idx, phi_idx); bins out of range are dropped."""
    k = F.col("processed_bin") - 1
    return bins.withColumns({"q_idx": F.floor(k / n_phi).cast("int"), "phi_idx": F.pmod(k, F.lit(n_phi)).cast("int")}).where((k >= 0) & (F.col("q_idx") < n_q))


def subset_by_request(angles: DataFrame, requested: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """The nearest angle to every requested one; if any is farther than ``tolerance``, all angles."""
    gap = F.abs(angles["phi"] - requested["want"])
    found = angles.crossJoin(F.broadcast(requested)).groupBy("want").agg(F.min_by("angle_idx", F.struct(gap, F.col("angle_idx"))).alias("angle_idx"), F.min(gap).alias("gap"))
    state = found.agg(F.max("gap").alias("worst"))
    return angles.crossJoin(F.broadcast(state)).join(F.broadcast(found.select("angle_idx", F.lit(True).alias("hit")).distinct()), "angle_idx", "left").where((F.col("worst") > tolerance) | F.col("hit")).select(*angles.columns)


def off_diagonal(cells: DataFrame, drop_first_frame: bool = True) -> DataFrame:
    keep = F.col("i") != F.col("j")
    return cells.where(keep & (F.col("i") > 0) & (F.col("j") > 0) if drop_first_frame else keep)


def drop_first_frame(cells: DataFrame) -> DataFrame:
    return cells.where((F.col("i") > 0) & (F.col("j") > 0))


def masked_residual(residual: Column) -> Column:
    """0 on the diagonal, the row stays."""
    return F.when(F.col("i") == F.col("j"), F.lit(0.0)).otherwise(residual)


def with_defaults(cells: DataFrame, sigma: float = 0.01) -> DataFrame:
    """sigma where it is missing, and whether it was."""
    have = "sigma" in cells.columns
    own = F.col("sigma") if have else F.lit(None).cast("double")
    return cells.withColumns({"sigma": F.coalesce(own, F.lit(sigma)), "sigma_is_default": own.isNull()})


def upper_triangle(cells: DataFrame, diagonal: bool = True) -> DataFrame:
    return cells.where(F.col("i") <= F.col("j") if diagonal else F.col("i") < F.col("j"))


def mirror(half: DataFrame) -> DataFrame:
    """The full matrix of an upper triangle: each cell once on either side."""
    below = half.where(F.col("i") < F.col("j")).select("angle_idx", F.col("j").alias("i"), F.col("i").alias("j"), "c2")
    return half.select("angle_idx", "i", "j", "c2").unionByName(below)


def half_to_full(half: DataFrame) -> DataFrame:
    """h + h^T with the diagonal halved: cells may be given on either or both sides."""
    swapped = half.select("angle_idx", F.col("j").alias("i"), F.col("i").alias("j"), "c2")
    both = half.select("angle_idx", "i", "j", "c2").unionByName(swapped).groupBy("angle_idx", "i", "j").agg(F.sum("c2").alias("c2"))
    return both.withColumn("c2", F.when(F.col("i") == F.col("j"), F.col("c2") / 2).otherwise(F.col("c2")))


def transpose(cells: DataFrame, name: str = "c2t") -> DataFrame:
    return cells.select("angle_idx", F.col("j").alias("i"), F.col("i").alias("j"), F.col("c2").alias(name))


def symmetrise(cells: DataFrame) -> DataFrame:
    """(M + M^T) / 2 by one aggregation of unordered pairs, without a self-join."""
    pair = cells.groupBy("angle_idx", F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")).agg(F.avg("c2").alias("c2"))
    return pair.select("angle_idx", F.col("a").alias("i"), F.col("b").alias("j"), "c2").unionByName(pair.where("a < b").select("angle_idx", F.col("b").alias("i"), F.col("a").alias("j"), "c2"))


def flatten_arrays(rows: DataFrame) -> DataFrame:
    """(angle_idx, c2 array<array<double>>) to cells."""
    outer = rows.select("angle_idx", F.posexplode("c2").alias("i", "row"))
    return outer.select("angle_idx", "i", F.posexplode("row").alias("j", "c2"))


def index_sanity(chosen: DataFrame, n: int) -> DataFrame:
    """Counts of negative, out-of-range and repeated indices of column idx; all 0 where it is sound."""
    return chosen.agg(F.sum((F.col("idx") < 0).cast("long")).alias("negative"), F.sum((F.col("idx") >= n).cast("long")).alias("too_large"), (F.count("idx") - F.count_distinct("idx")).alias("repeated"))


def angle_statistics(angles: DataFrame, ranges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(total, min, max, mean, population std of phi; count and percentage per range)."""
    overall = angles.agg(F.count(F.lit(1)).alias("total"), F.min("phi").alias("phi_min"), F.max("phi").alias("phi_max"), F.avg("phi").alias("phi_mean"), F.stddev_pop("phi").alias("phi_std"))
    total = F.broadcast(angles.agg(F.count(F.lit(1)).alias("total")))
    r = F.broadcast(ranges)
    per = r.join(angles, angle_between(angles["phi"], r["min_angle"], r["max_angle"]), "left").groupBy("min_angle", "max_angle").agg(F.count("angle_idx").alias("n")).crossJoin(total)
    return overall, per.select("min_angle", "max_angle", "n", (100.0 * F.col("n") / F.col("total")).alias("percent"))


