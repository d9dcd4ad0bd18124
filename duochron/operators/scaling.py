"""Contrast and offset from exact quantiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import clip, finite
from .quantiles import exact_percentiles

LEAST_POINTS, LEAST_LATE = 100, 10


def quantile_scaling(cells: DataFrame, frames_dt: float = 1.0, low: float = 0.2, high: float = 0.8, floor: float = 0.1, ceiling: float = 0.9, bounded: bool = True) -> DataFrame:
    """(angle_idx, n, contrast, offset) per angle.

    The offset is a low quantile of late cells (lag at or beyond the ``high``
    lag quantile; all cells where fewer than ten are late), the contrast the
    rise from there to a high quantile of early cells. Angles with fewer than
    100 finite cells get the middles of the bounds.
    """
    x = cells.select("angle_idx", finite(F.col("c2")).alias("c2"), (F.abs(F.col("i") - F.col("j")) * frames_dt).alias("lag")).where("c2 IS NOT NULL")
    # Lags are as few as frames: a map of their counts is small.
    lags = F.broadcast(x.groupBy("angle_idx").agg(F.percentile("lag", F.lit(low)).alias("early"), F.percentile("lag", F.lit(high)).alias("late")))
    marked = x.join(lags, "angle_idx").select("angle_idx", "c2", (F.col("lag") >= F.col("late")).alias("is_late"), (F.col("lag") <= F.col("early")).alias("is_early"))
    wanted = {"late_floor": (floor, "is_late"), "all_floor": floor, "top": (ceiling, "is_early")}
    s = exact_percentiles(marked, ["angle_idx"], "c2", wanted).withColumnsRenamed({"n_all_floor": "n", "n_late_floor": "n_late"})
    offset = F.when(F.col("n_late") >= LEAST_LATE, F.col("late_floor")).otherwise(F.col("all_floor"))
    s = s.withColumn("offset", clip(offset, 0.5, 1.5) if bounded else offset)
    contrast = F.col("top") - F.col("offset")
    s = s.withColumn("contrast", clip(contrast, 0.0, 1.0) if bounded else contrast)
    enough = F.col("n") >= LEAST_POINTS
    return s.select("angle_idx", "n", F.when(enough, F.col("contrast")).otherwise(0.5).alias("contrast"), F.when(enough, F.col("offset")).otherwise(1.0).alias("offset"))


def averaged_scaling(per_angle: DataFrame) -> DataFrame:
    return per_angle.agg(F.avg("contrast").alias("contrast"), F.avg("offset").alias("offset"))


def strict_scaling(cells: DataFrame, quantile: float = 0.95) -> DataFrame:
    """Unbounded, with a ``complete`` flag: whether every angle has enough finite cells."""
    out = quantile_scaling(cells, floor=round(1 - quantile, 12), ceiling=quantile, bounded=False)
    return out.withColumn("complete", F.col("n") >= LEAST_POINTS)


def global_scaling(cells: DataFrame) -> DataFrame:
    """One row: the 5 % quantile as offset, the rise to the maximum as contrast; (0.5, 1) where either isn't positive."""
    s = exact_percentiles(cells, [], "c2", {"o": 0.05, "m": 1.0})
    ok = (F.col("o") > 0) & (F.col("m") - F.col("o") > 0)
    s = s.select(F.when(ok, F.col("m") - F.col("o")).otherwise(0.5).alias("contrast"), F.when(ok, F.col("o")).otherwise(1.0).alias("offset"))
    return _or_row(s, contrast=0.5, offset=1.0)


def _or_row(s: DataFrame, **otherwise: float | None) -> DataFrame:
    """The one row of ``s``; where it has none, the values given."""
    return s.agg(*(F.coalesce(F.first(k), F.lit(v).cast("double")).alias(k) for k, v in otherwise.items()))


def colour_limits(cells: DataFrame) -> DataFrame:
    """One row: the 1 % and 99 % quantiles of the finite cells, at least 1 apart where they are equal; (1, 1.5) without any."""
    s = exact_percentiles(cells.withColumn("c2", finite(F.col("c2"))), [], "c2", {"lo": 0.01, "hi": 0.99})
    s = s.select("lo", F.when(F.col("hi") > F.col("lo"), F.col("hi")).otherwise(F.col("lo") + 1).alias("hi"))
    return _or_row(s, lo=1.0, hi=1.5)


def residual_limit(cells: DataFrame) -> DataFrame:
    """One row: the 99 % quantile of the absolute residuals; null without any."""
    return _or_row(exact_percentiles(cells.select(F.abs("residual").alias("r")), [], "r", {"limit": 0.99}).select("limit"), limit=None)
