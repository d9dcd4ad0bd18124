"""The tables behind figures and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def comparison(cells: DataFrame) -> DataFrame:
    """Data, fit and residual of every cell."""
    return cells.select("angle_idx", "i", "j", "c2", "model", (F.col("c2") - F.col("model")).alias("residual"))


def residual_histogram(cells: DataFrame, low: float, high: float, bins: int) -> DataFrame:
    """(angle_idx, bin, n); the last bin holds its upper edge, values outside are left out."""
    width = (high - low) / bins
    r = F.col("c2") - F.col("model")
    return cells.where(r.between(low, high)).groupBy("angle_idx", F.least(F.floor((r - low) / width), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def rasterise(cells: DataFrame, frames: int, width: int, height: int) -> DataFrame:
    """Means of the cells that fall on each of width x height pixels."""
    return cells.groupBy("angle_idx", F.floor(F.col("i") * width / frames).cast("int").alias("x"), F.floor(F.col("j") * height / frames).cast("int").alias("y")).agg(F.avg("c2").alias("c2"))


def correlation_of(covariance: DataFrame) -> DataFrame:
    """(a, b, value) covariances to correlations."""
    d = F.broadcast(covariance.where(F.col("a") == F.col("b")).select(F.col("a").alias("k"), F.sqrt("value").alias("sd")))
    out = covariance.join(d.withColumnsRenamed({"k": "a", "sd": "sa"}), "a").join(d.withColumnsRenamed({"k": "b", "sd": "sb"}), "b")
    return out.select("a", "b", (F.col("value") / (F.col("sa") * F.col("sb"))).alias("value"))


def parameter_status(fitted: DataFrame, atol: float = 1e-8) -> DataFrame:
    """(param, value, lower, upper) with status at_lower, at_upper or active."""
    v = F.col("value")
    return fitted.withColumn("status", F.when(F.abs(v - F.col("lower")) <= atol, "at_lower").when(F.abs(v - F.col("upper")) <= atol, "at_upper").otherwise("active"))


def expand_scaling(scaling: DataFrame) -> DataFrame:
    """(contrast array, offset array) to a row per angle."""
    c = scaling.select(F.posexplode(F.arrays_zip("contrast", "offset")).alias("angle_idx", "s"))
    return c.select("angle_idx", "s.contrast", "s.offset")


def clipped(values: DataFrame, bounds: DataFrame) -> DataFrame:
    """(name, value) clipped to the bounds (name, lower, upper), and whether it was within."""
    b = F.broadcast(bounds.select("name", "lower", "upper"))  # one row a parameter
    inside = F.col("value").between(F.col("lower"), F.col("upper"))
    return values.join(b, "name").select("name", F.greatest(F.least("value", "upper"), F.col("lower")).alias("value"), inside.alias("within"))
