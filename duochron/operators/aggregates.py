"""Statistics, scores, chi-squared and scaling as partial aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import clip, finite
from .filters import transpose
from .quantiles import exact_percentiles


def angle_distribution(cells: DataFrame) -> DataFrame:
    """Per angle: count and fraction, and the imbalance of all."""
    counts = cells.groupBy("angle_idx").agg(F.count(F.lit(1)).alias("n"))
    total = F.broadcast(counts.agg(F.sum("n").alias("total"), F.max("n").alias("most"), F.min("n").alias("least")))
    return counts.crossJoin(total).select("angle_idx", "n", (F.col("n") / F.col("total")).alias("fraction"), (F.col("most") / F.col("least")).alias("imbalance"), (F.col("most") / F.col("least") < 5).alias("balanced"))


def array_statistics(cells: DataFrame, value: str = "c2", order: tuple[str, ...] = ("angle_idx", "i", "j")) -> DataFrame:
    """One row: count, mean, population std, extremes, finite fraction, sum, first and last."""
    x = finite(F.col(value))
    by = F.struct(*order)
    return cells.agg(F.count(F.lit(1)).alias("n"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.min(x).alias("least"), F.max(x).alias("most"), F.avg(x.isNotNull().cast("int")).alias("finite_fraction"), F.sum(x).alias("total"), F.min_by(value, by).alias("first_value"), F.max_by(value, by).alias("last_value"))


def validation_score(errors: Column, warnings: Column, has_statistics: Column, non_finite: Column, q_range_valid: Column) -> Column:
    return clip(1 - 0.2 * errors - 0.05 * warnings + 0.1 * has_statistics.cast("int") - 0.1 * non_finite + 0.1 * q_range_valid.cast("int"), 0.0, 1.0)


def basic_quality(cells: DataFrame) -> DataFrame:
    """Mean band score and signal to noise of each matrix."""
    s = cells.groupBy("angle_idx").agg(F.avg("c2").alias("mean"), F.stddev_pop("c2").alias("std"))
    band = F.when(F.col("mean").between(0.5, 3.0), 85.0).when(F.col("mean").between(0.1, 5.0), 60.0).otherwise(30.0)
    return s.select("angle_idx", "mean", band.alias("range_score"), F.least(10 * F.col("mean") / F.col("std"), F.lit(100.0)).alias("snr_score"))


def asymmetry(cells: DataFrame) -> DataFrame:
    """Per matrix: mean |M - M^T| and the greatest |M| over finite cells, from one aggregation of unordered pairs.

    Both are null where nothing is finite.
    """
    x = finite(F.col("c2"))
    pair = cells.groupBy("angle_idx", F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")).agg(F.count(x).alias("k"), (F.max(x) - F.min(x)).alias("gap"), F.max(F.abs(x)).alias("most"))
    both = F.when((F.col("a") == F.col("b")) & (F.col("k") > 0), 1).when(F.col("k") > 1, 2).otherwise(0)
    return pair.groupBy("angle_idx").agg((F.sum(both * F.coalesce("gap", F.lit(0.0))) / F.nullif(F.sum(both), F.lit(0))).alias("mean_gap"), F.max("most").alias("most"))


def symmetry_and_decay(cells: DataFrame) -> DataFrame:
    """Per matrix: 100 * (1 - mean gap / max), and the decay of the diagonal over ten frames where it lies in [0, 1]."""
    d0, d10 = (F.max(F.when((F.col("i") == k) & (F.col("j") == k), finite(F.col("c2")))) for k in (0, 10))
    decay = cells.groupBy("angle_idx").agg(((d0 - d10) / d0).alias("decay"))
    return asymmetry(cells).join(decay, "angle_idx").select("angle_idx", (100 * (1 - F.col("mean_gap") / F.col("most"))).alias("symmetry"), F.when(F.col("decay").between(0, 1), F.col("decay")).alias("decay"))


def matrix_quality(cells: DataFrame) -> DataFrame:
    """Per matrix: weighted score of finiteness, first diagonal cell, symmetry and mean, all of finite cells; 0 below nine tenths of them."""
    x = finite(F.col("c2"))
    s = cells.groupBy("angle_idx").agg(F.avg(x.isNotNull().cast("int")).alias("f"), F.max(F.when((F.col("i") == 0) & (F.col("j") == 0), x)).alias("d"), F.avg(x).alias("m"))
    s = s.join(asymmetry(cells), "angle_idx")
    score = 0.4 * F.col("f") + 0.3 * F.when(F.col("d").between(0.5, 2.0), 1.0).otherwise(0.5) + 0.2 * F.greatest(1 - 100 * F.coalesce("mean_gap", F.lit(0.0)), F.lit(0.0)) + 0.1 * F.when(F.col("m").between(0.1, 5.0), 1.0).otherwise(0.5)
    return s.select("angle_idx", F.when(F.col("f") < 0.9, 0.0).otherwise(score).alias("score"))


def quality_filter(cells: DataFrame, threshold: float) -> DataFrame:
    """The cells of matrices whose score reaches the threshold."""
    good = matrix_quality(cells).where(F.col("score") >= threshold).select("angle_idx")
    return cells.join(F.broadcast(good), "angle_idx", "left_semi")


def readiness(finite_score: Column, symmetry: Column, snr: Column, decay: Column) -> Column:
    return 0.3 * finite_score + 0.4 * symmetry + 0.2 * snr + 0.1 * decay


def overall_quality(parts: list[Column], errors: Column, warnings: Column, repairs: Column) -> Column:
    """Six part scores of 0 to 100, weighted, less issues, plus a bonus for repairs."""
    weights = (0.2, 0.25, 0.2, 0.15, 0.1, 0.1)  # fixed values
    score = sum(w * p for w, p in zip(weights, parts))
    return clip(score - 10 * errors - 5 * warnings + F.least(5 * repairs, F.lit(10.0)), 0.0, 100.0)


def chi_squared(cells: DataFrame, by: list[str], data: str = "c2", model: str = "model", sigma: str = "sigma") -> DataFrame:
    """Sum of squared weighted residuals; a sigma that isn't positive has no weight."""
    r = F.when(F.col(sigma) > 0, (F.col(data) - F.col(model)) / F.col(sigma)).otherwise(0.0)
    return cells.groupBy(*by).agg(F.sum(r * r).alias("chi2"), F.count(F.lit(1)).alias("n"))


def per_angle_reduced(cells: DataFrame, n_parameters: int, data: str = "c2", model: str = "model") -> DataFrame:
    """Off-diagonal chi-squared over noise variance (that of cells far from the diagonal; the mean square where it vanishes)."""
    n = F.broadcast(cells.groupBy("angle_idx").agg((F.max("i") + 1).alias("size")))
    r = F.col(data) - F.col(model)
    off = cells.join(n, "angle_idx").where(F.col("i") != F.col("j"))
    s = off.groupBy("angle_idx", "size").agg(F.sum(r * r).alias("ss"), F.avg(r * r).alias("mse"), F.var_pop(F.when(F.abs(F.col("i") - F.col("j")) >= F.floor(F.col("size") / 2), F.col(data))).alias("var"))
    dof = F.greatest(F.col("size") * F.col("size") - F.col("size") - n_parameters, F.lit(1))
    noise = F.when(F.col("var") > 1e-12, F.col("var")).otherwise(F.col("mse"))
    return s.select("angle_idx", F.col("ss").alias("chi2"), dof.cast("long").alias("dof"), (F.col("ss") / noise / dof).alias("reduced"))


def least_squares_scaling(cells: DataFrame, theory: str = "model", data: str = "c2") -> DataFrame:
    """Per angle: contrast and offset that best scale the theory to the data."""
    return cells.groupBy("angle_idx").agg(F.regr_slope(data, theory).alias("contrast"), F.regr_intercept(data, theory).alias("offset"))


def normal_equations(cells: DataFrame, jacobian: list[str], residual: str, by: list[str] | None = None) -> DataFrame:
    """J^T J (upper triangle as g_a_b), J^T r (as h_a) and chi2 in one partial aggregation."""
    out = [F.sum(F.col(a) * F.col(b)).alias(f"g_{k}_{m}") for k, a in enumerate(jacobian) for m, b in enumerate(jacobian) if k <= m]
    out += [F.sum(F.col(a) * F.col(residual)).alias(f"h_{k}") for k, a in enumerate(jacobian)]
    return cells.groupBy(*(by or [])).agg(*out, F.sum(F.col(residual) * F.col(residual)).alias("chi2"), F.count(F.lit(1)).alias("n"))


def combine_estimates(estimates: DataFrame, weighting: str = "inverse_variance") -> DataFrame:
    """(param, value, variance, n_points) of several fits to one estimate per parameter."""
    w = {"inverse_variance": 1 / F.greatest("variance", F.lit(1e-10)), "n_points": F.col("n_points").cast("double"), "uniform": F.lit(1.0)}[weighting]
    return estimates.groupBy("param").agg((F.sum(w * F.col("value")) / F.sum(w)).alias("value"), (1 / F.sum(1 / (F.col("variance") + 1e-10))).alias("variance"))


def chunk_balance(chunks: DataFrame) -> DataFrame:
    """From (chunk, angle_idx) rows: sizes, their variation, and how many chunks hold every angle."""
    per = chunks.groupBy("chunk").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("angle_idx").alias("angles"))
    angles = F.broadcast(chunks.agg(F.count_distinct("angle_idx").alias("all_angles")))
    return per.crossJoin(angles).agg(F.avg("n").alias("mean_size"), F.stddev_pop("n").alias("std_size"), F.min("n").alias("least_size"), F.max("n").alias("most_size"), (F.stddev_pop("n") / F.avg("n")).alias("variation"), F.sum((F.col("angles") == F.col("all_angles")).cast("long")).alias("complete_chunks"), F.count(F.lit(1)).alias("chunks"))


def correlation_checks(cells: DataFrame) -> DataFrame:
    """Per matrix: whether it is symmetric (1e-10 absolute, 1e-5 relative) and its cell (0, 1) lies in [0.5, 2]."""
    lag = F.max(F.when((F.col("i") == 0) & (F.col("j") == 1), F.col("c2")))
    pairs = cells.groupBy("angle_idx", F.least("i", "j").alias("__lo"), F.greatest("i", "j").alias("__hi")).agg(F.count("c2").alias("__n"), F.min("c2").alias("__a"), F.max("c2").alias("__b"), lag.alias("__lag"))
    whole = (F.col("__lo") == F.col("__hi")) | (F.col("__n") == 2)
    close = F.when(whole, F.col("__b") - F.col("__a") <= 1e-10 + 1e-5 * F.least(F.abs("__a"), F.abs("__b")))
    return pairs.groupBy("angle_idx").agg(F.bool_and(close).alias("symmetric"), F.max("__lag").between(0.5, 2.0).alias("near_zero_lag_ok"))


def issues(cells: DataFrame) -> DataFrame:
    """(severity, category, message, parameter, value) rows of what is wrong; none where nothing is."""
    s = cells.agg(F.sum((finite(F.col("c2")).isNull()).cast("long")).alias("non_finite"), F.sum((F.col("c2") < 0).cast("long")).alias("negative"), F.avg("c2").alias("mean"), F.stddev_pop("c2").alias("std"))
    def issue(severity: str, category: str, message: str, value: Column, on: Column) -> Column:
        return F.struct(F.lit(severity).alias("severity"), F.lit(category).alias("category"), F.lit(message).alias("message"), F.lit("c2").alias("parameter"), value.cast("double").alias("value"), F.coalesce(on, F.lit(False)).alias("on"))

    rows = F.array(
        issue("error", "finite", "values that aren't finite", F.col("non_finite"), F.col("non_finite") > 0),
        issue("warning", "sign", "negative correlation", F.col("negative"), F.col("negative") > 0),
        issue("warning", "statistics", "mean outside 0.5 to 2", F.col("mean"), ~F.col("mean").between(0.5, 2.0)),
        issue("info", "statistics", "std above mean", F.col("std"), F.col("std") > F.col("mean")),
    )
    return s.select(F.explode(rows).alias("r")).where("r.on").select("r.severity", "r.category", "r.message", "r.parameter", "r.value")


#: What each level of repair does.
REPAIRS = {"disabled": (), "conservative": ("nan", "infinite"), "aggressive": ("nan", "infinite", "negative", "scale")}


def repair(cells: DataFrame, level: str = "conservative", only: tuple[str, ...] | None = None) -> DataFrame:
    """Repairs of a level, or those named in ``only``.

    ``nan`` puts NaN (and infinities, with ``infinite``) to their matrix's median; ``infinite`` alone puts them to
    its finite extremes; ``negative`` lifts negatives to 1e-6; ``scale`` undoes a wrong scale of all.
    """
    kinds = REPAIRS[level] if only is None else only
    x = F.col("c2")
    out = cells
    if "nan" in kinds or "infinite" in kinds:
        known = cells.withColumn("c2", finite(x))
        extremes = known.groupBy("angle_idx").agg(F.min("c2").alias("least"), F.max("c2").alias("most"))
        limits = F.broadcast(extremes.join(exact_percentiles(known, ["angle_idx"], "c2", {"mid": 0.5}), "angle_idx", "left"))
        fixed = finite(x)
        if "nan" in kinds:
            lost = x.isNull() | F.isnan(x)
            fixed = F.coalesce(fixed, F.when(lost | F.lit("infinite" in kinds), F.col("mid")).otherwise(x))
        else:
            fixed = F.coalesce(fixed, F.when(x == float("inf"), F.col("most")).when(x == float("-inf"), F.col("least")).otherwise(x))
        out = cells.join(limits, "angle_idx").select("angle_idx", "i", "j", fixed.alias("c2"))
    if "negative" in kinds:
        out = out.withColumn("c2", F.when(x < 0, 1e-6).otherwise(x))
    if "scale" in kinds:
        mean = F.broadcast(out.agg(F.avg("c2").alias("mean")))
        factor = F.when(F.col("mean") > 100, 0.01).when(F.col("mean") > 10, 0.1).when((F.col("mean") > 0) & (F.col("mean") < 0.01), 10.0).otherwise(1.0)
        out = out.crossJoin(mean).select("angle_idx", "i", "j", (x * factor).alias("c2"))
    return out


def artefact_free(cells: DataFrame) -> DataFrame:
    """Per matrix: whether every cell is finite and within -10 to 100."""
    return cells.groupBy("angle_idx").agg(F.bool_and(F.coalesce(finite(F.col("c2")).between(-10, 100), F.lit(False))).alias("clean"))


def retention(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: rows kept of those before, and the ratio of finite fractions."""
    a, b = (d.agg(F.count(F.lit(1)).alias(f"n_{s}"), F.avg(finite(F.col("c2")).isNotNull().cast("int")).alias(f"f_{s}")) for d, s in ((before, "before"), (after, "after")))
    return a.crossJoin(F.broadcast(b)).select((F.col("n_after") / F.col("n_before")).alias("retention"), (F.col("f_after") / F.col("f_before")).alias("fidelity"))


def component_hash(df: DataFrame) -> DataFrame:
    """One row: an order-free hash of all rows, to see whether a component changed.

    Sixty bits of each row's MD5 are summed, so that repeated rows count as often as they are there.
    """
    digest = F.md5(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns)))
    return df.agg(F.sum(F.conv(F.substring(digest, 1, 15), 16, 10).cast("decimal(20,0)")).cast("string").alias("hash"), F.count(F.lit(1)).alias("n"))


def fit_quality(reduced, condition, significance) -> Column:
    """good, marginal or poor."""
    band = F.when(reduced <= 2, "good").when(reduced <= 5, "marginal").otherwise("poor")
    return F.when((condition > 1e12) | (significance < 2), "poor").otherwise(band)
