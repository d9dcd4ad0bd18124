"""Repair, normalisation and denoising of correlation matrices held as cells."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import exact_percentiles

#: Keys of one matrix.
BY = ["angle_idx"]


def _replace_diagonal(cells: DataFrame, diagonal: DataFrame) -> DataFrame:
    """Cells with the diagonal values of (angle_idx, i, d) where there are any.

    Only the diagonal (one row in N) is joined; the rest streams by.
    """
    on = cells.where(F.col("i") == F.col("j")).join(diagonal, [*BY, "i"], "left").select("angle_idx", "i", "j", F.coalesce("d", "c2").alias("c2"))
    return cells.where(F.col("i") != F.col("j")).select("angle_idx", "i", "j", "c2").unionByName(on)


def _band(cells: DataFrame, width: int) -> DataFrame:
    """Off-diagonal cells within ``width`` of the diagonal, each given to both of its frames' diagonal cells."""
    near = cells.where((F.col("i") != F.col("j")) & (F.abs(F.col("i") - F.col("j")) <= width))
    return near.select("angle_idx", F.col("i").alias("at"), "i", "j", "c2").unionByName(near.select("angle_idx", F.col("j").alias("at"), "i", "j", "c2"))


def diagonal_basic(cells: DataFrame) -> DataFrame:
    """Each diagonal cell from the means of its neighbouring side-band pairs; the ends have one."""
    side = cells.where(F.abs(F.col("i") - F.col("j")) == 1).groupBy(*BY, F.least("i", "j").alias("k")).agg((F.sum("c2") / 2).alias("s"))
    spread = side.select("angle_idx", F.col("k").alias("i"), "s").unionByName(side.select("angle_idx", (F.col("k") + 1).alias("i"), "s"))
    return _replace_diagonal(cells, spread.groupBy(*BY, "i").agg(F.avg("s").alias("d")))


def diagonal_statistical(cells: DataFrame, width: int = 3, estimator: str = "median", trim: float = 0.2) -> DataFrame:
    """Each diagonal cell from its row's and column's finite neighbours up to ``width`` away."""
    near = _band(cells, width).where(~F.isnan("c2")).select("angle_idx", F.col("at").alias("i"), "c2")
    if estimator == "median":
        d = near.groupBy(*BY, "i").agg(F.median("c2").alias("d"))
    elif estimator == "mean":
        d = near.groupBy(*BY, "i").agg(F.avg("c2").alias("d"))
    elif estimator == "trimmed_mean":
        w = Window.partitionBy(*BY, "i")  # 4 * width cells at most
        ranked = near.withColumns({"r": F.row_number().over(w.orderBy("c2")), "n": F.count(F.lit(1)).over(w)})
        cut = F.floor(F.lit(trim) * F.col("n"))
        d = ranked.where((F.col("r") > cut) & (F.col("r") <= F.col("n") - cut)).groupBy(*BY, "i").agg(F.avg("c2").alias("d"))
    else:
        raise ValueError(f"no such estimator: {estimator}")
    return _replace_diagonal(cells, d)


def diagonal_interpolation(cells: DataFrame, method: str = "linear") -> DataFrame:
    """Inside, the mean of the cells above and below; the ends copy their inner neighbour."""
    if method != "linear":
        raise NotImplementedError(f"{method} interpolation")
    last = cells.groupBy(*BY).agg(F.max("i").alias("last"))
    near = cells.where(F.abs(F.col("i") - F.col("j")) == 1).join(F.broadcast(last), BY)
    inner = near.where((F.col("j") > 0) & (F.col("j") < F.col("last"))).groupBy(*BY, F.col("j").alias("k")).agg(F.avg("c2").alias("d"))
    ends = near.where(((F.col("i") == 0) & (F.col("j") == 1)) | ((F.col("i") == F.col("last") - 1) & (F.col("j") == F.col("last"))))
    ends = ends.select("angle_idx", F.when(F.col("i") == 0, F.lit(0)).otherwise(F.col("j")).alias("k"), F.col("c2").alias("d"))
    return _replace_diagonal(cells, inner.unionByName(ends).withColumnRenamed("k", "i"))


def correct_diagonal(cells: DataFrame, method: str = "basic", **options) -> DataFrame:
    return {"basic": diagonal_basic, "statistical": diagonal_statistical, "interpolation": diagonal_interpolation}[method](cells, **options)


def normalise(cells: DataFrame, method: str, low: float = 0.25, high: float = 0.75, eps: float = 1e-12) -> DataFrame:
    """Per matrix: baseline, statistical, minmax, robust or physics_based.

    Statistics are one aggregation per matrix joined back (partial sums on the
    map side), not a window that gathers a matrix in a task.
    """
    origin = F.max(F.when((F.col("i") == 0) & (F.col("j") == 0), F.col("c2")))
    x = F.col("c2")
    aggregates, result = {
        "baseline": ([origin.alias("o")], F.when(F.abs("o") > eps, x / F.col("o")).otherwise(x)),
        "statistical": ([F.avg("c2").alias("m"), F.stddev_pop("c2").alias("s")], F.when(F.col("s") > eps, (x - F.col("m")) / F.col("s")).otherwise(x)),
        "minmax": ([F.min("c2").alias("lo"), F.max("c2").alias("hi")], F.when(F.col("hi") - F.col("lo") > eps, (x - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(x)),
        "robust": (None, F.when(F.col("hi") - F.col("lo") > eps, (x - F.col("m")) / (F.col("hi") - F.col("lo"))).otherwise(x)),
        "physics_based": ([F.max("c2").alias("hi"), origin.alias("o")], None),
    }[method]
    if result is None:
        scaled = F.when(F.abs("hi") > eps, x / F.col("hi")).otherwise(x)
        first = F.when(F.abs("hi") > eps, F.col("o") / F.col("hi")).otherwise(F.col("o"))
        result = F.when((first < 1) & (F.abs(first) > eps), scaled / first).otherwise(scaled)
    statistics = cells.groupBy(*BY).agg(*aggregates) if aggregates else exact_percentiles(cells, BY, "c2", {"m": 0.5, "lo": low, "hi": high})
    return cells.join(F.broadcast(statistics), BY).select("angle_idx", "i", "j", result.alias("c2"))


#: Rows and columns of a tile.
TILE = 256


#: What a stencil finds beyond a matrix: its cells reflected, 0, or NaN.
EDGES = ("reflect", "zero", "open")


def stencil(cells: DataFrame, r: int, kernel: Callable[..., np.ndarray | tuple[np.ndarray, ...]], tile: int = TILE, edges: str = "reflect", outputs: tuple[str, ...] = ("c2",)) -> DataFrame:
    """Every cell from the (2r + 1)-square around it: ``kernel`` takes an array with r more on each side and gives the ``outputs``; with open edges it also takes the first row, the first column and the size.

    Matrices are cut into tiles; a tile also gets the cells within r of it, so that each cell moves once, a few twice.
    """
    if edges not in EDGES:
        raise ValueError(f"no such edges: {edges}")
    n = F.broadcast(cells.groupBy(*BY).agg((F.max("i") + 1).alias("n")))  # one row a matrix

    def places(axis: str):
        """(tile, place) of every tile that needs this row or column, as itself or reflected at an edge."""
        k, size = F.col(axis), F.col("n")
        seen = F.array_compact(F.array(k, F.when(k < r, -k - 1), F.when(k >= size - r, 2 * size - 1 - k))) if edges == "reflect" else F.array(k)
        last = F.floor((size - 1) / tile)

        def tiles(at):
            first = F.greatest(F.floor((at - r) / tile), F.lit(0))
            to = F.least(F.floor((at + r) / tile), last)
            return F.when(first <= to, F.transform(F.sequence(first, to), lambda t: F.struct(t.cast("int").alias("t"), (at - t * tile + r).cast("int").alias("at"))))

        return F.flatten(F.array_compact(F.transform(seen, tiles)))

    dealt = cells.select("angle_idx", "i", "j", "c2").join(n, BY).withColumn("x", F.explode(places("i"))).withColumn("y", F.explode(places("j")))
    dealt = dealt.select("angle_idx", F.col("x.t").alias("ti"), F.col("y.t").alias("tj"), F.col("x.at").alias("x"), F.col("y.at").alias("y"), "c2", "n")

    def smooth(rows: pa.Table) -> pa.Table:
        x, y, v = (rows.column(k).to_numpy() for k in ("x", "y", "c2"))
        angle, ti, tj, size = (rows.column(k)[0].as_py() for k in ("angle_idx", "ti", "tj", "n"))
        height, width = (min(tile, size - t * tile) for t in (ti, tj))
        a = np.full((height + 2 * r, width + 2 * r), 0.0 if edges == "zero" else np.nan)
        ok = (x < height + 2 * r) & (y < width + 2 * r)
        a[x[ok], y[ok]] = v[ok]
        own = np.zeros((height, width), bool)
        inside = (x >= r) & (x < r + height) & (y >= r) & (y < r + width)
        own[x[inside] - r, y[inside] - r] = True
        i, j = np.nonzero(own)
        made = kernel(a, ti * tile, tj * tile, size) if edges == "open" else kernel(a)
        made = made if isinstance(made, tuple) else (made,)
        return pa.table({"angle_idx": pa.array(np.full(len(i), angle, np.int32)), "i": pa.array((i + ti * tile).astype(np.int32)), "j": pa.array((j + tj * tile).astype(np.int32)), **{k: pa.array(x[i, j]) for k, x in zip(outputs, made)}})

    return dealt.groupBy("angle_idx", "ti", "tj").applyInArrow(smooth, "angle_idx int, i int, j int, " + ", ".join(f"{k} double" for k in outputs))


def median_filter(cells: DataFrame, size: int = 3) -> DataFrame:
    """Median over size x size cells, edges reflected."""

    def kernel(a: np.ndarray) -> np.ndarray:
        around = np.lib.stride_tricks.sliding_window_view(a, (size, size))
        return np.concatenate([np.median(rows, axis=(2, 3)) for rows in np.array_split(around, max(1, len(around) // 32))])

    return stencil(cells, size // 2, kernel)


def gaussian_filter(cells: DataFrame, sigma: float = 1.0, truncate: float = 4.0) -> DataFrame:
    """Separable Gaussian, edges reflected; two weighted sums along i and j."""
    r = int(truncate * sigma + 0.5)
    weights = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    weights /= weights.sum()

    def kernel(a: np.ndarray) -> np.ndarray:
        down = sum(w * a[k : len(a) - 2 * r + k] for k, w in enumerate(weights))
        return sum(w * down[:, k : down.shape[1] - 2 * r + k] for k, w in enumerate(weights))

    return stencil(cells, r, kernel)


def wiener_filter(cells: DataFrame, size: int = 3, noise: float | None = None) -> DataFrame:
    """Adaptive filter by local mean and variance over size x size cells; outside the matrix is 0."""
    r, area = size // 2, size * size

    def kernel(a: np.ndarray) -> tuple[np.ndarray, ...]:
        def box(x: np.ndarray) -> np.ndarray:
            down = sum(x[k : len(x) - 2 * r + k] for k in range(size))
            return sum(down[:, k : down.shape[1] - 2 * r + k] for k in range(size))

        m = box(a) / area
        return a[r : len(a) - r, r : a.shape[1] - r], m, box(a * a) / area - m * m

    local = stencil(cells, r, kernel, edges="zero", outputs=("c2", "m", "v"))
    if noise is None:
        local = local.join(F.broadcast(local.groupBy(*BY).agg(F.avg("v").alias("noise"))), BY)  # one row a matrix
    else:
        local = local.withColumn("noise", F.lit(noise))
    gain = 1 - F.col("noise") / F.greatest("v", F.lit(1e-300))
    return local.select("angle_idx", "i", "j", F.when(F.col("v") < F.col("noise"), F.col("m")).otherwise(F.col("m") + gain * (F.col("c2") - F.col("m"))).alias("c2"))


def savgol_filter(cells: DataFrame, window: int = 5, order: int = 2) -> DataFrame:
    """Polynomial smoothing along rows, then columns; the ends by the polynomial of the first and last window.

    A tile has the cells within a window of it, so both directions are done at once. A matrix of fewer frames than the window stays as it is.
    """
    positions = np.arange(window)
    vander = np.vander(positions, order + 1, increasing=True).astype(float)
    hat = vander @ np.linalg.pinv(vander)  # row k: the fitted value at place k of a window
    r, rim = window // 2, window - 1

    def along(a: np.ndarray, start: int, n: int) -> np.ndarray:
        """Rows of ``a`` smoothed, without their rim; the first column inside it is the matrix's ``start``."""
        width = a.shape[1] - 2 * rim
        out = sum(hat[r][k] * a[:, rim - r + k : rim - r + k + width] for k in range(window))
        for k in range(r):
            for place, first, row in ((k, 0, k), (n - 1 - k, n - window, window - 1 - k)):
                if start <= place < start + width:
                    out[:, place - start] = a[:, rim - start + first : rim - start + first + window] @ hat[row]
        return out

    def kernel(a: np.ndarray, i: int, j: int, n: int) -> np.ndarray:
        if n < window:
            return a[rim : len(a) - rim, rim : a.shape[1] - rim]
        return along(along(a, j, n).T, i, n).T

    return stencil(cells, rim, kernel, edges="open")


def denoise(cells: DataFrame, method: str, **options) -> DataFrame:
    return {"median": median_filter, "gaussian": gaussian_filter, "wiener": wiener_filter, "savgol": savgol_filter}[method](cells, **options)


def standardise(cells: DataFrame) -> DataFrame:
    return cells.select(F.col("angle_idx").cast("int").alias("angle_idx"), F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), F.col("c2").cast("double").alias("c2"))


def preprocess(cells: DataFrame, diagonal: str | None = "statistical", normalisation: str | None = None, noise: str | None = None) -> DataFrame:
    """Diagonal, normalisation, denoising, types, each optional, and always the basic diagonal correction at the end."""
    if diagonal:
        cells = correct_diagonal(cells, diagonal)
    if normalisation:
        cells = normalise(cells, normalisation)
    if noise:
        cells = denoise(cells, noise)
    return diagonal_basic(standardise(cells))
