"""Data sets in files: Parquet in and out, NPZ archives, text lists, JSON results, and what kind a path holds."""

from __future__ import annotations

import importlib.util
import io
import json
import math
import re
from collections.abc import Iterator
from pathlib import PurePosixPath

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import ALIASES, ANGLE, FRAME, Dataset

#: Limits of a loaded array.
MOST_FRAMES = 100_000
HDF5 = (".h5", ".hdf5", ".hdf")
#: What tells the two HDF5 layouts apart.
NEW_LAYOUT = ("xpcs/qmap/dynamic_v_list_dim0", "xpcs/twotime/correlation_map")
OLD_LAYOUT = ("xpcs/dqlist", "xpcs/dphilist", "exchange/C2T_all")


def detect_layout(names: set[str]) -> str:
    """aps_u, aps_old or unknown, from the names in a file or the columns of a table."""
    if set(NEW_LAYOUT) <= names:
        return "aps_u"
    return "aps_old" if set(OLD_LAYOUT) <= names else "unknown"


#: Shares and counts of the old layout's choice of wavevectors.
Q_SHARE, FEW_PAIRS, NEAREST_PAIRS = 0.1, 5, 10


def choose_old(q: np.ndarray, wanted: float) -> np.ndarray:
    """Numbers of the pairs within a tenth of the wavevector nearest to the wanted one; the ten nearest where those are under five."""
    chosen = q[np.argmin(np.abs(q - wanted))]
    near = np.flatnonzero(np.abs(q - chosen) <= Q_SHARE * chosen)
    return near if len(near) >= FEW_PAIRS else np.argsort(np.abs(q - chosen), kind="stable")[:NEAREST_PAIRS]


def choose_new(bins: np.ndarray, q: np.ndarray, phi: np.ndarray, wanted: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(numbers of matrices, their q, their phi) at the wavevector nearest to the wanted one; bins outside the grid are dropped."""
    number = np.asarray(bins, np.int64) - 1
    row, column = number // len(phi), number % len(phi)
    ok = np.flatnonzero((row >= 0) & (row < len(q)))
    if not len(ok):
        raise ValueError("no bin lies in the grid of q and phi")
    of = q[row[ok]]
    same = np.flatnonzero(np.abs(of - of[np.argmin(np.abs(of - wanted))]) < 1e-10)
    return ok[same], of[same], phi[column[ok[same]]]


def whole_matrix(half: np.ndarray) -> np.ndarray:
    """A stored half with its mirror image; the diagonal, which both have, once."""
    full = half + half.T
    np.fill_diagonal(full, np.diag(full) / 2)
    return full


def arrays_of(file, wanted_q: float) -> dict[str, np.ndarray]:
    """c2, q and phi of an open file (a mapping of names, with groups as mappings) in either layout; only what is chosen is read."""

    def have(name: str) -> bool:
        try:
            file[name]
        except KeyError:
            return False
        return True

    layout = detect_layout({n for n in (*NEW_LAYOUT, *OLD_LAYOUT) if have(n)})
    if layout == "aps_old":
        q, phi = (np.asarray(file[n][()] if hasattr(file[n], "shape") else file[n]).reshape(-1) for n in OLD_LAYOUT[:2])
        group, chosen = file[OLD_LAYOUT[2]], choose_old(q, wanted_q)
        keys = list(group)  # in the order of the pairs
        q, phi = q[chosen], phi[chosen]
    elif layout == "aps_u":
        every = (np.asarray(file[n][()]) for n in ("xpcs/twotime/processed_bins", NEW_LAYOUT[0], "xpcs/qmap/dynamic_v_list_dim1"))
        chosen, q, phi = choose_new(*every, wanted_q)
        group = file[NEW_LAYOUT[1]]
        keys = sorted(group)
    else:
        raise ValueError("neither layout of correlation files")
    return {"c2_exp": np.stack([whole_matrix(np.asarray(group[keys[k]][()], float)) for k in chosen.tolist()]), "wavevector_q_list": q, "phi_angles_list": phi}


def read_hdf5(spark: SparkSession, path: str, wanted_q: float, dt: float = 1.0, finite: bool = True) -> DataFrame:
    """The rows of ``read_npz`` from correlation files in HDF5, where h5py is installed; every file is one task's work."""
    if importlib.util.find_spec("h5py") is None:
        raise NotImplementedError("reading HDF5 needs h5py; convert the file to NPZ or Parquet")

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import h5py

        for frame in frames:
            for name, content in zip(frame["path"], frame["content"]):
                with h5py.File(io.BytesIO(content), "r") as f:
                    arrays = arrays_of(f, wanted_q)
                t = np.arange(arrays["c2_exp"].shape[1]) * dt
                yield from _cells_of(name, arrays | {"t1": t, "t2": t}, finite)

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.{h5,hdf5,hdf}").load(path).select("path", "content").mapInPandas(parse, _CELLS)


def resolve_alias(names, wanted: str) -> str:
    """The first alias of ``wanted`` that is there."""
    for name in ALIASES[wanted]:
        if name in names:
            return name
    raise KeyError(f"no {wanted}: expected one of {', '.join(ALIASES[wanted])}")


def check_arrays(arrays: dict[str, np.ndarray], finite: bool = True) -> None:
    """Refuse what isn't a data set: object arrays, wrong shapes, too many frames, time that falls; and, with ``finite``, values that aren't finite;
    without it those are left to the repair operators.
    """
    for name, a in arrays.items():
        if a.dtype == object:
            raise ValueError(f"{name} holds objects")
    c2 = arrays[resolve_alias(arrays, "c2")]
    if c2.ndim != 3 or c2.shape[1] != c2.shape[2]:
        raise ValueError(f"c2 must be (angles, frames, frames), not {c2.shape}")
    if not 1 <= c2.shape[1] <= MOST_FRAMES:
        raise ValueError(f"{c2.shape[1]} frames; 1 to {MOST_FRAMES} are allowed")
    if finite and not np.isfinite(c2).all():
        raise ValueError("c2 holds values that aren't finite")
    for name in ("t1", "t2"):
        t = arrays[name]
        if t.ndim != 1:
            raise ValueError(f"{name} must be one-dimensional")
        if (np.diff(t) < 0).any():
            raise ValueError(f"{name} falls")


def read_npz(spark: SparkSession, path: str, finite: bool = True) -> DataFrame:
    """Cells of NPZ archives: (file, angle_idx, i, j, t1, t2, q, phi, c2), parsed where the files are, without pickles.

    Works for one archive or a folder of them; every file is one task's work.
    """

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for file, content in zip(frame["path"], frame["content"]):
                with np.load(io.BytesIO(content), allow_pickle=False) as z:
                    arrays = {k: z[k] for k in z.files}
                yield from _cells_of(file, arrays, finite)

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").load(path).select("path", "content").mapInPandas(parse, _CELLS)


_CELLS = "file string, angle_idx int, i int, j int, t1 double, t2 double, q double, phi double, c2 double"


def _cells_of(file: str, arrays: dict[str, np.ndarray], finite: bool) -> Iterator[pd.DataFrame]:
    check_arrays(arrays, finite)
    c2, q, phi = (arrays[resolve_alias(arrays, k)] for k in ("c2", "q", "phi"))
    q = np.broadcast_to(np.atleast_1d(q), len(phi))
    n = c2.shape[1]
    i, j = np.repeat(np.arange(n), n), np.tile(np.arange(n), n)
    for a in range(len(c2)):
        yield pd.DataFrame({"file": file, "angle_idx": a, "i": i, "j": j, "t1": arrays["t1"][i].astype(float), "t2": arrays["t2"][j].astype(float), "q": float(q[a]), "phi": float(phi[a]), "c2": c2[a].ravel().astype(float)})


def from_long(cells: DataFrame, dt: float = 1.0) -> Dataset:
    """A data set from long rows as ``read_npz`` gives them (one file)."""
    angle = cells.select("angle_idx", F.lit("").alias("name"), "q", "phi").distinct()
    frame = cells.where("angle_idx = 0 AND j = 0").select("i", F.col("t1").alias("t"))
    return Dataset(cells.select("angle_idx", "i", "j", "c2"), angle, frame, dt)


def write_dataset(d: Dataset, path: str) -> None:
    """Parquet: cells partitioned by angle, so that an angle filter prunes folders; dimensions beside; one metadata row."""
    d.c2.repartition("angle_idx", F.floor(F.col("i") / 256)).sortWithinPartitions("angle_idx", "i", "j").write.mode("errorifexists").partitionBy("angle_idx").parquet(f"{path}/c2")
    d.angle.coalesce(1).write.parquet(f"{path}/angle")
    d.frame.coalesce(1).write.parquet(f"{path}/frame")
    meta = d.angle.agg(F.avg("q").alias("q_mean"), F.stddev_pop("q").alias("q_std"), F.count("q").alias("n_q"), F.count("phi").alias("n_phi"))
    meta.crossJoin(d.frame.agg(F.min("i").alias("first_frame"), F.max("i").alias("last_frame"))).withColumns({"dt": F.lit(d.dt), "length": F.lit(d.length)}).coalesce(1).write.parquet(f"{path}/meta")


def read_dataset(spark: SparkSession, path: str, q: float | None = None) -> Dataset:
    """A data set as ``write_dataset`` left it; with ``q``, it must be the stored mean to 1e-8."""
    meta = spark.read.parquet(f"{path}/meta").first()
    if q is not None and abs(meta["q_mean"] - q) > 1e-8:
        raise ValueError(f"the cache holds q = {meta['q_mean']}, not {q}")
    cells = spark.read.schema("i int, j int, c2 double, angle_idx int").parquet(f"{path}/c2").select("angle_idx", "i", "j", "c2")
    return Dataset(cells, spark.read.schema(ANGLE).parquet(f"{path}/angle"), spark.read.schema(FRAME).parquet(f"{path}/frame"), meta["dt"], meta["length"])


def load(spark: SparkSession, source: str, cache: str | None = None, wanted_q: float = 0.0, dt: float = 1.0, finite: bool = True) -> Dataset:
    """An NPZ archive, an HDF5 file, or a Parquet data set, read through ``cache`` where one is named."""
    if source.endswith((".npz", *HDF5)):
        read = (lambda: from_long(read_npz(spark, source, finite))) if source.endswith(".npz") else (lambda: from_long(read_hdf5(spark, source, wanted_q, dt, finite), dt))
        if cache is None:
            return read()
        try:
            return read_dataset(spark, cache)
        except Exception as e:  # no cache yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
        write_dataset(read(), cache)
        return read_dataset(spark, cache)
    return read_dataset(spark, source)


def file_name(template: str, **values) -> str:
    """``${name}`` placeholders filled in; the result must be a bare file name."""
    name = re.sub(r"\$\{(\w+)\}", lambda m: str(values[m[1]]), template)
    if name != PurePosixPath(name).name or name in ("", ".", ".."):
        raise ValueError(f"not a file name: {name!r}")
    return name


def safe_path(base: str, name: str, allowed: tuple[str, ...] = (".parquet", ".json", ".npz", ".txt")) -> str:
    """``name`` under ``base``: no way out of it, only known suffixes."""
    p = PurePosixPath(name)
    if p.is_absolute() or ".." in p.parts or p.suffix not in allowed:
        raise ValueError(f"not a path to save to: {name!r}")
    return f"{base.rstrip('/')}/{p}"


def json_safe(x):
    """A value as JSON has it: NaN is null, infinities and complex numbers are text or parts, long arrays are refused."""
    if isinstance(x, dict):
        return {str(k): json_safe(v) for k, v in x.items()}
    if isinstance(x, np.ndarray):
        if x.size > 1000:
            raise ValueError(f"array of {x.size} elements; keep arrays in Parquet")
        return json_safe(x.tolist())
    if isinstance(x, (list, tuple)):
        return [json_safe(v) for v in x]
    if isinstance(x, (complex, np.complexfloating)):
        return {"real": json_safe(x.real), "imag": json_safe(x.imag)}
    if isinstance(x, (float, np.floating)):
        return None if math.isnan(x) else ("Infinity" if x > 0 else "-Infinity") if math.isinf(x) else float(x)
    return x.item() if isinstance(x, np.generic) else x


def write_result(spark: SparkSession, fit, names: list[str], fitted: DataFrame, path: str) -> None:
    """A fit's parameters and summary as JSON lines, its fitted cells as Parquet by angle."""
    rows = [(n, float(v), float(u)) for n, v, u in zip(names, fit.parameters, fit.uncertainties)]
    spark.createDataFrame(rows, "name string, value double, stderr double").coalesce(1).write.json(f"{path}/parameters")
    summary = json.dumps(json_safe({"chi_squared": fit.chi_squared, "reduced_chi_squared": fit.reduced_chi_squared, "n": fit.n, "iterations": fit.iterations, "converged": fit.converged}))
    spark.createDataFrame([(summary,)], "value string").coalesce(1).write.text(f"{path}/summary")
    fitted.write.partitionBy("angle_idx").parquet(f"{path}/fitted")


def write_text_lists(angle: DataFrame, path: str) -> None:
    """The angles as %.6f and the wavevectors as %.8e, one a line."""
    angle.orderBy("angle_idx").select(F.format_string("%.6f", "phi")).coalesce(1).write.text(f"{path}/phi_list")
    angle.orderBy("angle_idx").select(F.format_string("%.8e", "q")).coalesce(1).write.text(f"{path}/q_list")


