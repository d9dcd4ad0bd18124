"""NPZ archives as a Spark data source: a matrix of an archive is a task, and a matrix is written only if it is whole.

    archives.register(spark)
    spark.read.format("matrix_archive").load(path)                 # an archive or a folder of them
    archives.write(cells, path)                                    # one archive an angle

Only headers are read to plan. A task seeks to its matrix in the archive
(member stored as it is; a compressed one is unpacked up to there) and passes
it on some rows at a time. Paths are of a file system that the driver and all
executors have mounted; ``files.read_npz`` reads from any store that Spark
reads, one archive a task.
"""

from __future__ import annotations

import glob
import os
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from numpy.lib import format as npy
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .files import MOST_FRAMES, resolve_alias

NAME = "matrix_archive"
SCHEMA = "file string, angle_idx int, i int, j int, t1 double, t2 double, q double, phi double, c2 double"
#: Cells that a task passes on at a time.
CELLS = 1 << 18


def _header(member) -> tuple[tuple[int, ...], bool, np.dtype]:
    """(shape, column-major, type) of a member that is open at its beginning; leaves it at the data."""
    version = npy.read_magic(member)
    shape, fortran, dtype = (npy.read_array_header_1_0 if version == (1, 0) else npy.read_array_header_2_0)(member)
    if dtype.hasobject:
        raise ValueError("an array holds objects")
    return shape, fortran, dtype


def _members(archive: zipfile.ZipFile) -> dict[str, str]:
    return {n.removesuffix(".npy"): n for n in archive.namelist()}


def matrix_shape(path: str) -> tuple[int, int]:
    """(angles, frames) of an archive, from the header of its matrices."""
    with zipfile.ZipFile(path) as archive:
        names = _members(archive)
        with archive.open(names[resolve_alias(names, "c2")]) as member:
            shape = _header(member)[0]
    if len(shape) != 3 or shape[1] != shape[2]:
        raise ValueError(f"{path}: c2 must be (angles, frames, frames), not {shape}")
    if not 1 <= shape[1] <= MOST_FRAMES:
        raise ValueError(f"{path}: {shape[1]} frames; 1 to {MOST_FRAMES} are allowed")
    return shape[0], shape[1]


@dataclass
class Matrix(InputPartition):
    path: str
    angle: int


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Matrix]:
        found = sorted(glob.glob(f"{glob.escape(self.path)}/*.npz")) if os.path.isdir(self.path) else [self.path]
        return [Matrix(f, a) for f in found for a in range(matrix_shape(f)[0])]

    def read(self, partition: Matrix) -> Iterator[pa.RecordBatch]:
        a = partition.angle
        with zipfile.ZipFile(partition.path) as archive:
            names = _members(archive)

            def small(name: str) -> np.ndarray:
                with archive.open(names[name]) as member:
                    return npy.read_array(member, allow_pickle=False)

            t1, t2, phi = small("t1").astype(float), small("t2").astype(float), small(resolve_alias(names, "phi"))
            q = np.broadcast_to(np.atleast_1d(small(resolve_alias(names, "q"))), len(phi))
            with archive.open(names[resolve_alias(names, "c2")]) as member:
                (_, n, _), fortran, dtype = _header(member)
                if fortran:  # of another order: the whole array has to be turned
                    whole = np.frombuffer(member.read(), dtype).reshape((n, n, -1)).T
                else:
                    member.seek(member.tell() + a * n * n * dtype.itemsize)
                rows = max(1, CELLS // n)
                for lo in range(0, n, rows):
                    hi = min(n, lo + rows)
                    c2 = whole[a, lo:hi] if fortran else np.frombuffer(member.read((hi - lo) * n * dtype.itemsize), dtype).reshape(-1, n)
                    i, j = np.repeat(np.arange(lo, hi, dtype=np.int32), n), np.tile(np.arange(n, dtype=np.int32), hi - lo)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([partition.path] * len(i), pa.string()), pa.array(np.full(len(i), a, np.int32)), pa.array(i), pa.array(j), pa.array(t1[i]), pa.array(t2[j]), pa.array(np.full(len(i), float(q[a]))), pa.array(np.full(len(i), float(phi[a]))), pa.array(c2.astype(float).ravel())],
                        ["file", "angle_idx", "i", "j", "t1", "t2", "q", "phi", "c2"],
                    )


@dataclass
class _Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class _Writer(DataSourceArrowWriter):
    """Rows come by angle; each angle's matrix must have every cell once."""

    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        from pyspark import TaskContext

        task, files = TaskContext.get().taskAttemptId(), []
        os.makedirs(self.path, exist_ok=True)

        def save(a: int, parts: list[pa.Table]) -> None:
            rows = pa.concat_tables(parts)
            i, j = (rows.column(k).to_numpy() for k in ("i", "j"))
            n = int(max(i.max(), j.max())) + 1
            place = i.astype(np.int64) * n + j
            if len(place) != n * n or len(np.unique(place)) != n * n or place.min() < 0:
                raise ValueError(f"angle {a}: {len(place)} cells don't fill {n} x {n}")
            c2 = np.empty(n * n)
            c2[place] = rows.column("c2").to_numpy()
            t1, t2 = np.empty(n), np.empty(n)
            t1[i], t2[j] = rows.column("t1").to_numpy(), rows.column("t2").to_numpy()
            name = f"angle-{a:05d}.npz"
            with open(f"{self.path}/.{name}.{task}", "wb") as f:
                np.savez(f, c2_exp=c2.reshape(1, n, n), t1=t1, t2=t2, wavevector_q_list=np.array([rows.column("q")[0].as_py()]), phi_angles_list=np.array([rows.column("phi")[0].as_py()]))
            files.append((f"{self.path}/.{name}.{task}", f"{self.path}/{name}"))

        now, held = None, []
        for batch in iterator:
            table = pa.Table.from_batches([batch])
            angles = table.column("angle_idx").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(angles)) + 1).tolist(), len(angles)]
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                if lo == hi:
                    continue
                if held and angles[lo] != now:
                    save(now, held)
                    held = []
                now = int(angles[lo])
                held.append(table.slice(lo, hi - lo))
        if held:
            save(now, held)
        return _Written(files)

    def commit(self, messages: list) -> None:
        for m in messages:
            for made, name in m.files if m else ():
                os.replace(made, name)

    def abort(self, messages: list) -> None:
        for m in messages:
            for made, _ in m.files if m else ():
                os.remove(made)


class MatrixArchives(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(MatrixArchives)


def write(cells: DataFrame, path: str) -> None:
    """One archive an angle from (angle_idx, i, j, t1, t2, q, phi, c2): a matrix is a task; one that isn't whole is refused, and none appears."""
    register(cells.sparkSession)
    columns = cells.select(F.lit("").alias("file"), "angle_idx", *(F.col(c).cast(t).alias(c) for c, t in (x.split() for x in SCHEMA.split(", ")[2:])))
    columns.repartition("angle_idx").sortWithinPartitions("angle_idx").write.format(NAME).mode("append").save(path)
