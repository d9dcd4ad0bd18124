"""Shared helpers: tables in the cluster's shared folder, and hashing of text columns."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import reduce, wraps
from operator import and_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or the session's checkpoint directory where that is unset.

    Without either, a local session (tests) gets a temporary folder; on a cluster there is none that all could reach.
    """
    context = spark.sparkContext
    own = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not own:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="duochron-"))
        own = context.getCheckpointDir()
    return own.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call gets."""
    return f"{shared_dir(spark)}/duochron/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage ends there, lost executors cost nothing."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Return this process's unused memory to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow; as the worker stays for later tasks, what the allocators hoard (a hundred MB and more) is given back at the end."""

    @wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def let_go(spark: SparkSession) -> None:
    """Have the driver's JVM drop what no plan refers to any more (old broadcasts, and with their shuffles the files) and shrink its heap."""
    gc.collect()  # Python's references to plans
    spark.sparkContext._jvm.System.gc()


#: A side of at most so many rows is broadcast; a larger one is shuffled.
BROADCAST_ROWS = 300_000
#: The same where a query has many such joins: a broadcast row takes up to 140 bytes, three times over in the driver, and old ones stay for a while.
FEW_ROWS = 50_000
#: Parts of a hot key where both sides are shuffled.
JOIN_SALTS = 16


def is_small(df: DataFrame, most: int | None = None) -> bool:
    """Whether the rows of ``df``, which are counted, are at most ``most`` and BROADCAST_ROWS."""
    most = BROADCAST_ROWS if most is None else min(most, BROADCAST_ROWS)
    return df.limit(most + 1).count() <= most


def bounded(df: DataFrame, most: int | None = None) -> DataFrame:
    """``df``, to be broadcast if its rows were counted to be few."""
    return F.broadcast(df) if is_small(df, most) else df


def join_small(df: DataFrame, other: DataFrame, *keys: str, how: str = "inner", most: int | None = None) -> DataFrame:
    """``df`` joined with ``other``, whose keys are unique: broadcast if few, else with each key of ``df`` dealt over JOIN_SALTS parts.

    Null keys match null keys. ``how`` is inner or left.
    """
    names = {k: f"__{k}" for k in keys}
    right = other.withColumnsRenamed(names)
    equal = [F.col(k).eqNullSafe(F.col(names[k])) for k in keys]
    if is_small(other, most):
        right = F.broadcast(right)
    else:
        df = df.withColumn("__salt", F.pmod(F.xxhash64(*df.columns), F.lit(JOIN_SALTS)))
        right = right.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(JOIN_SALTS - 1))))
        equal.append(F.col("__salt") == F.col("__part"))
    return df.join(right, reduce(and_, equal), how).drop(*names.values(), "__salt", "__part")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8_size(text: Column) -> Column:
    """UTF-8 bytes of a string column; null has none."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def text_key(text: Column) -> Column:
    """SHA-256 of the text as binary; null has the empty key, so that it equals only null."""
    return F.coalesce(F.unhex(F.sha2(text, 256)), F.lit(b""))


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
