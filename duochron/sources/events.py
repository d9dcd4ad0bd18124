"""A data set from an event table: products of normalised intensity fluctuations per angle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import ANGLE, Dataset

#: The event types stand for angles (degrees).
ANGLES = [(0, "click", 0.005, -170.0), (1, "error", 0.006, -90.0), (2, "purchase", 0.007, 5.0), (3, "signup", 0.008, 85.0), (4, "view", 0.009, 175.0)]
START_DAY = 19723
#: Steps of a day, and frames of a data set.
STEPS = {"day": (1, 30), "hour": (24, 720)}


def angle_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ANGLES, ANGLE)


def frame_table(spark: SparkSession, n: int, dt: float = 1.0, first: int = 0) -> DataFrame:
    return spark.range(n).select(F.col("id").cast("int").alias("i"), ((F.col("id") + first) * dt).cast("double").alias("t"))


def intensity(spark: SparkSession, sf_dir: str, step: str = "day") -> DataFrame:
    """(angle_idx, i, cents), every pair present: cents summed as integers, so any engine gets the same.

    The data set is defined on these five angles and thirty days; events of other types or days are no part of it.
    """
    of_day, n = STEPS[step]
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("ts", "event_type", "value")
    # ts has no zone, and none comes in: the time since 1970 of two zone-less values.
    since = "(CAST(ts AS TIMESTAMP_NTZ) - TIMESTAMP_NTZ'1970-01-01 00:00:00')"
    i = F.expr(f"CAST((EXTRACT(DAY FROM {since}) - {START_DAY}) * {of_day} + FLOOR(EXTRACT(HOUR FROM {since}) * {of_day} / 24) AS INT)")
    sums = events.select(F.col("event_type").alias("name"), i.alias("i"), F.round(F.col("value") * 100).cast("long").alias("cents")).groupBy("name", "i").agg(F.sum("cents").alias("cents"))
    grid = F.broadcast(angle_table(spark).select("angle_idx", "name")).crossJoin(frame_table(spark, n).select("i"))
    return grid.join(sums, ["name", "i"], "left").select("angle_idx", "i", F.coalesce("cents", F.lit(0)).alias("cents"))


def events_dataset(spark: SparkSession, sf_dir: str, step: str = "day") -> Dataset:
    """c2 = 1 + (I_i - mu)(I_j - mu) / mu**2 for each angle and pair of frames."""
    cents = intensity(spark, sf_dir, step)
    mean = cents.groupBy("angle_idx").agg(F.avg("cents").alias("mu"))
    frames = cents.join(F.broadcast(mean), "angle_idx").select("angle_idx", "i", (F.col("cents") - F.col("mu")).alias("d"), "mu")
    other = F.broadcast(frames.select("angle_idx", F.col("i").alias("j"), F.col("d").alias("dj")))  # angles x frames rows
    cells = frames.join(other, "angle_idx").select("angle_idx", "i", "j", (1 + F.col("d") * F.col("dj") / (F.col("mu") * F.col("mu"))).alias("c2"))
    return Dataset(cells, angle_table(spark), frame_table(spark, STEPS[step][1]))


#: The same tables in DuckDB SQL, as the beginning of a WITH clause.
SQL = """
WITH angle(angle_idx, name, q, phi) AS (VALUES (0, 'click', 0.005::DOUBLE, -170.0::DOUBLE), (1, 'error', 0.006::DOUBLE, -90.0::DOUBLE), (2, 'purchase', 0.007::DOUBLE, 5.0::DOUBLE), (3, 'signup', 0.008::DOUBLE, 85.0::DOUBLE), (4, 'view', 0.009::DOUBLE, 175.0::DOUBLE)),
frame AS (SELECT r::INTEGER AS i, r::DOUBLE AS t FROM range(30) x(r)),
sums AS (SELECT event_type AS name, ((epoch_us(ts) - 19723 * 86400000000) // 86400000000)::INTEGER AS i, sum(round(value * 100)::BIGINT) AS cents FROM events GROUP BY 1, 2),
intensity AS (SELECT angle_idx, f.i, coalesce(cents, 0)::BIGINT AS cents FROM angle CROSS JOIN frame f LEFT JOIN sums s ON s.name = angle.name AND s.i = f.i),
mean AS (SELECT angle_idx, sum(cents)::DOUBLE / count(*) AS mu FROM intensity GROUP BY 1),
fluct AS (SELECT x.angle_idx, i, cents - mu AS d, mu FROM intensity x JOIN mean USING (angle_idx)),
c2 AS (SELECT a.angle_idx, a.i, b.i AS j, 1 + a.d * b.d / (a.mu * a.mu) AS c2 FROM fluct a JOIN fluct b USING (angle_idx))
"""
#: The same in hourly frames.
HOURLY_SQL = SQL.replace("range(30)", "range(720)").replace("// 86400000000)::INTEGER", "// 3600000000)::INTEGER")
