"""Validation by component, of what changed only, and the stages a data set goes through."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import ISSUE, Dataset
from . import aggregates as A

# Ranges of wavevectors and time steps.
Q_RANGE, DT_RANGE = (1e-4, 1.0), (1e-6, 1e3)
COMPONENTS = ("c2", "angle", "frame")


def _rows(one: DataFrame, *found: tuple[str, str, str, str, Column, Column]) -> DataFrame:
    """Issue rows of (severity, category, message, parameter, value, whether it is one) over a one-row table."""
    made = [F.struct(*(F.lit(x).alias(k) for x, k in zip(f[:4], ("severity", "category", "message", "parameter"))), f[4].cast("double").alias("value"), F.coalesce(f[5], F.lit(False)).alias("on")) for f in found]
    return one.select(F.explode(F.array(*made)).alias("r")).where("r.on").select("r.severity", "r.category", "r.message", "r.parameter", "r.value")


def angle_issues(angle: DataFrame) -> DataFrame:
    """Wavevectors and angles: out of range, not finite, repeated."""
    bad_q = ~F.coalesce(F.col("q").between(*Q_RANGE), F.lit(False))
    bad_phi = ~F.coalesce(F.col("phi").between(-360, 360), F.lit(False))
    one = angle.agg(F.sum(bad_q.cast("long")).alias("q"), F.sum(bad_phi.cast("long")).alias("phi"), (F.count("phi") - F.count_distinct("phi", "q")).alias("twice"), F.count(F.lit(1)).alias("n"))
    return _rows(
        one,
        ("error", "missing", "no angles", "angle", F.col("n"), F.col("n") == 0),
        ("error", "range", "wavevectors out of range", "q", F.col("q"), F.col("q") > 0),
        ("error", "range", "angles that aren't", "phi", F.col("phi"), F.col("phi") > 0),
        ("warning", "repeated", "angles that repeat", "phi", F.col("twice"), F.col("twice") > 0),
    )


def frame_issues(frame: DataFrame, dt: float) -> DataFrame:
    """Times: missing, falling, and a step out of range. Frames are a dimension of some thousand rows."""
    from .windows import is_monotone

    one = frame.agg(F.count("t").alias("n")).crossJoin(F.broadcast(is_monotone(frame)))
    return _rows(
        one,
        ("error", "missing", "no frames", "frame", F.col("n"), F.col("n") == 0),
        ("warning", "order", "time falls", "t", F.col("n"), ~F.col("monotone")),
        ("error", "range", "time step out of range", "dt", F.lit(dt), F.lit(not DT_RANGE[0] <= dt <= DT_RANGE[1])),
    )


def component_issues(d: Dataset, component: str) -> DataFrame:
    """What is wrong with one component: c2, angle or frame."""
    if component == "c2":
        first = d.c2.agg(F.max(F.when((F.col("i") == 0) & (F.col("j") == 0), F.col("c2"))).alias("t0"))
        return A.issues(d.c2).unionByName(_rows(first, ("warning", "sign", "first cell isn't positive", "c2", F.col("t0"), F.col("t0") <= 0)))
    if component == "angle":
        return angle_issues(d.angle)
    if component == "frame":
        return frame_issues(d.frame, d.dt)
    raise ValueError(f"no such component: {component}; one of {', '.join(COMPONENTS)}")


def component_hashes(d: Dataset) -> dict[str, str | None]:
    """A hash of each component's rows."""
    return {k: A.component_hash(getattr(d, k)).first()["hash"] for k in COMPONENTS}


def validate(d: Dataset, known: dict[str, str | None] | None = None) -> tuple[DataFrame, dict[str, str | None]]:
    """(issues with their component, hashes): of the components whose hash isn't ``known``; all without it."""
    hashes = component_hashes(d)
    out = d.c2.sparkSession.createDataFrame([], "component string, " + ISSUE)
    for k in COMPONENTS:
        if known is None or known.get(k) != hashes[k]:
            out = out.unionByName(component_issues(d, k).withColumn("component", F.lit(k)))
    return out, hashes


STAGES = ("raw", "filtered", "preprocessed", "final")


def stages(raw: DataFrame, keep: DataFrame, diagonal: str | None = "statistical", normalisation: str | None = None, noise: str | None = None) -> dict[str, DataFrame]:
    """The cells at each stage: as they are, of the angles in ``keep``, preprocessed, and repaired at the end."""
    from . import matrix as M

    filtered = raw.join(F.broadcast(keep.select("angle_idx")), "angle_idx", "left_semi")  # one row an angle
    ready = M.correct_diagonal(filtered, diagonal) if diagonal else filtered
    ready = M.normalise(ready, normalisation) if normalisation else ready
    ready = M.denoise(ready, noise) if noise else ready
    return dict(zip(STAGES, (raw, filtered, ready, M.diagonal_basic(M.standardise(A.repair(ready))))))


def stage_report(cells: dict[str, DataFrame]) -> DataFrame:
    """(stage, place, n, finite_fraction, mean, score): one row a stage; ``score`` is the matrices' mean quality."""
    from ..functions.scalars import finite

    out = None
    for place, (name, df) in enumerate(cells.items()):
        x = finite(F.col("c2"))
        one = df.agg(F.count(F.lit(1)).alias("n"), F.avg(x.isNotNull().cast("int")).alias("finite_fraction"), F.avg(x).alias("mean"))
        one = one.crossJoin(F.broadcast(A.matrix_quality(df).agg(F.avg("score").alias("score"))))
        one = one.select(F.lit(name).alias("stage"), F.lit(place).alias("place"), "n", "finite_fraction", "mean", "score")
        out = one if out is None else out.unionByName(one)
    return out
