"""Lookup of points on a sorted, uneven grid: the next grid point at or after a value, or the last at or before it, clipped to the grid's ends."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .windows import _among, with_ranges

#: A grid of at most so many points is looked up by halving inside each task; a larger one is merged with the points in ranges.
GRID_POINTS = 64


def nearest_on_grid(points: DataFrame, grid: DataFrame, value: str, out: str, side: str = "ceiling", key: str = "t", index: str = "index") -> DataFrame:
    """``points`` with ``out``: the ``index`` of the grid row whose ``key`` is the least one not below ``value`` (ceiling) or the largest one not above it (floor).

    Values beyond an end get that end's index. Grid keys are distinct and not
    null, and the index rises with the key. A null value gets a null, a NaN
    counts as larger than all; an empty grid gives nulls.
    """
    if side not in ("ceiling", "floor"):
        raise ValueError(f"no such side: {side}")
    up = side == "ceiling"
    if grid.limit(GRID_POINTS + 1).count() <= GRID_POINTS:
        rows = sorted((r[0], r[1]) for r in grid.select(key, index).collect())  # GRID_POINTS at most
        if not rows:
            return points.withColumn(out, F.lit(None).cast(grid.schema[index].dataType))
        # Not below: as many as lie strictly below come before; the last edge is left out, which clips.
        keys = [k for k, _ in rows]
        place = _among_below(keys[:-1], F.col(value)) if up else _among(keys[1:], F.col(value))
        found = F.element_at(F.array(*(F.lit(i) for _, i in rows)), place + 1)
        return points.withColumn(out, F.when(F.col(value).isNotNull(), found).cast(grid.schema[index].dataType))
    taken = {c: f"__own_{k}" for k, c in enumerate(points.columns)}
    own = points.select(*(F.col(c).alias(n) for c, n in taken.items()), F.col(value).alias("__at"), F.lit(True).alias("__point"))
    marks = grid.select(F.col(key).alias("__at"), F.col(index).alias("__index"), F.lit(False).alias("__point"))
    # Of equal values, the grid's row lies where the window looks: behind the points, or before them.
    both = own.where("__at IS NOT NULL").unionByName(marks, allowMissingColumns=True)
    dealt = with_ranges(both, "__at").withColumn("__late", (F.col("__point") != F.lit(up)).cast("int"))
    # The ceiling is read from the largest value down: a frame that runs on to its end would be read anew for each row.
    turned = F.desc if up else F.asc
    window = Window.partitionBy("range").orderBy(turned("__at"), turned("__late")).rowsBetween(Window.unboundedPreceding, 0)
    seen = dealt.withColumn("__found", F.last("__index", ignorenulls=True).over(window))
    ends = dealt.groupBy("range").agg(F.min("__index").alias("lo"), F.max("__index").alias("hi"))  # a row a range
    ranges = Window.orderBy(turned("range")).rowsBetween(Window.unboundedPreceding, -1)
    beyond = (F.min("lo") if up else F.max("hi")).over(ranges)
    everywhere = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    clip = (F.max("hi") if up else F.min("lo")).over(everywhere)
    ends = ends.select("range", F.coalesce(beyond, clip).alias("__beyond"))
    found = seen.where("__point").join(F.broadcast(ends), "range").select(*(F.col(n).alias(c) for c, n in taken.items()), F.coalesce("__found", "__beyond").alias(out))
    nulls = points.where(F.col(value).isNull()).withColumn(out, F.lit(None).cast(grid.schema[index].dataType))
    return found.unionByName(nulls)


def _among_below(edges: list, value):
    """How many of the sorted ``edges`` are below ``value``."""
    if not edges:
        return F.lit(0)
    mid = len(edges) // 2
    return F.when(value <= F.lit(edges[mid]), _among_below(edges[:mid], value)).otherwise(_among_below(edges[mid + 1 :], value) + (mid + 1))
