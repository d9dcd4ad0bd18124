"""Ordered computations: monotony, ranks, runs, trends and chunk allocation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def is_monotone(frames: DataFrame, value: str = "t") -> DataFrame:
    """One row: whether the value never falls along i."""
    w = Window.orderBy("i")  # frames are a dimension of some thousand rows
    return frames.withColumn("__ok", F.coalesce(F.col(value) >= F.lag(value).over(w), F.lit(True))).agg(F.bool_and("__ok").alias("monotone"))


def keep_best(starts: DataFrame, cost: str = "cost", key: str = "start", share: float = 0.5, least: int = 3) -> DataFrame:
    """The max(least, floor(n * share)) starts of least cost, ranked."""
    n = F.broadcast(starts.agg(F.greatest(F.lit(least), F.floor(F.count(F.lit(1)) * share)).alias("__k")))
    return numbered(starts, cost, "rank", key).crossJoin(n).where(F.col("rank") <= F.col("__k")).drop("__k")


def best_result(results: DataFrame) -> DataFrame:
    """The successful result of least chi2."""
    return results.where("success").agg(F.min_by("start", F.struct("chi2", "start")).alias("start"), F.min("chi2").alias("chi2"))


#: Rows of an ordered history that one task orders; the number of ranges grows with the history.
RANGE_ROWS = 200_000


def _among(edges: list, key: Column, first: int = 0) -> Column:
    """How many of the sorted ``edges`` are at most ``key``, by halving: as many comparisons as there are bits in their number."""
    if not edges:
        return F.lit(first)
    mid = len(edges) // 2
    return F.when(key < F.lit(edges[mid]), _among(edges[:mid], key, first)).otherwise(_among(edges[mid + 1 :], key, first + mid + 1))


def with_ranges(history: DataFrame, key: str) -> DataFrame:
    """Add range (0 and on, ascending with ``key``) of about RANGE_ROWS rows: a count and one sketch say where to cut, and no task orders all rows.

    Keys that repeat stay in one range; a range may be empty.
    """
    n = -(-history.count() // RANGE_ROWS)
    if n <= 1:
        return history.withColumn("range", F.lit(0))
    edges = sorted(set(history.approxQuantile(key, [k / n for k in range(1, n)], 1 / (8 * n))))
    return history.withColumn("range", _among(edges, F.col(key)))


def numbered(rows: DataFrame, key: str, name: str, *then: str) -> DataFrame:
    """Add ``name``: the row's number (1 and on) by ``key``, then by the other columns; ranges are numbered apart, then moved on by what those before hold."""
    dealt = with_ranges(rows, key)
    held = dealt.groupBy("range").agg(F.count(F.lit(1)).alias("__n"))  # a row a range
    before = held.select(F.col("range"), (F.sum("__n").over(Window.orderBy("range")) - F.col("__n")).alias("__before"))
    own = F.row_number().over(Window.partitionBy("range").orderBy(key, *then))
    return dealt.join(F.broadcast(before), "range").withColumn(name, (own + F.col("__before")).cast("long")).drop("range", "__before")


def over_last(history: DataFrame, key: str, size: int, columns: dict[str, Callable[[WindowSpec], Column]]) -> DataFrame:
    """``columns`` (functions of a window) over the last ``size`` rows by ``key``: equal blocks of numbered rows, each with the last rows of the one before."""
    block = max(size, RANGE_ROWS)
    place = F.col("__row") - 1
    dealt = numbered(history, key, "__row").withColumns({"__block": F.floor(place / block), "__own": F.lit(True)})
    tail = dealt.where(place % block > block - size).withColumns({"__block": F.col("__block") + 1, "__own": F.lit(False)})
    w = Window.partitionBy("__block").orderBy("__row").rowsBetween(-(size - 1), 0)
    return dealt.unionByName(tail).select("*", *(f(w).alias(k) for k, f in columns.items())).where("__own").drop("__own", "__block", "__row")


def consecutive_triggers(history: DataFrame, at: int = 5) -> DataFrame:
    """(step, triggered, run, fires): the length of the run of triggers up to each step, and whether it reaches ``at``.

    Runs are counted in each range of steps; what a range's first run brings along is summed over the ranges before.
    """
    dealt = with_ranges(history, "step")
    whole = Window.partitionBy("range").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    marked = dealt.withColumn("__breaks", F.sum((~F.col("triggered")).cast("int")).over(whole))
    run = F.sum(F.col("triggered").cast("int")).over(Window.partitionBy("range", "__breaks").orderBy("step").rowsBetween(Window.unboundedPreceding, 0))
    counted = marked.withColumn("__run", F.when(F.col("triggered"), run).otherwise(0))
    ends = counted.groupBy("range").agg(F.max_by("__run", "step").alias("last"), F.max("__breaks").alias("breaks"))  # a row a range
    # A range without a break hands on what it got: so do all since the last one with a break.
    ordered = Window.orderBy("range")
    ends = ends.withColumn("since", F.sum((F.col("breaks") > 0).cast("int")).over(ordered))
    so_far = F.sum("last").over(Window.partitionBy("since").orderBy("range"))
    carried = ends.withColumn("sum", so_far).select("range", F.coalesce(F.lag("sum").over(ordered), F.lit(0)).alias("__carried"))
    total = F.when(F.col("triggered"), F.col("__run") + F.when(F.col("__breaks") == 0, F.col("__carried")).otherwise(0)).otherwise(0)
    out = counted.join(F.broadcast(carried), "range").withColumn("run", total)
    return out.withColumn("fires", F.col("run") >= at).drop("range", "__breaks", "__run", "__carried")


def trend(history: DataFrame, size: int = 10) -> DataFrame:
    """(step, slope): the least-squares slope of value over the last ``size`` steps."""
    return over_last(history, "step", size, {"slope": lambda w: F.regr_slope("value", F.col("step").cast("double")).over(w)}).select("step", "slope")


def ring_statistics(batches: DataFrame, size: int = 100) -> DataFrame:
    """Per batch: success rate, mean loss and mean iterations of the last ``size``."""
    means = {"success_rate": F.col("success").cast("int"), "mean_loss": F.col("loss"), "mean_iterations": F.col("iterations")}
    return over_last(batches, "batch", size, {k: (lambda w, c=c: F.avg(c).over(w)) for k, c in means.items()}).select("batch", *means)


def allocate_chunks(points: DataFrame, n_chunks: int, key: str = "point_id") -> DataFrame:
    """Add chunk (0 and on): every angle's points in order, as evenly as possible over all chunks."""
    ranged = with_ranges(points, key)
    held = ranged.groupBy("angle_idx", "range").agg(F.count(F.lit(1)).alias("__n"))  # a row an angle and range
    w = Window.partitionBy("angle_idx")
    held = held.select("angle_idx", "range", (F.sum("__n").over(w.orderBy("range")) - F.col("__n")).alias("__before"), F.sum("__n").over(w).alias("__all"))
    at = F.row_number().over(Window.partitionBy("angle_idx", "range").orderBy(key)) - 1 + F.col("__before")
    # The first (all mod n) chunks have one more, as ntile deals them.
    size, more = F.floor(F.col("__all") / n_chunks), F.col("__all") % n_chunks
    chunk = F.when(F.col("__at") < more * (size + 1), F.floor(F.col("__at") / (size + 1))).otherwise(more + F.floor((F.col("__at") - more * (size + 1)) / F.greatest(size, F.lit(1))))
    dealt = ranged.join(F.broadcast(held), ["angle_idx", "range"]).withColumn("__at", at)
    return dealt.withColumn("chunk", chunk.cast("int")).drop("range", "__before", "__all", "__at")


def shuffled_chunks(points: DataFrame, n_chunks: int, key: str = "point_id", seed: int = 42) -> DataFrame:
    """As ``allocate_chunks`` but in a seeded random order of each angle's points: 48 bits of a hash say where a point falls.

    No ordering, no window, near-even; for angles of billions of points.
    """
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("angle_idx").cast("string"), F.col(key).cast("string")))
    place = F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") / F.lit(float(1 << 48))
    return points.withColumn("chunk", F.floor(place * n_chunks).cast("int"))


def diagonal_overlay(cells: DataFrame) -> DataFrame:
    """Per angle: variance of the raw diagonal and root mean square difference to the model where both are finite."""
    d = F.col("c2") - F.col("model")
    return cells.where(F.col("i") == F.col("j")).groupBy("angle_idx").agg(F.var_samp("c2").alias("variance"), F.sqrt(F.avg(F.when(~F.isnan(d), d * d))).alias("rmse"))
