"""Exact percentiles of many rows: a sketch brackets each rank, and only the bracket's rows are ordered."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Ranks on either side of a percentile that its bracket holds, as a share of the rows, and the sketch's accuracy.
MARGIN, ACCURACY = 1e-3, 10_000
#: Groups of at most so many rows are their own bracket.
SMALL = 10_000


def exact_percentiles(rows: DataFrame, by: list[str], value: str, wanted: dict[str, float | tuple[float, str]]) -> DataFrame:
    """(by, n_NAME, NAME ...): the percentiles of the values that aren't null, linear between neighbours; null for none.

    ``wanted`` are names with a share, or with a share and the boolean column that says which rows count. One pass
    sketches, one counts what lies below each bracket and keeps its rows (some thousandths), which are counted by
    value before they are ordered.
    """
    ask = {k: v if isinstance(v, tuple) else (v, None) for k, v in wanted.items()}
    groups = by or ["__all"]
    x = rows if by else rows.withColumn("__all", F.lit(1))
    own = {k: F.col(value) if on is None else F.when(F.col(on), F.col(value)) for k, (_, on) in ask.items()}
    sketch = []
    for k, (q, _) in ask.items():
        sketch += [F.count(own[k]).alias(f"n_{k}"), F.percentile_approx(own[k], [max(q - MARGIN, 0.0), min(q + MARGIN, 1.0)], ACCURACY).alias(f"e_{k}")]
    edges = F.broadcast(x.groupBy(*groups).agg(*sketch))  # one row a group
    joined = x.join(edges, groups)

    def inside(k: str, q: float):
        at_least = F.lit(q <= MARGIN) | (F.col(f"n_{k}") <= SMALL) | (own[k] >= F.col(f"e_{k}")[0])
        at_most = F.lit(q >= 1 - MARGIN) | (F.col(f"n_{k}") <= SMALL) | (own[k] <= F.col(f"e_{k}")[1])
        return at_least, at_most

    parts = []
    for k, (q, _) in ask.items():
        low, high = inside(k, q)
        parts.append(F.when(own[k].isNotNull() & high, F.struct(F.lit(k).alias("name"), F.when(low, own[k]).alias("v"))))
    # A null v counts a row below the bracket.
    found = joined.select(*groups, F.explode(F.array_compact(F.array(*parts))).alias("p")).select(*groups, "p.name", "p.v")
    counted = found.groupBy(*groups, "name", "v").agg(F.count(F.lit(1)).alias("c"))
    # Nulls come first, so that what lies below is in every running sum.
    upto = F.sum("c").over(Window.partitionBy(*groups, "name").orderBy(F.col("v").asc_nulls_first()))
    ranked = counted.withColumn("upto", upto).where("v IS NOT NULL").join(edges, groups)
    out = []
    for k, (q, _) in ask.items():
        rank = q * (F.col(f"n_{k}") - 1)
        below, above = (F.min(F.when((F.col("name") == k) & (F.col("upto") > r), F.col("v"))) for r in (F.floor(rank), F.ceil(rank)))
        share = F.max(rank - F.floor(rank))
        out += [F.max(f"n_{k}").alias(f"n_{k}"), (below + share * (above - below)).alias(k)]
    return ranked.groupBy(*groups).agg(*out).drop("__all")
