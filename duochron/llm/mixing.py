"""Mixing sources to target weights by Poisson replication.

A source's repetition rate is what brings its characters to its target weight
of the budget. Each document's number of copies is a Poisson draw with that
mean, made by inverting the distribution at a number in [0, 1) that is hashed
from the seed and the doc_id (large rates in equal parts); the copies are then put in one global order by a
hash of their own.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, materialize

#: Characters of a partition of the output, at most about.
PART_CHARS = 32 << 20
#: The greatest rate that one hashed number inverts; exp(-rate) must not underflow.
RATE_AT_ONCE = 500


def hashed_unit(*parts: Column) -> Column:
    """48 bits of MD5 of the joined parts, as a number in [0, 1); the same in any SQL engine."""
    digest = F.md5(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") / F.lit(float(1 << 48))


def poisson_quantile(rate: Column, u: Column) -> Column:
    """The least n whose cumulative Poisson probability exceeds ``u``.

    The terms go far enough (mean + 12 deviations + 40) to pass 1 - 2**-48, so no draw is cut off.
    For rates up to RATE_AT_ONCE; ``poisson_draw`` takes any.
    """
    terms = F.sequence(F.lit(1), F.ceil(rate + 12 * F.sqrt(rate) + 40).cast("int"))
    start = F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("c"), F.when(u < F.exp(-rate), 0).otherwise(1).alias("n"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * rate / k
        c = acc["c"] + p
        return F.struct(p.alias("p"), c.alias("c"), (acc["n"] + F.when(u < c, 0).otherwise(1)).alias("n"))

    return F.aggregate(terms, start, step, lambda acc: acc["n"])


def poisson_draw(rate: Column, *parts: Column) -> Column:
    """A Poisson draw at the hash of ``parts``; a rate above RATE_AT_ONCE is the sum of draws of equal rates, each at a hash of its own."""
    n = F.ceil(rate / RATE_AT_ONCE).cast("int")
    split = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda acc, k: acc + poisson_quantile(rate / n, hashed_unit(*parts, k)))
    return F.when(rate <= RATE_AT_ONCE, poisson_quantile(rate, hashed_unit(*parts))).otherwise(split)


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None, epochs: float = 1.0, temperature: float = 0.5) -> DataFrame:
    """(source, size, rate): the size and the repetition rate of every source.

    ``weights`` are target shares by source (scaled to sum to 1; a source that
    isn't named gets none). Without them a source's share is its own size to
    the power ``temperature``. A document's size is its characters and one more,
    so that no source is empty. The budget is ``epochs`` times all sizes.
    """
    size = F.coalesce(F.length("text"), F.lit(0)).cast("long") + 1
    sizes = docs.groupBy("source").agg(F.sum(size).alias("size"))
    if weights is not None:
        pairs = [F.when(F.col("source") == F.lit(k), F.lit(float(v))) for k, v in weights.items()]
        share = F.coalesce(*pairs, F.lit(0.0)) if pairs else F.lit(0.0)
    else:
        share = F.sqrt(F.col("size")) if temperature == 0.5 else F.pow(F.col("size").cast("double"), F.lit(temperature))
    shares = sizes.withColumn("share", share)
    total = shares.agg(F.sum("size").cast("double").alias("all_size"), F.sum("share").alias("all_share"))
    return shares.crossJoin(F.broadcast(total)).select("source", "size", (F.col("share") / F.col("all_share") * (F.lit(float(epochs)) * F.col("all_size")) / F.col("size")).alias("rate"))


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, epochs: float = 1.0, seed: int = 17, temperature: float = 0.5, shuffle: bool = True, keep_draw: bool = False) -> DataFrame:
    """The documents, each as often as its Poisson draw, in one global hashed order over the output's partitions.

    All columns stay. With ``keep_draw``: also (instead of columns so named) mix_rate, mix_copy (0 and on) and
    mix_key, the place in the global order. A null source is a source of its
    own. Rows of one doc_id share their draw. An empty table gives no rows.
    """
    rates = materialize(source_rates(docs, weights, epochs, temperature), "mix-rates")
    expected = rates.agg(F.sum(F.col("rate") * F.col("size"))).first()[0] or 0
    # One row per source; the broadcast is guarded by a count.
    rates = bounded(rates.select(F.col("source").alias("__source"), F.col("rate").alias("__rate")))
    drawn = docs.join(rates, docs["source"].eqNullSafe(rates["__source"])).drop("__source")
    drawn = drawn.withColumn("__n", poisson_draw(F.col("__rate"), F.lit(f"draw{seed}"), F.col("doc_id")))
    copies = drawn.where(F.col("__n") > 0).withColumn("__copy", F.explode(F.sequence(F.lit(0), F.col("__n") - 1))).drop("__n")
    copies = copies.withColumn("__key", hashed_unit(F.lit(f"order{seed}"), F.col("doc_id"), F.col("__copy")))
    if shuffle:
        # Keys are uniform, so equal ranges are even without a sample of the draws.
        parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(expected / PART_CHARS))
        copies = copies.repartitionById(parts, F.floor(F.col("__key") * parts).cast("int")).sortWithinPartitions("__key", "doc_id", "__copy")
    drawn = {"__rate": "mix_rate", "__copy": "mix_copy", "__key": "mix_key"}
    return copies.drop(*drawn.values()).withColumnsRenamed(drawn) if keep_draw else copies.drop(*drawn)


def mix_order(seed: int = 17) -> list[Column]:
    """The columns that put the rows of ``mix_sources`` back into its global order: copies are numbered and hashed again."""
    copy = F.row_number().over(Window.partitionBy("doc_id", F.xxhash64("text")).orderBy("doc_id")) - 1
    return [hashed_unit(F.lit(f"order{seed}"), F.col("doc_id"), copy), F.col("doc_id")]
