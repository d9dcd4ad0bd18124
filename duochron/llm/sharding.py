"""Balanced shards of indivisible groups by Karmarkar-Karp differencing.

Documents with equal texts form a group that stays whole. Every group starts as
a partial partition with all its bytes in one slot; the two partial partitions
with the largest spread are combined in opposite order until one is left.
Blocks of groups are differenced in parallel, and the resulting partial
partitions (one vector of shard sums per block) are differenced again, level by
level, so no task ever sees more than one block. Groups above a hundredth of a
fair share stay out of the blocks: they are differenced first, and every block
starts from its part of their loads, so that small groups leave them room.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import join_small, materialize, text_key, utf8_size

#: Groups that one task differences, and partial partitions that one task combines.
BLOCK_GROUPS = 20_000
BLOCK_PARTIALS = 500
#: A group is large above a fair share divided by this.
LARGE_PARTS = 100
#: Documents numbered by one window group.
SLOT_ROWS = 20_000


def difference(partials: np.ndarray) -> np.ndarray:
    """Combine k-way partial partitions by largest differencing.

    ``partials`` is (n, k), one row of slot sums each. Returns (n, k): the final
    slot of every slot of every row. Ties go to the earlier row.
    """
    n, k = partials.shape
    order = np.argsort(partials, axis=1, kind="stable")
    sums = list(np.take_along_axis(partials, order, axis=1))
    heap = [(-int(s[-1] - s[0]), i) for i, s in enumerate(sums)]
    heapq.heapify(heap)
    merges = []
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        total = sums[a] + sums[b][::-1]
        by = np.argsort(total, kind="stable")
        total = total[by]
        sums[a] = sums[b] = None
        sums.append(total)
        merges.append((a, b, by))
        heapq.heappush(heap, (-int(total[-1] - total[0]), len(sums) - 1))
    slot = np.empty((len(sums), k), np.int32)
    slot[-1] = np.arange(k)
    for node in range(len(sums) - 1, n - 1, -1):
        a, b, by = merges[node - n]
        slot[a, by] = slot[node]
        slot[b, k - 1 - by] = slot[node]
    out = np.empty((n, k), np.int32)
    np.put_along_axis(out, order, slot[:n], axis=1)
    return out


def _difference_groups(n_shards: int):
    def block(groups: pd.DataFrame) -> pd.DataFrame:
        groups = groups.sort_values(["bytes", "key"], ascending=[False, True], kind="stable")
        partials = np.zeros((len(groups), n_shards), np.int64)
        partials[:, 0] = groups["bytes"]
        return pd.DataFrame({"key": groups["key"], "bytes": groups["bytes"], "block": groups["block"], "label": difference(partials)[:, 0]})

    return block


def _difference_beside(load: np.ndarray, rest: int):
    """Difference a block's groups together with its part of the large groups' loads, which fixes the shards."""

    def block(groups: pd.DataFrame) -> pd.DataFrame:
        groups = groups.sort_values(["bytes", "key"], ascending=[False, True], kind="stable")
        partials = np.zeros((len(groups) + 1, len(load)), np.int64)
        partials[0] = np.rint(load * (int(groups["bytes"].sum()) / rest))
        partials[1:, 0] = groups["bytes"]
        slot = difference(partials)
        return pd.DataFrame({"key": groups["key"], "shard": np.argsort(slot[0])[slot[1:, 0]].astype(np.int32)})

    return block


def _difference_partials(n_shards: int):
    def block(rows: pd.DataFrame) -> pd.DataFrame:
        wide = rows.pivot_table(index="block", columns="label", values="bytes", aggfunc="sum", fill_value=0).reindex(columns=range(n_shards), fill_value=0).sort_index()
        to = difference(wide.to_numpy(np.int64))
        return pd.DataFrame({"block": np.repeat(wide.index.to_numpy(), n_shards), "label": np.tile(np.arange(n_shards), len(wide)), "parent": int(rows["parent"].iloc[0]), "parent_label": to.ravel()})

    return block


def assign_groups(groups: DataFrame, n_shards: int, n_groups: int, block_groups: int = BLOCK_GROUPS, block_partials: int = BLOCK_PARTIALS) -> DataFrame:
    """(key, shard) for groups of (key binary, bytes long), differenced in blocks and then level by level."""
    n_blocks = max(1, math.ceil(n_groups / block_groups))
    blocks = groups.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(n_blocks)).cast("int"))
    if n_blocks > 1:
        total = groups.agg(F.sum("bytes")).first()[0]
        large = groups.where(F.col("bytes") * (LARGE_PARTS * n_shards) > F.lit(total))  # fewer than LARGE_PARTS * n_shards rows
        rows = sorted(large.collect(), key=lambda r: (-r["bytes"], bytes(r["key"])))
        if rows:
            partials = np.zeros((len(rows), n_shards), np.int64)
            partials[:, 0] = [r["bytes"] for r in rows]
            slot = difference(partials)[:, 0]
            load = np.zeros(n_shards, np.int64)
            np.add.at(load, slot, partials[:, 0])
            placed = groups.sparkSession.createDataFrame([(bytes(r["key"]), int(k)) for r, k in zip(rows, slot)], "key binary, shard int")
            small = blocks.where(F.col("bytes") * (LARGE_PARTS * n_shards) <= F.lit(total))
            return small.groupBy("block").applyInPandas(_difference_beside(load, total - int(load.sum())), "key binary, shard int").unionByName(placed)
    labels = materialize(blocks.groupBy("block").applyInPandas(_difference_groups(n_shards), "key binary, bytes long, block int, label int"), "kk-labels")
    sums = labels.groupBy("block", "label").agg(F.sum("bytes").alias("bytes"))
    shard_of = None
    while True:
        parents = math.ceil(n_blocks / block_partials)
        level = materialize(sums.withColumn("parent", F.pmod("block", F.lit(parents)).cast("int")).groupBy("parent").applyInPandas(_difference_partials(n_shards), "block int, label int, parent int, parent_label int"), "kk-level")
        if shard_of is None:
            shard_of = level.select(F.col("block").alias("of_block"), F.col("label").alias("of_label"), "parent", "parent_label")
        else:
            up = level.select(F.col("block").alias("parent"), F.col("label").alias("parent_label"), F.col("parent").alias("p"), F.col("parent_label").alias("pl"))
            shard_of = shard_of.join(up, ["parent", "parent_label"]).select("of_block", "of_label", F.col("p").alias("parent"), F.col("pl").alias("parent_label"))
        if parents == 1:
            break
        sums = sums.join(level, ["block", "label"]).groupBy(F.col("parent").alias("block"), F.col("parent_label").alias("label")).agg(F.sum("bytes").alias("bytes"))
        n_blocks = parents
    shard_of = shard_of.select(F.col("of_block").alias("block"), F.col("of_label").alias("label"), F.col("parent_label").alias("shard"))
    return labels.join(shard_of, ["block", "label"]).select("key", "shard")


def shard_by_bytes(docs: DataFrame, n_shards: int, overhead: int = 16, block_groups: int = BLOCK_GROUPS, slot_rows: int = SLOT_ROWS) -> DataFrame:
    """Put every document into one of ``n_shards`` shards of near equal bytes.

    Returns doc_id, size (UTF-8 bytes plus ``overhead``), text_crc32, law
    ('bytes'), shard, slot (gapless from 0 within each shard) and grown_shard
    (null). Copies of a text share a shard; null texts are one group, empty
    texts another. Null or repeated doc_ids are rows like any others. An empty
    table gives no rows. A group larger than a fair share makes its shard that
    large: it is indivisible.
    """
    base = materialize(docs.select("doc_id", (utf8_size(F.col("text")) + overhead).alias("size"), F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"), text_key(F.col("text")).alias("key")), "kk-base")
    groups = materialize(base.groupBy("key").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")), "kk-groups")
    total = groups.agg(F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows")).first()
    chunks = max(1, math.ceil(total["rows"] / slot_rows))
    shards = materialize(assign_groups(groups.select("key", "bytes"), n_shards, total["groups"], block_groups), "kk-shards")
    placed = join_small(base, shards, "key").withColumn("chunk", F.pmod(F.xxhash64("doc_id", "key"), F.lit(chunks)).cast("int"))
    placed = materialize(placed.drop("key"), "kk-placed")
    starts = placed.groupBy("shard", "chunk").agg(F.count(F.lit(1)).alias("rows")).withColumn("start", F.sum("rows").over(Window.partitionBy("shard").orderBy("chunk")) - F.col("rows")).drop("rows")
    rank = F.row_number().over(Window.partitionBy("shard", "chunk").orderBy("doc_id", "size", "text_crc32")) - 1
    return (
        placed.withColumn("rank", rank)
        .join(starts, ["shard", "chunk"])
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("start") + F.col("rank")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )


def write_shards(docs: DataFrame, path: str, n_shards: int) -> None:
    """Write the documents as Parquet, one folder a shard (``kk_shard``, instead of a column so named)."""
    keyed = docs.withColumn("__key", text_key(F.col("text")))
    groups = keyed.groupBy("__key").agg((F.sum(utf8_size(F.col("text"))) + 16 * F.count(F.lit(1))).alias("bytes")).withColumnRenamed("__key", "key")
    groups = materialize(groups, "kk-groups")
    shards = materialize(assign_groups(groups, n_shards, groups.count()), "kk-shards").withColumnsRenamed({"key": "__key", "shard": "__shard"})
    join_small(keyed, shards, "__key").drop("__key", "kk_shard").withColumnRenamed("__shard", "kk_shard").write.partitionBy("kk_shard").parquet(path)
