"""Hard negatives by integer inner products whose bits are taken from the top.

Components are scaled to integers in two's complement. Of a block of vectors
and a block of anchors, the product with the highest bit plane comes first, then
the next. What the planes left out can add lies between the sums of an anchor's
negative and positive components times their largest value, so every pair has
an interval for its score that halves with each plane. A pair is dropped once
its interval lies outside all wanted bands, or below as many scores as are
wanted. When few are left, the other planes are taken pair by pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Vectors in a block and anchors in a block; their score matrix is what a task holds.
ROWS = 4096
ANCHORS = 512
#: Row blocks to one shard, whose blocks meet every block of anchors.
SHARD_BLOCKS = 4
#: Pairs are taken one by one when so small a part of the matrix is left.
FEW = 1 / 16
SCALE = 256
#: Bits of a scaled component; more could pass 64 bits in a score.
MOST_BITS = 26

_BLOCK = "block long, ids binary, labels binary, matrix binary"
_GROUP = "anchors long, rids binary, anchor_ids binary, anchor_labels binary, vectors binary, low binary, high binary"
_FOUND = "rid long, band int, id long, score long"
_FAR = 1 << 62


class Bands:
    """For each anchor and band: least and greatest score, how many are wanted, and the score that a pair must reach."""

    def __init__(self, low: np.ndarray, high: np.ndarray, wanted: int):
        self.low, self.high, self.wanted, self.reached = low, high, wanted, np.full(low.shape, -_FAR)

    def alive(self, least: np.ndarray, most: np.ndarray, own: np.ndarray | None = None) -> np.ndarray:
        """Whether a score between ``least`` and ``most`` can be wanted; ``own`` are the pairs' anchors, without it anchors are the rows."""
        out = np.zeros(least.shape, bool)
        for k in range(self.low.shape[1]):
            floor, high = np.maximum(self.low[:, k], self.reached[:, k]), self.high[:, k]
            floor, high = (floor[:, None], high[:, None]) if own is None else (floor[own], high[own])
            out |= (most >= floor) & (least <= high)
        return out

    def raise_reached(self, least: np.ndarray, most: np.ndarray, allowed: np.ndarray) -> None:
        """Where as many pairs as wanted lie in a band for sure, none below the last of them is needed."""
        if least.shape[1] < self.wanted:
            return
        for k in range(self.low.shape[1]):
            sure = np.where(allowed & (least >= self.low[:, k, None]) & (most <= self.high[:, k, None]), least, -_FAR)
            last = np.partition(sure, -self.wanted, axis=1)[:, -self.wanted]
            self.reached[:, k] = np.maximum(self.reached[:, k], last)


def best_pairs(vectors: np.ndarray, matrix: np.ndarray, ids: np.ndarray, allowed: np.ndarray, bands: Bands, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, band, id, score) of the pairs that a band of ``bands`` may want, at most ``wanted`` for each; raises what the bands reach.

    ``vectors`` (anchors, d) and ``matrix`` (rows, d) are integers of ``bits`` bits in two's complement.
    """
    positive, negative = np.maximum(vectors, 0).sum(axis=1), np.minimum(vectors, 0).sum(axis=1)
    exact = np.float32 if vectors.shape[1] << (bits - 1) < 1 << 24 else np.float64
    anchors = vectors.astype(exact)
    score = np.zeros(allowed.shape, np.int64)
    allowed = allowed.copy()
    own = row = None
    for bit in range(bits - 1, -1, -1):
        weight = -(1 << bit) if bit == bits - 1 else 1 << bit
        left = (1 << bit) - 1
        plane = (matrix >> bit) & 1
        if own is None:
            score += weight * (anchors @ plane.astype(exact).T).astype(np.int64)
            least, most = score + negative[:, None] * left, score + positive[:, None] * left
            bands.raise_reached(least, most, allowed)
            allowed &= bands.alive(least, most)
            if allowed.sum() <= FEW * allowed.size or not bit:
                own, row = np.nonzero(allowed)
                score = score[own, row]
        else:
            score = score + weight * (vectors[own] * plane[row]).sum(axis=1)
            still = bands.alive(score + negative[own] * left, score + positive[own] * left, own)
            own, row, score = own[still], row[still], score[still]
    found = []
    for k in range(bands.low.shape[1]):
        inside = (score >= np.maximum(bands.low[own, k], bands.reached[own, k])) & (score <= bands.high[own, k])
        found.append((own[inside], np.full(inside.sum(), k), ids[row[inside]], score[inside]))
    return keep_best(*(np.concatenate(x) for x in zip(*found)), bands)


def keep_best(own: np.ndarray, band: np.ndarray, ids: np.ndarray, score: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The first ``wanted`` of each anchor and band by score, then id; raises what the bands reach."""
    order = np.lexsort((ids, -score, band, own))
    own, band, ids, score = own[order], band[order], ids[order], score[order]
    group = own * bands.low.shape[1] + band
    first = np.searchsorted(group, group)
    place = np.arange(len(group)) - first
    last = place == bands.wanted - 1
    bands.reached[own[last], band[last]] = np.maximum(bands.reached[own[last], band[last]], score[last])
    kept = place < bands.wanted
    return own[kept], band[kept], ids[kept], score[kept]


def _pack_rows(rows: DataFrame, size: int, count: int, columns: str, names: list[str]) -> DataFrame:
    """Blocks of ``count`` rows: a number, each integer column as bytes, the scaled vectors (``size`` components, short ones filled with zeros) as bytes."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, held, n = TaskContext.get().partitionId() << 32, [], 0

        def block(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            nonlocal number
            rows = pa.Table.from_batches(parts).combine_chunks()
            longs = [np.asarray(rows.column(k), np.int64).tobytes() for k in range(rows.num_columns - 1)]
            lists = rows.column(rows.num_columns - 1).combine_chunks()
            lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
            sizes = np.diff(np.asarray(lists.offsets))
            out = np.zeros((rows.num_rows, size), np.int64)
            out[np.arange(size) < sizes[:, None]] = np.floor(SCALE * np.asarray(lists.flatten(), np.float64)).astype(np.int64)
            number += 1
            return pa.RecordBatch.from_arrays([pa.array([number - 1], pa.int64()), *(pa.array([x], pa.binary()) for x in (*longs, out.tobytes()))], names)

        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, count - n)
                held.append(part)
                n, batch = n + part.num_rows, batch.slice(part.num_rows)
                if n == count:
                    yield block(held)
                    held, n = [], 0
        if n:
            yield block(held)

    return rows.mapInArrow(pack, columns)


def _meet(blocks: DataFrame, groups: DataFrame, shards: int, same_label: bool, wanted: int, bits: int, size: int) -> DataFrame:
    """(rid, band, id, score): of each shard of blocks, the best ``wanted`` rows for each anchor and band.

    Every block of anchors goes to every shard, where it meets the shard's blocks one after the other.
    """
    left = groups.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    right = blocks.withColumn("shard", F.pmod(F.xxhash64("block"), F.lit(shards)).cast("int"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, best, bands, rids = None, None, None, None

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((rids[best[0]], best[1], best[2], best[3]), (pa.int64(), pa.int32(), pa.int64(), pa.int64()))], ["rid", "band", "id", "score"])

        for batch in batches:
            for x in batch.to_pylist():
                if x["anchors"] != now:
                    if best is not None:
                        yield rows()
                    now = x["anchors"]
                    rids, own_ids, own_labels = (np.frombuffer(x[k], np.int64) for k in ("rids", "anchor_ids", "anchor_labels"))
                    vectors = np.frombuffer(x["vectors"], np.int64).reshape(-1, size)
                    low, high = (np.frombuffer(x[k], np.int64).reshape(len(rids), -1) for k in ("low", "high"))
                    best, bands = tuple(np.zeros(0, np.int64) for _ in range(4)), Bands(low, high, wanted)
                ids, labels = np.frombuffer(x["ids"], np.int64), np.frombuffer(x["labels"], np.int64)
                matrix = np.frombuffer(x["matrix"], np.int64).reshape(-1, size)
                allowed = ((own_labels[:, None] == labels) == same_label) & (own_ids[:, None] != ids)
                found = best_pairs(vectors, matrix, ids, allowed, bands, bits)
                best = keep_best(*(np.concatenate(y) for y in zip(best, found)), bands)
        if best is not None:
            yield rows()

    # The join goes through the blocks of a shard for one block of anchors before the next; where it doesn't, a task only gives more rows.
    met = left.join(right, "shard").drop("shard")
    return met.mapInArrow(run, _FOUND)


def _first(found: DataFrame, wanted: int) -> DataFrame:
    """With ``rank``: the first ``wanted`` of each anchor and band; a shard gave at most so many."""
    place = Window.partitionBy("rid", "band").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= wanted)


def hard_negatives(vectors: DataFrame, is_anchor: Column, n_positives: int = 5, n_negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Of ``vectors`` (vec_id, embedding, label), every row with ``is_anchor`` asks
    all others. Components become floor(256 * x); a score is the exact integer
    inner product, higher first, then the smaller vec_id. Positives are the
    first rows of the anchor's label. For each, negatives are the first rows of
    another label with low * positive_score <= 100 * score <= high * positive_score.

    Rows with a null vec_id, label or vector, or a component that is null or not
    finite, take no part. Short vectors are filled with zeros. Rows of the
    anchor's own vec_id are never its partners; other repeated rows count each,
    and a repeated anchor is answered each time. Fewer rows than wanted are all
    returned; an empty table gives no rows; other columns don't matter.
    Components beyond 2**25 after scaling raise a ValueError.
    """
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"), is_anchor.alias("asks"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(~bad)
    largest = F.max(F.array_max(F.transform("embedding", lambda x: F.abs(x))))
    size, top, n = rows.agg(F.max(F.size("embedding")), largest, F.count(F.lit(1))).first()
    size = max(size or 0, 1)
    bits = int(SCALE * (top or 0.0)).bit_length() + 2
    if bits > MOST_BITS:
        raise ValueError(f"components of {bits} bits after scaling")
    blocks = materialize(_pack_rows(rows.select("vec_id", "label", "embedding"), size, ROWS, _BLOCK, ["block", "ids", "labels", "matrix"]), "negatives-blocks")
    asking = rows.where("asks").select(F.monotonically_increasing_id().alias("rid"), "vec_id", "label", "embedding")
    packed = _pack_rows(asking, size, ANCHORS, "anchors long, rids binary, anchor_ids binary, anchor_labels binary, vectors binary", ["anchors", "rids", "anchor_ids", "anchor_labels", "vectors"])
    groups = materialize(packed, "negatives-anchors")
    shards = max(1, -(-n // (ROWS * SHARD_BLOCKS)))

    def widest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                k = len(x["rids"]) // 8
                ends = [np.full(k, v, np.int64).tobytes() for v in (-_FAR, _FAR)]
                yield pa.RecordBatch.from_arrays([pa.array([v], pa.int64() if j == 0 else pa.binary()) for j, v in enumerate([*x.values(), *ends])], [*x, "low", "high"])

    positives = _first(_meet(blocks, groups.mapInArrow(widest, _GROUP), shards, True, n_positives, bits, size), n_positives)
    positives = materialize(positives.select("rid", (F.col("rank") - 1).alias("band"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "negatives-positives")

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, rids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = np.frombuffer(rids, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array([number] * len(own), pa.int64())], ["rid", "anchors"])

    of_anchor = groups.select("anchors", "rids").mapInArrow(places, "rid long, anchors long")
    scores = positives.join(of_anchor, "rid").groupBy(F.col("anchors").alias("of")).agg(F.collect_list(F.struct("rid", "band", "positive_score")).alias("found"))  # at most ANCHORS * n_positives in a row

    def banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                rids = np.frombuffer(x["rids"], np.int64)
                at = {r: k for k, r in enumerate(rids.tolist())}
                least, most = np.full((len(rids), n_positives), _FAR), np.full((len(rids), n_positives), -_FAR)  # empty
                for y in x.pop("found"):
                    least[at[y["rid"]], y["band"]] = -(-low * y["positive_score"] // 100)
                    most[at[y["rid"]], y["band"]] = high * y["positive_score"] // 100
                values = [*x.values(), least.tobytes(), most.tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([v], pa.int64() if j == 0 else pa.binary()) for j, v in enumerate(values)], [*x, "low", "high"])

    asked = groups.join(scores, F.col("anchors") == F.col("of")).drop("of").mapInArrow(banded, _GROUP)
    negatives = _first(_meet(blocks, asked, shards, False, n_negatives, bits, size), n_negatives)
    return negatives.join(positives, ["rid", "band"]).join(_names(groups), "rid").select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def _names(groups: DataFrame) -> DataFrame:
    """(rid, anchor_id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rids, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(x, np.int64)) for x in (rids, ids)], ["rid", "anchor_id"])

    return groups.select("rids", "anchor_ids").mapInArrow(run, "rid long, anchor_id long")
