"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade >= j) = sigmoid(w . x - t_j) with one weight vector w over hashed text
features for all grades and ordered thresholds t_1 < t_2 < ...; the fitted model
gives every document its expected grade and the tail probability of the wanted
grade.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import give_back, lean
from .shingles import _LOWER, gram_hashes, hash_spans, split_words, text_bytes

BUCKETS = 1 << 21
#: A shorter text has no shape features: its shares are chance.
SHAPE_BYTES = 150
#: Bytes of a word that make its stem feature.
STEM = 5
#: Labelled documents of each grade that the model is fitted on, at most.
FIT_PER_GRADE = 3000

#: Grades go from 0 to this one; each has a threshold, whether or not labels have it.
TOP_GRADE = 2

#: A text's features share the weight 1 / (their number ** DAMPING), so that one telling word counts among few and many.
DAMPING = 0.5

#: The least probability of the top grade with which a document is kept.
KEEP = 0.7

#: Words for the features: runs of letters, lower-cased; bytes of non-ASCII characters count as letters.
_BREAK = np.ones(256, bool)
_BREAK[97:123] = False
_BREAK[128:] = False
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def _kinds() -> np.ndarray:
    """Kind of each byte: 0 space, 1 lower, 2 upper, 3 digit, 4 stop or comma, 5 other mark, 6 non-ASCII."""
    k = np.full(256, 5, np.int8)
    k[_SPACE] = 0
    k[97:123], k[65:91], k[48:58], k[[44, 46]], k[128:] = 1, 2, 3, 4, 6
    return k


_KINDS = _kinds()


def hashed_features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(feature bucket, first of each text plus the total): distinct words, and binned shares of kinds of bytes, repeats and lengths."""
    raw, offsets = text_bytes(column)
    n = len(column)
    low = _LOWER[raw] if len(raw) else raw
    starts, ends = split_words(low, offsets, _BREAK) if len(raw) else (np.zeros(0, int), np.zeros(0, int))
    hashes = hash_spans(low, starts, ends) if len(starts) else np.zeros(0, np.uint64)
    stems = hash_spans(low, starts, np.minimum(ends, starts + STEM)) if len(starts) else hashes
    buckets = (hashes >> np.uint64(43)).astype(np.int64)
    stem_buckets = ((stems ^ np.uint64(0x5DEECE66D)) >> np.uint64(43)).astype(np.int64)
    at = np.searchsorted(starts, offsets)
    grams = gram_hashes(hashes, 2)
    kinds = _KINDS[raw]
    rows = []
    for t in range(n):
        a, b = at[t], at[t + 1]
        own = np.unique(np.concatenate([buckets[a:b], stem_buckets[a:b]]))
        shares = np.bincount(kinds[offsets[t] : offsets[t + 1]], minlength=7)
        total, n_words = max(int(shares.sum()), 1), b - a
        repeats = 1 - len(np.unique(grams[a : b - 1])) / (n_words - 1) if n_words > 1 else 0.0
        values = [int(20 * s / total + 0.999) for s in shares] + [int(10 * repeats + 0.999), int(n_words).bit_length()]
        shape = [_shape(k, min(v, 30)) for k, v in enumerate(values)] if total >= SHAPE_BYTES else []
        rows.append(np.concatenate([own, np.array(shape, np.int64)]))
    return np.concatenate(rows) if rows else np.zeros(0, np.int64), np.concatenate([[0], np.cumsum([len(r) for r in rows], dtype=np.int64)])


def _shape(kind: int, value: int) -> int:
    return BUCKETS + kind * 31 + value


N_FEATURES = BUCKETS + 9 * 31


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class CumulativeLink:
    """``weights`` over features and ordered ``cuts``."""

    def __init__(self, weights: np.ndarray, cuts: np.ndarray):
        self.weights, self.cuts = weights, cuts

    def tails(self, features: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """(text, j): P(grade >= j + 1)."""
        own = self.weights[features]
        total, active = (np.diff(np.concatenate([[0.0], np.cumsum(x, dtype=np.float64)])[bounds]) for x in (own, own != 0))
        return _sigmoid((total / np.maximum(active, 1.0) ** DAMPING)[:, None] - self.cuts[None, :])


def screen(features: np.ndarray, owner: np.ndarray, grades: np.ndarray, least: int, deviations: float, lift: float) -> np.ndarray:
    """The features in at least ``least`` texts that mark a grade.

    Their share of that grade's texts exceeds their share of the others' by
    ``deviations`` standard errors and ``lift`` times; features that only follow
    the length of a text don't.
    """
    keep = np.zeros(N_FEATURES, bool)
    keep[features] = True
    used = np.flatnonzero(keep)  # counts are of these only: arrays of all features would fill the driver
    place = np.zeros(N_FEATURES, np.int32)
    place[used] = np.arange(len(used), dtype=np.int32)
    features = place[features]
    n, seen = len(grades), np.bincount(features, minlength=len(used))
    marks, of = np.zeros(len(used), bool), grades.astype(np.int8)[owner]
    pooled = np.clip(seen / max(n, 1), 1e-9, 1 - 1e-9)
    for g in np.unique(grades):
        m = int((grades == g).sum())
        own = np.bincount(features[of == g], minlength=len(used))
        share, rest = own / m, (seen - own) / max(n - m, 1)
        marks |= (share - rest > deviations * np.sqrt(pooled * (1 - pooled) * (1 / m + 1 / max(n - m, 1)))) & (share > lift * rest)
    keep[used] = marks & (seen >= least)
    return keep


def fit(features: np.ndarray, bounds: np.ndarray, grades: np.ndarray, totals: np.ndarray | None = None, top: int = TOP_GRADE, rounds: int = 300, rate: float = 0.05, penalty: float = 1e-4, least: int = 8, deviations: float = 5.0, lift: float = 6.0) -> CumulativeLink:
    """Penalised maximum likelihood of the cumulative-link model on the screened features; ``totals``: of how many texts of each grade these are a sample."""
    n, k = len(grades), top
    owner = np.repeat(np.arange(n, dtype=np.int32), np.diff(bounds))
    keep = screen(features, owner, grades, least, deviations, lift)[features]
    used, columns = np.unique(features[keep], return_inverse=True)
    owner = owner[keep]
    value = 1.0 / np.maximum(np.bincount(owner, minlength=n), 1.0)[owner] ** DAMPING
    own = np.maximum(np.bincount(grades, minlength=k + 1), 1)
    totals = own if totals is None else np.asarray(totals, float)[: k + 1]
    share = (totals / own / totals.sum())[grades]
    w, cuts = np.zeros(len(used)), np.linspace(-0.5, 0.5, k)
    m = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(cuts), np.zeros_like(cuts)]
    for step in range(1, rounds + 1):
        z = np.bincount(owner, w[columns] * value, n)
        p = np.concatenate([np.ones((n, 1)), _sigmoid(z[:, None] - cuts), np.zeros((n, 1))], axis=1)
        at = np.arange(n)
        mass = np.maximum(p[at, grades] - p[at, grades + 1], 1e-9)
        slope = p * (1 - p)
        d_upper, d_lower = slope[at, grades] / mass, slope[at, grades + 1] / mass  # of log mass, by z - cut
        dz = (d_upper - d_lower) * share
        dc = np.zeros((n, k + 2))
        dc[at, grades] -= d_upper * share
        dc[at, grades + 1] += d_lower * share
        grads = np.bincount(columns, dz[owner] * value, len(w)) - penalty * w, dc[:, 1:-1].sum(axis=0)
        for i, (x, g) in enumerate(zip((w, cuts), grads)):
            m[2 * i] = 0.9 * m[2 * i] + 0.1 * g
            m[2 * i + 1] = 0.99 * m[2 * i + 1] + 0.01 * g * g
            x += rate * (m[2 * i] / (1 - 0.9**step)) / (np.sqrt(m[2 * i + 1] / (1 - 0.99**step)) + 1e-12)
        cuts.sort()
    weights = np.zeros(N_FEATURES, np.float32)
    weights[used] = w
    return CumulativeLink(weights, cuts)


def grade_of(quality: Column, toxic: Column) -> Column:
    """The graded rating of a label: 0 low quality, 1 toxic, 2 good; null labels count as 0."""
    return F.when(F.coalesce(quality, F.lit(0)) == 0, 0).when(F.coalesce(toxic, F.lit(0)) == 1, 1).otherwise(2)


def train(docs: DataFrame, labels: DataFrame, per_grade: int = FIT_PER_GRADE) -> CumulativeLink:
    """Fit on at most ``per_grade`` labelled documents of each of the three grades, those of least hash.

    The sample is a documented bound for a fitted model; scoring covers every document.
    Equal texts count once, with the label of the least doc_id. Labels without a document are left
    out; without any labelled document the model finds every text good.
    """
    graded = labels.select("doc_id", grade_of(F.col("quality"), F.col("toxic")).alias("grade")).withColumn("h", F.xxhash64("doc_id"))
    totals = {r["grade"]: r["count"] for r in graded.groupBy("grade").count().collect()}  # three rows at most
    picked = None
    for grade in range(3):
        some = graded.where(F.col("grade") == grade).orderBy("h", "doc_id").limit(per_grade)
        picked = some if picked is None else picked.union(some)
    # At most 3 * per_grade rows of two longs.
    sample = docs.select("doc_id", "text").join(F.broadcast(picked.select("doc_id", "grade")), "doc_id").groupBy("text").agg(F.min(F.struct("doc_id", "grade")).alias("first")).select("text", "first.*")

    @lean
    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, bounds = hashed_features(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("grade"), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values.astype(np.int32)))], ["doc_id", "grade", "features"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = sample.mapInArrow(extract, f"doc_id {kind}, grade int, features array<int>").toArrow().sort_by("doc_id").combine_chunks()
    if not rows.num_rows:
        return CumulativeLink(np.zeros(N_FEATURES, np.float32), np.array([-5.0, -4.0]))  # p_good is above any threshold in use
    lists = rows["features"].combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    bounds = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(), dtype=np.int64)])
    model = fit(lists.flatten().to_numpy(), bounds, rows["grade"].to_numpy().astype(int), np.array([totals.get(g, 0) for g in range(3)]))
    del rows, lists
    give_back()  # the driver's, before the next jobs
    return model


_SCORES = ("expected_grade", "p_toxic_or_good", "p_good")


def _scored(docs: DataFrame, model: CumulativeLink, text_of) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast((np.flatnonzero(model.weights), model.weights[model.weights != 0], model.cuts))
    schema = StructType([*docs.schema.fields, *(StructField(n, DoubleType()) for n in _SCORES)])

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used, values, cuts = shared.value
        weights = np.zeros(N_FEATURES, np.float32)
        weights[used] = values
        link = CumulativeLink(weights, cuts)
        for whole in batches:
            for lo in range(0, whole.num_rows, 500):
                part = whole.slice(lo, 500)
                tails = link.tails(*hashed_features(text_of(part)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(tails.sum(axis=1)), pa.array(tails[:, 0]), pa.array(tails[:, -1])], [*part.schema.names, *_SCORES])

    return docs.mapInArrow(run, schema)


def score_quality(docs: DataFrame, model: CumulativeLink) -> DataFrame:
    """All columns of ``docs`` and expected_grade, p_toxic_or_good, p_good. A null text is empty. Nothing is shuffled."""
    return _scored(docs, model, lambda batch: batch.column("text"))


def select_good(docs: DataFrame, labels: DataFrame, least: float = KEEP, per_grade: int = FIT_PER_GRADE) -> DataFrame:
    """The documents whose tail probability of the top grade is at least ``least``, with their own columns only."""
    inner = docs.select(F.struct("*").alias("row"))  # a struct, so that no column of theirs can clash with a score
    scored = _scored(inner, train(docs, labels, per_grade), lambda batch: batch.column("row").field("text"))
    return scored.where(F.col("p_good") >= least).select("row.*")
