"""Hard negatives against brute force in Python integers."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from duochron.llm import negatives as N

SCHEMA = "vec_id long, embedding array<float>, label int, score int, block int"


def brute_force(rows, every, low=30, high=90, n_positives=5, n_negatives=10):
    rows = [(i, [math.floor(256 * x) for x in v], c) for i, v, c, *_ in rows if None not in (i, v, c) and all(x is not None and math.isfinite(x) for x in v)]
    size = max((len(v) for _, v, _ in rows), default=0)
    rows = [(i, v + [0] * (size - len(v)), c) for i, v, c in rows]
    out = []
    for i, v, c in rows:
        if i % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), j, d) for j, w, d in rows if j != i)
        for p, j, _ in [x for x in scored if x[2] == c][:n_positives]:
            fits = [x for x in scored if x[2] != c and low * -p <= 100 * -x[0] <= high * -p][:n_negatives]
            out += [(i, j, rank, k, -p, -s) for rank, (s, k, _) in enumerate(fits, 1)]
    return sorted(out)


def made_rows(seed, n=300, size=9, spread=1.0):
    rng = random.Random(seed)
    rows = [(k, [np.float32(rng.gauss(0.2, spread)).item() for _ in range(size)], rng.randrange(4), 0, 0) for k in range(n)]
    rows += [(n + k, list(rows[k][1]), rng.randrange(4), 0, 0) for k in range(40)]  # ties
    rows += [(rows[3][0], list(rows[3][1]), rows[3][2], 0, 0)]  # a repeated row
    rows += [(None, [1.0] * size, 1, 0, 0), (1001, None, 1, 0, 0), (1002, [1.0] * size, None, 0, 0), (1003, [None] + [1.0] * (size - 1), 1, 0, 0), (1004, [float("nan")] * size, 1, 0, 0), (1005, [float("inf")] * size, 1, 0, 0), (1010, [2.0], 1, 0, 0), (1020, [], 2, 0, 0)]
    return rows


@pytest.mark.parametrize(("seed", "few"), [(1, 1 / 16), (2, 0.6), (3, 0.0)])
def test_equals_brute_force(spark, monkeypatch, seed, few):
    for name, value in {"ROWS": 50, "ANCHORS": 7, "SHARD_BLOCKS": 2, "FEW": few}.items():
        monkeypatch.setattr(N, name, value)
    rows = made_rows(seed)
    found = N.hard_negatives(spark.createDataFrame(rows, SCHEMA).repartition(3), F.col("vec_id") % 10 == 0)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(tuple(r) for r in found.collect()) == brute_force(rows, 10)


def test_large_components_repeated_anchors_and_none(spark):
    rows = [r for r in made_rows(4, 60, 5, 3000.0)] + [(10, [1.0, 2.0], 1, 0, 0)] * 2
    docs = spark.createDataFrame(rows, SCHEMA)
    assert sorted(tuple(r) for r in N.hard_negatives(docs, F.col("vec_id") % 10 == 0).collect()) == brute_force(rows, 10)
    assert N.hard_negatives(docs.limit(0), F.col("vec_id") % 10 == 0).count() == 0
    assert N.hard_negatives(docs, F.lit(False)).count() == 0
    with pytest.raises(ValueError, match="bits"):
        N.hard_negatives(spark.createDataFrame([(1, [1e30], 1, 0, 0)], SCHEMA), F.lit(True))


def test_intervals_hold_the_score():
    """A pair that is dropped is never one that a band wants, whatever the plane at which it goes."""
    rng = np.random.default_rng(0)
    vectors, matrix = rng.integers(-500, 500, (8, 6)), rng.integers(-500, 500, (200, 6))
    low, high = np.full((8, 1), -100_000), np.full((8, 1), 400_000)
    own, _, ids, score = N.best_pairs(vectors, matrix, np.arange(200), np.ones((8, 200), bool), N.Bands(low, high, 4), 10)
    exact = vectors @ matrix.T
    for k in range(8):
        wanted = sorted((-s, i) for i, s in enumerate(exact[k].tolist()) if -100_000 <= s <= 400_000)[:4]
        assert [(-s, i) for i, s in zip(ids[own == k].tolist(), score[own == k].tolist())] == wanted
