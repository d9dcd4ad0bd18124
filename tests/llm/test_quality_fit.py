"""The cumulative-link fit against its own objective, written out plainly; features against a Python loop."""

import math
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from duochron.llm import quality as Q


def objective(weights, cuts, texts, grades, penalty):
    """Mean log probability of the grades less the penalty, one text after the other."""
    total = 0.0
    for own, g in zip(texts, grades):
        own = [f for f in own if f in weights]
        z = sum(weights[f] for f in own) / max(len(own), 1) ** Q.DAMPING
        tails = [1.0, *(1 / (1 + math.exp(-(z - c))) for c in cuts), 0.0]
        total += math.log(max(tails[g] - tails[g + 1], 1e-9))
    return total / len(texts) - penalty / 2 * sum(w * w for w in weights.values())


@pytest.fixture(scope="module")
def graded():
    rng = np.random.default_rng(4)
    texts, grades = [], []
    for _ in range(240):
        g = int(rng.integers(0, 3))
        marks = rng.choice(4, 2, replace=False) + 10 * (g if rng.random() < 0.85 else int(rng.integers(0, 3)))
        texts.append([int(x) + 1 for x in marks] + [int(x) + 100 for x in rng.choice(8, 2, replace=False)])
        grades.append(g)
    return texts, grades


def test_the_fit_is_an_optimum(graded):
    texts, grades = graded
    features, bounds = np.concatenate([np.array(t) for t in texts]), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    model = Q.fit(features, bounds, np.array(grades), rounds=6000, rate=0.01, penalty=1e-2, least=4, deviations=2.0, lift=1.5)
    used = np.flatnonzero(model.weights)
    assert len(used) >= 9 and (used < 100).all() and (np.diff(model.cuts) > 0).all()  # what all grades share is screened out
    weights, cuts = {int(f): float(model.weights[f]) for f in used}, model.cuts.tolist()
    best = objective(weights, cuts, texts, grades, 1e-2)
    slopes = []
    for f in weights:
        up, down = ({**weights, f: weights[f] + s} for s in (1e-4, -1e-4))
        slopes.append((objective(up, cuts, texts, grades, 1e-2) - objective(down, cuts, texts, grades, 1e-2)) / 2e-4)
    for k in range(len(cuts)):
        up, down = ([c + s * (j == k) for j, c in enumerate(cuts)] for s in (1e-4, -1e-4))
        slopes.append((objective(weights, up, texts, grades, 1e-2) - objective(weights, down, texts, grades, 1e-2)) / 2e-4)
    assert max(map(abs, slopes)) < 1e-3
    rng = np.random.default_rng(0)
    for _ in range(20):
        other = objective({f: w + rng.normal(0, 0.1) for f, w in weights.items()}, sorted(c + rng.normal(0, 0.05) for c in cuts), texts, grades, 1e-2)
        assert other <= best + 1e-6


def test_tails_by_hand():
    weights = np.zeros(Q.N_FEATURES, np.float32)
    weights[[3, 5]] = 2.0, -1.0
    model = Q.CumulativeLink(weights, np.array([-0.5, 0.75]))
    got = model.tails(np.array([3, 5, 9, 3]), np.array([0, 3, 4, 4]))  # features without weight don't count; a text may have none
    for row, z in zip(got, ((2 - 1) / math.sqrt(2), 2.0, 0.0)):
        assert row == pytest.approx([1 / (1 + math.exp(-(z - c))) for c in (-0.5, 0.75)], rel=1e-6)
    assert (got[:, 0] >= got[:, 1]).all()


def test_features_of_a_text_do_not_depend_on_its_batch():
    texts = ["Some plain words, some again.", None, "", "ÜBER élan 123 !!", "a" * 400 + " b " * 300]
    features, bounds = Q.hashed_features(pa.array(texts))
    for k, t in enumerate(texts):
        own, _ = Q.hashed_features(pa.array([t], pa.string()))
        assert features[bounds[k] : bounds[k + 1]].tolist() == own.tolist()
    # Distinct words and stems, whatever their case: "some" twice is one feature, and its own stem.
    words = {w.lower() for w in ("Some", "plain", "words", "again")}
    assert bounds[1] - bounds[0] <= 2 * len(words) and len(set(features[: bounds[1]].tolist())) == bounds[1]


def test_the_fit_holds_no_arrays_of_all_features():
    rng = np.random.default_rng(2)
    n = 300
    features, grades = np.sort(rng.integers(0, Q.N_FEATURES, (n, 20)), axis=1).ravel(), np.arange(n) % 3
    tracemalloc.start()
    Q.fit(features, np.arange(0, 20 * n + 1, 20), grades, rounds=2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 32e6  # one array of doubles of all features takes 17 MB
