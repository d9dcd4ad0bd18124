import random

import pytest

LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: Extra columns whose names clash with what the operators add.
CLASH = {"size": 1, "shard": 2, "slot": 3, "n_words": 4, "kept": 5, "h": 6, "k": 7, "n": 8, "row": 9, "component": 10, "k1": 11, "band_lang": 12, "expected_grade": 13, "mix_key": 14, "value": 15}


def words(rng, n, vocabulary=400):
    return " ".join("w" + str(rng.randrange(vocabulary)) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """Rows (doc_id, text, lang, source): nulls, empty and long texts, exact and near copies, repeated rows, a null id."""
    rng = random.Random(5)
    base = words(rng, 90, 5000)
    rows = [(1, None, "en", "a"), (2, "", "en", None), (3, " \n\t ", None, "b"), (4, "one", "en", "a"), (5, "One", "en", "a"), (6, "a b c d", "de", "b")]
    for k in range(12):
        w = base.split()
        for at in rng.sample(range(90), k // 4 + 1):
            w[at] = f"x{k}y{at}"
        rows.append((10 + k, " ".join(w), "en", "a"))
    rows += [(30 + k, base, "en", "hot") for k in range(6)]
    rows += [(50 + k, words(rng, rng.randrange(20, 120)), rng.choice(["en", "fr"]), rng.choice("abc")) for k in range(40)]
    rows += [(100, words(rng, 30000, 10**6), "en", "a"), (100, "another text of a repeated id that is long enough to count", "en", "a"), (101, rows[30][1], "en", "c"), (101, rows[30][1], "en", "c"), (None, base + " tail", "en", "a")]
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    extra = [f"{k} int" for k in CLASH]
    rows = [(*r, len(r[1] or ""), *CLASH.values()) for r in corpus]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(extra)).repartition(5)
