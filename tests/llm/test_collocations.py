"""Phrases against brute force in Python integers."""

import random
import re
from collections import Counter

import pytest

from duochron.llm import collocations as C


def brute_force(rows, least, top):
    total, f = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", text):
            words = [w for w in re.split("[ \t]+", piece) if w]
            total[lang] += len(words)
            for n in range(1, 6):
                for i in range(len(words) - n + 1):
                    f[lang, tuple(words[i : i + n])] += 1
    found = {k: v for k, v in f.items() if len(k[1]) > 1 and v >= least}
    inside = {(lang, p[i : i + m]) for (lang, p), v in found.items() for m in range(2, len(p)) for i in range(len(p) - m + 1) if v >= found[lang, p[i : i + m]]}
    out = {}
    for (lang, p), a in found.items():
        if (lang, p) not in inside:
            score, _, left, right = min((1000 * a * total[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
            out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), left, right))
    return sorted((lang, rank, p.decode(), -a, left, right, total[lang], -score) for lang, all_ in out.items() for rank, (score, a, p, left, right) in enumerate(sorted(all_)[:top], 1))


def made_rows(seed):
    rng = random.Random(seed)
    vocabulary = ["alpha", "Beta", "gamma", "delta", "é", "ζ", "x\x0by", "eps", "rare%d", "o'k", "-"]
    set_phrases = ["new york city", "to be or not to be", "a b c d e f g"]
    rows = [(None, None), ("en", None), ("en", ""), (None, "Two words"), ("en", " .. ,\t")]
    for k in range(120):
        words = [rng.choice(set_phrases) if rng.random() < 0.3 else rng.choice(vocabulary).replace("%d", str(k)) for _ in range(rng.randint(1, 25))]
        rows.append((rng.choice(["en", "en", "de", None]), "".join(w + rng.choice([" ", " ", " ", "\t", ". ", ",", "\n"]) for w in words)))
    return rows + rows[5:9] * 3


@pytest.mark.parametrize(("seed", "words"), [(1, 1_000_000), (2, 0)])
def test_equals_brute_force(spark, monkeypatch, seed, words):
    """Many ranges and small sorts; a bound of no words joins words with the dictionary."""
    for name, value in {"DICTIONARY_WORDS": words, "SORT_KEYS": 150, "RANGE_BYTES": 1500, "WORD_BYTES": 2000, "TEXT_BYTES": 300, "COUNTED_WORDS": 20}.items():
        monkeypatch.setattr(C, name, value)
    rows = made_rows(seed)
    docs = spark.createDataFrame([(*r, 1, "k") for r in rows], "lang string, text string, n int, key string").repartition(4)
    for top in (2000, 3):
        found = sorted(tuple(r) for r in C.collocations(docs, 5, top).collect())
        assert found == brute_force(rows, 5, top)
    assert any(r[3] > 20 for r in found)


def test_empty_table_and_a_very_long_text(spark):
    docs = spark.createDataFrame([("en", "a b " * 200_000)], "lang string, text string")
    assert [tuple(r) for r in C.collocations(docs, 100).collect()] == brute_force([("en", "a b " * 200_000)], 100, 2000)
    assert C.collocations(docs.limit(0)).count() == 0


def test_exact_beyond_64_bits(spark):
    counts = spark.createDataFrame([(1, (1).to_bytes(8, "big"), 10**15), (1, (2).to_bytes(8, "big"), 3 * 10**14), (2, (1).to_bytes(8, "big") + (2).to_bytes(8, "big"), 10**14 + 7)], "size int, key binary, f long")
    totals = spark.createDataFrame([((1).to_bytes(8, "big"), "en", 10**16 + 1)], "word binary, lang string, n long")
    row = C._cut_scores(counts, totals).first()
    assert row.score == 1000 * (10**14 + 7) * (10**16 + 1) // (10**15 * 3 * 10**14)


def test_ids_have_no_gaps_whatever_the_partitions(spark):
    words = spark.createDataFrame([("en", f"w{k}") for k in range(100)], "lang string, word string")
    for n in (1, 7, 40):
        assert sorted(r.id for r in C._numbered(words.repartition(n)).collect()) == list(range(1, 101))
