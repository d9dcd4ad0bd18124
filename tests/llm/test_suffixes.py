"""Suffix dedup against brute force: bytes in a string of so many bytes that also starts elsewhere."""

import random
from collections import Counter

import pytest

from duochron.llm import suffixes as S
from duochron.llm.queries import op11_suffix_dedup


def brute_force(texts, least):
    """(n_bytes, kept, spans) of each text."""
    data = [(t or "").encode() for t in texts]
    counts = Counter(b[i : i + least] for b in data for i in range(len(b) - least + 1))
    out = []
    for b in data:
        covered = [False] * len(b)
        for i in range(len(b) - least + 1):
            if counts[b[i : i + least]] > 1:
                covered[i : i + least] = [True] * least
        edges = [i for i in range(len(b) + 1) if (i < len(b) and covered[i]) != (i > 0 and covered[i - 1])]
        out.append((len(b), bytes(x for x, c in zip(b, covered) if not c), list(zip(edges[::2], edges[1::2]))))
    return out


def made_texts(seed):
    """Passages shared in whole and in part, copies, copies with one byte more, runs of one letter, NUL bytes, empty and null texts."""
    rng = random.Random(seed)
    shared = ["".join(rng.choice("abcé ") for _ in range(rng.randint(10, 300))) for _ in range(6)]
    texts = [None, "", None, "a" * 500, "ab" * 100, "short"]
    for _ in range(50):
        pieces = [rng.choice(shared)[rng.randint(0, 20) : rng.randint(30, 300)] if rng.random() < 0.6 else "".join(rng.choice("abcdefé \x00") for _ in range(rng.randint(1, 60))) for _ in range(rng.randint(1, 6))]
        text = "".join(pieces)
        texts.append(text)
        if rng.random() < 0.3:
            texts.append(text)
        if rng.random() < 0.3:
            k = rng.randrange(len(text) + 1)
            texts.append(text[:k] + "!" + text[k:])
    return texts


@pytest.mark.parametrize(("seed", "hot"), [(1, 50_000), (2, 8)])
def test_equals_brute_force(spark, monkeypatch, seed, hot):
    """Many blocks, ranges and chunks; with ``hot`` of 8 many keys have their windows sorted one by one."""
    for name, value in {"BLOCK_BYTES": 1500, "RANGE_BYTES": 2000, "PRINT_BYTES": 4000, "CHUNK": 300, "HOT_KEY": hot}.items():
        monkeypatch.setattr(S, name, value)
    texts = made_texts(seed)
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t in enumerate(texts)], "doc_id long, text string, spans string, kept int").repartition(3)
    found = {r.doc_id: (r.n_bytes, bytes(r.kept), [(x.start, x.end) for x in r.spans]) for r in S.repeated_spans(docs, 40).collect()}
    assert found == dict(enumerate(brute_force(texts, 40)))


def test_null_ids_repeated_rows_and_empty_tables(spark):
    text = "".join(chr(97 + k % 7) for k in range(190)) + "0123456789"
    docs = spark.createDataFrame([(None, text), (None, text), (3, text[1:]), (3, None)], "doc_id long, text string")
    rows = sorted((r.doc_id or -1, r.n_bytes, len(r.kept)) for r in S.repeated_spans(docs).collect())
    assert rows == [(-1, 200, 0), (-1, 200, 0), (3, 0, 0), (3, 199, 199)]
    assert S.repeated_spans(docs.limit(0)).count() == 0


def test_a_very_long_text(spark):
    rng = random.Random(5)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(5000))
    filler = "".join(rng.choice("abcdefgh ") for _ in range(300_000))
    docs = spark.createDataFrame([(1, filler + passage), (2, passage + filler[:150])], "doc_id long, text string")
    found = {r.doc_id: [(x.start, x.end) for x in r.spans] for r in S.repeated_spans(docs).collect()}
    assert found == {1: [(300_000, 305_000)], 2: [(0, 5000)]}


def test_front_coding_and_the_loser_tree(spark):
    rng = random.Random(9)
    runs = [sorted({bytes(rng.choices(b"ab", k=rng.randint(0, 12))) for _ in range(rng.randint(0, 40))}) for _ in range(7)]
    coded = [S.front_code(r) for r in runs]
    assert [S.front_decode(a.tolist(), [len(s) for s in r], rest) for (a, rest), r in zip(coded, runs)] == runs
    order, common = S.merge_runs(runs, [a.tolist() for a, _ in coded])
    merged = [runs[r][p] for r, p in order]
    assert merged == sorted(s for r in runs for s in r)
    assert common[1:] == [S.common_prefix(a, b) for a, b in zip(merged, merged[1:])]


def test_query(spark, tmp_path):
    text = "word " * 60
    spark.createDataFrame([(1, text + "one"), (2, "two " + text)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in op11_suffix_dedup(spark, str(tmp_path)).collect()}
    assert rows == {1: (303, 300, 1), 2: (304, 301, 1)}  # the blank before the first word repeats too
