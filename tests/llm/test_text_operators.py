"""Operators 1, 3, 7, 8 against brute force on a small hard corpus."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from duochron.llm.components import connected_components
from duochron.llm.decontaminate import contamination, drop_contaminated
from duochron.llm.jaccard import keep_one_each, least_overlap, may_link, near_duplicates, parity_sketch, prefix_length, star_links
from duochron.llm.perplexity import base_counts, quality_rules
from duochron.llm.sharding import difference, shard_by_bytes, write_shards
from duochron.llm.shingles import hash_spans, shingle_sets, word_hashes

from .conftest import words

SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def sets_of(corpus):
    out = []
    for _, text, *_ in corpus:
        w = SPACED.findall(lower(text))
        out.append(frozenset(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))) if w else frozenset())
    return out


def brute_components(corpus):
    sets, parent = sets_of(corpus), list(range(len(corpus)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    groups = defaultdict(list)
    for k in range(len(sets)):
        groups[find(k)].append(k)
    out = []
    for k, s in enumerate(sets):
        ids = [corpus[m][0] for m in groups[find(k)] if corpus[m][0] is not None] if s else [corpus[k][0]]
        out.append((corpus[k][0], len(s), min(ids) if ids else None))
    return out


def test_near_duplicates(docs, corpus):
    got = [tuple(r) for r in near_duplicates(docs).collect()]
    assert Counter(got) == Counter(brute_components(corpus))


@pytest.mark.parametrize("shingles", [1, 200, 2000])
def test_near_duplicates_of_split_lists_and_stars(docs, corpus, monkeypatch, shingles):
    import duochron.llm.common as C
    import duochron.llm.jaccard as J

    monkeypatch.setattr(J, "LIST_ENTRIES", 1)
    monkeypatch.setattr(J, "STAR_SHINGLES", shingles)
    monkeypatch.setattr(C, "BROADCAST_ROWS", 0)
    assert Counter(tuple(r) for r in near_duplicates(docs).collect()) == Counter(brute_components(corpus))


def test_sketches_are_no_broadcast(docs, corpus, monkeypatch):
    import duochron.llm.common as C
    import duochron.llm.jaccard as J

    broadcast, real = [], C.F.broadcast
    monkeypatch.setattr(C.F, "broadcast", lambda df: broadcast.append(df.columns) or real(df))
    assert Counter(tuple(r) for r in J.near_duplicates(docs).collect()) == Counter(brute_components(corpus))
    assert broadcast and not any("sketch" in columns for columns in broadcast)


def test_broadcasts_stay_below_what_a_small_driver_holds(spark, monkeypatch):
    import duochron.llm.common as C

    held, real = [], C.F.broadcast
    monkeypatch.setattr(C.F, "broadcast", lambda df: held.append(df.count()) or real(df))
    links = spark.range(60_000).select((F.col("id") * 2).alias("a"), (F.col("id") * 2 + 1).alias("b"))
    assert connected_components(links).where("component != node - node % 2").isEmpty()
    assert all(n <= 50_000 for n in held)


def test_only_wanted_texts_move(docs, corpus, spark, monkeypatch):
    import duochron.llm.jaccard as J

    monkeypatch.setattr(J, "FEW_ROWS", 0)
    moved, real = [], J._among
    monkeypatch.setattr(J, "_among", lambda every, where: moved.append((real(every, where), where)) or moved[-1][0])
    assert Counter(tuple(r) for r in J.near_duplicates(docs).collect()) == Counter(brute_components(corpus))
    assert moved
    for left, where in moved:
        assert {r.k for r in left.collect()} == {r.at_k for r in where.collect()}
    many = spark.range(200_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"), F.xxhash64("id").alias("k"))
    wanted = many.where("doc_id < 60000").select(F.col("k").alias("at_k"))
    left = real(many, wanted)
    assert left.where("doc_id < 60000").count() == 60_000 and left.count() < 61_000


@pytest.mark.parametrize("longest", [1, 8])
def test_pairs_that_share_few_lists_go(spark, monkeypatch, longest):
    import duochron.llm.jaccard as J

    # Seven texts that share a rare passage and no more; what else they hold is met in many other texts. And near copies of other texts.
    rng = random.Random(8)
    passage, bodies = words(rng, 9, 10**6), [words(rng, 80, 10**6) for _ in range(7)]
    rows = [(k, passage + " " + body) for k, body in enumerate(bodies)]
    rows += [(10 + 10 * k + j, body + " " + words(rng, 300, 10**6)) for k, body in enumerate(bodies) for j in range(10)]
    for k in range(8):
        w = words(rng, 90, 10**6).split()
        for copy in range(k + 4):
            other = list(w)
            other[rng.randrange(90)] = f"c{copy}"
            if copy % 3 == 2:
                other[rng.randrange(90)] = f"d{copy}"
            rows.append((100 * (k + 1) + copy, " ".join(other[copy:])))
    seen, real = [], J._stars
    monkeypatch.setattr(J, "SHORT_LIST", longest)
    monkeypatch.setattr(J, "_stars", lambda *args: seen.append(real(*args)) or seen[-1])
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert Counter(tuple(r) for r in J.near_duplicates(docs).collect()) == Counter(brute_components(rows))
    ids = dict(zip((r[0] for r in rows), J._set_ids(shingle_sets(pa.array([r[1] for r in rows]))).tolist()))
    apart = {ids[k] for k in range(7)}
    met = [r for r in seen[0].collect() if {r["a"], r["b"]} & apart]
    assert bool(met) == (longest < 8)


def test_sets_that_link_meet_in_the_lists_needed():
    from duochron.llm.jaccard import lists_needed

    rng = np.random.default_rng(4)
    for _ in range(3000):
        every = rng.permutation(rng.integers(1, 60))
        a, b = (np.sort(every[rng.random(len(every)) < rng.choice([0.8, 0.9, 1.0])]) for _ in range(2))
        both = len(np.intersect1d(a, b))
        if both and 100 * both >= 75 * (len(a) + len(b) - both):
            met = len(np.intersect1d(a[: prefix_length(len(a), 75)], b[: prefix_length(len(b), 75)]))
            assert met >= max(1, lists_needed(len(a), len(b), 75))


@pytest.mark.parametrize("lists", [1, 2, 12])
def test_sets_that_link_meet_early_in_the_lists_needed(monkeypatch, lists):
    import duochron.llm.jaccard as J

    monkeypatch.setattr(J, "LISTS", lists)
    rng = np.random.default_rng(6)
    for _ in range(3000):
        every = rng.permutation(rng.integers(1, 160))
        sets = [np.sort(every[rng.random(len(every)) < rng.choice([0.8, 0.9, 1.0])]) for _ in range(2)]
        a, b = sorted(sets, key=len)
        both = np.intersect1d(a, b)
        if len(both) and 100 * len(both) >= 75 * (len(a) + len(b) - len(both)):
            met = np.intersect1d(*(s[: prefix_length(len(s), 75)] for s in (a, b)))
            meta = np.stack([(np.searchsorted(s, met) << 32) + len(s) for s in (a, b)], axis=1).ravel()
            starts, counts = np.arange(len(met)) * 2, np.full(len(met), 2)
            rows = J._pairs(meta, np.tile([7, 8], len(met)), starts, counts, 75)
            needed = min(lists, int(J.lists_needed(len(a), len(b), 75)))
            assert rows[:, 3].min() == needed <= len(rows)
            # In long lists as many are seen, by both sets.
            seen = J._blocks_that_reach(meta, starts, counts, 75, lists - 1)
            assert min(seen[::2].sum(), seen[1::2].sum()) >= needed


def test_sets_that_meet_by_chance_give_no_rows(spark):
    import duochron.llm.jaccard as J

    def groups(size):
        """Texts of 60, 90, 135 ... words that share the passage of their group, and one near copy of each text."""
        rng = random.Random(9)
        rows = []
        for g in range(10):
            passage = words(rng, 14, 10**6)
            for k in range(size):
                w = words(rng, 60 * 3**k // 2**k, 10**6)
                rows += [(1000 * g + 10 * k, f"{passage} {w}"), (1000 * g + 10 * k + 1, f"{passage} {w} end")]
        return rows

    found = {}
    for size in (2, 4):
        rows = groups(size)
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        assert Counter(tuple(r) for r in J.near_duplicates(docs).collect()) == Counter(brute_components(rows))
        index = J._index(docs, 5, 75, np.zeros(1 << J.SKETCH_BITS, np.uint8), 255).repartition(1)
        found[size] = J._lists(index, 75).where("kind = 2").select("x", "sid").distinct().count()
    assert found == {2: 20, 4: 40}  # a pair of each text and its copy; all that meet in an indexed list are 60 and 232


def test_star_links_against_all_pairs():
    rng = np.random.default_rng(3)
    for trial in range(60):
        base = np.unique(rng.integers(0, 1 << 40, 60).astype(np.uint64))
        sets = []
        for _ in range(12):
            kept = base[rng.random(len(base)) < rng.choice([0.8, 0.9, 1.0])]
            sets.append(np.unique(np.concatenate([kept, rng.integers(0, 40, rng.integers(0, 25)).astype(np.uint64)])))
        apart = [100 * len(np.intersect1d(s, sets[0])) < 75 * len(np.union1d(s, sets[0])) for s in sets[1:]]
        guests = (np.arange(11) >= 7) & apart if trial % 2 else None  # guests don't link with the leader
        links, outside = star_links(sets[0], sets[1:], 75, guests)
        every = [set(s.tolist()) for s in sets[1:]] + [set(sets[0].tolist())]
        real = {(a, b) for a in range(-1, 11) for b in range(-1, 11) if a != b and 100 * len(every[a] & every[b]) >= 75 * len(every[a] | every[b])}
        assert all(link in real for link in links)
        if guests is not None:  # pairs of the star's own sets were compared before
            real = {(a, b) for a, b in real if -1 in (a, b) or guests[a] != guests[b]}
        label = {k: k for k in range(-1, 11)}
        found = dict(label)
        for names, pairs in ((label, real), (found, links)):
            for _ in range(12):
                for a, b in pairs:
                    names[a] = names[b] = min(names[a], names[b])
        assert label == found and (guests is not None or outside == [k for k in range(11) if label[k] != -1])


def test_sketches_let_every_link_through():
    rng = np.random.default_rng(8)
    for _ in range(40):
        base = rng.integers(0, 1 << 63, rng.integers(1, 300)).astype(np.uint64)
        sets = [np.unique(np.append(base[rng.random(len(base)) < rng.choice([0.1, 0.7, 0.95])], rng.integers(0, 1 << 63, rng.integers(1, 40)).astype(np.uint64))) for _ in range(12)]
        ok = may_link(np.array([len(x) for x in sets]), [parity_sketch(x) for x in sets], np.arange(12), 75)
        real = [any(k != m and 100 * len(np.intersect1d(x, y)) >= 75 * len(np.union1d(x, y)) for m, y in enumerate(sets)) for k, x in enumerate(sets)]
        assert (ok >= real).all()
    apart = [np.unique(rng.integers(0, 1 << 63, 200).astype(np.uint64)) for _ in range(10)]
    assert not may_link(np.array([len(x) for x in apart]), [parity_sketch(x) for x in apart], np.arange(10), 75).any()


def test_one_of_each_group_stays(docs, corpus):
    kept = keep_one_each(docs)
    assert kept.columns == docs.columns
    groups = Counter()
    for r in kept.collect():
        groups[r["doc_id"]] += 1
    want = {}
    for (doc, n, component), (_, text, *_) in zip(brute_components(corpus), corpus):
        key = ("empty", doc, text) if not n else ("group", component if component != 100 else (100, text))
        want.setdefault(key, doc)
    assert sum(groups.values()) == len(want)
    assert {31, 32, 33, 34, 35}.isdisjoint(groups) and groups[1] == groups[2] == groups[3] == 1


def test_prefix_and_overlap_bounds():
    for n in range(1, 60):
        assert prefix_length(n, 75) == n - int(np.ceil(0.75 * n)) + 1
        for m in range(1, 60):
            i = least_overlap(n, m, 75)
            assert 100 * i >= 75 * (n + m - i) and 100 * (i - 1) < 75 * (n + m - i + 1)


def test_empty_tables(docs, spark):
    none = docs.limit(0)
    bench = spark.createDataFrame([], "item_id long, text string")
    for df in (near_duplicates(none), keep_one_each(none), shard_by_bytes(none, 4), contamination(none, bench), quality_rules(none)):
        assert df.count() == 0


def test_components(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (7, 200)], "a long, b long")
    got = {r.node: r.component for r in connected_components(links).collect()}
    assert all(got[k] == 0 for k in [*range(41), 200]) and got[101] == 100


def test_hashing_is_by_content():
    a = pa.array(["a b c", "b", None, "", "A\x0bB  c", "é b", "a b"])
    h, at = word_hashes(a)
    assert np.diff(at).tolist() == [3, 1, 0, 0, 3, 2, 1]
    assert h[0] == h[4] and h[1] == h[3] and len(set(h.tolist())) == 5
    assert (shingle_sets(a.slice(4, 1))[0] == shingle_sets(a)[4]).all()
    raw = np.frombuffer(b"abcabc", np.uint8)
    x = hash_spans(raw, np.array([0, 3]), np.array([3, 6]))
    assert x[0] == x[1]


# ---- sharding ----


def test_shards_are_balanced_whole_and_numbered(docs, corpus):
    rows = shard_by_bytes(docs, 7, block_groups=10, slot_rows=5).collect()
    assert len(rows) == len(corpus)
    want = Counter((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t, *_ in corpus)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == want
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < 7
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len({r.shard for r in rows if r.text_crc32 == zlib.crc32(corpus[18][1].encode())}) == 1
    groups = Counter()
    for (_, t, *_), s in zip(corpus, range(len(corpus))):
        groups[t] += len((t or "").encode()) + 16
    load = Counter()
    for r in rows:
        load[r.shard] += r["size"]
    rest = [load[s] for s in range(7)]
    top = max(groups.values())
    assert max(rest) - min(rest) <= top


def test_differencing_beats_or_equals_the_largest_item():
    rng = np.random.default_rng(2)
    x = rng.integers(1, 1000, 300)
    p = np.zeros((300, 8), np.int64)
    p[:, 0] = x
    slot = difference(p)[:, 0]
    load = np.bincount(slot, x, 8)
    assert load.sum() == x.sum() and load.max() - load.min() <= 10
    assert difference(np.array([[5, 0]]))[0].tolist() in ([0, 1], [1, 0])


@pytest.mark.parametrize("shares", [[0.5], [1.0], [0.9, 0.6, 0.3, 0.02]])
def test_blocks_leave_room_for_large_groups(spark, shares):
    from duochron.llm.sharding import assign_groups

    rng = np.random.default_rng(3)
    small = np.maximum(rng.lognormal(7, 1, 6000), 16).astype(int).tolist()
    fair = sum(small) / (8 - sum(shares))
    sizes = small + [int(x * fair) for x in shares]
    groups = spark.createDataFrame([(k.to_bytes(4, "big"), n) for k, n in enumerate(sizes)], "key binary, bytes long").repartition(3)
    got = assign_groups(groups, 8, len(sizes), block_groups=1000).collect()
    load = np.zeros(8)
    for r in got:
        load[r.shard] += sizes[int.from_bytes(r.key, "big")]
    assert len({bytes(r.key) for r in got}) == len(got) == len(sizes) and load.max() / load.mean() < 1.001


def test_written_shards_hold_every_text(docs, corpus, tmp_path, spark):
    write_shards(docs, str(tmp_path / "s"), 3)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == len(corpus) and back.select("kk_shard").distinct().count() <= 3


# ---- decontamination ----

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_contamination(corpus, items):
    import hashlib

    windows = defaultdict(set)
    for item, text in items:
        w = WORD.findall(lower(text))
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[i : i + n])].add(str(item))
    out = []
    for doc, text, *_ in corpus:
        w = WORD.findall(lower(text))
        hit, found = set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[tuple(w[i : i + n])]
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


@pytest.fixture(scope="module")
def items(corpus):
    long = corpus[-5][1].split()
    return [(7, " ".join(long[100:130])), (11, " ".join(long[110:125]).upper()), (12, corpus[40][1]), (13, "one"), (14, ""), (15, None), (16, "a-b; c"), (17, " ".join(long[29990:])), (18, "never seen words in any of these documents at all, nowhere"), (7, "w1 w2 w3")]


def test_contamination(docs, corpus, items, spark):
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = Counter(tuple(r) for r in contamination(docs, bench).collect())
    want = Counter(brute_contamination(corpus, items))
    assert got == want
    clean = drop_contaminated(docs, bench)
    assert clean.columns == docs.columns and clean.count() == sum(1 for r in brute_contamination(corpus, items) if not r[5])


def test_text_ids_and_pipeline_stages_of_odd_tables(spark, items):
    bench = spark.createDataFrame(items, "item_id long, text string")
    named = spark.createDataFrame([("a", "one"), ("b", "two words here"), (None, "three")], "doc_id string, text string")
    assert {r.doc_id for r in drop_contaminated(named, bench).collect()} == {"b", None}


def test_winnowing_runs_no_python(docs, items, spark, monkeypatch):
    plan = contamination(docs, spark.createDataFrame(items, "item_id long, text string"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_every_window_length_is_found_at_every_place(spark):
    rng = np.random.default_rng(9)
    item = [f"k{x}" for x in rng.integers(0, 10**6, 10)]
    rows = [(k, " ".join(f"r{k}q{m}" for m in range(k)) + " " + " ".join(item) + " end of it", "en", "a") for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = contamination(docs, spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()
    assert all(r.n_hit == 10 and r.contaminated for r in got)


# ---- quality rules ----


def brute_base(text):
    text = text or ""
    w = SPACED.findall(text)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    marked = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if SPACED.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(marked)


HARD = ["a b c a b c", "x y\nx y\n\n \n \nx y ", "é#à|&", None, "", "a a a a", "\n", "l\r\nl\r\n", "日本 語\n日本 語", "one"]


def test_base_counts():
    got = base_counts(pa.array(HARD, pa.string()))
    assert list(zip(*(got[k].tolist() for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")))) == [brute_base(t) for t in HARD]


def test_quality_rules(docs, corpus):
    got = Counter(tuple(r)[:6] for r in quality_rules(docs).collect())
    assert got == Counter((d, *brute_base(t)) for d, t, *_ in corpus)
    for r in quality_rules(docs).collect():
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)


BITS, ORDER = 5, 4


def _discounts(counts: np.ndarray) -> np.ndarray:
    """The discount for a count of 0, 1, 2 and of 3 or more."""
    n = [max(float((counts == k).sum()), 1e-9) for k in (1, 2, 3, 4)]
    y = n[0] / (n[0] + 2 * n[1])
    return np.array([0.0] + [min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.05 * k), 0.95 * k) for k in (1, 2, 3)])


def kneser_ney(grams: np.ndarray, counts: np.ndarray) -> dict[str, np.ndarray]:
    """The same model of one language over 32 symbols, in one process, for comparison: sorted ``keys`` with ``logp``; ``back`` per 3-symbol history; ``lower``, the next order's log probability."""
    by = np.argsort(grams)
    keys, counts = grams[by].astype(np.int64), counts[by].astype(np.float64)
    tables = [(keys, counts)]
    for order in range(ORDER - 1, 0, -1):  # continuation counts: distinct left neighbours
        tables.append(np.unique(tables[-1][0] & ((1 << BITS * order) - 1), return_counts=True))
    lower = np.full(1, 1.0 / (1 << BITS))
    for order, (k, c) in enumerate(reversed(tables), 1):
        c = c.astype(np.float64)
        discount = _discounts(c)[np.minimum(c, 3).astype(int)]
        history = k >> BITS
        n_histories = 1 << BITS * (order - 1)
        total = np.bincount(history, c, n_histories)
        gamma = np.where(total > 0, np.bincount(history, discount, n_histories) / np.maximum(total, 1), 1.0)
        shorter = (1 << BITS * (order - 1)) - 1
        if order == ORDER:
            p = (c - discount) / total[history] + gamma[history] * lower[k & shorter]
            return {"keys": k.astype(np.int32), "logp": np.log(p).astype(np.float32), "back": np.log(gamma).astype(np.float32), "lower": np.log(lower).astype(np.float32)}
        every = np.arange(1 << BITS * order)
        dense = gamma[every >> BITS] * (lower[every & shorter] if order > 1 else lower[0])
        dense[k] += (c - discount) / total[history]
        lower = dense
    raise AssertionError


def expand(model: dict[str, np.ndarray]) -> np.ndarray:
    """Log probability by 4-gram code: the sorted arrays laid over their back-off."""
    codes = np.arange(1 << BITS * ORDER, dtype=np.int64)
    out = model["back"][codes >> BITS] + model["lower"][codes & ((1 << BITS * (ORDER - 1)) - 1)]
    out[model["keys"]] = model["logp"]
    return out


def test_the_model_is_a_distribution():
    rng = np.random.default_rng(1)
    grams, counts = np.unique(rng.integers(0, 1 << 20, 4000) & 0b00011_00111_00011_01111, return_counts=True)
    p = np.exp(expand(kneser_ney(grams, counts)).astype(float)).reshape(-1, 32).sum(axis=1)
    np.testing.assert_allclose(p, 1.0, atol=1e-3)


def test_odd_text_leaves_its_band(spark):
    rng = np.random.default_rng(4)
    plain = [" ".join("".join(rng.choice(list("aeinrst"), rng.integers(2, 7))) for _ in range(80)) for _ in range(60)]
    odd = " ".join("".join(rng.choice(list("qxzjkw0123456789#*"), 6)) for _ in range(80))
    docs = spark.createDataFrame([(k, t, "en") for k, t in enumerate([*plain, odd])], "doc_id long, text string, lang string")
    kept = {r.doc_id for r in quality_rules(docs).where("kept").collect()}
    assert kept == set(range(60))


@pytest.mark.parametrize("held", [4_000_000, 0])
def test_scripts_beyond_ascii_and_languages_have_models_of_their_own(spark, monkeypatch, held):
    import duochron.llm.perplexity as P

    rng, monk = np.random.default_rng(6), monkeypatch
    monk.setattr(P, "MODEL_GRAMS", held)
    monk.setattr(P, "SLICE_GRAMS", 50)
    monk.setattr(P, "SLAB_BYTES", 4000)
    monk.setattr(P, "CHUNK_POINTS", 700)
    words = ["".join(map(chr, rng.integers(0x430, 0x450, rng.integers(2, 7)))) for _ in range(30)]
    prose = [" ".join(rng.choice(words, 80)) for _ in range(60)]
    odd = " ".join("".join(map(chr, rng.integers(0x430, 0x450, len(w)))) for w in prose[0].split())  # the same spaces and lengths
    rows = [(k, t, "ru") for k, t in enumerate([*prose, odd])] + [(100, odd, None), (None, odd, "xx"), (101, None, "ru"), (102, "", "ru")]
    got = {(r.doc_id, r.lang): r for r in quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)).collect()}
    assert len(got) == len(rows) and {k for k, r in got.items() if r.kept and k[1] == "ru"} == {(k, "ru") for k in range(60)}
    assert got[101, "ru"].log_perplexity is None and got[102, "ru"].log_perplexity is None

    def model(texts):
        tables = [Counter(("\0" * 3 + t)[i : i + 4] for t in texts for i in range(len(t)))]
        for _ in range(3):
            tables.append(Counter(g[1:] for g in tables[-1]))
        p = {"": 1 / (len(tables[-1]) + 1)}
        for t in reversed(tables):
            grams = list(t)
            cut = dict(zip(grams, _discounts(np.array([t[g] for g in grams]))[[min(t[g], 3) for g in grams]]))
            total, left = Counter(), Counter()
            for g in grams:
                total[g[:-1]] += t[g]
                left[g[:-1]] += cut[g]
            p = {g: (t[g] - cut[g] + left[g[:-1]] * p[g[1:]]) / total[g[:-1]] for g in grams}
        return p

    for lang in ("ru", None, "xx"):
        own = [(d, t) for d, t, x in rows if x == lang and t]
        p = model([t for _, t in own])
        for d, t in own:
            want = -np.mean([np.log(p[("\0" * 3 + t)[i : i + 4]]) for i in range(len(t))])
            assert abs(got[d, lang].log_perplexity - want) < 1e-5


def test_grams_of_more_symbols_than_a_packed_code_holds():
    from duochron.llm.perplexity import distinct_grams

    text = "".join(map(chr, [*range(0x3400, 0xD7FF), *range(0x10000, 0x14000)])) + "abcabcabc"
    history, symbol, counts, inverse, bounds = distinct_grams([text, "", "abc"])
    assert len(set(zip(history.tolist(), symbol.tolist()))) == len(history) and counts.sum() == len(text) + 3 == bounds[-1]
    assert (symbol[inverse] == [ord(c) + 1 for c in text + "abc"]).all() and sorted(counts.tolist())[-4:] == [1, 2, 2, 2]
