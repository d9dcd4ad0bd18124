"""Quality rules: base counts, and a modified Kneser-Ney character n-gram model.

Spark counts every 4-gram of full code points per language over all texts. The
count table and the model grow with the corpus: every order is a table
partitioned by its n-grams, and each language has its own. The model is stored
as sorted hash arrays, in slices of the hash range. Where its counted rows are
few enough, the slices are broadcast and every task scores its own documents;
a larger model stays where it is: documents are put into slabs of some
megabytes, a slab asks for its distinct n-grams by a join with the model, and is
scored against the answer. Each language gets a lower and an upper bound of log
perplexity from the exact quartiles of its own documents.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, materialize
from .shingles import gram_hashes, hash_spans, mix, split_words, text_bytes

ORDER = 4
#: Bits of a symbol: a code point plus one; 0 stands before each text.
POINT_BITS = 21
#: Text bytes of a slab, and code points that are packed at once.
SLAB_BYTES, CHUNK_POINTS = 1 << 23, 1 << 20
#: A model of at most so many n-grams (12 bytes each) is broadcast; a larger one answers slabs of documents by a join.
MODEL_GRAMS = 4_000_000
#: N-grams of a stored slice, about.
SLICE_GRAMS = 1 << 16
#: Steps of log perplexity a unit, for the quartiles.
STEPS = 10_000
#: Languages of which the discounts may be broadcast; more are joined by shuffling.
BROADCAST_LANGS = 100_000


def symbols(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(code point plus one of every text after three zeros, first code point of each text plus the total)."""
    lengths = np.array([len(t) if t else 0 for t in texts], np.int64)
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    points = np.frombuffer("".join(t for t in texts if t).encode("utf-32-le", "surrogatepass"), np.uint32)
    pad = ORDER - 1
    padded = np.zeros(len(points) + pad * len(texts), np.int32)
    padded[np.arange(len(points)) + np.repeat(pad * np.arange(1, len(texts) + 1), lengths)] = points + 1
    return padded, bounds


def distinct_grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(histories, symbols, counts) of the distinct 4-grams that end at a code point, the place of every code point's gram in them, and the texts' bounds."""
    padded, bounds = symbols(texts)
    at = np.flatnonzero(padded)
    seen = np.zeros((1 << POINT_BITS) + 1, bool)
    seen[padded] = seen[0] = True
    alphabet = np.flatnonzero(seen)
    bits = max(int(len(alphabet) - 1).bit_length(), 1)
    if bits * ORDER < 63:  # packed by the chunk's own alphabet
        place = np.zeros(len(seen), np.int64)
        place[alphabet] = np.arange(len(alphabet))
        dense = place[padded]
        codes = dense[at]
        for k in range(1, ORDER):
            codes = codes | (dense[at - k] << bits * k)
        codes, inverse, counts = np.unique(codes, return_inverse=True, return_counts=True)
        mask = (1 << bits) - 1
        part = [alphabet[(codes >> bits * k) & mask].astype(np.int64) for k in range(ORDER)]
        history = part[3] << 2 * POINT_BITS | part[2] << POINT_BITS | part[1]
        return history, part[0].astype(np.int32), counts, inverse, bounds
    wide = padded.astype(np.int64)
    history, symbol = wide[at - 3] << 2 * POINT_BITS | wide[at - 2] << POINT_BITS | wide[at - 1], padded[at]
    by, first = _runs(history, symbol)
    starts = np.flatnonzero(first)
    inverse = np.empty(len(at), np.int64)
    inverse[by] = np.cumsum(first) - 1
    return history[by][starts], symbol[by][starts], np.diff(np.append(starts, len(at))), inverse, bounds


def _runs(history: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order by gram, and which rows in it begin a new gram."""
    by = np.lexsort((symbol, history))
    first = np.ones(len(by), bool)
    first[1:] = (history[by][1:] != history[by][:-1]) | (symbol[by][1:] != symbol[by][:-1])
    return by, first


def _sum_grams(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    history, symbol, n = (np.concatenate(x) for x in zip(*parts))
    by, first = _runs(history, symbol)
    starts = np.flatnonzero(first)
    return history[by][starts], symbol[by][starts], np.add.reduceat(n[by], starts) if len(starts) else n


def _chunks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about CHUNK_POINTS code points."""
    lo = size = 0
    for k, t in enumerate(texts):
        size += len(t) if t else 0
        if size >= CHUNK_POINTS:
            yield lo, k + 1
            lo, size = k + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def with_keys(docs: DataFrame) -> DataFrame:
    """doc_id, lang, text and lang_key, in which null differs from every language."""
    return docs.select("doc_id", "lang", "text", F.when(F.col("lang").isNull(), "").otherwise(F.concat(F.lit("="), "lang")).alias("lang_key"))


def with_slabs(docs: DataFrame, slab_bytes: int | None = None) -> DataFrame:
    """The rows with slab: rows that follow each other in a task, of about ``slab_bytes`` text bytes. Written once, so that slabs stay as they are."""
    limit = slab_bytes or SLAB_BYTES

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slab, held = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            size = np.cumsum(np.diff(text_bytes(batch.column("text"))[1])) + held
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(slab + size // limit)], [*batch.schema.names, "slab"])
            slab, held = slab + int(size[-1]) // limit if len(size) else slab, int(size[-1]) % limit if len(size) else held

    return materialize(docs.mapInArrow(deal, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema) + ", slab long"), "kn-slabs")


def count_grams(docs: DataFrame) -> DataFrame:
    """(slab long, lang_key string, history long, symbol int, n long): grams of the texts of each task by language, and by slab if ``docs`` have slabs."""
    if "slab" not in docs.columns:
        docs = docs.withColumn("slab", F.lit(0).cast("long"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, str], list] = defaultdict(list)
        rows = 0

        def out(slab: int, lang: str, grams: tuple) -> pa.RecordBatch:
            k = len(grams[0])
            return pa.RecordBatch.from_arrays([pa.array(np.full(k, slab, np.int64)), pa.array([lang], pa.string()).take(pa.array(np.zeros(k, np.int32))), pa.array(grams[0]), pa.array(grams[1]), pa.array(grams[2].astype(np.int64))], ["slab", "lang_key", "history", "symbol", "n"])

        for batch in batches:
            by: dict[tuple[int, str], list] = defaultdict(list)
            for text, lang, slab in zip(batch.column("text").to_pylist(), batch.column("lang_key").to_pylist(), batch.column("slab").to_pylist()):
                if text:
                    by[slab, lang].append(text)
            for key, texts in by.items():
                for lo, hi in _chunks(texts):
                    held[key].append(distinct_grams(texts[lo:hi])[:3])
                    rows += len(held[key][-1][0])
            if rows > 1 << 21:
                held = defaultdict(list, {k: [_sum_grams(v)] for k, v in held.items()})
                rows = sum(len(v[0][0]) for v in held.values())
                if rows > 1 << 20:
                    for (slab, lang), v in held.items():
                        yield out(slab, lang, v[0])
                    held, rows = defaultdict(list), 0
        for (slab, lang), v in held.items():
            yield out(slab, lang, _sum_grams(v))

    return docs.select("text", "lang_key", "slab").mapInArrow(count, "slab long, lang_key string, history long, symbol int, n long")


def language_models(grams: DataFrame) -> DataFrame:
    """(lang_key, history, symbol, logp) of every counted 4-gram: interpolated modified Kneser-Ney, a model per language.

    Lower orders count distinct left neighbours. Below order 1 stand a
    language's symbols and one that was never seen, alike.
    """
    tables = [grams.groupBy("lang_key", "history", "symbol").agg(F.sum("n").alias("n"))]
    tables[0] = materialize(tables[0], "kn-order4")
    for order in range(ORDER - 1, 0, -1):
        shorter = F.col("history").bitwiseAND(F.lit((1 << POINT_BITS * (order - 1)) - 1))
        lower = tables[-1].groupBy("lang_key", shorter.alias("history"), "symbol").agg(F.count(F.lit(1)).alias("n"))
        tables.append(materialize(lower, f"kn-order{order}"))

    def of(k: int) -> Column:
        return F.greatest(F.sum((F.col("n") == k).cast("double")), F.lit(1e-9))

    below = None
    for order, table in enumerate(reversed(tables), 1):
        c = table.groupBy("lang_key").agg(*(of(k).alias(f"c{k}") for k in (1, 2, 3, 4)), F.count(F.lit(1)).alias("rows"))
        y = F.col("c1") / (F.col("c1") + 2 * F.col("c2"))
        d = [F.least(F.greatest(k - (k + 1) * y * F.col(f"c{k + 1}") / F.col(f"c{k}"), F.lit(0.05 * k)), F.lit(0.95 * k)).alias(f"d{k}") for k in (1, 2, 3)]
        d = materialize(c.select("lang_key", "rows", *d), "kn-discounts")
        # One row per language; the broadcast is guarded by a count.
        if d.limit(BROADCAST_LANGS + 1).count() <= BROADCAST_LANGS:
            d = F.broadcast(d)
        cut = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        cut = table.join(d, "lang_key").select("lang_key", "history", "symbol", "n", cut.alias("cut"), "rows")
        totals = cut.groupBy("lang_key", "history").agg(F.sum("n").alias("total"), F.sum("cut").alias("left"))
        own = cut.join(totals, ["lang_key", "history"])
        if below is None:
            own = own.withColumn("lower", 1 / (F.col("rows") + 1))
        else:
            shorter = F.col("history").bitwiseAND(F.lit((1 << POINT_BITS * (order - 2)) - 1))
            own = own.withColumn("shorter", shorter).join(below.select("lang_key", F.col("history").alias("shorter"), "symbol", F.col("p").alias("lower")), ["lang_key", "shorter", "symbol"])
        below = own.select("lang_key", "history", "symbol", ((F.col("n") - F.col("cut") + F.col("left") * F.col("lower")) / F.col("total")).alias("p"))
    return below.select("lang_key", "history", "symbol", F.log("p").cast("float").alias("logp"))


_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def base_counts(column: pa.Array) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    raw, offsets = text_bytes(column)
    n_texts = len(column)
    zeros = np.zeros(n_texts, np.int64)
    if not len(raw):
        return {k: zeros for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
    starts, ends = split_words(raw, offsets)
    at = np.searchsorted(starts, offsets)

    def per_text(mask: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(mask)])[offsets])

    spaces = (raw == 32) | ((raw >= 9) & (raw <= 13))
    line = np.zeros(256, bool)
    line[10] = True
    ls, le = split_words(raw, offsets, line)
    keep = np.searchsorted(starts, le) > np.searchsorted(starts, ls)  # lines with a word
    ls, le = ls[keep], le[keep]
    owner = np.searchsorted(offsets, ls, side="right") - 1
    lines = hash_spans(raw, ls, le)
    by = np.lexsort((lines, owner))
    same = (lines[by][1:] == lines[by][:-1]) & (owner[by][1:] == owner[by][:-1])
    dup_lines = np.bincount(owner[by][1:][same], minlength=n_texts)
    words = hash_spans(raw, starts, ends)
    grams = gram_hashes(words, 3)
    repeated = zeros.copy()
    for t in np.flatnonzero(np.diff(at) > 3):
        g = grams[at[t] : at[t + 1] - 2]
        s = np.sort(g)
        twice = s[1:][s[1:] == s[:-1]]
        if len(twice):
            hit = np.isin(g, twice)
            marked = np.zeros(len(g) + 2, bool)
            for k in range(3):
                marked[k : k + len(g)] |= hit
            repeated[t] = marked.sum()
    return {"n_words": np.diff(at), "word_chars": per_text(~spaces & ((raw & 0xC0) != 0x80)), "n_symbols": per_text(_SYMBOL[raw]), "n_dup_lines": dup_lines, "n_repeat_words": repeated}


_SCORED = "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, log_perplexity double"


def _look_up(answer: tuple[np.ndarray, np.ndarray, np.ndarray], history: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """The answer's log probability of each distinct gram; each has one."""
    k = len(answer[0])
    every = np.concatenate([answer[0], history]), np.concatenate([answer[1], symbol])
    by, first = _runs(*every)  # stable: an answer stands before its question
    asked = np.flatnonzero(by >= k)
    if first[asked].any():
        raise ValueError("a gram that was not counted")
    out = np.empty(len(history))
    out[by[asked] - k] = answer[2][by[asked - 1]]
    return out


def gram_keys(lang_key: str, history: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each n-gram of a language."""
    seed = np.frombuffer(hashlib.sha256(lang_key.encode()).digest()[:8], np.uint64)
    with np.errstate(over="ignore"):
        return mix(mix(history.astype(np.uint64) + seed) + symbol.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def store(models: DataFrame) -> DataFrame:
    """(slice long, keys binary, logp binary): the models as sorted hash arrays, each slice a range of the hash."""
    slices = max(1, models.count() // SLICE_GRAMS)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang = batch.column("lang_key").dictionary_encode()
            code, keys = lang.indices.to_numpy(), np.zeros(batch.num_rows, np.uint64)
            history, symbol = batch.column("history").to_numpy(), batch.column("symbol").to_numpy()
            for k, name in enumerate(lang.dictionary.to_pylist()):
                own = code == k
                keys[own] = gram_keys(name, history[own], symbol[own])
            yield pa.RecordBatch.from_arrays([pa.array((keys >> np.uint64(32)).astype(np.int64) * slices >> 32), pa.array(keys.view(np.int64)), batch.column("logp")], ["slice", "key", "logp"])

    def pack(rows: pa.Table) -> pa.Table:
        keys, logp = rows.column("key").to_numpy().view(np.uint64), rows.column("logp").to_numpy()
        by = np.argsort(keys)
        return pa.table([rows.column("slice").slice(0, 1), pa.array([keys[by].tobytes()], pa.binary()), pa.array([logp[by].astype(np.float32).tobytes()], pa.binary())], ["slice", "keys", "logp"])

    rows = models.select("lang_key", "history", "symbol", "logp").mapInArrow(hashed, "slice long, key long, logp float")
    return materialize(rows.groupBy("slice").applyInArrow(pack, "slice long, keys binary, logp binary"), "kn-arrays")


_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _mean_logp(texts: list[str], of_grams) -> np.ndarray:
    """Mean negative log probability a code point of texts that aren't empty."""
    out = np.zeros(len(texts))
    for lo, hi in _chunks(texts):
        history, symbol, _, inverse, bounds = distinct_grams(texts[lo:hi])
        out[lo:hi] = -np.add.reduceat(of_grams(history, symbol)[inverse], bounds[:-1]) / np.diff(bounds)
    return out


def _scored(doc_id: pa.Array, lang: pa.Array, text: pa.Array, mean: np.ndarray, size: np.ndarray) -> list[pa.Array]:
    parts = [base_counts(text.slice(lo, 500)) for lo in range(0, len(text), 500)]
    counts = [np.concatenate([p[k] for p in parts]).astype(np.int64) if parts else np.zeros(0, np.int64) for k in _COUNTS]
    return [doc_id.cast(pa.int64()), lang, *[pa.array(c) for c in counts], pa.array(mean, mask=size == 0)]


def score_here(docs: DataFrame, arrays: DataFrame) -> DataFrame:
    """Base counts and mean negative log probability per code point (null for no text), by the broadcast arrays."""
    slices = sorted((r["slice"], bytes(r["keys"]), bytes(r["logp"])) for r in arrays.collect())  # MODEL_GRAMS n-grams at most
    shared = docs.sparkSession.sparkContext.broadcast((b"".join(k for _, k, _ in slices), b"".join(p for _, _, p in slices)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, logp = np.frombuffer(shared.value[0], np.uint64), np.frombuffer(shared.value[1], np.float32).astype(np.float64)

        def look_up(lang: str, history: np.ndarray, symbol: np.ndarray) -> np.ndarray:
            wanted = gram_keys(lang, history, symbol)
            at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            if (keys[at] != wanted).any():
                raise ValueError("an n-gram that was not counted")
            return logp[at]

        for whole in batches:
            for lo in range(0, whole.num_rows, 2000):
                batch = whole.slice(lo, 2000)
                texts, langs = batch.column("text").to_pylist(), np.array(batch.column("lang_key").to_pylist(), object)
                size = np.array([len(t) if t else 0 for t in texts], np.int64)
                mean = np.zeros(len(texts))
                for lang in sorted(set(langs)):
                    own = np.flatnonzero((langs == lang) & (size > 0))
                    mean[own] = _mean_logp([texts[k] for k in own], partial(look_up, lang))
                yield pa.RecordBatch.from_arrays(_scored(batch.column("doc_id"), batch.column("lang"), batch.column("text"), mean, size), ["doc_id", "lang", *_COUNTS, "log_perplexity"])

    return docs.mapInArrow(run, _SCORED)


def score_slabs(docs: DataFrame, models: DataFrame) -> DataFrame:
    """What ``score_here`` gives, for a model that is too large to be broadcast: slabs of documents ask for their n-grams by a join."""
    docs = with_slabs(docs)

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        texts, langs = docs.column("text").to_pylist(), np.array(docs.column("lang_key").to_pylist(), object)
        mean, size = np.zeros(len(texts)), np.array([len(t) if t else 0 for t in texts], np.int64)
        of = np.array(answers.column("lang_key").to_pylist(), object)
        columns = [answers.column(c).to_numpy() for c in ("history", "symbol", "logp")]
        for lang in sorted(set(langs)):
            own = np.flatnonzero((langs == lang) & (size > 0))
            mean[own] = _mean_logp([texts[k] for k in own], partial(_look_up, tuple(c[of == lang] for c in columns)))
        plain = [docs.column(c).combine_chunks() for c in ("doc_id", "lang", "text")]
        return pa.table(_scored(*plain, mean, size), ["doc_id", "lang", *_COUNTS, "log_perplexity"])

    answers = count_grams(docs).select("slab", "lang_key", "history", "symbol").distinct().join(models, ["lang_key", "history", "symbol"])
    return docs.groupBy("slab").cogroup(answers.groupBy("slab")).applyInArrow(run, _SCORED)


def bands(scored: DataFrame, spread: float) -> DataFrame:
    """(band_lang, lower, upper): ``spread`` interquartile ranges beyond each language's quartiles of log perplexity.

    Quartiles are exact on values in steps of 1 / STEPS: counts of the steps add up alike in any order.
    """
    steps = scored.where("log_perplexity is not null").groupBy("lang", F.round(F.col("log_perplexity") * STEPS).cast("long").alias("step")).agg(F.count(F.lit(1)).alias("n"))
    up_to = Window.partitionBy("lang").orderBy("step")
    ranked = steps.select("lang", "step", F.sum("n").over(up_to).alias("below"), F.sum("n").over(Window.partitionBy("lang")).alias("all"))
    q = [F.min(F.when(4 * F.col("below") >= k * F.col("all"), F.col("step"))) / STEPS for k in (1, 3)]
    found = ranked.groupBy("lang").agg(q[0].alias("q1"), q[1].alias("q3"))
    reach = F.greatest(F.col("q3") - F.col("q1"), F.lit(0.01)) * spread
    return found.select(F.col("lang").alias("band_lang"), (F.col("q1") - reach).alias("lower"), (F.col("q3") + reach).alias("upper"))


def quality_rules(docs: DataFrame, min_words: int = 50, max_repeat_percent: int = 50, spread: float = 4.0) -> DataFrame:
    """One row per document: base counts, base_failed, log_perplexity, its language's band and kept.

    base_failed: fewer than ``min_words`` words, or more than
    ``max_repeat_percent`` % of the words in repeated 3-word windows. A document
    is kept if it passes and its log perplexity lies within ``spread``
    interquartile ranges of its language's quartiles, which are taken over all
    documents that pass the base rules. A null language is a language of its
    own; null and empty texts have no words and fail. An empty table gives no
    rows.
    """
    docs = with_keys(docs)
    models = materialize(language_models(count_grams(docs)), "kn-models")
    if models.limit(MODEL_GRAMS + 1).count() <= MODEL_GRAMS:
        scored = score_here(docs, store(models))
    else:
        scored = score_slabs(docs, models)
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    scored = materialize(scored, "kn-scored").withColumn("base_failed", failed)
    limits = bands(scored.where(~F.col("base_failed")), spread)
    within = F.col("log_perplexity").between(F.col("lower"), F.col("upper"))
    return scored.join(bounded(limits), scored["lang"].eqNullSafe(limits["band_lang"]), "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & F.coalesce(within, F.lit(False))).alias("kept"), "lang", "log_perplexity", "lower", "upper"
    )
