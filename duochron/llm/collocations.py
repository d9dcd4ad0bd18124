"""Phrases that hold together: counts of all short word sequences, and the weakest cut of each.

1. Words are counted by language. Those met ``least`` times get ids; a phrase
   can't be more frequent than its words, so pieces break at all others.
2. Every place in a piece gives one fixed-width key: the ids of the next five
   words, zeros behind the piece's end. A task sorts its keys by radix, counts
   runs of equal ones, and cuts them at range borders.
3. A range sorts what it got in the same way. Keys that begin with a phrase
   lie side by side, so run lengths over the first 1 to 5 ids count all phrases;
   only a range's first and last phrases are added up over ranges.
4. Candidates are cut in two in each way and joined with the counts of both parts.
"""

from __future__ import annotations

import bisect
import json
import math
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, join_small, materialize, utf8_size
from .suffixes import _pack, _unpack

LEAST = 100
LONGEST = 5
TOP = 2000
#: A dictionary of more words isn't sent to the tasks; words are then joined with it.
DICTIONARY_WORDS = 1_000_000
#: Bytes of text that a task tokenizes at a time, places it sorts at a time, and distinct words it counts at a time.
TEXT_BYTES = 2 << 20
SORT_KEYS = 1_000_000
COUNTED_WORDS = 200_000
#: Bytes of text behind one share of the words.
WORD_BYTES = 16 << 20
#: Bytes of text behind one range of keys, and sampled keys for each range's border.
RANGE_BYTES = 8 << 20
SAMPLES_PER_RANGE = 50

#: What ends a piece. Spaces and tabs part words.
ENDS = ".,;:!?\n\x0b\x0c\r"
_BREAK = b"."
_TABLE = bytes(_BREAK[0] if chr(c) in ENDS else c + 32 if 65 <= c <= 90 else c for c in range(256))


def tokens(text: bytes) -> list[bytes]:
    """Words of UTF-8 text with A-Z in lower case; a dot stands where a piece ends."""
    return text.translate(_TABLE).replace(_BREAK, b" . ").split()


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    """(lang, texts joined by dots), TEXT_BYTES at a time or one long text."""
    for batch in batches:
        held: dict[str, list[bytes]] = {}
        sizes: Counter = Counter()
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            text = text.as_py()
            held.setdefault(lang, []).append(text)
            sizes[lang] += len(text) + 1
            if sizes[lang] >= TEXT_BYTES:
                yield lang, _BREAK.join(held.pop(lang))
                del sizes[lang]
        for lang, texts in held.items():
            yield lang, _BREAK.join(texts)


def word_counts(texts: DataFrame, parts: int, least: int) -> DataFrame:
    """(lang, word, f) of texts (lang, text as binary): words met ``least`` times, and rows with a null word that add up to all words of a language.

    A task's counts travel as one packed row for each of ``parts`` shares of the words.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}

        def rows() -> pa.RecordBatch:
            shares: dict[int, tuple[list, list, list]] = {}
            for lang, own in counts.items():
                own.pop(_BREAK, None)
                for word, n in own.items():
                    share = shares.setdefault(zlib.crc32(word) % parts, ([], [], []))
                    share[0].append(word)
                    share[1].append(n)
                for share in shares.values():
                    share[2].append((lang, len(share[0])))
            counts.clear()
            payloads = [_pack(json.dumps(langs).encode(), b" ".join(words), np.array(n, "<i8")) for words, n, langs in shares.values()]
            return pa.RecordBatch.from_arrays([pa.array(list(shares), pa.int32()), pa.array(payloads, pa.binary())], ["part", "payload"])

        for lang, text in _chunks(batches):
            counts.setdefault(lang, Counter()).update(tokens(text))
            if sum(map(len, counts.values())) > COUNTED_WORDS:
                yield rows()
        yield rows()

    def add(rows: pa.Table) -> pa.Table:
        totals: dict[str, Counter] = {}
        for x in rows.column("payload"):
            langs, words, n = _unpack(x.as_py())
            words, n, lo = words.split(b" "), np.frombuffer(n, "<i8").tolist(), 0
            for lang, hi in json.loads(langs):
                own = totals.setdefault(lang, Counter())
                for word, f in zip(words[lo:hi], n[lo:hi]):
                    own[word] += f
                lo = hi
        found = [(lang, w, f) for lang, own in totals.items() for w, f in own.items() if f >= least]
        found += [(lang, None, own.total()) for lang, own in totals.items()]
        return pa.table({"lang": pa.array([x[0] for x in found], pa.string()), "word": pa.array([x[1] for x in found], pa.binary()), "f": pa.array([x[2] for x in found], pa.int64())})

    found = texts.mapInArrow(count, "part int, payload binary").groupBy("part").applyInArrow(add, "lang string, word binary, f long")
    return found.withColumn("word", F.col("word").cast("string"))


def _numbered(words: DataFrame) -> DataFrame:
    """(lang, word, id): ids from 1 without gaps, and no task sees all words: places in partitions, then what the partitions before hold."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        at, part = 0, TaskContext.get().partitionId()
        for batch in batches:
            places = pa.array(np.arange(at, at + batch.num_rows), pa.int64())
            at += batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * batch.num_rows, pa.int32()), places], ["lang", "word", "part", "place"])

    placed = materialize(words.select("lang", "word").mapInArrow(place, "lang string, word string, part int, place long"), "collocation-places")
    held = placed.groupBy(F.col("part").alias("of")).agg(F.count(F.lit(1)).alias("held"))
    before = held.select("of", (F.sum("held").over(Window.orderBy("of")) - F.col("held")).alias("before"))  # one row a partition
    return placed.join(F.broadcast(before), F.col("part") == F.col("of")).select("lang", "word", (F.col("before") + F.col("place") + 1).alias("id"))


def radix_order(keys: np.ndarray) -> np.ndarray:
    """The order of the columns of ``keys`` (ids by place), least digit first, 16 bits at a time."""
    order = np.arange(keys.shape[1])
    for ids in keys[::-1]:
        for shift in range(0, ids.itemsize * 8, 16):
            digit = (ids >> ids.dtype.type(shift)).astype(np.uint16) if ids.itemsize > 2 else ids
            if shift and not digit.any():
                break
            order = order[np.argsort(digit[order], kind="stable")]
    return order


def run_lengths(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct columns in order, and how often each is met (or the sum of its counts)."""
    order = radix_order(keys)
    keys = keys[:, order]
    first = np.flatnonzero(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(axis=0)])) if keys.shape[1] else np.zeros(0, np.int64)
    if not len(first):
        return keys, np.zeros(0, np.int64)
    return keys[:, first], np.diff(np.append(first, len(order))) if counts is None else np.add.reduceat(counts[order], first)


def window_ids(ids: np.ndarray) -> np.ndarray:
    """(LONGEST, places): the ids from each place that has one, zeros from the first break on."""
    wide = np.concatenate([ids, np.zeros(LONGEST, ids.dtype)])
    out = [wide[: len(ids)]]
    for k in range(1, LONGEST):
        out.append(np.where(out[-1] > 0, wide[k : k + len(ids)], 0).astype(ids.dtype))
    return np.stack(out)[:, ids > 0]


class Encoder:
    """A worker's dictionary by language, from the (langs, words, ids) sent to it."""

    made: dict[str, dict] = {}

    @classmethod
    def of(cls, name: str, packed: bytes) -> dict[str, dict[bytes, int]]:
        if name not in cls.made:
            cls.made.clear()
            table = pa.ipc.open_stream(packed).read_all()
            found: dict[str, dict[bytes, int]] = {}
            for lang, word, number in zip(*(c.to_pylist() for c in table.columns)):
                found.setdefault(lang, {})[word.encode()] = number
            cls.made[name] = found
        return cls.made[name]


def _id_type(largest: int) -> np.dtype:
    return np.dtype("<u2") if largest < 1 << 16 else np.dtype("<u4") if largest < 1 << 32 else np.dtype("<u8")


def encoded(texts: DataFrame, dictionary: DataFrame, words: int, kind: np.dtype) -> DataFrame:
    """(ids binary): ids of whole texts with zeros at breaks. The dictionary goes to the tasks if it has few words, else words are joined with it."""
    if words <= DICTIONARY_WORDS:
        sink = pa.BufferOutputStream()
        rows = dictionary.toArrow()
        with pa.ipc.new_stream(sink, rows.schema) as out:
            out.write_table(rows)
        packed, name = texts.sparkSession.sparkContext.broadcast(sink.getvalue().to_pybytes()), uuid.uuid4().hex

        def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = Encoder.of(name, packed.value)
            for lang, text in _chunks(batches):
                found = tokens(text)
                ids = np.fromiter(map(own.get(lang, {}).get, found, repeat(0)), kind, len(found))
                yield pa.RecordBatch.from_arrays([pa.array([ids.tobytes()], pa.binary())], ["ids"])

        return texts.mapInArrow(encode, "ids binary")
    marked = F.regexp_replace(ascii_lower(F.col("text").cast("string")), "[.,;:!?\\n-\\r]", " . ")
    rows = texts.select("lang", F.monotonically_increasing_id().alias("row"), marked.alias("text"))
    rows = rows.select("lang", "row", F.posexplode(F.split("text", "[ \\t]+")).alias("at", "word")).where("word <> ''")
    found = join_small(rows, dictionary, "lang", "word", how="left").groupBy("row").agg(F.sort_array(F.collect_list(F.struct("at", F.coalesce("id", F.lit(0)).alias("id")))).getField("id").alias("ids"))

    def to_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([np.array(x.as_py(), kind).tobytes() for x in batch.column(0)], pa.binary())], ["ids"])

    return found.select("ids").mapInArrow(to_bytes, "ids binary")


def _sample(ids: DataFrame, kind: np.dtype, share: float) -> DataFrame:
    """(key): a random share of all keys."""

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column(0):
                keys = window_ids(np.frombuffer(x.as_py(), kind))
                taken = np.random.default_rng(keys.shape[1]).random(keys.shape[1]) < share
                yield pa.RecordBatch.from_arrays([pa.array(keys[:, taken].T.astype(np.int64).tolist(), pa.list_(pa.int64()))], ["key"])

    return ids.mapInArrow(take, "key array<long>")


def _find(keys: np.ndarray, border: tuple) -> int:
    return bisect.bisect_left(range(keys.shape[1]), border, key=lambda k: tuple(keys[:, k].tolist()))


def phrase_counts(ids: DataFrame, kind: np.dtype, borders: list[tuple], least: int) -> DataFrame:
    """(size, key, f) of every phrase of 1 to LONGEST words met ``least`` times; the key is its ids, 8 bytes each, high byte first."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def rows() -> pa.RecordBatch:
            keys, counts = run_lengths(np.concatenate(held, axis=1))
            cuts = [0, *(_find(keys, b) for b in borders), keys.shape[1]]
            full = [k for k in range(len(cuts) - 1) if cuts[k] < cuts[k + 1]]
            return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([_pack(np.ascontiguousarray(keys[:, cuts[k] : cuts[k + 1]]), counts[cuts[k] : cuts[k + 1]].astype("<i4")) for k in full], pa.binary())], ["part", "payload"])

        for batch in batches:
            for x in batch.column(0):
                found = np.frombuffer(x.as_py(), kind)
                for lo in range(0, len(found), SORT_KEYS):
                    # The next places are looked at, but belong to the next part.
                    own = window_ids(found[lo : lo + SORT_KEYS + LONGEST - 1])
                    more = int((found[lo + SORT_KEYS : lo + SORT_KEYS + LONGEST - 1] > 0).sum())
                    own = own[:, : own.shape[1] - more]
                    held.append(own)
                    n += own.shape[1]
                    if n >= SORT_KEYS:
                        yield rows()
                        held, n = [], 0
        if n:
            yield rows()

    def count(rows: pa.Table) -> pa.Table:
        got = [_unpack(x.as_py()) for x in rows.column("payload")]
        keys = np.concatenate([np.frombuffer(x[0], kind).reshape(LONGEST, -1) for x in got], axis=1)
        keys, counts = run_lengths(keys, np.concatenate([np.frombuffer(x[1], "<i4") for x in got]).astype(np.int64))
        sizes, names, totals = [], [], []
        for size in range(1, LONGEST + 1):
            has = keys[size - 1] > 0
            own, f = keys[:size, has], counts[has]
            if not len(f):
                break
            first = np.flatnonzero(np.concatenate([[True], (own[:, 1:] != own[:, :-1]).any(axis=0)]))
            f = np.add.reduceat(f, first)
            kept = f >= least
            kept[[0, -1]] = True  # these may go on in other ranges
            key = own[:, first[kept]].T.astype(">u8").tobytes()
            n = int(kept.sum())
            sizes += [size] * n
            names += [key[8 * size * k : 8 * size * (k + 1)] for k in range(n)]
            totals.append(f[kept])
        return pa.table({"size": pa.array(sizes, pa.int32()), "key": pa.array(names, pa.binary()), "f": pa.array(np.concatenate(totals), pa.int64())})

    parts = ids.mapInArrow(send, "part int, payload binary").groupBy("part").applyInArrow(count, "size int, key binary, f long")
    return parts.groupBy("size", "key").agg(F.sum("f").alias("f")).where(F.col("f") >= least)


def _cut_scores(counts: DataFrame, totals: DataFrame) -> DataFrame:
    """(size, key, a, lang, k, l, r, n, score) of each candidate at its weakest cut."""
    whole = counts.where("size > 1").select("size", "key", F.col("f").alias("a"), F.substring("key", 1, 8).alias("word"))
    whole = join_small(whole, totals, "word")
    cuts = whole.select("*", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.withColumns({"left": F.expr("substring(key, 1, 8 * k)"), "right": F.expr("substring(key, 8 * k + 1)")})
    cuts = join_small(cuts, counts.select(F.col("key").alias("left"), F.col("f").alias("l")), "left")
    cuts = join_small(cuts, counts.select(F.col("key").alias("right"), F.col("f").alias("r")), "right")
    exact = F.expr("(cast(1000 * cast(a as decimal(19, 0)) as decimal(19, 0)) * cast(n as decimal(19, 0))) div (cast(l as decimal(19, 0)) * cast(r as decimal(19, 0)))")
    cuts = cuts.withColumn("cut", F.struct(exact.alias("score"), "k", "l", "r"))
    return cuts.groupBy("size", "key", "a", "lang", "n").agg(F.min("cut").alias("cut")).select("size", "key", "a", "lang", "n", "cut.*")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases by the score of their weakest cut.

    A phrase has 2 to 5 words in one piece and is met ``least`` times. With n
    words in the language, a the phrase's count, l and r those of its parts at a
    cut, the score is floor(1000 * a * n / (l * r)), the lowest over its cuts
    (then the shortest first part). A phrase inside a longer one that is met as
    often is left out. Ties go to larger a, then to the phrase's bytes. A null
    text is empty, a null lang ``und``; repeated rows count again; an empty
    table gives no rows; other columns don't matter.
    """
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    bytes_ = docs.agg(F.sum(utf8_size(F.col("text")))).first()[0] or 0
    words = materialize(word_counts(texts, max(1, math.ceil(bytes_ / WORD_BYTES)), least), "collocation-words")
    totals = words.where("word IS NULL").groupBy("lang").agg(F.sum("f").alias("n"))
    dictionary = materialize(_numbered(words.where("word IS NOT NULL")), "collocation-dictionary")
    size, largest = dictionary.agg(F.count(F.lit(1)), F.max("id")).first()
    kind = _id_type(largest or 0)
    ranges = max(1, math.ceil(bytes_ / RANGE_BYTES))
    ids = encoded(texts, dictionary, size, kind)
    if size > DICTIONARY_WORDS:
        ids = materialize(ids, "collocation-ids")
    counts = materialize(phrase_counts(ids, kind, _borders(texts, dictionary, size, kind, ranges), least), "collocation-counts")
    of_word = dictionary.select(F.unhex(F.lpad(F.hex("id"), 16, "0")).alias("word"), "lang").join(F.broadcast(totals), "lang")  # totals: one row a language
    scored = materialize(_cut_scores(counts, of_word), "collocation-scores")
    # What a longer candidate with the same count holds goes; one word more is enough, as counts in between are equal.
    longer = scored.where("size > 2").select(F.explode(F.array(F.expr("substring(key, 1, 8 * (size - 1))"), F.expr("substring(key, 9)"))).alias("inner"), F.col("a").alias("as_often"))
    kept = scored.join(longer, (F.col("key") == F.col("inner")) & (F.col("a") == F.col("as_often")), "left_anti")
    place = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    kept = kept.withColumn("place", F.rank().over(place)).where(F.col("place") <= top)
    spelled = kept.select("key", F.posexplode(F.expr("transform(sequence(0, size - 1), x -> substring(key, 8 * x + 1, 8))")).alias("at", "word"))
    names = dictionary.select(F.unhex(F.lpad(F.hex("id"), 16, "0")).alias("word"), F.col("word").alias("spelling"))
    spelled = join_small(spelled, names, "word").groupBy("key").agg(F.array_join(F.sort_array(F.collect_list(F.struct("at", "spelling"))).getField("spelling"), " ").alias("phrase"))
    final = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.join(spelled, "key").withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))


def _borders(texts: DataFrame, dictionary: DataFrame, size: int, kind: np.dtype, ranges: int) -> list[tuple]:
    """Keys that cut the order into ranges, from a sample of the texts: some SAMPLES_PER_RANGE a range in all."""
    if ranges == 1:
        return []
    wanted = SAMPLES_PER_RANGE * ranges
    fraction = min(1.0, 4 * wanted / max(texts.count(), 1))
    some = texts.sample(fraction, seed=1)
    # A word takes six bytes or so; every key is as likely, whatever its language and the length of its text.
    share = min(1.0, wanted * 6 / (fraction * ranges * RANGE_BYTES))
    keys = sorted(tuple(r[0]) for r in _sample(encoded(some, dictionary, size, kind), kind, share).collect())  # SAMPLES_PER_RANGE a range
    return sorted({keys[k * len(keys) // ranges] for k in range(1, ranges)}) if keys else []
