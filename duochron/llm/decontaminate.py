"""Benchmark decontamination by winnowing, with DataFrame functions only.

Of each window of ``W`` successive K-gram hashes the least is kept; K + W - 1
words make one item window, so any shared span that long shares a kept hash.
Test fingerprints are joined with the training documents'; documents with a
common fingerprint are then extended: all their windows are compared with the
items' windows. No Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import ascii_lower, materialize

# Fixed value: what makes up a word, after lower-casing A-Z.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
K, W = 5, 6
SPAN = K + W - 1
#: A side of at most so many rows of a few longs is broadcast; a larger one is shuffled.
BROADCAST_ROWS = 500_000


def words(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def _shifted(a: str, by: int, join) -> Column:
    """``join`` of each element of array column ``a`` and the one ``by`` places on; the last ``by`` are of no use."""
    return F.zip_with(a, F.slice(a, by + 1, F.greatest(F.size(a) - by, F.lit(0))), join)


def _pair(x: Column, y: Column) -> Column:
    return F.xxhash64(x, y)


def _hash(word: Column) -> Column:
    return F.xxhash64(word)


def _tagged(length: int):
    return lambda gram: F.xxhash64(gram, F.lit(length))


def _window(length: int):
    return lambda gram, at: F.struct(F.lit(length).alias("len"), at.alias("at"), gram.alias("gram"))


def _grams(df: DataFrame, hashes: str, width: int, out: str) -> DataFrame:
    """Add ``out``: the hash of ``width`` words from each word on. Doubling: two halves that may overlap."""
    df = df.withColumn(out, F.col(hashes))
    have = 1
    while have < width:
        by = min(have, width - have)
        df = df.withColumn(out, _shifted(out, by, _pair))
        have += by
    return df.withColumn(out, F.slice(out, 1, F.greatest(F.size(hashes) - width + 1, F.lit(0))))


def _winnow(df: DataFrame, hashes: str, out: str) -> DataFrame:
    """Add ``out``: the least of every W successive K-gram hashes, each once."""
    df = _grams(df, hashes, K, out)
    have = 1
    while have < W:
        by = min(have, W - have)
        df = df.withColumn(out, _shifted(out, by, lambda x, y: F.least(x, y)))
        have += by
    return df.withColumn(out, F.array_distinct(F.slice(out, 1, F.greatest(F.size(hashes) - SPAN + 1, F.lit(0)))))


def _hashed(df: DataFrame, text: str) -> DataFrame:
    """Add ``h``, the hash of every word."""
    return df.withColumn("h", words(F.col(text))).withColumn("h", F.transform("h", _hash))


def _windows(df: DataFrame, lengths: list[int]) -> DataFrame:
    """Add ``windows``: (len, at, gram) of every window of SPAN words and of each shorter length."""
    parts = []
    for n in [SPAN, *lengths]:
        df = _grams(df, "h", n, f"w{n}")
        parts.append(F.transform(f"w{n}", _window(n)))
    return df.withColumn("windows", F.concat(*parts)).drop(*(f"w{n}" for n in [SPAN, *lengths]))


def _fingerprints(df: DataFrame, lengths: list[int]) -> DataFrame:
    """Add ``prints``: winnowed hashes, and the grams of shorter lengths tagged with their length."""
    df = _winnow(df, "h", "prints")
    for n in lengths:
        df = _grams(df, "h", n, "short").withColumn("prints", F.concat("prints", F.array_distinct(F.transform("short", _tagged(n))))).drop("short")
    return df


def _bounded(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _keys(docs: DataFrame) -> dict[str, Column]:
    """A key of (doc_id, text) without nulls."""
    id_ = F.col("doc_id")
    if not isinstance(docs.schema["doc_id"].dataType, IntegralType):
        id_ = F.when(id_.isNotNull(), F.xxhash64(id_))
    return {"k1": F.coalesce(id_.cast("long"), F.lit(-(1 << 63))), "k2": F.xxhash64("text")}


def _matches(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, k1, k2, n_words, one row per document; k1, k2, n_hit, n_items, items_sha256 of each contaminated text)."""
    items = _hashed(benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text"), "text").drop("text")
    items = materialize(items.where(F.size("h") > 0), "bench-items")
    short = sorted(r[0] for r in items.where(F.size("h") < SPAN).select(F.size("h")).distinct().collect())  # nine values at most
    own = F.when(F.size("h") < SPAN, F.size("h")).otherwise(SPAN)
    item_windows = _windows(items.withColumn("own", own), short).select("item", "own", F.explode("windows").alias("w")).where(F.col("w.len") == F.col("own"))
    item_windows = materialize(item_windows.select("item", F.col("w.len").alias("len"), F.col("w.gram").alias("gram")).distinct(), "bench-windows")
    grams = _bounded(materialize(item_windows.select("len", "gram").distinct(), "bench-grams"))
    prints = _winnow(items, "h", "prints").select(F.explode("prints").alias("print"))
    prints = prints.union(item_windows.where(F.col("len") < SPAN).select(F.xxhash64("gram", "len")))
    prints = _bounded(materialize(prints.distinct().withColumn("known", F.lit(True)), "bench-prints"))

    keyed = docs.select("doc_id", "text", *(c.alias(n) for n, c in _keys(docs).items()))
    # One row per document (print null) and one per fingerprint that some item has.
    seen = _fingerprints(_hashed(keyed, "text").drop("text"), short).select("doc_id", "k1", "k2", F.size("h").cast("long").alias("n_words"), F.explode(F.concat("prints", F.array(F.lit(None).cast("long")))).alias("print"))
    seen = seen.join(prints, "print", "left").where(F.col("print").isNull() | F.col("known"))
    seen = materialize(seen.select("doc_id", "k1", "k2", "n_words", F.col("print").isNotNull().alias("candidate")), "bench-seen")
    candidates = _bounded(materialize(seen.where("candidate").select("k1", "k2").distinct(), "bench-candidates"))

    extended = _windows(_hashed(keyed.join(candidates, ["k1", "k2"]).drop("doc_id").dropDuplicates(["k1", "k2"]), "text").drop("text"), short)
    hits = extended.select("k1", "k2", F.explode("windows").alias("w")).select("k1", "k2", "w.*").join(grams, ["len", "gram"])
    hits = materialize(hits, "bench-hits")
    by_place = Window.partitionBy("k1", "k2").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("at") + F.col("len")
    covered = hits.withColumn("before", F.coalesce(F.max(end).over(by_place), F.lit(0))).groupBy("k1", "k2").agg(F.sum(F.greatest(end - F.greatest("at", "before"), F.lit(0))).cast("long").alias("n_hit"))
    found = hits.select("k1", "k2", "len", "gram").distinct().join(_bounded(item_windows), ["len", "gram"]).groupBy("k1", "k2").agg(F.sort_array(F.collect_set("item")).alias("items"))
    found = found.select("k1", "k2", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"))
    return seen.where(~F.col("candidate")), covered.join(found, ["k1", "k2"])


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A window is SPAN successive words of an item; an item with fewer, but some,
    is one window. A document word in any occurrence of a window is hit. Null
    texts have no words; null item_ids count as one item named ''. Repeated rows
    give repeated rows; an empty table gives none, and an empty benchmark hits
    nothing.
    """
    seen, per_text = _matches(docs, benchmark)
    return (
        seen.join(per_text, ["k1", "k2"], "left").select(
            "doc_id",
            "n_words",
            F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
            F.coalesce("n_items", F.lit(0)).alias("n_items"),
            F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
            (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
        )
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a hit, all columns and repeated rows as they are."""
    dirty = materialize(_matches(docs, benchmark)[1].select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2")), "bench-dirty")
    keyed = docs.withColumns({f"__{n}": c for n, c in _keys(docs).items()})
    return keyed.join(_bounded(dirty), ["__k1", "__k2"], "left_anti").drop("__k1", "__k2")
