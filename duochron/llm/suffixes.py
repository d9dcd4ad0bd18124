"""Exact substring dedup by a distributed sort of suffixes that knows common prefixes.

A window is a string of ``least`` bytes. Two windows are equal only if the
position of the least hash in their first part (the window's key) is at the
same place in both and the bytes from there on agree. So only one suffix is
sorted for each key, with the bytes before it carried along, and it stands for
all windows of that key:

1. Whole texts are packed into blocks. Fingerprints of keys are exchanged as
   sorted hash arrays; keys whose fingerprint is met once can't repeat.
2. Each block sorts the suffixes at its other keys and collapses equal ones.
   This run is front-coded (bytes in common with the suffix before, then the
   rest) and cut into ranges.
3. Each range combines its runs with a loser tree. A suffix's bytes in common
   with the last winner are known, so those are never compared again.
4. Suffixes side by side with enough bytes in common, and their bytes before
   the key, say which windows repeat. Blocks get these bits back.

Nothing is decided by a hash: a fingerprint only rules out what can't repeat.
A key met very often (a passage of a large part of all documents) has its
windows sorted one by one, so that its contexts spread over ranges.
"""

from __future__ import annotations

import bisect
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import materialize, utf8_size

LEAST = 200
#: Bytes of text in a block; a longer document is a block of its own.
BLOCK_BYTES = 4 << 20
#: Bytes of text behind one range of suffixes, and behind one share of the fingerprints.
RANGE_BYTES = 32 << 20
PRINT_BYTES = 64 << 20
#: Occurrences from which a key's windows are sorted one by one.
HOT_KEY = 50_000
#: Positions whose keys are looked for at a time.
CHUNK = 1 << 17
#: Sampled keys for each range, and bytes of a block that its samples come from.
SAMPLES_PER_RANGE = 20
SAMPLE_BYTES = 1 << 16

_NOTE = "block long, kind int, part int, payload binary"
_RUN = "part int, block long, payload binary"


class Cut:
    """Lengths that follow from the window's: of a key's fingerprint, of the hashed gram, and how far a key may lie in."""

    def __init__(self, least: int):
        if least < 24:
            raise ValueError("windows need 24 bytes at least")
        self.least = least
        self.print = max(16, least * 3 // 10)
        self.reach = least - self.print


def _pack(*arrays: np.ndarray | bytes) -> bytes:
    parts = [a if isinstance(a, bytes) else a.tobytes() for a in arrays]
    head = np.array([len(p) for p in parts], "<i8").tobytes()
    return bytes([len(parts)]) + zstandard.ZstdCompressor(level=3).compress(head + b"".join(parts))


def _unpack(data: bytes) -> list[bytes]:
    n, body = data[0], zstandard.ZstdDecompressor().decompress(data[1:])
    out, at = [], 8 * n
    for size in np.frombuffer(body, "<i8", n):
        out.append(body[at : at + size])
        at += size
    return out


def _mix(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    x = (x * np.uint64(0x9E3779B97F4A7C15)) ^ (y * np.uint64(0xC2B2AE3D27D4EB4F))
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def window_keys(data: bytes, starts: np.ndarray, cut: Cut) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, first, last): for each stretch of neighbouring windows with the same key, the key's and the windows' positions.

    ``starts`` bounds the documents in ``data``; windows never cross them.
    """
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    pad = data + bytes(16)
    words = np.ndarray((len(pad) - 7,), "<u8", pad, strides=(1,))
    total = len(data) - cut.least + 1
    whole = np.zeros(max(total, 0) + 1, np.int8)  # +1 where a document's windows begin, -1 behind its last one
    has = np.diff(starts) >= cut.least
    np.add.at(whole, starts[:-1][has], 1)
    np.add.at(whole, starts[1:][has] - cut.least + 1, -1)
    whole = np.cumsum(whole, dtype=np.int8)
    begins = np.zeros(len(whole), bool)
    begins[starts[:-1][has]] = True
    for lo in range(0, total, CHUNK):
        n = min(CHUNK, total - lo)  # windows that start here
        m = n + cut.reach
        h = _mix(words[lo : lo + m], words[lo + 8 : lo + 8 + m])
        # The place fills the low bits, so that equal hashes count from the left.
        h = (h & ~np.uint64((1 << 24) - 1)) | np.arange(m, dtype=np.uint64)
        size = 1
        while size * 2 <= cut.reach + 1:
            h = np.minimum(h[:-size], h[size:])
            size *= 2
        rest = cut.reach + 1 - size
        if rest:
            h = np.minimum(h[: len(h) - rest], h[rest:])
        key = (h[:n] & np.uint64((1 << 24) - 1)).astype(np.int64)
        valid = whole[lo : lo + n] > 0
        fresh = np.concatenate([[True], (key[1:] != key[:-1]) | (valid[1:] != valid[:-1])]) | begins[lo : lo + n]
        first = np.flatnonzero(fresh)
        last = np.append(first[1:] - 1, n - 1)
        inside = valid[first]
        first, last = first[inside], last[inside]
        out.append((key[first] + lo, first + lo, last + lo))
    if not out:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*out))


def key_prints(data: bytes, keys: np.ndarray, cut: Cut) -> np.ndarray:
    """64-bit hashes of the ``cut.print`` bytes at each key."""
    pad = data + bytes(16)
    words = np.ndarray((len(pad) - 7,), "<u8", pad, strides=(1,))
    h = np.zeros(len(keys), np.uint64)
    for at in [*range(0, cut.print - 8, 8), cut.print - 8]:
        h = _mix(h, words[keys + at])
    return h


def _blocks(docs: DataFrame) -> DataFrame:
    """(block, ids, starts, data): whole texts as UTF-8, about BLOCK_BYTES to a row, compressed."""
    kind = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("ids", T.ArrayType(kind)), T.StructField("data", T.BinaryType())])
    id_type = to_arrow_type(kind)
    docs = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, ids, texts, held = TaskContext.get().partitionId() << 32, [], [], 0

        def row() -> pa.RecordBatch:
            starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype("<i8")
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([ids], pa.list_(id_type)), pa.array([_pack(starts, b"".join(texts))], pa.binary())], ["block", "ids", "data"])

        for batch in batches:
            for one, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                if ids and held + len(text) > BLOCK_BYTES:
                    yield row()
                    number, ids, texts, held = number + 1, [], [], 0
                ids.append(one)
                texts.append(text)
                held += len(text)
        if ids:
            yield row()

    return docs.mapInArrow(pack, schema)


def _each_block(blocks: DataFrame, notes: DataFrame | None, make, schema) -> DataFrame:
    """``make(block, ids, starts, data, notes)`` yields rows for each block; notes are {(kind, part): payload}. The notes come to the blocks by a shuffle."""
    names = [f.name for f in schema.fields] if isinstance(schema, T.StructType) else [x.split()[0] for x in schema.split(", ")]
    noted = notes is not None
    if noted:
        own = notes.groupBy(F.col("block").alias("of")).agg(F.collect_list(F.struct("kind", "part", "payload")).alias("notes"))
        blocks = blocks.join(own.hint("shuffle_hash"), F.col("block") == F.col("of"), "left").drop("of")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                starts, data = _unpack(batch.column("data")[k].as_py())
                found = {(x["kind"], x["part"]): x["payload"] for x in batch.column("notes")[k].as_py() or ()} if noted else {}
                columns = make(batch.column("block")[k].as_py(), batch.column("ids")[k].as_py(), np.frombuffer(starts, "<i8"), data, found)
                if columns[0]:
                    yield pa.RecordBatch.from_arrays(columns, names)

    return blocks.mapInArrow(run, schema)


def _note_rows(part: list[int], block: list[int], payload: list[bytes]) -> list[pa.Array]:
    return [pa.array(part, pa.int32()), pa.array(block, pa.int64()), pa.array(payload, pa.binary())]


SEEN, RUN, REPEATS = 0, 1, 2


def _seen(blocks: DataFrame, cut: Cut, parts: int) -> DataFrame:
    """Notes SEEN: for the sorted distinct fingerprints of a block, a byte each: 0 met once, 1 met again, 2 met very often."""
    top = np.uint64(max(1, math.ceil((1 << 64) / parts) - 1)) if parts > 1 else None

    def send(block, ids, starts, data, notes):
        prints, counts = np.unique(key_prints(data, window_keys(data, starts, cut)[0], cut), return_counts=True)
        place = (prints // top).astype(np.int64).clip(0, parts - 1) if top is not None else np.zeros(len(prints), np.int64)
        ends = np.searchsorted(place, np.arange(parts + 1))
        full = [k for k in range(parts) if ends[k] < ends[k + 1]]
        return _note_rows(full, [block] * len(full), [_pack(prints[ends[k] : ends[k + 1]], np.minimum(counts[ends[k] : ends[k + 1]], 1 << 30).astype("<i4")) for k in full])

    def count(rows: pa.Table) -> pa.Table:
        got = [_unpack(x.as_py()) for x in rows.column("payload")]
        prints = [np.frombuffer(x[0], np.uint64) for x in got]
        distinct, where = np.unique(np.concatenate(prints), return_inverse=True)
        totals = np.bincount(where, np.concatenate([np.frombuffer(x[1], "<i4") for x in got]))
        said = np.where(totals >= HOT_KEY, 2, np.where(totals > 1, 1, 0)).astype(np.uint8)[where]
        cuts = np.cumsum([len(p) for p in prints])[:-1]
        n = rows.num_rows
        return pa.table({"block": rows.column("block"), "kind": pa.array([SEEN] * n, pa.int32()), "part": rows.column("part"), "payload": pa.array([_pack(x) for x in np.split(said, cuts)], pa.binary())})

    return _each_block(blocks, None, send, _RUN).groupBy("part").applyInArrow(count, _NOTE)


def _splitters(blocks: DataFrame, ranges: int, cut: Cut, n_blocks: int) -> list[bytes]:
    """Strings that cut the order of suffixes into ranges, from a sample of the keys of every block: SAMPLES_PER_RANGE a range in all."""
    each = max(1, math.ceil(SAMPLES_PER_RANGE * ranges / max(n_blocks, 1)))

    def take(block, ids, starts, data, notes):
        rng = np.random.default_rng(block)
        lo = int(rng.integers(0, max(len(data) - SAMPLE_BYTES, 0) + 1))
        some = data[lo : lo + SAMPLE_BYTES]  # keys prefer some strings, so places alone are no sample of them
        keys = window_keys(some, np.array([0, len(some)]), cut)[0]
        return [pa.array([some[k : k + cut.least] for k in rng.choice(keys, each)] if len(keys) else [], pa.binary())]

    if ranges == 1:
        return []
    found = sorted(r[0] for r in _each_block(blocks, None, take, "sample binary").collect())  # SAMPLES_PER_RANGE * ranges short strings
    return sorted({found[k * len(found) // ranges] for k in range(1, ranges)}) if found else []


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Bytes that ``a`` and ``b`` have in common, of which ``known`` aren't compared again."""
    n = min(len(a), len(b))
    if a[known:n] == b[known:n]:
        return n
    step = known
    while a[step : step + 16] == b[step : step + 16]:
        step += 16
    while a[step] == b[step]:
        step += 1
    return step


def front_code(strings: list[bytes]) -> tuple[np.ndarray, bytes]:
    """(bytes in common with the string before, the rest of all strings)."""
    shared = [0] + [common_prefix(a, b) for a, b in zip(strings, strings[1:])]
    return np.array(shared[: len(strings)], "<i4"), b"".join(s[k:] for s, k in zip(strings, shared))


def front_decode(shared: list[int], sizes: list[int], rest: bytes) -> list[bytes]:
    out, at, last = [], 0, b""
    for k, n in zip(shared, sizes):
        end = at + n - k
        last = last[:k] + rest[at:end]
        at = end
        out.append(last)
    return out


def merge_runs(runs: list[list[bytes]], shared: list[list[int]]) -> tuple[list[tuple[int, int]], list[int]]:
    """A loser tree over sorted runs: ((run, place) in order, bytes in common with the one before).

    ``shared`` has each string's bytes in common with the one before it in its
    run. A node keeps the loser and its bytes in common with the winner that
    beat it. Of two strings, the one with more in common with the last winner
    comes first, without a look at either; only equal numbers are compared, and
    only from there on.
    """
    k = 1 << max(0, (len(runs) - 1).bit_length())
    heads: list[bytes | None] = [r[0] if r else None for r in runs] + [None] * (k - len(runs))
    known = [0] * k
    at = [0] * k
    losers = [0] * k

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser) of two runs by their heads; the loser's bytes in common become those with the winner."""
        x, y = heads[a], heads[b]
        if y is None:
            return a, b
        if x is None:
            return b, a
        p, q = known[a], known[b]
        if p != q:
            return (a, b) if p > q else (b, a)
        p = common_prefix(x, y, p)
        if x[p : p + 1] <= y[p : p + 1]:
            known[b] = p
            return a, b
        known[a] = p
        return b, a

    level = list(range(k))
    for size in [k >> s for s in range(1, k.bit_length())]:
        played = [play(level[2 * i], level[2 * i + 1]) for i in range(size)]
        losers[size : 2 * size] = [x[1] for x in played]
        level = [x[0] for x in played]
    winner = level[0]
    order: list[tuple[int, int]] = []
    common: list[int] = []
    while heads[winner] is not None:
        place = at[winner]
        order.append((winner, place))
        common.append(known[winner])
        at[winner] = place = place + 1
        own = runs[winner]
        if place < len(own):
            heads[winner], known[winner] = own[place], shared[winner][place]
        else:
            heads[winner] = None
        node = (winner + k) >> 1
        while node:
            winner, losers[node] = play(winner, losers[node])
            node >>= 1
    return order, common


def _bits(lo: int, hi: int) -> int:
    """Bits ``lo`` to ``hi``."""
    return (1 << (hi + 1)) - (1 << lo) if lo <= hi else 0


def repeats_in_group(found: list[tuple[bytes, bytes, int]], least: int) -> list[int]:
    """Of entries with one fingerprint, as (suffix at the key, bytes before the key backwards, times met): bit d tells whether the window that starts d bytes before the key repeats."""
    n = len(found)
    rights, lefts = [x[0] for x in found], [x[1] for x in found]
    low = [least - len(r) for r in rights]
    out = [_bits(low[k], len(lefts[k])) if found[k][2] > 1 else 0 for k in range(n)]
    if n == 1:
        return out
    by_left = sorted(range(n), key=lefts.__getitem__)
    beside: list[list[int]] = [[] for _ in range(n)]
    after = [common_prefix(rights[k], rights[k + 1]) for k in range(n - 1)]
    before = [0] * n
    for a, b in zip(by_left, by_left[1:]):
        beside[a].append(b)
        beside[b].append(a)
        c = common_prefix(lefts[a], lefts[b])
        before[a], before[b] = max(before[a], c), max(before[b], c)
    open_: dict[int, list[int]] = {}
    for k in range(n):
        if found[k][2] > 1:
            continue
        most = max(after[k - 1] if k else 0, after[k] if k < n - 1 else 0)
        wanted = _bits(max(low[k], least - most), min(len(lefts[k]), before[k]))
        if not wanted:
            continue
        for other in {*beside[k], *([k - 1] if k else ()), *([k + 1] if k < n - 1 else ())}:
            out[k] |= _bits(least - common_prefix(rights[k], rights[other]), common_prefix(lefts[k], lefts[other]))
        rest = wanted & ~out[k]
        while rest:
            d = rest.bit_length() - 1
            open_.setdefault(d, []).append(k)
            rest ^= 1 << d
    for d, own in open_.items():
        counts = Counter((rights[k][: least - d], lefts[k][:d]) for k in range(n) if low[k] <= d <= len(lefts[k]))
        for k in own:
            if counts[rights[k][: least - d], lefts[k][:d]] > 1:
                out[k] |= 1 << d
    return out


def _runs(blocks: DataFrame, seen: DataFrame, splitters: list[bytes], cut: Cut) -> DataFrame:
    """Rows (part, block, payload): front-coded sorted runs by range, and with part -1 the places of a block's entries."""
    least = cut.least

    def send(block, ids, starts, data, notes):
        keys, first, last = window_keys(data, starts, cut)
        prints = key_prints(data, keys, cut)
        distinct, inverse = np.unique(prints, return_inverse=True)
        said = np.concatenate([np.frombuffer(_unpack(notes[x])[0], np.uint8) for x in sorted(notes)]) if notes else np.zeros(0, np.uint8)
        said = said[inverse] if len(distinct) else np.zeros(0, np.uint8)
        entries: dict[tuple[int, bytes, bytes], list[tuple[int, int]]] = {}
        for k in np.flatnonzero(said).tolist():
            key, a, b = int(keys[k]), int(first[k]), int(last[k])
            if said[k] == 1:
                right = data[key : b + least]
                entries.setdefault((bisect.bisect_right(splitters, right[: cut.print]), right, data[a:key][::-1]), []).append((a, b))
            else:
                for p in range(a, b + 1):
                    right = data[p : p + least]
                    entries.setdefault((bisect.bisect_right(splitters, right), right, b""), []).append((p, p))
        if not entries:
            return _note_rows([], [], [])
        order = sorted(entries)
        places = np.array([(k, a, b) for k, e in enumerate(order) for a, b in entries[e]], "<i8")
        parts, payloads = [-1], [_pack(places)]
        lo = 0
        while lo < len(order):
            hi = bisect.bisect_left(order, (order[lo][0] + 1,), lo)
            shared, rest = front_code([e[1] for e in order[lo:hi]])
            more = np.array([min(len(entries[e]), 2) for e in order[lo:hi]], np.uint8)
            sizes = np.array([(len(e[1]), len(e[2])) for e in order[lo:hi]], "<i4")
            parts.append(order[lo][0])
            payloads.append(_pack(shared, sizes, more, rest, b"".join(e[2] for e in order[lo:hi])))
            lo = hi
        return _note_rows(parts, [block] * len(parts), payloads)

    return _each_block(blocks, seen, send, _RUN)


def _combine(runs: DataFrame, cut: Cut) -> DataFrame:
    """Notes REPEATS: bits of all windows of a run's entries in their order."""
    least = cut.least

    def combine(rows: pa.Table) -> pa.Table:
        strings, shared, lefts, more = [], [], [], []
        for x in rows.column("payload"):
            a, sizes, times, rest, before = _unpack(x.as_py())
            common, sizes = np.frombuffer(a, "<i4").tolist(), np.frombuffer(sizes, "<i4").reshape(-1, 2)
            strings.append(front_decode(common, sizes[:, 0].tolist(), rest))
            shared.append(common)
            ends = np.cumsum(sizes[:, 1]).tolist()
            lefts.append([before[i:j] for i, j in zip([0, *ends], ends)])
            more.append(times)
        order, common = merge_runs(strings, shared)
        bits: list[list[int]] = [[0] * len(s) for s in strings]
        lo = 0
        while lo < len(order):
            hi = lo + 1
            while hi < len(order) and common[hi] >= cut.print:
                hi += 1
            if hi - lo > 1 or more[order[lo][0]][order[lo][1]] > 1:
                met: dict[tuple[bytes, bytes], list[tuple[int, int]]] = {}
                for r, p in order[lo:hi]:
                    met.setdefault((strings[r][p], lefts[r][p]), []).append((r, p))
                names = list(met) if len(met) == 1 else sorted(met)
                for name, found in zip(names, repeats_in_group([(a, b, len(met[a, b]) if len(met[a, b]) > 1 else more[met[a, b][0][0]][met[a, b][0][1]]) for a, b in names], least)):
                    for r, p in met[name]:
                        bits[r][p] = found
            lo = hi
        payloads = []
        for r in range(len(strings)):
            text = "".join(format(found >> (least - len(s)), f"0{len(b) + len(s) - least + 1}b") for found, s, b in zip(bits[r], strings[r], lefts[r]))
            payloads.append(_pack(np.packbits(np.frombuffer(text.encode(), np.uint8) == 49), np.array([len(strings[r])], "<i8")))
        return pa.table({"block": rows.column("block"), "kind": pa.array([REPEATS] * rows.num_rows, pa.int32()), "part": rows.column("part"), "payload": pa.array(payloads, pa.binary())})

    return runs.where("part >= 0").groupBy("part").applyInArrow(combine, _NOTE)


def repeated_spans(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, n_bytes, spans, kept): every byte in a string of ``least`` bytes that also starts elsewhere, in any text or the same.

    ``spans`` are the maximal runs of such bytes as (start, end), ``kept`` the
    other bytes (not always whole characters). Texts are UTF-8 and never cut;
    a null or empty text has no bytes. Every row gives one row, also where
    doc_ids are null or repeat: rows of equal text repeat each other. An empty
    table gives an empty one; other columns are left out.
    """
    cut = Cut(least)
    blocks = materialize(_blocks(docs), "suffix-blocks")
    total = docs.agg(F.sum(utf8_size(F.col("text")))).first()[0] or 0
    n_blocks = blocks.count()
    seen = materialize(_seen(blocks, cut, max(1, math.ceil(total / PRINT_BYTES))), "suffix-seen")
    splitters = _splitters(blocks, max(1, math.ceil(total / RANGE_BYTES)), cut, n_blocks)
    runs = materialize(_runs(blocks, seen, splitters, cut), "suffix-runs")
    places = runs.where("part < 0").select("block", F.lit(RUN).alias("kind"), "part", "payload")
    notes = materialize(_combine(runs, cut).unionByName(places), "suffix-repeats")
    kind = docs.schema["doc_id"].dataType
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("n_bytes", T.LongType()), T.StructField("spans", span), T.StructField("kept", T.BinaryType())])
    id_type = to_arrow_type(kind)
    arrow_span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def mark(block, ids, starts, data, notes):
        covered = np.zeros(len(data) + 1, np.int32)
        if notes:
            entry, a, b = np.frombuffer(_unpack(notes.pop((RUN, -1)))[0], "<i8").reshape(-1, 3).T
            windows = b - a + 1
            per = np.zeros(entry.max() + 1, np.int64)
            per[entry] = windows
            found = [_unpack(notes[part]) for part in sorted(notes)]
            ends = np.cumsum([int(np.frombuffer(x[1], "<i8")[0]) for x in found])
            flat = np.concatenate([np.unpackbits(np.frombuffer(x[0], np.uint8), count=int(w.sum())) for x, w in zip(found, np.split(per, ends[:-1]))])
            lead = (np.cumsum(per) - per)[entry]
            step = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
            hit = (np.repeat(a, windows) + step)[flat[np.repeat(lead, windows) + step] > 0]
            covered = np.bincount(hit, minlength=len(covered)) - np.bincount(hit + least, minlength=len(covered))
        inside = np.cumsum(covered)[:-1] > 0
        raw = np.frombuffer(data, np.uint8)
        spans, kept = [], []
        for lo, hi in zip(starts[:-1], starts[1:]):
            own = inside[lo:hi]
            edge = np.flatnonzero(np.diff(np.concatenate([[0], own.view(np.int8), [0]])))
            spans.append([{"start": int(x), "end": int(y)} for x, y in zip(edge[::2], edge[1::2])])
            kept.append(raw[lo:hi][~own].tobytes())
        return [pa.array(ids, id_type), pa.array(np.diff(starts), pa.int64()), pa.array(spans, arrow_span), pa.array(kept, pa.binary())]

    return _each_block(blocks, notes, mark, schema)
