"""Token ids in length-delimited binary records, with an offset index.

A record is

    u32 length | u32 masked crc32 of those 4 bytes | payload | u32 masked crc32 of payload | newline

little-endian; the payload is i64 doc_id (a null doc_id is the least i64), then
the token ids as u16 or, for a larger vocabulary, u32. Spark's text sink writes
the files (each row a record, its line separator the closing newline), so they
are committed atomically on any file system that Spark writes to.
"""

from __future__ import annotations

import json
import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded, lean, shared_path, utf8_size
from .shingles import hash_spans

#: UTF-8 bytes of text whose ids go to one file; a reader holds one file in memory.
FILE_TEXT_BYTES = 16 << 20
NULL_ID = -(1 << 63)
#: Pieces whose ids a worker remembers before it starts afresh, and characters that it encodes at a time (or one longer text).
CACHE_PIECES = 600_000
ENCODE_CHARS = 3 << 19
#: Other texts are encoded whole: an apostrophe may begin a contraction, and Unicode tables of two libraries may differ elsewhere.
PLAIN = regex.compile(r"[\t\n\r\x20-\x26\x28-\x7e\xa1-ɏ]*")


def mask(crc: int) -> int:
    """A checksum of data that holds checksums is weak; the stored one is rotated and shifted."""
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = struct.pack("<I", len(payload))
    return head + struct.pack("<I", mask(zlib.crc32(head))) + payload + struct.pack("<I", mask(zlib.crc32(payload)))


def frames(data: bytes | memoryview) -> Iterator[tuple[int, int, bytes | memoryview]]:
    """(offset, length, payload) of each record; raises ValueError where a checksum or the framing is wrong."""
    at = 0
    while at < len(data):
        if at + 8 > len(data):
            raise ValueError(f"record cut off at {at}")
        n, check = struct.unpack_from("<II", data, at)
        if check != mask(zlib.crc32(data[at : at + 4])) or at + 13 + n > len(data):
            raise ValueError(f"wrong length at {at}")
        payload = data[at + 8 : at + 8 + n]
        if struct.unpack_from("<I", data, at + 8 + n)[0] != mask(zlib.crc32(payload)) or data[at + 12 + n] != 10:
            raise ValueError(f"wrong payload at {at}")
        yield at, n + 13, payload
        at += n + 13


def _piece_classes() -> np.ndarray:
    """Class of each code point below U+0250: 0 not handled here, 1 letter, 2 number, 3 other, 4 space, 5 other white space."""
    out = np.zeros(0x250, np.int8)
    for c in range(0x250):
        if PLAIN.fullmatch(chr(c)):
            out[c] = 1 if regex.match(r"\p{L}", chr(c)) else 2 if regex.match(r"\p{N}", chr(c)) else 5 if c in (9, 10, 13) else 4 if c == 32 else 3
    return out


_CLASS = _piece_classes()


def split_pieces(points: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """First code point of every piece of plain texts: the byte-level pre-tokenizer's rule, for whole batches.

    A run of letters, numbers or marks takes the one space before it; the last
    white space before a run stands alone unless it is that space.
    """
    kinds = _CLASS[points]
    space = kinds >= 4
    first = np.zeros(len(points), bool)
    first[bounds[:-1][bounds[:-1] < len(points)]] = True
    before = np.concatenate([[0], kinds[:-1]])
    before[first] = 0
    run = (before != kinds) & ~space
    start = space & (before < 4)
    start |= run & (before != 4)
    start[np.flatnonzero(run & (before >= 4)) - 1] = True
    return np.flatnonzero(start)


def splits_like_bytes(tokenizer_file: str) -> bool:
    """Whether ``split_pieces`` is this tokenizer's own rule: plain byte-level pieces, no normaliser."""
    with open(tokenizer_file, encoding="utf-8") as f:
        described = json.load(f)
    rule = described.get("pre_tokenizer") or {}
    return described.get("normalizer") is None and rule.get("type") == "ByteLevel" and not rule.get("add_prefix_space", True) and rule.get("use_regex", True)


class PieceEncoder:
    """Encodes texts with a byte-level tokenizer; a piece of plain text that was met before is not encoded again.

    Pieces are told apart by a 64-bit hash. A tokenizer with other rules for pieces encodes whole texts.
    """

    def __init__(self, tokenizer_file: str, end_id: int):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else "<u4")
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.end = np.array([end_id], self.dtype)
        self.by_pieces = splits_like_bytes(tokenizer_file)
        newline = self._ids(["\n"])[0]
        self.newline = int(newline[0]) if len(newline) == 1 else None
        self._forget()

    def _forget(self) -> None:
        self.hashes, self.starts, self.sizes, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, self.dtype)

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.dtype) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, hashes: np.ndarray, pieces: list[str]) -> None:
        """Encode pieces and remember their ids; many at a time, with newlines between, which are pieces of their own."""
        marks = [not p.isspace() for p in pieces] if self.newline is not None else [False] * len(pieces)
        found: list[np.ndarray | None] = [None] * len(pieces)
        words = [k for k, ok in enumerate(marks) if ok]
        groups = [words[k : k + 100] for k in range(0, len(words), 100)]
        for group, ids in zip(groups, self._ids(["\n".join(pieces[k] for k in g) for g in groups])):
            for k, own in zip(group, np.split(ids, np.flatnonzero(ids == self.newline))):
                found[k] = own if k == group[0] else own[1:]
        rest = [k for k, ok in enumerate(marks) if not ok]
        for k, own in zip(rest, self._ids([pieces[k] for k in rest])):
            found[k] = own
        sizes = np.array([len(x) for x in found], np.int64)
        starts = len(self.ids) + np.concatenate([[0], np.cumsum(sizes)[:-1]])
        self.ids = np.concatenate([self.ids, *found])
        at = np.searchsorted(self.hashes, hashes)  # the new hashes are sorted
        self.hashes, self.starts, self.sizes = (np.insert(old, at, new) for old, new in ((self.hashes, hashes), (self.starts, starts), (self.sizes, sizes)))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text, then the end id, as bytes; null is empty."""
        texts = [t or "" for t in texts]
        plain = [self.by_pieces and PLAIN.fullmatch(t) is not None and not any(s in t for s in self.specials) for t in texts]
        own = [t for t, ok in zip(texts, plain) if ok]
        fast = iter(self._encode_plain(own))
        slow = iter(self._ids([t for t, ok in zip(texts, plain) if not ok]))
        return [np.concatenate([next(fast if ok else slow), self.end]).tobytes() for ok in plain]

    def _encode_plain(self, texts: list[str]) -> list[np.ndarray]:
        joined = "".join(texts)
        if not joined:
            return [np.zeros(0, self.dtype)] * len(texts)
        bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        starts = split_pieces(points, bounds)
        ends = np.append(starts[1:], len(points))
        distinct, where, inverse = np.unique(hash_spans(points, starts, ends), return_index=True, return_inverse=True)
        if len(self.hashes) > CACHE_PIECES:
            self._forget()
        at = np.minimum(np.searchsorted(self.hashes, distinct), max(len(self.hashes) - 1, 0))
        new = self.hashes[at] != distinct if len(self.hashes) else np.ones(len(distinct), bool)
        if new.any():
            self._learn(distinct[new], [joined[starts[k] : ends[k]] for k in where[new]])
            at = np.searchsorted(self.hashes, distinct)
        at = at[inverse]
        sizes = self.sizes[at]
        done = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.ids[np.repeat(self.starts[at] - done[:-1], sizes) + np.arange(done[-1])]
        cuts = done[np.searchsorted(starts, bounds)]
        return [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:])]


def parts_by_size(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts have at most so many bytes, or one row."""
    sizes = np.array(pa.compute.fill_null(pa.compute.binary_length(batch.column("text")), 0), np.int64)
    ends, lo = np.cumsum(sizes), 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, side="right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


_ENCODERS: dict[tuple, PieceEncoder] = {}


def encoder(tokenizer_file: str, end_id: int) -> PieceEncoder:
    """The worker's own encoder: its tokenizer and what it remembers last over tasks."""
    if (tokenizer_file, end_id) not in _ENCODERS:
        _ENCODERS[tokenizer_file, end_id] = PieceEncoder(tokenizer_file, end_id)
    return _ENCODERS[tokenizer_file, end_id]


def write_records(docs: DataFrame, path: str, tokenizer_file: str, end_id: int, file_text_bytes: int = FILE_TEXT_BYTES, order: list[Column] | None = None) -> None:
    """Encode every whole text and write its record under ``path``, ordered over files in the order of their numbers.

    Without ``order`` doc_ids ascend, null ones first; rows of one doc_id are
    ordered by a hash of their text. A null or empty text gives a record with
    the end id alone. An empty table gives no records.
    """
    size = docs.agg(F.sum(utf8_size(F.col("text")))).first()[0] or 0
    files = max(1, math.ceil(size / file_text_bytes))
    doc_id = F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID))
    order = order or [doc_id, F.xxhash64("text")]
    names = [f"order{k}" for k in range(len(order))]
    ordered = docs.select(doc_id.alias("doc_id"), "text", *(c.alias(n) for c, n in zip(order, names))).repartitionByRange(files, *names).sortWithinPartitions(*names).select("doc_id", "text")

    @lean
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer_file, end_id)
        for batch in batches:
            for part in parts_by_size(batch, ENCODE_CHARS):
                ids = own.encode(part.column("text").to_pylist())
                rows = [frame(struct.pack("<q", d) + b) for d, b in zip(part.column("doc_id").to_pylist(), ids)]
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], ["record"])

    ordered.mapInArrow(encode, "record binary").select(F.col("record").cast("string").alias("value")).write.text(path, compression="none", lineSep="\n")


_INDEX = "file string, record long, offset long, length long, doc_id long, n_tokens long, ids_crc32 long, ids_before long"


def read_index(spark: SparkSession, path: str, id_bytes: int = 2) -> DataFrame:
    """The offset index, read from the files themselves with every checksum verified.

    (file, record: its number in the file, offset, length, doc_id, n_tokens, ids_crc32 of the ids as u32, ids_before: ids of the file's records before).
    """

    @lean
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, data in zip(batch.column("path").to_pylist(), batch.column("content")):
                rows, before = [], 0
                for k, (offset, length, payload) in enumerate(frames(memoryview(data.as_buffer()))):
                    ids = np.frombuffer(payload, f"<u{id_bytes}", offset=8).astype("<u4")
                    doc = struct.unpack_from("<q", payload)[0]
                    rows.append((file, k, offset, length, None if doc == NULL_ID else doc, len(ids), zlib.crc32(ids.tobytes()), before))
                    before += len(ids)
                columns = list(zip(*rows)) or [()] * 8
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if i == 0 else pa.int64()) for i, c in enumerate(columns)], ["file", "record", "offset", "length", "doc_id", "n_tokens", "ids_crc32", "ids_before"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).where(F.col("length") > 0)
    return files.select("path", "content").mapInArrow(parse, _INDEX)


def read_at(spark: SparkSession, wanted: DataFrame, path: str, id_bytes: int = 2) -> DataFrame:
    """Shuffled reads: the (doc_id, ids) of the index rows in ``wanted``, each file opened once."""
    places = wanted.groupBy("file").agg(F.sort_array(F.collect_list("offset")).alias("offsets"))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select(F.col("path").alias("file"), "content")

    @lean
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, offsets in zip(batch.column("content"), batch.column("offsets").to_pylist()):
                raw = data.as_buffer().to_pybytes()
                docs, ids = [], []
                for at in offsets:
                    payload = next(frames(raw[at : at + 13 + struct.unpack_from("<I", raw, at)[0]]))[2]
                    doc = struct.unpack_from("<q", payload)[0]
                    docs.append(None if doc == NULL_ID else doc)
                    ids.append(np.frombuffer(payload, f"<u{id_bytes}", offset=8).astype(np.int32).tolist())
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return files.join(places, "file").select("content", "offsets").mapInArrow(read, "doc_id long, ids array<int>")


def stored_order(docs: DataFrame) -> list[Column] | None:
    """The columns that put rows read from Parquet files into the order in which they were written; None for other rows."""
    # A join has the metadata of any side, so only a plain scan counts.
    plan = docs._jdf.queryExecution().analyzed()
    if plan.getClass().getSimpleName() != "LogicalRelation" or plan.relation().getClass().getSimpleName() != "HadoopFsRelation" or plan.relation().fileFormat().toString() != "Parquet":
        return None
    return [F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("long"), F.col("_metadata.row_index")]


#: Files whose totals are summed in one task; so many blocks again meet in one.
FILE_BLOCK = 1000


def file_starts(index: DataFrame) -> DataFrame:
    """(file, file_start): the ids of all files before, in the order of the numbers in their names."""
    files = index.groupBy("file").agg(F.sum("n_tokens").alias("tokens"))
    files = files.withColumn("number", F.regexp_extract("file", r"part-(\d+)[^/]*$", 1).cast("long"))
    files = files.withColumn("block", F.floor(F.col("number") / FILE_BLOCK))
    blocks = files.groupBy("block").agg(F.sum("tokens").alias("held"))
    blocks = blocks.select(F.col("block").alias("of"), (F.sum("held").over(Window.orderBy("block")) - F.col("held")).alias("base"))
    own = F.sum("tokens").over(Window.partitionBy("block").orderBy("number")) - F.col("tokens")
    return files.withColumn("own", own).join(blocks, F.col("block") == F.col("of")).select("file", (F.col("base") + F.col("own")).alias("file_start"))


def encode_to_records(docs: DataFrame, tokenizer_file: str, end_id: int = 2, path: str | None = None, file_text_bytes: int = FILE_TEXT_BYTES, order: list[Column] | None = None) -> DataFrame:
    """Write records and their index (``path``/records, ``path``/index), and return the index with each document's global ``start``.

    ``start`` counts the ids of all documents before it in file order, which is
    ``order`` or else ascending doc_id.
    """
    spark = docs.sparkSession
    path = path or shared_path(spark, "records")
    write_records(docs, f"{path}/records", tokenizer_file, end_id, file_text_bytes, order)
    id_bytes = encoder(tokenizer_file, end_id).dtype.itemsize
    read_index(spark, f"{path}/records", id_bytes).write.parquet(f"{path}/index")
    index = spark.read.schema(_INDEX).parquet(f"{path}/index")
    starts = bounded(file_starts(index))
    return index.join(starts, "file").select("doc_id", (F.col("file_start") + F.col("ids_before")).alias("start"), "n_tokens", "ids_crc32", "file", "offset", "length")
