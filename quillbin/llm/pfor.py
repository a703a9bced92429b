"""Token-ID output in patched frame-of-reference blocks.

A document table goes out in ascending doc_id order as segments. A segment has a table of its documents and blocks of `BLOCK` ids; a block is coded as
its minimum, the differences' low bits packed at a width that a percentile of the differences needs, and an exception list with the positions and high
bits of the larger ones. An index holds where each block starts, so a range of ids can be read alone. Many segments lie in one Parquet file, uncompressed,
beside columns with their sizes and first and last doc_ids: its footer is the index of segments, and totals are read without a segment's bytes. Spark's
file writer puts them on any Hadoop file system (its commit protocol keeps exactly one attempt of each task).
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillbin.llm._common import LOWER, binary_list, chunks, lean, scratch, table

BLOCK = 1024
PERCENTILE = 0.95
#: A segment is closed once it holds so many ids (a longer document makes a longer segment).
SEGMENT_IDS = 1 << 19
#: Bytes of segments that the writer and the readers of a file hold at once.
ROW_GROUP = 8 << 20
HEAD = struct.Struct("<8sIIQQIIB")
MAGIC = b"QBPFOR01"
END_ID = 2
#: What each of a cache's two generations holds; longer words are encoded each time.
CACHED_WORDS, CACHED_PIECES, CACHED_BYTES = 150_000, 20_000, 64


def _default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


# ---------------------------------------------------------------- encoding


class Remembered(dict):
    """What `work` gives for a key, in two generations: a full one becomes the older one, and what is asked for again comes back from there."""

    def __init__(self, work: Callable, most: int):
        super().__init__()
        self.work, self.most, self.older = work, most, {}

    def __missing__(self, key):
        got = self.older.get(key)
        if got is None:
            got = self.work(key)
        if len(key) <= CACHED_BYTES:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[key] = got
        return got


class Encoder:
    """ids of texts as little-endian unsigned 32-bit bytes, equal to the library's, with a cache of words.

    For a tokenizer that lower-cases, drops white space and splits words by a pattern, no id depends on another word: texts are cut at ASCII
    white space, words of ASCII and Latin-1 letters are split by the tokenizer's own pattern and go to its model directly, and all other
    words, or those with a special token's opening, to the whole tokenizer. Any other tokenizer encodes whole texts. Bytes that are not valid UTF-8
    are replacement characters."""

    SIMPLE = regex.compile(r"[!-~À-ÖØ-öø-ÿ]+")
    #: The pattern leaves a run of these behind letters as one piece (an apostrophe may begin another one).
    TAIL = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"

    def __init__(self, source: str):
        import json

        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_str(source)
        spec = json.loads(source)
        norm, pre = spec["normalizer"] or {}, spec["pre_tokenizer"] or {}
        kinds = [x["type"] for x in norm.get("normalizers", [])], [x["type"] for x in pre.get("pretokenizers", [])]
        self.by_word = kinds == (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]) and pre["pretokenizers"][0]["behavior"] == "Removed" and not pre["pretokenizers"][1]["add_prefix_space"] and all("<|" in x["content"] for x in spec["added_tokens"])
        if self.by_word:
            splits = pre["pretokenizers"][0]["pattern"]["Regex"]
            self.pattern = regex.compile(splits)
            self.tails = splits.endswith(r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
            kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
            self.bytes_map = {b: chr(b) for b in kept} | {b: chr(256 + n) for n, b in enumerate(b for b in range(256) if b not in set(kept))}
        self.words, self.pieces = Remembered(self._word, CACHED_WORDS), Remembered(self._piece, CACHED_PIECES)

    def _piece(self, piece: str) -> bytes:
        own = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.bytes_map)
        return np.array([t.id for t in self.tok.model.tokenize(own)], "<u4").tobytes()

    def _word(self, word: bytes) -> bytes:
        if self.tails:
            core = word.rstrip(self.TAIL)
            text = core.decode("utf-8", "replace")
            if text.isalpha() and (core.isascii() or self.SIMPLE.fullmatch(text)):
                if len(core) < len(word):
                    return self.words[text.lower().encode()] + self.pieces[word[len(core) :].decode()]
                return self._piece(text.lower())
        text = word.decode("utf-8", "replace")
        if self.SIMPLE.fullmatch(text) and "<|" not in text:
            return b"".join(map(self.pieces.__getitem__, self.pattern.findall(text.lower())))
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __call__(self, text: bytes) -> bytes:
        if not self.by_word:
            return np.array(self.tok.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids, "<u4").tobytes()
        # lower-casing first is the same but beside special tokens, and marks that join a letter of one case only (U+0300 to U+037F)
        if b"<|" not in text and b"\xcc" not in text and b"\xcd" not in text:
            text = text.translate(LOWER)
        return b"".join(map(self.words.__getitem__, text.split()))


_ENCODERS: dict[int, Encoder] = {}


def encoder(source: str) -> Encoder:
    key = zlib.crc32(source.encode())
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(source)
    return _ENCODERS[key]


# ---------------------------------------------------------------- blocks


def _bits_needed(x: np.ndarray) -> np.ndarray:
    return np.ceil(np.log2(x.astype(np.float64) + 1)).astype(np.uint8)


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """(blocks, BLOCK) of uint32 below 2^width as (blocks, bytes)."""
    wide = values.astype(">u4" if width > 16 else ">u2")
    bits = np.unpackbits(wide.view(np.uint8).reshape(*values.shape, -1), axis=2)[:, :, -width:]
    return np.packbits(bits.reshape(len(values), -1), axis=1)


def _unpack(data: np.ndarray, width: int, size: int) -> np.ndarray:
    """Inverse of _pack: (blocks, bytes) as (blocks, size) of uint32."""
    full = 32 if width > 16 else 16
    bits = np.zeros((len(data), size, full), np.uint8)
    bits[:, :, full - width :] = np.unpackbits(data, axis=1)[:, : size * width].reshape(len(data), size, width)
    return np.packbits(bits.reshape(len(data), -1), axis=1).view(">u4" if full == 32 else ">u2").astype(np.uint32)


def write_segment(doc_ids: list[int | None], counts: list[int], ids: np.ndarray, partition: int = 0, before: int = 0, block: int = BLOCK, percentile: float = PERCENTILE) -> bytes:
    """One segment's bytes. ids: uint32, all documents' ids in order; before: ids of the earlier segments of the same partition."""
    n_blocks = -(-len(ids) // block)
    padded = np.zeros(n_blocks * block, np.uint32)
    padded[: len(ids)] = ids
    if len(ids) % block:
        padded[len(ids) :] = ids[(n_blocks - 1) * block :].min()
    padded = padded.reshape(n_blocks, block)
    mins = padded.min(1) if n_blocks else np.zeros(0, np.uint32)
    delta = padded - mins[:, None]
    widths = np.zeros(n_blocks, np.uint8)
    if n_blocks:
        rank = min(block - 1, int(np.ceil(percentile * block)))
        widths = _bits_needed(np.partition(delta, rank, axis=1)[:, rank])
    starts = np.concatenate([[0], np.cumsum((widths.astype(np.int64) * block + 7) // 8)]).astype("<u4")
    packed = np.zeros(int(starts[-1]), np.uint8)
    high = np.zeros_like(delta)
    for w in np.unique(widths).tolist():
        which = np.flatnonzero(widths == w)
        for at in range(0, len(which), 128):
            some = which[at : at + 128]
            high[some] = delta[some] >> np.uint32(w) if w < 32 else 0
            if w:
                rows = _pack(delta[some] & np.uint32((1 << w) - 1), w)
                packed[starts[some].astype(np.int64)[:, None] + np.arange(rows.shape[1])] = rows
    which, pos = np.nonzero(high)
    patch = high[which, pos]
    exc_bytes = 4 if len(patch) and patch.max() > 0xFFFF else 2
    exc_starts = np.searchsorted(which, np.arange(n_blocks + 1)).astype("<u4")
    head = HEAD.pack(MAGIC, partition, len(doc_ids), before, len(ids), n_blocks, block, exc_bytes)
    parts = [
        np.array([d or 0 for d in doc_ids], "<i8"), np.array([d is None for d in doc_ids], np.uint8), np.array(counts, "<u4"),
        mins.astype("<u4"), widths, starts, exc_starts, packed, pos.astype("<u2"), patch.astype("<u4" if exc_bytes == 4 else "<u2"),
    ]
    return b"".join([head, *(x.tobytes() for x in parts)])


class Segment:
    """Reads a segment: documents' ids and counts, and any range of ids by way of the block index."""

    def __init__(self, data: bytes):
        magic, self.partition, n_docs, self.before, self.n, self.n_blocks, self.block, exc = HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a segment of packed ids")
        at = HEAD.size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        raw, null = take("<i8", n_docs), take("u1", n_docs)
        self.doc_ids = [None if z else int(d) for d, z in zip(raw, null, strict=True)]
        self.counts = take("<u4", n_docs)
        self.mins, self.widths = take("<u4", self.n_blocks), take("u1", self.n_blocks)
        self.starts, self.exc_starts = take("<u4", self.n_blocks + 1), take("<u4", self.n_blocks + 1)
        self.packed = take("u1", int(self.starts[-1]))
        self.pos = take("<u2", int(self.exc_starts[-1]))
        self.high = take("<u4" if exc == 4 else "<u2", int(self.exc_starts[-1]))

    def blocks(self, first: int, last: int) -> np.ndarray:
        """ids of blocks first..last-1."""
        out = np.zeros((last - first, self.block), np.uint32)
        widths = self.widths[first:last]
        for w in np.unique(widths[widths > 0]).tolist():
            which = np.flatnonzero(widths == w)
            for at in range(0, len(which), 128):
                some = which[at : at + 128]
                data = self.packed[self.starts[some + first].astype(np.int64)[:, None] + np.arange((w * self.block + 7) // 8)]
                out[some] = _unpack(data, w, self.block)
        e, f = self.exc_starts[first], self.exc_starts[last]
        rows = np.repeat(np.arange(last - first), np.diff(self.exc_starts[first : last + 1].astype(np.int64)))
        out[rows, self.pos[e:f]] |= self.high[e:f].astype(np.uint32) << widths[rows].astype(np.uint32)
        return (out + self.mins[first:last, None]).reshape(-1)

    def ids(self, start: int = 0, n: int | None = None) -> np.ndarray:
        n = self.n - start if n is None else n
        if n <= 0:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, -(-(start + n) // self.block)
        return self.blocks(first, last)[start - first * self.block :][:n]


# ---------------------------------------------------------------- Spark


SEGMENT_ROW = "partition int, before long, n_ids long, n_docs long, first_id long, last_id long, data binary"


def write_token_files(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID) -> None:
    """Encodes every text (null: empty), appends end_id, and writes segments below `path` in ascending doc_id order.

    Rows without id come first; equal ids are ordered by a hash of the text, and repeated rows are all written. One shuffle, of the texts, by ranges."""
    spark = docs.sparkSession
    with open(tokenizer or _default_tokenizer(), encoding="utf-8") as f:
        source = spark.sparkContext.broadcast(f.read())
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, partition, before = encoder(source.value), TaskContext.get().partitionId(), 0
        doc_ids: list = []
        counts: list[int] = []
        held: list[bytes] = []
        size = 0

        def close() -> pa.RecordBatch:
            nonlocal before, size
            data = write_segment(doc_ids, counts, np.frombuffer(b"".join(held), "<u4"), partition, before)
            ends = pa.array([doc_ids[0]], pa.int64()), pa.array([doc_ids[-1]], pa.int64())
            row = [pa.array([partition], pa.int32()), pa.array([before]), pa.array([size]), pa.array([len(doc_ids)]), *ends, pa.array([data], pa.binary())]
            before += size
            size = 0
            for x in (doc_ids, counts, held):
                x.clear()
            return pa.RecordBatch.from_arrays(row, ["partition", "before", "n_ids", "n_docs", "first_id", "last_id", "data"])

        lean()
        for batch in batches:
            for part in chunks(batch, "text"):
                for doc_id, text in zip(part.column("doc_id").to_pylist(), binary_list(part.column("text")), strict=True):
                    ids = encode(text) + end
                    doc_ids.append(doc_id)
                    counts.append(len(ids) // 4)
                    held.append(ids)
                    size += len(ids) // 4
                    if size >= SEGMENT_IDS:
                        yield close()
        if doc_ids:
            yield close()

    slim = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64("text").alias("text_hash"))
    ordered = slim.repartitionByRange("doc_id", "text_hash").sortWithinPartitions("doc_id", "text_hash").drop("text_hash")
    files = ordered.mapInArrow(run, SEGMENT_ROW).write.mode("overwrite").option("compression", "none")
    files.option("parquet.block.size", ROW_GROUP).option("parquet.enable.dictionary", "false").parquet(path)


def read_token_files(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 for each document of the files; with_ids adds the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("data"):
                seg = Segment(data.as_py())
                ids = seg.ids()
                ends = np.cumsum(seg.counts.astype(np.int64))
                cols = [
                    pa.array([seg.partition] * len(ends), pa.int32()), pa.array(seg.doc_ids, pa.int64()), pa.array(ends - seg.counts + seg.before), pa.array(seg.counts.astype(np.int64)),
                    pa.array([zlib.crc32(ids[e - n : e].astype("<u4").tobytes()) for e, n in zip(ends, seg.counts.astype(np.int64), strict=True)], pa.int64()),
                ]
                names = ["partition", "doc_id", "at", "n_tokens", "ids_crc32"]
                if with_ids:
                    cols.append(pa.array([ids[e - n : e].astype(np.int64) for e, n in zip(ends, seg.counts.astype(np.int64), strict=True)], pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    files = spark.read.schema(SEGMENT_ROW).parquet(path)
    sizes = sorted((r.partition, r.n) for r in files.groupBy("partition").agg(F.sum("n_ids").alias("n")).collect())  # a row for each task that wrote
    base, rows = 0, []
    for partition, n in sizes:
        rows.append((partition, base))
        base += n
    bases = spark.createDataFrame(rows, "partition int, base long")
    read = files.select("data").mapInArrow(run, "partition int, doc_id long, at long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)
    out = read.join(F.broadcast(bases), "partition")  # a row for each task that wrote
    return out.select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def token_output(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID, path: str | None = None) -> DataFrame:
    """Writes docs' token files (below `path`, by default a new folder of the shared scratch space) and returns what read_token_files finds there.

    Empty tables give no file and no row. Columns other than doc_id and text are ignored."""
    path = path or f"{scratch(docs.sparkSession)}/tokens"
    write_token_files(docs, path, tokenizer, end_id)
    return read_token_files(docs.sparkSession, path)


def op6_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output(table(spark, sf_dir, "documents"))


QUERIES = {"op6_token_output": op6_token_output}
ORACLE: dict[str, str] = {}
