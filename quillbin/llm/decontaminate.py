"""Benchmark decontamination with suffix arrays over the training text.

The corpus is cut into shards of words. Each shard's suffixes are sorted (a suffix array, to the depth of a window; suffixes that begin with a
word that no benchmark item uses can match nothing and are left out), and every benchmark suffix is binary-searched in it. Runs of matching
positions on one diagonal are the longest verbatim matches, with their places on both sides. Shards never leave their task: no shuffle.
The benchmark goes out in blocks of bounded size, and each shard is searched for one block after the other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillbin.llm._common import ALNUM, binary_list, chunks, table

WINDOW = 8
#: Words of benchmark text in a block, and distinct ones (ids take 16 bits): what a worker holds of the benchmark at once.
BLOCK_WORDS, BLOCK_VOCABULARY = 400_000, 65_000


def words_of(text: bytes) -> list[bytes]:
    return text.translate(ALNUM).split()


class Block:
    """Part of the benchmark: its word ids, and its distinct windows with the items that have them."""

    def __init__(self, items: list[tuple[int, int, list[bytes]]], window: int):
        """items: (item_id, the piece's first word in the item, the piece's words)."""
        self.window = window
        self.ids: dict[bytes, int] = {}
        seen: dict[tuple[int, bytes], set[int]] = {}
        self.items = [i for i, _, _ in items]
        self.pieces = [(first, words) for _, first, words in items]
        for at, (_, _, words) in enumerate(items):
            ids = np.array([self.ids.setdefault(w, len(self.ids) + 1) for w in words], np.uint16)
            n = min(window, len(ids))
            for k in range(len(ids) - n + 1):
                seen.setdefault((n, ids[k : k + n].tobytes()), set()).add(at)
        self.n = np.array([n for n, _ in seen], np.int64)
        padded = np.zeros((len(seen), -(-window // 4) * 4), np.uint16)
        for row, (n, raw) in enumerate(seen):
            padded[row, :n] = np.frombuffer(raw, np.uint16)
        self.keys = _keys(padded)
        self.at = np.concatenate([[0], np.cumsum([len(x) for x in seen.values()])]).astype(np.int64)
        self.of = np.array([i for x in seen.values() for i in sorted(x)], np.int64)
        self.shortest = int(self.n.min()) if len(self.n) else window


def _keys(rows: np.ndarray) -> np.ndarray:
    """(n, 4k) word ids as (k, n) integers that sort as the rows do."""
    wide = rows.astype(np.uint64).reshape(len(rows), -1, 4)
    return np.ascontiguousarray((wide << np.array([48, 32, 16, 0], np.uint64)).sum(2, dtype=np.uint64).T)


def _masks(n: np.ndarray, parts: int) -> np.ndarray:
    """For prefixes of n words: what a key keeps of each part."""
    out = np.zeros((parts, len(n)), np.uint64)
    for k in range(parts):
        keep = np.clip(n - 4 * k, 0, 4)
        out[k] = np.where(keep > 0, (np.uint64(0xFFFFFFFFFFFFFFFF) << (np.uint64(16) * (4 - np.maximum(keep, 1)).astype(np.uint64))), np.uint64(0))
    return out


def _bound(array: np.ndarray, keys: np.ndarray, masks: np.ndarray, after: bool) -> np.ndarray:
    """Binary search of every key in the sorted array (parts, n): the first suffix whose masked key is >= it, or > it if after."""
    lo, hi = np.zeros(keys.shape[1], np.int64), np.full(keys.shape[1], array.shape[1], np.int64)
    while (open_ := lo < hi).any():
        mid = (lo + hi) >> 1
        at = np.minimum(mid, array.shape[1] - 1)
        less, same = np.zeros(len(lo), bool), np.ones(len(lo), bool)
        for k in range(len(array)):
            own = array[k][at] & masks[k]
            less |= same & (own < keys[k])
            same &= own == keys[k]
        right = (less | same if after else less) & open_
        lo, hi = np.where(right, mid + 1, lo), np.where(open_ & ~right, mid, hi)
    return lo


def search(block: Block, docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """(window, position) for every occurrence of a window of the block in a shard; positions count the shard's words, documents end to end."""
    none = np.zeros(0, np.int64)
    sizes = np.fromiter(map(len, docs), np.int64, len(docs))
    total, window = int(sizes.sum()), block.window
    if not total or not len(block.n):
        return none, none
    get = block.ids.get
    ids = np.fromiter((get(w, 0) for d in docs for w in d), np.uint16, total)
    ends = np.repeat(np.cumsum(sizes), sizes)
    # suffixes whose first words, as many as the shortest window has, are all the benchmark's
    use = ids > 0
    start = use.copy()
    for k in range(1, block.shortest):
        start[: total - k] &= use[k:]
        start[total - k :] = False
    start &= np.arange(total) + block.shortest <= ends
    places = np.flatnonzero(start)
    if not len(places):
        return none, none
    wide = -(-window // 4) * 4
    spots = places[:, None] + np.arange(wide)
    rows = np.where((spots < ends[places][:, None]) & (np.arange(wide) < window), ids[np.minimum(spots, total - 1)], 0)
    keys = _keys(rows)
    order = np.lexsort(keys[::-1])
    array, places = keys[:, order], places[order]  # the suffix array
    masks = _masks(block.n, len(array))
    lo, hi = _bound(array, block.keys, masks, False), _bound(array, block.keys, masks, True)
    n = hi - lo
    which = np.repeat(np.arange(len(n)), n)
    first = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
    return which, places[first + np.arange(len(which))]


def blocks_of(benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> list[Broadcast]:
    """The benchmark, streamed to the driver and broadcast in blocks. Rows without item_id or without words take no part."""
    out, items, words, vocabulary = [], [], 0, set()
    context = benchmark.sparkSession.sparkContext

    def close() -> None:
        nonlocal items, words, vocabulary
        if items:
            out.append(context.broadcast(Block(items, window)))
        items, words, vocabulary = [], 0, set()

    rows = benchmark.filter("item_id is not null").select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    for item_id, text in rows.toLocalIterator():
        own = words_of((text or "").encode())
        # an item with more distinct words than a block holds is cut into pieces that share window-1 words, and so keeps every window
        step = min(block_words, BLOCK_VOCABULARY)
        for k in range(0, max(1, len(own) - window + 1), step):
            piece = own[k : k + step + window - 1]
            if not piece:
                continue
            if words + len(piece) > block_words or len(vocabulary | set(piece)) >= BLOCK_VOCABULARY:
                close()
            items.append((item_id, k, piece))
            words += len(piece)
            vocabulary.update(piece)
    close()
    return out


def _load(block: Broadcast, alone: bool) -> Block:
    """One block stays in memory from task to task; several are read from the executor's copy in turn, so that one is held at a time."""
    return block.value if alone or block._path is None else block.load_from_path(block._path)


def scan(texts: list[bytes], blocks: list[Broadcast]) -> tuple[np.ndarray, np.ndarray, list[list[int]]]:
    """(words, hit words, ids of items with a window in it) of each text: one shard."""
    docs = [words_of(t) for t in texts]
    sizes = np.fromiter(map(len, docs), np.int64, len(docs))
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    change = np.zeros(total + 1, np.int64)
    found: list[set[int]] = [set() for _ in docs]
    for b in blocks:
        block = _load(b, len(blocks) == 1)
        which, places = search(block, docs)
        np.add.at(change, places, 1)
        np.add.at(change, places + block.n[which], -1)
        doc = np.searchsorted(ends, places, "right")
        for d, w in np.unique(np.stack([doc, which], 1), axis=0).tolist() if len(which) else ():
            found[d].update(block.items[i] for i in block.of[block.at[w] : block.at[w + 1]].tolist())
    hit = np.concatenate([[0], np.cumsum(np.cumsum(change[:-1]) > 0)])
    return sizes, hit[ends] - hit[ends - sizes], [sorted(x, key=str) for x in found]


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The longest verbatim matches: doc_id, item_id, doc_start, item_start, n_words (all in words), one row for each maximal run of at least
    `window` words (or a whole shorter item) and each of its places. Null texts have no words; rows without item_id take no part."""
    blocks = blocks_of(benchmark, window)

    def runs(doc: list[bytes]) -> list[tuple[int, int, int, int]]:
        # (place in the document, place in the item, words) of every window that both have, by item
        shared: dict[int, set[tuple[int, int, int]]] = {}
        for b in blocks:
            block = _load(b, len(blocks) == 1)
            which, places = search(block, [doc])
            for w, p in zip(which.tolist(), places.tolist(), strict=True):
                n = int(block.n[w])
                for i in block.of[block.at[w] : block.at[w + 1]].tolist():
                    first, words = block.pieces[i]
                    own = doc[p : p + n]
                    shared.setdefault(block.items[i], set()).update((p, first + k, n) for k in range(len(words) - n + 1) if words[k : k + n] == own)
        out = []
        for item, spots in shared.items():
            for p, k, n in spots:
                if (p - 1, k - 1, n) not in spots:
                    m = 1
                    while (p + m, k + m, n) in spots:
                        m += 1
                    out.append((item, p, k, m + n - 1))
        return sorted(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                rows = [(d, *r) for d, t in zip(part.column("doc_id").to_pylist(), binary_list(part.column("text")), strict=True) for r in runs(words_of(t))]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(5)], ["doc_id", "item_id", "doc_start", "item_start", "n_words"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, item_id long, doc_start long, item_start long, n_words long")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, min_items: int = 2) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for each row of docs (repeated rows each give one; null ids are kept).

    n_hit counts the words inside any occurrence of a window. Null texts have no words; an empty benchmark hits nothing; other columns are ignored."""
    blocks = blocks_of(benchmark, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                n, hit, items = scan(binary_list(part.column("text")), blocks)
                digests = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in items]
                n_items = np.fromiter(map(len, items), np.int64, len(items))
                cols = [part.column("doc_id"), pa.array(n), pa.array(hit), pa.array(n_items), pa.array(digests, pa.string()), pa.array(n_items >= min_items)]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    slim = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return slim.mapInArrow(run, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, min_items: int = 1) -> DataFrame:
    """docs, all columns, without the rows in which windows of `min_items` items or more occur."""
    blocks = blocks_of(benchmark, window)
    typed = docs.withColumn("text", F.col("text").cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                _, _, items = scan(binary_list(part.column("text")), blocks)
                yield part.filter(pa.array([len(x) < min_items for x in items]))

    return typed.mapInArrow(run, typed.schema)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op1_decontaminate": op1_decontaminate}
ORACLE = {
    "op1_decontaminate": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
bw AS (SELECT DISTINCT item_id, least(8, len(w)) AS n, array_to_string(list_slice(w, i, i + least(8, len(w)) - 1), ' ') AS g
       FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 6))) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
marked AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hits)) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS k FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN marked USING (doc_id) LEFT JOIN named USING (doc_id)
"""
}
