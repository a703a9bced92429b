"""SimHash near-duplicates by tiled exact comparison.

Fingerprints are laid out by population count and cut into tiles of equal size. Two fingerprints within `radius` bits have population counts within
`radius` of each other, so a fingerprint only goes to the pairs of its tile with tiles of such counts; the others are skipped. Inside a tile pair the
same bound holds for the sums of the differences of the four 16-bit parts' counts, which skips most sub-tiles. What remains is compared exactly: numpy
exclusive-or and bit counts. A tile pair hands on a spanning forest of its links (never all pairs), and the forests are joined by distributed components.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillbin.llm._common import LOWER, binary_list, chunks, components, drop_path, fresh, scratch, stored, sweep, table

#: Fingerprints in a tile: a pair's rows are some 50 MB a side where sketches go along. Fewer rows make LEAST_TILES of at least LEAST_ROWS, for the tasks' sake.
TILE, LEAST_TILES, LEAST_ROWS = 1 << 19, 4, 4096
#: As these, for tiles of texts of like sizes, where a text goes to the tiles of sizes near its own alone.
SIZE_TILE, LEAST_SIZE_TILES = 1 << 18, 32
#: Classes of sizes to a doubling.
CLASSES = 64
#: Cells of an outer product held at once; rows of one among texts of like sizes, and its cells, for the processor's cache.
CELLS, ROWS, FEW_CELLS = 1 << 20, 128, 1 << 18
#: Bits within which a pair is proposed where shingle sets decide at 0.8: of 2000 made pairs just above it none lay farther apart (at 14 bits, 53).
WIDE = 22
#: Parts of a text's second fingerprint: four bits of the least shingle hash in each of so many ranges of hashes.
SKETCH = 256
#: Tile pairs that a filter lists, and texts whose hashes are broadcast; more of them are joined.
FEW_PAIRS, MOST_BROADCAST = 1000, 500_000


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """XXH64 (seed 42) of each `width`-word shingle, repeats included; the whole sequence if it is shorter."""
    words = text.translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, h = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([h(joined, 42)], np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    first = (ends - sizes)[: len(words) - width + 1].tolist()
    return np.array([h(joined[a:b], 42) for a, b in zip(first, ends[width - 1 :].tolist(), strict=True)], np.uint64)


def fingerprint(text: bytes, width: int = 4) -> int:
    return bits_of_majority(shingle_hashes(text, width))


def bits_of_majority(hashes: np.ndarray) -> int:
    """64 bits; a bit is 1 if it is set in over half of the hashes. No hashes: 0."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def sketch(distinct: np.ndarray) -> bytes:
    """SKETCH parts of ascending distinct hashes: the last four bits of the least hash in each range (1 for 0), 0 where a range has none.

    Sets that differ in d hashes differ in d parts at most, and sets of similarity s in SKETCH * (1 - s) parts at most on average."""
    ranges = (distinct >> np.uint64(56)).astype(np.int64)
    first = np.flatnonzero(np.diff(ranges, prepend=-1))
    parts = np.zeros(SKETCH, np.uint8)
    parts[ranges[first]] = np.maximum(distinct[first] & np.uint64(15), np.uint64(1)).astype(np.uint8)
    return (parts[::2] << 4 | parts[1::2]).tobytes()


def apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """In how many parts sketches (rows of integers) differ."""
    d = x ^ y
    d |= d >> np.uint64(2)
    d |= d >> np.uint64(1)
    return np.bitwise_count(d & np.uint64(0x1111111111111111)).sum(1, dtype=np.int64)


def most_apart(both: np.ndarray, similarity: float) -> np.ndarray:
    """Parts in which the sketches of two sets, `both` hashes together, may differ: what their difference can amount to, and eight deviations above the mean."""
    rate = 1 - similarity
    return np.minimum(both * rate / (1 + similarity) + 1e-9, SKETCH * rate + 8 * np.sqrt(SKETCH * rate * (1 - rate)))


def with_fingerprint(docs: DataFrame, width: int = 4, sketched: bool = False) -> DataFrame:
    """(doc_id, text_hash, fp, shingles) for each row: text_hash tells apart rows that share an id, shingles counts distinct ones.

    sketched adds their sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                fps, sizes, sketches = np.zeros(part.num_rows, np.uint64), np.zeros(part.num_rows, np.int64), []
                for k, text in enumerate(binary_list(part.column("text"))):
                    hashes = shingle_hashes(text, width)
                    distinct = np.unique(hashes)
                    fps[k], sizes[k] = bits_of_majority(hashes), len(distinct)
                    if sketched:
                        sketches.append(sketch(distinct))
                cols = [part.column("doc_id"), part.column("text_hash"), pa.array(fps.view(np.int64)), pa.array(sizes), *[pa.array(sketches, pa.binary())] * sketched]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "text_hash", "fp", "shingles", *["sketch"] * sketched])

    slim = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64("text").alias("text_hash"))
    return slim.mapInArrow(run, "doc_id long, text_hash long, fp long, shingles long" + ", sketch binary" * sketched)


def _segments(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(np.ascontiguousarray(x).view(np.uint16).reshape(-1, 4))


def _union(lab: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Joins the sets of u[i] and v[i]; lab holds each node's root."""
    while True:
        a, b = lab[u], lab[v]
        differ = a != b
        if not differ.any():
            return
        a, b = a[differ], b[differ]
        np.minimum.at(lab, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := lab[lab], lab):
            lab[:] = up


def tile_forest(left: np.ndarray, right: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Star edges of the components that links (at most `radius` bits apart) make between left and right, or within left."""

    def grouped(x):
        seg = _segments(x)
        key = seg.astype(np.int64) @ np.array([1 << 24, 1 << 16, 1 << 8, 1])
        order = np.argsort(key, kind="stable")
        _, at = np.unique(key[order], return_index=True)
        return order, np.append(at, len(x)), seg[order[at]].astype(np.int16)

    values = left if right is None else np.concatenate([left, right])
    lab = np.arange(len(values))
    lo, l_at, l_seg = grouped(left)
    ro, r_at, r_seg = (lo, l_at, l_seg) if right is None else grouped(right)
    base = 0 if right is None else len(left)
    for k in range(len(l_seg)):
        near = np.flatnonzero(np.abs(r_seg - l_seg[k]).sum(1) <= radius)
        if right is None:
            near = near[near >= k]
        if not len(near):
            continue
        rows = lo[l_at[k] : l_at[k + 1]]
        cols = np.concatenate([ro[r_at[n] : r_at[n + 1]] for n in near])
        for c in range(0, len(cols), CELLS):
            some = cols[c : c + CELLS]
            step = max(1, CELLS // len(some))
            for r in range(0, len(rows), step):
                own = rows[r : r + step]
                close = np.bitwise_count(values[own][:, None] ^ values[some + base][None, :]) <= radius
                if not close.any():
                    continue
                close &= lab[own][:, None] != lab[some + base][None, :]
                a, b = np.nonzero(close)
                if len(a):
                    _union(lab, own[a], some[b] + base)
    node = np.flatnonzero(lab != np.arange(len(lab)))
    return values[node], values[lab[node]]


def _dealt(fps: DataFrame, radius: int, tile: int) -> DataFrame:
    """fps once for each pair of tiles that it is compared in: pair, side, own (the pair of a tile with itself, which has side 0 alone).

    Rows are numbered by population count, in order of a hash where they share one; so a tile is a range of numbers, and what lies within `radius` of a
    count is another range. Only the counts of the 65 population counts come to the driver."""
    n = np.zeros(65, np.int64)
    for r in fps.groupBy(F.bit_count("fp").alias("p")).agg(F.count("*").alias("n")).collect():
        n[r.p] = r.n
    at = np.concatenate([[0], np.cumsum(n)])
    tiles = max(1, -(-int(at[-1]) // tile), min(LEAST_TILES, int(at[-1]) // LEAST_ROWS))
    size = max(1, -(-int(at[-1]) // tiles))
    first = [int(at[max(0, p - radius)]) // size for p in range(65)]
    last = [max(0, int(at[min(65, p + radius + 1)]) - 1) // size for p in range(65)]
    of = lambda values: F.element_at(F.array(*(F.lit(int(v)).cast("long") for v in values)), (F.bit_count("fp") + 1).cast("int"))
    number = of(at[:65]) + F.pmod(F.xxhash64(*fps.columns), F.greatest(of(n), F.lit(1)))
    return _copied(fps, fps.columns, F.floor(number / F.lit(size)), of(first), of(last), tiles)


def _copied(rows: DataFrame, columns: list[str], tile: Column, first: Column, last: Column, tiles: int) -> DataFrame:
    """columns of rows once for each pair of their tile with one from first to last: pair, side, own as in _dealt."""
    own = rows.withColumn("tile", tile.cast("long")).withColumn("other", F.explode(F.sequence(first, last)))
    pair = F.least("tile", "other") * F.lit(tiles) + F.greatest("tile", "other")
    return own.select(*columns, pair.alias("pair"), (F.col("other") < F.col("tile")).cast("int").alias("side"), (F.col("other") == F.col("tile")).alias("own"))


def _dealt_by_size(texts: DataFrame, similarity: float, tile: int) -> DataFrame:
    """As _dealt, of texts (text_hash, shingles and more): a tile is a range of sizes, and a text goes to those tiles alone that hold sizes with which sets
    can be as similar as `similarity`.

    Texts are numbered by classes of sizes, in order of a hash within a class, so that one very common size makes many tiles too."""
    kind = F.floor(F.log2(F.col("shingles") + 1) * CLASSES).cast("long")
    by_class = texts.groupBy(kind.alias("class")).agg(F.count("*").alias("n"), F.min("shingles").alias("least"), F.max("shingles").alias("most"))
    found = sorted(by_class.collect())  # 64 * CLASSES rows at most
    n, least, most = (np.array([r[k] for r in found], np.int64) for k in ("n", "least", "most"))
    at = np.concatenate([[0], np.cumsum(n)])
    total = int(at[-1])
    tiles = max(1, -(-total // tile), min(LEAST_SIZE_TILES, total // LEAST_ROWS))
    size = max(1, -(-total // tiles))
    first = at[np.searchsorted(most, least * similarity - 1e-6)] // size
    last = (at[np.searchsorted(least, (most + 1e-6) / similarity, "right")] - 1) // size
    rows = [(r["class"], *map(int, x)) for r, *x in zip(found, at, n, first, last, strict=False)]
    of = texts.sparkSession.createDataFrame(rows, "class_ long, at_ long, n_ long, first_ long, last_ long")
    known = texts.join(F.broadcast(of), kind == F.col("class_"))  # a row for each class
    return _copied(known, texts.columns, F.floor((F.col("at_") + F.pmod(F.xxhash64("text_hash"), "n_")) / F.lit(size)), F.col("first_"), F.col("last_"), tiles)


def links(fps: DataFrame, radius: int = 4, tile: int = TILE) -> DataFrame:
    """Edges (a, b) over distinct fingerprints (column fp) that connect exactly those that links connect."""

    def compare(t: pa.Table) -> pa.Table:
        fp, side = t.column("fp").to_numpy().view(np.uint64), t.column("side").to_numpy()
        left, right = fp[side == 0], fp[side == 1]
        if len(t) and t.column("own")[0].as_py():
            a, b = tile_forest(left, None, radius)
        else:
            a, b = tile_forest(left, right, radius) if len(left) and len(right) else (fp[:0], fp[:0])
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    return _dealt(fps, radius, tile).groupBy("pair").applyInArrow(compare, "a long, b long")


def clusters(docs: DataFrame, width: int = 4, radius: int = 4, tile: int = TILE) -> tuple[DataFrame, DataFrame]:
    """(rows (doc_id, text_hash, fp), classes (fp, component_id)).

    component_id is the smallest doc_id among the rows whose fingerprints are reachable; null if none has an id."""
    path = scratch(docs.sparkSession)
    rows = stored(with_fingerprint(docs, width), f"{path}/rows")
    own = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), f"{path}/own")
    roots = components(links(own.select("fp"), radius, tile), path)
    named = own.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root_fp", F.coalesce("root", "fp"))
    best = named.groupBy("root_fp").agg(F.min("least").alias("component_id"))
    return rows, named.select("fp", "root_fp").join(best, "root_fp").drop("root_fp")


def near_duplicates(docs: DataFrame, width: int = 4, radius: int = 4, tile: int = TILE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for each row of docs.

    Null and empty texts, and texts without words, have fingerprint zero and link like any other. Repeated rows each give a row. Rows without
    doc_id join components but never name them; a component without any id has a null component_id. Other columns are ignored."""
    rows, classes = clusters(docs, width, radius, tile)
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return rows.join(classes, "fp").select("doc_id", hexed.alias("fingerprint"), "component_id")


# ---------------------------------------------------------------- verified near copies


def tile_pairs(
    left: np.ndarray, right: np.ndarray | None, sizes: tuple[np.ndarray, np.ndarray], sketches: tuple[np.ndarray, np.ndarray], radius: int, similarity: float, most: int = 3,
    roots: tuple[np.ndarray, np.ndarray] | None = None, tried: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None,
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Positions (in left, in right or left) of links of at most `radius` bits: of each fingerprint, on either side, its `most` nearest ones. Then the
    positions on both sides of what has further links: a link that is left out has both of its ends there.

    sizes, sketches: distinct shingles of both sides, and their sketches as rows of integers; sets that cannot be as similar as `similarity` by their
    sizes, or whose sketches are farther apart than such sets' are, are passed over.
    roots: where given, links between equal ones are passed over; tried: of positions on both sides, which links are not wanted again."""
    other = left if right is None else right
    l_size, r_size = sizes[0], sizes[right is not None]
    half = sketches[0].shape[1] // 2
    l_sketch, r_sketch = ([np.ascontiguousarray(x[:, :half]), np.ascontiguousarray(x[:, half:])] for x in (sketches[0], sketches[right is not None]))
    l_order, r_order = np.lexsort((left, l_size)), np.lexsort((other, r_size))
    l_fp, r_fp, l_sizes, r_sizes = left[l_order], other[r_order], l_size[l_order], r_size[r_order]
    found: list[np.ndarray] = []
    more: tuple[list[np.ndarray], list[np.ndarray]] = [], []
    for at in range(0, len(left), ROWS):
        own, ends = l_fp[at : at + ROWS, None], min(at + ROWS, len(left))
        low = int(np.searchsorted(r_sizes, similarity * l_sizes[at] - 1e-6))
        high = int(np.searchsorted(r_sizes, (l_sizes[ends - 1] + 1e-6) / similarity, "right"))
        for c in range(max(low, at + 1) if right is None else low, high, FEW_CELLS // ROWS):
            cols = r_fp[c : min(high, c + FEW_CELLS // ROWS)]
            dist = np.bitwise_count(own ^ cols[None, :])
            i, j = np.divmod(np.flatnonzero(dist.reshape(-1) <= radius), len(cols))
            d = dist[i, j]
            a, b = l_sizes[at + i], r_sizes[c + j]
            alike = np.minimum(a, b) >= similarity * np.maximum(a, b)
            if right is None:
                alike &= c + j > at + i
            i, j, d, both = i[alike], j[alike], d[alike], (a + b)[alike]
            i, j = l_order[at + i], r_order[c + j]
            if roots is not None:
                alike = roots[0][i] != roots[right is not None][j]
                i, j, d, both = i[alike], j[alike], d[alike], both[alike]
            limit, parts = most_apart(both, similarity), np.zeros(len(i), np.int64)
            for x, y in zip(l_sketch, r_sketch, strict=True):  # what the first half of the sketches rules out needs no second one
                parts += apart(x[i], y[j])
                alike = parts <= limit
                i, j, d, limit, parts = i[alike], j[alike], d[alike], limit[alike], parts[alike]
            if tried is not None and len(i):
                alike = ~tried(i, j)
                i, j, d = i[alike], j[alike], d[alike]
            if not len(i):
                continue
            use = np.zeros(len(i), bool)
            for side in (i, j):
                order = np.lexsort((i + j, d, side))
                key = side[order]
                begin = np.concatenate([[True], key[1:] != key[:-1]])
                rank = np.arange(len(key)) - np.maximum.accumulate(np.where(begin, np.arange(len(key)), 0))
                use[order[rank < most]] = True
            found.append(np.stack([i[use], j[use]], 1))
            for ends_, side in zip(more, (i[~use], j[~use]), strict=True):
                ends_.append(np.unique(side))
    none = np.zeros(0, np.int64)
    both = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
    return both[:, 0], both[:, 1], *(np.unique(np.concatenate(x)) if x else none for x in more)


def _propose(t: pa.Table, tried: pa.Table | None, radius: int, similarity: float, most: int) -> pa.Table:
    """One tile pair's links (pair, a, b), and (pair, a, no b, side) for each text that has further ones."""
    side = t.column("side").to_numpy()
    fp, th, n = (tuple(x[side == k] for k in (0, 1)) for x in (t.column("fp").to_numpy().view(np.uint64), t.column("text_hash").to_numpy(), t.column("shingles").to_numpy()))
    two = not (len(t) and t.column("own")[0].as_py())
    sketches_ = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint64).reshape(-1, SKETCH // 16)
    sketches = sketches_[side == 0], sketches_[side == 1]
    roots, known = None, None
    if tried is not None:
        all_roots = t.column("root").to_numpy()
        roots = all_roots[side == 0], all_roots[side == 1]
        done = set(zip(tried.column("a").to_pylist(), tried.column("b").to_pylist(), strict=True))

        def known(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            x, y = th[0][i], th[two][j]
            return np.fromiter((k in done for k in zip(np.maximum(x, y).tolist(), np.minimum(x, y).tolist(), strict=True)), bool, len(x))

    i, j, more_i, more_j = tile_pairs(fp[0], fp[1] if two else None, n, sketches, radius, similarity, most, roots, known)
    x, y = th[0][i], th[two][j]
    more = [(th[0][more_i], 0), (th[two][more_j], int(two))]
    a = np.concatenate([np.maximum(x, y), *(m for m, _ in more)])
    b = pa.array(np.concatenate([np.minimum(x, y), *(m for m, _ in more)]), mask=np.arange(len(a)) >= len(x))
    which = np.concatenate([np.zeros(len(x), np.int32), *(np.full(len(m), k, np.int32) for m, k in more)])
    pair = t.column("pair")[0].as_py() if len(t) else 0
    return pa.table({"pair": pa.array(np.full(len(a), pair, np.int64)), "a": pa.array(a), "b": b, "side": pa.array(which), "own": pa.array(np.full(len(a), not two))})


def near_copies(docs: DataFrame, width: int = 5, radius: int = 14, similarity: float = 0.8, tile: int = SIZE_TILE, most: int = 1) -> tuple[DataFrame, DataFrame]:
    """(rows (doc_id, text_hash, fp), classes (text_hash, root)): texts joined by chains of pairs within `radius` bits whose `width`-word shingle sets
    have a Jaccard similarity of `similarity` or more.

    Tiles are ranges of the sets' sizes, and only sizes that allow the similarity are compared. The comparison proposes each text's `most` nearest fingerprints in a tile pair; the sets decide. Texts with further ones are compared again,
    round by round, without the pairs that were tried or are joined by now, until none is left: every pair is decided, and a group of copies never
    emits all of its pairs. A round allows eight times the last one's proposals for a text, so that rounds are few."""
    spark, path = docs.sparkSession, scratch(docs.sparkSession)
    rows = stored(with_fingerprint(docs, width, sketched=True), f"{path}/rows")
    texts = stored(rows.groupBy("text_hash").agg(*(F.min(c).alias(c) for c in ("fp", "shingles", "sketch"))), f"{path}/texts")
    kinds = "pair long, a long, b long, side int, own boolean"

    def shingle_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                sets = [np.unique(shingle_hashes(t, width)).tobytes() for t in binary_list(part.column("text"))]
                yield pa.RecordBatch.from_arrays([part.column("text_hash"), pa.array(sets, pa.binary())], ["text_hash", "shingles"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= similarity * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    slim = docs.select(F.xxhash64("text").alias("text_hash"), F.col("text").cast("string").alias("text"))

    def joined(pairs: DataFrame, turn: int) -> DataFrame:
        """The pairs (a, b) that are similar enough."""
        wanted = pairs.select(F.col("a").alias("text_hash")).union(pairs.select("b")).distinct()
        if wanted.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST:
            wanted = F.broadcast(wanted)  # 8 bytes each; of more, the texts are shuffled to them
        sets = stored(slim.join(wanted, "text_hash", "left_semi").dropDuplicates(["text_hash"]).mapInArrow(shingle_sets, "text_hash long, shingles binary"), f"{path}/sets{turn}")
        one = pairs.join(sets.select(F.col("text_hash").alias("a"), F.col("shingles").alias("x")), "a")
        two = one.join(sets.select(F.col("text_hash").alias("b"), F.col("shingles").alias("y")), "b")
        return two.select("a", "b", "x", "y").mapInArrow(verify, "a long, b long")

    dealt = _dealt_by_size(texts, similarity, tile)
    proposed = stored(dealt.groupBy("pair").applyInArrow(lambda t: _propose(t, None, radius, similarity, most), kinds), f"{path}/proposed0")
    tried, edges, turn = None, None, 0
    while True:
        pairs = proposed.filter("b is not null and a <> b").select("pair", "a", "b").distinct()
        new = joined(pairs.select("a", "b"), turn)
        roots = components(new if edges is None else edges.union(new), f"{path}/turn{turn}")
        drop_path(spark, f"{path}/sets{turn}")  # the components are written
        sweep(spark)
        edges = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
        tried = pairs if tried is None else tried.union(pairs)
        over = proposed.filter("b is null").select("pair", F.col("a").alias("text_hash"), "side", "own").distinct()
        over = over.join(texts, "text_hash").join(roots.withColumnRenamed("node", "text_hash"), "text_hash", "left")
        over = stored(over.withColumn("root", F.coalesce("root", "text_hash")), f"{path}/over{turn}")
        apart = over.groupBy("pair").agg(F.min("root").alias("least"), F.max("root").alias("last")).filter("least <> last").select("pair")
        few = [r.pair for r in apart.limit(FEW_PAIRS + 1).collect()]
        unsettled = (lambda df: df.filter(F.col("pair").isin(few))) if len(few) <= FEW_PAIRS else (lambda df: df.join(apart, "pair", "left_semi"))  # noqa: E731, B023
        again = unsettled(over)
        turn += 1
        if again.isEmpty():
            break
        past = unsettled(tried)
        # few texts are left, so each may hand on more
        now = most * 8**turn
        compare = lambda t, old: _propose(t, old, radius, similarity, now)
        proposed = stored(again.groupBy("pair").cogroup(past.groupBy("pair")).applyInArrow(compare, kinds), f"{path}/proposed{turn}")
        if proposed.isEmpty():
            break
    named = texts.join(roots.withColumnRenamed("node", "text_hash"), "text_hash", "left")
    return rows, named.select("text_hash", F.coalesce("root", "text_hash").alias("root"))


def deduplicate(docs: DataFrame, width: int = 5, radius: int = WIDE, similarity: float = 0.8, tile: int = SIZE_TILE) -> DataFrame:
    """docs, all columns, with one row left of each group of near copies: that of the smallest doc_id (of repeated rows, one; a group without ids keeps
    a row of one of its texts). Null texts are one text of their own; texts without words are alike."""
    rows, classes = near_copies(docs, width, radius, similarity, tile)
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("best")
    kept = rows.groupBy("text_hash").agg(F.min("doc_id").alias("doc_id")).join(classes, "text_hash").groupBy("root").agg(best)
    own_id, own_hash, keep_id, keep_hash = fresh(docs, "own_id", "own_hash", "keep_id", "keep_hash")
    kept = kept.select(F.col("best.doc_id").alias(keep_id), F.col("best.text_hash").alias(keep_hash))
    marked = docs.withColumns({own_hash: F.xxhash64("text"), own_id: F.col("doc_id").cast("long")})
    found = marked.join(kept, F.col(own_id).eqNullSafe(F.col(keep_id)) & (F.col(own_hash) == F.col(keep_hash)), "left_semi")
    return found.dropDuplicates([own_id, own_hash]).drop(own_hash, own_id)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op5_simhash": op5_simhash}
ORACLE: dict[str, str] = {}
