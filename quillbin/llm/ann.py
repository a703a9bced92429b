"""Approximate nearest neighbours with an inverted multi-index.

Unit vectors are cut in two halves, each with a codebook of its own; a cell is a pair of centroids. A query walks the pairs in the order of
their summed distances (multi-sequence traversal with a heap) until the cells hold the share of all rows that the wanted recall needs, and the
entries of those cells are reranked by exact cosine. That share is measured when the index is fitted, against brute force on a bounded sample.
Cells travel in blocks of bounded size (a larger cell is split over several). A block meets the queries that probe it in parts of bounded size, and is
copied once for each part: what travels grows with the rows and the probes, and no task gathers a cell or a query set.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillbin.llm._common import scratch, stored, table

#: Rows that the codebooks are fitted on at most (those with the smallest hashes of their ids), and queries of the recall measurement.
SAMPLE, PROBED = 20_000, 200
#: Recall at which the walk's length is set.
RECALL = 0.96
BLOCK_ROWS, BLOCK_QUERIES = 8192, 4096


def codebook_size(n: int) -> int:
    return int(np.clip(2 * n**0.3, 1, 2048))


def kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Lloyd's algorithm from evenly spaced rows; a centroid that loses its rows stays."""
    c = x[np.unique(np.linspace(0, len(x) - 1, min(k, len(x))).astype(int))].copy()
    for _ in range(rounds):
        own = distances(x, c).argmin(1)
        n = np.bincount(own, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None, :], 0)


def unit(v: np.ndarray) -> np.ndarray:
    """Rows scaled to length one in double precision, by way of their largest component so that nothing overflows."""
    v = v.astype(np.float64)
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


class Index:
    """Codebooks of both halves, rows in each cell, and the share of all rows that a query has to see."""

    def __init__(self, sample: np.ndarray, neighbours: int, recall: float, size: int):
        half = sample.shape[1] // 2
        self.half = half
        self.one, self.two = kmeans(sample[:, :half], size), kmeans(sample[:, half:], size)
        self.counts = np.bincount(self.cells(sample), minlength=len(self.one) * len(self.two))
        self.share = self._share(sample, neighbours, recall)

    def cells(self, v: np.ndarray) -> np.ndarray:
        return distances(v[:, : self.half], self.one).argmin(1) * len(self.two) + distances(v[:, self.half :], self.two).argmin(1)

    def walk(self, v: np.ndarray) -> Iterator[int]:
        """Cells by the sum of their halves' distances to the vector v, each once."""
        a, b = distances(v[None, : self.half], self.one)[0], distances(v[None, self.half :], self.two)[0]
        i, j = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
        a, b, i, j = a[i].tolist(), b[j].tolist(), i.tolist(), j.tolist()
        heap, done, width = [(a[0] + b[0], 0, 0)], [0] * len(a), len(self.two)
        while heap:
            _, x, y = heapq.heappop(heap)
            yield i[x] * width + j[y]
            done[x] = y + 1
            # (x, y) lets in its neighbours whose own other neighbour is done
            if x + 1 < len(a) and done[x + 1] == y:
                heapq.heappush(heap, (a[x + 1] + b[y], x + 1, y))
            if y + 1 < len(b) and (x == 0 or done[x - 1] > y + 1):
                heapq.heappush(heap, (a[x] + b[y + 1], x, y + 1))

    def visit(self, v: np.ndarray, rows: int) -> list[int]:
        """The first cells of the walk that hold `rows` rows together (empty ones left out)."""
        out, seen = [], 0
        for cell in self.walk(v):
            if n := int(self.counts[cell]):
                out.append(cell)
                seen += n
                if seen >= rows:
                    break
        return out

    def _share(self, sample: np.ndarray, neighbours: int, recall: float) -> float:
        """Share of the rows up to the cell that holds a true neighbour: the quantile at `recall` over sampled queries' neighbours."""
        if len(sample) < 2:
            return 1.0
        own, needed = self.cells(sample), []
        for q in np.unique(np.linspace(0, len(sample) - 1, min(PROBED, len(sample))).astype(int)).tolist():
            sims = sample @ sample[q]
            sims[q] = -2
            k = min(neighbours, len(sample) - 1)
            true = own[np.argpartition(-sims, k - 1)[:k]]
            order = np.fromiter(self.walk(sample[q]), np.int64)
            seen = np.empty(len(order))
            seen[order] = np.cumsum(self.counts[order])
            needed += (seen[true] / len(sample)).tolist()
        return float(min(1.0, np.quantile(needed, recall)))


def cosine(entries: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Of each row with the vector, on the numbers as they are; scaled first only where their squares leave the range of doubles."""
    with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
        c = (entries * query).sum(1) / (np.sqrt((entries * entries).sum(1)) * np.sqrt((query * query).sum()))
    odd = ~(np.abs(c) <= 1.0000001)
    if odd.any():
        c[odd] = (unit(entries[odd]) * unit(query[None])).sum(1)
    return c


def top(queries: np.ndarray, entries: np.ndarray, allowed: np.ndarray, q_rows: np.ndarray, e_rows: np.ndarray, e_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query position, entry position, cosine): each query's k nearest allowed entries, never its own row; ties go to smaller ids."""
    out_q, out_e, out_s = [], [], []
    units = unit(entries)
    for at in range(0, len(queries), 128):
        sims = unit(queries[at : at + 128]) @ units.T
        sims[~allowed[at : at + 128] | (q_rows[at : at + 128, None] == e_rows[None, :])] = -2
        kk = min(k, sims.shape[1])
        least = np.partition(sims, sims.shape[1] - kk, axis=1)[:, sims.shape[1] - kk]
        for r in range(len(sims)):
            near = np.flatnonzero((sims[r] >= least[r] - 1e-12) & (sims[r] > -1.5))
            exact = cosine(entries[near], queries[at + r])
            best = np.lexsort((e_ids[near], -exact))[:k]
            out_q.append(np.full(len(best), at + r))
            out_e.append(near[best])
            out_s.append(exact[best])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *out_q]).astype(np.int64), np.concatenate([none, *out_e]).astype(np.int64), np.concatenate([np.zeros(0), *out_s])


def neighbours(vectors: DataFrame, every: int = 50, k: int = 5, recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score: of each row whose vec_id is divisible by `every`, the k nearest other rows found, by cosine.

    Rows without vec_id, and vectors that are null, empty, zero, of another length than the commonest (of equally common, the shortest), or that hold null
    or non-finite components, take no part. A query has fewer than k rows only if there are fewer candidates. Rows that share a vec_id are rows of
    their own (each a query, and candidates of each other). Other columns are ignored."""
    spark, path = vectors.sparkSession, scratch(vectors.sparkSession)
    x = F.col("embedding").cast("array<double>")
    sound = F.coalesce(F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(x, lambda c: c != 0), F.lit(False))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("v")).filter(F.col("vec_id").isNotNull() & sound)
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), f"{path}/rows")
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    result = "query_id long, rank int, vec_id long, score double"
    if not sizes:
        return spark.createDataFrame([], result)
    dim, n = sizes[0].d, sizes[0].n
    rows = rows.filter(F.size("v") == dim)
    sample = rows.select("v", F.xxhash64(F.lit(3), "vec_id").alias("h"), "row").orderBy("h", "row").limit(SAMPLE).select("v").collect()  # SAMPLE rows at most
    index = Index(unit(np.array([r.v for r in sample])), k, recall, codebook_size(n))
    fitted = spark.sparkContext.broadcast(index)

    def matrix(column: pa.Array) -> np.ndarray:
        return np.ascontiguousarray(np.asarray(column.flatten()).reshape(len(column), dim), np.float64)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = matrix(batch.column("v"))
                yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("vec_id"), pa.array([y.tobytes() for y in v], pa.binary()), pa.array(fitted.value.cells(unit(v)))], ["row", "vec_id", "v", "cell"])

    entries = stored(rows.mapInArrow(place, "row long, vec_id long, v binary, cell long"), f"{path}/entries")
    counts = np.zeros(len(index.counts), np.int64)
    for r in entries.groupBy("cell").agg(F.count("*").alias("n")).collect():  # a row for each cell of the codebooks' size
        counts[r.cell] = r.n
    index.counts = counts
    fitted = spark.sparkContext.broadcast(index)
    # cells in blocks: (first block, blocks) of each cell
    first, parts, block, held = np.zeros(len(counts), np.int64), np.ones(len(counts), np.int64), 0, 0
    for cell, m in enumerate(counts.tolist()):
        if m > BLOCK_ROWS:
            block += held > 0
            first[cell], parts[cell] = block, -(-m // BLOCK_ROWS)
            block, held = block + int(parts[cell]), 0
        else:
            if held + m > BLOCK_ROWS:
                block, held = block + 1, 0
            first[cell], held = block, held + m
    dealt = spark.sparkContext.broadcast((first, parts))
    is_query = F.pmod("vec_id", F.lit(every)) == 0
    wanted = max(k + 1, int(np.ceil(index.share * n)))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, (start, many) = fitted.value, dealt.value
        for batch in batches:
            out: list[tuple] = []
            for row, vec_id, raw in zip(*(batch.column(c).to_pylist() for c in ("row", "vec_id", "v")), strict=True):
                by_block: dict[int, list[int]] = {}
                for cell in own.visit(unit(np.frombuffer(raw)[None])[0], wanted):
                    for b in range(int(start[cell]), int(start[cell] + many[cell])):
                        by_block.setdefault(b, []).append(cell)
                out += [(row, vec_id, raw, b, np.array(c, "<i4").tobytes()) for b, c in by_block.items()]
            kinds = {"row": pa.int64(), "vec_id": pa.int64(), "v": pa.binary(), "block": pa.int64(), "cells": pa.binary()}
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(kinds.values())], list(kinds))

    def place_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, many = dealt.value
        for batch in batches:
            cell, row = batch.column("cell").to_numpy(), batch.column("row").to_numpy()
            b = start[cell] + (row * 2654435761 >> 7) % many[cell]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "vec_id", "v", "cell")), pa.array(b)], ["row", "vec_id", "v", "cell", "block"])

    probes = entries.filter(is_query).select("row", "vec_id", "v").repartition("row").mapInArrow(probe, "row long, vec_id long, v binary, block long, cells binary")
    probes = stored(probes, f"{path}/probes")
    # blocks that are probed, and in how many parts their queries come; a block has thousands of rows, so this table is small, and if not it is joined
    asked = stored(probes.groupBy("block").agg(F.ceil(F.count("*") / BLOCK_QUERIES).cast("long").alias("parts")), f"{path}/asked")
    probes = probes.join(asked, "block").withColumn("q", F.pmod(F.xxhash64("row"), F.col("parts"))).drop("parts")
    blocks = entries.mapInArrow(place_blocks, "row long, vec_id long, v binary, cell long, block long").join(asked, "block")
    blocks = blocks.withColumn("q", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")

    def rerank(e: pa.Table, q: pa.Table) -> pa.Table:
        kinds = {"row": pa.int64(), "query_id": pa.int64(), "vec_id": pa.int64(), "score": pa.float64()}
        if not e.num_rows or not q.num_rows:
            return pa.table({c: pa.array([], t) for c, t in kinds.items()})
        ev, qv = (np.frombuffer(b"".join(t.column("v").to_pylist())).reshape(-1, dim) for t in (e, q))
        cells, e_cell = np.unique(e.column("cell").to_numpy(), return_inverse=True)
        open_ = np.zeros((q.num_rows, len(cells)), bool)
        for i, raw in enumerate(q.column("cells").to_pylist()):
            open_[i] = np.isin(cells, np.frombuffer(raw, "<i4"))
        q_row, q_id, e_id = q.column("row").to_numpy(), q.column("vec_id").to_numpy(), e.column("vec_id").to_numpy()
        parts_ = []
        for at in range(0, q.num_rows, 512):
            i, j, s = top(qv[at : at + 512], ev, open_[at : at + 512][:, e_cell], q_row[at : at + 512], e.column("row").to_numpy(), e_id, k)
            parts_.append(pa.table({"row": q_row[at + i], "query_id": q_id[at + i], "vec_id": e_id[j], "score": s}))
        return pa.concat_tables(parts_)

    found = blocks.groupBy("block", "q").cogroup(probes.groupBy("block", "q")).applyInArrow(rerank, "row long, query_id long, vec_id long, score double")
    best = found.withColumn("rank", F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")))
    return best.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(table(spark, sf_dir, "embeddings"))


QUERIES = {"op3_ann": op3_ann}
ORACLE: dict[str, str] = {}
