"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by source and exact length. Each source's target is met by whole passes over it and, for the rest of the budget, by a
bounded-knapsack dynamic programme over its length counts; the documents of each length are then picked in a seeded order. Only the counts
of a source meet in one task: as many rows as it has distinct lengths.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillbin.llm._common import binary_list, chunks, fresh, scratch, stored, table

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST = 2
SEED = 17
#: Words of budget that the dynamic programme fills at most; what lies above goes by greedy steps first.
KNAPSACK_WORDS = 1 << 18
#: Documents of one source and length that are ordered together.
BUCKET = 4096


def fit_lengths(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length (at most counts) to take for a total near budget.

    First the same fraction of every length, rounded down; then single documents by their rounding remainders; then subset sums."""
    total = int((lengths * counts).sum())
    take = np.zeros(len(lengths), np.int64)
    if budget <= 0 or total <= 0:
        return take
    if budget >= total:
        return np.where(lengths > 0, counts, 0)
    exact = counts * (budget / total)
    take = np.where(lengths > 0, np.minimum(np.floor(exact).astype(np.int64), counts), 0)
    left = budget - int((take * lengths).sum())
    order = np.lexsort((lengths, take - exact))
    order = order[(lengths[order] > 0) & (take[order] < counts[order])]
    run = np.cumsum(lengths[order])
    reserve = min(KNAPSACK_WORDS // 2, 20 * max(1, total // max(1, int(counts.sum()))))  # left for subset sums to be exact
    some = order[: np.searchsorted(run, left - reserve, "right")]
    take[some] += 1
    left -= int(lengths[some].sum())
    # whole documents, the longest that fit first, until the rest is small
    for k in np.argsort(-lengths, kind="stable").tolist():
        if left <= KNAPSACK_WORDS:
            break
        if lengths[k] > 0 and (n := min(int(counts[k] - take[k]), left // int(lengths[k]))) > 0:
            take[k] += n
            left -= n * int(lengths[k])
    return take + _subset_sum(lengths, counts - take, left)


def _subset_sum(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """Bounded knapsack: bit s of a state says that s words can be made; the reachable total nearest below budget is traced back."""
    take = np.zeros(len(lengths), np.int64)
    if budget <= 0 or budget > KNAPSACK_WORDS:
        return take
    full, state, steps = (1 << (budget + 1)) - 1, 1, []
    for k in np.argsort(lengths, kind="stable").tolist():
        size, n = int(lengths[k]), int(counts[k])
        if size <= 0 or size > budget:
            continue
        n, part = min(n, budget // size), 1
        while n > 0 and not state >> budget & 1:
            part_now = min(part, n)
            new = (state | state << size * part_now) & full
            if new != state:
                steps.append((state, k, part_now))
                state = new
            n -= part_now
            part *= 2
        if state >> budget & 1:
            break
    at = state.bit_length() - 1
    for before, k, n in reversed(steps):
        if not before >> at & 1:
            take[k] += n
            at -= n * int(lengths[k])
    return take


def _rows(docs: DataFrame, seed: int, key: Column) -> DataFrame:
    """doc_id, key, source, size, order (a seeded hash) for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                sizes = pa.array([len(t.split()) for t in binary_list(part.column("text"))], pa.int64())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "key", "source", "order")), sizes], ["doc_id", "key", "source", "order", "size"])

    order = F.xxhash64(F.lit(seed), F.col("doc_id").cast("long"), F.col("text").cast("string"))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), key.alias("key"), F.col("source").cast("string").alias("source"), order.alias("order"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id long, key long, source string, order long, size long")


def targets(counts: DataFrame, path: str, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """source, source_size, target: source by source in code-point order (null last) the weights repeat; no target exceeds most times its source.

    The excess of capped targets goes to the others by weight, round by round; a round is one aggregate over the table of sources."""
    by_name = F.col("source").asc_nulls_last()
    sizes = counts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    ranked = stored(sizes.repartitionByRange(by_name).sortWithinPartitions(by_name).withColumn("at", F.monotonically_increasing_id()), f"{path}/sources")
    part = F.shiftrightunsigned("at", 33)
    held = sorted((r.part, r.n) for r in ranked.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())  # a row for each task
    before, starts = 0, []
    for p, n in held:
        starts.append((p, before))
        before += n
    base = ranked.sparkSession.createDataFrame(starts, "part long, before long")
    rank = F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    weighed = ranked.withColumn("part", part).join(F.broadcast(base), "part")  # a row for each task
    weighed = weighed.select("source", "source_size", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(rank, F.lit(len(weights))) + 1).cast("int")).alias("weight"))
    cap = F.col("source_size") * float(most)
    budget = share * (weighed.agg(F.sum("source_size")).first()[0] or 0)
    level, n_capped = 0.0, -1
    while True:
        over = F.lit(level) * F.col("weight") > cap
        capped, size, weight = weighed.agg(F.count_if(over), F.sum(F.when(over, cap)), F.sum(F.when(~over, F.col("weight")))).first()
        if capped == n_capped or not weight:
            break
        level, n_capped = (budget - (size or 0.0)) / weight, capped
    return weighed.select("source", "source_size", F.least(F.lit(level) * F.col("weight"), cap).alias("target"))


def allot(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: int = SEED, key: Column | None = None) -> DataFrame:
    """doc_id, key, size, source_size, target, copies for each row of docs: how often the mix takes it, 0 to `most` times.

    Null texts have size 0; null sources are one source; rows of size 0 are taken as the whole passes take them. Equal ids and repeated rows are
    rows of their own. The order of picking is a hash of seed, id and text, so reruns agree; ties of equal rows pick equal rows."""
    path = scratch(docs.sparkSession)
    rows = stored(_rows(docs, seed, F.lit(0).cast("long") if key is None else key), f"{path}/rows")
    counts = stored(rows.groupBy("source", "size").agg(F.count("*").alias("n")), f"{path}/counts")
    goal = targets(counts, path, weights, share, most).cache()

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        lengths, n = pdf["size"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64)
        size, target = int((lengths * n).sum()), int(round(float(pdf["target"].iloc[0])))
        passes = min(most, target // size) if size else 0
        extra = fit_lengths(lengths, n, target - passes * size) if passes < most else np.zeros(len(n), np.int64)
        return pdf.assign(passes=passes, extra=extra)

    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    joined = counts.alias("c").join(goal.alias("g"), same(counts, goal)).select(counts["source"], "size", "n", "source_size", "target")
    kinds = "source string, size long, n long, source_size long, target double"
    chosen = stored(joined.groupBy("source").applyInPandas(choose, f"{kinds}, passes int, extra long"), f"{path}/chosen")
    goal.unpersist()
    bucket = F.pmod("order", F.lit(1) + F.floor(F.col("n") / BUCKET))
    dealt = rows.join(chosen, same(rows, chosen) & (rows["size"] == chosen["size"])).select("doc_id", "key", rows["source"], rows["size"], "order", "source_size", "target", "passes", "extra", bucket.alias("bucket"))
    held = dealt.groupBy("source", "size", "bucket").agg(F.count("*").alias("m"))
    earlier = Window.partitionBy("source", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    held = held.select(F.col("source").alias("s"), F.col("size").alias("z"), F.col("bucket").alias("b"), F.coalesce(F.sum("m").over(earlier), F.lit(0)).alias("earlier"))
    own = Window.partitionBy("source", "size", "bucket").orderBy("order", "doc_id", "key")
    ranked = dealt.withColumn("rank", F.row_number().over(own))
    ranked = ranked.join(held, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")) & (F.col("bucket") == F.col("b")))
    copies = F.col("passes") + (F.col("earlier") + F.col("rank") <= F.col("extra")).cast("int")
    return ranked.select("doc_id", "key", "size", "source_size", "target", copies.alias("copies"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: int = SEED) -> DataFrame:
    """The mix itself: docs' rows, all columns, each as often as allot says."""
    own_id, own_key, taken_id, taken_key, n, copy = fresh(docs, "own_id", "own_key", "taken_id", "taken_key", "times", "copy")
    plain = [F.col(f"`{c.replace('`', '``')}`") for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    key = F.xxhash64(*plain)
    taken = allot(docs, weights, share, most, seed, key).groupBy("doc_id", "key").agg(F.sum("copies").alias(n)).filter(F.col(n) > 0)
    taken = taken.withColumnsRenamed({"doc_id": taken_id, "key": taken_key})
    marked = docs.withColumns({own_id: F.col("doc_id").cast("long"), own_key: key})
    met = marked.join(taken, F.col(own_id).eqNullSafe(F.col(taken_id)) & (F.col(own_key) == F.col(taken_key))).dropDuplicates([own_id, own_key])
    return met.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(n).cast("int")))).drop(own_id, own_key, taken_id, taken_key, n, copy)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = allot(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


QUERIES = {"op8_mixing": op8_mixing}
ORACLE: dict[str, str] = {}
