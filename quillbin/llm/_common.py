"""Shared helpers of the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker handles at once; a longer document is a chunk of its own.
CHUNK_BYTES = 8 << 20

_UPPER = range(0x41, 0x5B)
#: Lower-cases A-Z and nothing else, on UTF-8 bytes.
LOWER = bytes(b | 0x20 if b in _UPPER else b for b in range(256))
#: As LOWER; every ASCII byte that is neither a letter nor a digit becomes a space.
ALNUM = bytes(b | 0x20 if b in _UPPER else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(column: str | Column, modulus: int) -> Column:
    """crc32 of the decimal text of an id, modulo; null ids fall in 0."""
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(modulus)), F.lit(0))


def binary_list(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null becomes empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most `limit` bytes of text each (one row at least)."""
    if not batch.num_rows:
        return
    col = batch.column(batch.schema.get_field_index(column))
    sizes = np.asarray(pc.fill_null(pc.binary_length(col), 0)).astype(np.int64)
    part = np.cumsum(sizes) // limit
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def lean() -> None:
    """Gives back memory that this worker has freed: what an earlier task of another stage has held stays with a reused worker otherwise."""
    pa.default_memory_pool().release_unused()
    if hasattr(ctypes.CDLL(None), "malloc_trim"):
        ctypes.CDLL(None).malloc_trim(0)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of df has."""
    taken = {c.lower() for c in df.columns}
    return [next(x for x in (name + "_" * k for k in range(len(taken) + 1)) if x.lower() not in taken) for name in names]


#: Scratch folders of this process that have not been dropped.
MADE: list[str] = []


def scratch(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which all executors share; it goes when the driver ends, or by drop_scratch.

    Where that setting is absent, a folder of this machine is made in local mode; on a cluster, whose executors would not see it, it is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.conf.get("quillbin.scratch", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="quillbin-")
        spark.conf.set("quillbin.scratch", base)
    path = f"{base}/quillbin-{uuid.uuid4().hex}"
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(p)
    fs.deleteOnExit(p)
    MADE.append(path)
    return path


def drop_scratch(spark: SparkSession, paths: list[str]) -> None:
    """Deletes scratch folders that no DataFrame in use reads any more, and lets Spark drop the shuffles that nothing refers to."""
    for path in paths:
        drop_path(spark, path)
        if path in MADE:
            MADE.remove(path)
    sweep(spark)


def sweep(spark: SparkSession) -> None:
    """Spark deletes the shuffles of a plan once the driver's collector has found it unreachable, which may take long without this; Python's collector lets
    go of the plan first, which a cycle of closures may still hold."""
    gc.collect()
    spark._jvm.System.gc()


def drop_path(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def stored(df: DataFrame, path: str) -> DataFrame:
    """Writes and rereads: cuts the lineage at files that outlive any executor."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(edges: DataFrame, path: str, max_rounds: int = 60) -> DataFrame:
    """Connected components of edges (a long, b long): rows (node, root), root the smallest node, for every node that is not a root itself.

    Alternating large-star and small-star rounds (Kiveris et al., 2014): O(log^2 n) rounds, each two shuffles of the edges, each node's
    neighbourhood only aggregated (never collected) and hot neighbourhoods joined by a skew-splittable join. Every round is written below `path`."""
    spark = edges.sparkSession

    def star(e: DataFrame, large: bool) -> DataFrame:
        big, small = F.greatest("a", "b"), F.least("a", "b")
        if large:
            sym = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        else:
            sym = e.select(big.alias("u"), small.alias("v"))
        m = sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        joined = sym.join(m, "u")
        if large:
            out = joined.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:
            out = joined.filter("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).unionAll(m.select(F.col("u").alias("a"), F.col("m").alias("b")))
        return out.filter("a <> b").distinct()

    def digest(e: DataFrame) -> tuple:
        # decimal keeps the sum of 64-bit hashes exact
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), f"{path}/cc0")
    before = digest(now)
    for k in range(1, max_rounds + 1):
        if not before[0]:
            break
        new = stored(star(star(now, True), False), f"{path}/cc{k}")
        after = digest(new)
        drop_path(spark, f"{path}/cc{k - 1}")
        now = new
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle within {max_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda x, y: x | y, conditions, F.lit(False))
