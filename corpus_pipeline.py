"""A corpus pipeline of five stages: quality, near copies, benchmark passages, mixture, token files.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next stage's docs. All but
the last return the columns of documents. When a stage begins, the output of the one before is written, and what that one has kept in the
scratch space is deleted.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from quillbin.llm import _common, crf, decontaminate, mixing, pfor, simhash
from quillbin.llm._common import drop_scratch, scratch, stored, table

#: Scratch folders of the stage that ran last.
_left: list[str] = []


def _stage(work: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    @wraps(work)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        drop_scratch(spark, _left)
        before = set(_common.MADE)
        out = work(spark, docs, sf_dir)
        _left[:] = [p for p in _common.MADE if p not in before]
        return out

    return run


@_stage
def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without the rows whose quality score is below 0.3. Null texts are scored as empty ones; without labels of both classes all rows have one
    score, the labels' share of good. Repeated rows stay or go together; all columns are kept."""
    return crf.keep_good(docs, table(spark, sf_dir, "labels"))


@_stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with one row of each group of near copies (five-word shingles, similarity 0.8), that of the smallest doc_id. Null texts are one text;
    texts without words are alike; of repeated rows one stays; a group without ids keeps a row. All columns are kept."""
    return simhash.deduplicate(docs)


@_stage
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without the rows in which a window of eight words of a benchmark item (or a whole shorter item) occurs. Null and empty texts stay, as do all
    rows where the benchmark is empty. Repeated rows stay or go together; all columns are kept."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


@_stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs' rows, all columns, each 0 to 2 times, so that every source comes near its target share. Null sources are one source, null texts have no words;
    repeated rows are rows of their own."""
    return mixing.mix(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each row, read back from the token files that it writes. Null texts are the end id alone; rows without id
    come first; repeated rows are all written; an empty table gives no row. The files stay until the driver ends."""
    drop_scratch(spark, _left)
    _left.clear()
    return pfor.token_output(docs)


STAGES = [
    ("quality", drop_low_quality),
    ("near_dedup", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("mix", mix_sources),
    ("tokens", write_tokens),
]

#: Models and token files are beyond SQL; the tests compare every stage with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = table(spark, sf_dir, "documents"), scratch(spark)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, f"{path}/{k}-{name}")
    return docs
