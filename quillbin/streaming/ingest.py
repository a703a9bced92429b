"""Streaming ingest of observations (metric, value)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillbin.sources.store import Store


def flush_stream(observations: DataFrame, store: Store, checkpoint: str, label: Callable[[int], tuple[int, int]], name: str = "ingest", **trigger) -> StreamingQuery:
    """Flushes every micro-batch as a segment labelled label(batch id) = (ts, dur), once even if the batch is run again, and compacts after it.

    An observation goes into the segment of the batch that it arrives in: there is no late data."""

    def write(batch: DataFrame, batch_id: int) -> None:
        ts, dur = label(batch_id)
        if store.flush(batch, ts, dur, batch=f"{name}/{batch_id}") is not None:
            store.compact()

    return observations.writeStream.queryName(name).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def windowed(observations: DataFrame, time: str, duration: str, late: str, keys: list[str] | None = None, value: str = "value") -> DataFrame:
    """Event-time histograms: (start, keys..., bucket, cnt) of each window, final once the watermark (`late`) has passed its end."""
    keys = keys or ["metric"]
    from quillbin.functions.buckets import bucket_of, is_counted

    counted = observations.withWatermark(time, late).filter(is_counted(value))
    return counted.groupBy(F.window(time, duration), *keys, bucket_of(value).alias("bucket")).agg(F.count("*").alias("cnt")).select(F.col("window.start").alias("start"), *keys, "bucket", "cnt")


