"""Histograms in long form: a row (keys..., bucket, cnt) for each bucket that holds anything.

`keys` are the columns that name a histogram. Every operator is a group-by or a window over one shuffle by the keys; counts are combined within a
task before they travel, so a metric with a third of all observations sends at most 65 536 rows from each task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillbin.functions.buckets import bucket_of, is_counted, low_of, mid_of

Keys = Sequence[str]
NAN = float("nan")
PACKED = "array<struct<bucket:int,cnt:bigint>>"


def observe(observations: DataFrame, keys: Keys, value: str = "value") -> DataFrame:
    """Counts observations by bucket. NaN, infinities and nulls are left out."""
    counted = observations.filter(is_counted(value)).select(*keys, bucket_of(value).alias("bucket"))
    return counted.groupBy(*keys, "bucket").agg(F.count("*").alias("cnt"))


def merge(*histograms: DataFrame, keys: Keys) -> DataFrame:
    """The bucket-wise sum of histograms, by the keys: also over fewer keys than they came with."""
    parts = [h.select(*keys, "bucket", "cnt") for h in histograms]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.groupBy(*keys, "bucket").agg(F.sum("cnt").alias("cnt"))


def reset(histogram: DataFrame) -> DataFrame:
    """No counts."""
    return histogram.filter(F.lit(False))


def total(histogram: DataFrame, keys: Keys) -> DataFrame:
    return histogram.groupBy(*keys).agg(F.sum("cnt").alias("total"))


def min_max(histogram: DataFrame, keys: Keys) -> DataFrame:
    """min: the lowest bucket's lower edge; max: the highest bucket's middle. Without keys, NaN if nothing is counted."""
    held = histogram.filter("cnt > 0").groupBy(*keys).agg(F.min("bucket").alias("lo"), F.max("bucket").alias("hi"))
    return held.select(*keys, F.coalesce(low_of("lo"), F.lit(NAN)).alias("min"), F.coalesce(mid_of("hi"), F.lit(NAN)).alias("max"))


def _cumulated(histogram: DataFrame, keys: Keys) -> DataFrame:
    own = Window.partitionBy(*keys)
    so_far = own.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return histogram.filter("cnt > 0").withColumns({"cumulative": F.sum("cnt").over(so_far), "total": F.sum("cnt").over(own)})


def quantile(histogram: DataFrame, keys: Keys, q: float | Sequence[float]) -> DataFrame:
    """A row (keys..., q, value) for each q >= 0: the lower edge of the first bucket whose cumulative count exceeds floor(q * total + 0.5), else the maximum."""
    qs = [float(x) for x in ([q] if isinstance(q, int | float) else q)]
    if any(not x >= 0 for x in qs):
        raise ValueError("quantiles are 0 or more")
    seen = _cumulated(histogram, keys)
    goal = lambda x: F.floor(F.lit(x) * F.col("total") + 0.5)
    first = [F.min(F.when(F.col("cumulative") > goal(x), F.col("bucket"))).alias(f"b{i}") for i, x in enumerate(qs)]
    each = seen.groupBy(*keys).agg(F.max("bucket").alias("hi"), *first)
    rows = F.array(*(F.struct(F.lit(x).alias("q"), F.coalesce(low_of(f"b{i}"), mid_of("hi")).alias("value")) for i, x in enumerate(qs)))
    return each.select(*keys, F.inline(rows))


def cdf(histogram: DataFrame, keys: Keys, values: float | Sequence[float]) -> DataFrame:
    """A row (keys..., at, cdf) for each value: the share of counts in lower buckets, with half (rounded down) of the value's own bucket."""
    vs = [float(x) for x in ([values] if isinstance(values, int | float) else values)]
    own = [bucket_of(F.lit(v).cast("float")) for v in vs]
    below = [F.sum(F.when(F.col("bucket") < b, F.col("cnt")).otherwise(0)).alias(f"lo{i}") for i, b in enumerate(own)]
    at = [F.sum(F.when(F.col("bucket") == b, F.col("cnt")).otherwise(0)).alias(f"at{i}") for i, b in enumerate(own)]
    each = histogram.groupBy(*keys).agg(F.sum("cnt").alias("total"), *below, *at)
    share = lambda i: F.coalesce(F.try_divide(F.col(f"lo{i}") + F.floor(F.col(f"at{i}") / 2), F.col("total")), F.lit(NAN))
    return each.select(*keys, F.inline(F.array(*(F.struct(F.lit(v).alias("at"), share(i).alias("cdf")) for i, v in enumerate(vs)))))


def summary(histogram: DataFrame, keys: Keys) -> DataFrame:
    """count, sum, avg and sample variance, each bucket's counts at its middle. One count has variance 0; no counts give zeros (without keys)."""
    own = Window.partitionBy(*keys)
    held = histogram.filter("cnt > 0").withColumn("mid", mid_of("bucket"))
    held = held.withColumns({"n": F.sum("cnt").over(own), "s": F.sum(F.col("cnt") * F.col("mid")).over(own)})
    off = F.col("mid") - F.col("s") / F.col("n")
    each = held.groupBy(*keys).agg(F.first("n").alias("n"), F.first("s").alias("s"), F.sum(F.col("cnt") * off * off).alias("sq"))
    variance = F.when(F.col("n") > 1, F.col("sq") / (F.col("n") - 1)).otherwise(0.0)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return each.select(*keys, F.coalesce("n", F.lit(0)).alias("count"), zero(F.col("s")).alias("sum"), zero(F.try_divide("s", "n")).alias("avg"), zero(variance).alias("variance"))


def describe(histogram: DataFrame, keys: Keys, quantiles: dict[str, float]) -> DataFrame:
    """total, avg and the named quantiles of each histogram together: one shuffle by the keys for all of them."""
    seen = _cumulated(histogram, keys).withColumn("mid", mid_of("bucket"))
    first = [F.min(F.when(F.col("cumulative") > F.floor(F.lit(float(q)) * F.col("total") + 0.5), F.col("bucket"))).alias(name) for name, q in quantiles.items()]
    each = seen.groupBy(*keys).agg(F.first("total").alias("total"), F.sum(F.col("cnt") * F.col("mid")).alias("sum"), F.max("bucket").alias("hi"), *first)
    values = [F.coalesce(low_of(name), mid_of("hi")).alias(name) for name in quantiles]
    return each.select(*keys, "total", (F.col("sum") / F.col("total")).alias("avg"), *values)


def distribution(histogram: DataFrame, keys: Keys) -> DataFrame:
    """(keys..., value, cumulative, total) for each bucket, the value its middle."""
    return _cumulated(histogram, keys).select(*keys, mid_of("bucket").alias("value"), "cumulative", "total")


def equal(left: DataFrame, right: DataFrame, keys: Keys) -> DataFrame:
    """(keys..., equal) for every histogram of either side: whether all counts agree."""
    both = left.filter("cnt > 0").select(*keys, "bucket", F.col("cnt").alias("a"), F.lit(0).cast("long").alias("b"))
    both = both.unionByName(right.filter("cnt > 0").select(*keys, "bucket", F.lit(0).cast("long").alias("a"), F.col("cnt").alias("b")))
    sums = both.groupBy(*keys, "bucket").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    return sums.groupBy(*keys).agg(F.bool_and(F.col("a") == F.col("b")).alias("equal"))


def count_histograms(histogram: DataFrame, keys: Keys) -> DataFrame:
    return histogram.select(*keys).distinct().agg(F.count("*").alias("histograms"))


def pack(histogram: DataFrame, keys: Keys, column: str = "hist") -> DataFrame:
    """One row for each histogram, its buckets in ascending order in an array (65 536 at most)."""
    packed = F.array_sort(F.collect_list(F.struct(F.col("bucket").cast("int").alias("bucket"), F.col("cnt").cast("long").alias("cnt"))))
    return histogram.filter("cnt > 0").groupBy(*keys).agg(packed.alias(column))


def unpack(packed: DataFrame, keys: Keys, column: str = "hist") -> DataFrame:
    """The long form. Rows of the same keys stay apart until they are merged, which adds them up."""
    return packed.select(*keys, F.inline(column))


def merge_packed(a: Column, b: Column) -> Column:
    """The bucket-wise sum of two packed histograms within a row."""
    buckets = F.array_sort(F.array_distinct(F.concat(a["bucket"], b["bucket"])))
    of = lambda h, k: F.coalesce(F.aggregate(F.filter(h, lambda x: x["bucket"] == k), F.lit(0).cast("long"), lambda s, x: s + x["cnt"]), F.lit(0).cast("long"))
    return F.transform(buckets, lambda k: F.struct(k.alias("bucket"), (of(a, k) + of(b, k)).alias("cnt")))
