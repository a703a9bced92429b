"""Metadata queries over metrics: rows (name, tags)."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillbin.functions.tags import Rule, canonical_name, is_storable, parse_tags
from quillbin.plans.selector import Selector, parse


def normalise(metrics: DataFrame, metric: str = "metric", rules: Sequence[Rule] = ()) -> DataFrame:
    """Adds tags and name to rows with a metric text; rows whose metric has no tag or over 255 are dropped."""
    tagged = metrics.withColumn("tags", parse_tags(metric, rules)).filter(is_storable("tags"))
    return tagged.withColumn("name", canonical_name("tags"))


def dimension(metrics: DataFrame, metric: str = "metric", rules: Sequence[Rule] = ()) -> DataFrame:
    """One row (name, tags) for each metric. Each distinct text is parsed once."""
    return normalise(metrics.select(metric).distinct(), metric, rules).select("name", "tags").dropDuplicates(["name"])


def add(index: DataFrame, metrics: DataFrame, metric: str = "metric", rules: Sequence[Rule] = ()) -> DataFrame:
    """(name, tags, is_new) of the metrics: whether the index lacks them."""
    known = index.select("name", F.lit(True).alias("known"))
    return dimension(metrics, metric, rules).join(known, "name", "left").select("name", "tags", F.col("known").isNull().alias("is_new"))


def _each(metrics: DataFrame) -> DataFrame:
    return metrics.select("name", F.inline("tags"))


def tag_keys(metrics: DataFrame) -> DataFrame:
    return metrics.select(F.explode("tags.k").alias("key")).distinct()


def tag_values(metrics: DataFrame, key: str) -> DataFrame:
    return _each(metrics).filter(F.col("k") == key).select(F.col("v").alias("value")).distinct()


def tags(metrics: DataFrame) -> DataFrame:
    return metrics.select(F.explode("tags.tag").alias("tag")).distinct()


def cardinality(metrics: DataFrame) -> DataFrame:
    return metrics.agg(F.count("*").alias("metrics"))


def low_cardinality_tags(metrics: DataFrame, under: int) -> DataFrame:
    """Tags that at most `under` metrics carry."""
    return _each(metrics).groupBy("tag").agg(F.count("*").alias("metrics")).filter(F.col("metrics") <= under)


def high_cardinality_tag_keys(metrics: DataFrame, over: int) -> DataFrame:
    """Keys with `over` distinct tags or more."""
    return _each(metrics).select("k", "tag").distinct().groupBy(F.col("k").alias("key")).agg(F.count("*").alias("tags")).filter(F.col("tags") >= over)


def select(metrics: DataFrame, selector: str | Selector) -> DataFrame:
    """The metrics of a selection: a filter on their own tags, without join or shuffle."""
    return metrics.filter((parse(selector) if isinstance(selector, str) else selector).column())


def with_all_keys(metrics: DataFrame, *keys: str) -> DataFrame:
    found = F.lit(True)
    for k in keys or ("",):
        found = found & F.array_contains(F.col("tags")["k"], k)
    return metrics.filter(found)


def where_value(metrics: DataFrame, key: str, test: Callable[[Column], Column] | None) -> DataFrame:
    """Metrics with a value of key that the test holds for; without a test, all with the key."""
    return metrics.filter(F.exists("tags", lambda t: (t["k"] == key) & (test(t["v"]) if test else F.lit(True))))


def where_not_value(metrics: DataFrame, key: str, test: Callable[[Column], Column]) -> DataFrame:
    """Metrics with a value of key that the test does not hold for."""
    return metrics.filter(F.exists("tags", lambda t: (t["k"] == key) & ~test(t["v"])))


def lookup(metrics: DataFrame, name: str) -> DataFrame:
    return metrics.filter(F.col("name") == name)


def name_hash(name: str | Column) -> Column:
    """A surrogate key of a metric, for rows that should not carry its name."""
    return F.sha2(F.col(name) if isinstance(name, str) else name, 256)


def by_hash(metrics: DataFrame, hashes: DataFrame, column: str = "hash") -> DataFrame:
    """(hash, name, tags) of the metrics with one of the hashes: a join by the surrogate key, each hash looked up once."""
    wanted = hashes.select(F.col(column).alias("hash")).distinct()
    return metrics.select(name_hash("name").alias("hash"), "name", "tags").join(wanted, "hash", "left_semi")


def iterate(metrics: DataFrame, each: Callable[[str], bool]) -> bool:
    """Calls each(name) until it returns False; whether it never did. Rows stream to the driver a partition at a time."""
    rows: Iterator = metrics.select("name").toLocalIterator()
    return all(each(r.name) for r in rows)
