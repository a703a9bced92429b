"""Immutable time-labelled segments of histograms, as Parquet below a manifest.

A segment covers a range of generations [low, high) and holds a row (name, tags, ts, dur, hist) for each metric and flush, sorted by name and time.
Tags and histogram lie in columns of their own, so one table is index and data at once: listing metrics reads no histogram, and a selection
is a filter on the rows' own tags. Readers see the segments of the newest manifest only. A manifest's file is created exclusively, so of two writers one
fails; it knows each segment's range of ts, and scans skip the segments before theirs. Compaction leaves replaced segments where they are, for readers
that have begun, until vacuum deletes them.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillbin.functions.tags import TAGS_TYPE, Rule
from quillbin.functions.values import get_hex
from quillbin.operators import histogram, index
from quillbin.plans.selector import Selector, parse

SCHEMA = f"name string, tags {TAGS_TYPE}, ts bigint, dur bigint, hist {histogram.PACKED}"


@dataclass(frozen=True)
class Level:
    low: int
    high: int

    @property
    def folder(self) -> str:
        return f"{self.low:08X}-{self.high:08X}"

    @staticmethod
    def of_folder(name: str) -> Level:
        low, _, high = name.partition("-")
        if len(low) != 8 or len(high) != 8:
            raise ValueError(f"not a segment's folder: {name!r}")
        return Level(int(low, 16), int(high, 16))


def depth(low: int, high: int) -> int:
    return (high - low).bit_length()


def check_levels(levels: Iterable[Level]) -> list[Level]:
    """Levels in order; they begin at 0 and leave no gap."""
    out, at = sorted(levels, key=lambda x: x.low), 0
    for level in out:
        if level.low >= level.high:
            raise ValueError(f"empty segment {level}")
        if level.low != at:
            raise ValueError(f"segments do not join at {at}: {level}")
        at = level.high
    return out


def compaction_suffix(levels: Sequence[Level]) -> list[Level]:
    """The last segments that one segment should replace: as a binary counter carries; fewer than two mean none."""
    first = len(levels) - 1
    while first > 0 and depth(levels[first - 1].low, levels[-1].high) != depth(levels[first - 1].low, levels[first - 1].high):
        first -= 1
    return list(levels[first:]) if len(levels) - max(first, 0) >= 2 else []


class Store:
    def __init__(self, spark: SparkSession, root: str, rules: Sequence[Rule] = ()):
        self.spark, self.root, self.rules = spark, root.rstrip("/"), tuple(rules)
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.root}/manifest"))
        self.levels()

    # ------------------------------------------------------------ manifest

    def _versions(self) -> list[str]:
        found = self._fs.listStatus(self._path(f"{self.root}/manifest"))
        return sorted(f.getPath().getName() for f in found if f.getPath().getName().startswith("v"))

    def _manifest(self) -> tuple[int, dict]:
        """The newest manifest; one that is still being written is passed over."""
        names = self._versions()
        for name in reversed(names):
            stream = self._fs.open(self._path(f"{self.root}/manifest/{name}"))
            try:
                text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
            if text.endswith("}"):
                return int(name[1:]), json.loads(text)
        return 0, {"levels": [], "batches": [], "streams": {}}

    def _publish(self, version: int, content: dict) -> None:
        """Creates the next manifest; an error if another writer has been faster."""
        target = self._path(f"{self.root}/manifest/v{version + 1:012d}")
        text, taken = bytearray(json.dumps(content).encode()), RuntimeError("the store has changed meanwhile")
        if self._fs.getUri().getScheme() == "file":
            # a link appears whole or, where the name exists, not at all
            draft = self._path(f"{self.root}/manifest/.{uuid.uuid4().hex}")
            self._write_bytes(draft, text)
            try:
                os.link(draft.toUri().getPath(), target.toUri().getPath())
            except FileExistsError:
                raise taken from None
            finally:
                self._fs.delete(draft, False)
            return
        try:
            self._write_bytes(target, text)
        except Py4JJavaError:
            raise taken from None

    def _write_bytes(self, path, data: bytearray) -> None:
        stream = self._fs.create(path, False)  # never over an existing file
        stream.write(data)
        stream.close()

    def vacuum(self, older_than: float = 86_400.0) -> int:
        """Deletes segments and manifests that the newest manifest has replaced and that are older than so many seconds; how many. A scan that began
        before must have ended."""
        now, (version, content) = time.time(), self._manifest()
        held, gone = {x["folder"] for x in content["levels"]}, 0
        old = lambda f: f.getModificationTime() / 1000 <= now - older_than
        data = self._path(f"{self.root}/data")
        for f in self._fs.listStatus(data) if self._fs.exists(data) else ():
            if f.getPath().getName() not in held and old(f):
                gone += bool(self._fs.delete(f.getPath(), True))
        for f in self._fs.listStatus(self._path(f"{self.root}/manifest")):
            name = f.getPath().getName()
            if name.startswith("v") and int(name[1:]) < version and old(f):
                gone += bool(self._fs.delete(f.getPath(), False))
        return gone

    def levels(self) -> list[Level]:
        return check_levels(Level.of_folder(x["folder"].split(".")[0]) for x in self._manifest()[1]["levels"])

    # ------------------------------------------------------------ writing

    def _write(self, rows: DataFrame, folder: str) -> None:
        ordered = rows.repartitionByRange("name", "ts").sortWithinPartitions("name", "ts", "dur")
        ordered.write.mode("overwrite").parquet(f"{self.root}/data/{folder}")

    @contextmanager
    def _parts(self, rows: DataFrame, part: str) -> Iterator[dict[int, str]]:
        """Rows written into a folder for each value of the column `part`, in one job: value -> folder, to be moved to its place; what is not goes in the end."""
        staging = self._path(f"{self.root}/data/.parts.{uuid.uuid4().hex}")
        # by range: a segment is cut only where it is large, and a task has few segments
        ordered = rows.repartitionByRange(part, "name", "ts").sortWithinPartitions(part, "name", "ts", "dur")
        try:
            ordered.write.partitionBy(part).parquet(staging.toString())
            found = (f.getPath() for f in self._fs.listStatus(staging) if f.isDirectory())
            yield {int(p.getName().partition("=")[2]): p.toString() for p in found}
        finally:
            self._fs.delete(staging, True)

    def _place(self, source: str | None, level: Level) -> str:
        """Moves a written folder, or a new one without rows, to where a segment's folder is; its name."""
        folder = f"{level.folder}.{uuid.uuid4().hex[:8]}"
        target = self._path(f"{self.root}/data/{folder}")
        if not (self._fs.rename(self._path(source), target) if source else self._fs.mkdirs(target)):
            raise RuntimeError(f"cannot create {target.toString()}")
        return folder

    def _counted(self, observations: DataFrame, metric: str, value: str, by: Sequence[str] = ()) -> DataFrame:
        """(name, by..., tags, hist) of observations, which are read once. Texts that name the same metric are added up."""
        keys = ["name", *by]
        counts = histogram.pack(histogram.observe(observations, [metric, *by], value), [metric, *by])
        named = index.normalise(counts, metric, self.rules).select(*keys, "tags", "hist")
        each = named.groupBy(*keys).agg(F.first("tags").alias("tags"), F.collect_list("hist").alias("parts"))
        # a single text's histogram stays packed; the buckets of several are added within the same partition
        single, none = F.size("parts") == 1, F.array().cast(histogram.PACKED)
        spread = each.select(*keys, "tags", F.when(single, F.col("parts")[0]).alias("whole"), F.inline_outer(F.when(single, none).otherwise(F.flatten("parts"))))
        summed = spread.groupBy(*keys, "bucket").agg(F.first("tags").alias("tags"), F.first("whole").alias("whole"), F.sum("cnt").alias("cnt"))
        added = F.array_sort(F.collect_list(F.struct("bucket", "cnt")))
        return summed.groupBy(*keys).agg(F.first("tags").alias("tags"), F.coalesce(F.first("whole"), added).alias("hist"))

    def flush(self, observations: DataFrame, ts: int, dur: int, metric: str = "metric", value: str = "value", batch: str | None = None) -> Level | None:
        """Counts observations and writes them as a new segment labelled (ts, dur). Metrics that cannot be stored are left out.

        batch: a name under which this flush takes place once; a second time nothing is written (None). Of names that end in / and a number, the numbers
        ascend, and only the last one is kept."""
        version, content = self._manifest()
        stream, _, number = (batch or "").rpartition("/")
        if batch is not None and (batch in content["batches"] or number.isdigit() and content["streams"].get(stream, -1) >= int(number)):
            return None
        counted = self._counted(observations, metric, value)
        rows = counted.select("name", "tags", F.lit(ts).cast("long").alias("ts"), F.lit(dur).cast("long").alias("dur"), "hist")
        high = max((x["high"] for x in content["levels"]), default=0)
        level = Level(high, high + 1)
        folder = f"{level.folder}.{uuid.uuid4().hex[:8]}"
        self._write(rows, folder)
        content["levels"].append({"folder": folder, "low": level.low, "high": level.high, "first": ts, "last": ts})
        if batch is not None:
            if number.isdigit():
                content["streams"][stream] = int(number)
            else:
                content["batches"].append(batch)
        self._publish(version, content)
        return level

    def flush_each(self, observations: DataFrame, label: str, dur: int, metric: str = "metric", value: str = "value") -> list[Level]:
        """A flush for each value of the whole-number column `label`, its ts, in ascending order, with empty segments for values between that do not come.
        The observations are read once and all segments written by one job. Rows without a label are left out."""
        version, content = self._manifest()
        counted = self._counted(observations.filter(F.col(label).isNotNull()), metric, value, [label])
        rows = counted.select("name", "tags", F.col(label).cast("long").alias("ts"), F.lit(dur).cast("long").alias("dur"), "hist", F.col(label).cast("long").alias("part"))
        high, out = max((x["high"] for x in content["levels"]), default=0), []
        with self._parts(rows, "part") as written:
            for ts in range(min(written), max(written) + 1) if written else ():
                level = Level(high + len(out), high + len(out) + 1)
                content["levels"].append({"folder": self._place(written.get(ts), level), "low": level.low, "high": level.high, "first": ts, "last": ts})
                out.append(level)
        if out:
            self._publish(version, content)
        return out

    def compact_each(self) -> list[Level]:
        """Rewrites segments as if a compaction had followed each one's flush: what the binary counter leaves in the end is written at once, by one job, each
        row once."""
        version, content = self._manifest()
        known, runs = sorted(content["levels"], key=lambda x: x["low"]), []
        for x in known:
            runs.append([x])
            suffix = compaction_suffix([Level(r[0]["low"], r[-1]["high"]) for r in runs])
            if suffix:
                runs[-len(suffix) :] = [[y for r in runs[-len(suffix) :] for y in r]]
        merged = [r for r in runs if len(r) > 1]
        if not merged:
            return []
        part = F.coalesce(*(F.when(F.col("low").between(r[0]["low"], r[-1]["low"]), r[0]["low"]) for r in merged))  # a term for each bit of the counter
        rows = self._read([x for r in merged for x in r]).withColumn("part", part).drop("low")
        out, content["levels"] = [], []
        with self._parts(rows, "part") as written:
            for r in runs:
                if len(r) > 1:
                    level = Level(r[0]["low"], r[-1]["high"])
                    folder = self._place(written.get(level.low), level)
                    r = [{"folder": folder, "low": level.low, "high": level.high, "first": min(x["first"] for x in r), "last": max(x["last"] for x in r)}]
                    out.append(level)
                content["levels"] += r
        self._publish(version, content)
        return out

    def compact(self) -> Level | None:
        """Rewrites the suffix of segments that a binary counter would carry as one. Rows are kept as they are, equal ones too."""
        version, content = self._manifest()
        known = sorted(content["levels"], key=lambda x: x["low"])
        suffix = compaction_suffix([Level(x["low"], x["high"]) for x in known])
        if not suffix:
            return None
        old = known[len(known) - len(suffix) :]
        level = Level(suffix[0].low, suffix[-1].high)
        folder = f"{level.folder}.{uuid.uuid4().hex[:8]}"
        self._write(self._read(old).drop("low"), folder)
        whole = {"folder": folder, "low": level.low, "high": level.high, "first": min(x["first"] for x in old), "last": max(x["last"] for x in old)}
        content["levels"] = known[: len(known) - len(suffix)] + [whole]
        self._publish(version, content)
        return level

    # ------------------------------------------------------------ reading

    def _read(self, levels: list[dict]) -> DataFrame:
        if not levels:
            return self.spark.createDataFrame([], SCHEMA).withColumn("low", F.lit(0))
        read = self.spark.read.schema(SCHEMA).parquet(*(f"{self.root}/data/{x['folder']}" for x in levels))
        folder = F.regexp_extract("_metadata.file_path", r"/data/([0-9A-F]{8})-[0-9A-F]{8}\.[0-9a-f]{8}/[^/]*$", 1)
        return read.withColumn("low", get_hex(folder).cast("int"))

    def rows(self, after: int | None = None) -> DataFrame:
        """All rows (name, tags, ts, dur, hist, low) of the newest manifest's segments; of those that reach `after`, if it is given."""
        levels = self._manifest()[1]["levels"]
        return self._read([x for x in levels if after is None or x["last"] >= after])

    def _selected(self, selector: str | Selector, reference_compat: bool, after: int | None = None) -> DataFrame:
        chosen = parse(selector) if isinstance(selector, str) else selector
        rows = self.rows(after)
        if not reference_compat or not chosen.unequal_tags():
            return rows.filter(chosen.column())
        # the compatible `!=` finds nothing in a segment that does not know the tag
        known = {}
        for tag in set(chosen.unequal_tags()):
            held = rows.filter(F.array_contains(F.col("tags")["tag"], tag)).select("low").distinct().collect()  # a row for each segment
            known[tag] = F.col("low").isin([r.low for r in held])
        return rows.filter(chosen.column(known=known.__getitem__))

    def query_metrics(self, selector: str | Selector, reference_compat: bool = False) -> DataFrame:
        """Names of the metrics selected."""
        return self._selected(selector, reference_compat).select("name").distinct()

    def query_data(self, selector: str | Selector, after: int = 0, reference_compat: bool = False) -> DataFrame:
        """Rows (name, ts, dur, hist, low) of the metrics selected with ts >= after, in no order; merged_scan and for_each put them in order."""
        return self._selected(selector, reference_compat, after).filter(F.col("ts") >= after).select("name", "ts", "dur", "hist", "low")

    def query_histograms(self, selector: str | Selector, after: int = 0, reference_compat: bool = False) -> DataFrame:
        """query_data in long form: (name, ts, dur, low, bucket, cnt)."""
        return histogram.unpack(self.query_data(selector, after, reference_compat), ["name", "ts", "dur", "low"])

    def for_each(self, selector: str | Selector, after: int, each: Callable[..., bool]) -> bool:
        """Calls each(name, ts, dur, hist) in order of name and time until it returns False; whether it never did."""
        rows = self.query_data(selector, after).orderBy("name", "ts", "dur", "low").toLocalIterator()
        return all(each(r.name, r.ts, r.dur, r.hist) for r in rows)

    def metrics(self) -> DataFrame:
        """The dimension (name, tags) of all segments."""
        return self.rows().select("name", "tags").dropDuplicates(["name"])


def merged_scan(*scans: DataFrame) -> DataFrame:
    """Rows of several scans as one, in order of (name, ts, dur), equal ones kept, ties in the order of the scans."""
    out = None
    for k, scan in enumerate(scans):
        part = scan.withColumn("scan", F.lit(k))
        out = part if out is None else out.unionByName(part)
    return out.orderBy("name", "ts", "dur", "scan")


def metric_lines(spark: SparkSession, path: str) -> DataFrame:
    """Metric texts, one on each line of (gzipped) text files."""
    return spark.read.text(path).select(F.col("value").alias("metric"))
