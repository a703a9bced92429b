import random

import pytest
from pyspark.sql import functions as F

from quillbin.operators import histogram as H
from quillbin.sources.store import Level, Store, check_levels, compaction_suffix, merged_scan, metric_lines
from quillbin.streaming import ingest


def observations(spark, metrics, n=10):
    return spark.createDataFrame([(m, float(i)) for m in metrics for i in range(n)], "metric string, value float")


def test_names_and_levels():
    for low, high in ((0, 1), (0xFFFFFFFF, 0), (17, 4096)):
        assert Level.of_folder(Level(low, high).folder) == Level(low, high)
    assert check_levels([Level(4, 5), Level(0, 4)]) == [Level(0, 4), Level(4, 5)]
    for bad in ([Level(1, 2)], [Level(0, 1), Level(2, 3)], [Level(0, 0)]):
        with pytest.raises(ValueError):
            check_levels(bad)


def test_compaction_is_a_binary_counter():
    levels, shapes = [], []
    for g in range(16):
        levels.append(Level(g, g + 1))
        if suffix := compaction_suffix(levels):
            levels = levels[: len(levels) - len(suffix)] + [Level(suffix[0].low, suffix[-1].high)]
        shapes.append([x.high - x.low for x in levels])
        check_levels(levels)
    assert shapes[3] == [4] and shapes[4] == [4, 1] and shapes[6] == [4, 2, 1] and shapes[15] == [16]


def test_lifecycle(spark, tmp_path):
    rng = random.Random(0)
    metrics = [",".join(f"{rng.choice('abcd')}{rng.choice('xyz')}={rng.randint(0, 9)}" for _ in range(4)) + f",zzz={i}" for i in range(60)]
    store = Store(spark, str(tmp_path / "s"))
    assert store.query_metrics("{zzz|}").count() == 0
    for i in range(3):
        store.flush(observations(spark, metrics[i * 20 : i * 20 + 20]), i + 1, 1)
        before = sorted(map(tuple, H.unpack(store.rows(), ["name", "ts", "dur"]).collect()))
        store.compact()
        assert sorted(map(tuple, H.unpack(store.rows(), ["name", "ts", "dur"]).collect())) == before
    again = Store(spark, store.root)
    assert again.levels() == [Level(0, 2), Level(2, 3)]
    totals = H.total(again.query_histograms("{zzz|}"), ["name"]).collect()
    assert len(totals) == 60 and {r.total for r in totals} == {10}
    plain = [m for m in metrics if len({t.partition("=")[0] for t in m.split(",")}) == 5][-1]
    assert H.total(again.query_histograms(plain), ["name"]).first().total == 10
    assert again.query_data("{zzz|}", after=3).count() == 20 and again.query_data("{zzz|}", after=4).count() == 0
    seen = []
    assert not again.for_each("{zzz|}", 2, lambda name, ts, dur, hist: seen.append((name, ts)) or len(seen) < 5)
    assert seen == sorted(seen)
    assert again.metrics().count() == 60


def test_texts_of_one_metric_are_added(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.flush(observations(spark, ["a=1,b=2", "b=2,a=1", "", ","]), 7, 1)
    rows = store.rows().collect()
    assert [r.name for r in rows] == ["a=1,b=2"] and sum(h.cnt for h in rows[0].hist) == 20 and [h.bucket for h in rows[0].hist] == sorted({h.bucket for h in rows[0].hist})


def test_unknown_tag_in_the_compatible_reading(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.flush(observations(spark, ["a=1", "a=2"]), 1, 1)
    store.flush(observations(spark, ["a=3"]), 2, 1)
    names = lambda **k: {r.name for r in store.query_metrics("a != 1", **k).collect()}
    assert names() == {"a=2", "a=3"} and names(reference_compat=True) == {"a=2"}


def test_batches_flush_once_and_writers_collide(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    assert store.flush(observations(spark, ["a=1"]), 1, 1, batch="x/0") and store.flush(observations(spark, ["a=1"]), 1, 1, batch="x/0") is None
    version, content = store._manifest()
    store.flush(observations(spark, ["a=1"]), 2, 1)
    with pytest.raises(RuntimeError):
        store._publish(version, content)


def test_merged_scan_keeps_equal_rows(spark):
    scans = [spark.createDataFrame([(c, 0, 0) for c in s], "name string, ts long, dur long") for s in ("ace", "drsu", "", "059qz", "5atu")]
    assert "".join(r.name for r in merged_scan(*scans).collect()) == "0559aacdeqrstuuz"


def test_lines(spark, tmp_path):
    import gzip

    with gzip.open(tmp_path / "m.gz", "wt") as f:
        f.write("a=1\nb=2\n")
    assert metric_lines(spark, str(tmp_path)).count() == 2


def test_stream(spark, tmp_path):
    observations(spark, ["a=1", "b=1"]).coalesce(1).write.parquet(str(tmp_path / "in"))
    store = Store(spark, str(tmp_path / "s"))
    for _ in range(2):
        stream = spark.readStream.schema("metric string, value float").parquet(str(tmp_path / "in"))
        ingest.flush_stream(stream, store, str(tmp_path / "c"), lambda b: (b, 1), name="t").awaitTermination()
    assert {(r.name, r.total) for r in H.total(store.query_histograms("{a|} | {b|}"), ["name"]).collect()} == {("a=1", 10), ("b=1", 10)}


def test_windows_over_a_stream(spark, tmp_path):
    rows = spark.createDataFrame([(f"2024-01-01 00:{m:02d}:00", "a=1", 1.0) for m in range(20)], "at string, metric string, value float").withColumn("at", F.to_timestamp("at"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = ingest.windowed(stream, "at", "10 minutes", "1 minute").writeStream.outputMode("complete").format("memory").queryName("w").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.cnt for r in spark.table("w").collect()) == [10, 10]


def test_scans_outlive_compaction_until_vacuum(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    for i in range(2):
        store.flush(observations(spark, [f"a={i}"]), i + 1, 1)
    scan = store.query_data("{a|}")
    store.compact()
    assert scan.count() == 2 and store.vacuum(older_than=3600) == 0 and scan.count() == 2
    assert store.vacuum(older_than=0) == 4 and store.query_data("{a|}").count() == 2  # two segments, two manifests


def test_segments_before_a_scan_are_not_read(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    for i in range(3):
        store.flush(observations(spark, [f"a={i}"]), 10 * i, 1)
    assert len(store.query_data("{a|}", after=10).inputFiles()) < len(store.query_data("{a|}").inputFiles())
    assert {r.ts for r in store.query_data("{a|}", after=10).collect()} == {10, 20}
    assert store.query_data("{a|}", after=21).count() == 0


def test_late_rows_over_several_batches_and_a_restart(spark, tmp_path):
    at = lambda m, v: (f"2024-01-01 {m // 60:02d}:{m % 60:02d}:00", "a=1", v)
    batches = [[at(1, 1.0), at(12, 1.0)], [at(45, 1.0)], [at(2, 1.0), at(44, 1.0)], [at(90, 1.0)]]
    path = lambda x: str(tmp_path / x)
    schema = "at timestamp, metric string, value float"

    def more(some):
        for b in some:
            spark.createDataFrame(b, "at string, metric string, value float").withColumn("at", F.to_timestamp("at")).coalesce(1).write.mode("append").parquet(path("in"))
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path("in"))
        out = ingest.windowed(stream, "at", "10 minutes", "5 minutes")
        out.writeStream.outputMode("append").format("parquet").option("path", path("out")).option("checkpointLocation", path("c")).trigger(availableNow=True).start().awaitTermination()
        return {(str(r.start)[11:16], r.cnt) for r in spark.read.parquet(path("out")).collect()}

    assert more(batches[:2]) == {("00:00", 1), ("00:10", 1)}
    # minute 2 comes after its window is final; minute 44 is in time
    assert more(batches[2:]) == {("00:00", 1), ("00:10", 1), ("00:40", 2)}
