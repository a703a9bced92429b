from quillbin.sources.store import Level, Store

SCHEMA = "metric string, value float, at int"
ROWS = [("a=1,b=2", 1.0, 3), ("b=2,a=1", 1.0, 3), ("b=2,a=1", 5.0, 3), ("c=1", 2.0, 3), ("c=1", 2.0, 4), ("a=1,b=2", float("nan"), 5), ("", 1.0, 6), ("c=1", -1.0, 7), ("c=1", 9.0, None), ("c=1", 4.0, 9)]


def content(store):
    return sorted((r.low, r.name, sorted(t.tag for t in r.tags), r.ts, r.dur, [tuple(h) for h in r.hist]) for r in store.rows().collect())


def test_all_flushes_at_once_are_as_one_after_another(spark, tmp_path):
    rows = spark.createDataFrame(ROWS, SCHEMA)
    one, all_ = Store(spark, str(tmp_path / "one")), Store(spark, str(tmp_path / "all"))
    for ts in range(3, 10):
        one.flush(rows.filter(rows.at == ts), ts, 1)
    assert all_.flush_each(rows, "at", 1) == all_.levels() == one.levels() == [Level(k, k + 1) for k in range(7)]
    assert content(all_) == content(one) and len(content(one)) == 5
    assert [(x["first"], x["last"]) for x in all_._manifest()[1]["levels"]] == [(ts, ts) for ts in range(3, 10)]
    assert all_.query_data("{c|}", after=8).count() == 1
    # what is written is in its place, and nothing else
    assert len(list((tmp_path / "all" / "data").iterdir())) == 7
    assert all_.flush_each(rows.filter("at IS NULL"), "at", 1) == [] and len(all_.levels()) == 7


def test_all_compactions_at_once_are_as_one_after_another(spark, tmp_path):
    rows = spark.createDataFrame(ROWS, SCHEMA)
    one, all_ = Store(spark, str(tmp_path / "one")), Store(spark, str(tmp_path / "all"))
    for ts in range(3, 10):
        one.flush(rows.filter(rows.at == ts), ts, 1)
        one.compact()
    all_.flush_each(rows, "at", 1)
    before, scan = content(all_), all_.query_data("{c|}")
    assert all_.compact_each() == [Level(0, 4), Level(4, 6)]
    assert all_.levels() == one.levels() == [Level(0, 4), Level(4, 6), Level(6, 7)] and content(all_) == content(one)
    assert sorted(r[1:] for r in content(all_)) == sorted(r[1:] for r in before)
    assert scan.count() == 4 and all_.compact_each() == []
    assert all_.vacuum(older_than=0) == 7 and all_.query_data("{c|}", after=9).count() == 1  # six segments and a manifest
    all_.flush(rows.filter("at = 9"), 10, 1)
    all_.compact()
    assert all_.levels() == [Level(0, 8)]
