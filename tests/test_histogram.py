import numpy as np
import pytest
from pyspark.sql import functions as F

from quillbin.functions.buckets import bucket_of, low_of, mid_of
from quillbin.operators import histogram as H


def bits(v):
    u = np.asarray(v, np.float32).view(np.uint32)
    return ((u ^ np.where(u >> 31, np.uint32(0xFFFFFFFF), np.uint32(0x80000000))) >> 16).astype(np.int64)


def test_buckets_are_the_upper_bits(spark):
    rng = np.random.default_rng(0)
    raw = np.concatenate([rng.integers(0, 2**32, 20_000, dtype=np.uint64).astype(np.uint32), (np.arange(65536, dtype=np.uint32) << 16), (np.arange(65536, dtype=np.uint32) << 16) + 0xFFFF])
    v = raw.view(np.float32)
    v = v[np.isfinite(v)]
    rows = spark.createDataFrame([(float(x),) for x in v], "v double").select("v", bucket_of(F.col("v").cast("float")).alias("b")).toPandas()
    assert (rows.b.to_numpy() == bits(rows.v.to_numpy())).all()


def test_edges_and_middles(spark):
    rows = spark.range(0, 65536).select(F.col("id").cast("int").alias("b")).select("b", low_of("b").alias("low"), mid_of("b").alias("mid")).toPandas()
    finite = rows[(rows.b > 127) & (rows.b < 65408)]  # the others hold infinities and NaN
    u = finite.b.to_numpy().astype(np.uint32)
    raw = np.where(u >= 32768, (u << 16) ^ np.uint32(0x80000000), (u << 16) ^ np.uint32(0xFFFFFFFF))
    low = np.where(u >= 32768, raw, raw).astype(np.uint32).view(np.float32).astype(np.float64)
    assert np.array_equal(finite.low.to_numpy(), low)
    assert (finite.mid > finite.low).all() and (bits(finite.mid.to_numpy()) == finite.b).all()


@pytest.fixture(scope="module")
def thousand(spark):
    return H.observe(spark.range(1000).select(F.lit("m").alias("name"), F.col("id").cast("float").alias("value")), ["name"]).cache()


def test_golden(thousand):
    assert H.total(thousand, ["name"]).first().total == 1000
    m = H.min_max(thousand, ["name"]).first()
    assert (m.min, m.max) == (0.0, 998.0)
    q = {r.q: r.value for r in H.quantile(thousand, ["name"], [0, 0.25, 0.5, 1, 2]).collect()}
    assert q == {0.0: 0.0, 0.25: 250.0, 0.5: 500.0, 1.0: 998.0, 2.0: 998.0}
    with pytest.raises(ValueError):
        H.quantile(thousand, ["name"], -0.1)
    d = H.distribution(thousand, ["name"]).orderBy("value").collect()
    assert d[-1].cumulative == d[-1].total == 1000
    c = {r.at: r.cdf for r in H.cdf(thousand, ["name"], [-1.0, 500.0, 5000.0]).collect()}
    assert c[-1.0] == 0 and c[5000.0] == 1 and abs(c[500.0] - 0.5) < 0.01


def test_summary(spark, thousand):
    s = H.summary(thousand, ["name"]).first()
    assert s["count"] == 1000 and abs(s.avg - 499.5) < 2 and abs(s.variance - 83416) < 900
    one = H.observe(spark.createDataFrame([("a", 3.0)], "name string, value float"), ["name"])
    r = H.summary(one, ["name"]).first()
    assert (r["count"], r["sum"], r.avg, r.variance) == (1, r["sum"], r["sum"], 0.0)


def test_uncounted_values(spark):
    rows = spark.createDataFrame([("a", x) for x in (float("nan"), float("inf"), float("-inf"), None, 0.0, -0.0)], "name string, value float")
    got = {r.bucket: r.cnt for r in H.observe(rows, ["name"]).collect()}
    assert got == {32768: 1, 32767: 1}


def test_empty(spark):
    empty = H.observe(spark.createDataFrame([], "name string, value float"), ["name"])
    assert H.total(empty, ["name"]).count() == 0
    m = H.min_max(empty, []).first()
    assert np.isnan(m.min) and np.isnan(m.max)
    assert np.isnan(H.cdf(empty, [], 1.0).first().cdf)
    assert H.reset(H.observe(spark.createDataFrame([("a", 1.0)], "name string, value float"), ["name"])).count() == 0


def test_merge_equal_pack(spark, thousand):
    twice = H.merge(thousand, thousand, keys=["name"])
    assert H.total(twice, ["name"]).first().total == 2000
    assert not H.equal(thousand, twice, ["name"]).first().equal and H.equal(thousand, thousand, ["name"]).first().equal
    packed = H.pack(thousand, ["name"])
    assert H.equal(H.unpack(packed, ["name"]), thousand, ["name"]).first().equal
    both = packed.select("name", H.merge_packed(F.col("hist"), F.col("hist")).alias("hist"))
    assert H.equal(H.unpack(both, ["name"]), twice, ["name"]).first().equal
    assert H.count_histograms(thousand, ["name"]).first().histograms == 1


def test_describe_agrees_with_its_parts(thousand):
    r = H.describe(thousand, ["name"], {"p50": 0.5, "p100": 1.0}).first()
    assert (r.total, r.p50, r.p100) == (1000, 500.0, 998.0) and r.avg == pytest.approx(H.summary(thousand, ["name"]).first().avg)
