import corpus_pipeline as cp

from quillbin.llm import crf, simhash


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(cp.STAGES):
        before, out = docs, stage(spark, docs, sf)
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert docs.columns == columns
        if name == "quality":
            good = crf.quality(before, spark.read.parquet(f"{sf}/labels.parquet")).filter("predicted = 1")
            assert {r.doc_id for r in docs.collect()} == {r.doc_id for r in good.collect()}
        if name == "near_dedup":
            left = {r.doc_id: set(simhash.shingle_hashes(r.text.encode(), 5).tolist()) for r in docs.collect()}
            for r in before.collect():
                if r.doc_id not in left:
                    own = set(simhash.shingle_hashes(r.text.encode(), 5).tolist())
                    assert any(len(own & x) >= 0.5 * len(own | x) for x in left.values())
        if name == "decontaminate":
            items = [r.text.lower().split() for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            windows = {" ".join(w[i : i + 8]) for w in items for i in range(len(w) - 7)}
            assert not [r.doc_id for r in docs.collect() if any(w in " ".join(r.text.lower().split()) for w in windows)]
        if name == "mix":
            assert docs.count() > before.count()
        if name == "tokens":
            rows = docs.orderBy("start").collect()
            assert len(rows) == before.count() and all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:], strict=False))
            assert [r.doc_id for r in rows] == sorted(r.doc_id for r in rows)


def test_run(spark, sf):
    assert cp.run(spark, sf).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
