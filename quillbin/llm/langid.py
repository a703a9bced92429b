"""Language identification by nearest centroids.

A text is the normalised TF-IDF vector of its hashed byte n-grams (one to three bytes, letters lower-cased, everything else in ASCII a space).
Every language has several centroids, from spherical k-means over a bounded sample of its documents; document frequencies come from all
learning documents. The nearest centroid by cosine names the language, and a text farther from it than its own members ever are is marked.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillbin.llm._common import chunks, fold, table

FOLDS, HELD_OUT = 4, 2
#: Documents of each language that its centroids are fitted on at most, those with the smallest hashes.
SAMPLE = 400
CENTROIDS = 4
#: Languages whose thresholds are broadcast; those of more are joined by a shuffle.
MOST_BROADCAST = 100_000
#: Centroids that a worker holds at once (25 kB each); a text is compared with one block of them after the other.
BLOCK = 4000
DIMS = 256 + 2048 + 4096
#: Texts whose vectors a worker holds at once.
ROWS = 256

_BLANK = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))
_ASCII_LETTER = re.compile(b"[A-Za-z]")


def has_letter(text: bytes) -> bool:
    return bool(_ASCII_LETTER.search(text)) or any(map(str.isalpha, text.decode("utf-8", "ignore")))


def counts_of(texts: list[bytes]) -> np.ndarray:
    """n-gram counts, (texts, DIMS) of float32."""
    out = np.zeros((len(texts), DIMS), np.float32)
    for k, text in enumerate(texts):
        words = text.decode("utf-8", "replace").lower().encode().translate(_BLANK).split()
        if not words:
            continue
        a = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8).astype(np.uint32)
        two = (a[:-1] << np.uint32(8)) | a[1:]
        three = (two[:-1] << np.uint32(8)) | a[2:]
        two = (two * np.uint32(2654435761)) >> np.uint32(21)
        three = (three * np.uint32(2246822519)) >> np.uint32(20)
        out[k] = np.concatenate([np.bincount(a, minlength=256), np.bincount(two, minlength=2048), np.bincount(three, minlength=4096)])
    return out


def vectors(texts: list[bytes], idf: np.ndarray) -> np.ndarray:
    v = np.sqrt(counts_of(texts)) * idf
    norm = np.sqrt((v * v).sum(1, keepdims=True))
    return v / np.where(norm > 0, norm, 1)


def spherical_kmeans(v: np.ndarray, k: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """(centroids, least cosine of their members); begins with the first row and then the rows farthest from those taken."""
    taken = [0]
    near = v @ v[0]
    while len(taken) < min(k, len(v)):
        far = int(near.argmin())
        if near[far] > 1 - 1e-6:
            break
        taken.append(far)
        near = np.maximum(near, v @ v[far])
    c = v[taken].copy()
    for _ in range(rounds):
        own = (v @ c.T).argmax(1)
        for j in range(len(c)):
            if (own == j).any():
                m = v[own == j].sum(0)
                c[j] = m / max(float(np.linalg.norm(m)), 1e-12)
    sims = v @ c.T
    own = sims.argmax(1)
    least = np.array([sims[own == j, j].min() if (own == j).any() else 1.0 for j in range(len(c))])
    return c, least


class Model:
    def __init__(self, idf: np.ndarray, langs: list[str], centroids: np.ndarray, least: np.ndarray):
        self.idf, self.langs, self.centroids, self.least = idf, langs, centroids, least

    def blocks(self) -> list[Model]:
        """The model in parts of at most BLOCK centroids, one without any if there are none."""
        cuts = range(0, max(1, len(self.langs)), BLOCK)
        return [Model(self.idf, self.langs[a : a + BLOCK], self.centroids[a : a + BLOCK], self.least[a : a + BLOCK]) for a in cuts]

    def predict(self, texts: list[bytes | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, cosine, rejected) of each text; `und` without a letter or a language to learn, with cosine -1."""
        langs, score, rejected = ["und"] * len(texts), np.full(len(texts), -1.0), np.ones(len(texts), bool)
        if not self.langs:
            return langs, score, rejected
        for at in range(0, len(texts), ROWS):
            some = [k for k in range(at, min(at + ROWS, len(texts))) if texts[k] and has_letter(texts[k])]
            if not some:
                continue
            sims = vectors([texts[k] for k in some], self.idf) @ self.centroids.T
            best = sims.argmax(1)
            cos = sims[np.arange(len(some)), best]
            for k, b in zip(some, best.tolist(), strict=True):
                langs[k] = self.langs[b]
            score[some] = np.clip(cos, 0, 1)
            rejected[some] = cos < self.least[best]
        return langs, score, rejected


def fit(docs: DataFrame, folds: int = FOLDS, held_out: int = HELD_OUT, sample: int = SAMPLE, centroids: int = CENTROIDS) -> Model:
    """Learns from rows with a text and a language outside the held-out fold. Document frequencies cover all of them; the centroids of a language are fitted
    on `sample` of its distinct pairs of id and text, those with the smallest hashes, however often they come."""
    spark = docs.sparkSession
    learn = docs.filter("lang is not null and text is not null").filter(fold("doc_id", folds) != held_out).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(DIMS + 1, np.int64)
        for batch in batches:
            for part in chunks(batch, "text"):
                texts = part.column("text").cast(pa.binary()).to_pylist()
                df[DIMS] += len(texts)
                for at in range(0, len(texts), ROWS):
                    df[:DIMS] += (counts_of(texts[at : at + ROWS]) > 0).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(DIMS + 1)), pa.array(df)], ["gram", "n"])

    df = np.zeros(DIMS + 1, np.int64)
    for r in learn.select("text").mapInArrow(frequencies, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect():  # DIMS + 1 rows
        df[r.gram] = r.n
    idf = (np.log((1 + df[DIMS]) / (1 + df[:DIMS])) + 1).astype(np.float32)

    # the draw sorts hashes alone; texts follow once it is made. Equal rows are one within a task already, and a task hands on `sample` of a language at most
    hashed = learn.withColumn("order", F.xxhash64(F.lit(11), "doc_id", "text"))
    drawn = hashed.groupBy("lang", "order").agg(F.count("*").alias("n")).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("order"))).filter(F.col("rank") <= sample)
    last = drawn.groupBy("lang").agg(F.max("order").alias("last"), F.max("rank").alias("rank"))
    few = last.limit(MOST_BROADCAST + 1).collect()
    if len(few) <= MOST_BROADCAST:
        last = F.broadcast(spark.createDataFrame(few, "lang string, last long, rank int"))  # a hash for each language
    near = hashed.join(last.select("lang", "last"), "lang").filter(F.col("order") <= F.col("last")).dropDuplicates(["lang", "order"])
    drawn = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("order")))
    given = spark.sparkContext.broadcast(idf)

    def cluster(t: pa.Table) -> pa.Table:
        texts = [x for x in t.sort_by("rank").column("text").cast(pa.binary()).to_pylist() if has_letter(x)]
        if not texts:
            return pa.table({"lang": pa.array([], pa.string()), "centroid": pa.array([], pa.binary()), "least": pa.array([], pa.float64())})
        c, least = spherical_kmeans(np.concatenate([vectors(texts[a : a + ROWS], given.value) for a in range(0, len(texts), ROWS)]), centroids)
        return pa.table({"lang": [t.column("lang")[0].as_py()] * len(c), "centroid": pa.array([x.astype(np.float32).tobytes() for x in c], pa.binary()), "least": pa.array(least.astype(np.float64))})

    rows = drawn.select("lang", "text", "rank").groupBy("lang").applyInArrow(cluster, "lang string, centroid binary, least double").collect()  # CENTROIDS for each language
    rows.sort(key=lambda r: (r.lang, r.centroid))
    held_c = np.stack([np.frombuffer(r.centroid, np.float32) for r in rows]) if rows else np.zeros((0, DIMS), np.float32)
    return Model(idf, [r.lang for r in rows], held_c, np.array([r.least for r in rows]))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score (cosine, 0 to 1), rejected for each row of docs.

    Null texts and texts without a letter are `und` with score 0 (rejected), as are all if nothing could be learned; equal cosines go to the smaller
    language; repeated rows each give a row; rows without id fall in fold 0; other columns are ignored."""
    context = docs.sparkSession.sparkContext
    kinds = "doc_id long, held_out boolean, text string, lang_pred string, score double, rejected boolean"

    def compared(block: Model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        model = context.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in chunks(batch, "text"):
                    langs, score, rejected = model.value.predict(part.column("text").cast(pa.binary()).to_pylist())
                    before = np.asarray(part.column("score"))
                    better = score > before
                    langs = [a if x else b for a, b, x in zip(langs, part.column("lang_pred").to_pylist(), better.tolist(), strict=True)]
                    rejected = np.where(better, rejected, part.column("rejected").to_numpy(zero_copy_only=False))
                    yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "held_out", "text")), pa.array(langs, pa.string()), pa.array(np.where(better, score, before)), pa.array(rejected)], ["doc_id", "held_out", "text", "lang_pred", "score", "rejected"])

        return run

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), F.col("text").cast("string").alias("text"))
    out = slim.withColumns({"lang_pred": F.lit("und"), "score": F.lit(-1.0), "rejected": F.lit(True)})
    for block in fit(docs).blocks():
        out = out.mapInArrow(compared(block), kinds)
    return out.select("doc_id", "held_out", "lang_pred", F.greatest("score", F.lit(0.0)).alias("score"), "rejected")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


QUERIES = {"op9_language": op9_language}
ORACLE: dict[str, str] = {}
