"""Document quality from a linear-chain conditional random field over lines.

Each line is good or bad. Its features are counts of byte classes, shape and repetition, with those of the lines before and after it. The chain
is trained on labelled documents (lines begin with their document's label; lines of bad documents that the chain finds good are relabelled),
and a document's quality is the length-weighted mean of its lines' marginal probabilities from forward-backward, put on a probability scale
by a logistic fit. Forward-backward runs over all lines of a chunk at once, as segmented prefix products of 2x2 matrices.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillbin.llm._common import binary_list, chunks, fold, table

#: Labelled documents of each class that training takes at most, those with the smallest hashes of their ids.
SAMPLE = 1500
#: Lines of the sample that training takes at most, whole documents.
SAMPLE_LINES = 120_000
FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.3
#: Bytes of text whose line features are held at once (a longer document is a chunk of its own): short lines take some 20 times their text.
FEATURE_BYTES = 1 << 20

_LOWER, _UPPER, _DIGIT, _SPACE, _STOP, _MARK, _PIPE, _BANG, _WIDE, _OTHER = range(10)
CLASSES = np.full(256, _MARK, np.uint8)
CLASSES[ord("a") : ord("z") + 1] = _LOWER
CLASSES[ord("A") : ord("Z") + 1] = _UPPER
CLASSES[ord("0") : ord("9") + 1] = _DIGIT
CLASSES[[9, 11, 12, 13, 32]] = _SPACE
CLASSES[[ord(c) for c in ".,;:'\"?-()"]] = _STOP
CLASSES[ord("|")] = _PIPE
CLASSES[ord("!")] = _BANG
CLASSES[128:] = _WIDE
CLASSES[:9] = CLASSES[14:32] = CLASSES[127] = _OTHER
CLASSES[10] = _OTHER
_OWN = 17


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of every line (n, k), line lengths in bytes, first line of each text and n). Every text has a line at least."""
    data = b"\n".join(texts)
    array = np.frombuffer(data + b"\n", np.uint8)
    ends = np.flatnonzero(array == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    sizes = (ends - starts).astype(np.float64)
    n_lines = np.array([t.count(b"\n") + 1 for t in texts], np.int64)
    first = np.concatenate([[0], np.cumsum(n_lines)])
    cls = CLASSES[array]
    totals = [np.add.reduceat((cls == k).astype(np.int32), starts).astype(np.float64) for k in range(9)]
    inner = (cls[1:] != _SPACE) & (cls[:-1] == _SPACE)
    words = 1 + np.add.reduceat(np.concatenate([[False], inner]).astype(np.int32), starts)
    lines = data.split(b"\n")
    again = np.zeros(len(lines))
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a > 1:
            seen: set[bytes] = set()
            for k in range(a, b):
                if lines[k] in seen and lines[k]:
                    again[k] = 1.0
                seen.add(lines[k])
    unique = np.array([len(set(w)) / len(w) if (w := x.split()) else 1.0 for x in lines])
    some = np.maximum(sizes, 1)
    letters = totals[_LOWER] + totals[_UPPER] + totals[_WIDE] + 1e-9
    last = array[np.maximum(ends - 1, starts)]
    head = array[starts]
    own = np.stack(
        [
            np.ones(len(sizes)), np.minimum(np.log1p(sizes) / 5, 2), totals[_UPPER] / letters, totals[_DIGIT] / some * 3, totals[_MARK] / some * 5, totals[_PIPE] / some * 5, totals[_BANG] / some * 5,
            totals[_STOP] / some * 5, totals[_WIDE] / letters, totals[_SPACE] / some * 3, np.minimum(some / words / 10, 2), again, 1 - unique, (CLASSES[last] == _STOP) * 1.0,
            (CLASSES[head] == _UPPER) * 1.0, (sizes == 0) * 1.0, np.minimum(letters / some, 1.0),
        ],
        1,
    )
    ids = np.repeat(np.arange(len(texts)), n_lines)
    before, after = np.zeros_like(own), np.zeros_like(own)
    joined = ids[1:] == ids[:-1]
    before[1:][joined] = own[:-1][joined]
    after[:-1][joined] = own[1:][joined]
    alone = (n_lines == 1)[ids][:, None] * 1.0
    return np.concatenate([own, before[:, 1:], after[:, 1:], alone], 1), sizes, first


def marginals(score: np.ndarray, trans: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Forward-backward of all chains at once: P(line is good), P(pair of neighbours) summed (2, 2), and the log partition's sum.

    score: (n,) the good label's score against the bad one's; trans: (2, 2) scores of neighbours' labels; first: first line of each chain, and n."""
    n = len(score)
    begins = np.zeros(n, bool)
    begins[first[:-1]] = True
    emit = np.stack([np.zeros(n), score], 1)
    top = emit.max(1)
    e = np.exp(emit - top[:, None])
    step = np.exp(trans - trans.max())
    steps = step[None] * e[:, None, :]
    steps[begins] = np.stack([e[begins], np.zeros_like(e[begins])], 1)  # from the start, by way of row 0
    start = np.maximum.accumulate(np.where(begins, np.arange(n), 0))

    def scan(m: np.ndarray, origin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """m[origin] @ ... @ m[t] for each t, scaled, with the log of the scale."""
        p, q, r, s = (np.ascontiguousarray(m[:, i, j]) for i in (0, 1) for j in (0, 1))
        log, behind = np.zeros(n), np.arange(n) - origin
        d, longest = 1, int(behind.max(initial=0)) + 1
        while d < longest:
            t = np.flatnonzero(behind >= d)
            u = t - d
            p0, q0, r0, s0, p1, q1, r1, s1 = p[u], q[u], r[u], s[u], p[t], q[t], r[t], s[t]
            new = p0 * p1 + q0 * r1, p0 * q1 + q0 * s1, r0 * p1 + s0 * r1, r0 * q1 + s0 * s1
            scale = np.maximum(np.maximum(new[0], new[1]), np.maximum(new[2], new[3]))
            new_log = log[u] + log[t] + np.log(scale)
            p[t], q[t], r[t], s[t] = (x / scale for x in new)
            log[t] = new_log
            d *= 2
        return np.stack([np.stack([p, q], 1), np.stack([r, s], 1)], 1), log

    forward, log = scan(steps, start)
    alpha = forward[:, 0, :]
    ends = first[1:] - 1
    z = float((np.log(alpha[ends].sum(1)) + log[ends]).sum() + top.sum() + (n - (len(first) - 1)) * trans.max())
    # backward: chains reversed, matrices transposed; steps[t] leads from t-1 to t
    shifted = np.zeros_like(steps)
    shifted[:-1] = steps[1:]
    is_end = np.zeros(n, bool)
    is_end[ends] = True
    shifted[is_end] = np.array([[1.0, 0.0], [1.0, 0.0]])
    flipped = np.ascontiguousarray(shifted[::-1].transpose(0, 2, 1))
    flip_begin = np.maximum.accumulate(np.where(is_end[::-1], np.arange(n), 0))
    back, _ = scan(flipped, flip_begin)
    beta = back[::-1][:, 0, :]
    both = alpha * beta
    good = both[:, 1] / both.sum(1)
    inner = np.flatnonzero(~begins)
    pair = alpha[inner - 1][:, :, None] * steps[inner] * beta[inner][:, None, :]
    return good, (pair / pair.sum((1, 2))[:, None, None]).sum(0), z


def train(features: np.ndarray, first: np.ndarray, labels: np.ndarray, rounds: int = 3, steps: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """(weights, transitions) by Adam on the chains' log-likelihood; labels are the documents' (1 good)."""
    docs = np.repeat(np.arange(len(labels)), np.diff(first))
    y = labels[docs].astype(np.float64)
    each = 1.0 / np.sqrt(np.diff(first))[docs]
    w, trans = np.zeros(features.shape[1]), np.zeros((2, 2))
    begins = np.zeros(len(y), bool)
    begins[first[:-1]] = True
    inner = np.flatnonzero(~begins)
    for turn in range(rounds):
        m = [np.zeros_like(w), np.zeros_like(trans)]
        v = [np.zeros_like(w), np.zeros_like(trans)]
        pairs = np.zeros((2, 2))
        np.add.at(pairs, (y[inner - 1].astype(int), y[inner].astype(int)), each[inner])
        for k in range(1, steps + 1):
            good, pair, _ = marginals(features @ w, trans, first)
            scale = pairs.sum() / max(pair.sum(), 1e-9)
            grads = [features.T @ ((y - good) * each) / each.sum() - 1e-4 * w, (pairs - pair * scale) / max(pairs.sum(), 1.0) - 1e-2 * trans]
            for x, g, a, b in zip((w, trans), grads, m, v, strict=True):
                a *= 0.9
                a += 0.1 * g
                b *= 0.99
                b += 0.01 * g * g
                x += 0.15 * (a / (1 - 0.9**k)) / (np.sqrt(b / (1 - 0.99**k)) + 1e-8)
        if turn + 1 < rounds:
            good, _, _ = marginals(features @ w, trans, first)
            new = np.where(labels[docs] == 0, good > 0.9, 1.0).astype(np.float64)
            # a bad document keeps its worst line
            worst = np.minimum.reduceat(good, first[:-1])
            new[(labels[docs] == 0) & (good <= worst[docs])] = 0.0
            y = new
    return w, trans


def summary(good: np.ndarray, sizes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Of each chain: 1 and the log-odds of the length-weighted mean marginal, kept within +-8."""
    weight = sizes + 1.0
    mean = np.add.reduceat(good * weight, first[:-1]) / np.add.reduceat(weight, first[:-1])
    mean = np.clip(mean, 3e-4, 1 - 3e-4)
    return np.stack([np.ones(len(mean)), np.log(mean / (1 - mean))], 1)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 30) -> np.ndarray:
    """Newton's method with a small ridge."""
    b = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        g = x.T @ ((y - p) * weight) - 0.1 * b
        h = (x * (p * (1 - p) * weight)[:, None]).T @ x + 0.1 * np.eye(len(b))
        b = b + np.linalg.solve(h, g)
    return b


class Model:
    def __init__(self, w: np.ndarray, trans: np.ndarray, scale: np.ndarray):
        self.w, self.trans, self.scale = w, trans, scale

    def lines(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        features, sizes, first = line_features(texts)
        good, _, _ = marginals(features @ self.w, self.trans, first)
        return good, sizes, first

    def score(self, texts: list[bytes]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        return 1 / (1 + np.exp(-summary(*self.lines(texts)) @ self.scale))


def fit(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, held_out: int = HELD_OUT, sample: int = SAMPLE, sample_lines: int = SAMPLE_LINES) -> Model:
    """The chain and its scale, from labelled documents outside the held-out fold: at most `sample` of each class and half of `sample_lines` lines.

    Documents enter in the order of a hash of their ids, class by class; one with more lines than are left is passed over, and a class of such alone is
    represented by its shortest document. Of several texts of an id, that of the least hash counts. So the sample does not depend on the order of rows.
    Labels that are null, without id, or of the held-out fold take no part; several labels of an id count as their mean (0.5 and more: good). A class
    without a labelled document leaves the chain untrained: the score is then the labels' share of good (0.5 without labels)."""
    spark = docs.sparkSession
    known = labels.filter("doc_id is not null and quality is not null").filter(fold("doc_id", folds) != held_out)
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.avg("quality") >= 0.5).cast("int").alias("good"))
    share = {r.good: r.n for r in known.groupBy("good").agg(F.count("*").alias("n")).collect()}
    order = F.xxhash64(F.lit(7), "doc_id")
    picked = [r for y in (0, 1) for r in known.filter(F.col("good") == y).orderBy(order, "doc_id").limit(sample).collect()]
    chosen = spark.createDataFrame([(r.doc_id, r.good, k) for k, r in enumerate(picked)], "known_id long, good int, turn int")

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    met = slim.join(F.broadcast(chosen), F.col("doc_id") == F.col("known_id")).withColumn("hash", F.xxhash64("text"))  # 2 * sample rows at most
    sizes_of = met.groupBy("turn").agg(F.min(F.struct("hash", (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).alias("n"))).alias("x"))
    sized = {r.turn: (r.x.hash, r.x.n) for r in sizes_of.collect()}  # a row for each picked label
    wanted: list[tuple[int, int]] = []
    for y in (0, 1):
        own, left, some = [k for k, r in enumerate(picked) if r.good == y and k in sized], sample_lines // 2, []
        for k in own:
            if sized[k][1] <= left:
                some.append(k)
                left -= sized[k][1]
        wanted += [(k, sized[k][0]) for k in some or sorted(own, key=lambda k: (sized[k][1], k))[:1]]
    taken = spark.createDataFrame(wanted, "turn int, hash long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text", FEATURE_BYTES):
                features, sizes, first = line_features(binary_list(part.column("text")))
                cut = [features[a:b].astype(np.float32).tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
                lengths = [sizes[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("turn"), part.column("good"), pa.array(cut, pa.binary()), pa.array(lengths, pa.binary())], ["turn", "good", "x", "sizes"])

    texts = met.join(F.broadcast(taken), ["turn", "hash"]).select("turn", "good", "text").dropDuplicates(["turn"])
    xs, ss, ys = [], [], []
    width = 3 * _OWN - 2 + 1
    for r in sorted(texts.mapInArrow(run, "turn int, good int, x binary, sizes binary").toLocalIterator(), key=lambda r: r.turn):
        xs.append(np.frombuffer(r.x, np.float32).reshape(-1, width))
        ss.append(np.frombuffer(r.sizes))
        ys.append(r.good)
    y = np.array(ys)
    total = share.get(0, 0) + share.get(1, 0)
    if len(set(ys)) < 2:
        p = np.clip(share.get(1, 0) / total if total else 0.5, 0.01, 0.99)
        return Model(np.zeros(width), np.zeros((2, 2)), np.array([np.log(p / (1 - p)), 0.0]))
    features, sizes = np.concatenate(xs).astype(np.float64), np.concatenate(ss)
    first = np.concatenate([[0], np.cumsum([len(x) for x in xs])])
    w, trans = train(features, first, y)
    good, _, _ = marginals(features @ w, trans, first)
    weight = np.where(y == 1, share[1] / total / (y == 1).sum(), share[0] / total / (y == 0).sum()) * len(y)
    return Model(w, trans, logistic(summary(good, sizes, first), y.astype(np.float64), weight))


def quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs.

    Null texts count as empty: one empty line. Repeated rows each give a row; rows without id fall in fold 0 (held out); other columns are ignored."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text", FEATURE_BYTES):
                score = model.value.score(binary_list(part.column("text")))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs, all columns, without the rows whose score is below the threshold."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    typed = docs.withColumn("text", F.col("text").cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text", FEATURE_BYTES):
                yield part.filter(pa.array(model.value.score(binary_list(part.column("text"))) >= threshold))

    return typed.mapInArrow(run, typed.schema)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op7_quality": op7_quality}
ORACLE: dict[str, str] = {}
