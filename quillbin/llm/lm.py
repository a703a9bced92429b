"""Language-model scoring by logistic context mixing of bit predictors.

A text is a sequence of tokens (lower-cased words, then an end), and a token a sequence of binary decisions, each predicted by several predictors over
hashed contexts whose stretched probabilities are summed with weights that gates choose, and refined by an adaptive probability map:

* Do the words come that the words before announce? At content-defined places, one in EVERY, the last CONTEXT words are a context, and the words up to the
  next such place its continuation. The continuation that most often followed the context in training texts either comes, as a whole, or not. Contexts and
  continuations are counted over the whole corpus and joined to the texts by their hashes, so they grow with the corpus and lie on no single machine.
  Predictors know how often and how purely the continuation came, its size, and its first word; a training text's own occurrence is left out.
* Otherwise, is a word one of the commonest, and which? The bits of their code are predicted by the counts at the nodes of its tree, over all tokens, after
  the word before, after the two words before, and after the second one before. Pairs of these states choose the weights.
* If it is none of them, its bytes are spelled, bit by bit, from the one to four bytes before, the whole of the word so far, and the counts of all training words.

Weights are trained over all training tokens: of spelling and continuations online, in every task on its own part, and averaged; of the common words' bits
on the counts of each combination of the predictors' states, added up over the corpus, so that they do not depend on how it is cut. The trained state is then frozen, so documents can be
scored anywhere in any order and reruns agree. Beside it stands an add-one unigram model over exact counts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from copy import copy
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillbin.llm._common import LOWER, binary_list, chunks, drop_path, fold, lean, scratch, stored, sweep, table

FOLDS, HELD_OUT = 7, 2
#: The end of a text as a token; no word can hold it.
END = b"\n"
#: Commonest words, which have codes of their own and whose counts every task holds; the others are joined. RARE stands for the number of any other.
HEAVY = RARE = 200_000
#: Words of a context; one place in EVERY has one, by its hash; words of a continuation at most.
CONTEXT, EVERY, LONGEST = 3, 10, 31
#: Bits of the largest tables of slots for contexts of one to ORDERS bytes and of the whole word so far; smaller corpora have smaller ones.
MOST_SLOTS = (16, 20, 21, 22, 22)
ORDERS = len(MOST_SLOTS) - 1
#: Distinct words that a task counts before it hands them on; bytes of text whose tokens it holds at once.
COUNTED, PIECE = 200_000, 2 << 20
#: Slots that travel together when tasks' counts are added up.
CHUNK = 1 << 15
#: Contexts of a common word's bits, as distances of the words before; bits of the largest table of slots of each; tokens whose bits are held at once.
BEFORE = ((1,), (1, 2), (2,))
WORD_SLOTS, BITS = 22, 4096
#: Confidence levels of a predictor; as many again for contexts that have only ever had one outcome.
LEVELS = 12


def tokens_of(text: bytes) -> list[bytes]:
    return text.translate(LOWER).split()


def squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


# ---------------------------------------------------------------- spelling


def widths_for(distinct: int) -> tuple[int, ...]:
    """Bits of each table of slots for so many distinct words."""
    need = int(np.ceil(np.log2(max(2, distinct) * 64)))
    return (16, *(min(most, max(16, need)) for most in MOST_SLOTS[1:]))


def expand(words: list[bytes], widths: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Every bit of every word and its terminator: (slot of each predictor (predictors, n), bit, node of the byte's bit tree, word's number)."""
    starts = np.concatenate([[0], np.cumsum([1 << b for b in widths])])
    tails = [w if w == END else w + b"\x20" for w in words]
    sizes = np.fromiter(map(len, tails), np.int64, len(tails))
    data = np.frombuffer(b"".join(tails), np.uint8).astype(np.uint64)
    n = len(data)
    word = np.repeat(np.arange(len(tails)), sizes)
    begin = np.repeat(np.cumsum(sizes) - sizes, sizes)
    place = np.arange(n) - begin
    shifted = [np.where(place >= k, np.concatenate([np.zeros(k, np.uint64), data[: n - k]])[:n], np.uint64(0)) if n else data for k in range(1, ORDERS + 1)]
    mult = np.uint64(0x9E3779B97F4A7C15)
    contexts, h = [], np.zeros(n, np.uint64)
    for k in range(ORDERS):
        h = (h ^ (shifted[k] + np.uint64(k + 1))) * mult
        h ^= h >> np.uint64(29)
        contexts.append(h)
    contexts.append(_prefix_hashes(data, place))
    bits = np.unpackbits(data.astype(np.uint8)[:, None], axis=1)
    nodes = np.ones((n, 8), np.int64)
    for j in range(1, 8):
        nodes[:, j] = 2 * nodes[:, j - 1] + bits[:, j - 1]
    slots = np.empty((len(widths), n * 8), np.int64)
    spread = nodes.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for k, (c, width) in enumerate(zip(contexts, widths, strict=True)):
        if k == 0:
            slot = (shifted[0].astype(np.int64)[:, None] << 8) | nodes
        else:
            slot = (((c[:, None] + spread) * mult) >> np.uint64(64 - width)).view(np.int64)
        slots[k] = (slot + starts[k]).reshape(-1)
    return slots, bits.reshape(-1), nodes.reshape(-1), np.repeat(word, 8)


def _prefix_hashes(data: np.ndarray, place: np.ndarray) -> np.ndarray:
    """A hash of each token's bytes before each place: sums of the bytes' hashes with their places, which prefix sums give."""
    mult = np.uint64(0xC2B2AE3D27D4EB4F)
    x = (data + np.uint64(1)) * mult + place.astype(np.uint64) * np.uint64(0x165667B19E3779F9)
    x ^= x >> np.uint64(31)
    x *= mult
    x ^= x >> np.uint64(27)
    run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)])
    at = np.arange(len(data))
    h = (run[at] - run[at - place]) + place.astype(np.uint64)
    h = (h ^ (h >> np.uint64(33))) * mult
    return h ^ (h >> np.uint64(29))


def state_of(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Counts of zeros and ones as one number of 16 bits; where either exceeds 255, both are scaled down."""
    top = np.maximum(np.maximum(zeros, ones), 255).astype(np.float64)
    small = lambda x: np.minimum(np.ceil(x * (255 / top)), 255).astype(np.uint16)
    return small(zeros) << np.uint16(8) | small(ones)


_Z, _O = np.divmod(np.arange(1 << 16), 256)
SCALED = (_Z == 255) | (_O == 255)
#: Of each state: its stretched probability of a one, and its confidence level.
STRETCH = np.where(_Z + _O > 0, np.log((_O + 0.05) / (_Z + 0.05)), 0.0).astype(np.float32)
LEVEL = (np.minimum(np.log2(_Z + _O + 1).astype(np.int64), LEVELS - 1)).astype(np.int16)


class Speller:
    """States of slots, gated weights, and an adaptive probability map."""

    KNOTS = 25
    #: By the confidence of the whole-word predictor: which of GATES sets of weights is in force.
    GATES = 7
    GATE_OF = np.array([0, 1, 2, 3, 3, 4, 4, 5, 5, 6, 6, 6], np.int16)
    #: Of each state, the first of its level's gates; contexts with one outcome have levels of their own.
    GATE = ((LEVEL + LEVELS * ((_Z == 0) | (_O == 0))) * GATES).astype(np.int16)

    def __init__(self, states: np.ndarray, widths: tuple[int, ...]):
        self.states, self.widths = states, widths
        self.weights = np.full((len(widths), 2 * LEVELS * self.GATES), 0.25)
        self.bias = np.zeros(256)
        self.map = np.tile(squash(np.linspace(-8, 8, self.KNOTS)), (256, 1))

    def inputs(self, slots: np.ndarray, own: np.ndarray | None = None, single: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(stretched probabilities, gates) of every predictor. own: the bits, left out of the counts; single: whether the bit's word came but
        once, for only then do the predictors over distinct words lose it."""
        s = self.states[slots]
        if own is not None:
            one = np.where(own == 1, np.uint16(1), np.uint16(256))
            held = np.where(own == 1, s & np.uint16(255), s >> np.uint16(8)) > 0
            held[:ORDERS] &= single
            held &= ~SCALED[s]  # one of many
            s = s - np.where(held, one, np.uint16(0))
        return STRETCH[s], self.GATE[s] + self.GATE_OF[LEVEL[s[ORDERS]]]

    def mixed(self, stretched: np.ndarray, gate: np.ndarray, node: np.ndarray) -> np.ndarray:
        x = self.bias[node]
        for p in range(len(stretched)):
            x += self.weights[p][gate[p]] * stretched[p]
        return x

    def refined(self, x: np.ndarray, node: np.ndarray) -> np.ndarray:
        """Probability of a one: half the mixer's, half the map's."""
        at = (np.clip(x, -7.999, 7.999) + 8) * ((self.KNOTS - 1) / 16)
        low = at.astype(np.int64)
        at -= low
        low += node * self.KNOTS
        flat = self.map.ravel()
        m = flat[low]
        m += (flat[low + 1] - m) * at
        return np.clip((squash(x) + m) / 2, 1e-6, 1 - 1e-6)

    def train(self, words: list[bytes], single: np.ndarray, batch: int = 200, rate: float = 0.1) -> None:
        """Online: batch after batch is predicted, the map takes a step to what came, then each weight one against the coding cost, by its curvature."""
        curve, bias_curve = np.zeros_like(self.weights), np.zeros(256)
        for a in range(0, len(words), batch):
            slots, bit, node, word = expand(words[a : a + batch], self.widths)
            s, gate = self.inputs(slots, bit, single[a : a + batch][word])
            x = self.mixed(s, gate, node)
            near = np.rint((np.clip(x, -7.999, 7.999) + 8) / 16 * (self.KNOTS - 1)).astype(np.int64)
            key = node * self.KNOTS + near
            n = np.bincount(key, minlength=256 * self.KNOTS)
            mean = np.bincount(key, bit, 256 * self.KNOTS) / np.maximum(n, 1)
            self.map += 0.1 * (n / (n + 40)).reshape(256, -1) * (mean.reshape(256, -1) - self.map)
            q = squash(x)
            error, bend, keep = bit - q, q * (1 - q), 0.1 if a else 1.0
            for p in range(len(s)):
                curve[p] += keep * (np.bincount(gate[p], bend * s[p] * s[p], self.weights.shape[1]) - curve[p])
                self.weights[p] += rate * np.bincount(gate[p], error * s[p], self.weights.shape[1]) / (curve[p] + 5)
            bias_curve += keep * (np.bincount(node, bend, 256) - bias_curve)
            self.bias += 0.2 * rate * np.bincount(node, error, 256) / (bias_curve + 5)

    def trained(self) -> np.ndarray:
        return np.concatenate([self.weights.ravel(), self.bias, self.map.ravel()])

    def take(self, values: np.ndarray) -> None:
        a, b = self.weights.size, self.weights.size + 256
        self.weights, self.bias, self.map = values[:a].reshape(self.weights.shape), values[a:b], values[b:].reshape(self.map.shape)

    def cost(self, words: list[bytes]) -> np.ndarray:
        """log10 probability of each word."""
        out = np.zeros(len(words))
        for a in range(0, len(words), 500):
            slots, bit, node, word = expand(words[a : a + 500], self.widths)
            p = self.refined(self.mixed(*self.inputs(slots), node), node)
            out[a : a + 500] = np.bincount(word, np.log10(np.where(bit == 1, p, 1 - p)), len(words[a : a + 500]))
        return out


def word_counts(docs: DataFrame, path: str) -> DataFrame:
    """(word binary, n long) of every word of docs (held_out, text) and of the texts' ends; n counts the training texts' alone and may be 0. All are
    counted within a task before they travel."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

        lean()
        counts: Counter = Counter()
        for batch in batches:
            for part in chunks(batch, "text", PIECE):
                for text, held in zip(binary_list(part.column("text")), part.column("held_out").to_pylist(), strict=True):
                    if held:
                        counts.update(dict.fromkeys(tokens_of(text), 0))
                        counts[END] += 0
                    else:
                        counts.update(tokens_of(text))
                        counts[END] += 1
                if len(counts) > COUNTED:
                    yield out()
                    counts.clear()
        if counts:
            yield out()
            counts.clear()
        lean()

    slim = docs.select("held_out", "text")
    return stored(slim.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), f"{path}/counts")


def slot_states(counts: DataFrame, widths: tuple[int, ...]) -> np.ndarray:
    """The state of every slot over all training words: the predictors over bytes count distinct words, that over the whole word so far tokens."""

    def fill(seen: np.ndarray, batch: pa.RecordBatch) -> None:
        words, n = batch.column("word").to_pylist(), batch.column("n").to_numpy()
        for a in range(0, len(words), 4000):
            slots, bit, _, word = expand(words[a : a + 4000], widths)
            times = np.minimum(n[a : a + 4000], 1 << 20).astype(np.int32)  # a state holds far fewer
            for b in (0, 1):
                use = bit == b
                for k, row in enumerate(slots):
                    np.add.at(seen[b], row[use], times[word[use]] if k == ORDERS else np.int32(1))

    return states_of(counts.filter("n > 0"), sum(1 << b for b in widths), fill)


def states_of(rows: DataFrame, total: int, fill: Callable[[np.ndarray, pa.RecordBatch], None]) -> np.ndarray:
    """The states of so many slots, whose zeros and ones (2, slots) fill adds up for a batch of rows."""
    cells = -(-total // CHUNK) * CHUNK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        seen = np.zeros((2, cells), np.int32)
        some = False
        for batch in batches:
            if batch.num_rows:
                fill(seen, batch)
                some = True
        if some:
            for k in range(cells // CHUNK):
                part = seen[:, k * CHUNK : (k + 1) * CHUNK]
                if part.any():
                    yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([TaskContext.get().partitionId() // 32]), pa.array([_packed(part)], pa.binary())], ["chunk", "part", "data"])

    def add(t: pa.Table) -> np.ndarray:
        out = np.zeros(2 * CHUNK, np.int64)
        for x in t.column("data"):
            out += _opened(x.as_py(), np.int32)
        return np.minimum(out, 2**30)

    def some_of(t: pa.Table) -> pa.Table:
        return pa.table({"chunk": [t.column("chunk")[0].as_py()], "part": [t.column("part")[0].as_py()], "data": pa.array([_packed(add(t).astype(np.int32))], pa.binary())})

    def all_of(t: pa.Table) -> pa.Table:
        out = add(t).reshape(2, -1)
        return pa.table({"chunk": [t.column("chunk")[0].as_py()], "data": pa.array([state_of(out[0], out[1]).tobytes()], pa.binary())})

    kind = "chunk long, part long, data binary"
    sums = rows.mapInArrow(run, kind).groupBy("chunk", "part").applyInArrow(some_of, kind).groupBy("chunk").applyInArrow(all_of, "chunk long, data binary")
    states = np.zeros(cells, np.uint16)
    for r in sums.toLocalIterator():  # one row for each chunk of the slots, whose number MOST_SLOTS bounds
        states[r.chunk * CHUNK : (r.chunk + 1) * CHUNK] = np.frombuffer(r.data, np.uint16)
    return states[:total]


def _packed(x: np.ndarray) -> bytes:
    """Counts, most of them small: all first bytes, all second ones and so on."""
    raw = np.ascontiguousarray(x).reshape(-1, 1).view(np.uint8).T.tobytes()
    return len(raw).to_bytes(4, "little") + pa.compress(raw, "zstd", asbytes=True)


def _opened(data: bytes, kind: type) -> np.ndarray:
    raw = pa.decompress(data[4:], int.from_bytes(data[:4], "little"), "zstd")
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def averaged(rows: list) -> np.ndarray | None:
    """The mean of the tasks' trained values, by what they have trained on (rows: values, n)."""
    total = sum(r.n for r in rows)
    return sum(np.frombuffer(r.values) * (r.n / total) for r in rows) if total else None


def fit_speller(counts: DataFrame, distinct: int, spelled: Column) -> Speller:
    """counts: word, n of all words. Every task trains on its words in their order, the result is the tasks' mean: on all training words that are spelled, and
    those that came but once, as new ones."""
    widths = widths_for(distinct)
    speller = Speller(slot_states(counts, widths), widths)
    given = counts.sparkSession.sparkContext.broadcast(speller)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        own, done = Speller(given.value.states, widths), 0
        for batch in batches:
            words = batch.column("word").to_pylist()
            own.train(words, batch.column("n").to_numpy() == 1)
            done += len(words)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([own.trained().tobytes()], pa.binary()), pa.array([done])], ["values", "n"])

    rare = counts.filter((F.col("n") == 1) | (spelled & (F.col("n") > 0)))
    values = averaged(rare.mapInArrow(run, "values binary, n long").collect())  # a row of fixed size for each task
    given.destroy()
    if values is not None:
        speller.take(values)
    return speller


# ---------------------------------------------------------------- expected words


class Lexicon:
    """The commonest words: number, hash, log10(count + 1), and log10 of the share of all tokens; and log10 of the share of all others."""

    def __init__(self, words: list[tuple[bytes, int]], total: int):
        self.numbers = {w: k for k, (w, _) in enumerate(words)}
        n = np.array([c for _, c in words], np.float64)
        blank = RARE + 1 - len(words)
        self.hashes = np.concatenate([np.array([xxhash.xxh64_intdigest(w) for w, _ in words], np.uint64), np.zeros(blank, np.uint64)])
        self.counted = np.concatenate([np.log10(n + 1), np.zeros(blank)])
        self.share = np.concatenate([np.log10(np.maximum(n, 1) / (total + 1)), np.zeros(blank)])
        self.others = float(np.log10((total - n.sum() + 1) / (total + 1)))
        self.own = np.append(self.share[:RARE], self.others)  # of each number, RARE included


class Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        return RARE


class Passages(NamedTuple):
    """Tokens of several texts, end to end, and where contexts are."""

    numbers: np.ndarray  # of each token
    rare: np.ndarray  # positions of the tokens that have none
    words: list  # of those, the words
    begin: np.ndarray  # first token of each text, and their number
    keys: np.ndarray  # hash of the context before each continuation
    start: np.ndarray  # its first token
    size: np.ndarray  # its tokens
    codes: np.ndarray  # 43 bits of its hash, its size (5), the kind of its first word (3), and that word, hashed (12)


def numbered(texts: list[bytes], numbers: Numbers, ends: bytes = END) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """Numbers of the texts' tokens, those tokens that have none, and the first token of each text, and their number."""
    words: list[bytes] = []
    begin = [0]
    for text in texts:
        words += tokens_of(text)
        words.append(ends)
        begin.append(len(words))
    ids = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
    return ids, [words[i] for i in np.flatnonzero(ids == RARE).tolist()], np.array(begin, np.int64)


def passages(texts: list[bytes], lexicon: Lexicon, numbers: Numbers, ends: bytes = END) -> Passages:
    return passages_of(*numbered(texts, numbers, ends), lexicon)


def passages_of(ids: np.ndarray, rare_words: list[bytes], first: np.ndarray, lexicon: Lexicon) -> Passages:
    rare = np.flatnonzero(ids == RARE)
    h = lexicon.hashes[ids]
    h[rare] = np.fromiter(map(xxhash.xxh64_intdigest, rare_words), np.uint64, len(rare_words))
    place = np.arange(len(ids)) - np.repeat(first[:-1], np.diff(first))
    key = np.zeros(len(ids), np.uint64)
    for k in range(1, CONTEXT + 1):
        key[k:] = (key[k:] ^ h[:-k]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    start = np.flatnonzero((place >= CONTEXT) & (key % np.uint64(EVERY) == 0))
    text_of = np.searchsorted(first, start, "right")
    stop = np.minimum(np.minimum(np.append(start[1:], len(ids)), first[text_of]), start + LONGEST)
    run = np.concatenate([np.zeros(1, np.uint64), np.cumsum((h * np.uint64(0xC2B2AE3D27D4EB4F)) * powers(len(h)), dtype=np.uint64)])
    size = stop - start
    whole = (run[stop] - run[start]) * powers(len(h), inverse=True)[start]  # a polynomial in the words' hashes
    whole = (whole ^ (whole >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    word = ids[start]
    kind = np.where(word == RARE, 6, np.searchsorted([1, 64, 1024, 8192, 32768], word, "right"))
    feature = (size << 15) | (kind << 12) | (word * 2654435761 >> 7 & 4095)
    codes = ((whole >> np.uint64(21)) << np.uint64(20)).view(np.int64) | feature
    return Passages(ids, rare, rare_words, first, key[start].view(np.int64), start, size, codes)


_BASE = 0xD1342543DE82EF95
_POWERS: dict[bool, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """The first n powers of an odd number modulo 2^64, or of its inverse."""
    held = _POWERS.get(inverse)
    if held is None or len(held) < n:
        base = pow(_BASE, -1, 1 << 64) if inverse else _BASE
        held = np.ones(max(n, 1 << 16), np.uint64)
        held[1:] = np.uint64(base)
        _POWERS[inverse] = held = np.multiply.accumulate(held)
    return held[:n]


#: A decision's features in one number: the continuation's size (5 bits), the kind of its first word (3), that word, hashed (12), how often it came (3), and
#: its share among the context's (2).
CONTEXTS = 32 + 256 + 256 + 4096
SETS = 32 + 32


def contexts_of(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context of each predictor (4, n), weights' sets (2, n), map's row) of decisions."""
    pure, often, word, kind, size = cells & 3, cells >> 2 & 7, cells >> 5 & 4095, cells >> 17 & 7, cells >> 20
    own = often * 4 + pure
    return np.stack([own, 32 + size * 8 + often, 288 + kind * 32 + size, 544 + word]), np.stack([own, 32 + size]), kind


class Matcher:
    """Probability that an expected continuation comes: four hashed contexts' predictions, two sets of weights, and an adaptive map."""

    KNOTS = 33

    def __init__(self, hits: np.ndarray, misses: np.ndarray):
        self.stretch = np.log((hits + 0.4) / (misses + 0.4))
        self.weights = np.full((SETS, 4), 0.25)
        self.map = np.tile(squash(np.linspace(-8, 8, self.KNOTS)), (8, 1))

    def mixed(self, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        contexts, sets, kind = contexts_of(cells)
        s = self.stretch[contexts]
        x = ((self.weights[sets[0]] + self.weights[sets[1]]).T * s).sum(0) / 2
        return x, s, sets, kind

    def train(self, cells: np.ndarray, hit: np.ndarray, batch: int = 2000, rate: float = 0.02) -> None:
        for a in range(0, len(cells), batch):
            x, s, sets, kind = self.mixed(cells[a : a + batch])
            y = hit[a : a + batch]
            near = np.rint((np.clip(x, -7.999, 7.999) + 8) / 16 * (self.KNOTS - 1)).astype(np.int64)
            key = kind * self.KNOTS + near
            n = np.bincount(key, minlength=8 * self.KNOTS)
            mean = np.bincount(key, y, 8 * self.KNOTS) / np.maximum(n, 1)
            self.map += 0.1 * (n / (n + 40)).reshape(8, -1) * (mean.reshape(8, -1) - self.map)
            error = y - squash(x)
            for which in sets:
                m = np.bincount(which, minlength=SETS)
                for p in range(4):
                    self.weights[:, p] += rate * np.bincount(which, error * s[p], SETS) / np.maximum(m, 20)

    def probability(self, cells: np.ndarray) -> np.ndarray:
        x, _, _, kind = self.mixed(cells)
        at = (np.clip(x, -7.999, 7.999) + 8) / 16 * (self.KNOTS - 1)
        low = at.astype(np.int64)
        f = at - low
        m = self.map[kind, low] * (1 - f) + self.map[kind, low + 1] * f
        return np.clip((squash(x) + m) / 2, 1e-5, 1 - 1e-5)

    def trained(self) -> np.ndarray:
        return np.concatenate([self.weights.ravel(), self.map.ravel()])

    def take(self, values: np.ndarray) -> None:
        self.weights, self.map = values[: 4 * SETS].reshape(SETS, 4), values[4 * SETS :].reshape(8, -1)


# ---------------------------------------------------------------- common words


def code_tree(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Huffman's code of symbols by their descending counts: (first step of each symbol, and their number; steps: inner node * 2 + bit; stretched share of
    ones at each node)."""
    n = len(counts)
    weight, up, i, j = [*counts[::-1].tolist(), *[0] * (n - 1)], [0] * (2 * n - 1), 0, n
    for k in range(n, 2 * n - 1):  # the two lightest of the symbols and nodes that are left
        for bit in (0, 1):
            if i < n and (j >= k or weight[i] <= weight[j]):
                x, i = i, i + 1
            else:
                x, j = j, j + 1
            up[x] = (k - n) * 2 + bit
            weight[k] += weight[x]
    up, weight_, ones = np.array(up), np.array(weight, np.float64), np.zeros(n - 1)
    odd = np.flatnonzero(up[:-1] & 1)
    ones[up[odd] >> 1] = weight_[odd]
    now, at, found = np.arange(n)[::-1], np.arange(n), []
    while len(at := at[now[at] != 2 * n - 2]):
        step = up[now[at]]
        found.append((at, step))
        now[at] = n + (step >> 1)
    size = np.zeros(n, np.int64)
    for at, _ in found:
        size[at] += 1
    start = np.concatenate([[0], np.cumsum(size)])
    steps = np.zeros(start[-1], np.int32)
    for k, (at, step) in enumerate(found):
        steps[start[at] + k] = step
    return start, steps, np.log(ones / (weight_[n:] - ones))


#: Buckets of a state: never seen; one outcome alone, by how often (6) and which; both outcomes, by their share (9) and whether often.
BUCKETS = 32
_TIMES = _Z + _O
_SHARE = np.digitize(np.log((_O + 0.4) / (_Z + 0.4)), [-2, -1.3, -0.7, -0.25, 0.25, 0.7, 1.3, 2])
_ONE_OUTCOME = 1 + 2 * np.minimum(np.log2(np.maximum(_TIMES, 1)).astype(int), 5) + (_O > 0)
BUCKET = np.where(_TIMES == 0, 0, np.where((_Z == 0) | (_O == 0), _ONE_OUTCOME, 13 + 2 * _SHARE + (_TIMES >= 24))).astype(np.uint8)
#: Of each state, in five bits each: its bucket without a zero, without a one, and as it is.
_WITHOUT = BUCKET[np.where(~SCALED & (_Z > 0), _Z - 1, _Z) * 256 + _O], BUCKET[_Z * 256 + np.where(~SCALED & (_O > 0), _O - 1, _O)], BUCKET
BUCKET_WITHOUT = sum(b.astype(np.uint16) << np.uint16(5 * k) for k, b in enumerate(_WITHOUT))


class Coder:
    """Bits of the common words' code, each predicted by its node's own counts and by those after the words before, mixed by weights that the states choose,
    and refined by an adaptive map.

    What the predictors say of a bit is one of CELLS combinations of their states; the mixer's answers to all of them are a table."""

    #: Levels of a node's own share, which a code keeps near one half.
    EDGES = np.linspace(-1.4, 1.4, 15)
    KNOTS, ROUNDS, RATE = 33, 60, 0.3

    def __init__(self, words: list[int], total: int, before: tuple[tuple[int, ...], ...] = BEFORE):
        self.before, self.others = before, len(words)
        self.start, self.steps, odds = code_tree(np.array([*words, total - sum(words) + 1], np.int64))
        self.level = np.digitize(odds, self.EDGES)  # 64 bits, as all that indexes: narrower indices cost several times as much
        self.width = min(WORD_SLOTS, max(12, int(np.ceil(np.log2(max(2, total) * 4)))))
        self.cells = (len(self.EDGES) + 1) * BUCKETS ** len(before)
        self.states = np.zeros((len(before), 0), np.uint16)  # of each slot, BUCKET_WITHOUT
        self.cost = np.zeros(2 * self.cells, np.float32)

    def contexts(self, ids: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
        """Hashes of the contexts of each token of several texts, end to end."""
        place = np.arange(len(ids)) - np.repeat(first[:-1], np.diff(first))
        out = []
        for k, distances in enumerate(self.before):
            h = np.full(len(ids), k + 1, np.uint64)
            for d in distances:
                word = np.full(len(ids), RARE + 1, np.uint64)  # before the text
                word[d:] = np.where(place[d:] >= d, ids[: max(0, len(ids) - d)], RARE + 1)
                h = (h ^ word) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            out.append(h)
        return out

    def bits(self, ids: np.ndarray, contexts: list[np.ndarray], use: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]]:
        """Of the tokens at `use`, some at a time: (bits of each, bit, node, slots in each predictor's table)."""
        for a in range(0, len(use), BITS):
            at = use[a : a + BITS]
            symbol = np.minimum(ids[at], self.others)
            begin = self.start[symbol]
            size = self.start[symbol + 1] - begin
            step = self.steps[np.arange(int(size.sum())) + np.repeat(begin - (np.cumsum(size) - size), size)].astype(np.int64)
            node = step >> 1
            spread = (node.view(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
            yield size, step & 1, node, [((np.repeat(h[at], size) + spread) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.width)).view(np.int64) for h in contexts]

    def fill(self, seen: np.ndarray, ids: np.ndarray, first: np.ndarray) -> None:
        """Adds the texts' bits to the zeros and ones of all predictors' slots."""
        flat, row = seen.reshape(-1), seen.shape[1]
        for _, bit, _, slots in self.bits(ids, self.contexts(ids, first), np.arange(len(ids))):
            for k, slot in enumerate(slots):
                np.add.at(flat, slot + (bit * row + (k << self.width)), np.int32(1))

    def decisions(self, ids: np.ndarray, first: np.ndarray, held: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(bits of each token, cell * 2 + bit of each bit) of the texts, some tokens at a time; of those that are not held out, the own bit is left out."""
        fresh_ = np.repeat(held, np.diff(first))
        for a, (size, bit, node, slots) in zip(range(0, len(ids), BITS), self.bits(ids, self.contexts(ids, first), np.arange(len(ids))), strict=True):
            which = np.where(np.repeat(fresh_[a : a + BITS], size), 10, 5 * bit).astype(np.uint16)
            cell = self.level[node]
            for states, slot in zip(self.states, slots, strict=True):
                cell = cell * BUCKETS + (states[slot] >> which & np.uint16(BUCKETS - 1))
            yield size, 2 * cell + bit

    def costs(self, ids: np.ndarray, first: np.ndarray, held: np.ndarray) -> np.ndarray:
        """log10 probability of each token's code."""
        out, a = np.zeros(len(ids)), 0
        for size, decision in self.decisions(ids, first, held):
            run = np.concatenate([[0.0], np.cumsum(self.cost[decision], dtype=np.float64)])
            ends = np.cumsum(size)
            out[a : a + len(size)] = run[ends] - run[ends - size]
            a += len(size)
        return out

    def train(self, cell: np.ndarray, zeros: np.ndarray, ones: np.ndarray) -> None:
        """Weights and map by how often the combinations of all training tokens had which bit, then the cost of every decision."""
        parts = lambda c: [c // BUCKETS ** len(self.before), *(c // BUCKETS**k % BUCKETS for k in range(len(self.before) - 1, -1, -1))]
        zeros, ones = zeros.astype(np.float64), ones.astype(np.float64)
        own = parts(cell)
        # what a state's bits were, over all nodes, is its prediction
        self.stretch = [np.log((np.bincount(p, ones, BUCKETS) + 0.4) / (np.bincount(p, zeros, BUCKETS) + 0.4)) for p in own]
        self.weights = np.full((2, BUCKETS * BUCKETS, len(own)), 0.5)
        s, times = [t[p] for t, p in zip(self.stretch, own, strict=True)], zeros + ones
        for _ in range(self.ROUNDS):
            x = self.mixed(own)
            q = squash(x)
            error, bend = ones - times * q, times * q * (1 - q)
            for which, gate in enumerate(self.gates(own)):
                for p, given in enumerate(s):
                    self.weights[which, :, p] += self.RATE * np.bincount(gate, error * given, BUCKETS * BUCKETS) / (np.bincount(gate, bend * given * given, BUCKETS * BUCKETS) + 5)
        near = own[0] * self.KNOTS + np.rint((np.clip(self.mixed(own), -7.999, 7.999) + 8) / 16 * (self.KNOTS - 1)).astype(np.int64)
        rows = len(self.EDGES) + 1
        prior = np.tile(squash(np.linspace(-8, 8, self.KNOTS)), rows)
        self.map = ((np.bincount(near, ones, rows * self.KNOTS) + 40 * prior) / (np.bincount(near, times, rows * self.KNOTS) + 40)).reshape(rows, -1)
        for a in range(0, self.cells, 1 << 16):
            q = self.probability(parts(np.arange(a, min(a + (1 << 16), self.cells))))
            self.cost[2 * a : 2 * a + 2 * len(q)] = np.log10(np.stack([1 - q, q], 1)).ravel()

    def gates(self, own: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """What chooses the two sets of weights: the second context's state with the first one's and with the last one's."""
        second = own[min(2, len(own) - 1)]
        return own[1] * BUCKETS + second, own[-1] * BUCKETS + second

    def mixed(self, own: list[np.ndarray]) -> np.ndarray:
        one, two = self.gates(own)
        return sum((self.weights[0, one, p] + self.weights[1, two, p]) * t[v] for p, (t, v) in enumerate(zip(self.stretch, own, strict=True))) / 2

    def probability(self, own: list[np.ndarray]) -> np.ndarray:
        """Of a one: half the mixer's, half the map's."""
        x = self.mixed(own)
        at = (np.clip(x, -7.999, 7.999) + 8) / 16 * (self.KNOTS - 1)
        low = at.astype(np.int64)
        f = at - low
        m = self.map[own[0], low] * (1 - f) + self.map[own[0], low + 1] * f
        return np.clip((squash(x) + m) / 2, 1e-6, 1 - 1e-6)


def fit_coder(coder: Coder, texts: DataFrame) -> None:
    """texts: held_out, ids (numbers of a text's tokens, packed)."""
    context = texts.sparkSession.sparkContext
    learn, given = texts.filter("not held_out").select("ids"), context.broadcast(coder)

    def fill(seen: np.ndarray, batch: pa.RecordBatch) -> None:
        for part in chunks(batch, "ids", PIECE // 4):
            given.value.fill(seen, *unpacked(part))

    coder.states = BUCKET_WITHOUT[states_of(learn, len(coder.before) << coder.width, fill)].reshape(len(coder.before), -1)
    given.destroy()
    sweep(texts.sparkSession)
    ready = context.broadcast(coder)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        seen = np.zeros(2 * coder_cells, np.int64)
        for batch in batches:
            for part in chunks(batch, "ids", PIECE // 4):
                for _, decision in ready.value.decisions(*unpacked(part), np.zeros(part.num_rows, bool)):
                    np.add.at(seen, decision, 1)
        parts = {k: part for k in range(0, len(seen), CHUNK) if (part := seen[k : k + CHUNK]).any()}
        yield pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int64()), pa.array(list(map(_packed, parts.values())), pa.binary())], ["chunk", "data"])

    def add(t: pa.Table) -> pa.Table:
        total = sum(_opened(x.as_py(), np.int64) for x in t.column("data"))
        return pa.table({"chunk": [t.column("chunk")[0].as_py()], "data": pa.array([total.tobytes()], pa.binary())})

    coder_cells, kind = coder.cells, "chunk long, data binary"
    seen = np.zeros(2 * coder.cells, np.int64)
    for r in learn.mapInArrow(tally, kind).groupBy("chunk").applyInArrow(add, kind).toLocalIterator():  # cells' number is fixed
        seen[r.chunk : r.chunk + CHUNK] = np.frombuffer(r.data, np.int64)
    ready.destroy()
    seen = seen.reshape(-1, 2)
    some = np.flatnonzero(seen.any(1))
    coder.train(some, seen[some, 0], seen[some, 1])


def unpacked(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the tokens of a batch's texts, and the first of each, and their number."""
    parts = [np.frombuffer(x, np.uint8).reshape(3, -1) for x in batch.column("ids").to_pylist()]
    low, mid, high = np.concatenate(parts, 1).astype(np.int64) if parts else np.zeros((3, 0), np.int64)
    return low | mid << 8 | high << 16, np.cumsum([0, *(p.shape[1] for p in parts)])


# ---------------------------------------------------------------- Spark


class Model(NamedTuple):
    lexicon: Lexicon
    speller: Speller
    matcher: Matcher
    total: int
    distinct: int
    coder: Coder | None = None


def _lists(values: pa.Array, first: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), values)


def score(docs: DataFrame, folds: int = FOLDS, held_out: int = HELD_OUT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte for each row of docs.

    Null texts are empty: one token, the end. Rows without id fall in fold 0, which trains. Repeated rows train as often as they come and each give
    a row. Without training texts every token is unknown and the base probability 1 (N and V are 0). bits_per_byte is the model's cost over the text's
    UTF-8 bytes (null for an empty text). Other columns are ignored."""
    return scored(docs, folds, held_out, BEFORE)[0]


def scored(docs: DataFrame, folds: int = FOLDS, held_out: int = HELD_OUT, before: tuple[tuple[int, ...], ...] = ()) -> tuple[DataFrame, Model]:
    """The scores and the model. before: the contexts of common words' bits; without any, such a word costs its share of all tokens."""
    spark, path = docs.sparkSession, scratch(docs.sparkSession)
    context = spark.sparkContext
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold("doc_id", folds) == held_out).alias("held_out"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    counts = word_counts(slim, path)
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") > 0)).first()
    # the lexicon takes whole classes of about equal counts, the commonest ones that fit; a class is a 256th of a doubling
    level = F.floor(F.log2("n") * 256)
    held, cut = 0, None
    for r in counts.filter("n > 0").groupBy(level.alias("level")).agg(F.count("*").alias("n")).orderBy(F.desc("level")).collect():  # 16384 rows at most
        held += r.n
        if held > HEAVY:
            break
        cut = r.level
    inside = (F.col("n") > 0) & (level >= cut) if cut is not None else F.lit(False)
    common = counts.filter(inside).orderBy(F.desc("n"), "word").collect()  # HEAVY rows at most
    lexicon = Lexicon([(bytes(r.word), r.n) for r in common], total)
    outside = ~F.coalesce(inside, F.lit(False))
    speller = fit_speller(counts, distinct, outside)
    sweep(spark)
    spelling = context.broadcast(speller)

    def spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for batch in batches:
            costs = pa.array(spelling.value.cost(batch.column("word").to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), costs], ["word", "n", "cost"])

    # every distinct word outside the lexicon is spelled once
    words = stored(counts.filter(outside).mapInArrow(spelled, "word binary, n long, cost double"), f"{path}/words")
    spelling.destroy()
    drop_path(spark, f"{path}/counts")
    given = context.broadcast(lexicon)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        numbers, row = Numbers(given.value.numbers), TaskContext.get().partitionId() << 33
        for batch in batches:
            for part in chunks(batch, "text", PIECE):
                texts = binary_list(part.column("text"))
                ids, rare, begin = numbered(texts, numbers)
                rare_at = np.searchsorted(np.flatnonzero(ids == RARE), begin)
                planes = np.stack([ids & 255, ids >> 8 & 255, ids >> 16]).astype(np.uint8)
                cols = {
                    "row": pa.array(np.arange(row, row + len(texts))), "doc_id": part.column("doc_id"), "held_out": part.column("held_out"), "n_bytes": pa.array([len(t) for t in texts], pa.int64()),
                    "ids": pa.array([planes[:, a:b].tobytes() for a, b in zip(begin, begin[1:], strict=False)], pa.binary()), "rare": _lists(pa.array(rare, pa.binary()), rare_at),
                }
                row += len(texts)
                yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))
        lean()

    texts = stored(slim.mapInArrow(number, "row long, doc_id long, held_out boolean, n_bytes long, ids binary, rare array<binary>"), f"{path}/texts")
    given.destroy()
    coder = Coder([r.n for r in common], total, before) if before and total else None
    if coder:
        fit_coder(coder, texts)
        sweep(spark)
    lexicon, numbers_ = copy(lexicon), lexicon.numbers
    lexicon.numbers = {}  # which the next step does without
    given_, coding = context.broadcast(lexicon), context.broadcast(coder)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        lex, code = given_.value, coding.value
        for batch in batches:
            for part in chunks(batch, "ids", PIECE // 4):
                ids, first = unpacked(part)
                p = passages_of(ids, part.column("rare").flatten().to_pylist(), first, lex)
                cost = code.costs(ids, first, part.column("held_out").to_numpy(zero_copy_only=False)) if code else lex.own[ids]
                run = np.concatenate([[0.0], np.cumsum(cost)])
                sums = lambda x: np.add.reduceat(x, p.begin[:-1])
                rare_at, key_at = np.searchsorted(p.rare, p.begin), np.searchsorted(p.start, p.begin)
                own = lambda at, cuts: pa.array((at - np.repeat(p.begin[:-1], np.diff(cuts))).astype(np.int32))
                cols = {
                    "row": part.column("row"), "doc_id": part.column("doc_id"), "held_out": part.column("held_out"), "n_bytes": part.column("n_bytes"),
                    "n_tokens": pa.array(np.diff(p.begin)), "known": pa.array(sums((p.numbers < RARE).astype(np.int64))), "sums": pa.array(sums(lex.counted[p.numbers])), "share": pa.array(sums(cost)),
                    "rare": _lists(pa.array(p.words, pa.binary()), rare_at), "rare_at": _lists(own(p.rare, rare_at), rare_at),
                    "keys": _lists(pa.array(p.keys), key_at), "codes": _lists(pa.array(p.codes), key_at), "starts": _lists(own(p.start, key_at), key_at),
                    "shares": _lists(pa.array((run[p.start + p.size] - run[p.start]).astype(np.float32)), key_at),
                }
                yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))
                del p, run, cols
        _POWERS.clear()
        lean()

    kinds = "row long, doc_id long, held_out boolean, n_bytes long, n_tokens long, known long, sums double, share double, rare array<binary>, rare_at array<int>, keys array<long>, codes array<long>, starts array<int>, shares array<float>"
    first = stored(texts.mapInArrow(read, kinds), f"{path}/first")
    coding.destroy()
    given_.destroy()
    lexicon.numbers = numbers_
    drop_path(spark, f"{path}/texts")
    places = first.select("row", "held_out", F.inline(F.arrays_zip(F.col("keys").alias("key"), F.col("codes").alias("code"), F.col("starts").alias("start"), F.col("shares").alias("share"))))
    # the commonest continuation of each context that comes again; equal ones are counted within a task before they travel
    each = places.groupBy("key", "code").agg(F.count_if(~F.col("held_out")).alias("n"), F.count("*").alias("all"))
    best = each.groupBy("key").agg(F.max(F.struct("n", "code")).alias("best"), F.sum("n").alias("total"), F.sum("all").alias("all")).filter("best.n > 0 and all > 1")
    best = stored(best.select("key", F.col("best.code").alias("expected"), F.col("best.n").alias("n"), "total"), f"{path}/best")
    sweep(spark)
    # a training text's own occurrence is left out
    hit, own = F.col("code") == F.col("expected"), (~F.col("held_out")).cast("int")
    made = places.join(best, "key").select("row", "held_out", "start", "share", "expected", hit.alias("hit"), (F.col("n") - own * hit.cast("int")).alias("n"), (F.col("total") - own).alias("total"))
    made = made.filter("n > 0 and total > 0")
    often = F.least(F.floor(F.log2("n")), F.lit(7))
    ratio = F.col("n") / F.col("total")
    pure = (ratio >= 0.5).cast("int") + (ratio >= 0.75).cast("int") + (ratio >= 1).cast("int")
    cell = F.col("expected").bitwiseAND(F.lit((1 << 20) - 1)) * 32 + often * 4 + pure
    made = stored(made.select("row", "held_out", "start", F.when(F.col("hit"), F.col("share")).alias("share"), "hit", cell.cast("int").alias("cell")), f"{path}/made")
    sweep(spark)

    def flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        return batch.column("cell").to_numpy().astype(np.int64), batch.column("hit").to_numpy(zero_copy_only=False)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        seen = np.zeros((2, CONTEXTS), np.int64)
        for batch in batches:
            cells, hit = flat(batch)
            for c in contexts_of(cells)[0]:
                seen[0] += np.bincount(c[hit], minlength=CONTEXTS)
                seen[1] += np.bincount(c[~hit], minlength=CONTEXTS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(CONTEXTS)), pa.array(seen[0]), pa.array(seen[1])], ["context", "hits", "misses"])

    learn = made.filter("not held_out").select("cell", "hit")
    seen = np.zeros((2, CONTEXTS), np.int64)
    for r in learn.mapInArrow(tally, "context long, hits long, misses long").groupBy("context").agg(F.sum("hits").alias("hits"), F.sum("misses").alias("misses")).collect():  # CONTEXTS rows
        seen[:, r.context] = r.hits, r.misses
    matcher = Matcher(*seen)

    def practise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, done = Matcher(*seen), 0
        for batch in batches:
            cells, hit = flat(batch)
            own.train(cells, hit)
            done += len(cells)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([own.trained().tobytes()], pa.binary()), pa.array([done])], ["values", "n"])

    values = averaged(learn.mapInArrow(practise, "values binary, n long").collect())  # a row of fixed size for each task
    if values is not None:
        matcher.take(values)
    frozen = context.broadcast(matcher)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            cells, hit = flat(batch)
            p = frozen.value.probability(cells)
            gain = np.log10(np.where(hit, p, 1 - p)) - np.nan_to_num(batch.column("share").to_numpy(zero_copy_only=False).astype(np.float64))
            span = batch.column("start").to_numpy().astype(np.int64) * 32 + (cells >> 20)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(gain), pa.array(span, mask=~hit)], ["row", "gain", "span"])

    gains = made.select("row", "start", "share", "hit", "cell").mapInArrow(weigh, "row long, gain double, span long").groupBy("row").agg(F.sum("gain").alias("gain"), F.array_sort(F.collect_list("span")).alias("came"))
    gains = stored(gains, f"{path}/gains")
    frozen.destroy()
    for name in ("best", "made"):
        drop_path(spark, f"{path}/{name}")
    sweep(spark)

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for batch in batches:
            rows, out, times, left = [], [], [], []
            for row, rare, at, came in zip(*(batch.column(c).to_pylist() for c in ("row", "rare", "rare_at", "came")), strict=True):
                known = np.zeros(len(at), bool)
                if came:
                    spans, places_ = np.array(came), np.array(at)
                    k = np.searchsorted(spans, 32 * places_ + 31, "right") - 1  # the last span that begins there or before
                    known = (k >= 0) & (places_ < (spans[k] >> 5) + (spans[k] & 31))
                held: dict[bytes, list[int]] = {}
                for w, past in zip(rare, known.tolist(), strict=True):
                    x = held.setdefault(w, [0, 0])
                    x[0] += 1
                    x[1] += not past
                rows += [row] * len(held)
                out += held
                times += [x[0] for x in held.values()]
                left += [x[1] for x in held.values()]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(out, pa.binary()), pa.array(times, pa.int64()), pa.array(left, pa.int64())], ["row", "word", "times", "spelled"])

    met = first.select("row", "rare", "rare_at").filter(F.size("rare") > 0).join(gains.select("row", "came"), "row", "left")
    pairs = met.mapInArrow(others, "row long, word binary, times long, spelled long")
    cost = F.sum(F.col("spelled") * F.col("cost")).alias("cost")
    by_row = pairs.join(words, "word").groupBy("row").agg(cost, F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("more"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("add"))
    out = first.drop("rare", "rare_at", "keys", "codes", "starts", "shares").join(gains.select("row", "gain"), "row", "left").join(by_row, "row", "left")
    unit = float(np.log10(total + distinct + 1))
    plus = lambda a, b: F.col(a) + F.coalesce(b, F.lit(0))
    out = out.withColumn("score", plus("share", "cost") + F.coalesce("gain", F.lit(0)))
    bits = F.when(F.col("n_bytes") > 0, -F.col("score") / float(np.log10(2)) / F.col("n_bytes"))
    out = out.select(
        "doc_id", "held_out", "n_tokens", plus("known", "more").cast("long").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (plus("sums", "add") - F.col("n_tokens") * unit).alias("base_score"), "score", bits.alias("bits_per_byte"),
    )
    return out, Model(lexicon, speller, matcher, total, distinct, coder)


def op10_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))


QUERIES = {"op10_lm": op10_lm}
ORACLE: dict[str, str] = {}
