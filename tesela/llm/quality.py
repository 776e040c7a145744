"""A quality classifier on random-indexing word vectors.

Every word has a fixed sparse random vector.  A word's own vector is the sum of the random vectors of its neighbours, over all texts.
A document's features are the means over its words of their unit vectors, and of the products of the unit vectors of neighbours, by
component, which tell repeated words from varied ones.  A two-layer network, learnt from a bounded sample of labelled rows, gives a logit;
a temperature fitted on a part that the gradients don't see turns it into a probability.

Words are numbered by hash, so vectors, sums and network have one size, whatever the corpus.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesela.llm.common import RangeHash, mixed, release, row_ranges, text_bytes, whole_row

#: Numbers of words, components of a vector, components of a random vector that aren't 0, neighbours on either side.
WORDS, WIDTH, FILLED, NEAR = 1 << 15, 32, 4, 2
#: Bytes of text worked on at once, and pieces into which a table of sums is cut on its way.
SLICE, SLABS = 1 << 20, 128
#: Labelled rows that the network learns from, at most: those with the smallest hashes of their ids.
SAMPLE = 20_000
#: Hidden units, passes over the sample, rows of a step, step size, weight decay, share kept for the temperature.
HIDDEN, PASSES, STEP_ROWS, RATE, DECAY, KEPT = 32, 60, 128, 0.003, 1e-4, 0.2

_SPACE, _WORD, _SIGN = 0, 1, 2
#: What a byte is part of: space, a word (ASCII letters and digits, all beyond ASCII) or a run of other signs.
KIND = np.array([_WORD if b >= 0x80 or chr(b).isalnum() else _SPACE if b <= 0x20 or b == 0x7F else _SIGN for b in range(256)], np.uint8)


def _pieces(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first document, bytes, offsets) of ranges of documents that make up about SLICE bytes; a longer one comes in slices that end at a
    space where there is one."""
    for lo, hi in row_ranges(np.diff(offsets), SLICE):
        at, end = int(offsets[lo]), int(offsets[hi])
        if hi - lo > 1 or end - at <= SLICE:
            yield lo, data[at:end], offsets[lo : hi + 1] - at
            continue
        while at < end:
            cut = min(end, at + SLICE)
            if cut < end and len(spaces := np.flatnonzero(data[at + SLICE // 2 : cut] == 0x20)):
                cut = at + SLICE // 2 + int(spaces[-1]) + 1
            yield lo, data[at:cut], np.array([0, cut - at])
            at = cut


def word_numbers(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, document) of each word and each run of signs in order; case counts, words never cross documents."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = KIND[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[1:-1] = kind[1:] != kind[:-1]
    cut[offsets] = True
    cut[-1] = True
    edges = np.flatnonzero(cut)
    starts, ends = edges[:-1], edges[1:]
    real = kind[starts] != _SPACE
    starts, ends = starts[real], ends[real]
    numbers = mixed(RangeHash(data, 13).of(starts, ends)) % np.uint64(WORDS)
    return numbers.astype(np.int64), np.searchsorted(offsets, starts, "right") - 1


def random_vectors() -> tuple[np.ndarray, np.ndarray]:
    """(places, signs) of the components of each word's random vector that aren't 0."""
    x = mixed(np.arange(WORDS * FILLED, dtype=np.uint64) + np.uint64(1 << 40)).reshape(WORDS, FILLED)
    return (x % np.uint64(WIDTH)).astype(np.int64), np.where(x >> np.uint64(63), 1.0, -1.0)


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's sums of neighbours' random vectors, in SLABS pieces; deal: some number that spreads the tasks."""
    places, signs = random_vectors()
    total = np.zeros(WORDS * WIDTH)
    for batch in batches:
        for _, data, offsets in _pieces(*text_bytes(batch.column("text"))):
            words, owner = word_numbers(data, offsets)
            for far in range(1, NEAR + 1):
                pair = np.flatnonzero(owner[far:] == owner[:-far])
                for a, b in ((words[pair], words[pair + far]), (words[pair + far], words[pair])):
                    for f in range(FILLED):
                        total += np.bincount(a * WIDTH + places[b, f], signs[b, f], WORDS * WIDTH)
    deal = TaskContext.get().partitionId()
    release()
    slabs = total.astype(np.int64).reshape(SLABS, -1)
    used = np.flatnonzero(slabs.any(1))
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(np.full(len(used), deal), pa.int32()), pa.array([slabs[s].tobytes() for s in used], pa.binary())], names=["slab", "deal", "sums"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each slab of a task."""
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for slab, sums in zip(batch.column("slab").to_pylist(), batch.column("sums"), strict=True):
            part = np.frombuffer(sums.as_py(), np.int64)
            held[slab] = held[slab] + part if slab in held else part
    deal = TaskContext.get().partitionId()
    yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([deal] * len(held), pa.int32()), pa.array([x.tobytes() for x in held.values()], pa.binary())], names=["slab", "deal", "sums"])


def word_vectors(texts: DataFrame, text: str = "text") -> np.ndarray:
    """(WORDS, WIDTH) unit vectors of words from their neighbours in all texts; zero for words that never occur.

    A task sends WORDS x WIDTH sums at most, whatever it reads; they are added in two steps, first in many tasks, then by slab, and the
    driver gets one table.
    """
    slabs = "slab int, deal int, sums binary"
    parts = texts.select(F.col(text).alias("text")).mapInArrow(_neighbours, slabs)
    many = max(1, int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    few = parts.repartition(many, "slab", F.pmod(F.xxhash64("deal"), F.lit(1 + many // SLABS))).mapInArrow(_added, slabs)
    table = np.zeros((SLABS, WORDS * WIDTH // SLABS))
    for r in few.repartition(min(many, SLABS), "slab").mapInArrow(_added, slabs).collect():  # SLABS rows
        table[r["slab"]] += np.frombuffer(r["sums"], np.int64)
    table = table.reshape(WORDS, WIDTH)
    return (table / np.maximum(np.sqrt((table**2).sum(1, keepdims=True)), 1e-9)).astype(np.float32)


def pooled(vectors: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(documents, 2 WIDTH + 1) features: mean vector, mean product of neighbours, logarithm of the number of words; 0 without words."""
    n = len(offsets) - 1
    sums, counts, pairs = np.zeros((n, 2 * WIDTH)), np.zeros(n), np.zeros(n)
    for lo, some, cuts in _pieces(data, offsets):
        words, owner = word_numbers(some, cuts)
        if not len(words):
            continue
        u = vectors[words]
        first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
        docs = owner[first] + lo
        sums[docs, :WIDTH] += np.add.reduceat(u, first, axis=0, dtype=np.float64)
        product = np.zeros_like(u)
        product[:-1] = u[:-1] * u[1:] * (owner[1:] == owner[:-1])[:, None]
        sums[docs, WIDTH:] += np.add.reduceat(product, first, axis=0, dtype=np.float64)
        size = np.diff(np.append(first, len(words)))
        counts[docs] += size
        pairs[docs] += size - 1
    sums[:, :WIDTH] /= np.maximum(counts, 1)[:, None]
    sums[:, WIDTH:] /= np.maximum(pairs, 1)[:, None]
    return np.concatenate((sums, np.log1p(counts)[:, None]), axis=1)


@dataclass
class Network:
    """Standardised features, a hidden layer of tanh, a logit and its temperature."""

    mean: np.ndarray
    spread: np.ndarray
    weights: list[np.ndarray] = field(default_factory=list)
    temperature: float = 1.0

    def hidden(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(x @ self.weights[0] + self.weights[1])

    def logits(self, features: np.ndarray) -> np.ndarray:
        x = np.clip((features - self.mean) / self.spread, -8, 8)
        return self.hidden(x) @ self.weights[2] + self.weights[3]

    def probabilities(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(features) / self.temperature, -30, 30)))


def _loss(logits: np.ndarray, y: np.ndarray, temperature: float) -> float:
    z = logits / temperature
    return float(np.mean(np.logaddexp(0, z) - y * z))


def fit_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature between 1/20 and 20 with the least log loss, by golden sections of its logarithm.

    Targets keep a distance from 0 and 1 that one more row of either class would give, so rows that are told apart without a fault don't
    make it fall without end.
    """
    good = y.sum()
    y = np.where(y == 1, (good + 1) / (good + 2), 1 / (len(y) - good + 2))
    lo, hi, ratio = -math.log(20), math.log(20), (math.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = hi - ratio * (hi - lo), lo + ratio * (hi - lo)
        if _loss(logits, y, math.exp(a)) <= _loss(logits, y, math.exp(b)):
            hi = b
        else:
            lo = a
    return math.exp((lo + hi) / 2)


def fit_network(features: np.ndarray, y: np.ndarray, seed: int = 7) -> Network:
    """Adam on the log loss of the first rows; the last KEPT share chooses the pass whose weights stay, and gives the temperature."""
    rng = np.random.default_rng(seed)
    train = max(1, len(y) - int(KEPT * len(y)))
    net = Network(features[:train].mean(0), features[:train].std(0) + 1e-6)
    x = np.clip((features[:train] - net.mean) / net.spread, -8, 8)
    net.weights = [rng.normal(0, 1 / math.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / math.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in net.weights]
    step, least, chosen = 0, math.inf, net.weights
    for _ in range(PASSES):
        order = rng.permutation(train)
        for at in range(0, train, STEP_ROWS):
            some, step = order[at : at + STEP_ROWS], step + 1
            h = net.hidden(x[some])
            error = (1 / (1 + np.exp(-np.clip(h @ net.weights[2] + net.weights[3], -30, 30))) - y[some]) / len(some)
            back = np.outer(error, net.weights[2]) * (1 - h**2)
            gradients = [x[some].T @ back, back.sum(0), h.T @ error, error.sum(keepdims=True)]
            for w, g, (m, v) in zip(net.weights, gradients, moments, strict=True):
                g = g + DECAY * w
                m += 0.1 * (g - m)
                v += 0.001 * (g**2 - v)
                w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        if train < len(y) and (loss := _loss(net.logits(features[train:]), y[train:], 1.0)) < least:
            least, chosen = loss, [w.copy() for w in net.weights]
    net.weights = chosen
    if train < len(y):
        net.temperature = fit_temperature(net.logits(features[train:]), y[train:])
    return net


@dataclass
class QualityModel:
    """Word vectors and network; without a network every text has the score `otherwise`."""

    vectors: np.ndarray
    network: Network | None
    otherwise: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        if self.network is None:
            return np.full(len(texts), self.otherwise)
        return self.network.probabilities(pooled(self.vectors, *text_bytes(texts)))


def is_held_out(key: Column) -> Column:
    """Whether the CRC-32 of the key as text leaves 0 modulo 5; null keys are not held out."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn_quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> QualityModel:
    """Word vectors from all texts; the network from at most `sample` rows of labels, those with the smallest hashes of their keys.

    A label of 1 counts as good, any other as not, null as none.  Labels without a document are ignored; several labels of one key count
    as rows.  Where labels are missing or all alike, no network is fitted, and all texts score their share of good ones (0.5 if there are
    none).
    """
    vectors = word_vectors(docs, text)
    sent = docs.sparkSession.sparkContext.broadcast(vectors)  # WORDS x WIDTH floats
    chosen = labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull()).select(F.col(key).alias("_key"), (F.col(label) == 1).cast("int").alias("_good"))
    chosen = chosen.withColumn("_hash", F.xxhash64("_key")).orderBy("_hash", "_key", "_good").limit(sample)
    features = F.arrow_udf(lambda texts: _features(sent.value, texts), "array<double>")
    found = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(F.broadcast(chosen), "_key")
    rows = found.select("_hash", "_key", "_good", features(F.coalesce("_text", F.lit(""))).alias("_x")).collect()  # at most a row of features a label
    rows.sort(key=lambda r: (r["_hash"], str(r["_key"]), r["_good"], r["_x"]))
    y = np.array([float(r["_good"]) for r in rows])
    if not len(y) or y.min() == y.max():
        return QualityModel(vectors, None, float(y.mean()) if len(y) else 0.5)
    return QualityModel(vectors, fit_network(np.array([r["_x"] for r in rows]), y), float(y.mean()))


def _features(vectors: np.ndarray, texts: pa.Array) -> pa.Array:
    x = pooled(vectors, *text_bytes(texts))
    release()
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))


def score_quality(docs: DataFrame, model: QualityModel, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """docs with score double (0 to 1, higher: good likelier) and predicted int (1 from the threshold up).

    Only the text counts; null texts score as empty ones, whose features are 0.  Very long texts are worked on in slices; a run of letters
    or signs of over SLICE bytes counts as several words.  Repeated rows score alike.  Columns of docs with the names of the added ones are
    replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # one size, whatever the corpus
    scores = F.arrow_udf(lambda texts: _scores(sent.value, texts), "double").asNondeterministic()  # else it would run once for each column
    made = docs.select(whole_row(docs, ["score", "predicted"]), scores(F.coalesce(F.col(text), F.lit(""))).alias("score"))
    return made.select("_row.*", "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def _scores(model: QualityModel, texts: pa.Array) -> pa.Array:
    out = pa.array(model.scores(texts))
    release()
    return out
