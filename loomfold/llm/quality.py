"""Quality rules: fixed counts, and a calibrated logistic regression on hashed n-grams.

Features are the relative frequencies of hashed words, word pairs and trigrams of code points of
the whole text, a third of the DIMS each. The regression is trained on the driver on at most SAMPLE
labelled rows (those with the least hash of their id: a fixed choice, about the same at every table
size) and at most SAMPLE_BYTES of their features, a fourth of which is held out to fit the probability (Platt scaling). Scoring runs in Arrow
batches on the bytes of all their texts at once, the model (a MB) being broadcast.

Defined cases: a null text has no words; texts under 20 words, or with over 30 % of their words in
repeated eight-word windows, fail without a score deciding; without labels of both kinds every
score is 1; null labels are ignored; repeated rows are scored alike; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomfold.llm.common import byte_slices, pick
from loomfold.llm.textbytes import NOT_SPACE, grams, room, span_hashes, word_spans

SAMPLE = 2000
SAMPLE_BYTES = 128 << 20
BITS = 14
DIMS = 3 << BITS
KEEP_FROM = 0.5
WINDOW, MOST_REPEATED, LEAST_WORDS = 8, 30, 20
SYMBOLS = "#*$%&|<>"  # fixed values

SAME = np.uint64(1 << 63)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(words: list) -> int:
    """Words inside windows of WINDOW words that occur twice or more. Windows are told apart exactly:
    ranks of pairs, of pairs of pairs, and of those (prefix doubling)."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    seen: dict = {}
    rank = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    if len(seen) == len(words):
        return 0
    step = 1
    while step < WINDOW:
        pairs = rank[:-step] * (int(rank.max()) + 1) + rank[step:]
        _, rank, count = np.unique(pairs, return_inverse=True, return_counts=True)
        if len(count) == len(rank):
            return 0
        step *= 2
    edge = np.zeros(len(words) + 1, np.int64)
    starts = np.flatnonzero(count[rank] > 1)
    edge[starts] += 1
    edge[starts + WINDOW] -= 1
    return int((np.cumsum(edge) > 0).sum())


def count(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    raw = text.encode()
    words = raw.split()  # bytes split on exactly space and \\x09-\\x0D
    chars = len(text) - sum(map(text.count, " \t\n\v\f\r"))
    lines: set = set()
    repeats = 0
    for line in raw.split(b"\n"):
        if line in lines:
            repeats += 1
        elif line and not line.isspace():
            lines.add(line)
    return len(words), chars, sum(map(text.count, SYMBOLS)), repeats, repeated_words(words)


def features(raw: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each kind of feature: its index in the model for each gram of all texts, and each text's first gram."""
    starts, ends, first = word_spans(raw, at, NOT_SPACE)
    h = span_hashes(raw, starts, ends)
    shift = np.uint64(64 - BITS)
    yield (h >> shift).astype(np.int64), first
    fits = room(first, 2)
    pairs = grams(h, 2) if len(h) > 1 else np.zeros(0, np.uint64)
    pairs[h[1:] == h[:-1]] = SAME  # a word said again is one feature, whatever the word
    pairs = pairs[fits[: len(pairs)]]
    yield (pairs >> shift).astype(np.int64) + (1 << BITS), np.concatenate([[0], np.cumsum(fits)])[first]
    lead = np.flatnonzero((raw & 0xC0) != 0x80)  # the first byte of each code point
    size = np.diff(np.append(lead, len(raw)))
    point = raw[lead].astype(np.uint64)
    for j in (1, 2, 3):
        more = np.flatnonzero(size > j)
        point[more] |= raw[lead[more] + j].astype(np.uint64) << np.uint64(8 * j)
    first = np.searchsorted(lead, at)
    fits = room(first, 3)
    three = grams(point, 3)
    three = three[fits[: len(three)]]
    yield (three >> shift).astype(np.int64) + (2 << BITS), np.concatenate([[0], np.cumsum(fits)])[first]


def raw_scores(raw: np.ndarray, at: np.ndarray, weights: np.ndarray) -> np.ndarray:
    total = np.zeros(len(at) - 1)
    for index, first in features(raw, at):
        sums = np.concatenate([[0.0], np.cumsum(weights[index], dtype=np.float64)])
        total += (sums[first[1:]] - sums[first[:-1]]) / np.maximum(1, np.diff(first))
    return total


@F.arrow_udf(T.BinaryType())
def _packed_features(texts: pa.Array) -> pa.Array:
    """Each text's non-zero features, as int32 indices and then float32 values."""
    out = []
    for _, raw, at in byte_slices(texts, 1):
        found, values = [], []
        for index, first in features(raw, at):
            f, n = np.unique(index, return_counts=True)
            found.append(f)
            values.append(n / max(1, len(index)))
        out.append(np.concatenate(found).astype(np.int32).tobytes() + np.concatenate(values).astype(np.float32).tobytes())
    return pa.array(out, pa.binary())


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class Model:
    """weights (by feature), bias, and the slope and offset of the calibrated probability."""

    def __init__(self, weights: np.ndarray, bias: float, slope: float, offset: float):
        self.weights, self.bias, self.slope, self.offset = weights, bias, slope, offset

    def probability(self, score: np.ndarray) -> np.ndarray:
        return _sigmoid(self.slope * (score + self.bias) + self.offset)


def fit(rows: list[tuple[bytes, int]], rounds: int = 150, rate: float = 0.3, decay: float = 1e-4) -> Model | None:
    """Full-batch Adam on packed features with labels 0 or 1; None without both kinds."""
    y = np.array([label for _, label in rows], float)
    if not len(y) or y.min() == y.max():
        return None
    index = [np.frombuffer(x, np.int32, len(x) // 8) for x, _ in rows]
    value = [np.frombuffer(x, np.float32, len(x) // 8, len(x) // 8 * 4) for x, _ in rows]
    held = np.arange(len(rows)) % 4 == 3 if len(rows) >= 40 else np.zeros(len(rows), bool)
    if held.any() and (y[held].min() == y[held].max() or y[~held].min() == y[~held].max()):
        held[:] = False

    def gathered(which: np.ndarray):
        own = np.flatnonzero(which)
        counts = np.array([len(index[i]) for i in own])
        return np.concatenate([index[i] for i in own]), np.concatenate([value[i] for i in own]).astype(float), np.repeat(np.arange(len(own)), counts), y[own]

    at, v, row, target = gathered(~held)
    share = np.where(target == 1, 0.5 / target.sum(), 0.5 / (1 - target).sum())  # both kinds weigh the same
    w, b = np.zeros(DIMS), 0.0
    m, s, mb, sb = np.zeros(DIMS), np.zeros(DIMS), 0.0, 0.0
    for t in range(1, rounds + 1):
        error = share * (_sigmoid(np.bincount(row, v * w[at], len(target)) + b) - target)
        g, gb = np.bincount(at, v * error[row], DIMS) + decay * w / len(target), error.sum()
        m, s, mb, sb = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g, 0.9 * mb + 0.1 * gb, 0.999 * sb + 0.001 * gb * gb
        up, down = 1 - 0.9**t, 1 - 0.999**t
        w -= rate * (m / up) / (np.sqrt(s / down) + 1e-8)
        b -= rate * (mb / up) / (np.sqrt(sb / down) + 1e-8)
    at, v, row, target = gathered(held if held.any() else ~held)
    z = np.bincount(row, v * w[at], len(target)) + b
    slope, offset = _platt(z, target)
    return Model(w.astype(np.float32), b, slope, offset)


def _platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Newton steps for the slope and offset, towards targets drawn in a little from 0 and 1."""
    target = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    x, beta = np.stack([z, np.ones_like(z)], 1), np.array([1.0, 0.0])
    for _ in range(50):
        p = _sigmoid(x @ beta)
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(2)
        beta = beta - np.clip(np.linalg.solve(h, x.T @ (p - target) + 1e-4 * (beta - [1, 0])), -1, 1)
    return max(float(beta[0]), 1e-3), float(beta[1])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Fits on at most `sample` labelled documents. The ids drawn (at most `sample`, so safe to
    broadcast) select the texts in one pass over the documents."""
    drawn = pick(labels, "doc_id", "quality").where("doc_id is not null and quality in (0, 1)")
    drawn = drawn.withColumn("draw", F.xxhash64("doc_id")).orderBy("draw", "quality").limit(sample)
    texts = pick(docs, "doc_id", "text").join(F.broadcast(drawn), "doc_id")
    texts = texts.orderBy("draw", "quality", F.xxhash64("text")).limit(sample)
    rows = texts.select(_packed_features(F.col("text")).alias("x"), "quality", "draw")
    so_far = F.sum(F.length("x")).over(Window.orderBy("draw", "quality", "x").rowsBetween(Window.unboundedPreceding, 0))  # over `sample` rows
    rows = rows.withColumn("so_far", so_far).where(F.col("so_far") <= SAMPLE_BYTES).orderBy("draw", "quality", "x").collect()
    return fit([(bytes(r["x"]), r["quality"]) for r in rows])


def rules(spark, model: Model | None):
    """A column function text -> struct(the COUNTS, base_failed, score)."""
    shared = spark.sparkContext.broadcast(model)
    fields = [T.StructField(c, T.LongType()) for c in COUNTS]

    @F.arrow_udf(T.StructType([*fields, T.StructField("score", T.DoubleType())]))
    def judged(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = shared.value
        for texts in batches:
            counts = np.array([count(t.as_py() or "") for t in texts], np.int64).reshape(-1, len(COUNTS))
            score = np.ones(len(texts))
            if model is not None:
                for row, raw, at in byte_slices(texts, 1 << 20):
                    score[row : row + len(at) - 1] = model.probability(raw_scores(raw, at, model.weights))
            yield pa.StructArray.from_arrays([*map(pa.array, counts.T.copy()), pa.array(score)], [*COUNTS, "score"])

    return judged


def verdicts(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", keep_from: float = KEEP_FROM, sample: int = SAMPLE) -> DataFrame:
    """For each document its id, the COUNTS, base_failed, kept, score (probability of good quality)."""
    judged = rules(docs.sparkSession, train(docs, labels, sample))
    found = pick(docs, doc_id, text).select(doc_id, judged(F.col(text)).alias("q"))
    return found.select(doc_id, *[f"q.{c}" for c in COUNTS], failed("q").alias("base_failed"), (~failed("q") & (F.col("q.score") >= keep_from)).alias("kept"), "q.score")


def failed(struct: str) -> Column:
    return (F.col(f"{struct}.n_words") < LEAST_WORDS) | (100 * F.col(f"{struct}.n_repeat_words") > MOST_REPEATED * F.col(f"{struct}.n_words"))


def filtered(docs: DataFrame, labels: DataFrame, text: str = "text", keep_from: float = KEEP_FROM) -> DataFrame:
    """The documents (all their columns) that are kept."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    judged = rules(docs.sparkSession, train(docs, labels))
    found = docs.toDF(*names).withColumn("q", judged(F.col(names[docs.columns.index(text)])))
    return found.where(~failed("q") & (F.col("q.score") >= keep_from)).select(*names).toDF(*docs.columns)
