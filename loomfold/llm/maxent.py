"""Scores of whole texts by a hashed maximum-entropy language model, beside the plain unigram score.

The outcome of a position is a token: a word (a stretch without white space, A-Z lower-cased) or the end.
The softmax is factored by classes: a token's cell has three digits to the base WIDTH, each predicted by a softmax over
WIDTH values given the digits before it. The most frequent tokens have a cell each; all others share the
cells of the last class by a checksum, and within such a cell a token has its share of the cell's counts
(one added for each token, and one outcome for all unknown ones).

A digit's logits are sums of weight vectors, one for each feature: a bias for the digits before it, and
hashed rows for the last token, the one before it (a skip), and both (a trigram), each with the digits before. Training starts
at the biases' closed form and makes gradient updates: in each round the tasks sum observed and expected
counts of each feature over their own texts, Spark adds these up by row, and each weight moves by a damped
log ratio of both: the gradient of the log-likelihood, scaled by its curvature. Each round takes
other texts, and all rounds together take all training texts once.

What grows with the corpus stays in Spark: token counts are a table, of which at most HOT tokens (the most
frequent, found by a histogram of counts) are sent to the tasks; the counts of the others are joined by
a shuffle of each text's other tokens. The weights have a fixed size, set by `bits`.

Defined cases: a null text is empty (one token, the end); a null id counts as the empty string, which is
no held-out one; repeated rows are rows of their own; without any training text all counts are 0 and the model is uniform;
columns besides id and text play no part."""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomfold.llm.common import materialise, pick, scope

END = b" "  # no word holds a space
WIDTH = 16
CELLS, TAIL = WIDTH**3, WIDTH**2  # the last TAIL cells are shared
HOT, HOT_BYTES = 1 << 17, 64  # tokens sent to the tasks, and bytes of each
FLUSH = 1 << 18  # distinct tokens that a task counts before it hands them on
SLICE = 1 << 17  # positions whose logits are computed together
TASK, LEAST_TASKS = 12_000_000, 4  # training tokens whose gradient is one task
PREFIXES = 1 + WIDTH + WIDTH**2

_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def words(text: bytes | None) -> list[bytes]:
    """Tokens of a text without the end; bytes.split() cuts at \\x20 and \\x09-\\x0D."""
    return text.lower().split() if text else []


def _key(token: Column) -> Column:
    return F.crc32(token) % TAIL


# counts


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.binary()), pa.array(seen.values(), pa.int64())], ["token", "n"])
        seen.clear()
        return out

    seen: Counter = Counter()
    for batch in batches:
        for text in batch.column(0).cast(pa.binary()):
            seen.update(words(text.as_py()))
            seen[END] += 1
            if len(seen) > FLUSH:
                yield flush()
    if seen:
        yield flush()


def token_counts(texts: DataFrame) -> DataFrame:
    """token (bytes), n over all rows of the one column of texts."""
    return texts.mapInArrow(_counted, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """What tasks need of the counts: the hot tokens with cell, log10(c + 1) and log10 of their share of the cell, and of each shared cell the log10 of its sum."""

    tokens: list[bytes]
    cell: np.ndarray
    log: np.ndarray
    share: np.ndarray
    tail_log: np.ndarray
    mass: np.ndarray  # training tokens of each cell
    limit: int  # counts above it are hot (for tokens of at most HOT_BYTES)
    total: int
    distinct: int


def vocabulary(counts: DataFrame) -> Vocabulary:
    sums = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count(F.lit(1)).alias("distinct")).first()
    level = F.floor(F.log2("n") * 4)  # at most 4 * 63 levels
    short = F.octet_length("token") <= HOT_BYTES
    sizes = sorted(((r["level"], r["least"], r["n"]) for r in counts.where(short).groupBy(level.alias("level")).agg(F.min("n").alias("least"), F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    limit, room = (sizes[0][1] if sizes else 1), HOT
    for _, least, n in sizes:
        if n > room:
            break
        limit, room = least - 1, room - n
    rows = sorted(((r["n"], bytes(r["token"])) for r in counts.where(short & (F.col("n") > limit)).collect()), key=lambda r: (-r[0], r[1]))  # at most HOT
    singles, n_hot = CELLS - TAIL, len(rows)
    n = np.array([r[0] for r in rows], np.int64)
    cell = np.arange(n_hot)
    tail = np.zeros((2, TAIL), np.int64)
    own = counts.join(F.broadcast(counts.sparkSession.createDataFrame([(t,) for _, t in rows[:singles]], "token binary")), "token", "left_anti") if rows else counts
    for r in own.groupBy(_key(F.col("token")).alias("k")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("tokens")).collect():  # TAIL rows
        tail[:, r["k"]] = r["n"], r["n"] + r["tokens"]
    cell[singles:] = [singles + zlib.crc32(t) % TAIL for _, t in rows[singles:]]
    mass = np.zeros(CELLS)
    mass[: min(n_hot, singles)] = n[:singles]
    mass[singles:] = tail[0]
    tail_log, log = np.log10(tail[1] + 1.0), np.log10(n + 1.0)
    share = np.zeros(n_hot)
    share[singles:] = log[singles:] - tail_log[cell[singles:] - singles]
    return Vocabulary([t for _, t in rows], cell.astype(np.int16), log, share, tail_log, mass, int(limit), int(sums["total"]), int(sums["distinct"]))


# texts as cells

CODED = "row long, doc_id {kind}, held_out boolean, n_tokens long, n_hot long, hot_log double, hot_share double, cells array<short>, others array<struct<token:binary,times:long>>"


def _coder(sent):
    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v: Vocabulary = sent.value
        find = {t: i for i, t in enumerate(v.tokens)}.get
        end = find(END, -1)
        cell, log, share = (np.append(a, 0) for a in (v.cell, v.log, v.share))  # the last is that of other tokens
        for whole in batches:
            for first in range(0, whole.num_rows, 1000):
                batch = whole.slice(first, 1000)
                parts, rare, shares, sizes = [], [], [], []
                for text in batch.column(3).cast(pa.binary()):
                    said = words(text.as_py())
                    own = np.array([*[find(w, -1) for w in said], end], np.int64)
                    said.append(END)
                    at = np.flatnonzero(own < 0).tolist()
                    seen = Counter(said[i] for i in at)
                    place = {w: zlib.crc32(w) % TAIL for w in seen}
                    own[at] = [-2 - place[said[i]] for i in at]
                    parts.append(own)
                    rare += seen.items()
                    sizes.append(len(seen))
                    shares.append(-sum(n * float(v.tail_log[place[w]]) for w, n in seen.items()))
                code = np.concatenate(parts)
                known = np.where(code >= 0, code, len(v.tokens))
                cells = np.where(code >= 0, cell[known], CELLS - TAIL - 2 - code).astype(np.int16)
                at = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
                others = pa.StructArray.from_arrays([pa.array([w for w, _ in rare], pa.binary()), pa.array([n for _, n in rare], pa.int64())], ["token", "times"])
                per = [np.add.reduceat(a, at[:-1]) for a in ((code >= 0).astype(np.int64), log[known], share[known])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), batch.column(2), pa.array(np.diff(at)), pa.array(per[0]), pa.array(per[1]), pa.array(per[2] + np.array(shares)),
                     pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(cells)), pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), others)],
                    ["row", "doc_id", "held_out", "n_tokens", "n_hot", "hot_log", "hot_share", "cells", "others"])

    return coded


# the model


class Model:
    """Weights by feature row; the last PREFIXES rows are the biases."""

    def __init__(self, bits: int, mass: np.ndarray | None = None):
        self.bits = bits
        self.weights = np.zeros(((1 << bits) + PREFIXES, WIDTH), np.float32)
        if mass is not None:  # log shares at each level, with a count of one more for each cell
            m = mass + 1.0
            for start, level in ((0, m.reshape(1, WIDTH, -1)), (1, m.reshape(WIDTH, WIDTH, -1)), (1 + WIDTH, m.reshape(-1, WIDTH, 1))):
                share = level.sum(2) / level.sum((1, 2))[:, None]
                self.weights[(1 << bits) + start : (1 << bits) + start + len(share)] = np.log(share)

    def levels(self, cell: np.ndarray, one: np.ndarray, two: np.ndarray):
        """For each level the positions with features there, the rows of these and the digit to be predicted.
        Below the first level shared cells have the bias only: their digits are those of a checksum."""
        shift = np.uint64(64 - self.bits)
        a, b = (one + 1).astype(np.uint64) * _MIX[0], (two + 1).astype(np.uint64) * _MIX[1]
        contexts = [a, b, (a ^ (b << np.uint64(1))) * _MIX[2]]
        own = np.arange(len(cell))
        for level in range(3):
            if level == 1:
                own = np.flatnonzero(cell < CELLS - TAIL)
                cell, contexts = cell[own], [c[own] for c in contexts]
            prefix = (np.zeros(len(cell), np.int64), 1 + (cell >> 8), 1 + WIDTH + (cell >> 4))[level]
            mixed = (prefix + 1).astype(np.uint64) * _MIX[2]
            yield own, [(1 << self.bits) + prefix] + [(((c + mixed) * _MIX[0]) >> shift).astype(np.int64) for c in contexts], cell >> (8, 4, 0)[level] & 15

    def outcomes(self, rows: list[np.ndarray], digit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities of all digits, and the natural log of the one that came."""
        z = self.weights[rows[0]]
        for r in rows[1:]:
            z += self.weights[r]
        np.clip(z, -40, 40, out=z)
        np.exp(z, out=z)
        z /= (z @ np.ones(WIDTH, np.float32))[:, None]
        return z, np.log(z[np.arange(len(z)), digit].astype(np.float64))

    def logs(self, cell: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """The natural log of each cell's probability."""
        bias = self.weights[1 << self.bits :].astype(np.float64)
        tail = np.arange(TAIL)
        shared = bias[WIDTH, tail >> 4] + bias[1 + WIDTH + (CELLS - TAIL >> 4) + (tail >> 4), tail & 15]
        out = np.where(cell < CELLS - TAIL, 0.0, shared[np.maximum(cell - (CELLS - TAIL), 0)])
        for own, rows, digit in self.levels(cell, one, two):
            out[own] += self.outcomes(rows, digit)[1]
        return out

    def move(self, observed: np.ndarray, expected: np.ndarray, rate: float, prior: float) -> None:
        self.weights += (rate * np.log((observed + prior) / (expected + prior))).astype(np.float32)


def _positions(batch: pa.RecordBatch, at: int):
    """Cells of a batch's texts, each with the two before it (CELLS before the first), in slices; and the texts' borders."""
    lists = batch.column(at)
    ends = np.asarray(lists.offsets, np.int64)
    cell = np.asarray(lists.values, np.int16)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    one, two = np.full(len(cell), CELLS, np.int16), np.full(len(cell), CELLS, np.int16)
    one[1:], two[2:] = cell[:-1], cell[:-2]
    starts = ends[:-1][np.diff(ends) > 0]
    one[starts] = two[starts] = CELLS
    two[starts[np.diff(np.append(starts, len(cell))) > 1] + 1] = CELLS
    parts = (tuple(a[i : i + SLICE].astype(np.int64) for a in (cell, one, two)) for i in range(0, len(cell), SLICE))
    return ends, parts


GRADIENT = "row int, observed array<float>, expected array<float>"


def _gradient(sent):
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = sent.value
        observed, expected = np.zeros(model.weights.shape, np.float32), np.zeros(model.weights.shape[::-1])
        for batch in batches:
            for part in _positions(batch, 0)[1]:
                for _, rows, digit in model.levels(*part):
                    by_digit = np.ascontiguousarray(model.outcomes(rows, digit)[0].T, dtype=np.float64)
                    for r in rows:
                        np.add.at(observed.reshape(-1), r * WIDTH + digit, np.float32(1))
                        for j in range(WIDTH):
                            expected[j] += np.bincount(r, by_digit[j], len(observed))
        expected = np.ascontiguousarray(expected.T, dtype=np.float32)
        used = np.flatnonzero(expected.any(1) | observed.any(1))
        for i in range(0, len(used), 8192):
            u = used[i : i + 8192]
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(u) + 1) * WIDTH, pa.int32()), pa.array(a[u].ravel())) for a in (observed, expected)]
            yield pa.RecordBatch.from_arrays([pa.array(u.astype(np.int32)), *lists], ["row", "observed", "expected"])

    return sums


def _summed_rows(parts: DataFrame, shape: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Both sums of all tasks, added up by row; of the size of the weights, whatever the corpus."""
    cells = [F.sum(F.col(c)[j]).alias(f"{c[0]}{j}") for c in ("observed", "expected") for j in range(WIDTH)]
    got = parts.groupBy("row").agg(*cells).toArrow()
    out, row = np.zeros((2, *shape)), np.asarray(got.column("row"))
    for n, c in enumerate("oe"):
        for j in range(WIDTH):
            out[n][row, j] = np.asarray(got.column(f"{c}{j}"))
    return out[0], out[1]


def train(coded: DataFrame, v: Vocabulary, bits: int = 17, rounds: int = 3, rate: float = 0.45, prior: float = 2.0) -> Model:
    """A model of the rows of `coded` that are not held out, each of which is in one of the rounds."""
    spark, model = coded.sparkSession, Model(bits, v.mass)
    if not v.total:
        return model
    # each task hands on sums of the size of the weights, so it gets many texts; their number follows the corpus
    texts = coded.coalesce(max(LEAST_TASKS, -(-v.total // TASK))).where("not held_out")
    for r in range(rounds):
        sent = spark.sparkContext.broadcast(model)
        part = texts.where(F.pmod(F.xxhash64("row"), F.lit(rounds)) == r).select("cells")
        model.move(*_summed_rows(part.mapInArrow(_gradient(sent), GRADIENT), model.weights.shape), rate, prior)
    return model


def _scorer(sent):
    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = sent.value
        for batch in batches:
            ends, parts = _positions(batch, batch.num_columns - 1)
            logs = [model.logs(*part) for part in parts]
            per = np.add.reduceat(np.concatenate(logs), ends[:-1]) if len(ends) > 1 else np.zeros(0)  # each text has a token, its end
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(per / math.log(10))], [*batch.schema.names[:-1], "cell_log"])

    return scored


def scored(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", held_out: Column | None = None, bits: int = 17, rounds: int = 3) -> DataFrame:
    """For each row its id, held_out, n_tokens, n_known (tokens seen in training), train_tokens, base_score and
    score: log10 of the text's probability by unigrams (one added to each count) and by the model.

    held_out: a boolean column over doc_id; by default the ids whose checksum leaves 2 when divided by 7."""
    rows = pick(docs, doc_id, text).toDF("doc_id", "text")
    said = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")
    held = F.coalesce(F.crc32(said) % 7 == 2 if held_out is None else held_out, F.lit(False))
    spark, kind = docs.sparkSession, rows.schema["doc_id"].dataType.simpleString()
    with scope(spark) as kept:
        counts = materialise(token_counts(rows.where(~held).select("text")), "token-counts")
        v = vocabulary(counts)
        numbered = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", held.alias("held_out"), "text")
        coded = materialise(numbered.mapInArrow(_coder(spark.sparkContext.broadcast(v)), CODED.format(kind=kind)), "coded-texts")
        model = train(coded, v, bits, rounds)
        others = coded.select("row", F.inline("others"))
        rare = others.join(counts.where((F.col("n") <= v.limit) | (F.octet_length("token") > HOT_BYTES)), "token").groupBy("row").agg(
            F.sum("times").alias("n_rare"), F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("rare_log"))
        out_schema = f"row long, doc_id {kind}, held_out boolean, n_tokens long, n_hot long, hot_log double, hot_share double, cell_log double"
        texts = coded.drop("others").mapInArrow(_scorer(spark.sparkContext.broadcast(model)), out_schema).join(rare, "row", "left")
        rare_log = F.coalesce("rare_log", F.lit(0.0))
        base = F.col("hot_log") + rare_log - F.col("n_tokens") * math.log10(v.total + v.distinct + 1)
        out = texts.select(
            "doc_id", "held_out", "n_tokens", (F.col("n_hot") + F.coalesce("n_rare", F.lit(0))).alias("n_known"), F.lit(v.total).cast("long").alias("train_tokens"),
            base.alias("base_score"), (F.col("cell_log") + F.col("hot_share") + rare_log).alias("score"))
        kept.append(out)
    return out
