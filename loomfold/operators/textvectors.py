"""Dense vectors of texts: hashed TF-IDF weights, projected on the leading right singular directions of the whole table.

The directions come from subspace iteration on blocks of rows: each round is one Spark job in which a task multiplies its rows A by
the present directions V (features x dims, sent along) and adds up A^T (A V); the sums by feature are all that reaches
the driver (FEATURES x dims numbers, 2 MB), which makes them orthogonal again. So words that stand in the same company
get near directions, without any model from outside.

Defined cases: a null text, or one without a letter or digit, has the zero vector; repeated ids have a row each; no rows give none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomfold.sources.scratch import materialise

FEATURES, DIMS, ROUNDS, SEED = 4096, 64, 4, 7
AT_ONCE = 1 << 16  # weights multiplied at once


def features(text: Column, n: int = FEATURES) -> Column:
    """The hashed words of a text, repeats included: numbers below n."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"(?U)[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(n)).cast("int"))


def inverse_frequency(rows: DataFrame, n: int) -> np.ndarray:
    """log((rows + 1) / (rows with the feature + 1)) + 1 for each feature, from counts of the whole table."""
    total = rows.count()
    known = rows.select(F.explode(F.array_distinct("f")).alias("f")).groupBy("f").agg(F.count(F.lit(1)).alias("n")).collect()  # n rows at most
    counts = np.zeros(n)
    for r in known:
        counts[r["f"]] = r["n"]
    return np.log((total + 1) / (counts + 1)) + 1


def _blocks(column: pa.ChunkedArray | pa.Array, idf: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks (first row, rows, row, feature, weight) of unit rows, in order of row and feature."""
    sizes = np.asarray(column.value_lengths()).astype(np.int64)
    n = len(idf)
    key, count = np.unique(np.repeat(np.arange(len(sizes)), sizes) * n + np.asarray(column.flatten()), return_counts=True)
    row, feature = key // n, key % n
    weight = count * idf[feature]
    weight = weight / np.sqrt(np.bincount(row, weight * weight, len(sizes)))[row]
    until, first = np.cumsum(np.bincount(row, minlength=len(sizes))), 0
    while first < len(sizes):
        done = until[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(until, done + AT_ONCE, "right")))
        part = slice(done, until[last - 1])
        yield first, last - first, row[part] - first, feature[part], weight[part]
        first = last


def _summed(key: np.ndarray, parts: np.ndarray, n: int) -> np.ndarray:
    """Sums of rows by key, which is in order."""
    out = np.zeros((n, parts.shape[1]))
    if len(key):
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        out[key[start]] = np.add.reduceat(parts, start)
    return out


def directions(rows: DataFrame, idf: np.ndarray, dims: int = DIMS, rounds: int = ROUNDS) -> np.ndarray:
    """features x dims, orthogonal: the leading right singular directions of the weights of `rows` (column f)."""
    n = len(idf)
    v = np.linalg.qr(np.random.default_rng(SEED).standard_normal((n, dims)))[0]
    for _ in range(rounds):

        def sums(batches: Iterator[pa.RecordBatch], v: np.ndarray = v) -> Iterator[pa.RecordBatch]:
            total = np.zeros((n, dims))
            for batch in batches:
                for _, size, row, feature, weight in _blocks(batch.column(0), idf):
                    projected = _summed(row, weight[:, None] * v[feature], size)
                    order = np.argsort(feature, kind="stable")
                    total += _summed(feature[order], weight[order, None] * projected[row[order]], n)
            used = np.flatnonzero(total.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), *map(pa.array, total[used].T)], ["f", *names])

        names = [f"v{i}" for i in range(dims)]
        parts = rows.select("f").mapInArrow(sums, "f int, " + ", ".join(f"{c} double" for c in names))
        found = parts.groupBy("f").agg(*[F.sum(c).alias(c) for c in names]).toPandas()  # a row a feature
        if found.empty:
            return v
        moved = np.zeros((n, dims))
        moved[found["f"].to_numpy()] = found[names].to_numpy()
        v = np.linalg.qr(moved)[0]
    return v


def vectors(table: DataFrame, row_id: str, text: str, dims: int = DIMS, n: int = FEATURES) -> DataFrame:
    """row_id and vector (`dims` doubles of length 1; zeros for a text without words) of every row."""
    rows = materialise(table.select(F.col(row_id), features(F.col(text), n).alias("f")), "text-features")
    idf = inverse_frequency(rows, n)
    v = directions(rows, idf, dims)

    @F.arrow_udf("array<double>")
    def projected(column: pa.Array) -> pa.Array:
        out = np.zeros((len(column), dims))
        for first, size, row, feature, weight in _blocks(column, idf):
            out[first : first + size] = _summed(row, weight[:, None] * v[feature], size)
        length = np.sqrt((out * out).sum(1, keepdims=True))
        out = np.divide(out, length, out=np.zeros_like(out), where=length > 1e-12)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1) * dims, pa.int32()), pa.array(out.ravel()))

    return rows.select(row_id, projected(F.col("f")).alias("vector"))
