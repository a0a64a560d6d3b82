"""What the operators of this subpackage share: exact column picking, lookups on hot keys, Arrow buffers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomfold.sources.scratch import materialise, scope  # noqa: F401  for the operators


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table `name` of a data folder, read through Spark (any store it can reach)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Exactly these columns, found by position, so that extra columns whose names clash
    (differing in case, or given twice) cannot make a reference ambiguous; of columns
    with the same name the first is taken."""
    at = []
    for name in names:
        lower = [c.lower() for c in df.columns]
        at.append(df.columns.index(name) if name in df.columns else lower.index(name.lower()))
    renamed = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return renamed.select(*[F.col(f"c{i}").alias(n) for i, n in zip(at, names, strict=True)])


def with_columns(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    """Adds columns; an older column whose name clashes (in any case) gives way."""
    taken = {n.lower() for n in new}
    keep = [F.col(f"`{c}`") for c in df.columns if c.lower() not in taken]
    return df.select(*keep, *[c.alias(n) for n, c in new.items()])


HOT = 1000


def lookup(rows: DataFrame, known: DataFrame, key: str, n_rows: int) -> DataFrame:
    """`rows` with the columns of `known`, which has a row for each key and `n`, how many of the n_rows
    rows have it. Keys with more than a HOT-th of the rows are fewer than HOT: they are broadcast, so
    that none is one task's work; the others join by shuffle."""
    limit = max(1, n_rows // HOT)
    hot = F.broadcast(known.where(F.col("n") > limit).drop("n"))
    rest = rows.join(hot.select(key), key, "left_anti").join(known.where(F.col("n") <= limit).drop("n"), key)
    return rows.join(hot, key).unionByName(rest)


def utf8(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array in one buffer, and the n + 1 offsets into it. Null is empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if array.null_count:
        array = array.fill_null("")
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    _, ends, data = array.buffers()
    kind = np.int64 if wide else np.int32
    at = np.frombuffer(ends, kind)[array.offset : array.offset + len(array) + 1].astype(np.int64) if len(array) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def byte_slices(array: pa.Array, most: int = 4 << 20):
    """Cuts a string array into runs of rows of about `most` bytes (a longer row stands alone),
    as (first row, bytes, offsets): bounds what vectorised code allocates."""
    raw, at = utf8(array)
    first, n = 0, len(at) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(at, at[first] + most, "right")) - 1)
        last = min(last, n)
        yield first, raw[at[first] : at[last]], at[first : last + 1] - at[first]
        first = last
