"""Scratch tables in the folder that the driver and all executors share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_made: list[list[str]] = []


def root(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Where it is unset, a session on this one machine uses its
    warehouse; a cluster must name a shared folder."""
    said = spark.conf.get("spark.checkpoint.dir", None)
    if said:
        return said.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"


def fresh(spark: SparkSession, label: str) -> str:
    """A path that nothing else uses; those made within `scope` are deleted at its end."""
    at = f"{root(spark)}/{label}-{uuid.uuid4().hex}"
    if _made:
        _made[-1].append(at)
    return at


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Writes a (narrow) intermediate table and reads it back: cuts the lineage, survives lost
    executors, and gives the planner its true size."""
    spark = df.sparkSession
    path = fresh(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> bool:
    """Whether it was there."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scope(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Deletes the tables made within it when it ends, but for those that the DataFrames put into the
    list read: what a result needs no more does not stay. Scopes may be nested."""
    kept: list[DataFrame] = []
    _made.append([])
    try:
        yield kept
    finally:
        paths = _made.pop()
        read = [f for df in kept for f in df.inputFiles()]
        for path in paths:
            name = path.rsplit("/", 1)[1]
            if not any(f"/{name}/" in f for f in read):
                delete(spark, path)
            elif _made:
                _made[-1].append(path)
