"""Exact quantiles of a continuous column without all its values in one task."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BINS, FEW = 1024, 10_000


def exact(df: DataFrame, column: str, qs: list[float]) -> list[float | None]:
    """The quantiles with linear interpolation between ranks; None for a column without values.

    Values are counted by bins between their least and greatest; the bin that holds a wanted rank is
    cut again, until it has at most FEW distinct values, and only these reach the driver. Each pass
    reads the column once for all ranks: two or three passes for values spread without large gaps."""
    values = df.select(F.col(column).cast("double").alias("x")).where("x is not null")
    n, low, high = values.agg(F.count(F.lit(1)), F.min("x"), F.max("x")).first()
    if not n:
        return [None] * len(qs)
    found: dict[int, float] = {}
    work = {((), low, high, 0): sorted({r for q in qs for r in (math.floor((n - 1) * q), math.ceil((n - 1) * q))})}
    while work:
        (path, low, high, before), ranks = work.popitem()
        inside = values
        for a, b, at in path:
            inside = inside.where(_bin(a, b) == at)
        if low < high and inside.select("x").distinct().limit(FEW + 1).count() > FEW:
            counts = inside.groupBy(_bin(low, high).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).orderBy("bin").collect()
            for r in counts:  # at most BINS + 1
                own = [x for x in ranks if before <= x < before + r["n"]]
                if own:
                    work[((*path, (low, high, r["bin"])), r["low"], r["high"], before)] = own
                before += r["n"]
            continue
        for r in inside.groupBy("x").agg(F.count(F.lit(1)).alias("n")).orderBy("x").collect():  # at most FEW
            found |= {x: r["x"] for x in ranks if before <= x < before + r["n"]}
            before += r["n"]
    out = []
    for q in qs:
        at = (n - 1) * q
        a, b = found[math.floor(at)], found[math.ceil(at)]
        out.append(a + (b - a) * (at - math.floor(at)))
    return out


def _bin(low: float, high: float):
    return F.floor((F.col("x") - F.lit(low)) / F.lit(high - low) * F.lit(float(BINS)))
