"""A table's profile in one pass, kinds of keys, and ids resolved against entities."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: answers to ids that name nothing
NO_USER, NO_PRODUCT = "User not found", "Product not found"

HLL_BITS, KLL_K = 14, 400  # distinct counts within about 1 %, quantiles within about 1 % of the ranks
QUARTERS = (0.25, 0.5, 0.75)


def _measures(cell: Column) -> dict[str, Column]:
    """Aggregates of a column of text cells."""
    full = F.when(F.trim(cell) != "", cell)
    number = F.when(full.rlike(r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"), F.trim(full).try_cast("double"))
    return {
        "cells": F.count(full), "nulls": F.count_if(cell.isNull()), "blanks": F.count_if(F.trim(cell) == ""),
        "wholes": F.count_if(full.rlike(r"^\s*[+-]?[0-9]+\s*$")), "numbers": F.count(number), "truths": F.count_if(F.lower(F.trim(full)).isin("true", "false")),
        "longest": F.max(F.length(full)), "mean": F.avg(number), "std": F.stddev_samp(number), "least": F.min(number), "most": F.max(number),
        "sketch": F.hll_sketch_agg(full, HLL_BITS), "quantiles": F.kll_sketch_agg_double(number, KLL_K),
    }


def profile(cells: DataFrame) -> DataFrame:
    """A row for each column: column, type, rows, nulls, blanks, null_share, longest, mean, std, least, most, about_distinct, about_quarters.

    The columns of `cells` are taken as text, as a CSV file holds them. A column's type is integer, number, boolean or
    text, by what all its cells that aren't null or blank can be read as; without any it is `empty`. The share counts
    nulls and blanks. Figures are null but for integers and numbers. Everything is a mergeable aggregate of one scan (partial sums
    on the map side, sketches of a fixed size for distinct counts and quartiles), so the driver and the last task get one row
    a partition. A table without rows gives its columns with zeros."""
    named = cells.toDF(*[f"c{i}" for i in range(len(cells.columns))])
    each = [F.struct(*[m.alias(n) for n, m in _measures(F.col(f"c{i}").cast("string")).items()]).alias(f"c{i}") for i in range(len(cells.columns))]
    total = named.agg(F.count(F.lit(1)).alias("rows"), *each)
    columns = F.explode(F.array(*[F.struct(F.lit(name).alias("column"), F.lit(i).alias("place"), F.col(f"c{i}").alias("m")) for i, name in enumerate(cells.columns)]))
    rows = total.select("rows", columns.alias("x")).select("rows", "x.column", "x.place", "x.m.*")
    kind = (
        F.when(F.col("cells") == 0, "empty").when(F.col("wholes") == F.col("cells"), "integer").when(F.col("numbers") == F.col("cells"), "number")
        .when(F.col("truths") == F.col("cells"), "boolean").otherwise("text")
    )
    figures = F.col("type").isin("integer", "number")
    rows = rows.withColumn("type", kind)
    share = F.coalesce(F.try_divide(F.col("nulls") + F.col("blanks"), F.col("rows")), F.lit(0.0))
    quarters = F.when(figures, F.array(*[F.kll_sketch_get_quantile_double("quantiles", F.lit(q)) for q in QUARTERS]))
    return rows.select(
        "column", "place", "type", "rows", "nulls", "blanks", share.alias("null_share"), F.coalesce("longest", F.lit(0)).alias("longest"),
        *[F.when(figures, F.col(c)).alias(c) for c in ("mean", "std", "least", "most")],
        F.coalesce(F.hll_sketch_estimate("sketch"), F.lit(0)).alias("about_distinct"), quarters.alias("about_quarters"),
    )


def is_object_id(key: Column) -> Column:
    return F.coalesce(key.rlike("^[0-9a-fA-F]{24}$"), F.lit(False))


def key_kind(key: Column) -> Column:
    """integer, object_id, text, blank or null. Digits are an integer unless they are 24."""
    return (
        F.when(key.isNull(), "null").when(F.trim(key) == "", "blank").when(is_object_id(key), "object_id")
        .when(key.rlike("^[0-9]+$"), "integer").otherwise("text")
    )


def key_diagnostics(rows: DataFrame, row_id: str, key: str, wanted: str, samples: int = 5) -> DataFrame:
    """kind, n, matching, sample: keys by kind, how many equal the wanted one (object ids in either case), and the first few
    rows of the kind by id as `id:key:matches`. Counts are combined before the shuffle and the sample is a limit by group,
    so no kind's rows meet in one task."""
    same = F.when(is_object_id(F.col(key)), F.lower(key) == wanted.lower()).otherwise(F.col(key) == wanted)
    known = rows.select(F.col(row_id).alias("id"), F.col(key).alias("key"), key_kind(F.col(key)).alias("kind"), F.coalesce(same, F.lit(False)).alias("matches"))
    counts = known.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_if("matches").alias("matching"))
    place = F.row_number().over(Window.partitionBy("kind").orderBy("id", "key"))
    said = F.concat_ws(":", F.col("id").cast("string"), F.coalesce("key", F.lit("")), F.col("matches").cast("string"))
    first = known.withColumn("place", place).where(F.col("place") <= samples).groupBy("kind").agg(F.sort_array(F.collect_list(F.struct("place", said.alias("said")))).alias("s"))
    return counts.join(first, "kind").select("kind", "n", "matching", F.array_join(F.transform("s", lambda x: x["said"]), ",").alias("sample"))


def resolved(requests: DataFrame, entities: DataFrame, asked: str, missing: str = NO_USER) -> DataFrame:
    """The requests with entity_id, or an error where their id names no entity.

    entities: entity_id, number (bigint) and object_id (24 hex digits), either null, each distinct. An id of digits is
    looked up as a number first (leading zeros don't count); one of 24 hex digits, in either case, as an object id if that finds
    nothing. Anything else, null included, is an error. Two equi-joins; ids that are no number or object id meet nothing."""
    by_number = entities.where("number is not null").select(F.col("number").alias("_number"), F.col("entity_id").alias("_first"))
    by_object = entities.where("object_id is not null").select(F.lower("object_id").alias("_object"), F.col("entity_id").alias("_second"))
    number = F.when(F.col(asked).rlike("^[0-9]+$"), F.col(asked).try_cast("bigint"))
    keyed = requests.withColumns({"_asked_number": number, "_asked_object": F.when(is_object_id(F.col(asked)), F.lower(asked))})
    rows = keyed.join(by_number, F.col("_asked_number") == F.col("_number"), "left").join(by_object, F.col("_asked_object") == F.col("_object"), "left")
    found = F.coalesce("_first", "_second")
    return rows.select(*requests.columns, found.alias("entity_id"), F.when(found.isNull(), missing).alias("error"))


def export_result(counts: dict[str, DataFrame], wanted: dict[str, DataFrame]) -> DataFrame:
    """export, rows, success, and for `all` the sum and whether all succeeded: an export succeeds if the rows read back
    (counts: one row, `rows`) are those to be written (wanted: alike)."""
    parts = [counts[n].select(F.lit(n).alias("export"), "rows").join(wanted[n].select(F.col("rows").alias("_wanted"))) for n in counts]  # one row each
    rows = reduce(DataFrame.unionByName, parts).select("export", "rows", (F.col("rows") == F.col("_wanted")).alias("success"))
    return rows.unionByName(rows.agg(F.lit("all").alias("export"), F.sum("rows").alias("rows"), F.bool_and("success").alias("success")))
