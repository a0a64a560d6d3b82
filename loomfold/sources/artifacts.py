"""Saved artifacts: where they are, restoring, deleting, logs as text, keyed changes, requests and their results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomfold.sources import scratch
from loomfold.sources.tables import read_csv, read_first, upsert, write_csv

COMPARISON = "model string, metric string, k int, value double"
STARTED, COMPLETED = "started", "completed"


def path(spark: SparkSession, name: str) -> str:
    """A path for this application in the folder that driver and executors share."""
    return f"{scratch.root(spark)}/artifact-{spark.sparkContext.applicationId}-{name}"


def valid(saved: DataFrame | None) -> bool:
    """Whether an artifact is there and holds a row."""
    return saved is not None and not saved.isEmpty()


def restore(spark: SparkSession, at: str, make: Callable[[], DataFrame]) -> tuple[DataFrame, bool]:
    """The artifact and True if it is valid; else it is made anew, saved and read back, and False."""
    saved = read_first(spark, at)
    if valid(saved):
        return saved, True
    fresh = make()
    fresh.write.mode("overwrite").parquet(at)
    return spark.read.schema(fresh.schema).parquet(at), False


def delete(spark: SparkSession, *paths: str) -> list[bool]:
    """Removes these artifacts; whether each was there."""
    return [scratch.delete(spark, p) for p in paths]


def write_log(results: DataFrame, at: str) -> None:
    """An evaluation log as text: for each model a head line and a line for each of its metrics.
    results: model, metric, k, value, a few rows for each model, which stay together in one file."""
    line = F.format_string("%s@%d = %.6f", "metric", "k", "value")
    text = results.groupBy("model").agg(F.concat_ws("\n", F.concat(F.lit("# "), F.first("model")), F.array_join(F.sort_array(F.collect_list(line)), "\n")).alias("value"))
    text.select("value").write.mode("overwrite").text(at)


def read_log(spark: SparkSession, at: str) -> DataFrame:
    """model, metric, k, value of a log; lines that aren't a metric are passed over."""
    whole = spark.read.text(at, wholetext=True)
    part = F.explode(F.filter(F.split("value", "(?m)^# "), lambda p: F.trim(p) != ""))
    rows = whole.select(part.alias("part")).select(F.split_part("part", F.lit("\n"), F.lit(1)).alias("model"), F.explode(F.split("part", "\n")).alias("line"))
    found = [F.regexp_extract("line", r"^(\w+)@(\d+) = (-?[0-9.]+)$", i) for i in (1, 2, 3)]
    rows = rows.select("model", found[0].alias("metric"), found[1].alias("k"), found[2].alias("value")).where("metric != ''")
    return rows.withColumns({"k": F.col("k").cast("int"), "value": F.col("value").cast("double")})


def write_comparison(results: DataFrame, at: str) -> None:
    write_csv(results, at)


def read_comparison(spark: SparkSession, at: str) -> DataFrame:
    return read_csv(spark, at, COMPARISON)


def apply_changes(old: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Inserts, updates and deletes by key. changes: the columns of `old`, `op` (upsert or delete) and
    `version`; the change with the greatest version counts, of equal ones the delete."""
    last = changes.groupBy(key).agg(F.max(F.struct("version", (F.col("op") == "delete").alias("gone"), F.struct(*old.columns).alias("row"))).alias("last"))
    kept = old.join(last.select(key), key, "left_anti").select(*old.columns)
    return kept.unionByName(last.where("not last.gone").select("last.row.*"))


def completed(requests: DataFrame, known: DataFrame, results: DataFrame, fresh: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The results after a run, and its log rows. A request that isn't known is passed over; for the
    others `fresh` replaces an older result, and a start and a finish are logged. All are keyed by request_id."""
    done = requests.join(known.select("request_id"), "request_id", "left_semi")
    made = done.select("request_id").join(fresh, "request_id")
    logs = done.select("request_id", F.posexplode(F.array(F.lit(STARTED), F.lit(COMPLETED))).alias("step", "message"))
    return upsert(results, made, "request_id"), logs
