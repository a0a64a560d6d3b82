"""Evaluation logs as text: metrics, their formulas and examples, from files that are split over tasks.

A log is a sequence of lines, its meaning depends on their order: a formula or an example belongs to the
last metric named before it. Files are read in blocks (byte ranges) by any number of tasks. Within a block the
last metric is a running value; what a block starts with comes from the last metric of the blocks before it, of
which only one name a block is kept. So one long log is no bottleneck, and the result is the same for any split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# fixed values: the marks of the logs
FORMULA, EXAMPLE = "📐 Công thức:", "Ví dụ áp dụng:"
FORMULA_SIGN, EXAMPLE_SIGN = "📐", "🧮"
PASSED_OVER = ("EVALUATING", "RESULTS FOR")

_SPACE = r"[\s\x1c-\x1f]"
_DIGITS = r"[0-9](?:_?[0-9])*"
_NUMBER = rf"^[+-]?(?:(?:{_DIGITS}\.?(?:{_DIGITS})?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?|(?i:inf|infinity|nan))$"


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?U)^{_SPACE}+|{_SPACE}+$", "")


def _after(line: Column, mark: str) -> Column:
    return F.when(F.contains(line, F.lit(mark)), trimmed(F.split(line, mark, 2)[1]))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """log, file, block, at, value: the lines of logs. The log is the file's name without `.log`, or the
    folder `model=<log>` it is in, whose files follow each other by name. `at` orders the lines of a block."""
    file = F.col("_metadata.file_path")
    own = F.coalesce(F.nullif(F.regexp_extract(file, r"/model=([^/]*)/[^/]*$", 1), F.lit("")), F.regexp_extract(file, r"([^/]*?)(?:\.log)?$", 1))
    return spark.read.text(path).select(own.alias("log"), file.alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")


def parse(lines: DataFrame) -> DataFrame:
    """log, name, value, formula, example: a row for each metric of a log.

    A metric is a line `name: number ...`, of repeated ones the last counts. Lines that are blank, begin with `===`
    or `[`, or are headings, are passed over, as are formulas and examples before any metric (or behind one without
    a name). A number is what Python's float reads. A metric without formula or example has null there."""
    line = trimmed(F.col("value"))
    rows = lines.select("log", "file", "block", "at", line.alias("line"))
    passed = F.col("line").startswith("===") | F.col("line").startswith("[") | (F.col("line") == "")
    for said in PASSED_OVER:
        passed |= F.contains("line", F.lit(said))
    signed = F.col("line").startswith(FORMULA_SIGN) | F.col("line").startswith(EXAMPLE_SIGN)
    name = trimmed(F.split("line", ":", 2)[0])
    first = F.regexp_extract(trimmed(F.split("line", ":", 2)[1]), rf"(?U)^([^\s\x1c-\x1f]*)", 1)
    is_metric = ~signed & F.contains("line", F.lit(":")) & first.rlike(_NUMBER)
    rows = rows.where(~passed).select(
        "log", "file", "block", "at",
        F.when(is_metric, name).alias("name"), F.when(is_metric, F.regexp_replace(first, "_", "").try_cast("double")).alias("value"),
        _after(F.col("line"), FORMULA).alias("formula"), _after(F.col("line"), EXAMPLE).alias("example"),
    ).where("name is not null or formula is not null or example is not null")
    blocks = rows.groupBy("log", "file", "block").agg(F.max_by("name", F.when(F.col("name").isNotNull(), F.col("at"))).alias("last"))
    before = Window.partitionBy("log").orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)  # one row a block
    blocks = blocks.select("log", "file", "block", F.last("last", ignorenulls=True).over(before).alias("carried"))
    so_far = Window.partitionBy("log", "file", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    running = rows.withColumn("own", F.last("name", ignorenulls=True).over(so_far)).join(blocks, ["log", "file", "block"])
    place = F.struct("file", "block", "at")
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), place)).alias(c)
    said = running.withColumn("metric", F.coalesce("own", "carried")).where("metric is not null")
    said = said.withColumns({c: F.when(F.col("metric") != "", F.col(c)) for c in ("formula", "example")})
    return said.groupBy("log", "metric").agg(last("value"), last("formula"), last("example")).withColumnRenamed("metric", "name")


def write(lines: DataFrame, path: str) -> None:
    """lines: model, place, line. One folder for each model; its files follow each other by name, so that a long log is
    written by many tasks."""
    ordered = lines.repartitionByRange("model", "place").sortWithinPartitions("model", "place")
    ordered.select("model", F.col("line").alias("value")).write.mode("overwrite").partitionBy("model").text(path)
