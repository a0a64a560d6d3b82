"""Rows that the small tables lack: users without interactions, products without users."""

import os

from pyspark.sql import functions as F

from __spark_entry__ import queries
from tests.conftest import SMALL


def grown(spark, folder, table: str, key: str) -> str:
    """A data folder whose `table` has one more row, with a key that no other table has."""
    for name in os.listdir(SMALL):
        if name != f"{table}.parquet":
            os.symlink(f"{SMALL}/{name}", folder / name)
    rows = spark.read.parquet(f"{SMALL}/{table}.parquet")
    rows.unionByName(rows.limit(1).withColumn(key, F.lit(99_999_999).cast(rows.schema[key].dataType))).write.parquet(f"{folder}/{table}.parquet")
    return str(folder)


def test_users_without_interactions_have_an_empty_history(spark, tmp_path):
    rows = {r["user_id"]: r for r in queries()["SRC02"](spark, grown(spark, tmp_path, "customer", "c_custkey")).collect()}
    assert rows["99999999"]["history"] == 0 and rows["99999999"]["first_one"] is None
    assert len(rows) == spark.read.parquet(f"{SMALL}/customer.parquet").count() + 1
