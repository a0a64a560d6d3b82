"""k-core pruning of interactions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomfold.sources import scratch


def checkpointed(rows: DataFrame) -> DataFrame:
    """Lineage cut in the shared scratch folder."""
    spark = rows.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(scratch.root(spark))
    return rows.checkpoint()


def prune_once(rows: DataFrame, k: int) -> DataFrame:
    """Rows (with column n, how many interactions each stands for) whose user and product both have at
    least k interactions, counted on the same snapshot."""
    users = rows.groupBy("user_id").agg(F.sum("n").alias("t")).where(F.col("t") >= k).select("user_id")
    products = rows.groupBy("product_id").agg(F.sum("n").alias("t")).where(F.col("t") >= k).select("product_id")
    return rows.join(users, "user_id", "left_semi").join(products, "product_id", "left_semi")


def k_core(rows: DataFrame, k: int, most_rounds: int = 100) -> tuple[DataFrame, int]:
    """Prunes until nothing changes; gives the rows and the number of rounds, the unchanged one included.
    Rounds run on one row for each (user, product) pair, written to shared scratch and counted from
    its files; the interactions are joined to the pairs that stay once, at the end."""
    with scratch.scope(rows.sparkSession) as kept:
        pairs = scratch.materialise(rows.groupBy("user_id", "product_id").agg(F.count(F.lit(1)).alias("n")), "pairs")
        before, n = pairs.count(), 0
        while n < most_rounds:
            n += 1
            pairs = scratch.materialise(prune_once(pairs, k), "pruned-pairs")
            after = pairs.count()
            if after == before:
                break
            before = after
        kept.append(pairs)
    stay = pairs.select(F.col("user_id").alias("stay_user"), F.col("product_id").alias("stay_product"))
    return rows.join(stay, F.col("user_id").eqNullSafe(F.col("stay_user")) & F.col("product_id").eqNullSafe(F.col("stay_product")), "left_semi"), n


def progress(rows: DataFrame, k: int) -> DataFrame:
    """stage (before, after), rows, users, products, density (interactions for each cell of the matrix), of k-core pruning."""
    after, _ = k_core(rows, k)
    out = None
    for stage, df in (("before", rows), ("after", after)):
        one = df.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("user_id").alias("users"), F.count_distinct("product_id").alias("products"))
        one = one.select(F.lit(stage).alias("stage"), "rows", "users", "products", F.coalesce(F.try_divide(F.col("rows"), F.col("users") * F.col("products")), F.lit(0.0)).alias("density"))
        out = one if out is None else out.unionByName(one)
    return out
