"""The whole answer to one request: personalised products and outfits, or an error code."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NO_PREDICTIONS, NO_MATCH, NO_PRODUCT = "no_predictions_for_user", "no_matching_products", "missing_product"


def respond(user_id: str, product_id: str, predictions: DataFrame, personalised: DataFrame | None, outfits: DataFrame | None, top_k: int = 6) -> DataFrame:
    """One row: user_id, current_product_id, error, personalized (product:usage match:gender match by
    rank), outfits (number:products by number). Without a personalised product the error says whether
    the user has any prediction. personalised and outfits are of one request, so a few rows; None
    stands for a product that is not in the catalog."""
    head = [F.lit(user_id).alias("user_id"), F.lit(product_id).alias("current_product_id")]
    none = F.lit(None).cast("string")
    if personalised is None or outfits is None:
        return predictions.sparkSession.range(1).select(*head, F.lit(NO_PRODUCT).alias("error"), none.alias("personalized"), none.alias("outfits"))
    said = F.concat_ws(":", "product_id", F.col("usage_match").cast("string"), F.col("gender_match").cast("string"))
    best = personalised.where(F.col("rank") <= top_k).agg(F.sort_array(F.collect_list(F.struct("rank", said.alias("said")))).alias("best"))
    suits = outfits.agg(F.sort_array(F.collect_list(F.struct("outfit_number", F.concat_ws(":", "outfit_number", "products").alias("said")))).alias("suits"))
    known = predictions.where(F.col("user_id") == user_id).limit(1).agg((F.count(F.lit(1)) > 0).alias("known"))
    rows = best.join(suits).join(known)  # one row each
    error = F.when(F.size("best") > 0, none).when(F.col("known"), NO_MATCH).otherwise(NO_PREDICTIONS)

    def joined(name: str, by: str):
        return F.when((F.size("best") > 0) & (F.size(name) > 0), F.array_join(F.transform(name, lambda x: x["said"]), by)).alias({"best": "personalized", "suits": "outfits"}[name])

    return rows.select(*head, error.alias("error"), joined("best", ","), joined("suits", ";"))
