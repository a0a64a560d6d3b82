"""Order states and latest interactions, by the same functions for tables and for streams.

A move (paid, delivered, cancelled) sets its flag and the time of the last such move; no move takes a flag back or
depends on another. So a state is a plain aggregation, the same for any order of arrival, and Structured Streaming keeps it in
its state store (output modes update and complete) with one row an order, without a state machine of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: moves and answers
PAID, DELIVERED, CANCELLED = "paid", "delivered", "cancelled"
UNKNOWN = "Order does not exist."


def order_states(moves: DataFrame) -> DataFrame:
    """order_id, is_paid, paid_at, is_delivered, delivered_at, is_cancelled, updated_at.

    moves: order_id, move, at. Other moves and null ids are passed over; a move without a time sets its flag only."""
    at = lambda kind: F.max(F.when(F.col("move") == kind, F.col("at")))
    has = lambda kind: F.bool_or(F.col("move") == kind)
    kept = moves.where(F.col("move").isin(PAID, DELIVERED, CANCELLED) & F.col("order_id").isNotNull())
    return kept.groupBy("order_id").agg(
        has(PAID).alias("is_paid"), at(PAID).alias("paid_at"), has(DELIVERED).alias("is_delivered"), at(DELIVERED).alias("delivered_at"),
        has(CANCELLED).alias("is_cancelled"), F.max("at").alias("updated_at"),
    )


def settled(orders: DataFrame, states: DataFrame) -> DataFrame:
    """Every order (order_id, created_at, distinct) with its state, and every id that is no order with a message instead."""
    known = orders.select("order_id", "created_at", F.lit(True).alias("there"))
    rows = known.join(states, "order_id", "full")
    there = F.col("there").isNotNull()
    flags = [F.when(there, F.coalesce(c, F.lit(False))).alias(c) for c in ("is_paid", "is_delivered", "is_cancelled")]
    times = [F.when(there, F.col(c)).alias(c) for c in ("paid_at", "delivered_at")]
    updated = F.when(there, F.greatest("created_at", "updated_at")).alias("updated_at")
    return rows.select("order_id", *flags, *times, updated, F.when(~there, UNKNOWN).alias("message"))


def latest_of_each(interactions: DataFrame) -> DataFrame:
    """user_id, product_id, interaction_type, ts of each user's latest interaction (ties: the greatest product, then type)."""
    place = F.struct("ts", "product_id", "interaction_type")
    return interactions.groupBy("user_id").agg(F.max(place).alias("last")).select("user_id", "last.product_id", "last.interaction_type", "last.ts")
