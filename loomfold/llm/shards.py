"""Sharding by vector bin packing: bytes, words and rows are balanced jointly.

What is placed are groups of equal texts. A group with more than a PARTS-th of a shard's share of
bytes, words or rows is placed by itself; there are at most 3 * PARTS such groups a shard. The
others are dealt whole, by hash, to GRAINS granules a shard, so that what the driver packs has the
same size at any scale. A group is in one shard, unless it alone exceeds a shard's share: then it
is cut into as few parts as fit. Items are placed largest first, each in the shard whose residual
capacity has the highest dot product with the item's vector (each dimension in units of a shard's
share), then a bounded number of moves and swaps evens out the bytes. For the slots the rows of a
large group are dealt to cells of about a PARTS-th of a share; slots count from the cell's first
slot in its shard, so numbering sorts cells, never whole shards or groups. Everything runs on
DataFrame functions; the driver sees sums by granule and cell and the list of large groups, all
bounded by the constants.

Defined cases: a null text has no bytes (its size is the header's alone) and groups with other null
texts; repeated rows have slots of their own; rows with null or equal ids go by order of storage;
an empty table has no rows; with fewer items than shards some shards stay empty.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomfold.llm.common import materialise, pick

HEADER = 8
GRAINS, PARTS = 256, 64
POLISH = 4000


def pack(loads: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each granule. loads: a row (bytes, words, rows) for each."""
    share = np.maximum(loads.sum(0) / shards, 1e-9)
    need = loads / share
    residual = np.ones((shards, loads.shape[1]))
    at = np.zeros(len(loads), int)
    for g in np.lexsort((np.arange(len(loads)), -need.sum(1))):
        at[g] = int(np.argmax(residual @ need[g]))
        residual[at[g]] -= need[g]
    for _ in range(POLISH):  # move or swap between the fullest and the emptiest by bytes
        most, least = int(np.argmin(residual[:, 0])), int(np.argmax(residual[:, 0]))
        gap = residual[least, 0] - residual[most, 0]
        ours, theirs = np.flatnonzero(at == most), np.flatnonzero(at == least)
        theirs = np.append(theirs, -1)  # -1: a move
        small = np.where(theirs < 0, 0.0, need[theirs, 0])
        order = np.argsort(small)
        want = need[ours, 0] - gap / 2
        near = np.clip(np.searchsorted(small[order], want), 0, len(order) - 1)
        change = need[ours, 0] - small[order][near]
        off = np.where((change > 0) & (change < gap), np.abs(change - gap / 2), np.inf)
        best = int(np.argmin(off)) if len(off) else 0
        if not len(off) or off[best] >= gap / 2 * 0.999 or gap < 1e-4:
            break
        mine, other = ours[best], theirs[order[near[best]]]
        at[mine] = least
        residual[most] += need[mine]
        residual[least] -= need[mine]
        if other >= 0:
            at[other] = most
            residual[most] -= need[other]
            residual[least] += need[other]
    return at


def item_of(cell: int, granules: int, first: np.ndarray, pieces: np.ndarray) -> int:
    """The first cell of what is placed together with this cell: a granule, a large group, or a part of one over a shard's share."""
    if cell < granules:
        return cell
    g = int(np.searchsorted(first, cell, "right")) - 1
    parts = -(-int(pieces[g]) // PARTS)
    return int(first[g]) + -(-((cell - int(first[g])) * parts // int(pieces[g])) * int(pieces[g]) // parts)


def assign(docs: DataFrame, shards: int = 24, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """For each document: its id, size (UTF-8 bytes and HEADER), text_crc32, shard, slot (gapless from 0 in a shard)."""
    spark, body = docs.sparkSession, F.coalesce(F.col(text), F.lit(""))
    rows = materialise(
        pick(docs, doc_id, text).select(
            F.col(doc_id).alias("id"),
            (F.octet_length(body) + HEADER).cast("long").alias("size"),
            F.crc32(body).alias("text_crc32"),
            F.regexp_count(body, F.lit("[^ \\t\\n\\x0B\\f\\r]+")).cast("long").alias("words"),
            F.xxhash64(F.col(text).isNull(), body).alias("group"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "sizes",
    )
    sums = [F.sum("size").alias("size"), F.sum("words").alias("words"), F.count(F.lit(1)).alias("rows")]
    total = rows.agg(*sums).first()
    cut = {k: max(1, total[k] or 0) / (shards * PARTS) for k in ("size", "words", "rows")}
    shares = F.greatest(*[F.col(k) / F.lit(v) for k, v in cut.items()])
    heavy = rows.groupBy("group").agg(*sums).select("group", shares.alias("shares")).where("shares > 1").orderBy("group").collect()
    pieces = np.ceil([r["shares"] for r in heavy]).astype(int)
    first = shards * GRAINS + np.cumsum(pieces) - pieces
    listed = spark.createDataFrame([(r["group"], int(a), int(n)) for r, a, n in zip(heavy, first, pieces)], "heavy_group long, first long, pieces long")
    cell = F.coalesce(F.col("first") + F.pmod(F.xxhash64("row"), F.col("pieces")), F.pmod(F.xxhash64("group"), F.lit(shards * GRAINS)))
    dealt = rows.join(F.broadcast(listed), F.col("group") == F.col("heavy_group"), "left").withColumn("cell", cell)
    loads = dealt.groupBy("cell").agg(*sums).orderBy("cell").collect()
    item = np.array([item_of(r["cell"], shards * GRAINS, first, pieces) for r in loads], int)
    names, at = np.unique(item, return_inverse=True)
    need = np.zeros((len(names), 3))
    np.add.at(need, at, np.array([[r["size"], r["words"], r["rows"]] for r in loads], float).reshape(-1, 3))
    placed = pack(need, shards)[at] if loads else []
    filled, where = [0] * shards, []
    for r, shard in zip(loads, placed):
        where.append((r["cell"], int(shard), filled[shard]))
        filled[shard] += r["rows"]
    where_df = spark.createDataFrame(where, "cell long, shard int, start long")
    ranked = F.row_number().over(_window())
    return (
        dealt.withColumn("rank", ranked).join(F.broadcast(where_df), "cell")
        .select(F.col("id").alias(doc_id), "size", "text_crc32", "shard", (F.col("start") + F.col("rank") - 1).cast("long").alias("slot"))
    )


def _window():
    from pyspark.sql import Window

    return Window.partitionBy("cell").orderBy("id", "row")
