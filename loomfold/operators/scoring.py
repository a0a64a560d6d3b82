"""Profiles, content-based and hybrid scores, personalised ranking."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomfold.functions import columns as C
from loomfold.functions import values as V
from loomfold.sources.scratch import materialise

SHELF, CROWD = 16_384, 20_000  # feature tuples and users in one task
CELLS_AT_ONCE = 1 << 20  # scores that a task holds at once


def encode(products: DataFrame, features=V.FEATURES) -> DataFrame:
    """One-hot encoding in long form: product_id, feature, value, feature_index (dense, by feature in
    order and value in lexical order). A null cell has no row (its block is all zero)."""
    pairs = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(f).alias("feature"), F.col(f).alias("value")) for i, f in enumerate(features)])
    long = products.select("product_id", F.inline(pairs)).where("value is not null")
    return long.join(F.broadcast(feature_index(products, features)), ["feature", "value"]).select("product_id", "feature", "value", "feature_index")


def feature_index(products: DataFrame, features=V.FEATURES) -> DataFrame:
    """feature, value, feature_index for each distinct value: the catalog's vocabulary, whose size is
    that of the facets and not of the data."""
    pairs = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(f).alias("feature"), F.col(f).alias("value")) for i, f in enumerate(features)])
    distinct = products.select(F.inline(pairs)).where("value is not null").distinct()
    return distinct.select("feature", "value", (F.row_number().over(Window.orderBy("position", "value")) - 1).alias("feature_index"))


def weighted(interactions: DataFrame, scheme: str = "pipeline") -> DataFrame:
    return interactions.withColumn("w", C.weight(F.col("interaction_type"), scheme))


def pair_weights(interactions: DataFrame, scheme: str = "pipeline") -> DataFrame:
    """user_id, product_id, summed weight and number of interactions: what profiles need of the facts,
    combined map-side before any join."""
    return weighted(interactions, scheme).groupBy("user_id", "product_id").agg(F.sum("w").alias("w"), F.count(F.lit(1)).alias("n"))


def profiles(interactions: DataFrame, products: DataFrame, features=V.FEATURES, scheme: str = "pipeline") -> DataFrame:
    """Weighted mean of the one-hot vectors of a user's products: user_id, feature, value, weight (zeros left out)."""
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("value")) for f in features])
    known = pair_weights(interactions, scheme).join(products, "product_id").select("user_id", "w", *features).repartition("user_id")  # the one exchange of all that follows
    total = known.groupBy("user_id").agg(F.sum("w").alias("total"))
    sums = known.select("user_id", "w", F.inline(pairs)).where("value is not null").groupBy("user_id", "feature", "value").agg(F.sum("w").alias("w"))
    return sums.join(total, "user_id").where("total > 0").select("user_id", "feature", "value", (F.col("w") / F.col("total")).alias("weight"))


def user_stats(interactions: DataFrame, users: DataFrame, scheme: str = "pipeline") -> DataFrame:
    s = weighted(interactions, scheme).groupBy("user_id").agg(F.count(F.lit(1)).alias("interaction_count"), F.sum("w").alias("total_weight"))
    return users.select("user_id").join(s, "user_id", "left").select("user_id", F.coalesce("interaction_count", F.lit(0)).alias("interaction_count"), F.coalesce("total_weight", F.lit(0.0)).alias("total_weight"), F.coalesce(F.try_divide("total_weight", "interaction_count"), F.lit(0.0)).alias("avg_weight"))


def preferences(interactions: DataFrame, products: DataFrame, attributes=("article_type", "usage", "gender"), scheme: str = "pipeline") -> DataFrame:
    """user_id, attribute, value, preference: summed weights divided by the attribute's largest."""
    pairs = F.array(*[F.struct(F.lit(a).alias("attribute"), F.col(a).alias("value")) for a in attributes])
    sums = pair_weights(interactions, scheme).join(products, "product_id").select("user_id", "w", F.inline(pairs)).where("value is not null").groupBy("user_id", "attribute", "value").agg(F.sum("w").alias("w"))
    return sums.select("user_id", "attribute", "value", (F.col("w") / F.max("w").over(Window.partitionBy("user_id", "attribute"))).alias("preference"))


def shape_scores(profile: DataFrame, shapes: DataFrame, features=V.FEATURES) -> DataFrame:
    """user_id, shape, score: cosine of a profile and a distinct feature tuple, for those that share a
    feature. shapes: one row for each `shape`, a struct of the features."""
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"shape.{f}").alias("value")) for f in features])
    cells = shapes.select("shape", F.inline(pairs)).where("value is not null")
    size = F.sqrt(F.count(F.lit(1)).over(Window.partitionBy("shape")).cast("double"))
    cells = cells.withColumn("size", size)
    norms = profile.groupBy("user_id").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    scored = profile.join(cells, ["feature", "value"]).groupBy("user_id", "shape").agg(F.sum(F.col("weight") / F.col("size")).alias("dot"))
    return scored.join(norms, "user_id").select("user_id", "shape", F.round(F.col("dot") / F.col("norm"), 9).alias("score"))


def content_scores(profile: DataFrame, products: DataFrame, k: int = 20, features=V.FEATURES, shelf: int = SHELF, crowd: int = CROWD) -> DataFrame:
    """Top k products by cosine of profile and one-hot vector: user_id, product_id, score, rank.

    Products with the same features have the same score, so users are scored against distinct feature tuples, each with its
    first k products by id. A grid: tuples are dealt to blocks of about `shelf` and users, a row each, to chunks of about
    `crowd`; a task gets one chunk and one block (cogrouped Arrow tables) and keeps k rows for each user, so no row
    is made for a user and a tuple. A product that shares nothing with the profile scores 0 and isn't listed."""
    index = F.broadcast(feature_index(products, features))
    known = F.struct(F.col("feature_index").cast("int").alias("at"), "weight")
    people = profile.where("user_id is not null").join(index, ["feature", "value"], "left").groupBy("user_id").agg(
        F.collect_list(F.when(F.col("feature_index").isNotNull(), known)).alias("cells"), F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    return _in_grid(people.select("user_id", F.col("cells.at").alias("at"), F.col("cells.weight").alias("weight"), "norm"), products, index, k, features, shelf, crowd)


def content_ranking(interactions: DataFrame, products: DataFrame, k: int = 20, features=V.FEATURES, scheme: str = "pipeline", shelf: int = SHELF, crowd: int = CROWD) -> DataFrame:
    """`content_scores` of the users' `profiles`, from the facts. Products carry the numbers of their features instead of the
    values, and each pair counts once more under the number -1, which gives a user's total: so pairs meet their user in one
    exchange of a few numbers a row, and no profile of strings is made, summed or joined."""
    index = materialise(feature_index(products, features).withColumn("feature_index", F.col("feature_index").cast("int")), "features")
    coded, at = products.select("product_id", *features), [f"at{i}" for i in range(len(features))]
    for f, name in zip(features, at):
        coded = coded.join(F.broadcast(index.where(F.col("feature") == f).select(F.col("value").alias(f), F.col("feature_index").alias(name))), f, "left")
    pairs = pair_weights(interactions, scheme).where("user_id is not null").join(coded.select("product_id", *at), "product_id").select("user_id", "w", *at).repartition("user_id")
    sums = pairs.select("user_id", "w", F.explode(F.array(F.lit(-1), *at)).alias("at")).where("at is not null").groupBy("user_id", "at").agg(F.sum("w").alias("w"))
    users = sums.groupBy("user_id").agg(F.collect_list(F.when(F.col("at") >= 0, F.struct("at", "w"))).alias("cells"), F.max(F.when(F.col("at") < 0, F.col("w"))).alias("total"))
    people = users.where("total > 0").select("user_id", F.col("cells.at").alias("at"), F.transform("cells.w", lambda w: w / F.col("total")).alias("weight"))
    people = people.withColumn("norm", F.sqrt(F.aggregate("weight", F.lit(0.0), lambda s, w: s + w * w)))
    return _in_grid(people, products, F.broadcast(index), k, features, shelf, crowd)


def _in_grid(people: DataFrame, products: DataFrame, index: DataFrame, k: int, features, shelf: int, crowd: int) -> DataFrame:
    """The grid of content_scores. people: user_id, feature numbers `at`, their `weight`, and the profile's norm."""
    shapes = products.select(F.struct(*features).alias("shape"), "product_id").withColumn("place", F.row_number().over(Window.partitionBy("shape").orderBy("product_id"))).where(F.col("place") <= k)
    shapes = shapes.groupBy("shape").agg(F.sort_array(F.collect_list("product_id")).alias("ids"))
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"shape.{f}").alias("value")) for f in features])
    cells = shapes.select("shape", "ids", F.inline(pairs)).where("value is not null").join(index, ["feature", "value"])
    tuples = cells.groupBy("shape").agg(F.first("ids").alias("ids"), F.collect_list(F.col("feature_index").cast("int")).alias("cells")).select("ids", "cells", F.xxhash64("shape").alias("key"))
    tuples, people = materialise(tuples, "feature-tuples"), materialise(people, "profiles")
    n_tuples, n_users = tuples.count(), people.count()
    blocks = max(1, -(-n_tuples // shelf))
    chunks = max(1, -(-n_users // crowd), min(people.sparkSession.sparkContext.defaultParallelism, n_users // 64))
    left = people.withColumn("chunk", F.pmod(F.xxhash64("user_id"), F.lit(chunks)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = tuples.withColumn("block", F.pmod("key", F.lit(blocks)).cast("int")).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    kinds = [df.schema[c].dataType.simpleString() for df, c in ((people, "user_id"), (products, "product_id"))]
    found = left.groupBy("block", "chunk").cogroup(right.groupBy("block", "chunk")).applyInArrow(_content_task(k), f"user_id {kinds[0]}, product_id {kinds[1]}, score double, rank int")
    return found if blocks == 1 else top_k(found.drop("rank"), k)


def _content_task(k: int):
    def best(of_users: pa.Table, of_tuples: pa.Table) -> pa.Table:
        ids, users = of_tuples.column("ids").combine_chunks(), of_users.column("user_id").combine_chunks()
        none = pa.array([], pa.int64())
        out = [(users.take(none), ids.flatten().take(none), np.zeros(0), np.zeros(0, np.int32))]
        if of_users.num_rows and of_tuples.num_rows:
            flat, sizes = ids.flatten(), ids.value_lengths().to_numpy(zero_copy_only=False)
            first = np.cumsum(sizes) - sizes
            place = np.unique(np.array(flat.to_pylist(), object), return_inverse=True)[1]  # ids in order
            cells = of_tuples.column("cells").to_pylist()
            size, wide = np.sqrt([float(len(c)) for c in cells]), max(map(len, cells))
            at, weight = of_users.column("at").combine_chunks(), of_users.column("weight").combine_chunks()
            lengths, norm = at.value_lengths().to_numpy(zero_copy_only=False), of_users.column("norm").to_numpy()
            at, weight = at.flatten().to_numpy(zero_copy_only=False), weight.flatten().to_numpy(zero_copy_only=False)
            ends = np.concatenate(([0], np.cumsum(lengths)))
            last = 1 + max(max(map(max, cells)), int(at.max(initial=0)))
            cells = np.array([c + [last] * (wide - len(c)) for c in cells])
            step, n = max(1, CELLS_AT_ONCE // len(cells)), min(k, len(cells))
            for start in range(0, len(norm), step):
                stop = min(start + step, len(norm))
                rows = np.repeat(np.arange(stop - start), lengths[start:stop])
                dense = np.zeros((stop - start, last + 1))
                dense[rows, at[ends[start] : ends[stop]]] = weight[ends[start] : ends[stop]]
                dot = sum(dense[:, cells[:, f]] for f in range(wide)) / size
                score = np.where(dot != 0, np.round(dot / np.where(norm[start:stop] > 0, norm[start:stop], 1.0)[:, None], 9), -np.inf)
                # the tuples of the n best scores, up to the one whose products make k, and all that equal it
                top = np.argpartition(-score, n - 1, axis=1)[:, :n]
                top = np.take_along_axis(top, np.argsort(-np.take_along_axis(score, top, 1), axis=1), 1)
                enough = np.minimum((np.cumsum(sizes[top], axis=1) < k).sum(1), n - 1)
                limit = np.take_along_axis(score, np.take_along_axis(top, enough[:, None], 1), 1)
                row, column = np.nonzero((score >= limit) & (score > -np.inf))
                times = sizes[column]
                item = np.repeat(first[column] - (np.cumsum(times) - times), times) + np.arange(times.sum())
                row, value = np.repeat(row, times), np.repeat(score[row, column], times)
                order = np.lexsort((place[item], -value, row))
                row, value, item = row[order], value[order], item[order]
                rank = np.arange(len(row)) - np.searchsorted(row, np.arange(stop - start))[row] if len(row) else np.zeros(0, int)
                keep = rank < k
                out.append((users.take(pa.array(start + row[keep])), flat.take(pa.array(item[keep])), value[keep], (rank[keep] + 1).astype(np.int32)))
        return pa.table({name: pa.chunked_array([pa.array(part[i]) if i > 1 else part[i] for part in out]) for i, name in enumerate(("user_id", "product_id", "score", "rank"))})

    return best


def content_matrix(profile: DataFrame, products: DataFrame, features=V.FEATURES) -> DataFrame:
    """user_id, pairs, non_zero, total, best: what the whole matrix of users and products holds, of
    which no pair is made: products of a feature tuple are counted, and the others score 0."""
    shapes = products.groupBy(F.struct(*features).alias("shape")).agg(F.count(F.lit(1)).alias("times"))
    scored = shape_scores(profile, shapes, features).join(shapes, "shape")
    of_user = scored.groupBy("user_id").agg(F.sum("times").alias("non_zero"), F.sum(F.col("score") * F.col("times")).alias("total"), F.max("score").alias("best"))
    return of_user.join(F.broadcast(products.agg(F.count(F.lit(1)).alias("pairs")))).select("user_id", "pairs", "non_zero", "total", "best")


def top_k(scores: DataFrame, k: int = 20, by: str = "user_id") -> DataFrame:
    """The k best of each user by score, then product_id; rank from 1."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), "product_id"))
    return scores.withColumn("rank", rank).where(F.col("rank") <= k)


def hybrid(graph: DataFrame, content: DataFrame, alpha: float = 0.5) -> DataFrame:
    """Blend of two score tables, each scaled by its global minimum and maximum; a pair missing on one
    side counts as raw 0 there, before scaling."""
    both = graph.withColumnRenamed("score", "g").join(content.withColumnRenamed("score", "c"), ["user_id", "product_id"], "full")
    both = both.select("user_id", "product_id", F.coalesce("g", F.lit(0.0)).alias("g"), F.coalesce("c", F.lit(0.0)).alias("c"))
    bounds = graph.agg(F.min("score").alias("g_low"), F.max("score").alias("g_high")).join(content.agg(F.min("score").alias("c_low"), F.max("score").alias("c_high")))  # one row each
    scaled = both.join(F.broadcast(bounds))
    g, c = C.min_max(F.col("g"), F.col("g_low"), F.col("g_high")), C.min_max(F.col("c"), F.col("c_low"), F.col("c_high"))
    return scaled.select("user_id", "product_id", C.blend(g, c, alpha).alias("score"))


def of_requests(requests: DataFrame, products: DataFrame, interactions: DataFrame, k: int = 10) -> DataFrame:
    """The candidates of each request that have its payload's article type and may be among its k best: product columns,
    base_score (the user's summed weight over 10) and the user's preferences for article type and usage.

    Products without history of the user differ by gender and usage only, so of each (article type, gender, usage) the
    first k + 1 by id (one may be the payload) stand for all; the user's own products are all candidates.
    So a request never meets the whole catalog.

    requests: request_id, user_id, age, allowed (genders), payload_id, payload_gender, payload_article, payload_usage."""
    mine = interactions.join(requests.select("user_id").distinct(), "user_id", "left_semi")
    score = pair_weights(mine).select("user_id", "product_id", (F.col("w") / 10).alias("base_score"))
    prefs = preferences(mine, products.hint("merge"))  # the whole catalog is never broadcast
    article = prefs.where("attribute = 'article_type'").select("user_id", F.col("value").alias("article_type"), F.col("preference").alias("article_pref"))
    usage = prefs.where("attribute = 'usage'").select("user_id", F.col("value").alias("usage"), F.col("preference").alias("usage_pref"))
    place = F.row_number().over(Window.partitionBy("article_type", "gender", "usage").orderBy("product_id"))
    shelf = products.withColumn("place", place).where(F.col("place") <= k + 1).drop("place")
    right = F.col("payload_article") == F.col("article_type")
    own = requests.join(score.select("user_id", "product_id"), "user_id").join(products.hint("merge"), "product_id").where(right)
    rows = requests.join(shelf, right).unionByName(own).where("product_id != payload_id").dropDuplicates(["request_id", "product_id"])
    rows = rows.join(score, ["user_id", "product_id"], "left").join(article, ["user_id", "article_type"], "left").join(usage, ["user_id", "usage"], "left")
    return rows.fillna(0.0, ["base_score", "article_pref", "usage_pref"])


def _suits() -> Column:
    return F.coalesce(F.array_contains("allowed", F.col("gender")), F.lit(False))


def funnel(requests: DataFrame, products: DataFrame, k: int = 10) -> DataFrame:
    """Counts of each request's candidates after each filter, from the catalog's counts by article type and gender (a
    vocabulary); the payload itself, which has its article type, is no candidate. The payload is in the catalog."""
    sizes = products.groupBy("article_type").agg(F.count(F.lit(1)).alias("n")).join(
        products.groupBy("article_type", "gender").agg(F.count(F.lit(1)).alias("m")).groupBy("article_type").agg(F.map_from_entries(F.collect_list(F.struct(F.coalesce("gender", F.lit("")).alias("gender"), "m"))).alias("by_gender")), "article_type")
    all_of_them = products.agg(F.count(F.lit(1)).alias("n_products"))  # one row
    rows = requests.join(sizes.withColumnRenamed("article_type", "payload_article"), "payload_article", "left").join(F.broadcast(all_of_them))
    suiting = F.aggregate(F.array_distinct("allowed"), F.lit(0).cast("long"), lambda t, g: t + F.coalesce(F.try_element_at("by_gender", g), F.lit(0)))
    itself = F.coalesce(F.array_contains("allowed", F.col("payload_gender")), F.lit(False)).cast("long")
    known = F.col("n").isNotNull()
    counted = rows.select("request_id", (F.col("n_products") - 1).alias("initial"), F.when(known, F.col("n") - 1).otherwise(0).alias("right"), F.when(known, suiting - itself).otherwise(0).alias("both"))
    initial, final = F.col("initial"), F.least(F.col("both"), F.lit(k).cast("long"))
    return counted.select("request_id", initial.alias("initial_count"), F.col("right").alias("after_articletype"), F.col("both").alias("after_age_gender"), final.alias("final_count"), (initial - final).alias("removed_count"), F.round(F.coalesce(F.try_divide((initial - final) * 100.0, initial), F.lit(0.0)), 6).alias("reduction_rate"))


def personalised(candidates: DataFrame, k: int = 10) -> DataFrame:
    """request_id, product_id, base_score, rank: each request's k best candidates that suit the user's age and gender."""
    best = Window.partitionBy("request_id").orderBy(F.desc("base_score"), "product_id")
    return candidates.where(_suits()).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("request_id", "product_id", "base_score", "rank")


def prioritised(candidates: DataFrame, k: int = 10) -> DataFrame:
    """Each request's candidates re-scored by the payload's usage and gender and the user's preferences:
    request_id, product_id, score, base_score, usage_match, gender_match, rank."""
    g, target = F.col("gender"), F.col("payload_gender")
    usage_match = F.col("usage").eqNullSafe(F.col("payload_usage"))
    rows = candidates.where(target.isNull() | (g == target) | (g == "Unisex"))
    match = F.when(target.isNotNull(), g == target).otherwise(_suits())
    other = F.when(target.isNotNull(), V.UNISEX_BONUS).when((g == "Unisex") & (F.col("age") >= 13), V.UNISEX_BONUS).otherwise(V.OFF_GENDER)
    bonus = F.when(match, V.GENDER_BONUS).otherwise(other)
    score = F.col("base_score") + F.when(usage_match, V.USAGE_BONUS).otherwise(0.0) + bonus + V.ARTICLE_PREF * F.col("article_pref") + V.USAGE_PREF * F.col("usage_pref")
    out = rows.select("request_id", "product_id", F.round(score, 9).alias("score"), "base_score", usage_match.alias("usage_match"), F.coalesce(match, F.lit(False)).alias("gender_match"))
    best = Window.partitionBy("request_id").orderBy(F.desc("score"), "product_id")
    return out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def matched_features(interactions: DataFrame, features: DataFrame, examples: int = 10) -> DataFrame:
    """One row: interactions with a known product, how many products these are, how many distinct
    product ids are not known, and the first of these by id."""
    known = features.select("product_id").distinct()
    ids = interactions.groupBy("product_id").agg(F.count(F.lit(1)).alias("n"))
    found = ids.join(known, "product_id").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("matched"), F.count(F.lit(1)).alias("products"))
    lost = ids.join(known, "product_id", "left_anti")
    shown = lost.orderBy("product_id").limit(examples).agg(F.array_join(F.sort_array(F.collect_list("product_id")), ",").alias("examples"))
    return found.join(lost.agg(F.count(F.lit(1)).alias("skipped"))).join(shown).select("matched", "products", "skipped", "examples")  # one row each


def content_vectors(profile: DataFrame, products: DataFrame, features=V.FEATURES) -> tuple[DataFrame, DataFrame]:
    """Users (user_id, vector) and items (product_id, vector) of length one over the feature vocabulary,
    whose dot product is the content score. The vocabulary is that of the facets, so vectors are short."""
    index = feature_index(products, features)
    size = index.count()

    def dense(rows: DataFrame, key: str, weight: Column) -> DataFrame:
        cells = F.map_from_entries(F.collect_list(F.struct(F.col("feature_index").cast("int"), weight)))
        norm = F.sqrt(F.sum(weight * weight))
        whole = rows.groupBy(key).agg(cells.alias("cells"), norm.alias("norm"))
        value = lambda i: F.coalesce(F.try_divide(F.try_element_at("cells", i.cast("int")), F.col("norm")), F.lit(0.0))
        return whole.select(key, F.transform(F.sequence(F.lit(0), F.lit(max(size - 1, 0))), value).alias("vector"))

    users = dense(profile.join(F.broadcast(index), ["feature", "value"]), "user_id", F.col("weight"))
    return users, dense(encode(products, features), "product_id", F.lit(1.0))
