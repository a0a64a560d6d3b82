"""Outfit suggestion in closed form: per slot the first pool that holds a candidate, and outfit t takes
its element (t - 1) mod n."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomfold.functions import columns as C
from loomfold.functions import values as V
from loomfold.operators.rankjoin import best_outfits


def suggest(requests: DataFrame, products: DataFrame, scores: DataFrame, outfits: int = 3) -> DataFrame:
    """request_id, outfit_number, products (the payload, then by slot), score (their sum), for each request.

    requests: request_id, user_id, allowed (genders), payload_id, payload_gender, payload_usage,
    payload_slot. products: product_id, slot, gender, usage. scores: user_id, product_id, score (positive).

    Required are accessories, topwear, bottomwear and footwear, or accessories and footwear for a dress;
    the payload's own slot is covered. A payload for women or girls that is no dress, top or bottom may
    get a dress. A slot uses the first pool that holds a candidate: usage and gender of the payload
    (Unisex goes with each gender), its gender, the user's genders (all products, if the catalog has
    none of these), Unisex, any; for a Unisex payload only its usage with the user's genders. Outfit t
    takes element (t - 1) mod n of a pool; without a candidate for a required slot there is none.

    A user's own products, and of the others the first outfits + 1 by id of each slot, gender and usage,
    hold the first `outfits` of every pool, so a request never meets the whole catalog."""
    dress, target = F.col("payload_slot") == "dress", F.col("payload_gender")
    wanted = F.when(dress, F.array(F.lit("accessories"), F.lit("footwear"))).otherwise(F.array(*map(F.lit, V.SLOTS)))
    required = F.array_except(wanted, F.array(F.coalesce("payload_slot", F.lit(""))))
    extra = F.when(target.isin("Women", "Girls") & ~F.coalesce(F.col("payload_slot").isin("dress", "topwear", "bottomwear"), F.lit(False)), F.array(F.lit("dress"))).otherwise(F.array().cast("array<string>"))
    asked = requests.withColumn("n_required", F.size(required)).withColumn("slot", F.explode(F.concat(required, extra)))
    shelf = products.where(F.col("slot").isin(*V.SLOTS, "dress")).select("product_id", "slot", "gender", "usage")
    first = F.row_number().over(Window.partitionBy("slot", "gender", "usage").orderBy("product_id"))
    others = asked.join(shelf.withColumn("n", first).where(F.col("n") <= outfits + 1).drop("n"), "slot")
    own = asked.join(scores.select("user_id", "product_id"), "user_id").join(shelf.hint("merge"), ["product_id", "slot"])
    rows = others.unionByName(own).dropDuplicates(["request_id", "slot", "product_id"]).where("product_id != payload_id")
    rows = rows.join(scores.select("user_id", "product_id", "score"), ["user_id", "product_id"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    genders = products.agg(F.collect_set("gender").alias("all_genders"))  # one row
    rows = rows.join(F.broadcast(genders))
    g, unisex = F.col("gender"), F.col("gender") == "Unisex"
    usage = F.col("payload_usage").isNull() | (F.col("usage") == F.col("payload_usage"))
    own_gender, suits = target.isNull() | (g == target) | unisex, F.array_contains("allowed", g) | unisex
    no_suiting = ~F.arrays_overlap("all_genders", F.concat("allowed", F.array(F.lit("Unisex"))))
    pool = F.when(target == "Unisex", F.when(usage & suits, 0)).when(usage & own_gender, 0).when(own_gender, 1).when(suits | no_suiting, 2).when(unisex, 3).otherwise(4)
    slot = Window.partitionBy("request_id", "slot")
    rows = rows.withColumn("pool", pool).where("pool is not null").withColumn("first", F.min("pool").over(slot)).where("pool = first")
    rows = rows.withColumns({"place": F.row_number().over(slot.orderBy(F.desc("score"), "product_id")) - 1, "n": F.count(F.lit(1)).over(slot)})
    rows = rows.withColumn("outfit_number", F.explode(F.sequence(F.lit(1), F.lit(outfits)))).where(F.col("place") == F.pmod(F.col("outfit_number") - 1, F.col("n")))
    whole = rows.groupBy("request_id", "user_id", "payload_id", "n_required", "outfit_number").agg(
        F.sort_array(F.collect_list(F.struct("slot", "product_id"))).alias("items"), F.sum("score").alias("score"), F.count_if(F.col("slot") != "dress").alias("core"))
    whole = whole.where("core = n_required")
    mine = scores.select("user_id", F.col("product_id").alias("payload_id"), F.col("score").alias("payload_score"))
    whole = whole.join(mine, ["user_id", "payload_id"], "left")
    return whole.select("request_id", "outfit_number", F.concat(F.array("payload_id"), F.transform("items", lambda x: x["product_id"])).alias("products"), F.round(F.col("score") + F.coalesce("payload_score", F.lit(0.0)), 6).alias("score"))


def valid(items: DataFrame) -> DataFrame:
    """outfit_id, valid: one usage among those known, and all four slots filled. items: outfit_id, slot, usage."""
    got = items.groupBy("outfit_id").agg(F.count_distinct("usage").alias("usages"), F.count_distinct(F.when(F.col("slot").isin(*V.SLOTS), F.col("slot"))).alias("slots"))
    return got.select("outfit_id", ((F.col("usages") == 1) & (F.col("slots") == len(V.SLOTS))).alias("valid"))


def structure_slot(sub: Column, master: Column) -> Column:
    """The slot that a product fills in a complete outfit, by words in its categories; the first that fits."""
    s, m = F.lower(F.coalesce(sub, F.lit(""))), F.lower(F.coalesce(master, F.lit("")))
    return (
        F.when(F.contains(s, F.lit("accessor")) | F.contains(m, F.lit("accessor")), "accessories").when(F.contains(s, F.lit("bottom")) | F.contains(m, F.lit("bottom")), "bottomwear")
        .when(F.contains(s, F.lit("top")) | F.contains(m, F.lit("top")), "topwear").when(F.contains(s, F.lit("foot")) | F.contains(m, F.lit("foot")) | F.contains(s, F.lit("shoe")), "footwear")
    )


def alike(a: str, b: str, features=V.FEATURES) -> Column:
    """Cosine of the one-hot vectors of two structs of features: equal known values over the root of both counts."""
    same = sum((F.coalesce(F.col(f"{a}.{f}") == F.col(f"{b}.{f}"), F.lit(False)).cast("double") for f in features), F.lit(0.0))
    known = [sum((F.col(f"{x}.{f}").isNotNull().cast("double") for f in features), F.lit(0.0)) for x in (a, b)]
    return F.when(known[0] * known[1] == 0, 0.0).otherwise(same / F.sqrt(known[0] * known[1]))


def complete(candidates: DataFrame, k: int = 10, item_weight: float = 1.0, pair_weight: float = 0.5, payload: str | None = None, features=V.FEATURES) -> DataFrame:
    """user_id, products, score, item_part, pair_part, rank: each user's k best combinations of one
    product a slot with one usage among those known, holding `payload` if given.

    candidates: user_id, product_id, slot, usage, score and the features; lists of any length are
    searched whole, by bounds (see rankjoin)."""
    found = best_outfits(candidates, V.SLOTS, features, k, item_weight, pair_weight, payload)
    scored = found.select("user_id", "products", F.round(F.col("item_part") + F.col("pair_part"), 9).alias("score"), "item_part", "pair_part")
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("score"), "products")))


def article_types(sub: Column, person: Column) -> Column:
    """The article types of a sub-category that suit a person; all of them if none would be left."""
    every = C.lookup({k: F.array(*map(F.lit, v)) for k, v in V.ARTICLE_TYPES.items()}, sub, F.array().cast("array<string>"))
    kept = F.when(person == "male", F.array_except(every, F.array(*map(F.lit, V.NOT_FOR_MEN)))).when(person == "female", every).otherwise(F.array_except(every, F.array(*map(F.lit, V.NOT_FOR_OTHERS))))
    return F.when(F.size(kept) > 0, kept).otherwise(every)


def product_gender(age: Column, gender: Column) -> Column:
    """The product gender of a person; Unisex if age or gender is not known."""
    g = C.normal_gender(gender)
    return F.when(age.isNull(), "Unisex").when(g == "male", F.when(age <= 12, "Boys").otherwise("Men")).when(g == "female", F.when(age <= 12, "Girls").otherwise("Women")).otherwise("Unisex")


def built(users: DataFrame, products: DataFrame, scores: DataFrame, outfits: int = 3, pool: int = 10) -> DataFrame:
    """user_id, outfit_number, slot, product_id, score, completeness: for each user `outfits` outfits,
    where outfit t takes the t-th best (or the last) of a slot's pool.

    users: user_id, age, gender, and the sub-categories `accessory` and `footwear` drawn for them. A
    pool is the first `pool` products by id of the slot's sub-category and suiting article types, of the
    user's own product gender, else Unisex, else any. They are sorted by the user's score (scores:
    user_id, product_id, score), else by a fifth of the rating. Women have a slot each for dress and
    innerwear; an outfit needs the four slots of V.SLOTS. Pools are broadcast: at most `pool` rows for
    each sub-category of V.ARTICLE_TYPES, product gender and kind of person, whatever the input."""
    found = _wanted(users).select("user_id", "person", "own", F.size("slots").alias("required"), F.inline("slots"))
    found = _shelved(found, _pools(products, pool)).select("user_id", "required", "slot", F.inline("items"))
    best = Window.partitionBy("user_id", "slot")
    found = found.join(scores.select("user_id", "product_id", "score"), ["user_id", "product_id"], "left").withColumn("key", F.round(F.coalesce("score", "base"), 9))
    found = found.withColumns({"place": F.row_number().over(best.orderBy(F.desc("key"), "product_id")), "n": F.count(F.lit(1)).over(best)})
    found = found.withColumn("outfit_number", F.explode(F.sequence(F.lit(1), F.lit(outfits)))).where(F.col("place") == F.least("outfit_number", "n"))
    whole = Window.partitionBy("user_id", "outfit_number")
    found = found.withColumns({"core": F.count_if(F.col("slot").isin(*V.SLOTS)).over(whole), "filled": F.count(F.lit(1)).over(whole)}).where(F.col("core") == len(V.SLOTS))
    return found.select("user_id", "outfit_number", "slot", "product_id", F.coalesce("score", F.lit(0.0)).alias("score"), (F.col("filled") / F.col("required")).alias("completeness"))


def _pools(products: DataFrame, pool: int, *more: str) -> DataFrame:
    """person, sub_category, shelf, items: the pools of `built`, each item with its product_id, base and the columns `more`."""
    kinds = F.explode(F.array(*map(F.lit, ("male", "female", "other"))))
    suits = products.where(F.col("sub_category").isin(*V.ARTICLE_TYPES)).withColumn("person", kinds)
    suits = suits.where(F.array_contains(article_types(F.col("sub_category"), F.col("person")), F.col("article_type")))
    shelf = F.explode(F.array_distinct(F.array(F.lit("any"), F.when(F.col("gender").isin(*V.ALL_GENDERS), F.col("gender")).otherwise("any"))))
    suits = suits.select("person", "sub_category", shelf.alias("shelf"), "product_id", (F.coalesce("rating", F.lit(0.0)) / 5).alias("base"), *more)
    first = F.row_number().over(Window.partitionBy("person", "sub_category", "shelf").orderBy("product_id"))
    return suits.withColumn("n", first).where(F.col("n") <= pool).groupBy("person", "sub_category", "shelf").agg(F.collect_list(F.struct("product_id", "base", *more)).alias("items"))


def _wanted(users: DataFrame) -> DataFrame:
    """users with person, own (their product gender) and slots: each slot and the sub-category that it takes."""
    person = F.coalesce(C.normal_gender(F.col("gender")), F.lit("other"))
    person = F.when(person == "unisex", "other").otherwise(person)
    wanted = [("accessories", F.col("accessory")), ("bottomwear", F.lit("Bottomwear")), ("topwear", F.lit("Topwear")), ("footwear", F.col("footwear"))]
    women = [("dress", F.lit("Dress")), ("innerwear", F.lit("Innerwear"))]
    slot = F.array(*[F.struct(F.lit(s).alias("slot"), c.alias("sub_category")) for s, c in wanted])
    more = F.array(*[F.struct(F.lit(s).alias("slot"), c.alias("sub_category")) for s, c in women])
    return users.withColumns({"person": person, "own": product_gender(F.col("age"), F.col("gender")), "slots": F.when(person == "female", F.concat(slot, more)).otherwise(slot)})


def _shelved(rows: DataFrame, pools: DataFrame) -> DataFrame:
    """Rows (person, own, sub_category) that have a pool, with its `items`: that of the own product gender, else Unisex, else any."""
    for n, at in enumerate((F.col("own"), F.lit("Unisex"), F.lit("any"))):
        side = pools.select("person", "sub_category", F.col("shelf").alias(f"at{n}"), F.col("items").alias(f"items{n}"))
        rows = rows.withColumn(f"at{n}", at).join(F.broadcast(side), ["person", "sub_category", f"at{n}"], "left")
    items = F.coalesce("items0", "items1", "items2")
    return rows.withColumn("items", items).where("items is not null").drop(*[f"{x}{n}" for x in ("at", "items") for n in range(3)])


def scored(users: DataFrame, products: DataFrame, vectors: DataFrame, outfits: int = 3, pool: int = 10) -> DataFrame:
    """user_id, outfits (array of outfit_number and its items by slot: slot, product_id, score), complete: the outfits of `built` by
    content scores, and the mean of their completeness (no outfits and 0 without all of V.SLOTS), in one row for each user.

    vectors: user_id and the vector of `content_vectors`; products have its `cells`, the places of their features. A user's vector
    meets the items of the pools in the user's own row, so one exchange brings all together."""
    pools = _pools(products, pool, "cells")
    rows = _wanted(users).join(vectors.select("user_id", "vector"), "user_id", "left").select("user_id", "person", "own", "vector", F.size("slots").alias("required"), F.inline("slots"))

    def placed(x: Column) -> Column:
        dot = F.aggregate(x["cells"], F.lit(0.0), lambda total, c: total + F.coalesce(F.get("vector", c.cast("int")), F.lit(0.0)))
        score = F.when(dot > 0, F.round(dot / F.sqrt(F.size(x["cells"]).cast("double")), 9))
        return F.struct((-F.round(F.coalesce(score, x["base"]), 9)).alias("by"), x["product_id"].alias("product_id"), F.coalesce(score, F.lit(0.0)).alias("score"))

    rows = _shelved(rows, pools).select("user_id", "required", "slot", F.sort_array(F.transform("items", placed)).alias("items"))
    taken = [F.element_at("items", F.least(F.lit(t), F.size("items"))) for t in range(1, outfits + 1)]
    rows = rows.select("user_id", "required", "slot", *[F.struct("slot", x["product_id"].alias("product_id"), x["score"].alias("score")).alias(f"o{t}") for t, x in enumerate(taken, 1)])
    whole = rows.groupBy("user_id").agg(F.any_value("required").alias("required"), F.count(F.lit(1)).alias("filled"), F.count_if(F.col("slot").isin(*V.SLOTS)).alias("core"), *[F.sort_array(F.collect_list(f"o{t}")).alias(f"o{t}") for t in range(1, outfits + 1)])
    every = F.array(*[F.struct(F.lit(t).alias("outfit_number"), F.col(f"o{t}").alias("items")) for t in range(1, outfits + 1)])
    full = F.col("core") == len(V.SLOTS)
    return whole.select("user_id", F.when(full, every).alias("outfits"), F.when(full, F.col("filled") / F.col("required")).otherwise(0.0).alias("complete"))
