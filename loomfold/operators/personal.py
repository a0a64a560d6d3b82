"""Style profiles, candidates ranked with a style bonus, reasons, fallbacks; for all users at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomfold.functions import columns as C
from loomfold.functions import values as V
from loomfold.operators.scoring import pair_weights, top_k

NO_REASON = V.NO_REASON


def tokens(*columns: str) -> Column:
    """Lower-case style tokens of a product, each once, in the order of the columns; nulls left out."""
    return F.array_distinct(F.transform(F.array_compact(F.array(*columns)), F.lower))


def style_profile(interactions: DataFrame, products: DataFrame, columns=("base_colour", "usage", "article_type"), k: int = 20, scheme: str = "pipeline", preferences: DataFrame | None = None, current: DataFrame | None = None) -> DataFrame:
    """user_id, token, weight, r: the k heaviest tokens of each user's products, of the styles that the
    user states (preferences: user_id, token) and of the product looked at (current: user_id, product_id)."""
    known = products.select("product_id", F.explode(F.array_compact(F.array(*columns))).alias("token"))
    sums = pair_weights(interactions, scheme).join(known, "product_id").select("user_id", F.lower("token").alias("token"), F.col("w").alias("weight"))
    if preferences is not None:
        sums = sums.unionByName(preferences.select("user_id", F.lower("token").alias("token"), F.lit(V.PREFERENCE_WEIGHT).alias("weight")))
    if current is not None:
        sums = sums.unionByName(current.join(known, "product_id").select("user_id", F.lower("token").alias("token"), F.lit(V.CURRENT_WEIGHT).alias("weight")))
    sums = sums.groupBy("user_id", "token").agg(F.sum("weight").alias("weight"))
    return sums.withColumn("r", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("weight"), "token"))).where(F.col("r") <= k)


def favourite(history: DataFrame, products: DataFrame, column: str, first: int = 10, order=("ts", "l_orderkey", "l_linenumber", "product_id", "interaction_type")) -> DataFrame:
    """user_id, column: the value most frequent among a user's first history items; of equal ones that seen first. Nulls don't count."""
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(*order))
    items = history.withColumn("place", place).where(F.col("place") <= first).join(products.select("product_id", column), "product_id").where(F.col(column).isNotNull())
    counts = items.groupBy("user_id", column).agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("seen"))
    return counts.groupBy("user_id").agg(F.min_by(column, F.struct(-F.col("n"), "seen")).alias(column))


def slots(sub: Column, master: Column) -> Column:
    """All slots that a product belongs to, sorted."""
    s, m = F.lower(F.coalesce(sub, F.lit(""))), F.lower(F.coalesce(master, F.lit("")))
    plain = [F.when(s == name, name) for name in ("topwear", "bottomwear", "dress", "innerwear")]
    both = [F.when((m == "accessories") | s.isin(*V.ACCESSORY_SUBS), "accessory"), F.when((m == "footwear") | s.isin(*V.FOOTWEAR_SUBS), "footwear")]
    return F.sort_array(F.array_compact(F.array(*plain, *both)))


def reason(age: Column, user_gender: Column, product_gender: Column, colour: Column, top_colour: Column, article: Column, season: Column) -> Column:
    """Why a product suits a user: the parts that hold, joined by `; `."""
    said = lambda key, value: F.concat(*[x for part in zip(map(F.lit, V.REASONS[key].split("{}")), (value, None)) for x in part if x is not None])
    mine, its = C.normal_gender(user_gender), C.normal_gender(product_gender)
    parts = [
        F.when(mine.isNotNull() & (its == mine) & its.isin("male", "female"), said("gender", mine)).when(mine.isNotNull() & (its == "unisex"), V.REASONS["unisex"]),
        F.when(age.between(18, 35), V.REASONS["young"]).when(age.between(36, 50), V.REASONS["middle"]).when(age > 50, V.REASONS["old"]),
        F.when(F.lower(colour) == F.lower(top_colour), said("colour", colour)).when(top_colour.isNotNull(), said("colour", top_colour)),
        F.when(F.nullif(article, F.lit("")).isNotNull(), said("article", F.lower(article))),
        F.when(F.nullif(season, F.lit("")).isNotNull(), said("season", F.lower(season))),
    ]
    return F.coalesce(F.nullif(F.concat_ws("; ", *parts), F.lit("")), F.lit(V.REASONS["none"]))


def matched(candidates: DataFrame, style: DataFrame) -> DataFrame:
    """Adds `bonus`, the summed weights of a candidate's tokens in its user's style, and `found`, those
    of positive weight in the order of the tokens. candidates: user_id, product_id, tokens, ...

    Each row of candidates is one group of at most as many rows as it has tokens."""
    at = candidates.select("user_id", "product_id", F.posexplode(F.array_distinct("tokens")).alias("at", "token")).distinct()
    hits = at.join(style.select("user_id", "token", "weight"), ["user_id", "token"])
    found = F.transform(F.sort_array(F.collect_list(F.when(F.col("weight") > 0, F.struct("at", "token")))), lambda x: x["token"])
    by = hits.groupBy("user_id", "product_id").agg(F.sum("weight").alias("bonus"), found.alias("found"))
    none = F.array().cast("array<string>")
    return candidates.join(by, ["user_id", "product_id"], "left").withColumns({"bonus": F.coalesce("bonus", F.lit(0.0)), "found": F.coalesce("found", none)})


def ranked_in_category(candidates: DataFrame, style: DataFrame, category: str) -> DataFrame:
    """user_id, product_id, score, rank of candidates in a category (slot): the base score (0 if null) plus the style bonus."""
    rows = matched(candidates.where(F.col("slot") == category), style)
    rows = rows.select("user_id", "product_id", F.round(F.coalesce("score", F.lit(0.0)) + F.col("bonus"), 9).alias("score"))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("score"), "product_id")))


def selection(candidates: DataFrame, style: DataFrame, k: int) -> DataFrame:
    """user_id, product_id, score, rank, reason: each user's k best, with the first three tokens that match the style."""
    best = matched(top_k(candidates, k), style)
    reason = F.when(F.size("found") > 0, F.concat(F.lit("Similar to your favorite ("), F.array_join(F.slice("found", 1, 3), ", "), F.lit(")"))).otherwise(NO_REASON)
    return best.select("user_id", "product_id", "score", "rank", reason.alias("reason"))


def completion(tag: Column, gender: Column | None = None) -> Column:
    """The categories that complete an outfit: by fixed rules, or, given the user's gender, with dresses
    for women wherever the rules leave them open; an unknown tag needs every other category."""
    t = F.lower(F.trim(tag))
    fixed = C.lookup({k: F.array(*map(F.lit, v)) for k, v in V.COMPLETION.items()}, t)
    if gender is None:
        return fixed
    female = F.coalesce(C.normal_gender(gender) == "female", F.lit(False))
    every = F.array(*map(F.lit, ("tops", "bottoms", "shoes", "accessories")))
    open_ = F.when(t.isin("shoes", "accessories"), F.array(F.lit("tops"), F.lit("bottoms"))).otherwise(F.filter(every, lambda c: c != F.coalesce(t, F.lit(""))))
    more = F.when(female, F.concat(open_, F.array(F.lit("dresses")))).otherwise(open_)
    return F.when(t.isin("tops", "bottoms", "dresses"), fixed).otherwise(F.filter(more, lambda c: c != F.coalesce(t, F.lit(""))))


def category_of(products: DataFrame, catalog: DataFrame, kind: str, name: str) -> DataFrame:
    """Adds `category`: the catalog's for the lower-case kind, else for its slug, else for the first word
    of the name's slug, else the catalog's first, else the kind itself in title case (`Other` without one).
    catalog: key (unique), category, position."""
    k, n = F.lower(F.col(kind)), F.split_part(C.slug(F.col(name), "-"), F.lit("-"), F.lit(1))
    rows = products
    for i, key in enumerate((k, C.slug(F.col(kind), "-"), n)):
        rows = rows.withColumn(f"key_{i}", F.nullif(key, F.lit(""))).join(catalog.select(F.col("key").alias(f"key_{i}"), F.col("category").alias(f"found_{i}")), f"key_{i}", "left")
    first = catalog.agg(F.min_by("category", "position").alias("first"))  # one row
    found = F.coalesce("found_0", "found_1", "found_2", "first", F.initcap(F.col(kind)), F.lit("Other"))
    return rows.join(F.broadcast(first)).withColumn("category", found).drop(*[f"{x}_{i}" for x in ("key", "found") for i in range(3)], "first")


def fallback_product(contexts: DataFrame, products: DataFrame) -> DataFrame:
    """Adds `product_id` to each context: the first product, by id, of an allowed gender and the age
    group, else the first of all. contexts: any columns, with `allowed` (array) and `age_group`;
    products: product_id, gender, age_group, of the wanted category and not used yet."""
    first = products.groupBy("gender", "age_group").agg(F.min("product_id").alias("id"))  # few rows: combined before the shuffle
    shelf = first.agg(F.collect_list(F.struct("gender", "age_group", "id")).alias("shelf"), F.min("id").alias("any"))
    fits = F.filter("shelf", lambda s: F.array_contains("allowed", s["gender"]) & (s["age_group"] == F.col("age_group")))
    return contexts.join(F.broadcast(shelf)).withColumn("product_id", F.coalesce(F.array_min(F.transform(fits, lambda s: s["id"])), "any")).drop("shelf", "any")


def article_label(article: Column) -> Column:
    """The name shown for an article type; `product` for none, other types as they are."""
    return F.when(F.coalesce(article, F.lit("")) == "", "product").otherwise(C.lookup(V.LABELS, F.lower(article), article))


def outfit_reason(current: Column, items: Column) -> Column:
    """What is said of an outfit around a product of article type `current`: colour and name of each item (a struct with
    base_colour and article_type) in order; without items that the outfit is complete."""
    said = F.transform(items, lambda x: F.concat(F.when(F.coalesce(x["base_colour"], F.lit("")) != "", F.concat(F.lower(x["base_colour"]), F.lit(" "))).otherwise(""), article_label(x["article_type"])))
    whole = F.concat(F.lit(V.OUTFIT_REASONS["items"]), article_label(current), F.lit(": "), F.array_join(said, " + "))
    return F.when(F.size(items) > 0, whole).otherwise(F.concat(F.lit(V.OUTFIT_REASONS["none"]), article_label(current)))
