"""Catalog queries: facets, search, sorting, pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomfold.functions import columns as C

SORTS = {"price_low_to_high": ("price",), "price_high_to_low": ("-price",), "newest": ("-created_day",), "oldest": ("created_day",), "rating": ("-rating", "-num_reviews")}


def facets(df: DataFrame, **wanted: str | None) -> DataFrame:
    """Case-insensitive equality on each facet that is supplied."""
    for name, value in wanted.items():
        if value:
            df = df.where(C.same_text(F.col(name), value))
    return df


def number(text: object) -> float | None:
    try:
        return float(str(text))
    except ValueError:
        return None


def between(df: DataFrame, column: str, low: object = None, high: object = None) -> DataFrame:
    """Range with inclusive bounds; a bound that isn't a number is ignored."""
    if low is not None and (x := number(low)) is not None:
        df = df.where(F.col(column) >= x)
    if high is not None and (x := number(high)) is not None:
        df = df.where(F.col(column) <= x)
    return df


def search(df: DataFrame, term: str, *columns: str, id_column: str | None = None) -> DataFrame:
    """Rows with the term, literally and in any case, in one of the columns, or as the id if it is digits."""
    found = F.lit(False)
    for c in columns:
        found = found | F.coalesce(C.contains(F.col(c), term), F.lit(False))
    if id_column and term.isdigit():
        found = found | (F.col(id_column) == term)
    return df.where(found)


def ordering(*keys: str, last: str = "product_id") -> list[Column]:
    """`-name` descends; nulls last; the id decides ties."""
    order = [F.desc_nulls_last(k[1:]) if k.startswith("-") else F.asc_nulls_last(k) for k in keys]
    return [*order, F.col(last)]


def page(df: DataFrame, order: Sequence[Column], number: int = 1, size: int = 20) -> DataFrame:
    """One page, its number held within [1, pages]; with rank, total and pages. The first pages are
    found by a limit, so no global sort of the table is made."""
    total = df.count()
    pages = max(-(-total // size), 1)
    at = min(max(number, 1), pages)
    cut = df.orderBy(*order).limit(at * size)
    ranked = cut.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    return ranked.where(F.col("rank") > (at - 1) * size).withColumns({"page": F.lit(at), "total": F.lit(total).cast("long"), "pages": F.lit(pages)})


def first_match(df: DataFrame, *tests: Column) -> DataFrame:
    """Rows of the first test that any row passes; all rows if none does."""
    level = F.lit(len(tests))
    for i in range(len(tests) - 1, -1, -1):
        level = F.when(tests[i], i).otherwise(level)
    marked = df.withColumn("level", level)
    least = marked.agg(F.min("level").alias("least"))
    return marked.join(F.broadcast(least)).where(F.col("level") == F.col("least")).drop("level", "least")


def top_pool(products: DataFrame, n: int = 10) -> DataFrame:
    """What n top products are drawn from: the first 3n (at least n, n from 1 to 50) with reviews, by
    rating, reviews and newness; if these are fewer than n, the best of the rest by reviews, rating and newness fill up to 3n."""
    n = max(1, min(n, 50))
    reviewed = products.where("num_reviews > 0").orderBy(F.desc("rating"), F.desc("num_reviews"), F.desc("created_day"), "product_id").limit(3 * n)
    rest = products.where("coalesce(num_reviews, 0) <= 0").orderBy(F.desc("num_reviews"), F.desc("rating"), F.desc("created_day"), "product_id")
    have = reviewed.count()  # at most 150
    return reviewed if have >= n else reviewed.unionByName(rest.limit(3 * n - have))


def top_products(products: DataFrame, n: int = 10, seed: int = 0) -> DataFrame:
    """n of the pool, drawn by a seeded shuffle."""
    return top_pool(products, n).orderBy(F.rand(seed)).limit(max(1, min(n, 50)))


def match_stores(left: DataFrame, right: DataFrame, group=("category", "gender", "age_group"), most: float = 1000.0) -> DataFrame:
    """id, other, step: for each product of one store that of the other with its slug, else with its name
    and a price under a cent apart, else with its name, else with the nearest price of its group, if
    less than `most` apart; of equal ones the least id. Both: id, slug, name, price and the group columns.

    Prices are compared by cent keys and by the neighbours among a group's distinct prices: no pairs of a group are made."""
    by_slug = right.where("slug is not null").groupBy("slug").agg(F.min("id").alias("by_slug"))
    by_name = right.where("name is not null").groupBy("name").agg(F.min("id").alias("by_name"))
    cent = F.floor(F.col("price") * 100)
    near = left.select("id", "name", "price", F.explode(F.array(cent - 1, cent, cent + 1)).alias("cent"))
    same = right.groupBy("name", "price").agg(F.min("id").alias("other_id")).select(F.col("name").alias("other_name"), F.col("price").alias("other_price"), F.floor(F.col("price") * 100).alias("other_cent"), "other_id")
    near = near.join(same, (F.col("name") == F.col("other_name")) & (F.col("cent") == F.col("other_cent"))).where(F.abs(F.col("price") - F.col("other_price")) < 0.01)
    by_price = near.groupBy("id").agg(F.min("other_id").alias("by_name_price"))
    groups = list(group)
    levels = right.groupBy(*groups, "price").agg(F.min("id").alias("least")).withColumn("level", F.struct("price", "least"))
    asked = left.select(*groups, "price").distinct()
    both = asked.join(levels, [*groups, "price"], "full")
    # both frames begin at the first row, so each is a running value
    below, above = (F.last("level", ignorenulls=True).over(Window.partitionBy(*groups).orderBy(o).rowsBetween(Window.unboundedPreceding, 0)) for o in (F.asc("price"), F.desc("price")))
    sides = F.array(*[F.struct(F.abs(F.col("price") - F.col(f"{s}.price")).alias("gap"), F.col(f"{s}.least").alias("other")) for s in ("below", "above")])
    nearest = both.withColumns({"below": below, "above": above}).withColumn("best", F.array_min(F.filter(sides, lambda x: x["other"].isNotNull() & (x["gap"] < most))))
    nearest = nearest.where("best is not null").select(*groups, "price", F.col("best.other").alias("by_gap"))
    rows = left.join(by_slug, "slug", "left").join(by_price, "id", "left").join(by_name, "name", "left").join(nearest, [*groups, "price"], "left")
    steps = ("by_slug", "by_name_price", "by_name", "by_gap")
    step = F.coalesce(*[F.when(F.col(s).isNotNull(), s) for s in steps])
    return rows.select("id", F.coalesce(*steps).alias("other"), step.alias("step")).where("other is not null")


def bounded_pick(products: DataFrame, group: str, picks: int, limit: int = 10) -> DataFrame:
    """group, outfit_index, product_id: from each group's `limit` best by score, else by a fifth of the
    rating, the one at each index, or the last for indexes beyond them."""
    order = Window.partitionBy(group).orderBy(F.desc(F.coalesce(F.col("score"), F.col("rating") / 5)), "product_id")
    best = products.withColumn("r", F.row_number().over(order)).where(F.col("r") <= limit)
    best = best.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(group))).withColumn("outfit_index", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(picks - 1).cast("long"))))
    return best.where(F.col("r") == F.least(F.col("outfit_index") + 1, F.col("n"))).select(group, "outfit_index", "product_id")
