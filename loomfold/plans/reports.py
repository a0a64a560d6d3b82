"""Aggregations, profiling and joins of the reporting side."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomfold.functions import columns as C
from loomfold.plans.catalog import simple
from loomfold.operators import metrics as M
from loomfold.functions import values as V
from loomfold.operators import personal, quantiles, scoring
from loomfold.plans.registry import query
from loomfold.sources import tables as S

QUARTERS = [0.25, 0.5, 0.75]

simple("A06", "select user_id, count(*) filter (interaction_type = 'view') > 0 as view, count(*) filter (interaction_type = 'like') > 0 as like, count(*) filter (interaction_type = 'purchase') > 0 as purchase from interactions group by 1",
       lambda i: i.groupBy("user_id").agg(*[(F.count_if(F.col("interaction_type") == t) > 0).alias(t) for t in ("view", "like", "purchase")]), S.interactions)
COLUMNS = ("product_id", "name", "article_type", "sub_category", "master_category", "base_colour", "gender", "usage", "year", "price", "rating", "num_reviews", "sale", "created_day", "brand")
simple("A07", " union all ".join(f"select '{c}' as column_name, round(1 - count({c}) / count(*), 6) as fraction from products" for c in COLUMNS),
       lambda p: p.agg(*[F.round(1 - F.count(c) / F.count(F.lit(1)), 6).alias(c) for c in p.columns]).select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("fraction")) for c in p.columns]))).orderBy(F.desc("fraction"), "column_name"))
simple("A08", "select count(price) as n, round(avg(price), 6) as mean, round(stddev_samp(price), 6) as std, min(price) as low, quantile_cont(price, 0.25) as q1, quantile_cont(price, 0.5) as q2, quantile_cont(price, 0.75) as q3, max(price) as high from products",
       lambda p: p.agg(F.count("price").alias("n"), F.round(F.avg("price"), 6).alias("mean"), F.round(F.stddev_samp("price"), 6).alias("std"), F.min("price").alias("low"), *[F.lit(x).alias(n) for x, n in zip(quantiles.exact(p, "price", QUARTERS), ("q1", "q2", "q3"))], F.max("price").alias("high")))
simple("A09", "select coalesce(usage, 'N/A') as usage, count(*) as n from products group by 1 order by n desc, usage limit 10", lambda p: p.groupBy(F.coalesce("usage", F.lit("N/A")).alias("usage")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "usage").limit(10))
_bin = "greatest(cast(ceil((price - low) / (high - low) * 10) as integer), 1)"


@query("A10", f"select {_bin} as bin, count(*) as n from products, (select min(price) as low, max(price) as high from products) group by 1")
def histogram(spark, d):
    p = S.products(spark, d).select("price")
    bounds = p.agg(F.min("price").alias("low"), F.max("price").alias("high"))
    at = F.greatest(F.ceil((F.col("price") - F.col("low")) / F.nullif(F.col("high") - F.col("low"), F.lit(0.0)) * 10), F.lit(1))
    return p.join(F.broadcast(bounds)).groupBy(at.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


simple("A11", "select least(cast(floor((x + 1) * 10) as integer), 19) as bin, count(*) as n, round(count(*) * 100.0 / sum(count(*)) over (), 6) as percent from (select rating / 2.5 - 1 as x from products) group by 1",
       lambda p: p.groupBy(F.least(F.floor((F.col("rating") / 2.5 - 1 + 1) * 10).cast("int"), F.lit(19)).alias("bin")).agg(F.count(F.lit(1)).alias("n")).withColumn("percent", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()), 6)))
simple("A12", "select count(*) as total, min(value) as low, max(value) as high, round(avg(value), 6) as mean, round(stddev_pop(value), 6) as std from event_rows", lambda e: e.agg(F.count(F.lit(1)).alias("total"), F.min("value").alias("low"), F.max("value").alias("high"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_pop("value"), 6).alias("std")), S.events)
simple("A13", "select round(quantile_cont(value, 0.25), 6) as q1, round(quantile_cont(value, 0.5), 6) as q2, round(quantile_cont(value, 0.75), 6) as q3 from event_rows", lambda e: e.sparkSession.createDataFrame([tuple(round(x, 6) for x in quantiles.exact(e, "value", QUARTERS))], "q1 double, q2 double, q3 double"), S.events)
simple("A14", "select min(n) as low, max(n) as high, round(avg(n), 6) as mean, quantile_cont(n, 0.5) as middle, round(stddev_pop(n), 6) as std from (select user_id, count(*) as n from interactions group by 1)", lambda i: i.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).agg(F.min("n").alias("low"), F.max("n").alias("high"), F.round(F.avg("n"), 6).alias("mean"), F.percentile("n", F.lit(0.5)).alias("middle"), F.round(F.stddev_pop("n"), 6).alias("std")), S.interactions)
simple("A15", "select min(value) as low, max(value) as high from event_rows", lambda e: e.agg(F.min("value").alias("low"), F.max("value").alias("high")), S.events)
simple("A16", "select count(distinct user_id) as users, count(distinct product_id) as products from interactions", lambda i: i.agg(F.count_distinct("user_id").alias("users"), F.count_distinct("product_id").alias("products")), S.interactions)
simple("A17", "select interaction_type, count(*) as n from event_rows group by 1", lambda e: e.groupBy("interaction_type").agg(F.count(F.lit(1)).alias("n")), S.events)
simple("A19", "select l_partkey, sum(l_quantity) as stock from lineitem group by 1", lambda l: l.groupBy("l_partkey").agg(F.sum("l_quantity").alias("stock")), lambda s, d: S.table(s, d, "lineitem"))


@query("A18", "select product_id, round(coalesce(avg(l_quantity / 10), 0), 6) as rating, count(l_quantity) as n from products left join lineitem on l_partkey = cast(product_id as bigint) and l_linenumber = 1 group by 1")
def reviews(spark, d):
    lines = S.table(spark, d, "lineitem").where("l_linenumber = 1").groupBy(F.col("l_partkey").cast("string").alias("product_id")).agg(F.avg(F.col("l_quantity") / 10).alias("rating"), F.count(F.lit(1)).alias("n"))
    return S.products(spark, d).select("product_id").join(lines, "product_id", "left").select("product_id", F.round(F.coalesce("rating", F.lit(0.0)), 6).alias("rating"), F.coalesce("n", F.lit(0)).alias("n"))


@query("A20", "select user_id, count(o_orderkey) filter (o_orderstatus = 'F') as paid, count(o_orderkey) filter (o_orderstatus = 'F') > 0 as buyer from users left join orders on cast(o_custkey as varchar) = user_id group by 1")
def paid_orders(spark, d):
    paid = S.table(spark, d, "orders").where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").cast("string").alias("user_id")).agg(F.count(F.lit(1)).alias("paid"))
    return S.users(spark, d).select("user_id").join(paid, "user_id", "left").select("user_id", F.coalesce("paid", F.lit(0)).alias("paid"), F.col("paid").isNotNull().alias("buyer"))


simple("A21", "select master_category, sub_category, string_agg(distinct article_type, ',' order by article_type) as articles from products group by 1, 2", lambda p: p.groupBy("master_category", "sub_category").agg(F.array_join(F.sort_array(F.collect_set("article_type")), ",").alias("articles")))
simple("A23", "select product_id, sum(w) as weight from weighted group by 1", lambda i: i.withColumn("w", C.weight(F.col("interaction_type"))).groupBy("product_id").agg(F.sum("w").alias("weight")), S.interactions)


@query("A24", "select user_id, d, coalesce(x, 0.0) as x from (select user_id from users union select user_id from weighted) cross join (select distinct d from v) left join (select user_id, d, round(sum(e * w) / sum(w), 6) as x from weighted join v using (product_id) group by 1, 2) using (user_id, d)",
       "v as (select cast(vec_id as varchar) as product_id, unnest(embedding) as e, generate_subscripts(embedding, 1) - 1 as d from embeddings)")
def mean_embedding(spark, d):
    """All dimensions; a user without a known product has the zero vector."""
    vectors = S.table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("product_id"), F.posexplode("embedding").alias("d", "e"))
    pairs = S.interactions(spark, d).withColumn("w", C.weight(F.col("interaction_type"))).groupBy("user_id", "product_id").agg(F.sum("w").alias("w"))
    means = pairs.join(vectors, "product_id").groupBy("user_id", "d").agg(F.round(F.sum(F.col("e") * F.col("w")) / F.sum("w"), 6).alias("x"))
    users = S.users(spark, d).select("user_id").union(pairs.select("user_id")).distinct()
    each = users.crossJoin(F.broadcast(vectors.select("d").distinct()))
    return each.join(means, ["user_id", "d"], "left").select("user_id", F.col("d").cast("long").alias("d"), F.coalesce("x", F.lit(0.0)).alias("x"))


FAVOURITE = """favourite as (select user_id, base_colour from (select user_id, base_colour, row_number() over (partition by user_id order by count(*) desc, min(place)) as r from (
  select user_id, product_id, row_number() over (partition by user_id order by ts, l_orderkey, l_linenumber, product_id, interaction_type) as place from interactions) join products using (product_id) where place <= 10 and base_colour is not null group by 1, 2) where r = 1)"""


@query("A25", "select user_id, base_colour from favourite", FAVOURITE)
def favourite_colour(spark, d):
    return personal.favourite(S.interactions(spark, d), S.products(spark, d), "base_colour")


_R = {k: v.replace("'", "''") for k, v in V.REASONS.items()}
_ITS = "case when p.gender in ('Men', 'Boys') then 'male' when p.gender in ('Women', 'Girls') then 'female' when p.gender = 'Unisex' then 'unisex' end"
_MINE = "case when u.gender in ('male', 'female') then u.gender end"
_said = lambda key, value: "'" + _R[key].replace("{}", f"' || {value} || '") + "'"


@query("S15", f"""select user_id, product_id, coalesce(nullif(concat_ws('; ',
  case when {_MINE} = {_ITS} then {_said("gender", _MINE)} when {_MINE} is not null and {_ITS} = 'unisex' then '{_R["unisex"]}' end,
  case when age between 18 and 35 then '{_R["young"]}' when age between 36 and 50 then '{_R["middle"]}' when age > 50 then '{_R["old"]}' end,
  case when lower(p.base_colour) = lower(f.base_colour) then {_said("colour", "p.base_colour")} when f.base_colour is not null then {_said("colour", "f.base_colour")} end,
  {_said("article", "lower(nullif(article_type, ''))")}, case when year % 2 = 0 then {_said("season", "'summer'")} end), ''), '{_R["none"]}') as reason
from (select * from (select user_id, product_id, row_number() over (partition by user_id order by sum(w) desc, product_id) as r from weighted group by 1, 2) where r <= 6) t
join users u using (user_id) join products p using (product_id) left join favourite f using (user_id)""", FAVOURITE)
def reasons(spark, d):
    """Why each user's six best products suit them; even years stand for summer."""
    best = scoring.top_k(scoring.pair_weights(S.interactions(spark, d)).select("user_id", "product_id", F.col("w").alias("score")), 6).select("user_id", "product_id")
    users = S.users(spark, d).select("user_id", "age", F.col("gender").alias("mine"))
    rows = best.join(users, "user_id").join(S.products(spark, d), "product_id").join(favourite_colour(spark, d).withColumnRenamed("base_colour", "top_colour"), "user_id", "left")
    season = F.when(F.col("year") % 2 == 0, "Summer")
    return rows.select("user_id", "product_id", personal.reason(F.col("age"), F.col("mine"), F.col("gender"), F.col("base_colour"), F.col("top_colour"), F.col("article_type"), season).alias("reason"))


# results of three models, drawn from the interactions of one type each
RESULTS = """results as (select case interaction_type when 'view' then 'cbf' when 'like' then 'gnn' else 'hybrid' end as model, round(count(distinct user_id) / count(*), 6) as ndcg_10, round(count(distinct product_id) / count(*), 6) as ndcg_20,
  round(sum(l_linenumber) / count(*) / 10, 6) as diversity, round(count(distinct product_id) / (select count(*) from products), 6) as coverage, cast(count(*) % 97 as double) as inference_time from interactions group by 1)"""
LONG = "select model, 'ndcg' as metric, 10 as k, ndcg_10 as value from results union all select model, 'ndcg', 20, ndcg_20 from results"


def model_results(spark, d):
    i, n = S.interactions(spark, d), S.products(spark, d).agg(F.count(F.lit(1)).alias("n"))
    model = F.when(F.col("interaction_type") == "view", "cbf").when(F.col("interaction_type") == "like", "gnn").otherwise("hybrid")
    rows, users, products = F.count(F.lit(1)), F.count_distinct("user_id"), F.count_distinct("product_id")
    got = i.groupBy(model.alias("model")).agg(F.round(users / rows, 6).alias("ndcg_10"), F.round(products / rows, 6).alias("ndcg_20"), F.round(F.sum("l_linenumber") / rows / 10, 6).alias("diversity"), products.alias("p"), (rows % 97).cast("double").alias("inference_time"))
    return got.join(F.broadcast(n)).select("model", "ndcg_10", "ndcg_20", "diversity", F.round(F.col("p") / F.col("n"), 6).alias("coverage"), "inference_time")


def long_results(spark, d):
    """model, metric, k, value."""
    wide = model_results(spark, d)
    return wide.select("model", F.inline(F.array(*[F.struct(F.lit("ndcg").alias("metric"), F.lit(k).alias("k"), F.col(f"ndcg_{k}").alias("value")) for k in (10, 20)])))


_H = "(select {0} from results where model = '{1}')"
_FLAGS = {f"best_ndcg_{k}": f"{_H.format(f'ndcg_{k}', 'hybrid')} >= (select max(ndcg_{k}) from results where model <> 'hybrid')" for k in (10, 20)}
_FLAGS |= {"more_diverse": f"{_H.format('diversity', 'hybrid')} > {_H.format('diversity', 'gnn')}", "wider": f"{_H.format('coverage', 'hybrid')} > {_H.format('coverage', 'gnn')}"}
_FLAGS["balanced"] = f"{_FLAGS['best_ndcg_10']} and {_FLAGS['more_diverse']}"
_BEST = [f"select '{m}' as metric, model, {m} as value from (select * from results order by {m} desc, model limit 1)" for m in ("ndcg_10", "ndcg_20", "diversity", "coverage")]
_BEST.append("select 'inference_time', model, inference_time from (select * from results order by case when inference_time > 0 then inference_time else 'infinity' end, model limit 1)")


@query("A26", " union all ".join(_BEST + [f"select '{n}', 'hybrid', cast({c} as double)" for n, c in _FLAGS.items()]), RESULTS)
def best_models(spark, d):
    """Best model of each metric, then the verdicts on the hybrid (1 or 0)."""
    rows = model_results(spark, d)
    said = M.verdicts(rows)
    flags = said.select(F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.lit("hybrid").alias("model"), F.col(c).cast("double").alias("value")) for c in said.columns])))
    return M.best_models(rows).unionByName(flags)


@query("SNK07", "select model, case when model = 'hybrid' then ndcg_10 + 1 else ndcg_10 end as score from results", RESULTS)
def upsert_result(spark, d):
    old = model_results(spark, d).select("model", F.col("ndcg_10").alias("score"))
    return S.upsert(old, old.where("model = 'hybrid'").withColumn("score", F.col("score") + 1), "model")


@query("J07", "select count(*) as n from interactions where user_id in (select user_id from users where segment = 'BUILDING')")
def semi(spark, d):
    users = S.users(spark, d).where("segment = 'BUILDING'").select("user_id")
    return S.interactions(spark, d).join(users, "user_id", "left_semi").agg(F.count(F.lit(1)).alias("n"))


@query("J08", "select product_id from products where product_id <> '3' and product_id not in (select product_id from interactions where user_id = '7')")
def anti(spark, d):
    seen = S.interactions(spark, d).where("user_id = '7'").select("product_id").union(spark.createDataFrame([("3",)], "product_id string"))
    return S.products(spark, d).select("product_id").join(seen, "product_id", "left_anti")


@query("J05", "select product_id, article_type, n from (select product_id, count(*) as n from interactions group by 1) join products using (product_id)")
def enrich(spark, d):
    counts = S.interactions(spark, d).groupBy("product_id").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(S.products(spark, d), "product_id").select("product_id", "article_type", "n")


@query("J06", "select e.product_id, coalesce(p.name, e.name) as name, p.product_id is not null as enriched from (select distinct product_id, 'item ' || product_id as name from event_rows) e left join products p using (product_id)")
def enrich_left(spark, d):
    """The whole catalog row where there is one, else what the recommendation says itself."""
    base = S.events(spark, d).select("product_id", F.concat(F.lit("item "), "product_id").alias("base_name")).distinct()
    full = S.products(spark, d).select("product_id", "name")
    return base.join(full, "product_id", "left").select("product_id", F.coalesce("name", "base_name").alias("name"), F.col("name").isNotNull().alias("enriched"))


@query("J12", "select o_orderkey, string_agg(cast(l_partkey as varchar), ',' order by l_linenumber, l_partkey) as parts from orders left join lineitem on o_orderkey = l_orderkey group by 1")
def nested(spark, d):
    lines = S.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey")
    parts = F.transform(F.sort_array(F.collect_list(F.when(F.col("l_partkey").isNotNull(), F.struct("l_linenumber", "l_partkey")))), lambda x: x["l_partkey"].cast("string"))
    return S.table(spark, d, "orders").select("o_orderkey").join(lines, "o_orderkey", "left").groupBy("o_orderkey").agg(F.nullif(F.array_join(parts, ","), F.lit("")).alias("parts"))


@query("J14", "select c_mktsegment, count(*) as n, round(sum(o_totalprice), 2) as total from orders join customer on o_custkey = c_custkey group by 1")
def orders_users(spark, d):
    return S.table(spark, d, "orders").join(S.table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("J18", "select (select count(*) from (select product_id from products intersect select product_id from event_rows)) as both, (select count(*) from (select product_id from products except select product_id from event_rows)) as left_only, (select count(*) from (select product_id from event_rows except select product_id from products)) as right_only")
def reconcile(spark, d):
    a, b = S.products(spark, d).select("product_id", F.lit(True).alias("l")), S.events(spark, d).select("product_id").distinct().withColumn("r", F.lit(True))
    return a.join(b, "product_id", "full").agg(F.count_if(F.col("l") & F.col("r")).alias("both"), F.count_if(F.col("r").isNull()).alias("left_only"), F.count_if(F.col("l").isNull()).alias("right_only"))


@query("J20", "select product_id, coalesce(w, rating, 0.0) as score from products left join (select product_id, sum(w) as w from weighted where user_id = '5' group by 1) using (product_id)")
def score_fallback(spark, d):
    own = S.interactions(spark, d).where("user_id = '5'").withColumn("w", C.weight(F.col("interaction_type"))).groupBy("product_id").agg(F.sum("w").alias("w"))
    return S.products(spark, d).join(own, "product_id", "left").select("product_id", F.coalesce("w", "rating", F.lit(0.0)).alias("score"))
