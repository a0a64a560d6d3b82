"""Further operators: histories, artifacts, dimension lookups, outfit pairs, graded metrics, seeded variants."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomfold.functions import columns as C
from loomfold.functions import literals as L
from loomfold.functions import values as V
from loomfold.operators import catalog as K
from loomfold.operators import metrics as M
from loomfold.operators import outfits as O
from loomfold.operators import personal, scoring
from loomfold.operators import textvectors as T
from loomfold.plans.catalog import KEY_SQL, LABELS_SQL, simple
from loomfold.plans.models import SHELVES, drawn
from loomfold.plans.recommend import CONTENT, TRUTH, _ranking
from loomfold.plans.registry import query
from loomfold.sources import artifacts as A
from loomfold.sources import tables as S
from loomfold.sources.scratch import materialise

HISTORY = "array<struct<k:int>>"


def _running():
    return Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)


# a user's history as a cell of Python literals: texts in either quotes, escapes, times, ids, nested values, and parts that are none
def _cells(rows):
    """user_id, cell: literals of a user's interactions, in the forms of repr, by time."""
    k = F.col("l_orderkey")
    name = F.when(k % 3 == 0, F.concat(F.lit('"it\'s; '), "product_id", F.lit('"'))).when(k % 3 == 1, F.concat(F.lit("'say \\\"\\x41\\u00e9\\\" "), "product_id", F.lit("'"))).otherwise(F.concat(F.lit("'plain ' 'p"), "product_id", F.lit("'")))
    at = F.date_format("ts", "'datetime.datetime('yyyy, M, d, 0, 5, 9')'")
    said = F.concat(F.lit("{'product_id': '"), "product_id", F.lit("', \"name\": "), name, F.lit(", 'at': "), at, F.lit(", 'more': [None, (True, -1.5e3), {'id': ObjectId('"), k.cast("string"), F.lit("')}],}"))
    part = F.when(k % 7 == 0, F.concat(F.lit("{'broken': "), "product_id", F.lit("..}"))).otherwise(said)
    ordered = F.sort_array(F.collect_list(F.struct("ts", "l_orderkey", "l_linenumber", part.alias("part"))))
    return rows.groupBy("user_id").agg(F.array_join(F.transform(ordered, lambda x: x["part"]), " ; ").alias("cell"))


PARSED = "array<struct<product_id:string,name:string,at:string,more:array<string>>>"
_NAMED = """case l_orderkey % 3 when 0 then 'it''s; ' || product_id when 1 then 'say "A' || chr(233) || '" ' || product_id else 'plain p' || product_id end"""


@query("JS03", f"""select user_id, l_orderkey, product_id, {_NAMED} as name, year(ts) || '-' || month(ts) || '-' || day(ts) || ' 0:5:9' as at, '{{"id":"' || l_orderkey || '"}}' as last from interactions where l_orderkey % 7 <> 0""")
def literal_histories(spark, d):
    """Each interaction that stands as a literal in its user's cell."""
    found = _cells(S.interactions(spark, d)).select("user_id", F.inline(F.from_json(L.histories(F.col("cell")), PARSED)))
    last = F.element_at("more", -1)
    return found.select("user_id", F.get_json_object(last, "$.id").cast("long").alias("l_orderkey"), "product_id", "name", "at", last.alias("last"))


@query("SRC05", "select user_id, count(i.user_id) filter (l_orderkey % 7 <> 0) as n, max(product_id) filter (l_orderkey % 7 <> 0) as greatest from users left join interactions i using (user_id) group by 1")
def users_with_histories(spark, d):
    """Users from a CSV file, whose history cells hold Python literals."""
    path = A.path(spark, "csv-literal-users")
    users = S.users(spark, d).join(_cells(S.interactions(spark, d)), "user_id", "left")
    S.write_csv(users.select(F.col("user_id").alias("id"), "name", F.lit(None).cast("string").alias("email"), "age", "gender", F.col("cell").alias("interaction_history")), path)
    read = S.read_csv(spark, path, S.USERS).withColumn("parsed_interactions", F.from_json(L.histories(F.col("interaction_history")), PARSED))
    return read.select(F.col("id").alias("user_id"), F.size("parsed_interactions").cast("long").alias("n"), F.array_max(F.transform("parsed_interactions", lambda x: x["product_id"])).alias("greatest"))




@query("J10", "select user_id, a.product_id as first, b.product_id as second from ranking a join ranking b using (user_id) where a.rank < b.rank and a.rank <= 10 and b.rank <= 10", CONTENT)
def pairs(spark, d):
    """The at most 45 pairs of each user's ten best, made within the user's row."""
    top = _ranking(spark, d).where("rank <= 10").groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("rank", "product_id"))).alias("items"))
    pair = F.explode(C.combinations(F.transform("items", lambda x: x["product_id"]), 2))
    return top.select("user_id", pair.alias("p")).select("user_id", F.col("p")[0].alias("first"), F.col("p")[1].alias("second"))


@query("J13", "select product_id, coalesce(c.first_id, 'none') as colour_of from products left join (select base_colour, min(product_id) as first_id from products where base_colour <> 'red' group by 1) c using (base_colour)")
def dimension_fallback(spark, d):
    p = S.products(spark, d)
    colours = p.where("base_colour != 'red'").groupBy("base_colour").agg(F.min("product_id").alias("first_id"))
    return p.join(colours, "base_colour", "left").select("product_id", F.coalesce("first_id", F.lit("none")).alias("colour_of"))


@query("J15", """select o_orderkey, o_orderstatus as status, result, coalesce(logs, '') as logs from orders left join (select l_orderkey as o_orderkey, min(cast(l_partkey as varchar)) as result,
  string_agg(l_linenumber || ':' || l_returnflag, ';' order by l_linenumber, l_returnflag) as logs from lineitem where l_linenumber > 1 group by 1) using (o_orderkey)""")
def requests_logs(spark, d):
    """Orders as requests, each with its one result and its collected log lines; some have neither."""
    lines = S.table(spark, d, "lineitem").where("l_linenumber > 1").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").cast("string").alias("product_id"), "l_linenumber", "l_returnflag")
    result = lines.groupBy("o_orderkey").agg(F.min("product_id").alias("result"))
    ordered = F.sort_array(F.collect_list(F.struct("l_linenumber", "l_returnflag")))
    logs = lines.groupBy("o_orderkey").agg(F.array_join(F.transform(ordered, lambda x: F.concat_ws(":", x["l_linenumber"].cast("string"), x["l_returnflag"])), ";").alias("logs"))
    asked = S.table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"))
    return asked.join(result, "o_orderkey", "left").join(logs, "o_orderkey", "left").select("o_orderkey", "status", "result", F.coalesce("logs", F.lit("")).alias("logs"))


@query("J16", "select user_id, product_id from (select user_id, unnest(favorites) as product_id from (select user_id, [cast(cast(user_id as bigint) % 7 as varchar), 'gone', user_id] as favorites from users)) where product_id in (select product_id from products)")
def favourites(spark, d):
    mine = S.users(spark, d).select("user_id", F.explode(F.array((F.col("user_id").cast("bigint") % 7).cast("string"), F.lit("gone"), F.col("user_id"))).alias("product_id"))
    return mine.join(S.products(spark, d).select("product_id"), "product_id", "left_semi").select("user_id", "product_id")


STORES = """here as (select product_id as id, case when k % 5 = 0 then 's' || k end as slug, name, price, article_type as category, gender, case when gender in ('Boys', 'Girls') then 'kid' else 'adult' end as age_group from (select *, cast(product_id as bigint) as k from products)),
there as (select 'b' || product_id as id, case when k % 3 = 0 then 's' || k end as slug, case when k % 2 = 0 then name end as name, price + case when k % 4 = 0 then 0 else k % 11 end as price, article_type as category, gender, case when gender in ('Boys', 'Girls') then 'kid' else 'adult' end as age_group from (select *, cast(product_id as bigint) as k from products) where k % 7 <> 0)"""


@query("J17", """select id, other, ['by_slug', 'by_name_price', 'by_name', 'by_gap'][step] as step from (select a.id, b.id as other, step, row_number() over (partition by a.id order by step, case when step = 4 then abs(a.price - b.price) end, b.id) as r
from here a join there b on a.slug = b.slug or a.name = b.name or a.category = b.category and a.gender = b.gender and a.age_group = b.age_group,
  lateral (select case when a.slug = b.slug then 1 when a.name = b.name and abs(a.price - b.price) < 0.01 then 2 when a.name = b.name then 3 when a.category = b.category and a.gender = b.gender and a.age_group = b.age_group and abs(a.price - b.price) < 1000 then 4 end as step) where step is not null) where r = 1""", STORES)
def match_stores(spark, d):
    """The catalog against a second store with other slugs, names and prices."""
    k = F.col("product_id").cast("bigint")
    kept = [F.col("article_type").alias("category"), "gender", F.when(F.col("gender").isin("Boys", "Girls"), "kid").otherwise("adult").alias("age_group")]
    slug = F.concat(F.lit("s"), k.cast("string"))
    here = S.products(spark, d).select(F.col("product_id").alias("id"), F.when(k % 5 == 0, slug).alias("slug"), "name", "price", *kept)
    there = S.products(spark, d).where(k % 7 != 0).select(F.concat(F.lit("b"), "product_id").alias("id"), F.when(k % 3 == 0, slug).alias("slug"), F.when(k % 2 == 0, F.col("name")).alias("name"), (F.col("price") + F.when(k % 4 == 0, 0).otherwise(k % 11)).alias("price"), *kept)
    return K.match_stores(here, there)


_OUTFITS = f"outfit_totals as (select cast(product_id as bigint) // 5 as outfit_id, sum(cast(round(rating * 100) as bigint)) as hundredths, sum(cast(round(rating * 100) as bigint)) / 100 as score, round(count(distinct {KEY_SQL}) filter ({KEY_SQL} in ('accessories','bottomwear','footwear','topwear')) / 4, 6) as completeness from products group by 1)"


# the mean of hundredths, rounded half up by whole numbers: the same in any order of addition
@query("A29", "select outfit_id, score, completeness, (200 * (select sum(hundredths) from outfit_totals) + (select count(*) from outfit_totals)) // (2 * (select count(*) from outfit_totals)) / 10000 as mean_score from outfit_totals", _OUTFITS)
def outfit_scores(spark, d):
    slot = C.lookup(V.CATEGORY_KEYS, F.col("sub_category"))
    hundredths = F.round(F.col("rating") * 100).cast("long")
    rows = S.products(spark, d).select(F.floor(F.col("product_id").cast("bigint") / 5).alias("outfit_id"), hundredths.alias("hundredths"), F.when(slot.isin(*V.SLOTS), slot).alias("slot"))
    each = rows.groupBy("outfit_id").agg(F.sum("hundredths").alias("hundredths"), F.round(F.count_distinct("slot") / 4, 6).alias("completeness"))
    n, total = F.count(F.lit(1)), F.sum("hundredths")
    mean = each.agg((F.floor((200 * total + n) / (2 * n)) / 10000).alias("mean_score"))  # one row
    return each.join(F.broadcast(mean)).select("outfit_id", (F.col("hundredths") / 100).alias("score"), "completeness", "mean_score")


simple("W14", "select sub_category, t, product_id from (select sub_category, product_id, row_number() over (partition by sub_category order by rating desc, product_id) - 1 as place, count(*) over (partition by sub_category) as n from products), generate_series(1, 5) g(t) where place = (t - 1) % n",
       lambda p: p.withColumn("place", F.row_number().over(Window.partitionBy("sub_category").orderBy(F.desc("rating"), "product_id")) - 1).where("place < 5").withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("sub_category"))).withColumn("t", F.explode(F.sequence(F.lit(1), F.lit(5)))).where(F.col("place") == F.pmod(F.col("t") - 1, F.col("n"))).select("sub_category", "t", "product_id"))
simple("W15", "select product_id from products order by rating desc, product_id limit 10", lambda p: p.orderBy(F.desc("rating"), "product_id").limit(10).select("product_id"))
_sub, _master = "lower(coalesce(sub_category, ''))", "lower(coalesce(master_category, ''))"
simple("S09", f"""select product_id, array_to_string(list_sort(list_filter([{", ".join(f"case when {_sub} = '{n}' then '{n}' end" for n in ("topwear", "bottomwear", "dress", "innerwear"))},
  case when {_master} = 'accessories' or {_sub} in {V.ACCESSORY_SUBS} then 'accessory' end, case when {_master} = 'footwear' or {_sub} in {V.FOOTWEAR_SUBS} then 'footwear' end], lambda x: x is not null)), ',') as slots from products""",
       lambda p: p.select("product_id", F.array_join(personal.slots(F.col("sub_category"), F.col("master_category")), ",").alias("slots")))
_NAMED_ITEM = f"""case when coalesce(article_type, '') = '' then 'product' else coalesce({LABELS_SQL}[lower(article_type)], article_type) end"""


@query("S16", f"""select user_id, case when count(*) = 1 then 'Complete outfit for ' || first(named order by product_id) else 'Perfect combination with ' || first(named order by product_id) || ': ' || array_to_string(list(coalesce(nullif(lower(base_colour), '') || ' ', '') || named order by product_id)[2:], ' + ') end as said
from (select user_id, p.*, {_NAMED_ITEM} as named from (select distinct user_id, product_id from interactions) join products p using (product_id)) group by 1""")
def outfit_reasons(spark, d):
    """Each user's products as an outfit around the first of them."""
    mine = S.interactions(spark, d).select("user_id", "product_id").distinct()
    rows = mine.join(S.products(spark, d).select("product_id", "base_colour", "article_type"), "product_id")
    items = rows.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("product_id", "base_colour", "article_type"))).alias("items"))
    return items.select("user_id", personal.outfit_reason(F.col("items")[0]["article_type"], F.slice("items", 2, F.greatest(F.size("items") - 1, F.lit(0)))).alias("said"))


simple("S23", "select user_id, lower(segment) as styles from users", lambda u: u.select("user_id", F.array_join(F.transform(F.filter(F.split(F.concat("segment", F.lit("; ")), ";"), lambda x: F.trim(x) != ""), lambda x: F.lower(F.trim(x))), ",").alias("styles")), S.users)
simple("AR02", "select user_id, 'a,' || user_id as added, 'a' as removed from users", lambda u: u.select("user_id", F.array_join(F.array_union(F.array(F.lit("a")), F.array(F.col("user_id"), F.lit("a"))), ",").alias("added"), F.array_join(F.array_remove(F.array(F.lit("a"), F.col("user_id")), F.col("user_id")), ",").alias("removed")), S.users)


@query("E06", f"""select round(1 - (square - m) / (m * (m - 1)), 6) as diversity from (select sum(s * s) as square, (select count(distinct product_id) from ranking join cells using (product_id)) as m from (
  select feature, value, sum(1 / size) as s from (select distinct product_id from ranking) join cells using (product_id) join sizes using (product_id) group by 1, 2))""", CONTENT)
def global_diversity(spark, d):
    shown = _ranking(spark, d).select("product_id").distinct()
    return M.one_list(shown, scoring.encode(S.products(spark, d))).select(F.round("ild", 6).alias("diversity"))


_GRADED = CONTENT + "," + TRUTH + """,
worth as (select user_id, product_id, coalesce(least(rating / 5, 1.0), 1.0) as rel from truth left join products using (product_id)),
ideal as (select user_id, any_value(n) as n, sum(case when r <= 10 then rel / log2(r + 1) else 0 end) as i10, sum(rel / log2(r + 1)) as i20 from (
  select *, row_number() over (partition by user_id order by rel desc, product_id) as r, count(*) over (partition by user_id) as n from worth) where r <= 20 group by 1),
gained as (select user_id, count(rel) filter (rank <= 10) as h10, count(rel) as h20, coalesce(sum(case when rank <= 10 then rel / log2(rank + 1) end), 0) as d10, coalesce(sum(rel / log2(rank + 1)), 0) as d20 from ranking left join worth using (user_id, product_id) group by 1)"""


@query("E09", "select user_id, round(h10 / n, 4) as recall_10, round(d10 / i10, 4) as ndcg_10, round(h20 / n, 4) as recall_20, round(d20 / i20, 4) as ndcg_20 from ideal join gained using (user_id)", _GRADED)
def graded(spark, d):
    relevant = M.truth(S.interactions(spark, d)).join(S.products(spark, d).select("product_id", "rating"), "product_id", "left")
    return M.graded(_ranking(spark, d), relevant)


simple("X18", "select product_id, concat_ws(' ', name, article_type, base_colour, usage, gender) as text from products", lambda p: p.select("product_id", F.concat_ws(" ", "name", "article_type", "base_colour", "usage", "gender").alias("text")))


def _texts(p):
    return p.select("product_id", F.concat_ws(" ", "name", "article_type", "base_colour", "usage", "gender").alias("text"))


@query("X18_vectors")
def item_vectors(spark, d):
    """A vector for each product's text; tested on planted synonyms."""
    return T.vectors(_texts(S.products(spark, d)), "product_id", "text")


@query("X18_shape", "select product_id, 64 as dims, 1.0 as length from products")
def item_vectors_shape(spark, d):
    """What holds for the vectors of any texts with words: their dimensions and length."""
    v = F.col("vector")
    return item_vectors(spark, d).select("product_id", F.size(v).alias("dims"), F.round(C.norm(v), 6).alias("length"))


# in whole hundredths, so that sums are exact in any order
simple("A28", "select event_id, sum(cast(round(value * 100) as bigint)) over (partition by user_id order by ts, event_id) / count(*) over (partition by user_id order by ts, event_id) as running from event_rows",
       lambda e: e.withColumn("so_far", F.struct(F.sum(F.round(F.col("value") * 100).cast("bigint")).over(_running()).alias("total"), F.count(F.lit(1)).over(_running()).alias("n"))).select("event_id", (F.col("so_far.total") / F.col("so_far.n")).alias("running")), S.events)


# orders as documents of a dump, with wrappers at every level and texts that look like them
def _documents(spark, d):
    k = F.col("o_orderkey")
    lines = S.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("l"))
    rows = S.table(spark, d, "orders").select("o_orderkey", "o_custkey", (F.unix_millis(F.col("o_orderdate").cast("timestamp")) + k % 2 * 7).alias("ms")).join(lines, "o_orderkey")
    item = lambda x: F.concat(F.lit('{"product": {"$oid": "p'), x["l_partkey"].cast("string"), F.lit(r'"}, "tags": [{"$oid":"t"}, "{\"$oid\":\"no\"}"], "n" :{"$numberInt":"'), x["l_linenumber"].cast("string"), F.lit('"}}'))
    date = F.when(k % 3 == 0, F.concat(F.lit('{"$numberLong":"'), F.col("ms").cast("string"), F.lit('"}'))).otherwise(F.col("ms").cast("string"))
    return rows.select("o_orderkey", F.concat(F.lit('{"_id": {"$oid": "o'), k.cast("string"), F.lit('"}, "user": {"id": {"$oid": "u'), F.col("o_custkey").cast("string"), F.lit('"}}, "at": {"$date": '), date, F.lit('}, "items": ['), F.array_join(F.transform("l", item), ", "), F.lit('], "total": {"$numberDouble": "-2.5"}}')).alias("document"))


_ITEM = """'{"n":' || l_linenumber || ',"product":"p' || l_partkey || '","tags":["t","{\\"$oid\\":\\"no\\"}"]}'"""


@query("JS02", f"""select o_orderkey, '{{"_id":"o' || o_orderkey || '","at":"' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || case when o_orderkey % 2 = 1 then '.007000' else '' end || '+00:00","items":[' || items || '],"total":-2.5,"user":{{"id":"u' || o_custkey || '"}}}}' as document
from orders join (select l_orderkey as o_orderkey, string_agg({_ITEM}, ',' order by l_linenumber, l_partkey) as items from lineitem group by 1) using (o_orderkey)""")
def unwrapped_documents(spark, d):
    return _documents(spark, d).select("o_orderkey", L.unwrapped(F.col("document")).alias("document"))


@query("AR05", "select o_orderkey, 'o' || o_orderkey as id, 'u' || o_custkey as user, products from orders join (select l_orderkey as o_orderkey, string_agg('p' || l_partkey || '/t', ',' order by l_linenumber, l_partkey) as products from lineitem group by 1) using (o_orderkey)")
def ids_as_strings(spark, d):
    """Ids of three levels, within lists too, read as strings from the rewritten documents."""
    v = F.parse_json(L.unwrapped(F.col("document")))
    rows = _documents(spark, d).select("o_orderkey", v.alias("v"))
    items = F.variant_get("v", "$.items", "array<struct<product:string,tags:array<string>>>")
    return rows.select("o_orderkey", F.variant_get("v", "$._id", "string").alias("id"), F.variant_get("v", "$.user.id", "string").alias("user"), F.array_join(F.transform(items, lambda x: F.concat(x["product"], F.lit("/"), x["tags"][0])), ",").alias("products"))


@query("X08", "select user_id, product_id, round(0.5 * (score - (select min(score) from one)) / (select max(score) - min(score) from one), 6) as score from one", "one as (select user_id, product_id, sum(w) as score from weighted group by 1, 2)")
def content_only(spark, d):
    """Without graph scores the blend goes on with content scores alone, the missing side being 0 after scaling."""
    content = scoring.pair_weights(S.interactions(spark, d)).select("user_id", "product_id", F.col("w").alias("score"))
    bounds = content.agg(F.min("score").alias("low"), F.max("score").alias("high"))
    return content.join(F.broadcast(bounds)).select("user_id", "product_id", F.round(C.blend(F.lit(0.0), C.min_max(F.col("score"), F.col("low"), F.col("high")), 0.5), 6).alias("score"))


@query("SNK06", "select user_id, count(*) as n from interactions group by 1")
def save_artifact(spark, d):
    path = A.path(spark, "counts")
    S.interactions(spark, d).groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@query("SRC14", "select product_id, price from products")
def load_artifact(spark, d):
    path = A.path(spark, "prices")
    S.products(spark, d).select("product_id", "price").write.mode("overwrite").parquet(path)
    return S.read_first(spark, path)


@query("SRC20", "select product_id, year from products")
def load_fallback(spark, d):
    path = A.path(spark, "years")
    S.products(spark, d).select("product_id", "year").write.mode("overwrite").parquet(path)
    return S.read_first(spark, A.path(spark, "not-there"), path)


@query("SRC16", "select * from (values ('prices', true), ('not-there', false)) t(name, there)")
def artifact_status(spark, d):
    path = A.path(spark, "status-prices")
    S.products(spark, d).select("product_id").write.mode("overwrite").parquet(path)
    rows = [("prices", S.read_first(spark, path) is not None), ("not-there", S.read_first(spark, A.path(spark, "not-there")) is not None)]
    return spark.createDataFrame(rows, "name string, there boolean")


_NINE = "cast(cast({} as decimal(18, 9)) as varchar)"


@query("P08", f"""select user_id, personalized, n, coalesce(outfit, '') as outfit, round(coalesce(complete, 0), 4) as outfit_complete_score
from (select user_id, string_agg(product_id || ':' || cast(rank as varchar) || ':' || {_NINE.format("score")}, ',' order by rank) as personalized, count(*) as n from ranking where rank <= 5 group by 1)
left join (select user_id, string_agg('outfit_' || cast(t as varchar) || '=' || items, ';' order by t) as outfit, avg(complete) as complete from (
  select user_id, t, string_agg(slot || ':' || product_id || ':' || {_NINE.format("coalesce(score, 0)")}, ',' order by slot) as items, any_value(size / case when person = 'female' then 6 else 4 end) as complete
  from filled where core = 4 group by 1, 2) group by 1) using (user_id)""", CONTENT + ", top as (select user_id, product_id, score from scored), " + SHELVES)
def response(spark, d):
    """The payload of each user with a ranking: the five best products with their scores, the map of three outfits by category, and how complete these are."""
    said = lambda *parts: F.array_join(F.array(*parts), ":")
    nine = lambda score: score.cast("decimal(18,9)").cast("string")
    best = _ranking(spark, d).where("rank <= 5").groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("rank", "product_id", "score"))).alias("items"))
    products = S.products(spark, d)
    cells = scoring.encode(products).groupBy("product_id").agg(F.collect_list("feature_index").alias("cells"))
    vectors, _ = scoring.content_vectors(scoring.profiles(S.interactions(spark, d), products), products)
    outfits = O.scored(drawn(spark, d), products.join(cells, "product_id"), materialise(vectors, "content-users"))  # stored, as each item looks into the vector
    listed = F.transform("outfits", lambda o: F.concat(F.lit("outfit_"), o["outfit_number"].cast("string"), F.lit("="), F.array_join(F.transform(o["items"], lambda x: said(x["slot"], x["product_id"], nine(x["score"]))), ",")))
    personal = F.array_join(F.transform("items", lambda x: said(x["product_id"], x["rank"].cast("string"), nine(x["score"]))), ",")
    return best.join(outfits, "user_id", "left").select(
        "user_id", personal.alias("personalized"), F.size("items").cast("long").alias("n"), F.coalesce(F.array_join(listed, ";"), F.lit("")).alias("outfit"), F.round(F.coalesce("complete", F.lit(0.0)), 4).alias("outfit_complete_score"))
