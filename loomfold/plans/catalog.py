"""Scans, exports, filters, sorting, pages, set operations, scalar functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomfold.functions import columns as C
from loomfold.functions import values as V
from loomfold.operators import catalog as K
from loomfold.operators import regexsearch
from loomfold.plans.registry import query
from loomfold.sources import artifacts as A
from loomfold.sources import tables as S

ID_NAME = ["product_id", "name"]


def simple(name: str, sql: str, run, role=S.products, more: str = "") -> None:
    """A query on one role: `run` maps its DataFrame."""
    query(name, sql, more)(lambda spark, d: run(role(spark, d)))


# scans
def _csv(spark, name: str) -> str:
    return A.path(spark, f"csv-{name}")


@query("SRC01", "select * from products")
def scan_products(spark, d):
    """The catalog from a CSV file under its declared schema."""
    products = S.products(spark, d)
    S.export_products(products, _csv(spark, "products-in"))
    return S.read_csv(spark, _csv(spark, "products-in"), products.schema)


@query("SRC02", """select u.user_id, name, age, gender, coalesce(n, 0) as history, first_one from users u
left join (select user_id, count(*) as n, min(strftime(ts, '%Y-%m-%dT%H:%M:%S.%f')) as first_one from interactions group by 1) i using (user_id)""")
def scan_users(spark, d):
    """Users from a CSV file, their history parsed from its JSON cell."""
    people = S.users(spark, d)
    cells = people.select("user_id", "name", F.concat("user_id", F.lit("@x")).alias("email"), "age", "gender")
    S.export_users(cells, S.interactions(spark, d), _csv(spark, "users-in"))
    rows = S.read_users(spark, _csv(spark, "users-in"))
    return rows.select(F.col("id").alias("user_id"), "name", "age", "gender", F.size("parsed_interactions").cast("long").alias("history"), F.get("parsed_interactions", 0)["timestamp"].alias("first_one"))


@query("SRC03", "select user_id, product_id, interaction_type, cast(ts as timestamp) as ts from interactions")
def scan_interactions(spark, d):
    S.export_interactions(S.interactions(spark, d), S.users(spark, d), _csv(spark, "interactions-in"))
    return S.read_interactions(spark, _csv(spark, "interactions-in"))


simple("SRC04", "select user_id, count(*) as n from interactions group by 1", lambda i: i.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")), S.interactions)
simple("SRC06", "select event_id, cast(ts as varchar) <> '' as ok, try_cast(cast(ts as varchar) || 'x' as timestamp) is null as bad from event_rows",
       lambda e: e.select("event_id", F.try_to_timestamp(F.col("ts").cast("string")).isNotNull().alias("ok"), F.try_to_timestamp(F.concat(F.col("ts").cast("string"), F.lit("x"))).isNull().alias("bad")), S.events)
simple("SRC07", "select product_id, name, gender from products", lambda p: p.select("product_id", "name", "gender"))
simple("SRC08", "select product_id, price from products", lambda p: p.select("product_id", "price"))
simple("SRC09", "select * from products where product_id = '17' limit 1", lambda p: p.where("product_id = '17'").limit(1))
simple("SRC10", "select user_id, name, age from users where user_id = '5'", lambda u: u.where("user_id = '5'").select("user_id", "name", "age"), S.users)
simple("SRC11", "select event_id, ts from event_rows where ts between timestamp '2024-01-02' and timestamp '2024-01-05'",
       lambda e: e.where(F.col("ts").between(F.lit("2024-01-02").cast("timestamp_ntz"), F.lit("2024-01-05").cast("timestamp_ntz"))).select("event_id", "ts"), S.events)


_CELL = "case when k % 7 = 0 then null else usage end"
SYNC_SQL = """old as (select cast(product_id as bigint) as id, name, 'old-' || product_id as slug, gender, usage, year from products where cast(product_id as bigint) % 4 <> 0),
cells as (select case when k % 10 = 3 then null when k % 10 = 7 then 'x' || product_id else product_id end as id, gender, case when k % 7 = 0 then null else usage end as usage, case when k % 5 = 0 then null else year + 1 end as year, name
  from (select *, cast(product_id as bigint) as k from products) where k % 2 = 1 or k % 4 = 0),
good as (select cast(id as bigint) as id, gender, usage, year, name from cells where try_cast(id as bigint) is not null)"""


@query("SRC12", """select 'row' as kind, coalesce(o.id, g.id) as id, coalesce(o.name, g.name) as name, coalesce(o.slug, 'product-' || g.id) as slug, case when g.id is null then o.gender else g.gender end as gender, case when g.id is null then o.usage else g.usage end as usage, case when g.id is null then o.year else g.year end as year, null as counts from old o full join good g on o.id = g.id
union all select 'counts', null, null, null, null, null, null, concat_ws(',', (select count(*) from cells), (select count(*) from good where id not in (select id from old)), (select count(*) from good where id in (select id from old)), (select count(*) from cells) - (select count(*) from good), 0)""", SYNC_SQL)
def sync(spark, d):
    """A sync of the catalog from a CSV file with padded, blank and bad cells: the catalog after it, and its counts."""
    p, k = S.products(spark, d), F.col("product_id").cast("bigint")
    none = F.lit(None).cast("string")
    old = p.where(k % 4 != 0).select(k.alias("id"), "name", F.concat(F.lit("old-"), "product_id").alias("slug"), *[F.col(c) if c in ("gender", "usage", "year") else none.alias(c) for c in S.SYNCED])
    said = {"gender": F.concat(F.lit(" "), "gender", F.lit(" ")), "usage": F.when(k % 7 == 0, "  ").otherwise(F.col("usage")), "year": F.when(k % 5 == 0, "soon").otherwise((F.col("year") + 1).cast("string")), "productDisplayName": F.col("name")}
    key = F.when(k % 10 == 3, " ").when(k % 10 == 7, F.concat(F.lit("x"), "product_id")).otherwise(F.concat("product_id", F.lit(" ")))
    cells = p.where((k % 2 == 1) | (k % 4 == 0)).select(k.alias("line"), key.alias("id"), *[said.get(c, none).alias(c) for c in S.SYNCED])
    S.write_csv(cells, _csv(spark, "sync"))
    merged, counts = S.sync_products(old, S.read_csv(spark, _csv(spark, "sync"), "line long, id string, " + ", ".join(f"{c} string" for c in S.SYNCED)))
    rows = merged.select(F.lit("row").alias("kind"), "id", "name", "slug", "gender", "usage", "year", none.alias("counts"))
    told = F.concat_ws(",", *[F.col(c).cast("string") for c in ("total", "created", "updated", "skipped", "errors")])
    empty = [F.lit(None).cast(t).alias(c) for c, t in (("id", "long"), ("name", "string"), ("slug", "string"), ("gender", "string"), ("usage", "string"), ("year", "int"))]
    return rows.unionByName(counts.select(F.lit("counts").alias("kind"), *empty, told.alias("counts")))


simple("SRC18", "select lower(sub_category) as key, min(product_id) as first_id from products group by 1", lambda p: p.groupBy(F.lower("sub_category").alias("key")).agg(F.min("product_id").alias("first_id")))

# exports
@query("SNK01", "select product_id, coalesce(usage, '') as usage, cast(year as varchar) as year, '[\"' || product_id || '.jpg\"]' as images from products")
def export_products(spark, d):
    """The cells of the file written: nulls are blank, images JSON."""
    S.export_products(S.products(spark, d).select("product_id", "usage", "year", F.array(F.concat("product_id", F.lit(".jpg"))).alias("images")), _csv(spark, "products"))
    return S.lines_of(spark, _csv(spark, "products"), "product_id string, usage string, year string, images string")


@query("SNK02", """select u.user_id, name, coalesce(cast(age as varchar), '') as age, coalesce(gender, '') as gender, coalesce(said, '[]') as interaction_history from users u left join (
  select user_id, '[' || string_agg('{"product_id":"' || product_id || '","interaction_type":"' || interaction_type || '","timestamp":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '"}', ',' order by ts, product_id, interaction_type) || ']' as said from interactions group by 1) using (user_id)""")
def export_users(spark, d):
    S.export_users(S.users(spark, d).select("user_id", "name", "age", "gender"), S.interactions(spark, d), _csv(spark, "users"))
    return S.lines_of(spark, _csv(spark, "users"), "user_id string, name string, age string, gender string, interaction_history string")


@query("SNK03", """select user_id, product_id, interaction_type, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') as timestamp, (select count(*) from interactions where user_id not in (select user_id from users where age >= 18)) as rejected
from interactions where user_id in (select user_id from users where age >= 18)""")
def export_interactions(spark, d):
    rejected = S.export_interactions(S.interactions(spark, d), S.users(spark, d).where("age >= 18"), _csv(spark, "interactions"))
    return S.lines_of(spark, _csv(spark, "interactions"), S.INTERACTIONS).withColumn("rejected", F.lit(rejected).cast("long"))


@query("SNK05", """select 'products' as export, product_id as id, concat_ws(';', gender, usage, base_colour) as said from products
union all select 'users', user_id, string_agg(product_id, ';' order by ts, product_id, interaction_type) from interactions group by user_id
union all select 'interactions', user_id || ' ' || product_id, interaction_type || ' ' || cast(cast(w as integer) as varchar) from weighted
union all select 'pairs', user_id, product_id || ' ' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') from (select * from interactions order by ts desc, user_id, product_id limit 50)""")
def export_evaluation(spark, d):
    """The four evaluation files, written and read back: lists joined with `;`, pairs the latest 50."""
    p, i = S.products(spark, d), S.interactions(spark, d)
    history = F.transform(F.sort_array(F.collect_list(F.struct("ts", "product_id", "interaction_type"))), lambda x: x["product_id"])
    pairs = S.latest_pairs(i, 50)
    files = {
        "products": p.select(F.col("product_id").alias("id"), F.concat_ws(";", "gender", "usage", "base_colour").alias("said")),
        "users": i.groupBy(F.col("user_id").alias("id")).agg(F.array_join(history, ";").alias("said")),
        "interactions": i.select(F.concat_ws(" ", "user_id", "product_id").alias("id"), F.concat_ws(" ", "interaction_type", C.weight(F.col("interaction_type")).cast("int").cast("string")).alias("said")),
        "pairs": pairs.select(F.col("user_id").alias("id"), F.concat_ws(" ", "current_product_id", "timestamp").alias("said")),
    }
    out = None
    for name, df in files.items():
        S.write_csv(df, _csv(spark, f"evaluation-{name}"))
        back = S.lines_of(spark, _csv(spark, f"evaluation-{name}"), "id string, said string").select(F.lit(name).alias("export"), "id", "said")
        out = back if out is None else out.unionByName(back)
    return out


@query("SNK11", "select l_orderkey, sum(l_quantity) as stock from lineitem where l_linenumber <> 1 group by 1 union all select l_orderkey, 0.0 from lineitem group by 1 having max(l_linenumber) = 1 and min(l_linenumber) = 1")
def child_replace(spark, d):
    lines = S.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return lines.groupBy("l_orderkey").agg(F.coalesce(F.sum(F.when(F.col("l_linenumber") != 1, F.col("l_quantity"))), F.lit(0.0)).alias("stock"))


# filters
simple("F01", "select count(*) as n from orders where o_orderstatus = 'F'", lambda o: o.where("o_orderstatus = 'F'").agg(F.count(F.lit(1)).alias("n")), lambda s, d: S.table(s, d, "orders"))
simple("F02", "select product_id, name from products where lower(gender) = 'women' and lower(usage) = 'casual'", lambda p: K.facets(p, gender="WOMEN", usage="casual", article_type=None).select(*ID_NAME))
simple("F03", "select product_id, price from products where price >= 950", lambda p: K.between(p, "price", "950", "abc").select("product_id", "price"))
simple("F04", "select product_id, year from products where year = 2012", lambda p: K.between(p, "year", "2012", "2012").select("product_id", "year"))
# terms as users type them: each is an expression as it stands, over four text columns, or an id
TERMS = ("Red", "(navy|blue).* steel", "^almond", "lav[aeiou]n?der s", "brand#1[1-3]$", "casual-shoes?", "e{2}l .*k", "t-?shirt", "17", "[xyz]{2}", "nothing like it")
TEXTS = ("name", "article_type", "slug", "brand")


def _texts(products):
    return products.select("product_id", "name", "article_type", C.slug(F.col("article_type"), "-").alias("slug"), "brand")


@query("F05", f"""select term, product_id, name from texts, (values {", ".join(f"('{t}')" for t in TERMS)}) t(term)
where {" or ".join(f"regexp_matches({c}, term, 'i')" for c in TEXTS)} or (regexp_full_match(term, '[0-9]+') and product_id = term)""",
       "texts as (select product_id, name, article_type, trim(regexp_replace(lower(article_type), '[^a-z0-9]+', '-', 'g'), '-') as slug, brand from products)")
def regex_search(spark, d):
    """Unescaped expressions through one trigram index of the catalog."""
    rows = _texts(S.products(spark, d))
    index = regexsearch.trigram_index(rows, "product_id", TEXTS)
    found = [regexsearch.search(rows, index, t, "product_id", TEXTS).select(F.lit(t).alias("term"), *ID_NAME) for t in TERMS]
    return reduce(DataFrame.unionByName, found)


simple("F06", "select product_id, name, price from products where contains(lower(name), 'red w') and price <= 1500 order by price, product_id limit 20", lambda p: K.between(K.search(p, "red w", "name"), "price", None, 1500).orderBy(*K.ordering("price")).limit(20).select("product_id", "name", "price"))
simple("F07", "select user_id from users where contains(lower(name), '0007') or contains(lower(segment), '0007')", lambda u: K.search(u, "0007", "name", "segment").select("user_id"), S.users)
simple("F08", "select product_id from products where contains(lower(name), 'bolt') or contains(lower(usage), 'bolt')", lambda p: K.search(p, "bolt", "name", "usage").select("product_id"))
simple("F09", "select product_id, sale from products where sale > 0 order by sale desc, created_day desc, product_id limit 50", lambda p: p.where("sale > 0").orderBy(*K.ordering("-sale", "-created_day")).limit(50).select("product_id", "sale"))
simple("F10", "select product_id from products where product_id in ('1','2','3','4') and product_id not in ('2')", lambda p: p.where(F.col("product_id").isin("1", "2", "3", "4") & ~F.col("product_id").isin("2")).select("product_id"))
simple("F11", "select product_id from products where lower(sub_category) = 'shoes'", lambda p: K.first_match(p, F.col("article_type") == "shoes", C.same_text(F.col("master_category"), "shoes"), C.same_text(F.col("sub_category"), "shoes"), C.contains(F.col("name"), "shoes")).select("product_id"))
simple("F12", "select product_id from products where article_type = 'Jeans'", lambda p: p.where("article_type = 'Jeans'").select("product_id"))

ALLOWED_SQL = """case when age is null or gender is null then ['Boys','Girls','Men','Unisex','Women']
  when age < 13 then case gender when 'male' then ['Boys'] when 'female' then ['Girls'] else ['Boys','Girls'] end
  else case gender when 'male' then ['Men','Unisex'] when 'female' then ['Women','Unisex'] else ['Men','Women','Unisex'] end end"""


@query("F13", "select user_id, count(*) as n from au join pg on list_contains(allowed, gender) cross join (select 1) group by user_id", f"au as (select user_id, {ALLOWED_SQL} as allowed from users), pg as (select gender from products)")
def allowed_products(spark, d):
    users = S.users(spark, d).select("user_id", F.explode(C.allowed_genders(F.col("age"), F.col("gender"))).alias("gender"))
    counts = S.products(spark, d).groupBy("gender").agg(F.count(F.lit(1)).alias("n"))
    return users.join(counts, "gender").groupBy("user_id").agg(F.sum("n").alias("n"))


simple("F15", "select distinct gender, case lower(gender) when 'men' then 'male' when 'boys' then 'male' when 'women' then 'female' when 'girls' then 'female' else 'unisex' end as normal from products", lambda p: p.select("gender", C.normal_gender(F.col("gender")).alias("normal")).distinct())
simple("F16", "select product_id from products where lower(gender) in ('unisex', 'women', 'girls', 'female')", lambda p: p.where(C.normal_gender(F.col("gender")).isin("unisex", "female")).select("product_id"))
simple("F17", "select gender, count(*) as n from products where lower(gender) in ('unisex', 'men', 'boys') group by 1", lambda p: p.where(C.gender_fits(F.col("gender"), F.lit("male"))).groupBy("gender").agg(F.count(F.lit(1)).alias("n")))
simple("F18", "select distinct article_type, lower(article_type) as lower, upper(article_type) as upper from products", lambda p: p.select("article_type", F.lower("article_type").alias("lower"), F.upper("article_type").alias("upper")).distinct())


@query("F19", "select product_id from products where gender in ('Women','Unisex') and lower(article_type) = 'jeans' and product_id not in (select product_id from interactions where user_id = '5')")
def candidate_pool(spark, d):
    seen = S.interactions(spark, d).where("user_id = '5'").select("product_id")
    return S.products(spark, d).where(F.col("gender").isin("Women", "Unisex") & C.same_text(F.col("article_type"), "jeans")).join(seen, "product_id", "left_anti").select("product_id")


simple("F20", "select product_id from products where lower(article_type) = 'jeans'", lambda p: p.where(C.same_text(F.col("article_type"), "Jeans")).select("product_id").distinct())
simple("F21", "select product_id from products where gender in ('Men','Unisex') and not contains(lower(coalesce(usage, '')), 'kid')", lambda p: p.where(F.col("gender").isin("Men", "Unisex") & ~F.coalesce(C.contains(F.col("usage"), "kid"), F.lit(False))).select("product_id"))
simple("F22", "select product_id from products where lower(gender) in ('girls','women','unisex')", lambda p: p.where(C.gender_fits(F.col("gender"), F.lit("female"))).select("product_id"))
simple("F23", "select product_id from products where product_id <> '9'", lambda p: p.where("product_id != '9'").select("product_id"))
simple("F24", "select product_id, interaction_type, ts from interactions where user_id = '7'", lambda i: i.where("user_id = '7'").select("product_id", "interaction_type", "ts"), S.interactions)
simple("F25", "select interaction_type, count(*) as n from interactions where interaction_type in ('purchase','like','cart') group by 1", lambda i: i.where(F.col("interaction_type").isin(*V.POSITIVE)).groupBy("interaction_type").agg(F.count(F.lit(1)).alias("n")), S.interactions)
simple("F26", "select product_id from products where lower(master_category) = 'apparel' and sub_category in ('Topwear','Dress')", lambda p: p.where(C.same_text(F.col("master_category"), "APPAREL") & F.col("sub_category").isin("Topwear", "Dress")).select("product_id"))
simple("F28", "select user_id, case when age > 10 and age <= 100 then age end as age from users", lambda u: u.select("user_id", F.when((F.col("age") > 10) & (F.col("age") <= 100), F.col("age")).alias("age")), S.users)
simple("F29", "select product_id from products where gender = 'Men' and contains(lower(name), 'gear')", lambda p: K.search(p.where("gender = 'Men'"), "gear", "name").select("product_id"))
simple("F30", "select product_id, price from products where contains(lower(name), 'ring') order by price desc, product_id limit 30", lambda p: K.search(p, "ring", "name").orderBy(*K.ordering("-price")).limit(30).select("product_id", "price"))
simple("F31", "select o_orderkey from orders where o_custkey = 11", lambda o: o.where("o_custkey = 11").select("o_orderkey"), lambda s, d: S.table(s, d, "orders"))

# projections
simple("P01", "select product_id, round(rating / 3, 4) as \"Rating\" from products", lambda p: p.select("product_id", C.round4(F.col("rating") / 3).alias("Rating")))
simple("P02", "select product_id, coalesce(usage, 'N/A') as usage, cast(price as double) as price, {'min': 0.0, 'max': price}.max as high from products", lambda p: p.select("product_id", F.coalesce("usage", F.lit("N/A")).alias("usage"), "price", F.struct(F.lit(0.0).alias("min"), F.col("price").alias("max")).alias("r")).select("product_id", "usage", "price", F.col("r.max").alias("high")))
simple("P03", "select product_id, case when trim(x) = '' then null else coalesce(cast(try_cast(trim(x) as bigint) as varchar), trim(x)) end as norm from (select product_id, case cast(product_id as bigint) % 4 when 0 then ' 0' || product_id when 1 then ' ' when 2 then 'a ' || product_id else product_id end as x from products)",
       lambda p: p.withColumn("k", F.col("product_id").cast("bigint") % 4).select("product_id", C.normal_id(F.when(F.col("k") == 0, F.concat(F.lit(" 0"), "product_id")).when(F.col("k") == 1, " ").when(F.col("k") == 2, F.concat(F.lit("a "), "product_id")).otherwise(F.col("product_id"))).alias("norm")))
simple("P04", "select product_id, coalesce(usage, gender) as picked from products", lambda p: p.select("product_id", F.coalesce("usage", "gender").alias("picked")))
simple("P05", "select user_id, gender is not null as has_gender, gender from users", lambda u: u.select("user_id", F.col("gender").isNotNull().alias("has_gender"), "gender"), S.users)
simple("P07", "select product_id, gender, article_type, base_colour from products", lambda p: p.select("product_id", "gender", "article_type", "base_colour"))

# sorting, pages, ranks
simple("W06", "select product_id, row_number() over (order by rating, num_reviews desc, created_day desc, product_id) as rank from products qualify rank <= 100", lambda p: p.orderBy(*K.ordering("rating", "-num_reviews", "-created_day")).limit(100).withColumn("rank", F.row_number().over(Window.orderBy(*K.ordering("rating", "-num_reviews", "-created_day")))).select("product_id", "rank"))
simple("W07", "select product_id, price from products order by price desc, product_id limit 25", lambda p: p.orderBy(*K.ordering(*K.SORTS["price_high_to_low"])).limit(25).select("product_id", "price"))
simple("W08", "select product_id, rank, page, total, pages from (select product_id, row_number() over (order by price, product_id) as rank, 3 as page, count(*) over () as total, cast(ceil(count(*) over () / 20.0) as integer) as pages from products) where rank between 41 and 60", lambda p: K.page(p, K.ordering("price"), 3, 20).select("product_id", "rank", "page", "total", "pages"))
simple("W09", "select product_id, true as has_next, true as has_previous from (select product_id, row_number() over (order by product_id) as r from products) where r between 21 and 40", lambda p: K.page(p, [F.col("product_id")], 2, 20).select("product_id", (F.col("page") < F.col("pages")).alias("has_next"), (F.col("page") > 1).alias("has_previous")))
simple("W10", """select product_id, rating from (select *, row_number() over (order by pool, case when pool = 0 then rating end desc, num_reviews desc, rating desc, created_day desc, product_id) as place from (
  select *, case when num_reviews > 0 then 0 else 1 end as pool from products)) where place <= case when (select count(*) from products where num_reviews > 0) >= 10 then least(30, (select count(*) from products where num_reviews > 0)) else 30 end""", lambda p: K.top_pool(p, 10).select("product_id", "rating"))
simple("W10_shuffled", None, lambda p: K.top_products(p, 10, 7).select("product_id", "rating"))
simple("W11", "select product_id, created_day from products order by created_day desc, product_id limit 20", lambda p: p.orderBy(*K.ordering("-created_day")).limit(20).select("product_id", "created_day"))
simple("W12", "select user_id, product_id, ts from interactions order by ts desc, user_id, product_id, l_orderkey, l_linenumber limit 40", lambda i: i.orderBy(F.desc("ts"), "user_id", "product_id", "l_orderkey", "l_linenumber").limit(40).select("user_id", "product_id", "ts"), S.interactions)
simple("W13", "select sub_category, outfit_index, product_id from (select *, row_number() over (partition by sub_category order by coalesce(score, rating / 5) desc, product_id) as r, least(10, count(*) over (partition by sub_category)) as n from (select p.*, case when num_reviews % 3 = 0 then num_reviews / 40.0 end as score from products p)), generate_series(0, 12) g(outfit_index) where r = least(outfit_index + 1, n)",
       lambda p: K.bounded_pick(p.withColumn("score", F.when(F.col("num_reviews") % 3 == 0, F.col("num_reviews") / 40.0)), "sub_category", 13))
simple("W16", "select base_colour, dense_rank() over (order by base_colour) - 1 as index from (select distinct base_colour from products)", lambda p: p.select("base_colour").distinct().withColumn("index", (F.dense_rank().over(Window.orderBy("base_colour")) - 1).cast("long")))
simple("W17", "select o_orderkey, o_orderdate from orders where o_custkey = 11 order by o_orderdate desc, o_orderkey limit 10", lambda o: o.where("o_custkey = 11").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(10).select("o_orderkey", "o_orderdate"), lambda s, d: S.table(s, d, "orders"))
simple("W18", "select distinct base_colour from products order by 1 limit 6", lambda p: p.select("base_colour").distinct().orderBy("base_colour").limit(6))
simple("W19", "select sub_category, product_id, r from (select sub_category, product_id, row_number() over (partition by sub_category order by rating desc, created_day desc, product_id) as r from products) where r <= 10", lambda p: p.withColumn("r", F.row_number().over(Window.partitionBy("sub_category").orderBy(*K.ordering("-rating", "-created_day")))).where("r <= 10").select("sub_category", "product_id", "r"))


# set operations
@query("SET01", "select user_id from interactions union select user_id from event_rows")
def union_distinct(spark, d):
    return S.interactions(spark, d).select("user_id").union(S.events(spark, d).select("user_id")).distinct()


@query("SET02", "select user_id, product_id from interactions union all select user_id, product_id from event_rows")
def union_all(spark, d):
    return S.interactions(spark, d).select("user_id", "product_id").union(S.events(spark, d).select("user_id", "product_id"))


@query("SET03", "select product_id from interactions intersect select product_id from event_rows")
def intersect(spark, d):
    return S.interactions(spark, d).select("product_id").intersect(S.events(spark, d).select("product_id"))


@query("SET04", "select product_id from products except select product_id from event_rows")
def except_(spark, d):
    return S.products(spark, d).select("product_id").subtract(S.events(spark, d).select("product_id"))


@query("SET05", "select count(*) as size, count(*) filter (product_id not in (select product_id from products)) = 0 as subset from (select distinct product_id from event_rows)")
def subset(spark, d):
    mine, all_ = S.events(spark, d).select("product_id").distinct(), S.products(spark, d).select("product_id", F.lit(1).alias("known"))
    return mine.join(all_, "product_id", "left").agg(F.count(F.lit(1)).alias("size"), (F.count_if(F.col("known").isNull()) == 0).alias("subset"))


# scalar functions
simple("S01", "select product_id, trim('  ' || name || ' ') as t, lower(article_type) as l, upper(gender) as u from products", lambda p: p.select("product_id", F.trim(F.concat(F.lit("  "), "name", F.lit(" "))).alias("t"), F.lower("article_type").alias("l"), F.upper("gender").alias("u")))
simple("S02", r"select product_id, regexp_replace(regexp_replace(lower(trim(name || ' & ' || article_type)), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') as slug from products", lambda p: p.select("product_id", C.slug(F.concat_ws(" & ", "name", "article_type")).alias("slug")))
simple("S03", "select product_id from products where contains(lower(usage), 'kid')", lambda p: p.where(C.contains(F.col("usage"), "kid")).select("product_id"))
simple("S04", r"select event_id, regexp_extract(props, '\{\"k\": ([0-9]+)\}', 1) as k from events", lambda e: e.select("event_id", F.regexp_extract("props", r'\{"k": ([0-9]+)\}', 1).alias("k")), lambda s, d: S.table(s, d, "events"))
simple("S05", "select product_id, split_part(name, ' ', 1) as first, array_to_string(string_split(name, ' '), '+') as joined from products", lambda p: p.select("product_id", F.split_part("name", F.lit(" "), F.lit(1)).alias("first"), F.array_join(F.split("name", " "), "+").alias("joined")))
simple("S06", "select product_id, left(md5(product_id), 24) as pseudo_id from products", lambda p: p.select("product_id", F.left(F.md5("product_id"), F.lit(24)).alias("pseudo_id")))
_tags = "case article_type " + " ".join(f"when '{k}' then '{v}'" for k, v in V.CATEGORY_TAGS.items()) + " end"
simple("S07", f"select product_id, {_tags} as tag from products", lambda p: p.select("product_id", C.lookup(V.CATEGORY_TAGS, F.col("article_type")).alias("tag")))
KEY_SQL = "case sub_category " + " ".join(f"when '{k}' then '{v}'" for k, v in V.CATEGORY_KEYS.items()) + " end"
simple("S08", f"select product_id, {KEY_SQL} as key from products", lambda p: p.select("product_id", C.lookup(V.CATEGORY_KEYS, F.col("sub_category")).alias("key")))
simple("S12", f"select user_id, array_to_string({ALLOWED_SQL}, ',') as allowed from users", lambda u: u.select("user_id", F.array_join(C.allowed_genders(F.col("age"), F.col("gender")), ",").alias("allowed")), S.users)
simple("S13", "select user_id, case when age <= 12 then 'kid' when age <= 19 then 'teen' else 'adult' end as age_group from users", lambda u: u.select("user_id", C.age_group(F.col("age")).alias("age_group")), S.users)
simple("S14", "select product_id, lower(concat_ws(',', usage, base_colour, article_type)) as tokens from products", lambda p: p.select("product_id", F.array_join(F.transform(F.array_compact(F.array("usage", "base_colour", "article_type")), F.lower), ",").alias("tokens")))
LABELS_SQL = "map {" + ", ".join(f"'{k}': '{v}'" for k, v in V.LABELS.items()) + "}"
simple("S17", f"select distinct article_type, case when coalesce(article_type, '') = '' then 'product' else coalesce({LABELS_SQL}[lower(article_type)], article_type) end as label from products",
       lambda p: p.select("article_type", F.when(F.coalesce("article_type", F.lit("")) == "", "product").otherwise(C.lookup(V.LABELS, F.lower("article_type"), F.col("article_type"))).alias("label")).distinct())
simple("S18", "select user_id, base || case when n > 0 then '_' || n else '' end as username from (select user_id, base, row_number() over (partition by base order by user_id) - 1 as n from (select user_id, lower(segment) as base from users))", lambda u: u.withColumn("base", F.lower("segment")).withColumn("n", F.row_number().over(Window.partitionBy("base").orderBy("user_id")) - 1).select("user_id", F.concat("base", F.when(F.col("n") > 0, F.concat(F.lit("_"), F.col("n").cast("string"))).otherwise("")).alias("username")), S.users)
simple("S20", "select product_id, round(rating * 100.0 / 5, 2) as percent from products", lambda p: p.select("product_id", F.round(F.col("rating") * 100.0 / 5, 2).alias("percent")))
simple("S21", "select product_id from products where abs(price - 900.1) < 0.01", lambda p: p.where(F.abs(F.col("price") - 900.1) < 0.01).select("product_id"))
simple("S22", "select user_id, coalesce(case gender when 'male' then 'male' when 'female' then 'female' end, 'unisex') as resolved from users", lambda u: u.select("user_id", F.coalesce(C.normal_gender(F.col("gender")), F.lit("unisex")).alias("resolved")), S.users)
simple("S24", "select interaction_type, max(case interaction_type when 'purchase' then 5.0 when 'cart' then 3.5 when 'like' then 2.5 when 'review' then 2.0 else 1.0 end) as weight from event_rows group by 1", lambda e: e.select("interaction_type", C.weight(F.col("interaction_type"), "engine").alias("weight")).distinct(), S.events)
simple("D01", "select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00' as iso from event_rows", lambda e: e.select("event_id", F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00")).alias("iso")), S.events)
simple("D02", "select event_id, strftime(ts, '%Y-%m-%d') as day from event_rows", lambda e: e.select("event_id", F.date_format(C.parsed_time(F.date_format("ts", "dd/MM/yyyy HH:mm")), "yyyy-MM-dd").alias("day")), S.events)
simple("D03", "select event_id, cast(floor(epoch_us(ts) / 1000) as bigint) as millis from event_rows", lambda e: e.select("event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("millis")), S.events)
simple("M05", "select product_id, round(log2(num_reviews + 2), 6) as l, round(pow(rating, 2), 6) as p, cast(ceil(rating) as bigint) as c, least(greatest(rating, 1), 4) as clamp from products", lambda p: p.select("product_id", F.round(F.log2(F.col("num_reviews") + 2.0), 6).alias("l"), F.round(F.pow("rating", F.lit(2)), 6).alias("p"), F.ceil("rating").alias("c"), F.least(F.greatest("rating", F.lit(1.0)), F.lit(4.0)).alias("clamp")))
simple("M07", "select product_id, round(case when x > 0 then x else 0.2 * x end, 6) as lrelu, round(-ln(1 + exp(-x)), 6) as logsig from (select product_id, rating - 2.5 as x from products)", lambda p: p.withColumn("x", F.col("rating") - 2.5).select("product_id", F.round(C.leaky_relu(F.col("x")), 6).alias("lrelu"), F.round(C.log_sigmoid(F.col("x")), 6).alias("logsig")))
simple("AR03", "select user_id, string_agg(distinct interaction_type, ';' order by interaction_type) as types from interactions group by 1", lambda i: i.groupBy("user_id").agg(F.array_join(F.sort_array(F.collect_set("interaction_type")), ";").alias("types")), S.interactions)
simple("AR04", "select event_id, case interaction_type when 'purchase' then 5.0 when 'view' then 1.0 else 1.0 end as w from event_rows", lambda e: e.select("event_id", C.weight(F.col("interaction_type")).alias("w")), S.events)


@query("AR01", "select user_id, product_id, interaction_type from (select *, row_number() over (partition by user_id, product_id order by ts desc, l_orderkey desc, l_linenumber desc, interaction_type desc) as r from interactions) where r = 1")
def latest_per_product(spark, d):
    i = S.interactions(spark, d)
    return i.groupBy("user_id", "product_id").agg(F.max_by("interaction_type", F.struct("ts", "l_orderkey", "l_linenumber", "interaction_type")).alias("interaction_type"))


simple("JS01", "select event_id, '{\"type\":\"' || interaction_type || '\",\"k\":' || product_id || '}' as js from event_rows", lambda e: e.select("event_id", F.to_json(F.struct(F.col("interaction_type").alias("type"), F.col("product_id").cast("int").alias("k"))).alias("js")), S.events)
