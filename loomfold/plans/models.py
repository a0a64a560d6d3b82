"""Artifacts, requests, trained embeddings, outfit search, the whole response, experiments."""

from __future__ import annotations

import time

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomfold.functions import columns as C
from loomfold.functions import values as V
from loomfold.operators import graph as G
from loomfold.operators import metrics as M
from loomfold.operators import outfits as O
from loomfold.operators import descent, personal, rankjoin, scoring, training
from loomfold.operators.response import respond
from loomfold.plans import recommend as R
from loomfold.plans import reports as P
from loomfold.plans.catalog import ALLOWED_SQL, KEY_SQL
from loomfold.plans.recommend import CONTENT, DIMS
from loomfold.plans.registry import query
from loomfold.sources import artifacts as A
from loomfold.sources import tables as S

@query("SRC15", "select 'prices' as name, true as restored, count(*) as n from products union all select 'empty', false, count(*) from products union all select 'missing', false, count(*) from products")
def restore_artifacts(spark, d):
    prices = S.products(spark, d).select("product_id", "price")
    prices.write.mode("overwrite").parquet(A.path(spark, "restore-prices"))
    prices.limit(0).write.mode("overwrite").parquet(A.path(spark, "restore-empty"))
    A.delete(spark, A.path(spark, "restore-missing"))
    out = None
    for name in ("prices", "empty", "missing"):
        saved, kept = A.restore(spark, A.path(spark, f"restore-{name}"), lambda: prices)
        row = saved.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), F.lit(kept).alias("restored"), "n")
        out = row if out is None else out.unionByName(row)
    return out


@query("SRC17", P.LONG, P.RESULTS)
def comparison(spark, d):
    at = A.path(spark, "comparison")
    A.write_comparison(P.long_results(spark, d), at)
    return A.read_comparison(spark, at)


@query("SNK08", P.LONG, P.RESULTS)
def evaluation_log(spark, d):
    at = A.path(spark, "log")
    A.write_log(P.long_results(spark, d), at)
    return A.read_log(spark, at)


@query("SNK09", "select * from (values ('kept', true, true), ('never-there', false, false)) t(name, was_there, removed)")
def delete_artifacts(spark, d):
    names = ("kept", "never-there")
    S.products(spark, d).select("product_id").write.mode("overwrite").parquet(A.path(spark, "delete-kept"))
    gone = A.delete(spark, *[A.path(spark, f"delete-{n}") for n in names])
    there = [S.read_first(spark, A.path(spark, f"delete-{n}")) is not None for n in names]
    return spark.createDataFrame([(n, g, g and not t) for n, g, t in zip(names, gone, there)], "name string, was_there boolean, removed boolean")


@query("SNK10", """select product_id, case when cast(product_id as bigint) % 10 = 1 then price + 2 else price end as price from products where cast(product_id as bigint) % 10 <> 0
union all select 'new-' || product_id, price from products where cast(product_id as bigint) % 10 = 2""")
def changed_documents(spark, d):
    """Two updates of a tenth of the products (the later counts), deletes of a tenth, inserts."""
    old = S.products(spark, d).select("product_id", "price")
    last = F.col("product_id").cast("bigint") % 10
    parts = [
        old.where(last == 1).select("product_id", (F.col("price") + 1).alias("price"), F.lit("upsert").alias("op"), F.lit(1).alias("version")),
        old.where(last == 1).select("product_id", (F.col("price") + 2).alias("price"), F.lit("upsert").alias("op"), F.lit(2).alias("version")),
        old.where(last == 0).select("product_id", "price", F.lit("delete").alias("op"), F.lit(1).alias("version")),
        old.where(last == 2).select(F.concat(F.lit("new-"), "product_id").alias("product_id"), "price", F.lit("upsert").alias("op"), F.lit(1).alias("version")),
    ]
    changes = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    return A.apply_changes(old, changes, "product_id")


@query("SNK12", """select l_orderkey as request_id, string_agg(distinct cast(l_partkey as varchar), ',' order by cast(l_partkey as varchar)) as product_ids, 2 as logs, 'started,completed' as messages from lineitem group by 1""")
def requests(spark, d):
    """Orders as requests and their products as results: an older result of each is replaced."""
    lines = S.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("request_id"), F.col("l_partkey").cast("string").alias("product_id"), "l_linenumber")
    known = S.table(spark, d, "orders").select(F.col("o_orderkey").alias("request_id"))
    asked = known.unionByName(spark.createDataFrame([(-1,)], "request_id long"))
    fresh = lines.groupBy("request_id").agg(F.array_join(F.sort_array(F.collect_set("product_id")), ",").alias("product_ids"))
    older = lines.where("l_linenumber = 1").select("request_id", F.col("product_id").alias("product_ids"))
    results, logs = A.completed(asked, known, older, fresh)
    said = logs.groupBy("request_id").agg(F.count(F.lit(1)).cast("int").alias("logs"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("step", "message"))), lambda x: x["message"]), ",").alias("messages"))
    return results.join(said, "request_id").select("request_id", "product_ids", "logs", "messages")


@query("J03", "select user_id, n as pairs, count(*) as non_zero, round(sum(score), 4) as total, round(max(score), 6) as best from scored, (select count(*) as n from products) group by 1, 2", CONTENT)
def whole_matrix(spark, d):
    got = scoring.content_matrix(R._profile(spark, d), S.products(spark, d))
    return got.select("user_id", "pairs", "non_zero", F.round("total", 4).alias("total"), F.round("best", 6).alias("best"))


TOP = "top as (select * from (select *, row_number() over (partition by user_id order by score desc, product_id) as rank from (select user_id, product_id, sum(w) as score from weighted group by 1, 2)) where rank <= {k})"


@query("J11", """select user_id, n * (n - 1) * (n - 2) * (n - 3) // 24 as combinations, rank, products, total from (
  select a.user_id, concat_ws('+', a.product_id, b.product_id, c.product_id, e.product_id) as products, a.score + b.score + c.score + e.score as total,
    cast(row_number() over (partition by a.user_id order by a.score + b.score + c.score + e.score desc, a.rank, b.rank, c.rank, e.rank) as integer) as rank
  from top a join top b on a.user_id = b.user_id and a.rank < b.rank join top c on a.user_id = c.user_id and b.rank < c.rank join top e on a.user_id = e.user_id and c.rank < e.rank)
join (select user_id, count(distinct product_id) as n from weighted group by 1) using (user_id) where rank <= 5""",
       TOP.format(k=8))  # the best 5 sets of 4 are among the first 8: tests compare whole lists
def combinations(spark, d):
    """Each user's five best sets of four products of their whole list, and how many sets it has."""
    best = rankjoin.best_sets(R._two(spark, d)[0], 4, 5)
    return best.select("user_id", "combinations", "rank", F.array_join("products", "+").alias("products"), "total")


def _alike_sql(a: str, b: str) -> str:
    same = " + ".join(f"coalesce(cast({a}.{f} = {b}.{f} as integer), 0)" for f in V.FEATURES)
    return f"({same}) / sqrt({a}.known * {b}.known)"


_PAIRS = " + ".join(_alike_sql(a, b) for n, a in enumerate("abce") for b in "abce"[n + 1 :])
_SUM = "a.score + b.score + c.score + e.score"


@query("X12", f"""select user_id, products, round(score, 6) as score, round(item_part, 6) as item_part, round(pair_part, 6) as pair_part, rank from (select *, row_number() over (partition by user_id order by score desc, products) as rank from (
  select a.user_id, array_to_string([a.product_id, b.product_id, c.product_id, e.product_id], ',') as products, round({_SUM} + 0.5 * ({_PAIRS}), 9) as score, {_SUM} as item_part, 0.5 * ({_PAIRS}) as pair_part
  from candidates a join candidates b using (user_id) join candidates c using (user_id) join candidates e using (user_id)
  where a.slot = 'accessories' and b.slot = 'bottomwear' and c.slot = 'footwear' and e.slot = 'topwear' and len(list_distinct([a.usage, b.usage, c.usage, e.usage])) = 1)) where rank <= 10""",
       TOP.format(k=1000000) + """, candidates as (select top.*, products.* exclude (product_id), case when master_category = 'Accessories' then 'accessories' when sub_category = 'Bottomwear' then 'bottomwear' when sub_category = 'Topwear' then 'topwear' when master_category = 'Footwear' then 'footwear' end as slot,
  """ + " + ".join(f"cast({f} is not null as integer)" for f in V.FEATURES) + " as known from top join products using (product_id))")
def exhaustive_outfits(spark, d):
    rows = R._two(spark, d)[0].join(S.products(spark, d), "product_id").withColumn("slot", O.structure_slot(F.col("sub_category"), F.col("master_category")))
    return R._short(O.complete(rows).withColumn("products", F.array_join("products", ",")))


_TYPES = "[" + ", ".join(f"'{a}'" for a in sorted({a for v in V.ARTICLE_TYPES.values() for a in v})) + "]"
_SUBS = "(" + ", ".join(f"'{s}'" for s in V.ARTICLE_TYPES) + ")"
SHELVES = f"""shelves as (select person, shelf, sub_category, product_id, base from (
  select person, shelf, sub_category, product_id, rating / 5 as base, row_number() over (partition by person, shelf, sub_category order by product_id) as n
  from products, (values ('male'), ('female'), ('other')) k(person), (values ('Men'), ('Women'), ('Boys'), ('Girls'), ('Unisex'), ('any')) s(shelf)
  where (shelf = 'any' or gender = shelf) and sub_category in {_SUBS} and list_contains({_TYPES}, article_type)) where n <= 10),
people as (select user_id, case when gender in ('male', 'female') then gender else 'other' end as person,
  case gender when 'male' then case when age <= 12 then 'Boys' else 'Men' end when 'female' then case when age <= 12 then 'Girls' else 'Women' end else 'Unisex' end as own,
  ['Bags','Belts','Headwear','Watches'][cast(user_id as bigint) % 4 + 1] as accessory, ['Shoes','Sandal','Flip Flops'][cast(user_id as bigint) % 3 + 1] as footwear from users),
wanted as (select *, 'accessories' as slot, accessory as sub_category from people union all select *, 'bottomwear', 'Bottomwear' from people union all select *, 'topwear', 'Topwear' from people union all select *, 'footwear', footwear from people
  union all select *, 'dress', 'Dress' from people where person = 'female' union all select *, 'innerwear', 'Innerwear' from people where person = 'female'),
levelled as (select w.user_id, w.person, w.slot, s.product_id, s.base, case when s.shelf = own then 0 when s.shelf = 'Unisex' then 1 else 2 end as level from wanted w join shelves s on s.person = w.person and s.sub_category = w.sub_category and s.shelf in (own, 'Unisex', 'any')),
placed as (select l.*, top.score, row_number() over (partition by user_id, slot order by round(coalesce(top.score, base), 9) desc, product_id) as place, count(*) over (partition by user_id, slot) as n
  from (select *, min(level) over (partition by user_id, slot) as first from levelled) l left join top using (user_id, product_id) where level = first),
filled as (select *, count(*) filter (slot in ('accessories','bottomwear','footwear','topwear')) over (partition by user_id, t) as core, count(*) over (partition by user_id, t) as size from placed, generate_series(1, 3) g(t) where place = least(t, n))"""
BUILT = TOP.format(k=1000000) + ",\n" + SHELVES


@query("X14", "select user_id, cast(t as integer) as outfit_number, slot, product_id, coalesce(score, 0.0) as score, round(size / case when person = 'female' then 6 else 4 end, 6) as completeness from filled where core = 4", BUILT)
def built_outfits(spark, d):
    return R._short(O.built(drawn(spark, d), S.products(spark, d), R._two(spark, d)[0]))


def drawn(spark, d):
    """Users with the sub-categories of accessory and footwear that their outfits take."""
    key = F.col("user_id").cast("bigint")
    subs = [F.element_at(F.array(*map(F.lit, names)), (key % len(names) + 1).cast("int")).alias(n) for n, names in (("accessory", ("Bags", "Belts", "Headwear", "Watches")), ("footwear", ("Shoes", "Sandal", "Flip Flops")))]
    return S.users(spark, d).select("user_id", "age", "gender", *subs)


_MAP = "map {" + ", ".join(f"'{k}': {v}" for k, v in V.ARTICLE_TYPES.items()) + "}"
query("S10", f"""select distinct sub_category, person, array_to_string(case when person = 'male' and len(list_filter(a, lambda x: not list_contains({V.NOT_FOR_MEN}, x))) > 0 then list_filter(a, lambda x: not list_contains({V.NOT_FOR_MEN}, x))
  when person = 'other' and len(list_filter(a, lambda x: not list_contains({V.NOT_FOR_OTHERS}, x))) > 0 then list_filter(a, lambda x: not list_contains({V.NOT_FOR_OTHERS}, x)) else a end, ',') as articles
from (select sub_category, {_MAP}[sub_category] as a, case when gender in ('Men', 'Boys') then 'male' when gender in ('Women', 'Girls') then 'female' else 'other' end as person from products)""")(
    lambda spark, d: S.products(spark, d).select("sub_category", F.when(F.col("gender").isin("Men", "Boys"), "male").when(F.col("gender").isin("Women", "Girls"), "female").otherwise("other").alias("person")).distinct()
    .select("sub_category", "person", F.array_join(O.article_types(F.col("sub_category"), F.col("person")), ",").alias("articles")))


def _positives(spark, d):
    return S.interactions(spark, d).where(F.col("interaction_type").isin(*V.POSITIVE)).select("user_id", "product_id")


def _trained(spark, d, epochs: int = 10):
    start = R._nodes(spark, d, DIMS).select("node", F.array(*DIMS).alias("vector"))
    nodes, said = descent.train(start, _positives(spark, d), epochs, rate=0.01)
    return nodes.select("node", *[F.col("vector")[i].alias(x) for i, x in enumerate(DIMS)]), said


@query("X06")
def trained_ranking(spark, d):
    """Each user's 20 best products by vectors of 64 dimensions after 10 epochs."""
    vectors, _ = _trained(spark, d)
    return R._dense(vectors)


@query("X06_epochs", f"select cast(e as integer) as epoch, count(*) as pairs, e > 1 as learned from interactions, generate_series(1, 10) g(e) where interaction_type in {V.POSITIVE} group by e")
def epochs(spark, d):
    """Each epoch sees every positive interaction once, and each but the first has a lower loss than the first."""
    _, said = _trained(spark, d)
    first = said.where("epoch = 1").select(F.col("loss").alias("first"))  # one row
    return said.join(F.broadcast(first)).select("epoch", "pairs", (F.col("loss") < F.col("first")).alias("learned"))


@query("X06_shape", "select user_id, least(20, (select count(distinct product_id) from interactions)) as n, true as known, true as ordered from (select distinct user_id from interactions)")
def trained_shape(spark, d):
    """What holds for any trained ranking: as many different known products for each user, in descending order of score."""
    ranked, products = trained_ranking(spark, d), S.products(spark, d).select("product_id", F.lit(True).alias("known"))
    falls = F.col("score") <= F.lag("score", 1, float("inf")).over(Window.partitionBy("user_id").orderBy("rank"))
    rows = ranked.join(products, "product_id", "left").withColumn("falls", falls)
    return rows.groupBy("user_id").agg(F.count_distinct("product_id").alias("n"), F.min(F.coalesce("known", F.lit(False))).alias("known"), F.min("falls").alias("ordered"))


@query("X17")
def random_ranking(spark, d):
    return training.random_lists(S.users(spark, d), S.products(spark, d), 10, seed=7)


@query("X17_shape", "select user_id, least(10, (select count(*) from products)) as n, least(10, (select count(*) from products)) as known, least(10, (select count(*) from products)) as last from users")
def random_shape(spark, d):
    """What holds for any random lists: different known products, with ranks from 1."""
    ranked, products = random_ranking(spark, d), S.products(spark, d).select("product_id", F.lit(1).alias("one"))
    return ranked.join(products.hint("merge"), "product_id", "left").groupBy("user_id").agg(F.count_distinct("product_id").alias("n"), F.count("one").alias("known"), F.max("rank").cast("long").alias("last"))


# the engine: train if needed, score, personalise
@query("X15", "select user_id, product_id, rank, 'already_trained' as status from top where rank <= 5", TOP.format(k=5))
def engine(spark, d):
    """The artifact is made by the first call and found by the second; the ranking comes from what is stored."""
    at = A.path(spark, "engine")
    A.delete(spark, at)
    score = lambda: R._two(spark, d)[0]
    for _ in range(2):
        stored, kept = A.restore(spark, at, score)
    return scoring.top_k(stored, 5).select("user_id", "product_id", "rank", F.lit("already_trained" if kept else "training_completed").alias("status"))


_X16 = f"""select '5' as user_id, '12' as current_product_id, cast(null as varchar) as error,
  (select string_agg(product_id || ':' || cast(usage_match as varchar) || ':' || cast(gender_match as varchar), ',' order by rank) from ({{X10}}) where rank <= 6) as personalized,
  (select string_agg(cast(outfit_number as varchar) || ':' || products, ';' order by outfit_number) from ({{X11}})) as outfits
union all select 'nobody', '12', 'no_predictions_for_user', null, null union all select '5', 'none', 'missing_product', null, null"""


@query("X16", _X16.format(X10=R.X10_SQL, X11=R.X11_SQL), R.ONE)
def whole_response(spark, d):
    pair = spark.createDataFrame([("5", "12")], "user_id string, payload_id string")
    best, suits = R.prioritised(spark, d, pair), R.outfits(spark, d, pair)
    known = R._two(spark, d)[0]
    out = respond("5", "12", known, best, suits)
    out = out.unionByName(respond("nobody", "12", known, best.limit(0), suits.limit(0)))
    return out.unionByName(respond("5", "none", known, None, None))


# experiments
@query("X19")
def experiment(spark, d):
    """Content, trained graph and hybrid models in one table of results: model, metric, k, value."""
    truth, products = M.truth(S.interactions(spark, d)), S.products(spark, d)
    features = scoring.encode(products)
    results = spark.createDataFrame([("hybrid", "recall", 10, -1.0)], A.COMPARISON)  # of an earlier run: it gives way
    rankings, seconds = {}, {}
    vectors = content = None
    for model in ("cbf", "gnn", "hybrid"):
        began = time.monotonic()
        if model == "cbf":
            ranked, content = R._ranking(spark, d), R._content_vectors(spark, d)
        elif model == "gnn":
            vectors, _ = _trained(spark, d)
            ranked = R._dense(vectors)
        else:  # the blend of both models' whole score tables
            ranked = G.dense_hybrid(R._sides(vectors), content)
        at = A.path(spark, f"ranking-{model}")
        ranked.select("user_id", "product_id", "score", "rank").write.mode("overwrite").parquet(at)
        rankings[model], seconds[model] = spark.read.parquet(at), time.monotonic() - began
    times = M.timings(seconds)
    for model, ranking in rankings.items():
        found = M.suite(ranking, truth, products, features=features).select(F.lit(model).alias("model"), "metric", "k", "value")
        timed = spark.createDataFrame([(model, m, 0, v) for m, v in times[model].items()], A.COMPARISON)
        results = S.upsert(results, found.unionByName(timed), "model")
    return results


_TIMED = "select model, inference_time as t from results where model <> 'hybrid' union all select 'hybrid', sum(inference_time) from results where model <> 'hybrid'"


@query("E10", f"select model, 'training_time' as metric, t as value from ({_TIMED}) union all select model, 'inference_time', t + case when model = 'hybrid' then {M.BLEND_SECONDS} else 0 end from ({_TIMED})", P.RESULTS)
def times(spark, d):
    seconds = {r["model"]: r["inference_time"] for r in P.model_results(spark, d).collect()}  # a row a model
    return spark.createDataFrame([(m, k, v) for m, t in M.timings(seconds).items() for k, v in t.items()], "model string, metric string, value double")


# candidates with the user's style
STYLED = TOP.format(k=20) + f""",
styles as (select user_id, token, weight from (select user_id, token, sum(w) as weight, row_number() over (partition by user_id order by sum(w) desc, token) as r from weighted join (select product_id, lower(value) as token from products unpivot (value for f in (base_colour, usage, article_type))) using (product_id) group by 1, 2) where r <= 20),
listed as (select top.*, {KEY_SQL} as slot, list_filter([lower(usage), lower(base_colour), lower(article_type), lower(sub_category)], lambda x: x is not null) as tokens from top join products using (product_id)),
hits as (select user_id, product_id, sum(weight) as bonus, list(token order by place) as found from (select distinct user_id, product_id, token, list_position(tokens, token) as place from (select user_id, product_id, tokens, unnest(tokens) as token from listed)) join styles using (user_id, token) group by 1, 2)"""


def _styled(spark, d):
    p = S.products(spark, d)
    kept = p.select("product_id", C.lookup(V.CATEGORY_KEYS, F.col("sub_category")).alias("slot"), personal.tokens("usage", "base_colour", "article_type", "sub_category").alias("tokens"))
    best = scoring.top_k(R._two(spark, d)[0], 20).drop("rank")
    return best.join(kept, "product_id"), personal.style_profile(S.interactions(spark, d), p)


@query("W20", "select user_id, product_id, score, row_number() over (partition by user_id order by score desc, product_id) as rank from (select user_id, product_id, round(score + coalesce(bonus, 0), 9) as score from listed left join hits using (user_id, product_id) where slot = 'footwear')", STYLED)
def category_ranking(spark, d):
    return personal.ranked_in_category(*_styled(spark, d), "footwear")


@query("W21", f"select user_id, product_id, score, rank, case when found is null then '{personal.NO_REASON}' else 'Similar to your favorite (' || array_to_string(found[1:3], ', ') || ')' end as reason from listed left join hits using (user_id, product_id) where rank <= 6", STYLED)
def personal_selection(spark, d):
    return personal.selection(*_styled(spark, d), 6)


_TAG = "case article_type " + " ".join(f"when '{k}' then '{v}'" for k, v in V.CATEGORY_TAGS.items()) + " end"
_RULES = "case tag " + " ".join(f"when '{k}' then '{','.join(v)}'" for k, v in V.COMPLETION.items()) + " end"


@query("S11", f"""select product_id, {_RULES} as fixed, case when tag in ('tops', 'bottoms', 'dresses') then {_RULES} when gender in ('Women', 'Girls') then 'tops,bottoms,dresses' else 'tops,bottoms' end as by_gender
from (select product_id, gender, {_TAG} as tag from products)""")
def completion_rules(spark, d):
    tag = C.lookup(V.CATEGORY_TAGS, F.col("article_type"))
    return S.products(spark, d).select("product_id", F.array_join(personal.completion(tag), ",").alias("fixed"), F.array_join(personal.completion(tag, F.col("gender")), ",").alias("by_gender"))


@query("J21", """select product_id, case when article_type = 'Jeans' then 'Denim' when article_type = 'Casual Shoes' then 'Walking' else coalesce(map {'jeans': 'Denim', 'casual-shoes': 'Walking', 'red': 'Reds', 'blue': 'Blues'}[split_part(trim(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '-'), '-', 1)], 'First') end as category from products""")
def category_fallback(spark, d):
    catalog = spark.createDataFrame([("accents", "First", 0), ("jeans", "Denim", 1), ("casual-shoes", "Walking", 2), ("red", "Reds", 3), ("blue", "Blues", 4)], "key string, category string, position int")
    return personal.category_of(S.products(spark, d).select("product_id", "article_type", "name"), catalog, "article_type", "name").select("product_id", "category")


@query("F32", f"""select user_id, coalesce((select min(product_id) from shelf where list_contains(allowed, gender) and shelf.age_group = c.age_group), (select min(product_id) from shelf)) as product_id
from (select user_id, {ALLOWED_SQL} as allowed, case when age <= 12 then 'kid' when age <= 19 then 'teen' else 'adult' end as age_group from users) c""",
       "shelf as (select product_id, gender, case when gender in ('Boys', 'Girls') then 'kid' else 'adult' end as age_group from products where sub_category = 'Shoes' and product_id not in ('3', '5'))")
def fallback_search(spark, d):
    group = F.when(F.col("gender").isin("Boys", "Girls"), "kid").otherwise("adult")
    shelf = S.products(spark, d).where("sub_category = 'Shoes' and product_id not in ('3', '5')").select("product_id", "gender", group.alias("age_group"))
    contexts = S.users(spark, d).select("user_id", C.allowed_genders(F.col("age"), F.col("gender")).alias("allowed"), C.age_group(F.col("age")).alias("age_group"))
    return personal.fallback_product(contexts, shelf).select("user_id", "product_id")
