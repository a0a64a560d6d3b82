"""Profiles, pruning, encoding, scoring, ranking, outfits, evaluation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomfold.functions import columns as C
from loomfold.functions import values as V
from loomfold.operators import graph as G
from loomfold.operators import metrics as M
from loomfold.operators import outfits as O
from loomfold.operators import personal, pruning, scoring
from loomfold.plans.catalog import ALLOWED_SQL, KEY_SQL, simple
from loomfold.plans.registry import query
from loomfold.sources import tables as S
from loomfold.sources.scratch import materialise


def _short(df):
    """The ratio columns of a result, rounded for comparison."""
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


CELLS = """cells as (select product_id, feature, value from products unpivot (value for feature in (master_category, sub_category, article_type, base_colour, usage)))"""
PROFILE = CELLS + """,
totals as (select user_id, sum(w) as total from weighted join products using (product_id) group by 1),
profile as (select user_id, feature, value, sum(w) / any_value(total) as weight from weighted join cells using (product_id) join totals using (user_id) group by 1, 2, 3)"""
CONTENT = PROFILE + """,
norms as (select user_id, sqrt(sum(weight * weight)) as norm from profile group by 1), sizes as (select product_id, sqrt(count(*)) as size from cells group by 1),
scored as (select user_id, product_id, round(sum(weight / size) / any_value(norm), 9) as score from profile join cells using (feature, value) join norms using (user_id) join sizes using (product_id) group by 1, 2),
ranking as (select * from (select *, row_number() over (partition by user_id order by score desc, product_id) as rank from scored) where rank <= 20)"""
TRUTH = "truth as (select distinct user_id, product_id from interactions where interaction_type in ('purchase','like','cart'))"
FEW = "try_cast(user_id as integer) % 25 = 0"


def _profile(spark, d):
    return scoring.profiles(S.interactions(spark, d), S.products(spark, d))


def _ranking(spark, d):
    return scoring.content_ranking(S.interactions(spark, d), S.products(spark, d))


@query("A01", "select user_id, feature, value, round(weight, 6) as weight from profile", PROFILE)
def user_profiles(spark, d):
    return _short(_profile(spark, d))


@query("J02", """select (select count(*) from event_rows where product_id in (select product_id from cells)) as matched, (select count(distinct product_id) from event_rows where product_id in (select product_id from cells)) as products,
(select count(distinct product_id) from event_rows where product_id not in (select product_id from cells)) as skipped, (select coalesce(string_agg(product_id, ',' order by product_id), '') from (select distinct product_id from event_rows where product_id not in (select product_id from cells) order by 1 limit 10)) as examples""", CELLS)
def matched_features(spark, d):
    return scoring.matched_features(S.events(spark, d), scoring.encode(S.products(spark, d)))


@query("A02", "select user_id, count(w) as interaction_count, coalesce(sum(w), 0.0) as total_weight, round(coalesce(sum(w) / count(w), 0.0), 6) as avg_weight from users left join weighted using (user_id) group by 1")
def stats(spark, d):
    return _short(scoring.user_stats(S.interactions(spark, d), S.users(spark, d)))


PREFS = """prefs as (select user_id, attribute, value, sum(w) / max(sum(w)) over (partition by user_id, attribute) as preference from weighted
  join (select product_id, attribute, value from products unpivot (value for attribute in (article_type, usage, gender))) using (product_id) group by 1, 2, 3)"""


@query("A03", "select user_id, attribute, value, round(preference, 6) as preference from prefs", PREFS)
def preference_maps(spark, d):
    return _short(scoring.preferences(S.interactions(spark, d), S.products(spark, d)))


@query("J01", "select user_id, article_type, sum(w) as w from weighted join products using (product_id) group by 1, 2")
def preference_join(spark, d):
    return scoring.pair_weights(S.interactions(spark, d), "pipeline").join(S.products(spark, d), "product_id").groupBy("user_id", "article_type").agg(F.sum("w").alias("w"))


ROUNDS = 8
PRUNED = "r0 as (select user_id, product_id, ts, l_orderkey, l_linenumber from interactions where interaction_type = 'purchase')" + "".join(
    f", r{i + 1} as materialized (select * from r{i} where user_id in (select user_id from r{i} group by 1 having count(*) >= 7) and product_id in (select product_id from r{i} group by 1 having count(*) >= 7))" for i in range(ROUNDS))


def _purchases(spark, d):
    return S.interactions(spark, d).where("interaction_type = 'purchase'").select("user_id", "product_id", "ts", "l_orderkey", "l_linenumber")


@query("A04", f"select user_id, product_id, ts from r{ROUNDS}", PRUNED)
def k_core(spark, d):
    rows, _ = pruning.k_core(_purchases(spark, d), 7)
    return rows.select("user_id", "product_id", "ts")


_DENSITY = "count(*) as rows, count(distinct user_id) as users, count(distinct product_id) as products, count(*) / (count(distinct user_id) * count(distinct product_id)) as density"


@query("A05", f"""select stage, rows, users, products, round(coalesce(density, 0), 9) as density, round(coalesce(density - (select density from before), 0), 9) as improvement
from (select 'before' as stage, * from before union all select 'after', * from after)""", PRUNED + f", before as (select {_DENSITY} from r0), after as (select {_DENSITY} from r{ROUNDS})")
def sparsity(spark, d):
    rows = pruning.progress(_purchases(spark, d), 7)
    first = F.max(F.when(F.col("stage") == "before", F.col("density"))).over(Window.partitionBy())  # two rows
    return rows.select("stage", "rows", "users", "products", F.round("density", 9).alias("density"), F.round(F.col("density") - first, 9).alias("improvement"))


@query("A22", f"""select * from (select user_id, token, sum(w) as weight, row_number() over (partition by user_id order by sum(w) desc, token) as r from (
  select user_id, token, w from weighted join t using (product_id) union all select user_id, lower(segment), {V.PREFERENCE_WEIGHT} from users union all select user_id, token, {V.CURRENT_WEIGHT} from users join t on t.product_id = cast(cast(user_id as bigint) % 100 + 1 as varchar)) group by 1, 2) where r <= 20""",
       "t as (select product_id, lower(value) as token from products unpivot (value for f in (base_colour, usage, article_type)))")
def style_profile(spark, d):
    """History, the segment as the user's stated style, and a product looked at."""
    users = S.users(spark, d)
    current = users.select("user_id", (F.col("user_id").cast("bigint") % 100 + 1).cast("string").alias("product_id"))
    return personal.style_profile(S.interactions(spark, d), S.products(spark, d), preferences=users.select("user_id", F.col("segment").alias("token")), current=current)


@query("X01", "select product_id, feature, value, feature_index from cells join (select feature, value, row_number() over (order by list_position(['master_category','sub_category','article_type','base_colour','usage'], feature), value) - 1 as feature_index from (select distinct feature, value from cells)) using (feature, value)", CELLS)
def encoding(spark, d):
    return scoring.encode(S.products(spark, d))


@query("A27", "select feature, count(distinct value) as dims, count(*) as non_zero from cells group by 1", CELLS)
def facet_counts(spark, d):
    return scoring.encode(S.products(spark, d)).groupBy("feature").agg(F.count_distinct("value").alias("dims"), F.count(F.lit(1)).alias("non_zero"))


@query("X02", "select user_id, product_id, score, rank from ranking", CONTENT)
def content(spark, d):
    return _ranking(spark, d)


@query("W01", "select user_id, product_id, rank from (select *, row_number() over (partition by user_id order by score desc, product_id) as rank from (select user_id, product_id, sum(w) as score from weighted group by 1, 2)) where rank <= 20")
def top(spark, d):
    return scoring.top_k(scoring.pair_weights(S.interactions(spark, d)).select("user_id", "product_id", F.col("w").alias("score")), 20).select("user_id", "product_id", "rank")


@query("W02", "select user_id, product_id, rank from (select *, row_number() over (partition by user_id order by -score, product_id) as rank from (select user_id, product_id, sum(w) as score from weighted group by 1, 2)) where rank <= 5")
def tie_broken(spark, d):
    return scoring.top_k(scoring.pair_weights(S.interactions(spark, d)).select("user_id", "product_id", F.col("w").alias("score")), 5).select("user_id", "product_id", "rank")


simple("W03", "select product_id, max(w) as best from weighted group by 1", lambda i: i.groupBy("product_id").agg(F.max(C.weight(F.col("interaction_type"))).alias("best")), S.interactions)
simple("W04", "select user_id, product_id, row_number() over (partition by user_id order by ts, l_orderkey, l_linenumber, product_id, interaction_type) as rank from interactions", lambda i: i.withColumn("rank", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "l_orderkey", "l_linenumber", "product_id", "interaction_type"))).select("user_id", "product_id", "rank"), S.interactions)


@query("W05", "select user_id, round(sum(1 / log2(rank + 1)), 6) as discount from ranking group by 1", CONTENT)
def discounts(spark, d):
    return _ranking(spark, d).groupBy("user_id").agg(F.round(F.sum(1 / F.log2(F.col("rank") + 1.0)), 6).alias("discount"))


# metrics of a ranking
def _per_user(name: str, ranking: str) -> str:
    return f"""{name}_hits as (select user_id, count(*) filter (rank <= 10) as h10, sum(case when rank <= 10 then 1 / log2(rank + 1) end) as d10, count(*) as h20, sum(1 / log2(rank + 1)) as d20 from {ranking} join truth using (user_id, product_id) group by 1),
{name} as (select user_id, relevant, coalesce(h10, 0) as h10, coalesce(h20, 0) as h20, coalesce(d10, 0.0) as d10, coalesce(d20, 0.0) as d20, a.ideal as i10, b.ideal as i20
  from relevant left join {name}_hits using (user_id) join ideal a on a.n = least(relevant, 10) join ideal b on b.n = least(relevant, 20))"""


PER_USER = CONTENT + "," + TRUTH + """,
relevant as (select user_id, count(*) as relevant from truth group by 1),
ideal as (select n, (select sum(1 / log2(i + 1)) from generate_series(1, n) g(i)) as ideal from generate_series(1, 20) t(n)),
""" + _per_user("per_user", "ranking")
HISTORY = PER_USER + """,
history as (select * from (select user_id, product_id, row_number() over (partition by user_id order by sum(w) desc, product_id) as rank from weighted group by 1, 2) where rank <= 20),
""" + _per_user("per_history", "history")


def _metric(k, column):
    def run(spark, d):
        rows = M.per_user(_ranking(spark, d), M.truth(S.interactions(spark, d)), k)
        return rows.select("user_id", F.round(column, 6).alias(column))

    return run


query("E01", "select user_id, round(h10 / relevant, 6) as recall from per_user", PER_USER)(_metric(10, "recall"))
query("E02", "select user_id, round(h10 / 10, 6) as precision from per_user", PER_USER)(_metric(10, "precision"))
query("E03", "select user_id, round(d10, 6) as dcg from per_user", PER_USER)(_metric(10, "dcg"))
query("E04", "select user_id, round(d10 / i10, 6) as ndcg from per_user", PER_USER)(_metric(10, "ndcg"))


@query("E05", f"""select user_id, round(greatest(0, 2 * sum(1 - coalesce(c, 0)) / (any_value(n) * (any_value(n) - 1))), 6) as ild from (
  select a.user_id, a.product_id, b.product_id, any_value(n) as n, sum(case when ca.feature = cb.feature and ca.value = cb.value then 1 / (sa.size * sb.size) else 0 end) as c
  from (select *, count(*) over (partition by user_id) as n from ranking where rank <= 10 and {FEW}) a join ranking b on a.user_id = b.user_id and a.rank < b.rank and b.rank <= 10
  join cells ca on ca.product_id = a.product_id join cells cb on cb.product_id = b.product_id join sizes sa on sa.product_id = a.product_id join sizes sb on sb.product_id = b.product_id group by 1, 2, 3) group by 1""".replace(f" and {FEW}", ""), CONTENT)
def diversity(spark, d):
    features = scoring.encode(S.products(spark, d))
    return _short(M.intra_list(_ranking(spark, d), features, 10))


@query("E07", "select count(distinct product_id) as covered, (select count(*) from products) as items, round(count(distinct product_id) / (select count(*) from products), 6) as coverage from ranking", CONTENT)
def coverage(spark, d):
    return _short(M.coverage(_ranking(spark, d), S.products(spark, d)))


def _suite_sql(per_user: str, ranking: str) -> str:
    rows = [f"select '{m}' as metric, {k} as k, round(avg({c}), 6) as value from {per_user}" for k in (10, 20) for m, c in (("recall", f"h{k} / relevant"), ("precision", f"h{k} / {k}"), ("ndcg", f"d{k} / i{k}"))]
    rows.append(f"select 'coverage', 20, round(count(distinct product_id) / (select count(*) from products), 6) from {ranking}")
    rows.append(f"""select 'ild', 20, round(avg(ild), 6) from (select user_id, greatest(0, 2 * sum(1 - coalesce(c, 0)) / (any_value(n) * (any_value(n) - 1))) as ild from (
  select a.user_id, a.product_id, b.product_id, any_value(n) as n, sum(case when ca.feature = cb.feature and ca.value = cb.value then 1 / (sa.size * sb.size) else 0 end) as c
  from (select *, count(*) over (partition by user_id) as n from {ranking}) a join {ranking} b on a.user_id = b.user_id and a.rank < b.rank
  join cells ca on ca.product_id = a.product_id join cells cb on cb.product_id = b.product_id join sizes sa on sa.product_id = a.product_id join sizes sb on sb.product_id = b.product_id group by 1, 2, 3) group by 1)""")
    return " union all ".join(rows)


def _measured(spark, d, ranking, relevant=None):
    """The suite of a ranking, which is stored as several aggregates read it."""
    products = S.products(spark, d)
    stored = materialise(ranking.select("user_id", "product_id", "rank"), "ranking")
    return _short(M.suite(stored, M.truth(S.interactions(spark, d)) if relevant is None else relevant, products, features=scoring.encode(products)))


METRICS = ["coverage", "ild", "ndcg", "precision", "recall"]
query("E08", _suite_sql("per_user", "ranking"), PER_USER)(lambda spark, d: _measured(spark, d, _ranking(spark, d)))


@query("E12", "select * from (pivot (" + " union all ".join(f"select '{m}' as model, * from ({_suite_sql(*names)})" for m, *names in (("cbf", "per_user", "ranking"), ("history", "per_history", "history"))) + f") on metric in ({', '.join(repr(m) for m in METRICS)}) using first(value))", HISTORY)
def comparison_table(spark, d):
    """Content and a plain model, each user's products by summed weight. That model and the truth of both come from one stored table of pairs."""
    liked = F.col("interaction_type").isin(*V.POSITIVE)
    pairs = materialise(scoring.weighted(S.interactions(spark, d)).groupBy("user_id", "product_id").agg(F.sum("w").alias("score"), F.max(liked).alias("liked")), "pairs")
    truth = pairs.where("liked").select("user_id", "product_id")
    history = scoring.top_k(pairs.select("user_id", "product_id", "score"), 20)
    rows = [_measured(spark, d, ranking, truth).withColumn("model", F.lit(m)) for m, ranking in (("cbf", _ranking(spark, d)), ("history", history))]
    return rows[0].unionByName(rows[1]).groupBy("model", "k").pivot("metric", METRICS).agg(F.first("value"))


query("E11", "select user_id, count(*) as n from truth group by 1", TRUTH)(lambda spark, d: M.truth(S.interactions(spark, d)).groupBy("user_id").agg(F.count(F.lit(1)).alias("n")))
query("J09", "select user_id, count(*) as hits from ranking join truth using (user_id, product_id) group by 1", CONTENT + "," + TRUTH)(lambda spark, d: _ranking(spark, d).join(M.truth(S.interactions(spark, d)), ["user_id", "product_id"]).groupBy("user_id").agg(F.count(F.lit(1)).alias("hits")))


# vectors
def _vectors(spark, d):
    return S.table(spark, d, "embeddings")


query("M01", "select vec_id, round(list_cosine_similarity(cast(embedding as double[]), cast(list_reverse(embedding) as double[])), 6) as cosine, round(sqrt(list_dot_product(cast(embedding as double[]), cast(embedding as double[]))), 6) as norm from embeddings")(
    lambda spark, d: _vectors(spark, d).select("vec_id", F.round(C.cosine(F.col("embedding"), F.reverse("embedding")), 6).alias("cosine"), F.round(C.norm(F.col("embedding")), 6).alias("norm")))
query("M02", "select vec_id, round(greatest(0, least(1, list_cosine_similarity(cast(embedding as double[]), cast(list_reverse(embedding) as double[])))), 6) as cosine from embeddings")(
    lambda spark, d: _vectors(spark, d).select("vec_id", F.round(C.clipped(C.cosine(F.col("embedding"), F.reverse("embedding"))), 6).alias("cosine")))


@query("M03", "select product_id, round((price - low) / case when high = low then 1 else high - low end, 6) as x from products, (select min(price) as low, max(price) as high from products)")
def scaled(spark, d):
    p = S.products(spark, d)
    return p.join(F.broadcast(p.agg(F.min("price").alias("low"), F.max("price").alias("high")))).select("product_id", F.round(C.min_max(F.col("price"), F.col("low"), F.col("high")), 6).alias("x"))


simple("M04", "select product_id, round(0.3 * rating + 0.7 * num_reviews, 6) as x from products", lambda p: p.select("product_id", F.round(C.blend(F.col("rating"), F.col("num_reviews"), 0.3), 6).alias("x")))

# graph
EDGES = "edges as (select 'u:' || user_id as src, 'p:' || product_id as dst from interactions union all select 'p:' || product_id, 'u:' || user_id from interactions), degrees as (select src as node, count(*) as degree from edges group by 1)"
DIMS = [f"x{i}" for i in range(64)]
DEPTH = 3


def _layers_sql(dims: int) -> str:
    """l0 to l3: the vectors before and after each layer; with identity weights the dimensions don't mix."""
    start = ", ".join(f"((cast(substr(node, 3) as bigint) * {7 + i} + {i * 13} + case when starts_with(node, 'u:') then 5 else 0 end) % 11 - 5) / 10.0::double as x{i}" for i in range(dims))
    layer = "l{n} as materialized (select node, " + ", ".join(f"case when x{i} > 0 then x{i} else 0.2 * x{i} end as x{i}" for i in range(dims)) + " from (select dst as node, " + ", ".join(f"sum(x{i} / norm) as x{i}" for i in range(dims)) + " from messages join l{p} on l{p}.node = src group by 1))"
    return EDGES + f", messages as materialized (select src, dst, sqrt(a.degree * b.degree) as norm from edges join degrees a on a.node = src join degrees b on b.node = dst), l0 as (select node, {start} from degrees)," + ",".join(layer.format(n=n + 1, p=n) for n in range(DEPTH))


LAYERS = _layers_sql(3)


def _states(spark, d, dims=DIMS):
    links = G.counted(S.interactions(spark, d))
    key, off = F.expr("substring(node, 3)").cast("bigint"), F.when(F.col("node").startswith("u:"), 5).otherwise(0)
    start = links.select(F.col("src").alias("node")).distinct().select("node", *[((key * (7 + n) + n * 13 + off) % 11 - 5).cast("double").__truediv__(10.0).alias(x) for n, x in enumerate(dims)])
    return G.layers(materialise(links, "links"), start, dims, DEPTH)


def _nodes(spark, d, dims=DIMS):
    return _states(spark, d, dims)[-1]


query("X03", "select node, row_number() over (order by case when starts_with(node, 'u:') then 0 else 1 end, node) - 1 as node_index from degrees", EDGES)(lambda spark, d: G.node_index(S.interactions(spark, d)))
query("M06", "select node, round(1 / sqrt(degree), 6) as norm from degrees", EDGES)(lambda spark, d: G.counted(S.interactions(spark, d)).groupBy(F.col("src").alias("node")).agg(F.sum("times").alias("degree")).select("node", F.round(C.inverse_sqrt(F.col("degree")), 6).alias("norm")))
query("J19", "select dst, count(*) as messages, round(sum(1 / sqrt(degree)), 6) as total from edges join degrees on node = src group by 1", EDGES)(
    lambda spark, d: (lambda links: links.join(links.groupBy("src").agg(F.sum("times").alias("degree")), "src").groupBy("dst").agg(F.sum("times").alias("messages"), F.round(F.sum(F.col("times") * C.inverse_sqrt(F.col("degree"))), 6).alias("total")))(G.counted(S.interactions(spark, d))))
query("X04", "select node, round(x0, 6) as x0, round(x1, 6) as x1, round(x2, 6) as x2 from l3", LAYERS)(lambda spark, d: _short(_nodes(spark, d, DIMS[:3])))
_length = "sqrt(a.x0 * a.x0 + a.x1 * a.x1 + a.x2 * a.x2)"
_moved = "sum((a.x0 - b.x0) * (a.x0 - b.x0) + (a.x1 - b.x1) * (a.x1 - b.x1) + (a.x2 - b.x2) * (a.x2 - b.x2))"
query("X04_figures", " union all ".join(f"select {n} as layer, round(avg({_length}), 6) as mean_norm, round(stddev_samp({_length}), 6) as std_norm, round(sqrt({_moved}), 6) as change from l{n} a join l{n - 1} b using (node)" for n in range(1, DEPTH + 1)), LAYERS)(lambda spark, d: _short(G.layer_figures(_states(spark, d, DIMS[:3]), DIMS[:3])))

GRAPH = _layers_sql(len(DIMS)) + f""",
vectors as (select node, [{", ".join(DIMS)}] as v from l3),
graph_scores as (select substr(u.node, 3) as user_id, substr(p.node, 3) as product_id, round(list_dot_product(u.v, p.v), 6) as score from vectors u, vectors p where starts_with(u.node, 'u:') and starts_with(p.node, 'p:')),
graph_ranking as (select * from (select *, row_number() over (partition by user_id order by score desc, product_id) as rank from graph_scores) where rank <= 20)"""


def _sides(nodes, dims=DIMS):
    vectors = nodes.select("node", F.array(*dims).alias("vector"))
    users = vectors.where("node like 'u:%'").select(F.expr("substring(node, 3)").alias("user_id"), "vector")
    return users, vectors.where("node like 'p:%'").select(F.expr("substring(node, 3)").alias("product_id"), "vector")


def _dense(nodes, dims=DIMS):
    """Each user's 20 best products by dot product, of a stored table of vectors."""
    return G.dense_top_k(*_sides(nodes, dims), 20)


def _content_vectors(spark, d):
    users, items = scoring.content_vectors(_profile(spark, d), S.products(spark, d))
    return materialise(users, "content-users"), materialise(items, "content-items")


X07_WHOLE = GRAPH + "," + CONTENT.replace("ranking as (select", "content_ranking as (select") + """,
every as (select user_id, product_id, g.score as g, coalesce(c.score, 0) as c from (select substr(u.node, 3) as user_id, substr(p.node, 3) as product_id, list_dot_product(u.v, p.v) as score from vectors u, vectors p where starts_with(u.node, 'u:') and starts_with(p.node, 'p:')) g left join scored c using (user_id, product_id)),
ends as (select min(g) as g0, max(g) - min(g) as gr, min(c) as c0, max(c) - min(c) as cr from every),
blended as (select user_id, product_id, round(0.5 * (g - g0) / gr + 0.5 * (c - c0) / cr, 6) as score from every, ends)"""


@query("X07_whole", "select user_id, max(score) as best, count(*) filter (rank <= 20) as n, cast(round(sum(cast(round(score * 1000000) as bigint)) filter (rank <= 20) / 1000) as bigint) as total from (select *, row_number() over (partition by user_id order by score desc, product_id) as rank from blended) group by 1", X07_WHOLE)
def hybrid_whole(spark, d):
    """The blend of the whole graph and content score tables: each user's best score and the sum of the 20 best, in thousandths."""
    nodes = _nodes(spark, d)
    best = G.dense_hybrid(_sides(nodes), _content_vectors(spark, d))
    return best.groupBy("user_id").agg(F.max("score").alias("best"), F.count(F.lit(1)).alias("n"), F.round(F.sum(F.round(F.col("score") * 1000000).cast("bigint")) / 1000).cast("bigint").alias("total"))


query("X05", "select user_id, product_id, score, rank from graph_ranking", GRAPH)(lambda spark, d: _dense(_nodes(spark, d)).select("user_id", "product_id", "score", "rank"))


# hybrid of two score tables
WEIGHTS = "wa as (select user_id, product_id, sum(w) as score from weighted group by 1, 2), wb as (select user_id, product_id, cast(count(*) as double) as score from event_rows group by 1, 2)"
HYBRID = WEIGHTS + """, hybrid as (select user_id, product_id, 0.5 * (coalesce(a.score, 0) - (select min(score) from wa)) / (select max(score) - min(score) from wa) + 0.5 * (coalesce(b.score, 0) - (select min(score) from wb)) / (select max(score) - min(score) from wb) as score from wa a full join wb b using (user_id, product_id))"""


def _two(spark, d):
    a = scoring.pair_weights(S.interactions(spark, d)).select("user_id", "product_id", F.col("w").alias("score"))
    b = S.events(spark, d).groupBy("user_id", "product_id").agg(F.count(F.lit(1)).cast("double").alias("score"))
    return a, b


query("X07", "select user_id, product_id, round(score, 6) as score from hybrid", HYBRID)(lambda spark, d: _short(scoring.hybrid(*_two(spark, d))))
query("J04", "select count(*) as pairs, count(*) filter (a.score is null) as no_a, count(*) filter (b.score is null) as no_b from wa a full join wb b using (user_id, product_id)", WEIGHTS)(
    lambda spark, d: (lambda a, b: a.join(b.withColumnRenamed("score", "b"), ["user_id", "product_id"], "full").agg(F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("score").isNull()).alias("no_a"), F.count_if(F.col("b").isNull()).alias("no_b")))(*_two(spark, d)))
query("F27", "select distinct user_id from hybrid", HYBRID)(lambda spark, d: scoring.hybrid(*_two(spark, d)).select("user_id").distinct())
query("P06", "select user_id, string_agg(product_id, ',' order by score desc, product_id) as best from (select *, row_number() over (partition by user_id order by score desc, product_id) as r from wa) where r <= 5 group by 1", WEIGHTS)(
    lambda spark, d: scoring.top_k(_two(spark, d)[0], 5).groupBy("user_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "product_id"))), lambda x: x["product_id"]), ",").alias("best")))

# requests: a user and a payload product; the test requests are the first product of each sub-category and gender
BATCH_SQL = "select cast(cast(product_id as bigint) % 100 + 1 as varchar) as user_id, product_id as payload_id from (select product_id, row_number() over (partition by sub_category, gender order by cast(product_id as bigint)) as r from products) where r = 1"
SINGLE_SQL = "select '5' as user_id, '12' as payload_id"


def _requests_sql(pairs: str) -> str:
    return PREFS + f""",
asked as (select q.user_id || ':' || q.payload_id as request_id, q.user_id, q.payload_id, age, {ALLOWED_SQL.replace("gender", "u.gender")} as allowed, p.gender as payload_gender, p.article_type as payload_article, p.usage as payload_usage, p.slot as payload_slot
  from ({pairs}) q join users u on u.user_id = q.user_id join (select *, {KEY_SQL} as slot from products) p on p.product_id = q.payload_id),
liked as (select user_id, product_id, sum(w) / 10 as score from weighted group by 1, 2),
base as (select asked.*, p.product_id, p.gender, p.usage, p.article_type, {KEY_SQL} as slot, coalesce(s.score, 0.0) as base_score, coalesce(a.preference, 0.0) as article_pref, coalesce(g.preference, 0.0) as usage_pref
  from asked join products p on p.product_id <> payload_id left join liked s on s.user_id = asked.user_id and s.product_id = p.product_id
  left join prefs a on a.user_id = asked.user_id and a.attribute = 'article_type' and a.value = p.article_type left join prefs g on g.user_id = asked.user_id and g.attribute = 'usage' and g.value = p.usage)"""


REQUESTS, ONE = _requests_sql(BATCH_SQL), _requests_sql(SINGLE_SQL)


def requests(spark, d, pairs=None):
    """request_id, user_id, age, allowed, payload_id and the payload's attributes. pairs: user_id, payload_id.
    Users and catalog are joined by shuffles: beside pairs of unknown size Spark would broadcast them whole."""
    p = S.products(spark, d)
    if pairs is None:
        key = F.col("product_id").cast("bigint")
        first = p.groupBy("sub_category", "gender").agg(F.min(key).alias("k"))
        pairs = first.select((F.col("k") % 100 + 1).cast("string").alias("user_id"), F.col("k").cast("string").alias("payload_id"))
    users = S.users(spark, d).select("user_id", "age", C.allowed_genders(F.col("age"), F.col("gender")).alias("allowed"))
    payload = p.select(F.col("product_id").alias("payload_id"), F.col("gender").alias("payload_gender"), F.col("article_type").alias("payload_article"), F.col("usage").alias("payload_usage"), C.lookup(V.CATEGORY_KEYS, F.col("sub_category")).alias("payload_slot"))
    return pairs.join(users.hint("merge"), "user_id").join(payload.hint("merge"), "payload_id").withColumn("request_id", F.concat_ws(":", "user_id", "payload_id"))


def _candidates(spark, d, pairs=None):
    return scoring.of_requests(requests(spark, d, pairs), S.products(spark, d), S.interactions(spark, d))


@query("F14", """select request_id, initial_count, after_articletype, after_age_gender, final_count, initial_count - final_count as removed_count, round((initial_count - final_count) * 100.0 / initial_count, 6) as reduction_rate from (
  select *, least(after_age_gender, 10) as final_count from (select request_id, count(*) as initial_count, count(*) filter (article_type = payload_article) as after_articletype, count(*) filter (article_type = payload_article and list_contains(allowed, gender)) as after_age_gender from base group by 1))""", REQUESTS)
def funnel(spark, d):
    return scoring.funnel(requests(spark, d), S.products(spark, d))


@query("X09", "select request_id, product_id, base_score, rank from (select *, row_number() over (partition by request_id order by base_score desc, product_id) as rank from base where article_type = payload_article and list_contains(allowed, gender)) where rank <= 10", REQUESTS)
def personalised(spark, d):
    return scoring.personalised(_candidates(spark, d))


X10_SQL = f"""select request_id, product_id, round(score, 6) as score, base_score, usage_match, gender_match, rank from (select *, row_number() over (partition by request_id order by round(score, 9) desc, product_id) as rank from (
  select request_id, product_id, base_score + case when usage is not distinct from payload_usage then {V.USAGE_BONUS} else 0 end + case when gender = payload_gender then {V.GENDER_BONUS} else {V.UNISEX_BONUS} end + {V.ARTICLE_PREF} * article_pref + {V.USAGE_PREF} * usage_pref as score,
  base_score, usage is not distinct from payload_usage as usage_match, gender = payload_gender as gender_match from base where article_type = payload_article and (gender = payload_gender or gender = 'Unisex'))) where rank <= 10"""


def prioritised(spark, d, pairs=None):
    return _short(scoring.prioritised(_candidates(spark, d, pairs)))


query("X10", X10_SQL, REQUESTS)(prioritised)

X11_SQL = """select request_id, t as outfit_number, any_value(payload_id) || ',' || string_agg(product_id, ',' order by slot) as products, round(sum(base_score) + coalesce(any_value(payload_score), 0), 6) as score from (
  select *, row_number() over (partition by request_id, slot order by base_score desc, product_id) - 1 as place, count(*) over (partition by request_id, slot) as n from (
    select *, min(pool) over (partition by request_id, slot) as first from (
      select b.*, l.score as payload_score, case when payload_gender = 'Unisex' then case when (payload_usage is null or usage = payload_usage) and (list_contains(allowed, gender) or gender = 'Unisex') then 0 end
        when (payload_usage is null or usage = payload_usage) and (gender = payload_gender or gender = 'Unisex') then 0 when gender = payload_gender or gender = 'Unisex' then 1
        when list_contains(allowed, gender) or not exists (select 1 from products q where list_contains(b.allowed, q.gender) or q.gender = 'Unisex') then 2 else 4 end as pool
      from base b left join liked l on l.user_id = b.user_id and l.product_id = b.payload_id
      where slot is distinct from payload_slot and (slot in ('accessories', 'footwear') or slot in ('topwear', 'bottomwear') and payload_slot is distinct from 'dress'
        or slot = 'dress' and payload_gender in ('Women', 'Girls') and payload_slot not in ('dress', 'topwear', 'bottomwear'))) where pool is not null) where pool = first), generate_series(1, 3) g(t)
where place = (t - 1) % n group by request_id, t having count(*) filter (slot <> 'dress') = any_value(case when payload_slot = 'dress' then 2 when payload_slot in ('accessories', 'bottomwear', 'footwear', 'topwear') then 3 else 4 end)"""


def outfits(spark, d, pairs=None):
    scores = scoring.pair_weights(S.interactions(spark, d)).select("user_id", "product_id", (F.col("w") / 10).alias("score"))
    p = S.products(spark, d).withColumn("slot", C.lookup(V.CATEGORY_KEYS, F.col("sub_category")))
    found = O.suggest(requests(spark, d, pairs), p, scores)
    return found.select("request_id", "outfit_number", F.array_join("products", ",").alias("products"), "score")


query("X11", X11_SQL, REQUESTS)(outfits)


OUTFIT_ROWS = f"outfit_rows as (select cast(product_id as bigint) // 5 as outfit_id, usage, {KEY_SQL} as slot from products)"


@query("X13", "select outfit_id, count(distinct usage) = 1 and count(distinct slot) filter (slot in ('accessories','bottomwear','footwear','topwear')) = 4 as valid from outfit_rows group by 1", OUTFIT_ROWS)
def outfit_validity(spark, d):
    rows = S.products(spark, d).select(F.floor(F.col("product_id").cast("bigint") / 5).alias("outfit_id"), "usage", C.lookup(V.CATEGORY_KEYS, F.col("sub_category")).alias("slot"))
    return O.valid(rows)
