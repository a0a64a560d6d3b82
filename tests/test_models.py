"""Trained embeddings, outfit search, artifacts and requests against plain versions."""

import math
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomfold.functions import columns as C
from loomfold.functions import values as V
from loomfold.operators import graph, metrics, outfits, personal, quantiles, training
from loomfold.operators.response import NO_MATCH, NO_PREDICTIONS, NO_PRODUCT, respond
from loomfold.sources import artifacts

DIMS = ["x0", "x1"]


def _start(spark):
    rows = [(f"{k}:{n}", ((n * 3 + i) % 7 - 3) / 5, ((n * 5 + i) % 9 - 4) / 5) for i, k in enumerate("up") for n in range(6)]
    return spark.createDataFrame(rows, "node string, x0 double, x1 double")


def _plain_training(pairs, drawn, start, epochs, rate, penalty):
    """Adam over all parameters, with numerical gradients of the loss."""
    state, m, v, losses = dict(start), dict.fromkeys(start, 0.0), dict.fromkeys(start, 0.0), []

    def loss(at, negative):
        total = 0.0
        for user, item in pairs:
            u, i, j = ([at[f"{k}:{n}", d] for d in DIMS] for k, n in (("u", user), ("p", item), ("p", negative[user, item])))
            x = sum(a * (b - c) for a, b, c in zip(u, i, j))
            total += math.log1p(math.exp(-x)) + penalty * sum(z * z for z in (*u, *i, *j))
        return total / len(pairs)

    for step in range(1, epochs + 1):
        negative, before = drawn[step], dict(state)
        losses.append(loss(before, negative))
        for key in state:
            up, down = {**before, key: before[key] + 1e-6}, {**before, key: before[key] - 1e-6}
            g = (loss(up, negative) - loss(down, negative)) / 2e-6
            g = 0.0 if abs(g) < 1e-9 else g
            m[key], v[key] = 0.9 * m[key] + 0.1 * g, 0.999 * v[key] + 0.001 * g * g
            state[key] = before[key] - rate * (m[key] / (1 - 0.9**step)) / (math.sqrt(v[key] / (1 - 0.999**step)) + 1e-8)
    return state, losses


def test_training_follows_the_gradient(spark):
    pairs = [("0", "0"), ("0", "1"), ("1", "1"), ("1", "1"), ("2", "3"), ("4", "0")]
    facts = spark.createDataFrame([*pairs, ("9", "1"), ("1", "9")], "user_id string, product_id string")  # two without a vector
    start = _start(spark)
    items, total = training.dense_index(start.where("node like 'p:%'").select(F.substring("node", 3, 9).alias("product_id")), "product_id")
    distinct = facts.distinct()
    drawn = {s: {(r["user_id"], r["product_id"]): r["negative"] for r in training.negatives(distinct, items, total, s).collect()} for s in (1, 2)}
    plain, losses = _plain_training(pairs, drawn, {(r["node"], d): r[d] for r in start.collect() for d in DIMS}, 2, 0.05, 0.01)
    got, said = training.train(start, facts, DIMS, 2, 0.05, 0.01)
    assert said == pytest.approx(losses, rel=1e-6)
    assert {(r["node"], d): r[d] for r in got.collect() for d in DIMS} == pytest.approx(plain, abs=1e-4)


def test_training_lowers_the_loss_and_bears_no_pairs(spark):
    facts = spark.createDataFrame([(str(n), str(n % 3)) for n in range(6)] * 2, "user_id string, product_id string")
    _, losses = training.train(_start(spark), facts, DIMS, 8, 0.1)
    assert losses[-1] < losses[0]
    same, none = training.train(_start(spark), facts.limit(0), DIMS, 2)
    assert none == [] and sorted(same.collect()) == sorted(_start(spark).collect())


@pytest.mark.parametrize("n", [0, 1, 7, 1000])
def test_dense_index(spark, n):
    ids = spark.range(n).select(F.col("id").cast("string").alias("product_id"))
    rows, total = training.dense_index(ids.union(ids), "product_id")
    assert total == n and sorted(r["place"] for r in rows.collect()) == list(range(n))


def test_random_lists_are_whole(spark):
    users = spark.createDataFrame([("a",), ("b",)], "user_id string")
    products = spark.range(4).select(F.col("id").cast("string").alias("product_id"))
    for k, size in ((3, 3), (9, 4)):
        rows = training.random_lists(users, products, k).collect()
        assert len(rows) == 2 * size == len({(r["user_id"], r["product_id"]) for r in rows})
    assert training.random_lists(users, products.limit(0)).count() == 0


def test_complete_outfits(spark):
    usages, colours = ("Casual", "Sports", None), ("red", None, "blue")
    rows = [("u", f"{s}{n}", s, usages[(n + i) % 3], 0.1 * n + i, colours[n]) for i, s in enumerate(V.SLOTS) for n in range(3)] + [("v", "x", "topwear", "Casual", 1.0, "red"), ("u", "d", "dress", "Casual", 9.0, "red")]
    candidates = spark.createDataFrame(rows, "user_id string, product_id string, slot string, usage string, score double, base_colour string")
    plain = []
    for four in combinations([r for r in rows if r[0] == "u"], 4):
        known = {r[3] for r in four} - {None}
        if {r[2] for r in four} == set(V.SLOTS) and len(known) == 1:
            alike = 0.0
            for a, b in combinations(four, 2):
                sizes = [sum(x is not None for x in (r[3], r[5])) for r in (a, b)]
                if sizes[0] * sizes[1]:
                    alike += sum(x == y and x is not None for x, y in ((a[3], b[3]), (a[5], b[5]))) / math.sqrt(sizes[0] * sizes[1])
            plain.append((-round(sum(r[4] for r in four) + 0.5 * alike, 9), sorted(r[1] for r in four)))
    plain.sort()
    got = outfits.complete(candidates, 1000, features=("usage", "base_colour")).orderBy("rank").collect()
    assert [(r["score"], r["products"]) for r in got] == [(pytest.approx(-s, abs=1e-8), p) for s, p in plain]
    held = outfits.complete(candidates, 1000, payload="topwear1", features=("usage", "base_colour")).collect()
    assert {tuple(r["products"]) for r in held} == {tuple(p) for _, p in plain if "topwear1" in p}


def test_combinations(spark):
    df = spark.createDataFrame([([1, 2, 3, 4, 5],), ([1],), ([],)], "a array<int>")
    got = [[tuple(c) for c in r[0]] for r in df.select(C.combinations(F.col("a"), 3)).collect()]
    assert [sorted(g) for g in got] == [sorted(combinations(range(1, 6), 3)), [], []]


def test_article_types(spark):
    df = spark.createDataFrame([("Innerwear", "male"), ("Shoes", "male"), ("Shoes", "other"), ("Shoes", "female"), ("?", "male"), (None, None)], "sub string, person string")
    got = [r[0] for r in df.select(outfits.article_types(F.col("sub"), F.col("person"))).collect()]
    assert got[0] == ["Bra"] and "Flats" not in got[1] and "Flats" in got[2] and "Heels" not in got[2] and "Heels" in got[3] and got[4] == got[5] == []


def test_changes(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2), ("c", None)], "k string, x int")
    changes = spark.createDataFrame([("a", 5, "upsert", 1), ("a", 6, "upsert", 2), ("b", None, "delete", 1), ("d", 4, "upsert", 1), ("e", 1, "upsert", 1), ("e", 1, "delete", 1)], "k string, x int, op string, version int")
    assert sorted(artifacts.apply_changes(old, changes, "k").collect(), key=str) == sorted([("a", 6), ("c", None), ("d", 4)], key=str)


def test_restore_and_log(spark, tmp_path):
    at, calls = f"file://{tmp_path}/made", []

    def make():
        calls.append(1)
        return spark.range(3)

    assert [artifacts.restore(spark, at, make)[1] for _ in range(3)] == [False, True, True] and len(calls) == 1
    assert artifacts.delete(spark, at, at) == [True, False]
    rows = [("m 1", "ndcg", 10, -0.5), ("m 1", "ndcg", 20, 1.0), ("x", "recall", 5, 0.25)]
    artifacts.write_log(spark.createDataFrame(rows, artifacts.COMPARISON), f"file://{tmp_path}/log")
    assert sorted(map(tuple, artifacts.read_log(spark, f"file://{tmp_path}/log").collect())) == rows


def test_response_errors(spark):
    known = spark.createDataFrame([("u", "p", 1.0)], "user_id string, product_id string, score double")
    best = spark.createDataFrame([("p", 1, True, False), ("q", 9, True, True)], "product_id string, rank int, usage_match boolean, gender_match boolean")
    suits = spark.createDataFrame([(1, "a,b")], "outfit_number int, products string")
    say = lambda *a: respond(*a).first()
    assert say("u", "c", known, best, suits)["personalized"] == "p:true:false" and say("u", "c", known, best, suits)["outfits"] == "1:a,b"
    assert say("u", "c", known, best.limit(0), suits)["error"] == NO_MATCH and say("w", "c", known, best.limit(0), suits)["error"] == NO_PREDICTIONS
    assert say("u", "c", known, None, None)["error"] == NO_PRODUCT and say("u", "c", known, best, suits.limit(0))["outfits"] is None


def test_verdicts_need_three_models(spark):
    rows = spark.createDataFrame([("gnn", 0.1, 0.1, 0.1, 0.1, 0.0), ("hybrid", 0.2, 0.2, None, 0.1, 0.0)], "model string, ndcg_10 double, ndcg_20 double, diversity double, coverage double, inference_time double")
    assert metrics.verdicts(rows).count() == 0
    best = {r["metric"]: r["model"] for r in metrics.best_models(rows).collect()}
    assert best["ndcg_10"] == "hybrid" and best["diversity"] == "gnn" and best["inference_time"] == "gnn"


def test_completion_and_categories(spark):
    df = spark.createDataFrame([("Shoes ", "women"), ("shoes", "male"), ("hats", "f"), ("tops", None), (None, "male")], "tag string, g string")
    got = df.select(personal.completion(F.col("tag")).alias("a"), personal.completion(F.col("tag"), F.col("g")).alias("b")).collect()
    assert [r["a"] for r in got] == [V.COMPLETION["shoes"], V.COMPLETION["shoes"], None, V.COMPLETION["tops"], None]
    assert [r["b"] for r in got] == [["tops", "bottoms", "dresses"], ["tops", "bottoms"], ["tops", "bottoms", "shoes", "accessories", "dresses"], V.COMPLETION["tops"], ["tops", "bottoms", "shoes", "accessories"]]
    rows = spark.createDataFrame([("a", "Jeans", "x"), ("b", "Casual Shoes", "x"), ("c", "?", "Red hat"), ("d", None, None)], "id string, kind string, name string")
    catalog = spark.createDataFrame([("jeans", "J", 2), ("casual-shoes", "C", 1), ("red", "R", 3)], "key string, category string, position int")
    assert {r["id"]: r["category"] for r in personal.category_of(rows, catalog, "kind", "name").collect()} == {"a": "J", "b": "C", "c": "R", "d": "C"}
    assert {r["id"]: r["category"] for r in personal.category_of(rows, catalog.limit(0), "kind", "name").collect()} == {"a": "Jeans", "b": "Casual Shoes", "c": "?", "d": "Other"}


def test_selection_reasons(spark):
    rows = spark.createDataFrame([("u", "a", "footwear", 1.0, ["x", "y", "z", "w"]), ("u", "b", "footwear", 2.0, []), ("u", "c", "topwear", None, ["q"])], "user_id string, product_id string, slot string, score double, tokens array<string>")
    style = spark.createDataFrame([("u", t, w) for t, w in (("w", 1.0), ("z", 2.0), ("y", 0.5), ("x", 0.25), ("q", 0.0))], "user_id string, token string, weight double")
    got = {r["product_id"]: r["reason"] for r in personal.selection(rows, style, 3).collect()}
    assert got == {"a": "Similar to your favorite (x, y, z)", "b": personal.NO_REASON, "c": personal.NO_REASON}
    ranked = personal.ranked_in_category(rows, style, "footwear").orderBy("rank").collect()
    assert [(r["product_id"], r["score"]) for r in ranked] == [("a", 4.75), ("b", 2.0)]


def test_whole_vectors_and_tables(spark):
    """The queries without a filter on ids or dimensions reach every dimension, user and order."""
    from loomfold.plans import registry
    from loomfold.sources import tables as S
    from tests.conftest import SMALL

    run = registry.queries()
    assert {r["d"] for r in run["A24"](spark, SMALL).select("d").distinct().collect()} == set(range(64))
    assert run["A24"](spark, SMALL).select("user_id").distinct().count() == S.users(spark, SMALL).count()
    assert run["J12"](spark, SMALL).count() == S.table(spark, SMALL, "orders").count()
    assert run["S16"](spark, SMALL).count() == S.interactions(spark, SMALL).select("user_id").distinct().count()


def test_graph_ids_stay_whole(spark, monkeypatch):
    from loomfold.plans import models, recommend

    ids = ["u:64b7f0c2a1d3e4f5a6b7c8d1", "u:64b7f0c2a1d3e4f5a6b7c8d2", "p:64b7f0c2a1d3e4f5a6b7c8d3"]
    nodes = spark.createDataFrame([(i, *[1.0] * len(recommend.DIMS)) for i in ids], "node string, " + ", ".join(f"{x} double" for x in recommend.DIMS))
    monkeypatch.setattr(models, "_trained", lambda *_: (nodes, None))
    for ranking in (recommend._dense(nodes), models.trained_ranking(spark, "")):
        assert sorted((r["user_id"], r["product_id"]) for r in ranking.collect()) == [(u[2:], ids[2][2:]) for u in ids[:2]]


def test_layers_with_weights(spark):
    """Three layers with weight matrices against dense matrices."""
    rng = np.random.default_rng(4)
    dims = ["x0", "x1", "x2"]
    facts = [(f"u{rng.integers(6)}", f"i{rng.integers(5)}") for _ in range(40)]
    links = graph.counted(spark.createDataFrame(facts, "user_id string, product_id string"))
    nodes = sorted({f"u:{u}" for u, _ in facts} | {f"p:{p}" for _, p in facts})
    at, start = {n: i for i, n in enumerate(nodes)}, rng.normal(size=(len(nodes), 3))
    weights = [rng.normal(size=(3, 3)) for _ in range(3)]
    adjacent = np.zeros((len(nodes), len(nodes)))
    for u, p in facts:
        adjacent[at[f"u:{u}"], at[f"p:{p}"]] += 1
        adjacent[at[f"p:{p}"], at[f"u:{u}"]] += 1
    scale = 1 / np.sqrt(adjacent.sum(1))
    states = graph.layers(links, spark.createDataFrame([(n, *map(float, start[i])) for n, i in at.items()], "node string, x0 double, x1 double, x2 double"), dims, 3, weights)
    x, figures = start, {r["layer"]: r for r in graph.layer_figures(states, dims).collect()}
    for n, state in enumerate(states[1:], 1):
        before, y = x, (scale[:, None] * adjacent * scale[None, :]) @ (x @ weights[n - 1])
        x = np.where(y > 0, y, 0.2 * y)
        for r in state.collect():
            assert [r[d] for d in dims] == pytest.approx(x[at[r["node"]]].tolist())
        lengths = np.linalg.norm(x, axis=1)
        assert (figures[n]["mean_norm"], figures[n]["std_norm"], figures[n]["change"]) == pytest.approx((lengths.mean(), lengths.std(ddof=1), np.linalg.norm(x - before)))


@pytest.mark.parametrize("values", [[], [3.0], [1.0] * 50, [float(i * i % 977) for i in range(3000)], [0.0] * 2000 + [1e9], [i / 7 for i in range(40_000)]])
def test_exact_quantiles(spark, values, monkeypatch):
    monkeypatch.setattr(quantiles, "FEW", 100)
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    qs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    assert quantiles.exact(df, "v", qs) == (pytest.approx(np.quantile(values, qs).tolist()) if values else [None] * 6)


def test_hybrid_of_whole_tables(spark):
    """Against all pairs; a product and a user without a content vector."""
    rng = np.random.default_rng(8)
    g_users, g_items, c_users, c_items = (rng.normal(size=(n, k)) for n, k in ((7, 3), (9, 3), (6, 4), (8, 4)))
    c_users, c_items = abs(c_users), abs(c_items)

    def frame(rows, key, name):
        return spark.createDataFrame([(f"{name}{i}", list(map(float, v))) for i, v in enumerate(rows)], f"{key} string, vector array<double>")

    sides = [(frame(u, "user_id", "u"), frame(i, "product_id", "p")) for u, i in ((g_users, g_items), (c_users, c_items))]
    got = {(r["user_id"], r["product_id"]): (r["score"], r["rank"]) for r in graph.dense_hybrid(*sides, alpha=0.3, k=4).collect()}
    g, c = g_users @ g_items.T, np.zeros((7, 9))
    c[:6, :8] = c_users @ c_items.T
    real = c[:6, :8]
    both = 0.3 * (g - g.min()) / (g.max() - g.min()) + 0.7 * (c - real.min()) / (real.max() - real.min())
    want = {(f"u{u}", f"p{p}"): (round(both[u, p], 6), r + 1) for u in range(7) for r, p in enumerate(np.argsort(-both[u])[:4])}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=2e-6) for k in want)
