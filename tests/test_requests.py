"""Requests against the whole catalog: what pruned candidates and counted filters must equal."""

import random

from pyspark.sql import functions as F

from loomfold.operators import scoring


def test_pruned_candidates_hold_the_best(spark):
    rng = random.Random(3)
    genders, usages, articles = ["Men", "Women", "Unisex", None], ["Casual", "Sports", None], ["Shirts", "Jeans"]
    items = [(f"{i:03d}", rng.choice(articles), rng.choice(genders), rng.choice(usages)) for i in range(400)]
    products = spark.createDataFrame(items, "product_id string, article_type string, gender string, usage string")
    facts = spark.createDataFrame([(f"u{rng.randrange(6)}", f"{rng.randrange(400):03d}", rng.choice(["purchase", "like", "view"])) for _ in range(150)], "user_id string, product_id string, interaction_type string")
    asked = [(f"r{n}", f"u{n % 8}", 10 + n, rng.sample(["Men", "Women", "Unisex"], 2), *[items[rng.randrange(400)][i] for i in (0,)]) for n in range(30)]
    by_id = {i[0]: i for i in items}
    rows = [(r, u, a, allowed, p, by_id[p][2], by_id[p][1], by_id[p][3]) for r, u, a, allowed, p in asked]
    requests = spark.createDataFrame(rows, "request_id string, user_id string, age int, allowed array<string>, payload_id string, payload_gender string, payload_article string, payload_usage string")
    for k in (1, 3, 10):
        few, whole = scoring.of_requests(requests, products, facts, k), scoring.of_requests(requests, products, facts, 1000)
        for best in (scoring.personalised, scoring.prioritised):
            assert sorted(map(str, best(few, k).collect())) == sorted(map(str, best(whole, k).collect()))
    assert whole.count() == sum(i[1] == r[6] and i[0] != r[4] for r in rows for i in items)
    got = {r.request_id: (r.initial_count, r.after_articletype, r.after_age_gender, r.final_count) for r in scoring.funnel(requests, products).collect()}
    for r in rows:
        right = [i for i in items if i[1] == r[6] and i[0] != r[4]]
        both = [i for i in right if i[2] in r[3]]
        assert got[r[0]] == (399, len(right), len(both), min(len(both), 10))
