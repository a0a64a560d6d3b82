"""Content rankings by blocks of feature tuples and chunks of users against a plain version."""

import math
import random
import re

import pytest

from __spark_entry__ import queries
from loomfold.operators import scoring
from tests.conftest import SMALL

FEATURES = ("kind", "colour")


def _plain(profile, products, k):
    out = set()
    for user in {u for u, *_ in profile if u is not None}:
        own = {(f, v): w for u, f, v, w in profile if u == user}
        norm, scored = math.sqrt(sum(w * w for w in own.values())), []
        for product, *values in products:
            known = [(f, v) for f, v in zip(FEATURES, values) if v is not None]
            dot = sum(own.get(cell, 0.0) for cell in known)
            if dot:
                scored.append((-round(dot / math.sqrt(len(known)) / norm, 9), product))
        out |= {(user, product, -score, rank) for rank, (score, product) in enumerate(sorted(scored)[:k], 1)}
    return out


@pytest.mark.parametrize("shelf,crowd", [(16_384, 20_000), (3, 4)])
def test_content_scores_are_those_of_all_products(spark, shelf, crowd):
    rng = random.Random(3)
    products = [(str(n), rng.choice(["a", "b", "c", None]), rng.choice(["red", "blue", "grey", None])) for n in range(40)]
    cells = [("kind", v) for v in ("a", "b", "c", "gone")] + [("colour", v) for v in ("red", "blue")]
    profile = [(f"u{n}", f, v, rng.choice([0.25, 0.5, 1.0])) for n in range(15) for f, v in rng.sample(cells, rng.randint(1, 4))] + [(None, "kind", "a", 1.0), ("lost", "kind", "gone", 1.0)]
    rows = spark.createDataFrame(profile, "user_id string, feature string, value string, weight double")
    catalog = spark.createDataFrame(products, "product_id string, kind string, colour string")
    got = scoring.content_scores(rows, catalog, 7, FEATURES, shelf=shelf, crowd=crowd)
    assert {tuple(r) for r in got.select("user_id", "product_id", "score", "rank").collect()} == _plain(profile, products, 7)


def test_content_scores_of_nothing(spark):
    rows = spark.createDataFrame([], "user_id string, feature string, value string, weight double")
    catalog = spark.createDataFrame([("1", "a", "red")], "product_id string, kind string, colour string")
    assert scoring.content_scores(rows, catalog, 7, FEATURES).count() == 0
    some = spark.createDataFrame([("u", "kind", "a", 1.0)], rows.schema)
    assert scoring.content_scores(some, catalog.limit(0), 7, FEATURES).count() == 0


def test_ranking_from_facts_is_that_of_profiles(spark):
    rng = random.Random(5)
    products = spark.createDataFrame([(str(n), rng.choice(["a", "b", "c", None]), rng.choice(["red", "blue", None])) for n in range(40)] + [("bare", None, None)], "product_id string, kind string, colour string")
    facts = [(f"u{rng.randrange(15)}", str(rng.randrange(50)), rng.choice(["view", "like", "purchase"])) for _ in range(150)] + [(None, "1", "view"), ("lost", "none", "view"), ("plain", "bare", "like")]
    facts = spark.createDataFrame(facts, "user_id string, product_id string, interaction_type string")
    want = scoring.content_scores(scoring.profiles(facts, products, FEATURES), products, 7, FEATURES)
    got = scoring.content_ranking(facts, products, 7, FEATURES)
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()} != set()


def test_pairs_meet_their_user_in_one_exchange(spark, monkeypatch):
    """And no strings but ids are sent with them."""
    plans, kept = {}, scoring.materialise
    monkeypatch.setattr(scoring, "materialise", lambda df, label: plans.update({label: df._jdf.queryExecution().executedPlan().toString()}) or kept(df, label))
    queries()["X02"](spark, SMALL)
    assert len(re.findall(r"Exchange hashpartitioning\(user_id#\d+, \d+\)", plans["profiles"])) == 1
    assert "base_colour" not in plans["profiles"].split("Exchange hashpartitioning(user_id#")[0]
