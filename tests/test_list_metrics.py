"""List diversity against all pairs, and how often metrics read the truth and the facts."""

import itertools
import math
import random
import re

import pytest

from loomfold.operators import metrics, scoring
from loomfold.plans import recommend

FEATURES = ("kind", "colour")


def _apart(items, cells):
    def cosine(a, b):
        a, b = cells.get(a, set()), cells.get(b, set())
        return len(a & b) / math.sqrt(len(a) * len(b)) if a and b else 0.0

    pairs = list(itertools.combinations(items, 2))
    return max(0.0, sum(1 - cosine(a, b) if cells.get(a) and cells.get(b) else 0 for a, b in pairs) / len(pairs))


def _tables(spark):
    rng = random.Random(2)
    products = [(str(n), rng.choice(["a", "b", None]), rng.choice(["red", "blue", None])) for n in range(30)]
    lists = {f"u{n}": rng.sample(range(35), rng.randint(1, 12)) for n in range(20)}
    cells = {p: {(f, v) for f, v in zip(FEATURES, values) if v} for p, *values in products}
    features = scoring.encode(spark.createDataFrame(products, "product_id string, kind string, colour string"), FEATURES)
    ranking = spark.createDataFrame([(u, str(p), r) for u, items in lists.items() for r, p in enumerate(items, 1)], "user_id string, product_id string, rank int")
    return cells, lists, features, ranking


def test_diversity_of_each_list_is_that_of_all_pairs(spark):
    cells, lists, features, ranking = _tables(spark)
    got = metrics.intra_list(ranking, features, 8)
    plan = got._jdf.queryExecution().executedPlan().toString()
    want = {u: _apart([str(p) for p in items[:8]], cells) for u, items in lists.items() if len(items) > 1}
    assert {r["user_id"]: r["ild"] for r in got.collect()} == pytest.approx(want)
    assert len(re.findall(r"Exchange hashpartitioning\(user_id#", plan)) == 1


def test_diversity_of_one_list(spark):
    cells, _, features, ranking = _tables(spark)
    items = ranking.select("product_id").distinct()
    assert metrics.one_list(items, features).first()["ild"] == pytest.approx(_apart([r[0] for r in items.collect()], cells))
    assert metrics.one_list(items.limit(1), features).count() == 0


@pytest.mark.parametrize("of", ["per_user", "suite"])
def test_truth_is_read_once(spark, tmp_path, of):
    _, _, features, ranking = _tables(spark)
    spark.createDataFrame([("u1", "3"), ("u1", "99"), ("new", "1")], "user_id string, product_id string").write.parquet(f"{tmp_path}/truth")
    truth = spark.read.parquet(f"{tmp_path}/truth")
    got = metrics.per_user(ranking, truth, 10) if of == "per_user" else metrics.suite(ranking, truth, features.select("product_id"), features=features)
    assert got._jdf.queryExecution().executedPlan().toString().count("truth]") == 1


def test_comparison_of_models_reads_the_facts_twice(spark, monkeypatch):
    from tests.conftest import SMALL

    calls, given = [], recommend.S.interactions
    monkeypatch.setattr(recommend.S, "interactions", lambda *a: calls.append(a) or given(*a))
    assert recommend.comparison_table(spark, SMALL).count() == 4
    assert len(calls) == 2
