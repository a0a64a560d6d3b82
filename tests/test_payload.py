"""The whole payload of a user: personalised products, outfits by category, completeness."""

import pytest

from loomfold.operators import outfits
from loomfold.plans import registry
from tests.conftest import SMALL

SUBS = {"Belts": "Belts", "Bottomwear": "Jeans", "Topwear": "Shirts", "Shoes": "Casual Shoes"}


def test_outfits_by_content_scores(spark):
    rows = [(f"{s}{n}", "Men", s, SUBS[s], float(n), [n]) for s in SUBS for n in range(3)]
    products = spark.createDataFrame(rows, "product_id string, gender string, sub_category string, article_type string, rating double, cells array<int>")
    users = spark.createDataFrame([("a", 30, "male", "Belts", "Shoes"), ("b", 30, "male", "Belts", "Shoes"), ("c", 30, "male", "Bags", "Shoes")], "user_id string, age int, gender string, accessory string, footwear string")
    vectors = spark.createDataFrame([("a", [0.9, 0.0, 0.7])], "user_id string, vector array<double>")
    got = {r["user_id"]: r for r in outfits.scored(users, products, vectors).collect()}
    assert [[(x["product_id"], x["score"]) for x in o["items"]][1] for o in got["a"]["outfits"]] == [("Bottomwear0", 0.9), ("Bottomwear2", 0.7), ("Bottomwear1", 0.0)]
    assert [x["slot"] for x in got["a"]["outfits"][0]["items"]] == ["accessories", "bottomwear", "footwear", "topwear"]
    assert [o["items"][3]["product_id"] for o in got["b"]["outfits"]] == ["Topwear2", "Topwear1", "Topwear0"]  # by rating
    assert got["a"]["complete"] == pytest.approx(1.0) and got["c"]["complete"] == 0.0 and got["c"]["outfits"] is None  # no bag


def test_payload_is_whole(spark):
    rows = registry.queries()["P08"](spark, SMALL).collect()
    assert {"personalized", "n", "outfit", "outfit_complete_score"} < set(rows[0].asDict())
    full = [r for r in rows if r["outfit"]]
    assert full and all(r["outfit_complete_score"] > 0 and r["outfit"].startswith("outfit_1=accessories:") and r["outfit"].count(";") == 2 for r in full)
    assert all(len(part.split(":")) == 3 for r in rows for part in r["personalized"].split(","))
