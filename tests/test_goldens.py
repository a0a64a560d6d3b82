"""Hand-made cases of FIXTURES.md, and properties."""

import os

import pytest
from pyspark.sql import functions as F

from loomfold.sources import scratch
from loomfold.functions import columns as C
from loomfold.operators import catalog, graph, metrics, outfits, pruning, scoring
from loomfold.sources import tables
from loomfold.streaming import events
from tests.conftest import SMALL


def test_weighted_profile(spark):
    products = spark.createDataFrame([("a", "x", "y", "z"), ("b", None, "y", None), ("c", "x", None, "z")], "product_id string, f1 string, f2 string, f3 string")
    facts = spark.createDataFrame([("u", "a", "purchase"), ("u", "b", "like"), ("u", "c", "view")], "user_id string, product_id string, interaction_type string")
    got = {r["feature"]: r["weight"] for r in scoring.profiles(facts, products, ("f1", "f2", "f3")).collect()}
    assert got == pytest.approx({"f1": 6 / 9, "f2": 8 / 9, "f3": 6 / 9})


def test_metrics(spark):
    ranking = spark.createDataFrame([("u", p, i) for i, p in enumerate("abcd", 1)], "user_id string, product_id string, rank int")
    truth = spark.createDataFrame([("u", "b"), ("u", "d"), ("u", "x")], "user_id string, product_id string")
    r = metrics.per_user(ranking, truth, 4).first()
    assert (r["recall"], r["precision"], r["dcg"], r["ndcg"]) == pytest.approx((2 / 3, 0.5, 1.0616063, 1.0616063 / 2.1309298), rel=1e-6)


def test_hybrid_counts_missing_as_raw_zero(spark):
    content = spark.createDataFrame([("u", "a", 0.2), ("u", "b", 0.6)], "user_id string, product_id string, score double")
    gnn = spark.createDataFrame([("u", "b", -1.0), ("u", "c", 3.0)], content.schema)
    got = {r["product_id"]: r["score"] for r in scoring.hybrid(gnn, content, 0.5).collect()}
    assert got == pytest.approx({"a": 0.125, "b": 0.5, "c": 0.25})


def test_allowed_genders(spark):
    rows = spark.createDataFrame([(12, "male"), (13, "male"), (12, "female"), (40, "other"), (None, "male")], "age int, gender string")
    got = [r[0] for r in rows.select(C.allowed_genders(F.col("age"), F.col("gender"))).collect()]
    assert got == [["Boys"], ["Men", "Unisex"], ["Girls"], ["Men", "Women", "Unisex"], ["Boys", "Girls", "Men", "Unisex", "Women"]]


def test_k_core(spark):
    rows = spark.createDataFrame([("u1", "a"), ("u1", "b"), ("u2", "a"), ("u2", "b"), ("u3", "c")], "user_id string, product_id string")
    kept, rounds = pruning.k_core(rows, 2)
    assert rounds == 2 and kept.count() == 4
    assert pruning.prune_once(kept.selectExpr("*", "1 as n"), 2).count() == 4
    more = rows.union(rows).union(spark.createDataFrame([(None, "a"), (None, "a")], rows.schema))
    assert pruning.k_core(more, 2)[0].count() == 10 and pruning.k_core(more, 3)[0].count() == 8


def test_scratch_is_shared_and_cleared(spark):
    class Cluster:
        class conf:
            get = staticmethod(lambda key, default=None: default)

        class sparkContext:
            master = "spark://somewhere:7077"

    with pytest.raises(ValueError):
        scratch.root(Cluster)
    with scratch.scope(spark) as kept:
        a, b = [scratch.materialise(spark.range(n), "test") for n in (3, 4)]
        paths = [df.inputFiles()[0].rsplit("/", 1)[0] for df in (a, b)]
        kept.append(b)
    assert b.count() == 4 and not os.path.exists(paths[0].removeprefix("file://")) and os.path.exists(paths[1].removeprefix("file://"))


def test_dense_scores_in_blocks(spark):
    users = spark.createDataFrame([(f"u{i}", [float(i), 1.0]) for i in range(5)], "user_id string, vector array<double>")
    items = spark.createDataFrame([(f"p{i}", [1.0, float(-i % 3)]) for i in range(9)], "product_id string, vector array<double>")
    one = graph.dense_top_k(users, items, 3).orderBy("user_id", "rank").collect()
    assert one == graph.dense_top_k(users, items, 3, block=2).orderBy("user_id", "rank").collect()
    assert len(one) == 15 and one[0]["product_id"] == "p1"


ASKED = "request_id string, user_id string, allowed array<string>, payload_id string, payload_gender string, payload_usage string, payload_slot string"


def suggested(spark, asked, rows, scores=()):
    products = spark.createDataFrame(rows, "product_id string, slot string, gender string, usage string")
    liked = spark.createDataFrame(list(scores), "user_id string, product_id string, score double")
    out = outfits.suggest(spark.createDataFrame(asked, ASKED), products, liked).orderBy("request_id", "outfit_number").collect()
    return {(r["request_id"], r["outfit_number"]): (r["products"], r["score"]) for r in out}


def test_outfit_needs_every_slot(spark):
    asked = [("r", "u", ["Men"], "t", "Men", "Casual", "topwear")]
    rows = [("1", "bottomwear", "Men", "Casual"), ("2", "footwear", "Men", "Casual"), ("3", "footwear", "Men", "Casual"), ("t", "topwear", "Men", "Casual")]
    assert suggested(spark, asked, rows) == {}
    got = suggested(spark, asked, [*rows, ("4", "accessories", "Men", "Formal")], [("u", "3", 0.5), ("u", "t", 0.25), ("v", "2", 9.0)])
    assert got == {("r", 1): (["t", "4", "1", "3"], 0.75), ("r", 2): (["t", "4", "1", "2"], 0.25), ("r", 3): (["t", "4", "1", "3"], 0.75)}


def test_outfit_pools_and_dresses(spark):
    slots = ("accessories", "bottomwear", "dress", "footwear", "topwear")
    rows = [(f"{g[0]}{u[0]}{s[0]}", s, g, u) for g in ("Women", "Men", "Unisex", "Boys") for u in ("Casual", "Formal") for s in slots]
    asked = [(n, "u", ["Women", "Unisex"], f"{g[0]}C{s[0]}", g, u, s) for n, g, u, s in (("dress", "Women", "Casual", "dress"), ("shoe", "Women", "Formal", "footwear"), ("top", "Women", None, "topwear"), ("man", "Men", "Casual", "footwear"), ("both", "Unisex", "Casual", "footwear"), ("none", "Unisex", "Sports", "footwear"), ("relaxed", "Boys", "Sports", "footwear"))]
    got = {n: p for (n, t), (p, _) in suggested(spark, asked, rows).items() if t == 1}
    assert got["dress"] == ["WCd", "UCa", "UCf"]  # neither top nor bottom
    assert got["shoe"] == ["WCf", "UFa", "UFb", "UFd", "UFt"]  # a dress besides
    assert got["top"] == ["WCt", "UCa", "UCb", "UCf"] and got["man"] == ["MCf", "MCa", "MCb", "MCt"]
    assert got["both"] == ["UCf", "UCa", "UCb", "UCt"] and "none" not in got  # Unisex: its usage only
    assert got["relaxed"] == ["BCf", "BCa", "BCb", "BCt"]  # usage given up, gender kept


def test_sync_rules(spark):
    cells = [(1, " 1 ", " Men ", "2010", "A"), (2, "", "x", "1", "B"), (3, "x7", "x", "1", "C"), (4, "2", "  ", "soon", ""), (5, "2", None, "2011", " D "), (6, "+3", "Girls", "12.5", None)]
    frame = spark.createDataFrame([(n, i, g, *[None] * 5, y, None, d) for n, i, g, y, d in cells], "line long, id string, " + ", ".join(f"{c} string" for c in ("gender", "masterCategory", "subCategory", "articleType", "baseColour", "season", "year", "usage", "productDisplayName")))
    old = spark.createDataFrame([(1, "old", "s", "Women", 2000), (9, "nine", "t", None, None)], "id long, name string, slug string, gender string, year int")
    old = old.select("id", "name", "slug", *[c if c in ("gender", "year") else F.lit(None).cast("string").alias(c) for c in tables.SYNCED])
    merged, counts = tables.sync_products(old, frame)
    assert tuple(counts.first()) == (6, 2, 2, 2, 0)
    got = {r["id"]: (r["name"], r["slug"], r["gender"], r["year"], r["productDisplayName"]) for r in merged.collect()}
    assert got == {1: ("old", "s", "Men", 2010, "A"), 9: ("nine", "t", None, None, None), 2: ("D", "product-2", None, 2011, "D"), 3: ("Product 3", "product-3", "Girls", None, None)}


def test_page_is_clamped(spark):
    rows = spark.range(45).select(F.col("id").cast("string").alias("product_id"), F.col("id").alias("price"))
    assert catalog.page(rows, catalog.ordering("price"), 99, 20).count() == 5
    assert catalog.page(rows.where("false"), catalog.ordering("price")).count() == 0


def test_csv_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("1", "Men", None), ("2", None, "Casual")], "id string, gender string, usage string")
    tables.write_csv(rows, str(tmp_path / "p"))
    back = tables.read_csv(spark, str(tmp_path / "p"), "id string, gender string, usage string")
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, rows.collect()), key=str)
    assert tables.read_first(spark, str(tmp_path / "none"), str(tmp_path / "none2")) is None


def test_stream_counts_equal_batch(spark, tmp_path):
    rows = spark.read.parquet(f"{SMALL}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    rows.write.parquet(str(tmp_path / "in"))
    flow = events.windowed_counts(events.read(spark, str(tmp_path / "in")), "1 day")
    run = flow.writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    run.awaitTermination(60)
    batch = rows.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select("w.start", "event_type", "n")
    assert sorted(map(tuple, spark.table("counts").collect())) == sorted(map(tuple, batch.collect()))


def test_cases_without_rows_or_values(spark):
    none = spark.createDataFrame([], "user_id string, product_id string, interaction_type string")
    assert scoring.pair_weights(none).count() == 0
    one = spark.createDataFrame([("u", "p", "strange"), ("u", "p", None)], none.schema)
    assert scoring.pair_weights(one).first()["w"] == 2.0
    assert pruning.k_core(none.select("user_id", "product_id"), 2)[1] == 1
