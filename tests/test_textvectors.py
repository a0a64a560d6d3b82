"""Text vectors: synonyms by company, the directions of a plain decomposition, awkward texts."""

import numpy as np

from loomfold.operators import textvectors as T


def made(spark, texts, **more):
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(5)
    return {r.id: np.array(r.vector) for r in T.vectors(rows, "id", "text", **more).collect()}


def test_synonyms_are_near(spark):
    rng = np.random.default_rng(3)
    company = {"sneaker": "running sport shoe lace", "trainer": "running sport shoe lace", "saree": "silk festive drape woven", "watch": "steel dial strap quartz"}
    texts = []
    for i in range(600):
        word = list(company)[i % 4]
        texts.append(" ".join([word, *rng.permutation(company[word].split())[:3]]))
    got = made(spark, texts + list(company), dims=3)  # as many as there are kinds of company; further ones tell the words themselves apart
    near = [[float(got[600 + i] @ got[600 + j]) for j in range(4)] for i in range(4)]
    assert near[0][1] > 0.95 and all(abs(near[i][j]) < 0.2 for i in range(4) for j in range(i) if (i, j) != (1, 0))


def test_directions_are_the_leading_ones(spark):
    rng = np.random.default_rng(4)
    texts = [" ".join(rng.choice([f"w{j}" for j in range(30)], 6, p=np.arange(1, 31) / 465)) for _ in range(300)]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").repartition(7).select(T.features(T.F.col("text"), 64).alias("f"))
    idf = T.inverse_frequency(rows, 64)
    v = T.directions(rows, idf, 6, 40)
    dense = np.zeros((300, 64))
    for i, r in enumerate(rows.collect()):
        np.add.at(dense[i], r.f, idf[r.f])
    dense /= np.linalg.norm(dense, axis=1, keepdims=True)
    kept, best = np.linalg.norm(dense @ v), np.linalg.norm(np.linalg.svd(dense)[1][:6])
    assert abs(kept / best - 1) < 0.01 and np.allclose(v.T @ v, np.eye(6))


def test_awkward_texts(spark):
    got = made(spark, [None, "", "--- !", "Über élan", "über ÉLAN", "a " * 200_000, "b", "b"], dims=4)
    assert len(got) == 8 and not np.any([got[i] for i in (0, 1, 2)]) and np.allclose(got[3], got[4]) and np.allclose(got[6], got[7])
    assert all(abs(np.linalg.norm(got[i]) - 1) < 1e-9 for i in range(3, 8))
    assert made(spark, [])  == {} and not np.any(made(spark, [None])[0])
