"""The best combinations of whole lists against all combinations."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomfold.functions import values as V
from loomfold.operators import outfits, rankjoin


def enumerated(rows, k, features, weight=0.5):
    """All combinations of (slot, id, score, usage, features...) rows."""
    def alike(x, y):
        same = sum(a is not None and a == b for a, b in zip(x[4:], y[4:]))
        size = np.sqrt(sum(a is not None for a in x[4:]) * sum(b is not None for b in y[4:]))
        return same / size if size else 0.0

    out = []
    for c in itertools.product(*[[r for r in rows if r[0] == s] for s in V.SLOTS]):
        if len({r[3] for r in c} - {None}) == 1:
            score = sum(r[2] for r in c) + weight * sum(alike(x, y) for x, y in itertools.combinations(c, 2))
            out.append((round(score, 6), [r[1] for r in c]))
    return sorted(out, key=lambda r: (-r[0], r[1]))[:k]


def lists(seed, size):
    rng = random.Random(seed)
    return [(s, f"{s[0]}{i:03d}", rng.choice([1.0, 2.0, 3.0, 5.0, 8.0]), rng.choice(["A", "B", None]), rng.choice(["A", "B", None]), rng.choice(["x", "y", None]), rng.choice(["p", None])) for s in V.SLOTS for i in range(rng.randint(0 if seed % 5 == 0 else 1, size))]


def test_outfits_equal_all_combinations(spark):
    users = {f"u{seed}": lists(seed, 7) for seed in range(40)}
    frame = spark.createDataFrame([(u, *r) for u, rows in users.items() for r in rows], "user_id string, slot string, product_id string, score double, usage string, f1 string, f2 string, f3 string")
    for k in (1, 3, 10):
        got = {}
        for r in outfits.complete(frame, k, features=("f1", "f2", "f3")).orderBy("user_id", "rank").collect():
            got.setdefault(r.user_id, []).append((round(r.score, 6), r.products))
        for u, rows in users.items():
            want = enumerated(rows, k, 3)
            assert [s for s, _ in got.get(u, [])] == pytest.approx([s for s, _ in want])
            assert sorted(p for _, p in got.get(u, [])) == sorted(p for _, p in want) or len(want) == k


def test_long_lists_meet_few_matrices(spark):
    """800 products a slot (4 * 10**11 combinations): found by bounds."""
    rng = random.Random(1)
    rows = [("u", s, f"{s}{i}", rng.random() * 100, "A", str(i % 40)) for s in V.SLOTS for i in range(800)]
    frame = spark.createDataFrame(rows, "user_id string, slot string, product_id string, score double, usage string, f1 string")
    got = outfits.complete(frame, 10, features=("f1",)).orderBy("rank").collect()
    best = [max((r for r in rows if r[1] == s), key=lambda r: r[3])[3] for s in V.SLOTS]
    assert len(got) == 10 and sum(best) <= got[0].score <= sum(best) + 3
    pool = [r[1:] for s in V.SLOTS for r in sorted((r for r in rows if r[1] == s), key=lambda r: -r[3])[:10]]
    assert got[0].score >= enumerated([(r[0], r[1], r[2], r[3], r[4]) for r in pool], 1, 1)[0][0] - 1e-6


@pytest.mark.parametrize("n,k", [(2, 1), (3, 4), (4, 7)])
def test_best_sets_equal_all_sets(spark, n, k):
    rng = random.Random(n)
    users = {f"u{u}": [(f"p{i:02d}", float(rng.choice([1, 2, 2, 3, 9]))) for i in range(rng.randint(0, 11))] for u in range(25)}
    frame = spark.createDataFrame([(u, *r) for u, rows in users.items() for r in rows], "user_id string, product_id string, score double")
    got = {}
    for r in rankjoin.best_sets(frame, n, k).orderBy("user_id", "rank").collect():
        got.setdefault(r.user_id, []).append((r.combinations, r.products, r.total))
    for u, rows in users.items():
        placed = sorted(rows, key=lambda r: (-r[1], r[0]))
        every = [(sum(r[1] for r in c), at, [r[0] for r in c]) for at, c in ((at, [placed[i] for i in at]) for at in itertools.combinations(range(len(placed)), n))]
        want = [(len(every), p, t) for t, _, p in sorted(every, key=lambda x: (-x[0], x[1]))[:k]]
        assert got.get(u, []) == want


def test_query_sets_are_of_whole_lists(spark):
    """What the oracle's pruned lists rest on: SQL over whole lists gives the same, for users with short lists."""
    import duckdb

    from loomfold.plans import models
    from loomfold.sources.tables import ROLES_SQL
    from tests.conftest import SMALL

    db = duckdb.connect()
    for t in ("part", "customer", "orders", "lineitem", "events"):
        db.execute(f"create view {t} as select * from read_parquet('{SMALL}/{t}.parquet')")
    sql = f"""with {ROLES_SQL}, {models.TOP.format(k=1000000)}, few as (select user_id from top group by 1 having count(*) between 4 and 25)
    select user_id, list([a.product_id, b.product_id, c.product_id, e.product_id] order by a.score + b.score + c.score + e.score desc, a.rank, b.rank, c.rank, e.rank)[:5], count(*)
    from few join top a using (user_id) join top b using (user_id) join top c using (user_id) join top e using (user_id) where a.rank < b.rank and b.rank < c.rank and c.rank < e.rank group by 1"""
    want = {u: (["+".join(p) for p in best], n) for u, best, n in db.execute(sql).fetchall()}
    got = {}
    for r in models.combinations(spark, SMALL).where(F.col("user_id").isin(list(want))).orderBy("user_id", "rank").collect():
        got.setdefault(r.user_id, ([], r.combinations))[0].append(r.products)
    assert want and got == want
