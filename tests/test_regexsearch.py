"""Search through the trigram index against a scan of all rows."""

import random
import re

import pytest
from pyspark.sql import functions as F

from loomfold.operators import regexsearch as X

COLUMNS = ("name", "more")


@pytest.mark.parametrize("pattern, clauses", [
    ("almond", [{"almond"}]), ("Al(mo)nd", [{"almond"}]), ("(red|blue) steel", [{"red", "blue"}, {" steel"}]), ("re|blue", []), ("ab+cde", [{"cde"}]), ("(abc)+x", [{"abc"}]), ("(abc)*xyz", [{"xyz"}]), ("^ste.*eel$", [{"ste"}, {"eel"}]),
    ("[abc]def", [{"def"}]), ("a.c", []), ("(?=abc)x", []), ("(", []), ("abc(?i:d)ef", [{"abc"}]), ("colou?rs", [{"colo"}]), ("Ééab", [{"Ééab"}]), ("\\x61bcd", [{"abcd"}]), ("abc|(def|ghi)jkl", None), ("", []), ("(?:abc|)z", []), ("\\bsteel\\b", [{"steel"}]),
])
def test_required_literals(pattern, clauses):
    got = X.required(pattern)
    assert clauses is None or got == [frozenset(c) for c in clauses]


def test_required_literals_hold():
    rng = random.Random(1)
    for _ in range(3000):
        pattern = _pattern(rng, 3)
        for _ in range(20):
            text = "".join(rng.choice("abcABC ") for _ in range(rng.randint(0, 14)))
            if re.search(pattern, text, re.I):
                assert all(any(said in text.lower() for said in c) for c in X.required(pattern)), (pattern, text)


def _pattern(rng, depth):
    if not depth or rng.random() < 0.3:
        return rng.choice(["a", "b", "c", "ab", "abc", "bca", "[ab]", ".", "cab", "\\w"])
    kind = rng.randrange(6)
    one, two = _pattern(rng, depth - 1), _pattern(rng, depth - 1)
    return [one + two, f"({one}|{two})", f"({one})+", f"(?:{one})*{two}", f"{one}(?:{two})?", f"({one}){{2}}"][kind]


def test_search_is_a_scan(spark):
    rng = random.Random(2)
    rows = [(str(i), None if i % 17 == 0 else "".join(rng.choice("abcABC ") for _ in range(rng.randint(0, 16))), rng.choice(["", "xyz", "Abcab", None])) for i in range(400)]
    frame = spark.createDataFrame(rows + [("é", "Ä é ſtraße Kelvin", "ABC")], "id string, name string, more string")
    index = X.trigram_index(frame, "id", COLUMNS)
    patterns = [_pattern(rng, 3) for _ in range(20)] + ["(?i)ABC", "^abc", "ca$", "17", "stra", "k", "\\d+", "(abc|cab).*b{1,2}", "abcab"]
    for p in patterns:
        scan = {r.id for r in frame.where(" or ".join(f"coalesce(rlike({c}, '(?i){p}'), false)" for c in COLUMNS).replace("\\", "\\\\")).collect()} | ({p} & {r[0] for r in rows} if p.isdigit() else set())
        got = [r.id for r in X.search(frame, index, p, "id", COLUMNS).collect()]
        assert len(got) == len(set(got)) and set(got) == scan, p


def test_only_candidates_run_the_expression(spark):
    frame = spark.range(1000).select(F.col("id").cast("string").alias("id"), F.concat(F.lit("item "), F.col("id").cast("string")).alias("name"), F.lit("").alias("more"))
    index = X.trigram_index(frame, "id", COLUMNS)
    assert X.candidates(index, "id", X.required("item 99.")).count() == 11
    plan = X.search(frame, index, "m 99.", "id", COLUMNS)._jdf.queryExecution().toString()
    assert "PushedFilters: [In(gram" in plan
