"""Python literals against the standard parser; extended JSON against a plain walk."""

import ast
import datetime
import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomfold.functions import literals as L

_LEAF = st.one_of(st.none(), st.booleans(), st.integers(), st.floats(allow_nan=False, allow_infinity=False), st.text(max_size=12).filter(lambda s: not any(0xD800 <= ord(c) < 0xE000 for c in s)))
_VALUE = st.recursive(_LEAF, lambda inner: st.one_of(st.lists(inner, max_size=4), st.tuples(inner, inner), st.tuples(inner), st.dictionaries(st.text(max_size=5), inner, max_size=4)), max_leaves=12)


def plain(x):
    return [plain(y) for y in x] if isinstance(x, (list, tuple)) else {k: plain(v) for k, v in x.items()} if isinstance(x, dict) else x


@given(_VALUE)
@settings(max_examples=500, deadline=None)
def test_literals_as_the_standard_parser_reads_them(value):
    assert plain(L.literal(repr(value))) == plain(ast.literal_eval(repr(value))) == plain(value)


@given(st.text(alphabet="{}[]():,;'\"\\ abNone01.x-_\n", max_size=25))
@settings(max_examples=1000, deadline=None)
def test_bad_literals(text):
    try:
        want = plain(ast.literal_eval(text.strip()))
    except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
        want = None
    try:
        got = L.literal(text)
    except L.Bad:
        got = None
    assert got == want or got is None or not isinstance(want, (dict, str)) and "\n" in text or isinstance(want, (set, bytes, complex)) or want is None


def test_histories():
    at = datetime.datetime(2024, 3, 5, 7, 8, 9, 1000)
    rows = [{"product_id": "it's; fine", "at": at, "n": None}, {"a": [1, (2, 3)], 'q"': {"deep": True}}]
    cell = ";".join(map(repr, rows)) + " ; {broken: 1} ;{'x': 1} junk;; [1]; {'id': ObjectId('5f')} ;{'open': 'x"
    want = [{"product_id": "it's; fine", "at": "2024-3-5 7:8:9", "n": None}, {"a": [1, [2, 3]], 'q"': {"deep": True}}, {"id": "5f"}]
    assert L.history(cell) == want and L.history(None) == L.history("") == L.history(";;") == []
    assert L.history("{'a': " * 5000) == []


def test_histories_in_a_table(spark):
    from pyspark.sql import functions as F

    rows = [("{'a': 'x'};{'a': \"it's\"}",), (None,), ("{'a': 1e999}",), ("bad",)]
    got = [json.loads(r[0]) if r[0] else None for r in spark.createDataFrame(rows, "c string").select(L.histories(F.col("c"))).collect()]
    assert got == [[{"a": "x"}, {"a": "it's"}], [], None, []]


def walked(x):
    if isinstance(x, list):
        return [walked(y) for y in x]
    if not isinstance(x, dict):
        return x
    if list(x) == ["$oid"]:
        return x["$oid"]
    if list(x) in (["$numberInt"], ["$numberLong"]):
        return int(x[list(x)[0]])
    if list(x) == ["$numberDouble"]:
        return float(x["$numberDouble"])
    if list(x) == ["$date"]:
        inner = walked(x["$date"])
        return inner if isinstance(inner, str) else datetime.datetime.fromtimestamp(inner / 1000, tz=datetime.timezone.utc).isoformat()
    return {k: walked(v) for k, v in x.items()}


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_extended_json_at_every_level(spark, zone):
    from pyspark.sql import functions as F

    rng = random.Random(1)

    def made(depth):
        if not depth or rng.random() < 0.3:
            return rng.choice([{"$oid": 'a"b\\c{'}, {"$oid": "5f2b"}, {"$numberLong": str(rng.randint(-9, 10**15))}, {"$numberInt": "7"}, {"$numberDouble": "-2.5"}, {"$date": rng.randint(-10**12, 2 * 10**12)}, {"$date": {"$numberLong": str(rng.randint(0, 10**9) * 1000)}}, {"$date": "2024-01-01T00:00:00Z"}, 'say {"$oid":"x"} it', '\\{"$date":1}', None, True, 1.5, [], {}])
        return [made(depth - 1) for _ in range(3)] if rng.random() < 0.5 else {k: made(depth - 1) for k in rng.sample(["a", "b", "$c", "d\"q", "é"], 3)}

    docs = [made(4) for _ in range(300)]
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        frame = spark.createDataFrame([(n, json.dumps(x, indent=n % 2)) for n, x in enumerate(docs)] + [(-1, "{bad"), (-2, None)], "n long, j string")
        got = {r.n: r.u for r in frame.select("n", L.unwrapped(F.col("j")).alias("u")).collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert got.pop(-1) is None and got.pop(-2) is None
    assert all(json.loads(got[n]) == walked(x) for n, x in enumerate(docs))


def test_documents_are_rewritten_once(spark):
    from pyspark.sql import functions as F

    from loomfold.functions import literals

    df = spark.createDataFrame([('{"a": {"$date": 7}, "b": [{"$oid": "x"}, {"$date": 1000}]}',), ("{}",), ("no",), (None,)], "d string").select(literals.unwrapped(F.col("d")).alias("o"))
    assert df._jdf.queryExecution().analyzed().toString().count("parse_json") == 1
    assert [r.o for r in df.collect()] == ['{"a":"1970-01-01T00:00:00.007000+00:00","b":["x","1970-01-01T00:00:01+00:00"]}', "{}", None, None]


def test_common_forms_are_read_without_the_parser(monkeypatch):
    from loomfold.functions import literals

    common = "{'a': \"it's; 1\", 'b': 'x\\x41' 'y', 'c': datetime.datetime(1995, 3, 4, 0, 5, 9), 'd': [None, (True, -1.5e3), {'e': ObjectId('7')}],} ; {'f': 5..}"
    odd = ["{'a': (3), 'b': (4,), 'c': [,]}", "{'a': [,]}", "{1: 2, 'a': +1, 'b': .5}", "{'a': b'x'}", "{'a': 1, 'a': 2.50}", "{'a': 'x", "[1;2]", "{'a': 007};{}", "{'a': u'x' r'\\d'}", "{'a':,}", "{'a': NaN}", "1 ; {'a': 'b' \"c\"}"]
    wanted = [literals._slow(c) for c in odd]
    assert [literals.history(c) for c in odd] == wanted
    monkeypatch.setattr(literals, "_Parser", None)
    assert literals.history(common) == [{"a": "it's; 1", "b": "xAy", "c": "1995-3-4 0:5:9", "d": [None, [True, -1500.0], {"e": "7"}]}]
