"""Periodic runs against all periods tried one by one."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomfold.llm import periodic
from loomfold.llm.queries import op12_runs
from tests.conftest import SMALL
from tests.llm.helpers import awkward, clashing, docs, prose


def brute(words):
    """Start, end, period of each run, by period."""
    n, ends = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(12, 2 * q):
                ends.setdefault((i, j + q), q)
            i = j + 1
    return sorted((a, b, q) for (a, b), q in ends.items())


def row(doc_id, text, planted):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    n, g = len(words), h // 10
    if planted and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = sorted(brute(words), key=lambda r: (r[0], r[2]))
    best = max(found, key=lambda r: (r[1] - r[0], -r[0], -r[2]), default=None)
    gone = {i for a, b, q in found for i in range(a + q, b)}
    said = "".join(f"{a},{b - a},{q}\n" for a, b, q in found)
    text = " ".join(w for i, w in enumerate(words) if i not in gone)
    first = (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(found), *first, sha(said), sha(text), text)


def same(words):
    got = list(zip(*(x.tolist() for x in periodic.runs(np.array(words, np.int64))))) if words else []
    assert got == sorted(brute(words), key=lambda r: (r[0], r[2]))


@given(st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=9), st.integers(1, 6)), max_size=8))
@settings(max_examples=300, deadline=None)
def test_runs_of_repeated_parts(parts):
    same([x for unit, times in parts for x in unit * times])


@pytest.mark.parametrize("letters", [1, 2, 3, 7])
def test_runs_of_random_words(letters):
    rng = random.Random(letters)
    for _ in range(150):
        same([rng.randrange(letters) for _ in range(rng.randint(0, 130))])


def test_runs_that_touch():
    same([0, 1] * 30 + [0] + [0, 1] * 30)  # one square for each odd period
    a, b = [0], [0, 1]
    while len(b) < 300:
        a, b = b, b + a
    same(b)


def test_wavelet_tree():
    rng = np.random.default_rng(1)
    values = rng.permutation(200)
    tree = periodic.WaveletTree(values, 200)
    for _ in range(300):
        a, b = sorted(rng.integers(0, 201, 2))
        v = int(rng.integers(0, 210))
        want = min((x for x in values[a:b] if x >= v), default=-1)
        assert tree.successor(np.array([a]), np.array([b]), np.array([v]))[0] == want


def texts():
    rows = [(i, " ".join(f"w{(j * j) % (2 + i % 9)}" for j in range(i % 70)), None, None, None) for i in range(20, 220)]
    return awkward() + rows + [(900, ("é ü 漢字 " * 9 + prose(4)) * 3, None, None, None), (901, "a\x0b" * 3000, None, None, None)]


@pytest.mark.parametrize("planted", [True, False])
def test_rows(spark, planted):
    got = periodic.periodic(clashing(docs(spark, [r for r in texts() if len(r[1] or "") < 60_000])), planted=planted).collect()
    want = [row(r[0], r[1], planted) for r in texts() if len(r[1] or "") < 60_000]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_long_text_and_empty_table(spark):
    long = " ".join(f"w{i % 5000}" for i in range(1_000_000))
    got = periodic.periodic(docs(spark, [(1, long, None, None, None)])).first()
    assert (got.n_runs, got.start, got.length, got.period) == (1, 0, 1_000_000, 5000) and got.collapsed == " ".join(f"w{i}" for i in range(5000))
    assert periodic.periodic(docs(spark, [])).collect() == []


def test_query_on_its_table(spark):
    rows = [r for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect() if len(r.text or "") < 4000]
    got = {r.doc_id: tuple(r) for r in op12_runs(spark, SMALL).collect()}
    assert all(got[r.doc_id] == row(r.doc_id, r.text, True)[:-1] for r in rows) and any(got[r.doc_id][1] for r in rows)
