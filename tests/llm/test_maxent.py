"""Language-model scores: counts and base score against a plain count, probabilities that sum to one, held-out gain."""

import math
import re
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from loomfold.llm import maxent
from loomfold.llm.queries import op13_scores
from tests.llm.helpers import awkward, clashing, docs, prose


def tokens(text):
    lower = re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lower), None]


def held(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7 == 2


def brute(rows):
    c = Counter(t for i, text in rows if not held(i) for t in tokens(text))
    n, v = sum(c.values()), len(c)
    return [(i, held(i), len(tokens(text)), sum(t in c for t in tokens(text)), n, sum(math.log10((c[t] + 1) / (n + v + 1)) for t in tokens(text))) for i, text in rows]


def same(got, want):
    got, want = sorted((tuple(r)[:6] for r in got), key=str), sorted(want, key=str)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert [r[5] for r in got] == pytest.approx([r[5] for r in want], rel=1e-9)


def test_awkward_rows(spark):
    rows = awkward() + [(i, prose(i) + " CASE Case é É", None, None, None) for i in range(50, 90)]
    got = maxent.scored(clashing(docs(spark, rows)), bits=10).collect()
    same(got, brute([r[:2] for r in rows]))
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)


def test_more_tokens_than_are_sent(spark, monkeypatch):
    """Counts of all other tokens come by the join, and the scores stay the same."""
    rows = [(i, prose(i) + f" only{i} x{i % 3} " + "z" * (60 + i), None, None, None) for i in range(120)]
    monkeypatch.setattr(maxent, "HOT", 20)
    got = maxent.scored(docs(spark, rows), bits=10).collect()
    same(got, brute([r[:2] for r in rows]))


def test_empty_and_untrained(spark):
    assert maxent.scored(docs(spark, []), bits=8).collect() == []
    only = next(i for i in range(99) if held(i))
    row = maxent.scored(docs(spark, [(only, "one two", None, None, None)]), bits=8).first()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score) == (3, 0, 0, 0.0)
    assert row.score == pytest.approx(-3 * math.log10(maxent.CELLS), rel=1e-6)


def test_outcomes_are_probabilities_and_biases_are_shares():
    mass = np.random.default_rng(1).integers(0, 1000, maxent.CELLS).astype(float)
    model = maxent.Model(10, mass)
    cell, start = np.arange(maxent.CELLS), np.full(maxent.CELLS, maxent.CELLS)
    for _, rows, digit in model.levels(cell, start, start):
        assert np.allclose(model.outcomes(rows, digit)[0].sum(1), 1, atol=1e-5)
    assert np.allclose(np.exp(model.logs(cell, start, start)), (mass + 1) / (mass + 1).sum(), rtol=1e-3)
    model.weights[: 1 << 10] = np.random.default_rng(2).normal(size=(1 << 10, maxent.WIDTH))
    assert np.exp(model.logs(cell, start, start)).sum() == pytest.approx(1, rel=1e-4)


def test_gradient_and_gain(spark):
    """Observed minus expected counts are the slope of the log-likelihood; updates gain on texts that were held out."""
    rng = np.random.default_rng(4)
    follows = rng.permutation(40)

    def text(seed):
        r, w, out = np.random.default_rng(seed), 0, []
        for _ in range(80):
            w = int(follows[w]) if r.random() < 0.8 else int(r.integers(40))
            out.append(f"w{w}")
        return " ".join(out)

    rows = [(i, text(i), None, None, None) for i in range(400)]
    got = [r for r in maxent.scored(docs(spark, rows), bits=12).collect() if r.held_out]
    n = sum(r.n_tokens for r in got)
    assert sum(r.score for r in got) / n > sum(r.base_score for r in got) / n + 0.3

    model = maxent.Model(8)
    model.weights[:] = rng.normal(size=model.weights.shape) / 4
    offsets, values = pa.array([0, 298, 300], pa.int32()), pa.array(rng.integers(0, maxent.CELLS, 300).astype(np.int16))
    batch = pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(offsets, values)], ["cells"])
    grad = np.zeros(model.weights.shape)
    for out in maxent._gradient(SimpleNamespace(value=model))(iter([batch])):
        seen, expected = (np.asarray(out.column(i).flatten()).reshape(-1, maxent.WIDTH) for i in (1, 2))
        grad[np.asarray(out.column(0))] = seen - expected
    value = lambda: sum(model.logs(*part).sum() for part in maxent._positions(batch, 0)[1])
    for at in zip(*np.unravel_index(np.argsort(-np.abs(grad), axis=None)[:5], grad.shape)):
        model.weights[at] += 1e-2
        high = value()
        model.weights[at] -= 2e-2
        slope = (high - value()) / 2e-2
        model.weights[at] += 1e-2
        assert slope == pytest.approx(grad[at], rel=0.05)


def test_query_gains_on_held_out_documents(spark):
    rows = [r for r in op13_scores(spark, "/root/testdata/sf0.01").collect() if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)
