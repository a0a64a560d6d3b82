"""Fill-in-middle: cuts on bytes against slices of code points, and exact restoring."""

import hashlib
import random

import numpy as np
import pytest

from loomfold.llm import infill
from tests.llm.helpers import awkward, clashing, docs


def brute(doc_id, text):
    x = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h, text = [int(x[8 * i : 8 * i + 8], 16) for i in range(4)], text or ""
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    out = f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}" if h[3] % 100 < 20 else f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"
    return doc_id, n, "spm" if h[3] % 100 < 20 else "psm", a, b - a, out


@pytest.mark.parametrize("seed", range(20))
def test_units_of_words(seed):
    rng = random.Random(seed)
    text = "".join(rng.choice("aé漢😀́ \x00߿￿") for _ in range(rng.randint(0, 90)))
    units, ends = infill.Units(np.frombuffer(text.encode(), np.uint8)), [len(text[:k].encode()) for k in range(len(text) + 1)]
    assert units.before(np.array(ends)).tolist() == list(range(len(text) + 1))
    assert not text or units.after(np.arange(1, len(text) + 1)).tolist() == ends[1:]


def texts():
    rng = random.Random(5)
    rows = [(i, "".join(rng.choice(["a", "é", "漢", "😀", "<", "P", "S>", " ", "M>"]) for _ in range(rng.randint(0, 60))), None, None, None) for i in range(100, 500)]
    return awkward() + rows + [(600, "<P> x", None, None, None), (601, "<P <S M>" * 50, None, None, None), (602, "漢" * 200_000, None, None, None)]


def test_rows_and_restoring(spark):
    from pyspark.sql import functions as F

    out = infill.transformed(clashing(docs(spark, texts())))
    got = [tuple(r) for r in out.withColumn("back", infill.restored(F.col("output"), F.col("form"))).collect()]
    want = [(*brute(r[0], r[1]), r[1] or "") for r in texts()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_empty_table(spark):
    assert infill.transformed(docs(spark, [])).collect() == []
