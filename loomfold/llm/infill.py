"""Fill-in-middle transformation of whole texts.

A text is cut at two drawn code points into prefix, middle and suffix, and these are put into the order
in which a model is to learn them. The cuts are found on the UTF-8 bytes of many texts at once, eight to
a 64-bit word: a unit (code point) ends at each byte that no continuation byte follows, which shifts and
masks mark for a whole word; the marks of a word are counted, the counts summed up and searched for the
word that holds the k-th unit, and prefix sums of its bytes (one multiplication) select it there.

Defined cases: a null text is empty and so plain; a null id is written as the empty string; repeated rows
are cut alike; columns besides id and text play no part."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomfold.llm.common import byte_slices, pick

# The marks, and the shares in percent of cut texts and of those with the suffix first.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
CUT, SUFFIX_FIRST = 90, 20

_HIGH = np.uint64(0x8080808080808080)
_ONES = np.uint64(0x0101010101010101)
_1, _7, _8, _56 = (np.uint64(n) for n in (1, 7, 8, 56))


class Units:
    """Code points of a UTF-8 buffer: how many end before a byte, and where the k-th ends."""

    def __init__(self, raw: np.ndarray):
        whole = np.zeros(len(raw) // 8 + 2, np.uint64)  # a word of padding at least: its bytes start units
        whole.view(np.uint8)[: len(raw)] = raw
        starts = ~(whole & ~(whole << _1)) & _HIGH  # all bytes but 10xxxxxx
        self.ends = starts[:-1] >> _8 | starts[1:] << _56
        self.total = np.concatenate(([0], np.cumsum(np.bitwise_count(self.ends), dtype=np.int64)))

    def before(self, byte: np.ndarray) -> np.ndarray:
        """Units that end before each byte offset."""
        word, rest = byte >> 3, (byte & 7).astype(np.uint64)
        below = (_1 << (rest * _8)) - _1
        return self.total[word] + np.bitwise_count(self.ends[word] & below)

    def after(self, k: np.ndarray) -> np.ndarray:
        """The byte offset behind the k-th unit of the buffer (k from 1)."""
        word = np.searchsorted(self.total, k, "left") - 1
        sums = (self.ends[word] >> _7) * _ONES  # byte i: marks in bytes 0 to i, at most 8
        short = ((sums | _HIGH) - (k - self.total[word]).astype(np.uint64) * _ONES) & _HIGH  # bytes whose sum reaches k
        return word * 8 + 9 - np.bitwise_count(short)


def _cut(text: pa.Array, one: pa.Array, two: pa.Array, keep: pa.Array, turn: pa.Array) -> pa.Array:
    draws = [np.asarray(a.fill_null(0), np.int64) for a in (one, two, keep, turn)]
    n_units, forms, heads, middles, outputs = [], [], [], [], []
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    for first, raw, at in byte_slices(text):
        rows = slice(first, first + len(at) - 1)
        units = Units(raw)
        base = units.before(at)
        n = np.diff(base)
        a, b = (d[rows] % (n + 1) for d in draws[:2])
        low, high = np.minimum(a, b), np.maximum(a, b)
        ends = [np.where(k > 0, units.after(np.maximum(base[:-1] + k, 1)), at[:-1]) for k in (low, high)]
        data, cut, flip = raw.tobytes(), (draws[2][rows] % 100 < CUT) & (n > 0), draws[3][rows] % 100 < SUFFIX_FIRST
        for i, (start, x, y, end) in enumerate(zip(at[:-1].tolist(), ends[0].tolist(), ends[1].tolist(), at[1:].tolist())):
            whole = data[start:end]
            if not cut[i] or p in whole or s in whole or m in whole:
                cut[i] = False
                forms.append("plain")
                outputs.append(whole)
            elif flip[i]:
                forms.append("spm")
                outputs.append(b"".join((s, data[y:end], p, data[start:x], m, data[x:y])))
            else:
                forms.append("psm")
                outputs.append(b"".join((p, data[start:x], s, data[y:end], m, data[x:y])))
        n_units.append(n)
        heads.append(pa.array(low, pa.int64(), mask=~cut))
        middles.append(pa.array(high - low, pa.int64(), mask=~cut))
    parts = [pa.concat_arrays([pa.array(c, pa.int64()) for c in x] or [pa.array([], pa.int64())]) for x in (n_units, heads, middles)]
    return pa.StructArray.from_arrays([parts[0], pa.array(forms, pa.string()), parts[1], parts[2], pa.array(outputs, pa.binary()).cast(pa.string())], ["n", "form", "prefix_chars", "middle_chars", "output"])


_CUT = T.StructType([T.StructField(n, T.StringType() if n in ("form", "output") else T.LongType()) for n in ("n", "form", "prefix_chars", "middle_chars", "output")])
_cut_udf = F.arrow_udf(_cut, _CUT)


def draws(key: Column, seed: int = 1) -> list[Column]:
    """Four numbers below 2**32, fixed by seed and key: groups of hex digits of a digest."""
    said = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(said, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def transformed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", seed: int = 1) -> DataFrame:
    """For each row its id, n (code points), form (plain, psm or spm), prefix_chars, middle_chars (null if
    plain) and output. A text that is empty, holds a mark, or is not drawn for cutting stays plain."""
    rows = pick(docs, doc_id, text).toDF("doc_id", "text")
    cut = rows.select("doc_id", _cut_udf(F.col("text"), *draws(F.col("doc_id"), seed)).alias("c"))
    return cut.select("doc_id", "c.*")


def restored(output: Column, form: Column) -> Column:
    """The text that `transformed` was given: the marks occur once each, as a text that holds one stays plain."""
    part = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    first, second, middle = (F.get(part, i) for i in (1, 2, 3))
    return F.when(form == "psm", F.concat(first, middle, second)).when(form == "spm", F.concat(second, middle, first)).otherwise(output)


ORACLE_SQL = """
with t as (select doc_id, coalesce(text, '') as text, sha256('1:' || coalesce(cast(doc_id as varchar), '')) as x from documents),
h as (select doc_id, text, length(text) as n, cast('0x' || x[1:8] as bigint) as h1, cast('0x' || x[9:16] as bigint) as h2, cast('0x' || x[17:24] as bigint) as h3, cast('0x' || x[25:32] as bigint) as h4 from t),
f as (select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
  case when n = 0 or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end as form from h)
select doc_id, cast(n as bigint) as n, form, case when form <> 'plain' then cast(a as bigint) end as prefix_chars, case when form <> 'plain' then cast(b - a as bigint) end as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || left(text, a) || '<S>' || substr(text, b + 1) || '<M>' || substr(text, a + 1, b - a)
    else '<S>' || substr(text, b + 1) || '<P>' || left(text, a) || '<M>' || substr(text, a + 1, b - a) end) as output_sha256,
  sha256(text) as restored_sha256 from f
"""
