"""Periodic runs of words, by internal pattern matching.

A run is a stretch of words with smallest period q and at least two periods long that cannot be extended.
Take a block of b words at a multiple of b: a run whose first period holds the block repeats it q words on.
So for each b = 1, 2, 4, ... (dyadic blocks) every block asks for its occurrences in the window behind it,
and every distance found is a candidate period, which is then extended to both sides and verified.

An occurrence query is a range successor: occurrences of a block are an interval of the suffix array, and
a wavelet tree over the suffix array gives the smallest position there that is not below a bound. Where two
occurrences lie at most half a block apart, they belong to a progression whose difference is the block's own
period; the whole progression is taken at once, and one that the block itself begins gives its difference only.

All words of many texts are one sequence here (words of different texts are different letters, so nothing
matches across texts), and all queries of a level are answered together in numpy.

Memory of a task: about 4 (log2 n + 40) bytes for each of the n words of a text, or of SLICE words of
several texts. Defined cases: a null text has no words; a null id counts as the empty string; repeated
rows give repeated results; other columns play no part."""

from __future__ import annotations

import hashlib
import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loomfold.llm.common import pick

LEAST = 12  # words of a run
SLICE = 1 << 17  # words searched together


class Suffixes:
    """Suffix array by prefix doubling. same[k][i] is the least place of a suffix that shares its first 2**k
    letters with suffix i; only suffixes that are not yet alone are sorted again."""

    def __init__(self, letters: np.ndarray):
        n = len(letters)
        self.order = np.argsort(letters, kind="stable")
        rank = _firsts(letters[self.order], np.arange(n), self.order)
        self.same, k = [rank], 1
        active = _shared(rank[self.order])
        while len(active):
            who = self.order[active]
            after = np.where(who + k < n, rank[np.minimum(who + k, n - 1)] + 1, 0)
            key = rank[who].astype(np.int64) * (n + 1) + after
            by = np.argsort(key, kind="stable")
            self.order[active] = who[by]
            rank = rank.copy()
            rank[who[by]] = _firsts(key[by], active, None)
            self.same.append(rank)
            active = active[_shared(rank[self.order[active]])]
            k *= 2

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many letters from i and from j (greater) on are equal."""
        n, i, j = len(self.order), i.copy(), j.copy()
        first = i.copy()
        for k in range(len(self.same) - 1, -1, -1):
            ok = j < n
            ok[ok] = self.same[k][i[ok]] == self.same[k][j[ok]]
            i[ok] += 1 << k
            j[ok] += 1 << k
        return i - first

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many letters before i and before j (greater) are equal."""
        i, j = i.copy(), j.copy()
        first = i.copy()
        for k in range(len(self.same) - 1, -1, -1):
            ok = i >= 1 << k
            ok[ok] = self.same[k][i[ok] - (1 << k)] == self.same[k][j[ok] - (1 << k)]
            i[ok] -= 1 << k
            j[ok] -= 1 << k
        return first - i


def _firsts(keys: np.ndarray, places: np.ndarray, who: np.ndarray | None) -> np.ndarray:
    """For sorted keys the place of the first equal one; scattered to `who` if given."""
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    found = places[np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0))].astype(np.int32)
    if who is None:
        return found
    out = np.empty(len(keys), np.int32)
    out[who] = found
    return out


def _shared(ranks: np.ndarray) -> np.ndarray:
    """Where sorted ranks have an equal neighbour."""
    alike = np.zeros(len(ranks) + 1, bool)
    alike[1:-1] = ranks[1:] == ranks[:-1]
    return np.flatnonzero(alike[1:] | alike[:-1])


class WaveletTree:
    """Numbers below `limit` in a fixed order, a level a bit: answers the least number not below a bound among places [low, high)."""

    def __init__(self, values: np.ndarray, limit: int):
        self.levels: list[tuple[int, np.ndarray, int]] = []
        for bit in range(max(1, int(limit).bit_length()) - 1, -1, -1):
            ones = (values >> bit & 1).astype(bool)
            zeros = np.zeros(len(values) + 1, np.int32)
            np.cumsum(~ones, out=zeros[1:])
            self.levels.append((bit, zeros, int(zeros[-1])))
            values = np.concatenate((values[~ones], values[ones]))

    def below(self, low: np.ndarray, high: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """How many numbers of each range are less than its bound."""
        low, high, count = low.copy(), high.copy(), np.zeros(len(low), np.int64)
        for bit, zeros, total in self.levels:
            a, b = zeros[low], zeros[high]
            one = (bound >> bit & 1).astype(bool)
            count += np.where(one, b - a, 0)
            low, high = np.where(one, total + low - a, a), np.where(one, total + high - b, b)
        return count

    def smallest(self, low: np.ndarray, high: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The k-th smallest (k from 0) of each range; there must be one."""
        low, high, k, value = low.copy(), high.copy(), k.copy(), np.zeros(len(low), np.int64)
        for bit, zeros, total in self.levels:
            a, b = zeros[low], zeros[high]
            one = k >= b - a
            value |= one.astype(np.int64) << bit
            k = np.where(one, k - (b - a), k)
            low, high = np.where(one, total + low - a, a), np.where(one, total + high - b, b)
        return value

    def successor(self, low: np.ndarray, high: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """The least number of each range that is not below its bound, or -1."""
        k = self.below(low, high, bound)
        out, some = np.full(len(low), -1, np.int64), k < high - low
        out[some] = self.smallest(low[some], high[some], k[some])
        return out


def _block(q: int) -> int:
    """The longest dyadic block such that each run of period q has one (at a multiple of its length) in all but its last q words."""
    return 1 << (max(q, LEAST - q) + 1).bit_length() - 2


def runs(letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end (exclusive) and smallest period of all runs of at least LEAST letters, by start, then period."""
    none = tuple(np.zeros(0, np.int64) for _ in range(3))
    n = len(letters)
    if n < LEAST:
        return none
    suffixes = Suffixes(letters)
    tree, found, b = None, [none], 1
    while 2 * b - 1 <= max(n // 2, LEAST - 1):
        periods = [q for q in range(1, LEAST) if _block(q) == b] if b <= LEAST else []
        periods += [q for q in (max(2 * b - 1, LEAST), 4 * b - 2) if q >= LEAST and _block(q) == b]
        level = b.bit_length() - 1
        if level >= len(suffixes.same):
            break  # all longer stretches are unlike each other
        if periods:
            tree = tree or WaveletTree(suffixes.order.astype(np.int64), n)
            found.append(_level(suffixes, tree, b, min(periods), max(periods)))
        b *= 2
    start, end, period = (np.concatenate(x) for x in zip(*found))
    by = np.lexsort((period, end, start))
    start, end, period = start[by], end[by], period[by]
    first = np.ones(len(start), bool)  # of one stretch the smallest period: others are its multiples
    first[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, period = start[first], end[first], period[first]
    by = np.lexsort((period, start))
    return start[by], end[by], period[by]


def _level(suffixes: Suffixes, tree: WaveletTree, b: int, least: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs found by the blocks of b letters with periods from `least` to `most`."""
    n = len(suffixes.order)
    same = suffixes.same[b.bit_length() - 1]
    sorted_ranks = same[suffixes.order]
    at = np.arange(0, n - b + 1, b)
    low = same[at].astype(np.int64)
    high = np.searchsorted(sorted_ranks, same[at], "right")
    many = high - low > 1
    at, low, high = at[many], low[many], high[many]
    bound, out = at + least, []
    while len(at):
        pos = tree.successor(low, high, bound)
        some = (pos >= 0) & (pos <= at + most)
        at, low, high, pos = at[some], low[some], high[some], pos[some]
        if not len(at):
            break
        after = tree.successor(low, high, pos + 1)
        step, last = after - pos, pos.copy()
        series = (after >= 0) & (2 * step <= b)
        if series.any():
            p, d = pos[series], step[series]
            last[series] = p + (suffixes.forward(p, p + d) + d - b) // d * d
        own = series & ((pos - at) % np.where(series, step, 1) == 0)
        if own.any():  # the block begins the progression: all but its difference are multiples of the smallest period
            a, d = at[own], step[own]
            own[own] = suffixes.forward(a, a + d) >= pos[own] - a
        single = ~series | own
        # one candidate each: the first distance, or the difference of the block's own progression where it is of this level
        first = np.where(own, np.where((step >= least) & (step <= most), step, 0), pos - at)
        out.append((at[single], first[single]))
        rest = ~single
        if rest.any():
            a, p, d = at[rest], pos[rest], step[rest]
            times = (np.minimum(last[rest], a + most) - p) // d + 1
            which = np.repeat(np.arange(len(a)), times)
            nth = np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times)
            out.append((a[which], p[which] + nth * d[which] - a[which]))
        bound = last + 1
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    at, q = (np.concatenate(x) for x in zip(*out))
    at, q = at[q > 0], q[q > 0]
    start = at - suffixes.backward(at, at + q)
    end = at + q + suffixes.forward(at, at + q)
    kept = end - start >= np.maximum(LEAST, 2 * q)
    return start[kept], end[kept], q[kept]


def repeating(words: list, key: str) -> list:
    """The words with a period planted behind some place of every tenth text, by the checksum of its key."""
    h = zlib.crc32(key.encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    cycle = words[a : a + p]
    return words[:a] + list(itertools.islice(itertools.cycle(cycle), n - a))


def _of_slice(texts: list[list[bytes]]) -> Iterator[tuple]:
    """n_runs, start, length, period, exponent_milli, and the runs and kept words as bytes, for each list of words."""
    ids: list[int] = []
    sizes = [len(w) for w in texts]
    for words in texts:
        known: dict[bytes, int] = {}
        base = len(ids)
        ids += [known.setdefault(w, base + len(known)) for w in words]
    start, end, period = runs(np.array(ids, np.int64))
    firsts = np.concatenate(([0], np.cumsum(sizes)))
    change = np.zeros(len(ids) + 1, np.int64)
    np.add.at(change, start + period, 1)
    np.add.at(change, end, -1)
    dropped = np.cumsum(change) > 0
    bounds = np.searchsorted(start, firsts)
    for i, words in enumerate(texts):
        a, b, base = bounds[i], bounds[i + 1], firsts[i]
        s, q = start[a:b] - base, period[a:b]
        length = end[a:b] - start[a:b]
        gone = dropped[base : firsts[i + 1]]
        kept = list(itertools.compress(words, (~gone).tolist())) if b > a else words
        said = "".join(f"{x},{y},{z}\n" for x, y, z in zip(s.tolist(), length.tolist(), q.tolist())).encode()
        best = (None,) * 4
        if b > a:
            k = int(np.lexsort((q, s, -length))[0])
            best = int(s[k]), int(length[k]), int(q[k]), int(1000 * length[k] // q[k])
        yield (int(b - a), *best, said, b" ".join(kept))


SCHEMA = "doc_id {kind}, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, collapsed string"


def _found(batches: Iterator[pa.RecordBatch], with_text: bool, planted: bool) -> Iterator[pa.RecordBatch]:
    def flush(keys: list, texts: list) -> pa.RecordBatch:
        rows = list(_of_slice(texts))
        cells = [pa.array([r[k] for r in rows], pa.int64()) for k in range(5)]
        cells += [pa.array([hashlib.sha256(r[k]).hexdigest() for r in rows], pa.string()) for k in (5, 6)]
        cells += [pa.array([r[6] for r in rows], pa.binary()).cast(pa.string())] if with_text else []
        return pa.RecordBatch.from_arrays([pa.array(keys, kind), *cells], ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"] + ["collapsed"] * with_text)

    for batch in batches:
        kind, keys, texts, n = batch.schema.field(0).type, [], [], 0
        for key, text in zip(batch.column(0), batch.column(1).cast(pa.binary())):
            words = (text.as_py() or b"").split()  # of bytes: at \x20 and \x09-\x0D
            key = key.as_py()
            if planted:
                words = repeating(words, "" if key is None else str(key))
            if texts and n + len(words) > SLICE:
                yield flush(keys, texts)
                keys, texts, n = [], [], 0
            keys.append(key)
            texts.append(words)
            n += len(words)
        if texts:
            yield flush(keys, texts)


def periodic(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", with_text: bool = True, planted: bool = False) -> DataFrame:
    """For each text its number of runs, the longest one (ties: smallest start, then period; null without a
    run) with exponent_milli = floor(1000 length / period), a digest of all runs (`start,length,period` lines),
    and the words without the repeats (those of a run behind its first period), joined by a space, and their
    digest. Words are stretches without white space. planted: every tenth text is made periodic first (a test law)."""
    rows = pick(docs, doc_id, text).toDF("doc_id", "text")
    schema = SCHEMA.format(kind=rows.schema["doc_id"].dataType.simpleString())
    if not with_text:
        schema = schema.rsplit(",", 1)[0]
    return rows.mapInArrow(lambda batches: _found(batches, with_text, planted), schema)
