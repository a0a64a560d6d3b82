"""Byte-level BPE encoding and decoding.

The merges are compiled into a finite-state transducer that is determinised while it runs. A
configuration is (bytes of an unfinished token, last finished token, finished tokens not yet
emitted); a state is the set of all configurations that agree with the bytes read. Two adjacent
tokens are compatible if merging their joined bytes gives back those two; an encoding is the one
whose neighbours are all compatible, so each state has one configuration without unfinished
bytes. What all configurations of a state have finished in common is emitted, so tokens leave
after a lookahead bounded by the longest token. States and transitions are made on first use; when
there are as many as may be kept, further ones are used and dropped, and in the end all are made anew.

Defined cases: a null text is encoded like an empty one (no ids); equal texts give equal ids;
texts are processed whole; ids outside the vocabulary raise when decoded; null ids decode to
nothing; bytes that are not UTF-8 decode to U+FFFD in `decode_text`.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import re
from array import array
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Code points that became letters (first list) or numbers (second) in Unicode
# versions later than the one the public tokenizer library splits by (16.0), as ranges.
LATER_LETTERS = (
    "0558 058B-058C 088F 0C5C 0CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 "
    "10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB 11DF1 16EA0-16EB8 16EBB-16ED3 16FF2-16FF3 187F8-187FF 18CD6-18CDA "
    "18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 "
    "1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD "
    "323B0-33479 3D000-3FC3F"
)
LATER_NUMBERS = "11DE0-11DE9 1246F 12475-1247F 12550-12686 16FF4-16FF6"

#: Bounds of what a Python worker keeps (about 350 MB): states of the transducer, and pieces in each of two generations.
MOST_STATES = 250_000
MOST_PIECES = 300_000
NEAR = 0x250
HEAD = 6


def _members(ranges: str) -> str:
    ends = (r.split("-") for r in ranges.split())
    return "".join(f"\\U{int(e[0], 16):08X}-\\U{int(e[-1], 16):08X}" for e in ends)


def _ranges(chars: list[str]) -> str:
    """A character class body for these sorted characters."""
    runs: list[list[str]] = []
    for c in chars:
        if runs and ord(c) == ord(runs[-1][1]) + 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "".join(f"{re.escape(a)}-{re.escape(b)}" for a, b in runs)


@lru_cache(maxsize=4)
def splitter(pattern: str):
    """The pattern as a function from a text to its pieces. Texts of characters below NEAR (Latin)
    run it with its classes written out, which is fastest; others run the pattern itself, and those
    with later code points one without them in its classes."""
    near = [chr(c) for c in range(NEAR)]
    own = {k: _ranges([c for c in near if regex.match(k, c)]) for k in (r"\p{L}", r"\p{N}", r"\s")}
    both = r"[^\s\p{L}\p{N}]"
    written = pattern.replace(both, "\0")
    for k, ranges in own.items():
        written = written.replace(k, f"[{ranges}]")
    written = written.replace(r"\S", f"[^{own[chr(92) + 's']}]").replace("\0", "[^" + "".join(own.values()) + "]")
    latin, far = re.compile(written), re.compile(f"[^\x00-{near[-1]}]")

    letters, numbers = _members(LATER_LETTERS), _members(LATER_NUMBERS)
    plain, later = regex.compile(pattern), regex.compile(f"[{letters}{numbers}]")
    exact = pattern.replace(both, "\0").replace(r"\p{L}", f"[\\p{{L}}--[{letters}]]").replace(r"\p{N}", f"[\\p{{N}}--[{numbers}]]")
    careful = regex.compile(exact.replace("\0", f"[{both}||[{letters}{numbers}]]"), regex.V1)

    def pieces(text: str) -> list[str]:
        if text.isascii() or not far.search(text):
            return latin.findall(text)
        return (careful if later.search(text) else plain).findall(text)

    return pieces


def read_ranks(raw: bytes) -> dict[bytes, int]:
    """Lines of `base64 rank`."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line.strip())}


class Transducer:
    """Bytes to ids by rank. `encode` takes one piece of text; `pieces` maps a piece to its packed ids.

    Unfinished bytes are held as a node of the trie of all tokens (0: none)."""

    def __init__(self, ranks: dict[bytes, int], most_states: int = MOST_STATES, most_pieces: int = MOST_PIECES):
        self.ranks = ranks
        self.tokens: list = [None] * (max(ranks.values()) + 1)  # bytes by id
        for token, i in ranks.items():
            self.tokens[i] = token
        self.child: dict[int, int] = {}  # node * 256 + byte -> node
        self.ends, self.inner = [-1], [True]  # the token that ends at a node; whether others go on
        for token, i in ranks.items():
            node = 0
            for byte in token:
                self.inner[node] = True
                key = node << 8 | byte
                if key not in self.child:
                    self.child[key] = len(self.ends)
                    self.ends.append(-1)
                    self.inner.append(False)
                node = self.child[key]
            self.ends[node] = i
        self.compatible: dict[int, bool] = {}
        self.reachable: dict[int, bool] = {}
        self.most_states = most_states
        self.pieces = _Pieces(self, most_pieces)
        self._clear()

    def _clear(self) -> None:
        self.start = _State((0, -1, ()), self._step)
        self.states: dict[tuple, _State] = {self.start.found: self.start}
        self.heads: dict[bytes, tuple[_State, tuple]] = {}  # where the first HEAD bytes of a piece lead
        self.unkept = 0

    def merged(self, raw: bytes) -> list[int]:
        """Merging by lowest rank, leftmost first; for the short strings that decide compatibility."""
        parts, rank, none = [raw[i : i + 1] for i in range(len(raw))], self.ranks.get, len(self.ranks)
        costs = [rank(a + b, none) for a, b in zip(parts, parts[1:])]
        while costs:
            best = min(costs)
            if best == none:
                break
            i = costs.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del costs[i]
            if i:
                costs[i - 1] = rank(parts[i - 1] + parts[i], none)
            if i < len(costs):
                costs[i] = rank(parts[i] + parts[i + 1], none)
        return [self.ranks[p] for p in parts]

    def _fits(self, last: int, token: int) -> bool:
        """Whether `token` may stand after `last` (-1: at the start)."""
        key = last << 24 | token if last >= 0 else -1 - token
        fits = self.compatible.get(key)
        if fits is None:
            if len(self.compatible) >= 2 * self.most_states:
                self.compatible.clear()
            before = [] if last < 0 else [last]
            fits = self.compatible[key] = self.merged(b"".join(map(self.tokens.__getitem__, (*before, token)))) == [*before, token]
        return fits

    def _step(self, state: _State, byte: int) -> tuple[_State, tuple]:
        child, ends, inner = self.child, self.ends, self.inner
        found, whole, owes = [], -1, ()
        old = iter(state.found)
        for node, last, owed in zip(old, old, old):  # longest unfinished part first; the first that fits is the only one
            node = child.get(node << 8 | byte)
            if node is None:
                continue
            if inner[node]:
                found.append((node, last, owed))
            if whole < 0 and ends[node] >= 0 and self._fits(last, ends[node]):
                whole = ends[node]
                owes = (*owed, whole)
        if whole < 0:
            raise ValueError("these ranks give no encoding of a prefix; all single bytes must be tokens")
        n, most = 0, min([len(c[2]) for c in found], default=len(owes))
        while n < most and n < len(owes) and all(c[2][n] == owes[n] for c in found):
            n += 1
        flat: list = []
        for node, last, owed in found:
            flat += (node, last, owed[n:])
        flat += (0, whole, owes[n:])
        key = tuple(flat)
        after = self.states.get(key)
        if after is None:
            after = _State(key, state.step)
            if len(self.states) >= self.most_states:  # used once, not kept
                self.unkept += 1
                return after, owes[:n]
            self.states[key] = after
        state[byte] = made = after, owes[:n]
        return made

    def encode(self, piece: bytes) -> list[int]:
        token = self.ranks.get(piece)
        if token is not None:
            return [token]
        if self.unkept > 20 * self.most_states:  # the texts have changed: learn anew
            self._clear()
        state, ids, rest = self.start, [], piece
        if len(piece) > HEAD:
            head = piece[:HEAD]
            known = self.heads.get(head)
            if known is None:
                for byte in head:
                    state, out = state[byte]
                    ids += out
                if len(self.heads) >= self.most_states:
                    self.heads.clear()
                self.heads[head] = state, tuple(ids)
            else:
                state, ids = known[0], [*known[1]]
            rest = piece[HEAD:]
        for byte in rest:
            state, out = state[byte]
            if out:
                ids += out
        ids += state.found[-1]
        return ids


class _State(dict):
    """The next state and the tokens emitted, by byte, made on first use. found: node, last token and
    owed tokens of each configuration in turn, that without unfinished bytes last."""

    __slots__ = ("found", "step")

    def __init__(self, found: tuple, step: Callable):
        self.found, self.step = found, step

    def __missing__(self, byte: int) -> tuple:
        return self.step(self, byte)


class _Pieces(dict):
    """Packed ids of recent pieces, made by the transducer on first use. When full it becomes the
    older generation, from which pieces in use come back."""

    def __init__(self, transducer: Transducer, most: int):
        super().__init__()
        self.transducer, self.most, self.older = transducer, most, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            ids = array("i", self.transducer.encode(piece.encode())).tobytes()
        if len(piece) <= 64:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[piece] = ids
        return ids


class Utf8Stream:
    """Incremental UTF-8: the state is the bytes of a character not yet complete (three at most)."""

    def __init__(self) -> None:
        self.pending = b""

    def feed(self, chunk: bytes) -> str:
        data = self.pending + chunk
        cut = len(data)
        for back in range(1, min(3, len(data)) + 1):
            byte = data[-back]
            if byte >= 0xC0:  # a lead byte: how many follow it says whether it is complete
                if back < (2 if byte < 0xE0 else 3 if byte < 0xF0 else 4):
                    cut -= back
                break
            if byte < 0x80:
                break
        self.pending = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def end(self) -> str:
        rest, self.pending = self.pending.decode("utf-8", "replace"), b""
        return rest


@contextmanager
def _no_cycles() -> Iterator[None]:
    """Without the cycle collector, which would scan all states again and again; none of them are in cycles."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


_made: dict[str, Transducer] = {}


def _transducer(raw: bytes) -> Transducer:
    """One for each vocabulary and Python worker."""
    key = hashlib.sha256(raw).hexdigest()
    if key not in _made:
        _made.clear()
        _made[key] = Transducer(read_ranks(raw))
    return _made[key]


def decode_stream(tokens: list[bytes], ids: Sequence[int], step: int = 4096) -> Iterator[str]:
    """Text of the ids as it becomes complete, `step` ids at a time."""
    stream = Utf8Stream()
    for i in range(0, len(ids), step):
        yield stream.feed(b"".join(map(tokens.__getitem__, ids[i : i + step])))
    yield stream.end()


class ByteBpe:
    """Column functions for one vocabulary. The rank file is read where this is made (the driver)
    and broadcast: half a MB, fixed by the vocabulary and not by the data."""

    def __init__(self, spark: SparkSession, path: str, pattern: str):
        with open(path, "rb") as file:
            self.ranks = spark.sparkContext.broadcast(file.read())
        self.pattern = pattern

    def encode(self, text: Column) -> Column:
        """array<int> of ids for each text."""
        ranks, pattern = self.ranks, self.pattern

        @F.arrow_udf(T.ArrayType(T.IntegerType(), False))
        def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            pieces, ids_of = splitter(pattern), _transducer(ranks.value).pieces
            with _no_cycles():
                for batch in batches:
                    for part in _parts(batch):
                        yield _packed([b"".join(map(ids_of.__getitem__, pieces(t.as_py() or ""))) for t in part])

        return encode(text)

    def round_trip(self, text: Column) -> Column:
        """struct(ids, decoded): the ids of each text, and the text that decoding these ids streams
        out; both in one Python worker, which then holds one transducer."""
        ranks, pattern = self.ranks, self.pattern

        @F.arrow_udf(T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType(), False)), T.StructField("decoded", T.StringType())]))
        def round_trip(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            transducer = _transducer(ranks.value)
            pieces, ids_of, tokens = splitter(pattern), transducer.pieces, transducer.tokens
            with _no_cycles():
                for batch in batches:
                    for part in _parts(batch):
                        ids = [b"".join(map(ids_of.__getitem__, pieces(t.as_py() or ""))) for t in part]
                        decoded = pa.array(["".join(decode_stream(tokens, array("i", x))) for x in ids], pa.string())
                        yield pa.StructArray.from_arrays([_packed(ids), decoded], ["ids", "decoded"])

        return round_trip(text)

    def decode(self, ids: Column) -> Column:
        """The bytes that the ids stand for."""
        ranks = self.ranks

        @F.arrow_udf(T.BinaryType())
        def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            tokens = _transducer(ranks.value).tokens
            for batch in batches:
                yield pa.array([b"".join(map(tokens.__getitem__, x)) for x in _lists(batch)], pa.binary())

        return decode(ids)

    def decode_text(self, ids: Column) -> Column:
        """The same as text, through the incremental UTF-8 state machine."""
        ranks = self.ranks

        @F.arrow_udf(T.StringType())
        def decode_text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            tokens = _transducer(ranks.value).tokens
            for batch in batches:
                yield pa.array(["".join(decode_stream(tokens, x)) for x in _lists(batch)], pa.string())

        return decode_text(ids)


def _parts(texts: pa.Array, rows: int = 256) -> Iterator[pa.Array]:
    """A batch in slices, so that what is made of one slice is sent before the next is begun."""
    for i in range(0, len(texts), rows):
        yield texts.slice(i, rows)


def _packed(ids: list[bytes]) -> pa.ListArray:
    """Packed int32 ids of each text as an Arrow list array."""
    at = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32)
    flat = pa.Array.from_buffers(pa.int32(), int(at[-1]), [None, pa.py_buffer(b"".join(ids))])
    return pa.ListArray.from_arrays(pa.array(at), flat, type=pa.list_(pa.field("element", pa.int32(), False)))


def _lists(batch: pa.ListArray) -> Iterator[list[int]]:
    values = batch.values.to_numpy(zero_copy_only=False)
    at = batch.offsets.to_numpy()
    empty = np.zeros(0, np.int32)
    for i, valid in enumerate(batch.is_valid().to_pylist()):
        yield (values[at[i] : at[i + 1]] if valid else empty).tolist()
