"""Benchmark decontamination by winnowing.

Words of a text are hashed, each K neighbouring words give a k-gram hash, and the least hash of
every W neighbouring k-grams is kept as a fingerprint, on both sides. A span of W + K - 1 = 10
shared words has the same least hash on both sides, so a document that holds any window of 10
item words meets one of the item's fingerprints: none is missed. Around each such hit the
windows that contain it are looked up and compared word by word, so none is invented. An item of
fewer than ten words is one window, shorter than winnowing guarantees; for each such length that
occurs, every span of that many document words is looked up.

The size of the benchmark's texts is measured first. Up to `small` bytes they are broadcast, and
each Python worker holds an index of sorted arrays (about six times the texts); documents are not
shuffled then. Beyond it fingerprints are joined by a shuffle: distinct document fingerprints meet
distinct item fingerprints, those in both are dealt to SALTS copies and joined to the documents'
own, so that no frequent passage is one task's work; the windows around hits are then joined to
the items' windows by their words, salted alike.

Defined cases: null or wordless texts have no words and no hits; an item without words is never
found; repeated items count once by id, a null item_id is the empty string; an empty benchmark
hits nothing; rows with equal doc_id and text have equal results; texts of any length are
processed whole; extra columns are ignored (`clean` keeps them).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomfold.llm.common import byte_slices, materialise, pick
from loomfold.llm.textbytes import ALNUM, BASE, LOWER, grams, mix, room, span_hashes, word_spans

WINDOW, K = 10, 5
W = WINDOW - K + 1
SMALL = 8 << 20
SALTS = 16
ROWS = 1 << 15  # windows sent at once
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

FOUND = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("last", T.LongType())]))),
    T.StructField("items", T.ArrayType(T.StringType())),
])
_FOUND = pa.struct([
    ("n_words", pa.int64()),
    ("spans", pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))),
    ("items", pa.list_(pa.string())),
])


def _slide(x: np.ndarray, n: int, pick_of) -> np.ndarray:
    m = len(x) - n + 1
    out = x[:m].copy()
    for j in range(1, n):
        pick_of(out, x[j : j + m], out=out)
    return out


def winnow(g: np.ndarray) -> np.ndarray:
    """Positions of k-gram hashes that are least in some window of W neighbours (all of equal ones)."""
    if len(g) < W:
        return np.arange(len(g))
    least = _slide(g, W, np.minimum)
    padded = np.concatenate([np.zeros(W - 1, np.uint64), least, np.zeros(W - 1, np.uint64)])
    return np.flatnonzero(g == _slide(padded, W, np.maximum))


class Words:
    """Words of a run of texts: spans in the lower-cased bytes, hashes, each text's first word."""

    def __init__(self, raw: np.ndarray, at: np.ndarray):
        self.raw = LOWER[raw]
        self.starts, self.ends, self.first = word_spans(self.raw, at, ALNUM)
        self.hashes = span_hashes(self.raw, self.starts, self.ends)

    def window(self, i: int, n: int) -> bytes:
        return b" ".join(self.raw[a:b].tobytes() for a, b in zip(self.starts[i : i + n], self.ends[i : i + n]))


class Index:
    """Item words in one buffer; windows by length as sorted hashes and the words they start at; fingerprints of those of WINDOW words."""

    def __init__(self, items: list[tuple[str, str]]):
        self.names = [i or "" for i, _ in items]
        raw, starts, ends, first, hashes = [np.zeros(0, np.uint8)], [], [], [np.zeros(1, np.int64)], []
        size = number = 0
        for _, part, at in byte_slices(pa.array([t or "" for _, t in items], pa.string())):
            words = Words(part, at)
            raw.append(words.raw)
            starts.append((words.starts + size).astype(np.int32))
            ends.append((words.ends + size).astype(np.int32))
            first.append(words.first[1:] + number)
            hashes.append(words.hashes)
            size, number = size + len(part), number + len(words.hashes)
        none = np.zeros(0, np.int32)
        self.raw, self.starts, self.ends = np.concatenate(raw), np.concatenate([none, *starts]), np.concatenate([none, *ends])
        self.first, h = np.concatenate(first), np.concatenate([np.zeros(0, np.uint64), *hashes])
        g = grams(h, K)
        self.prints = np.unique(g[winnow(g)])
        sizes = np.diff(self.first)
        of_word = np.repeat(np.minimum(sizes, WINDOW), sizes)
        self.windows: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in np.unique(of_word).tolist():
            at = np.flatnonzero((of_word == n) & room(self.first, n))
            own = grams(h, n)[at]
            order = np.argsort(own, kind="stable")
            self.windows[n] = own[order], at[order].astype(np.int32)
        self.told: dict[tuple[int, int], dict[bytes, tuple]] = {}

    def items(self, n: int, of: np.uint64, said: bytes) -> tuple:
        """Names of the items with this window. What a hash stands for is worked out when it is first met."""
        key = n, int(of)
        if key not in self.told:
            hashes, at = self.windows[n]
            found: dict[bytes, set] = {}
            for i in at[np.searchsorted(hashes, of) : np.searchsorted(hashes, of, "right")].tolist():
                text = b" ".join(self.raw[a:b].tobytes() for a, b in zip(self.starts[i : i + n], self.ends[i : i + n]))
                found.setdefault(text, set()).add(self.names[int(np.searchsorted(self.first, i, "right")) - 1])
            self.told[key] = {t: tuple(x) for t, x in found.items()}
        return self.told[key].get(said, ())

    def hits(self, words: Words) -> Iterator[tuple[int, int, tuple]]:
        """(word, length, items) of each occurrence of a window, sorted by word within a length."""
        for n, (known, _) in self.windows.items():
            starts, of = near(words, n, self.prints) if n == WINDOW else spans_of(words, n)
            for s in np.flatnonzero(_among(of, known)):
                items = self.items(n, of[s], words.window(starts[s], n))
                if items:
                    yield int(starts[s]), n, items


def near(words: Words, n: int, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First words and hashes of the windows of n words within a text that contain one of these fingerprints."""
    g = grams(words.hashes, K)
    at = winnow(g)
    at = at[_among(g[at], prints)]
    starts = np.unique((at[:, None] - np.arange(W)[None, :]).ravel())
    starts = starts[starts >= 0]
    starts = starts[room(words.first, n)[starts]]
    return starts, _rows(words.hashes[starts[:, None] + np.arange(n)[None, :]])


def spans_of(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """First words and hashes of all spans of n words within a text."""
    starts = np.flatnonzero(room(words.first, n))
    return starts, grams(words.hashes, n)[starts]


def _rows(h: np.ndarray) -> np.ndarray:
    out = np.zeros(len(h), np.uint64)
    for j in range(h.shape[1]):
        out = out * BASE + h[:, j]
    return mix(out)


def _among(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(x), bool)
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


_made: dict[str, Index] = {}


def _index(shared) -> Index:
    """One for each broadcast and Python worker."""
    if shared.id not in _made:
        _made.clear()
        _made[shared.id] = Index(shared.items.value)
    return _made[shared.id]


class _Shared:
    def __init__(self, spark, items: list[tuple[str, str]], key: str):
        self.items, self.id = spark.sparkContext.broadcast(items), key


def _items(benchmark: DataFrame, item_id: str, text: str) -> DataFrame:
    return pick(benchmark, item_id, text).select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), F.col(text).alias("text"))


def _size(items: DataFrame) -> int:
    return items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]


def finder(items: DataFrame):
    """A column function text -> struct(n_words, spans of hit words (last exclusive), items), for items of a checked size."""
    shared = _Shared(items.sparkSession, [(r["item"], r["text"]) for r in items.collect()], uuid.uuid4().hex)

    @F.arrow_udf(FOUND)
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        index = _index(shared)
        for texts in batches:
            out = []
            for _, raw, at in byte_slices(texts):
                words = Words(raw, at)
                spans: dict[int, list] = {}
                items: dict[int, set] = {}
                for s, n, names in index.hits(words):
                    i = int(np.searchsorted(words.first, s, "right")) - 1
                    own = s - int(words.first[i])
                    spans.setdefault(i, []).append((own, own + n))
                    items.setdefault(i, set()).update(names)
                for i, n in enumerate(np.diff(words.first).tolist()):
                    out.append((n, [{"first": a, "last": b} for a, b in _merged(spans.get(i, []))], sorted(items.get(i, ()))))
            yield pa.array([dict(zip(("n_words", "spans", "items"), x)) for x in out], _FOUND)

    return find


# The same by joins, for a benchmark of any size.

_PRINT = T.ArrayType(T.StructType([T.StructField("n", T.IntegerType()), T.StructField("h", T.LongType())]))
_PA_PRINT = pa.list_(pa.struct([("n", pa.int32()), ("h", pa.int64())]))


def _prints(lengths: tuple[int, ...] | None):
    """A column function text -> its distinct fingerprints (n, h): for WINDOW those of winnowing, else hashes of all spans of
    these lengths. None: of an item, whose own length decides."""

    @F.arrow_udf(_PRINT)
    def prints(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            counts, ns, hs = [], [], []
            for _, raw, at in byte_slices(texts, 1 << 20):
                words = Words(raw, at)
                g = grams(words.hashes, K)
                kept = winnow(g)
                kept = kept[room(words.first, K)[kept]]
                row = np.searchsorted(words.first, kept, "right") - 1
                found = [(np.full(len(kept), WINDOW), g[kept], row)]
                sizes = np.diff(words.first)
                for n in range(1, WINDOW) if lengths is None else lengths:
                    if n < WINDOW and (lengths is not None or (sizes == n).any()):
                        starts, of = spans_of(words, n)
                        found.append((np.full(len(starts), n), of, np.searchsorted(words.first, starts, "right") - 1))
                n, h, row = (np.concatenate(x) for x in zip(*found))
                if lengths is None:
                    fits = n == np.minimum(sizes, WINDOW)[row]
                    n, h, row = n[fits], h[fits], row[fits]
                order = np.lexsort((h, n, row))
                n, h, row = n[order], h[order], row[order]
                new = np.ones(len(n), bool)
                new[1:] = (n[1:] != n[:-1]) | (h[1:] != h[:-1]) | (row[1:] != row[:-1])
                counts.append(np.bincount(row[new], minlength=len(sizes)))
                ns.append(n[new])
                hs.append(h[new])
            values = pa.StructArray.from_arrays([pa.array(np.concatenate(ns).astype(np.int32)), pa.array(np.concatenate(hs).view(np.int64))], ["n", "h"]) if counts else pa.array([], _PA_PRINT.value_type)
            ends = np.concatenate([[0], np.cumsum(np.concatenate(counts))]) if counts else np.zeros(1)
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)

    return prints


def _windows(rows: DataFrame, keys: list[str], prints: str | None) -> DataFrame:
    """keys, s, n, said: the windows of each text around the fingerprints in column `prints`, or all of an item's. Rows are sent as they come."""
    schema = T.StructType([*[rows.schema[k] for k in keys], T.StructField("s", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("said", T.StringType())])

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                own = [batch.column(j).slice(i, 1) for j in range(len(keys))]
                for _, raw, at in byte_slices(batch.column(len(keys)).slice(i, 1)):
                    words = Words(raw, at)
                    size = len(words.hashes)
                    if prints is None:
                        wanted = {min(size, WINDOW): None} if size else {}
                    else:
                        wanted = {}
                        for x in batch.column(len(keys) + 1)[i].as_py():
                            wanted.setdefault(x["n"], []).append(x["h"])
                    for n, of in wanted.items():
                        if of is None:
                            starts = np.arange(size - n + 1)
                        elif n == WINDOW:
                            starts = near(words, n, np.sort(np.array(of, np.int64).view(np.uint64)))[0]
                        else:
                            starts, h = spans_of(words, n)
                            starts = starts[_among(h, np.sort(np.array(of, np.int64).view(np.uint64)))]
                        for a in range(0, len(starts), ROWS):
                            part = starts[a : a + ROWS]
                            said = pa.array([words.window(s, n) for s in part], pa.binary()).cast(pa.string())
                            copies = [pa.concat_arrays([k] * len(part)) if len(part) < 8 else k.take(pa.array(np.zeros(len(part), np.int64))) for k in own]
                            yield pa.RecordBatch.from_arrays([*copies, pa.array(part, pa.int64()), pa.array(np.full(len(part), n), pa.int32()), said], [*keys, "s", "n", "said"])

    columns = [*keys, "text", *([prints] if prints else [])]
    return rows.select(*columns).mapInArrow(sent, schema)


def joined(texts: DataFrame, items: DataFrame) -> DataFrame:
    """id, key, spans, items of the texts (id, key, text) with hits."""
    salt = F.pmod(F.xxhash64("id", "key"), F.lit(SALTS))
    salts = F.explode(F.array(*map(F.lit, range(SALTS)))).alias("salt")
    of_items = materialise(items.select(F.explode(_prints(None)(F.col("text"))).alias("p")).select("p.n", "p.h").distinct(), "item-prints")
    lengths = tuple(sorted(r["n"] for r in of_items.select("n").distinct().collect()))  # at most WINDOW numbers
    own = texts.select("id", "key", F.explode(_prints(lengths)(F.col("text"))).alias("p")).select("id", "key", "p.n", "p.h")
    shared = materialise(own.select("n", "h").distinct().join(of_items, ["n", "h"], "left_semi"), "shared-prints")
    hit = own.withColumn("salt", salt).join(shared.select("n", "h", salts), ["n", "h", "salt"], "left_semi")
    found = materialise(hit.groupBy("id", "key").agg(F.collect_set(F.struct("n", "h")).alias("prints")), "hit-prints")
    again = found.withColumnsRenamed({"id": "hit_id", "key": "hit_key"})
    around = texts.join(again, F.col("id").eqNullSafe(F.col("hit_id")) & (F.col("key") == F.col("hit_key"))).select("id", "key", "text", "prints")
    seen = materialise(_windows(around, ["id", "key"], "prints").distinct(), "hit-windows")
    known = _windows(items, ["item"], None).select("item", "n", "said").distinct().join(seen.select("n", "said").distinct(), ["n", "said"], "left_semi")
    met = seen.withColumn("salt", salt).join(known.select("item", "n", "said", salts), ["n", "said", "salt"])
    all_spans = F.transform(F.sort_array(F.collect_set(F.struct("s", "n"))), lambda x: F.struct(x["s"].alias("first"), (x["s"] + x["n"]).alias("last")))
    return met.groupBy("id", "key").agg(_merged_spans(all_spans).alias("spans"), F.sort_array(F.collect_set("item")).alias("items"))


def _merged_spans(spans: Column) -> Column:
    """Sorted spans with those that touch joined."""
    kind = "array<struct<first:bigint,last:bigint>>"

    def add(out: Column, span: Column) -> Column:
        end = F.element_at(out, -1)
        grown = F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.struct(end["first"].alias("first"), F.greatest(end["last"], span["last"]).alias("last"))))
        return F.when(F.size(out) == 0, F.array(span)).when(end["last"] >= span["first"], grown).otherwise(F.concat(out, F.array(span))).cast(kind)

    return F.aggregate(spans, F.array().cast(kind), add)


def decontaminate(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", small: int = SMALL) -> DataFrame:
    """For each document: doc_id, n_words, n_hit (words inside a window of the benchmark), spans of
    those words, items (ids found, sorted as strings), contaminated."""
    rows, items = pick(docs, doc_id, text), _items(benchmark, "item_id", "text")
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"])
    if _size(items) <= small:
        found = rows.select(doc_id, finder(items)(F.col(text)).alias("f")).select(doc_id, "f.*")
    else:
        texts = rows.select(F.col(doc_id).alias("id"), F.xxhash64(text).alias("key"), F.col(text).alias("text"))
        met = joined(texts, items).withColumnsRenamed({"id": "hit_id", "key": "hit_key"})
        counted = texts.select("id", "key", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("n_words"))
        none = [F.coalesce(c, F.array().cast(FOUND[c].dataType)).alias(c) for c in ("spans", "items")]
        found = counted.join(met, F.col("id").eqNullSafe(F.col("hit_id")) & (F.col("key") == F.col("hit_key")), "left").select(F.col("id").alias(doc_id), "n_words", *none)
    return found.select(doc_id, "n_words", n_hit.alias("n_hit"), "spans", "items", (n_hit > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", small: int = SMALL) -> DataFrame:
    """The documents (all their columns) without any window of a benchmark item."""
    names, items = [f"c{i}" for i in range(len(docs.columns))], _items(benchmark, "item_id", "text")
    plain = docs.toDF(*names)
    own_id, own_text = F.col(names[docs.columns.index(doc_id)]), F.col(names[docs.columns.index(text)])
    if _size(items) <= small:
        found = plain.withColumn("found", finder(items)(own_text))
        return found.where(F.size("found.spans") == 0).select(*names).toDF(*docs.columns)
    met = joined(plain.select(own_id.alias("id"), F.xxhash64(own_text).alias("key"), own_text.alias("text")), items)
    return plain.join(met, own_id.eqNullSafe(F.col("id")) & (F.xxhash64(own_text) == F.col("key")), "left_anti").toDF(*docs.columns)
