"""SimHash near-duplicates: fingerprints, links of few differing bits, and connected groups.

Equal fingerprints are one node. Fingerprints that differ in at most MOST_BITS of 64 bits agree in
all but MOST_BITS of any BLOCKS bit blocks, so each is dealt to one bucket for every choice of
BLOCKS - MOST_BITS blocks, keyed by those bits; more blocks (longer keys) are taken as the number
of fingerprints grows, so that buckets stay small. A bucket over BUCKET fingerprints is cut into
chunks, and every pair of chunks is a bucket of its own. Within buckets the fingerprints are sorted
by Gray rank, which puts those alike next to each other: the nodes of a hierarchical index are runs of
64, 8 and 2 of them (then each alone), and a node holds the bits that all of its codes share, at any
place, factored out as a mask and a pattern. Pairs of nodes are compared level by level: bits that both
share and that were not shared above add their differences to those counted so far, and a pair of
groups whose sum passes MOST_BITS is pruned whole, as is one whose members are known to be connected.
A bucket yields at most one link for each member (a star), never all pairs. The stars are joined to
components by rounds of large and small stars with minimum aggregation, each round written to the
shared folder; roots of large components and fingerprints of many copies are looked up by broadcast, as
they are few.

Defined cases: a null or wordless text has fingerprint zero and is linked like any other; fewer
than four words are one shingle; repeated rows and equal texts are one node and share a component;
a null doc_id is ignored in the minimum (a component of nulls only has a null id); no documents
give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomfold.llm.common import lookup, materialise, pick, scope

SHINGLE, MOST_BITS, SEED = 4, 4, 42
BUCKET = 4096
PAIRS = 1 << 20  # candidate pairs held at once
WIDTHS = (64, 8, 2, 1)  # codes of a node by level
#: Blocks by number of distinct fingerprints, so that a bucket of evenly spread ones has about 1000 at most.
BLOCKS = ((4_000_000, 5), (2_000_000_000, 6), (130_000_000_000, 7))


def fingerprint_of(text: bytes) -> int:
    """Unsigned 64-bit SimHash of the shingles of a text's bytes."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    if n < SHINGLE:
        hashes = np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
        starts = np.concatenate([[0], ends[: n - SHINGLE]]).tolist()
        shingles = (joined[a:b] for a, b in zip(starts, (ends[SHINGLE - 1 :] - 1).tolist()))
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, n - SHINGLE + 1)
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 15):
        counts += np.unpackbits(hashes[i : i + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


@F.arrow_udf(T.LongType())
def _fingerprint(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        raw = batch.fill_null("").cast(pa.binary())
        yield pa.array(np.array([fingerprint_of(x.as_py()) for x in raw], np.uint64).view(np.int64))


def fingerprint(text: Column) -> Column:
    """The fingerprint as a signed 64-bit number (the same bits)."""
    return _fingerprint(text)


def gray_rank(code: Column) -> Column:
    for shift in (1, 2, 4, 8, 16, 32):
        code = code.bitwiseXOR(F.shiftrightunsigned(code, shift))
    return code


def block_count(n: int) -> int:
    return next((b for most, b in BLOCKS if n <= most), 8)


def masks(blocks: int) -> list[int]:
    """Signed 64-bit masks, one for each choice of blocks that must agree."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    each = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]
    return [int(np.array(sum(c), np.uint64).view(np.int64)) for c in combinations(each, blocks - MOST_BITS)]


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def _connect(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Joins the components of each pair; labels are the least index of a component."""
    while len(a):
        la, lb = labels[a], labels[b]
        differ = la != lb
        a, b, la, lb = a[differ], b[differ], la[differ], lb[differ]
        np.minimum.at(labels, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            up = labels[labels]
            if np.array_equal(up, labels):
                break
            labels = up
    return labels


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... (counts[i] of them) for each i in turn."""
    total = int(counts.sum())
    before = np.cumsum(counts) - counts
    return np.arange(total) - np.repeat(before, counts) + np.repeat(starts, counts)


def _tree(group: np.ndarray, code: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """Nodes of the index by level, from the whole groups down to single codes: where each starts, the mask of
    the bits that all of its codes share, and those bits. A node is a run of codes next to each other in Gray order."""
    n = len(code)
    head = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    place = np.arange(n) - np.repeat(head, np.diff(np.append(head, n)))
    starts = [head, *[np.flatnonzero(place % width == 0) for width in WIDTHS]]
    both = [np.bitwise_and.reduceat(code, s) for s in starts]
    shared = [~(every ^ np.bitwise_or.reduceat(code, s)) for every, s in zip(both, starts)]
    return starts, shared, [every & mask for every, mask in zip(both, shared)]


def local_labels(group: np.ndarray, code: np.ndarray, seen: list | None = None) -> np.ndarray:
    """Least index of each member's component within its group; members are in Gray order in a group.
    `seen` is given (level, pairs compared, pairs kept) for every step."""
    n = len(code)
    labels = np.arange(n)
    near = np.flatnonzero((group[1:] == group[:-1]) & (_popcount(code[1:] ^ code[:-1]) <= MOST_BITS))
    labels = _connect(labels, near, near + 1)
    starts, shared, pattern = _tree(group, code)
    bounds = [np.searchsorted(below, np.append(above, n)) for above, below in zip(starts, starts[1:])]  # children of a node
    low = [np.minimum.reduceat(labels, s) for s in starts]
    high = [np.maximum.reduceat(labels, s) for s in starts]
    roots = np.arange(len(starts[0]))
    work = [(0, roots, roots, np.zeros(len(roots), np.uint8))]
    while work:
        level, x, y, apart = work.pop()
        if level == len(starts) - 1:
            labels = _connect(labels, x, y)
            continue
        open_ = ~((low[level][x] == high[level][y]) & (high[level][x] == low[level][y]))
        x, y, apart = x[open_], y[open_], apart[open_]
        bound = bounds[level]
        wide = bound[x + 1] - bound[x]
        left = _ranges(bound[x], wide)
        same = np.repeat(x == y, wide)
        start = np.where(same, left, np.repeat(bound[y], wide))
        count = np.repeat(bound[y + 1], wide) - start
        apart, known = np.repeat(apart, wide), np.repeat(shared[level][x] & shared[level][y], wide)
        until = np.cumsum(count)
        first = 0
        while first < len(left):
            last = max(first + 1, int(np.searchsorted(until, (until[first - 1] if first else 0) + PAIRS, "right")))
            part = slice(first, last)
            first = last
            i, j = np.repeat(left[part], count[part]), _ranges(start[part], count[part])
            mask, bits = shared[level + 1], pattern[level + 1]
            fresh = mask[i] & mask[j] & ~np.repeat(known[part], count[part])
            d = np.repeat(apart[part], count[part]) + _popcount((bits[i] ^ bits[j]) & fresh)
            near = d <= MOST_BITS
            if level + 2 == len(starts):
                near &= i != j
            if seen is not None:
                seen.append((level + 1, len(near), int(near.sum())))
            if near.any():
                work.append((level + 1, i[near], j[near], d[near]))
    return labels


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket columns..., code) sorted by bucket and Gray rank, to links (a > b) that connect
    what is connected within a bucket. Holds one batch and the bucket that goes on in the next."""
    rest = None

    def solved(rows: np.ndarray) -> pa.RecordBatch:
        new = np.ones(len(rows), bool)
        new[1:] = (rows[1:, :-1] != rows[:-1, :-1]).any(1)
        group, code = np.cumsum(new), rows[:, -1].copy().view(np.uint64)
        crowd = np.bincount(group)[group] > 1
        group, code = group[crowd], code[crowd]
        if not len(code):
            return pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 2, ["a", "b"])
        labels = local_labels(group, code)
        far = np.flatnonzero(labels != np.arange(len(labels)))
        u, v = code[far].view(np.int64), code[labels[far]].view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.maximum(u, v)), pa.array(np.minimum(u, v))], ["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], 1)
        rows = rows if rest is None else np.concatenate([rest, rows])
        same = (rows[:, :-1] == rows[-1, :-1]).all(1)
        cut = len(rows) - int(np.argmin(same[::-1])) if not same.all() else 0
        rest = rows[cut:]
        if cut:
            yield solved(rows[:cut])
    if rest is not None and len(rest):
        yield solved(rest)


def links(codes: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """From distinct 64-bit codes (column `code`, a stored table) links (a > b) between codes at
    most MOST_BITS apart, enough to connect all that such differences connect."""
    choice = masks(block_count(codes.count()))
    dealt = codes.select(F.explode(F.array(*[F.struct(F.lit(j).cast("long").alias("j"), F.col("code").bitwiseAND(F.lit(m)).alias("key")) for j, m in enumerate(choice)])).alias("d"), "code").select("d.j", "d.key", "code")
    large = materialise(dealt.groupBy("j", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > bucket), "large-buckets")
    pairs = ["j", "key", "s", "t"]
    if large.isEmpty():
        cut = dealt.select("j", "key", F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("t"), "code")
    else:
        chunks = F.coalesce(F.ceil(F.col("n") / bucket), F.lit(1)).cast("long")
        own = F.pmod(F.xxhash64("code"), F.col("chunks"))
        cut = (
            dealt.join(large, ["j", "key"], "left").withColumn("chunks", chunks).withColumn("own", own)
            .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
            .select("j", "key", F.least("own", "other").alias("s"), F.greatest("own", "other").alias("t"), "code")
        )
    mask = F.element_at(F.array(*[F.lit(m) for m in choice]), (F.col("j") + 1).cast("int"))
    rank = gray_rank(F.col("code").bitwiseAND(F.bitwise_not(mask)))
    sorted_ = cut.repartition(*pairs).sortWithinPartitions(*pairs, rank)
    return sorted_.mapInArrow(_links, "a long, b long")


def _size(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 31)))).first())


def components(edges: DataFrame) -> DataFrame:
    """From links (a > b) a stored table (a, b): for each linked code but the least of its component, that least one."""
    spark = edges.sparkSession
    edges = materialise(edges.distinct(), "links")
    before, state = None, _size(edges)
    while state != before:
        with scope(spark) as kept:
            both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
            least = materialise(both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).select("a", F.least("a", "m").alias("m"), "n"), "least")
            large = lookup(both, least, "a", 2 * state[0]).where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
            large = materialise(large, "large-star")
            least = materialise(large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")), "least")
            small = lookup(large, least, "a", large.count()).select(F.explode(F.array(F.struct(F.col("a"), F.col("m")), F.struct(F.col("b").alias("a"), F.col("m")))).alias("e"))
            edges = materialise(small.select("e.a", F.col("e.m").alias("b")).where(F.col("a") != F.col("b")).distinct(), "small-star")
            before, state = state, _size(edges)
            kept.append(edges)
    return edges


def _classes(docs: DataFrame, doc_id: str, text: str, bucket: int) -> tuple[DataFrame, DataFrame]:
    """Stored tables (id, code), a row for each document, and (code, n of its documents, root, component_id)."""
    with scope(docs.sparkSession) as kept:
        prints = materialise(pick(docs, doc_id, text).select(F.col(doc_id).alias("id"), fingerprint(F.col(text)).alias("code")), "fingerprints")
        nodes = materialise(prints.groupBy("code").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")), "codes")
        stars = components(links(nodes.select("code"), bucket))
        roots = stars.select(F.col("b").alias("code"), F.col("b").alias("root")).distinct()
        member = materialise(stars.select(F.col("a").alias("code"), F.col("b").alias("root")).union(roots), "members")
        known = materialise(member.join(nodes.select("code", "id"), "code"), "member-ids")
        least = materialise(known.groupBy("root").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")), "least-ids")
        linked = lookup(known, least, "root", known.count()).select("code", "root", "least")
        classes = nodes.join(linked, "code", "left").select("code", "n", F.coalesce("root", "code").alias("root"), F.coalesce("least", "id").alias("component_id"))
        classes = materialise(classes, "components")
        kept += [prints, classes]
    return prints, classes


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bucket: int = BUCKET) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the smallest doc_id reachable by links."""
    prints, classes = _classes(docs, doc_id, text, bucket)
    digits = F.lower(F.lpad(F.hex("code"), 16, "0"))
    return lookup(prints, classes, "code", prints.count()).select(F.col("id").alias(doc_id), digits.alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bucket: int = BUCKET) -> DataFrame:
    """One document (with all its columns) of each component: that with the smallest doc_id. Of rows
    that share this doc_id, and of a component without any doc_id, one row stays as well."""
    prints, classes = _classes(docs, doc_id, text, bucket)
    kept = lookup(prints, classes, "code", prints.count()).where(F.col("id") == F.col("component_id")).select(F.col("id").alias("kept_id"))
    repeated = materialise(prints.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or id is null").select(F.col("id").alias("more_id")), "repeated-ids")
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    own_id, own_text = F.col(f"c{docs.columns.index(doc_id)}"), F.col(f"c{docs.columns.index(text)}")
    if repeated.isEmpty():  # ids name rows: the join needs no texts' fingerprints
        return plain.join(kept, own_id == F.col("kept_id"), "left_semi").toDF(*docs.columns)
    kept = kept.join(repeated, F.col("kept_id") == F.col("more_id"), "left_anti")
    once = plain.join(kept, own_id == F.col("kept_id"), "left_semi")
    more = plain.join(repeated, own_id.eqNullSafe(F.col("more_id")), "left_semi").withColumn("code", fingerprint(own_text))
    more = lookup(more, classes, "code", more.count()).where(own_id.eqNullSafe(F.col("component_id"))).dropDuplicates(["root"])
    return once.union(more.select(*plain.columns)).toDF(*docs.columns)
