"""Search by an unescaped regular expression through an inverted index of trigrams.

A pattern's syntax tree tells which literals every match must hold. Their trigrams select posting lists, whose
intersection (for alternatives: union) leaves candidates, and only these run the expression. A pattern without
such literals, or one that the tree builder does not know, is run over all rows: the result is always that of a full scan.

Letters A-Z match in either case and others as they stand, as in the engine's case-insensitive matching."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomfold.sources.scratch import materialise

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLD = str.maketrans(_UPPER, _LOWER)
Clause = frozenset[str]  # literals of which one must occur


def required(pattern: str) -> list[Clause]:
    """Clauses of literals of three letters or more, lower-cased, that hold for every text the pattern matches."""
    try:
        tree = re._parser.parse(pattern, re.IGNORECASE)
    except (re.error, OverflowError, RecursionError):
        return []
    if tree.state.flags & re.VERBOSE:
        return []
    clauses: list[Clause] = []
    run: list[str] = []

    def end(into: list[Clause]) -> None:
        said = "".join(run).translate(_FOLD)
        run.clear()
        if len(said) >= 3:
            into.append(frozenset([said]))

    def walk(items, into: list[Clause]) -> None:
        for op, value in items:
            name = str(op)
            if name == "LITERAL":
                run.append(chr(value))
                # the engine's matching may fold these into ASCII letters
                if chr(value) in "ſKİı":
                    run.pop()
                    end(into)
            elif name == "SUBPATTERN" and not value[1] and not value[2]:
                walk(value[3], into)  # a group: the run goes on through it
            elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and value[0] >= 1:
                end(into)
                walk(value[2], into)
                end(into)
            elif name == "BRANCH":
                end(into)
                parts = []
                for branch in value[1]:
                    own: list[Clause] = []
                    walk(branch, own)
                    end(own)
                    parts.append(own)
                if all(parts):  # of each alternative the clause that says most
                    into.append(frozenset().union(*(max(own, key=lambda c: min(map(len, c))) for own in parts)))
            elif name == "AT":
                continue  # of no width
            else:
                end(into)
        return

    walk(tree, clauses)
    end(clauses)
    return clauses


def grams(literal: str) -> list[str]:
    return sorted({literal[i : i + 3] for i in range(len(literal) - 2)})


def trigram_index(rows: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """gram, key, at (the column's place): each trigram of each text once, in files sorted by gram, so that a search reads few of them."""
    texts = F.array(*[F.struct(F.lit(i).alias("at"), F.translate(F.col(c), _UPPER, _LOWER).alias("said")) for i, c in enumerate(columns)])
    each = rows.select(key, F.inline(texts)).where(F.char_length("said") >= 3)
    found = F.array_distinct(F.transform(F.sequence(F.lit(1), F.char_length("said") - 2), lambda i: F.substring(F.col("said"), i, F.lit(3))))
    postings = each.select(F.explode(found).alias("gram"), key, "at")
    return materialise(postings.repartitionByRange("gram", key).sortWithinPartitions("gram", key), "trigrams")


def candidates(index: DataFrame, key: str, clauses: Sequence[Clause]) -> DataFrame:
    """Keys of rows of which one column has all trigrams of one literal of each clause."""
    wanted = sorted({g for c in clauses for said in c for g in grams(said)})
    lists = index.where(F.col("gram").isin(wanted)).groupBy(key, "at").agg(F.collect_set("gram").alias("grams"))

    def holds(said: str) -> Column:
        return F.size(F.array_intersect("grams", F.array(*map(F.lit, grams(said))))) == len(grams(said))

    tests = [reduce(Column.__or__, [holds(said) for said in sorted(c)]) for c in clauses]
    return lists.where(reduce(Column.__and__, tests)).select(key).distinct()


def search(rows: DataFrame, index: DataFrame, pattern: str, key: str, columns: Sequence[str]) -> DataFrame:
    """Rows of which one column has a match of the pattern in any case, or whose key is the pattern, if that is digits."""
    matches = reduce(Column.__or__, [F.coalesce(F.rlike(F.col(c), F.lit(f"(?i){pattern}")), F.lit(False)) for c in columns])
    clauses = required(pattern)
    found = rows.join(candidates(index, key, clauses), key, "left_semi") if clauses else rows
    found = found.where(matches)
    if pattern.isdigit():
        found = found.unionByName(rows.where(F.col(key) == pattern)).dropDuplicates([key])
    return found
