"""License scans by canonical digest: a text and each of its lines are normalised (case, equivalent
spellings, punctuation, white space; the whole text also by copyright statements, heading and comment
marks), digested, and hash-joined to the digests of known licences. A licence text is found if the
whole document is it, in any line width; a notice if a line is it.

Only DataFrame functions are used. A text is normalised once, its lines kept apart; the digests of
the whole and of its lines meet the known ones in one join, broadcast up to SMALL bytes and
shuffled beyond. Texts are not shuffled, only digests.

Defined cases: a null or empty text, and one that is empty when normalised, matches nothing;
repeated rows match alike; extra columns are ignored; texts of any length are digested whole;
if two known licences have one canonical form, the alphabetically first id is given.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomfold.llm.common import pick
from loomfold.llm.license_digests import DIGESTS

SMALL = 16 << 20

# Equivalent spellings (pattern on lower-case text, replacement).
SPELLINGS = (("licence", "license"), ("sub[ -]license", "sublicense"), ("non[ -]?commercial", "noncommercial"), ("copyright (holder|owner)s?", "copyright holder"), ("https://", "http://"), ("&", " and "))

# Notices and short licence texts by id.
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Released under the MIT License."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, Version 2.0."),
    ("ARR", "All rights reserved."),
    ("MIT", """MIT License

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
"""),
    ("ISC", """ISC License

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.
"""),
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# What a whole text is freed of, in this order, on lower-case lines: (pattern, replacement). The same patterns run in both SQL dialects.
_WITHOUT = (
    (r"\n[ \t]*(#+|//+|/?\*+/?|;+|--+|%+|>+|!+)?[ \t]*", "\n"),  # comment marks and indents
    (r"permission[ \n]+is[ \n]+hereby[ \n]+granted", "\n\npermission is hereby granted"),  # a grant begins a paragraph
    (r"permission[ \n]+to[ \n]+use", "\n\npermission to use"),
    (r"redistribution[ \n]+and[ \n]+use", "\n\nredistribution and use"),
    (r"everyone[ \n]+is[ \n]+permitted", "\n\neveryone is permitted"),
    (r"this[ \n]+is[ \n]+free[ \n]+and[ \n]+unencumbered", "\n\nthis is free and unencumbered"),
    (r"this[ \n]+software[ \n]+is[ \n]+provided", "\n\nthis software is provided"),
    (r"creative[ \n]+commons[ \n]+legal[ \n]+code", "\n\ncreative commons legal code"),
    # a paragraph that begins as a copyright statement: the word or the sign with the other, a year or a name to be filled in
    (r"\n\n+(copyright[ \t,:]*(\(c\)|©|[0-9][0-9][0-9][0-9]|<|\[|\{)|(\(c\)|©)[ \t]*([0-9][0-9][0-9][0-9]|copyright))[^\n]*(\n[^\n]+)*", "\n\n"),
    # a heading: a first paragraph of one to three short lines, the first of which says license
    (r"^\n*[^\n]{0,60}licen[cs]e[^\n]{0,60}(\n[^\n]{1,80}){0,2}\n\n+", "\n"),
    (r"[ \t\n]+", " "),
)
_TELLING = r"(?i)copyright|\(c\)|©|licen|commercial"
_PUNCTUATION = r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+"
_PUNCTUATION_IN_LINE = r"[\x00-\x09\x0b-\x2f\x3a-\x60\x7b-\x7f]+"


def canonical_lines(text: Column) -> Column:
    """The normalised text, its lines kept apart."""
    return _normal(F.translate(text, _UPPER, _LOWER))


def _normal(out: Column) -> Column:
    for pattern, said in SPELLINGS:
        out = F.regexp_replace(out, pattern, said)
    return F.regexp_replace(out, _PUNCTUATION_IN_LINE, " ")


def joined_lines(lines: Column) -> Column:
    return F.trim(F.regexp_replace(lines, "[ \n]+", " "))


def canonical(text: Column) -> Column:
    """The normalised text without copyright statements and heading, the same for any line breaks within its paragraphs."""
    out = F.concat(F.lit("\n\n"), F.translate(text, _UPPER, _LOWER))
    for pattern, said in _WITHOUT:
        out = F.regexp_replace(out, pattern, said)
    return joined_lines(_normal(out))


def known_licenses(spark: SparkSession, notices=NOTICES, digests=DIGESTS) -> DataFrame:
    """license_id, digest of the canonical text."""
    rows = spark.createDataFrame([tuple(n) for n in notices], "license_id string, text string")
    rows = rows.select("license_id", F.sha2(canonical(F.col("text")), 256).alias("digest"))
    whole = spark.createDataFrame([tuple(d) for d in digests], "license_id string, digest string")
    return rows.union(whole).distinct()


def scanned(docs: DataFrame, licenses: DataFrame | None = None, doc_id: str = "doc_id", text: str = "text", small: int = SMALL) -> DataFrame:
    """For each document: its id, license_id (the whole text is that licence), n_notices (lines that
    are a known notice), notices (their distinct ids, sorted). licenses: license_id, digest; broadcast up to `small` bytes."""
    licenses = known_licenses(docs.sparkSession) if licenses is None else licenses
    known = licenses.groupBy("digest").agg(F.min("license_id").alias("known_id"))
    size = licenses.agg(F.coalesce(F.sum(F.octet_length("license_id") + F.octet_length("digest")), F.lit(0))).first()[0]
    narrow = pick(docs, doc_id, text).select(F.col(doc_id).alias("id"), F.xxhash64(text).alias("key"), F.col(text).alias("text"))
    texts = narrow.where("text is not null")
    lines = texts.select("id", "key", "text", canonical_lines(F.col("text")).alias("lines"))
    # a text without these has no statement and no heading, and its lines' form is that of the whole
    whole = F.when(F.col("text").rlike(_TELLING), canonical(F.col("text"))).otherwise(joined_lines(F.col("lines")))
    normal = lines.select("id", "key", whole.alias("whole"), "lines")
    line = F.transform(F.split("lines", "\n"), lambda x, i: F.struct(i.cast("int").alias("at"), F.trim(x).alias("said")))
    said = F.concat(F.array(F.struct(F.lit(-1).alias("at"), F.col("whole").alias("said"))), line)
    said = F.filter(said, lambda x: x["said"] != "")
    digests = normal.select("id", "key", F.explode(said).alias("s")).select("id", "key", "s.at", F.sha2("s.said", 256).alias("digest"))
    hits = digests.join(F.broadcast(known) if size <= small else known, "digest")
    # equal (id, key) are repeated rows, which have the same lines at the same places
    each = hits.groupBy(F.col("id").alias("own_id"), F.col("key").alias("own_key")).agg(
        F.min(F.when(F.col("at") < 0, F.col("known_id"))).alias("license_id"),
        F.count_distinct(F.when(F.col("at") >= 0, F.col("at"))).alias("lines"),
        F.sort_array(F.collect_set(F.when(F.col("at") >= 0, F.col("known_id")))).alias("notices"),
    )
    found = narrow.join(each, F.col("id").eqNullSafe(F.col("own_id")) & (F.col("key") == F.col("own_key")), "left")
    return found.select(F.col("id").alias(doc_id), "license_id", F.coalesce("lines", F.lit(0)).cast("long").alias("n_notices"), F.coalesce(F.array_join("notices", ","), F.lit("")).alias("notices"))


def _canonical_sql(text: str, whole: bool = False) -> str:
    out = f"translate({text}, '{_UPPER}', '{_LOWER}')"
    for pattern, said in (*(_WITHOUT if whole else ()), *SPELLINGS, (_PUNCTUATION, " ")):
        out = f"regexp_replace({'chr(10) || chr(10) || ' if pattern == _WITHOUT[0][0] else ''}{out}, '{pattern}', '{said}', 'g')"
    return f"trim({out})"


_KNOWN_SQL = ", ".join("('{}', '{}')".format(i, t.replace("'", "''")) for i, t in NOTICES)
ORACLE_SQL = rf"""
with known as (select min(license_id) as license_id, canon from (
    select license_id, {_canonical_sql("text", True)} as canon from (values {_KNOWN_SQL}) as n(license_id, text)) group by canon),
numbered as (select row_number() over () as row_no, doc_id, text from documents),
lines as (select row_no, {_canonical_sql("line")} as canon from (select row_no, unnest(string_split(text, chr(10))) as line from numbered) where line <> ''),
hits as (select row_no, count(*) as n, array_to_string(list_sort(list_distinct(list(license_id))), ',') as notices from lines join known using (canon) group by row_no)
select doc_id, k.license_id as license_id, coalesce(n, 0) as n_notices, coalesce(notices, '') as notices
from numbered left join known k on {_canonical_sql("text", True)} = k.canon left join hits using (row_no)
"""
