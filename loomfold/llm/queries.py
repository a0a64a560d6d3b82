"""The registered queries of this subpackage: opN_<name>, and pipeline if its module is there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomfold.llm import bpe, chat, decontam, htmltext, infill, licenses, maxent, periodic, quality, secretscan, shards, simhash, urlrules
from loomfold.llm.common import pick, table


def _sha(column) -> F.Column:
    return F.sha2(F.coalesce(column, F.lit("")).cast("binary"), 256)


def vocabulary() -> tuple[str, str]:
    """Path of the public rank file, and the pattern that splits text before it."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secretscan.findings(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", _sha(F.col("base")).alias("base_sha256"), "spans")


def op2_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlrules.judged(table(spark, sf_dir, "pages"))


def encoded(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of whole texts."""
    codec = bpe.ByteBpe(spark, *vocabulary())
    both = pick(docs, "doc_id", "text").select("doc_id", codec.round_trip(F.col("text")).alias("r"))
    ids = F.array_join(F.col("r.ids").cast("array<string>"), ",")
    return both.select("doc_id", F.size("r.ids").cast("long").alias("n_tokens"), _sha(ids).alias("ids_sha256"), _sha(F.col("r.decoded")).alias("decoded_sha256"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(spark, table(spark, sf_dir, "documents"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scanned(table(spark, sf_dir, "documents"))


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = pick(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text").union(extra)
    out = chat.formatted(rows)
    read = out.select("conv_id", "formatted", chat.parsed(F.col("formatted"), F.col("loss")).alias("p"))
    turns = F.array_join(F.transform("p.turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("p.turns").cast("long").alias("n_turns"), _sha(turns).alias("turns_sha256"),
        F.char_length("p.loss").cast("long").alias("loss_chars"), _sha(F.col("p.loss")).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op6_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shards.assign(table(spark, sf_dir, "documents"), 24)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), _sha(F.array_join("items", ",")).alias("items_sha256"), "contaminated")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.articles(table(spark, sf_dir, "pages"))


def op11_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = infill.transformed(table(spark, sf_dir, "documents"))
    text = infill.restored(F.col("output"), F.col("form"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", _sha(F.col("output")).alias("output_sha256"), _sha(text).alias("restored_sha256"))


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.periodic(table(spark, sf_dir, "documents"), with_text=False, planted=True)


def op13_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent.scored(table(spark, sf_dir, "documents"))


_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

OP8_SQL = rf"""
with docs as (select row_number() over () as row_no, doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
items as (select item_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
windows as (
  select distinct item_id, n, array_to_string(list_slice(w, s, s + n - 1), ' ') as said
  from (select item_id, w, least(10, len(w)) as n, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) as s from items where len(w) > 0)),
lengths as (select distinct n from windows),
spans as (
  select row_no, n, s, array_to_string(list_slice(w, s, s + n - 1), ' ') as said
  from (select row_no, w, n, unnest(generate_series(1, len(w) - n + 1)) as s from docs, lengths where len(w) >= n)),
found as (select row_no, item_id, s, n from spans join windows using (n, said)),
hit as (select row_no, count(distinct p) as n_hit from (select row_no, unnest(generate_series(s, s + n - 1)) as p from found) group by row_no),
names as (select row_no, count(distinct item_id) as n_items, array_to_string(list_sort(list_distinct(list(cast(item_id as varchar)))), ',') as ids from found group by row_no)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from docs left join hit using (row_no) left join names using (row_no)
"""

_CONTROL = "(" + "|".join(r"\x{:02x}".format(ord(c[0])) + "".join(f"\\x{ord(x):02x}" for x in c[1:]) for c in sorted(chat.CONTROL, key=len, reverse=True)) + ")"
OP5_SQL = rf"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e as (
  select *, length(role) + length(text) + length(role || text) - length(replace(role || text, '\', ''))
    + len(regexp_extract_all(role, '{_CONTROL}')) + len(regexp_extract_all(text, '{_CONTROL}')) + {len("<|turn|><|text|><|end|>") + 1} as chars from t)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(chars) as bigint) as formatted_chars
from e group by conv_id
"""

QUERIES = {f.__name__: f for f in (op1_secrets, op2_urls, op3_bpe, op4_licenses, op5_chat, op6_shards, op7_quality, op8_decontam, op9_simhash, op10_html, op11_infill, op12_runs, op13_scores)}
ORACLE_SQL = {"op2_urls": urlrules.ORACLE_SQL, "op4_licenses": licenses.ORACLE_SQL, "op5_chat": OP5_SQL, "op8_decontam": OP8_SQL, "op11_infill": infill.ORACLE_SQL}
