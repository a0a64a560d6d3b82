"""A training-data pipeline of five operators: quality rules, near-dedup, decontamination, secret
scans, byte-level BPE. Each stage takes (spark, docs, sf_dir), works on all rows its predecessor
kept, and returns a DataFrame; all but the last return the columns of documents.

Defined cases: those of the operators; a document with null text fails the quality rules; an empty
table gives no rows; extra columns, with clashing names too, stay until the last stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomfold.llm import decontam, quality, secretscan, simhash
from loomfold.llm.common import table
from loomfold.llm.queries import encoded
from loomfold.sources.scratch import materialise, scope


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep."""
    return quality.filtered(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest doc_id, of each group of near-duplicates."""
    return simhash.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret replaced by a mark; n_chars follows the text."""
    text, n_chars = docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else -1
    names = [f"c{i}" for i in range(len(docs.columns))]
    out = docs.toDF(*names).withColumn(names[text], secretscan.redacted(F.col(names[text])))
    if n_chars >= 0:
        kind = docs.schema[n_chars].dataType
        out = out.withColumn(names[n_chars], F.coalesce(F.char_length(names[text]).cast(kind), F.col(names[n_chars])))
    return out.toDF(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return encoded(spark, docs)


STAGES = [("quality", quality_rules), ("near_dedup", near_dedup), ("decontamination", decontamination), ("secrets", secret_scan), ("bpe", tokens)]

#: A trained model decides in the first stage: the rows are tested against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage is written and read again; what a stage wrote besides, and older stages, are deleted."""
    docs = table(spark, sf_dir, "documents")
    with scope(spark) as kept:
        for name, stage in STAGES:
            with scope(spark) as own:
                out = stage(spark, docs, sf_dir)
                plain = out.toDF(*[f"c{i}" for i in range(len(out.columns))])  # names may clash in a file
                docs = materialise(plain, f"stage-{name}").toDF(*out.columns)
                own.append(docs)
        kept.append(docs)
    return docs
