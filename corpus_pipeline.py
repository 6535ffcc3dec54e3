"""The document pipeline: five stages from raw documents to token ids.

Each stage gets all rows that the one before it kept, written as Parquet in the shared folder and read again, and its decisions take
effect: rejected documents, copies and contaminated documents go, personal data is replaced. All stages but the last return the columns of
``documents``; the last returns ids and the digest of the text that they decode to.

Edge cases: null and empty texts fail the quality rules; very long texts and columns of any other name, with dots or that of a stage's own key, need nothing special; an empty table passes through all stages. The two stages that join by doc_id take
equal ids for one document, of which one row stays, and give rows without an id one that their text decides and that stands behind all real ones.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millwright.llm import bpe, decontaminate, jaccard, pii, quality
from millwright.llm.common import table
from millwright.llm.scratch import saved



def own_name(docs: DataFrame) -> str:
    """A column name that the table does not have, in any case of letters."""
    taken, name = {c.lower() for c in docs.columns}, "_pipeline_id"
    while name in taken:
        name += "_"
    return name


def columns(docs: DataFrame) -> list[Column]:
    """All columns of the table, whatever is in their names."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in docs.columns]


def identity() -> Column:
    """doc_id, or a number from 2**62 on by the text."""
    return F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text").bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62)))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the base rule or the threshold table rejects."""
    return quality.keep(docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of documents with a similarity of 0.8 or more over five-word shingles, the smallest id stays."""
    key = own_name(docs)
    known = docs.withColumn(key, identity())
    found = jaccard.join(known, size=5, num=4, den=5, id_col=key)
    gone = found.groupBy(F.col("doc_id").alias(key)).agg(F.min("component_id").alias("kept"), F.count("*").alias("rows"))
    gone = saved(gone.filter((F.col("kept") < F.col(key)) | (F.col("rows") > 1)))  # written, so that its size decides how it is joined with the texts
    repeated = gone.filter(F.col("kept") == F.col(key)).select(key)
    one = known.join(repeated, key, "left_semi").dropDuplicates([key]).select(columns(docs))  # ids with several rows, of which one stays
    return known.join(gone.select(key), key, "left_anti").select(columns(docs)).union(one)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    key = own_name(docs)
    known = docs.withColumn(key, identity())
    hit = decontaminate.matches(known, table(spark, sf_dir, "benchmark"), id_col=key)
    hit = saved(hit.select(F.col("doc_id").alias(key)).distinct())
    return known.join(hit, key, "left_anti").select(columns(docs))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind in brackets, and counts the characters anew."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(columns(docs))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and the digest of the text that they decode to."""
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, decoded=True)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("benchmark decontamination", benchmark_decontamination),
    ("PII", personal_data),
    ("byte-level BPE", byte_bpe),
]

#: SQL can't express decontamination by SimHash or byte-pair merges; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
