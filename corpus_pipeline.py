"""The corpus pipeline: quality, lines, near-duplicates, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and gives back the rows that go on, with the columns of
documents; the last gives the token ids. run() writes each stage's rows as Parquet in the shared
folder and reads them again, so that a lost executor never costs more than one stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import bpe, line_dedup, minhash, mixing, quality
from tallyloom.llm.common import durable, table, unused, whole_text
from tallyloom.shipping import ship

#: The near-duplicate stage: words of a shingle and least similarity in percent.
SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifiers don't reject."""
    ship(spark)
    return quality.keep(docs, table(spark, sf_dir, "labels"))


def lines_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of line runs; one of which nothing is left goes."""
    ship(spark)
    done = line_dedup.line_dedup(docs)
    changed = F.col("n_deleted") > 0
    kept = done.where(~changed | F.col("text").rlike(line_dedup.WORD))
    return kept.select(*(F.when(changed, F.length("text").cast("long")).otherwise(F.col(c)).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest doc_id, of each group of near-duplicates.

    Where different texts share a doc_id each is judged by itself.
    """
    ship(spark)
    key = unused(docs, "_key")
    dropped = minhash.near_dedup(docs, SHINGLE_WORDS, SIMILAR_PERCENT, keyed=True).where("not kept").select("doc_id", F.col("text_md5").alias(key)).distinct()
    return docs.withColumn(key, F.unhex(F.md5(whole_text()))).join(dropped, ["doc_id", key], "left_anti").select(*(f"`{c}`" for c in docs.columns))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: a row for each time."""
    ship(spark)
    return mixing.mixed(docs)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, decoded_sha256 of each row."""
    ship(spark)
    return bpe.encode_checked(docs, bpe.Vocabulary(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN))


STAGES = [
    ("quality", quality_stage),
    ("line dedup", lines_stage),
    ("near dedup", near_stage),
    ("mixing", mixing_stage),
    ("tokens", tokens_stage),
]

#: A trained classifier comes first; SQL can't express it. The tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
