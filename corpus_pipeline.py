"""A corpus pipeline of five stages over `documents`, each calling one training-data operator.

Every stage takes all rows its predecessor kept and returns the columns of documents;
the last returns token ids. STAGES can be run one by one, each output written and read
again, or by run().

In all stages null texts count as empty, null ids and sources keep their rows, further
columns of docs are not carried on, texts of any length are taken whole, and an empty
table gives an empty one. Rows that agree in everything are treated alike, but for the
dedup, which keeps one of them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import bpe, mixing, pii, simhash_dedup, toxicity
from gridloom.llm._base import materialize, read_table
from gridloom.runtime import ship_package

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity models do not reject; without labels of both values, all of them."""
    ship_package(spark)
    scored = toxicity.toxicity_scores(docs, read_table(spark, sf_dir, "labels"), keep=COLUMNS)
    return scored.where("predicted = 0").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one of the smallest doc_id, and one row of that."""
    ship_package(spark)
    return simhash_dedup.deduplicated(docs.select(*COLUMNS))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by the name of its kind; null texts stay null. n_chars follows the text."""
    found = pii.find_spans(docs.select(*COLUMNS), pii.train(docs))
    text = F.when(F.col("text").isNotNull(), pii.masked(F.col("text"), "spans"))
    n_chars = F.when(F.size("spans") > 0, F.length("_masked").cast("long")).otherwise(F.col("n_chars"))
    return found.withColumn("_masked", text).select("doc_id", F.col("_masked").alias("text"), "lang", "source", n_chars.alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    return mixing.repeated(docs.select(*COLUMNS))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, ids and n_tokens of every row; texts that are null or empty have no ids."""
    ship_package(spark)
    found = bpe.encode_documents(docs.select(*COLUMNS), public_tokenizers.path(bpe.RANKS))
    return found.select("doc_id", "source", "ids", F.size("ids").cast("long").alias("n_tokens"))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("pii", mask_personal_data),
    ("mixing", mix_sources),
    ("byte_bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each output is written to the shared folder and read again. Without documents there are no rows."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL cannot express the trained and iterative stages.
ORACLE_SQL = None
