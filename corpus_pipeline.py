"""The corpus pipeline: quality rules, near-duplicate join, repeated-passage removal, personal data, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents. run() writes what a stage returns to the shared folder, and the next one reads it from there.

Ids name documents: of rows with the same id and text that stay, one stays. Other columns are dropped.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimstead.llm.common import durable, read_table, stored
from claimstead.llm.packing import best_fit_pack
from claimstead.llm.parity_join import similar_documents
from claimstead.llm.personal_data import masked, personal_spans
from claimstead.llm.quality_rules import judge
from claimstead.llm.suffix_dedup import remove_repeats

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return judge(docs.select(COLUMNS), COLUMNS).where("kept").select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near duplicates (five-word shingles, similarity 0.8) the document of the smallest id stays."""
    docs = docs.select(COLUMNS)
    rows = similar_documents(docs).withColumn("stays", F.equal_null("doc_id", "component_id"))
    ids = durable(rows.groupBy("doc_id").agg(F.max("stays").alias("stays"), F.count("*").alias("times")))
    stay = ids.where("stays").select(F.col("doc_id").alias("id"), "times")
    joined = docs.join(stay, F.equal_null(docs["doc_id"], stay["id"]))
    if ids.where("times > 1").isEmpty():
        return joined.select(COLUMNS)
    repeated = joined.where("times > 1").dropDuplicates(["doc_id", "text"])
    return joined.where("times = 1").unionByName(repeated).select(COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every byte of a 200-byte string that starts in two places goes."""
    kept = remove_repeats(docs, ["doc_id", "lang", "source", "n_chars"]).withColumn("text", F.col("kept_text"))
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    found = docs.select(COLUMNS).withColumn("text", text).withColumn("spans", personal_spans(F.col("text")))
    hidden = found.withColumn("text", masked(F.col("text"), F.col("spans")))
    return hidden.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokenised documents in sequences of 1024."""
    return best_fit_pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("personal data", personal_data),
    ("best-fit packing", packing),
]

#: SQL can't express the byte-pair encoding, the divergence from learned references or the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
