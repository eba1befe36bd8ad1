"""Training-corpus pipeline: quality rules, exact and near deduplication, mixing, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but the
last return the columns of documents. Every stage's result is written as Parquet in the shared
folder and read again, so a lost executor costs one stage's tasks at most.

Rows with a null id: the quality and exact stages treat them like others, the near-duplicate
stage keeps them, and mixing treats them as one document id. Other columns pass through as they
are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsentry.llm import bpe, quality
from flowsentry.llm.exact_dedup import exact_duplicates, normalised
from flowsentry.llm.mixing import mix_sources
from flowsentry.llm.near_dedup import near_duplicates
from flowsentry.llm.queries import vocabulary_path
from flowsentry.session import cut


def _columns(docs: DataFrame) -> list:
    return [F.col(f"d.`{c}`") for c in docs.columns]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the certified cutoffs of their language."""
    return quality.keep_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts; of repeated rows with the kept id, the longest text."""
    found = cut(exact_duplicates(docs).where("text_sha256 is not null and group_size > 1"))
    again = found.where("kept").groupBy("doc_id", "text_sha256").count().where("count > 1").select("doc_id", "text_sha256", F.lit(True).alias("again"))
    marks = found.where("not kept").select("doc_id", "text_sha256", F.lit(False).alias("again")).distinct().unionByName(again).alias("m")
    # Only rows of groups match; text of single documents is never grouped.
    keyed = docs.alias("d").join(marks, F.col("d.doc_id").eqNullSafe(F.col("m.doc_id")) & (F.sha2(normalised(F.col("d.text")), 256) == F.col("m.text_sha256")), "left")
    keyed = keyed.select(F.struct(*_columns(docs)).alias("row"), F.col("m.again").alias("again"), F.col("m.text_sha256").alias("sha"))
    single = keyed.where("again is null").select("row.*")
    if again.isEmpty():
        return single
    repeated = keyed.where("again").groupBy(F.col("row.doc_id").alias("id"), "sha").agg(F.max_by("row", F.struct(F.char_length("row.text"), F.col("row.text"))).alias("row"))
    return single.unionByName(repeated.select("row.*"))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, the one with the least id; rows of one id stay if one of their texts does."""
    ids = near_duplicates(docs).where("doc_id is not null").groupBy("doc_id").agg(F.max("kept").alias("kept"))
    dropped = ids.where("not kept").select("doc_id").alias("m")
    return docs.alias("d").join(dropped, F.col("d.doc_id") == F.col("m.doc_id"), "left_anti")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mixture; one that the mixture reads twice is there twice."""
    taken = mix_sources(docs).where("copies > 0").groupBy("doc_id").agg(F.max("copies").alias("copies")).alias("m")
    joined = docs.alias("d").join(taken, F.col("d.doc_id").eqNullSafe(F.col("m.doc_id")))
    return joined.select(F.struct(*_columns(docs)).alias("row"), F.explode(F.sequence(F.lit(1), F.col("m.copies").cast("int"))).alias("n")).select("row.*")


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids): the token ids of each document as little-endian int32 bytes."""
    return bpe.encode_documents(docs, vocabulary_path())


STAGES = [
    ("quality_rules", quality_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("mixing", mixing_stage),
    ("byte_bpe", encoding_stage),
]

#: Sampling of near duplicates, exact binomial cutoffs and the merges have no SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
