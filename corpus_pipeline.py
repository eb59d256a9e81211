"""A corpus pipeline over documents: each stage works on all that its predecessor kept.

run(spark, sf_dir) applies the stages to the documents table. Each stage's result is written as
Parquet to the shared folder and read again as the next one's input.

Defined results: a null text is scored, and counted, as an empty one and stays null; an empty table
gives no rows; rows that repeat another's id and text are scored alike, keep the same lines, and stay
or go together; rows that share an id with different texts go together in the near-duplicate and
benchmark stages if one of them goes; a null id is no near duplicate's representative and stays there.
Columns of any name pass through all stages but the last, n_chars follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.llm import bpe, decontaminate, line_dedup, near_dedup, quality
from tallyfold.llm.common import Scratch, fresh, table

#: Near duplicates: shingles of five words and a similarity of 0.8.
SHINGLE, SIMILARITY = 5, 80


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; the labels are those of all documents."""
    model = quality.train(docs, table(spark, sf_dir, "labels", "doc_id", "quality"))
    return docs.where(quality.score_of(model)(F.col("text")) >= quality.THRESHOLD)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; a document left without any text goes with them."""
    n, gone = fresh(docs.columns, "n_lines", "n_removed_lines")
    out = line_dedup.dedup_lines(docs, added=(n, gone)).where(f"`{gone}` = 0 OR trim(text) <> ''")
    return out.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(*(F.col(f"`{c}`") for c in docs.columns))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: that with the smallest id."""
    found = near_dedup.near_dedup(docs, size=SHINGLE, similarity=SIMILARITY)
    gone = found.where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, docs["doc_id"] == gone["doc_id"], "left_anti")


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    found = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))
    gone = found.where("contaminated").select("doc_id").distinct()
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["doc_id"]), "left_anti")


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as token ids, decoded again: the digest is that of the text."""
    # its workers share the executor with those of the stages before
    return bpe.digests(docs, with_ids=True, share=0.25).select("doc_id", "n_tokens", "ids", "decoded_sha256")


STAGES = [
    ("quality_classifier", quality_stage),
    ("line_dedup", line_stage),
    ("minhash_near_dedup", near_stage),
    ("benchmark_decontamination", benchmark_stage),
    ("byte_bpe", token_stage),
]

#: The classifier, fuzzy lines and the token ids can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.keep(stage(spark, docs, sf_dir), f"{k}-{name}")
    return docs
