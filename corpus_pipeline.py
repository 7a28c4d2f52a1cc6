"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and all
but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.functions.shipping import bounded
from textquarry.llm import classifier, decontaminate, line_dedup, ngram_join, packing
from textquarry.llm._common import checkpoint

#: Documents that score below are rejected.
LEAST_QUALITY = 0.7


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents of sufficient quality by the classifier (operator 9)."""
    model = classifier.fit(docs, bounded(spark).read.parquet(f"{sf_dir}/labels.parquet"))
    scored = classifier.score(docs, model, keep=tuple(docs.columns))
    return scored.where(F.col("score") >= LEAST_QUALITY).select("kept.*")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out lines that occurred before, up to two edits (operator 8); documents left without a word go."""
    bounded(spark)
    left = line_dedup.remove_lines(docs, drop_emptied=True)
    return left.withColumn("n_chars", F.length("text").cast("bigint"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group at a Jaccard similarity of 0.8 over five words (operator 3)."""
    bounded(spark)
    return ngram_join.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark window (operator 1)."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences (operator 5)."""
    bounded(spark)
    pieces = packing.pack_documents(docs)
    return pieces.select("doc_id", "start", (F.octet_length("ids") / 4).cast("bigint").alias("length"), F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("decontaminated", decontaminated), ("packed", packed)]

#: The stages hold a trained model and an edit join, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = bounded(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = checkpoint(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
