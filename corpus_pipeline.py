"""A corpus pipeline over the documents table, stage by stage.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept.
All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import crc_bucket, documents, stored
from quillspark.llm.decontamination import contained_items
from quillspark.llm.ngram_join import one_of_each
from quillspark.llm.packing import pack
from quillspark.llm.suffix_dedup import remove_repeats
from quillspark.llm.token_ids import default_path
from quillspark.llm.toxicity import fit_toxicity, score_rows


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network calls toxic go. It learns from the same labelled
    documents as op4, of those that are in docs. Each row is judged by its own text,
    whatever its id; null and empty texts are scored as one empty window."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(crc_bucket("doc_id", 5) != 0)
    return score_rows(docs, fit_toxicity(docs, labels)).where("score < 0.5").select("row.*")


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one row stays, that with the smallest
    id; rows with null ids and rows of one id with different texts count as
    documents of their own. Rows without words stay."""
    return one_of_each(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of repeated 200-byte strings go, with what they leave of a cut
    character. Every document stays, also one that has lost all its text."""
    out = remove_repeats(docs, characters=True)
    row = {c: F.col(f"row.{c}") for c in docs.columns}
    text = F.when(F.col("n_removed") > 0, F.col("kept").cast("string")).otherwise(row["text"])
    out = out.select(*(c.alias(k) for k, c in row.items() if k != "text"), text.alias("text"))
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text contains a benchmark item go, also those with a null id; a row
    that only shares its id with such a one stays. Texts are told apart by a 64-bit
    hash. Null and empty texts stay, an empty table stays empty."""
    texts = docs.select(F.xxhash64("text").alias("doc_id"), "text")
    found = contained_items(texts, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    gone = found.select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, F.xxhash64("text") == F.col("__gone"), "left_anti").select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row is packed, also those with null or repeated ids; a null or empty
    text is its end id alone. An empty table gives no sequences."""
    return pack(docs, default_path())


STAGES = [
    ("toxicity", toxicity),
    ("ngram_join", ngram_join),
    ("suffix_dedup", suffix_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: A trained network and a tokenizer aren't SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
