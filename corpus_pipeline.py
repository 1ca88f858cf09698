"""The corpus pipeline: five stages over ``documents``, each on all that the stage before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logsieve.llm import decontaminate, lines, minmax, toxicity, tree_bpe
from logsieve.sources.sinks import stage

#: A document of this probability or more is rejected as toxic.
TOXIC = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain does not hold for toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    chain = toxicity.fit_chain(docs, labels)
    scored = toxicity.score_chain(docs, chain, prefix="_chain_")
    return scored.where(F.col("_chain_toxic") < TOXIC).select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat an earlier one; n_chars follows the text."""
    return lines.dedup_lines(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least doc_id, of each group of near-duplicates."""
    groups = minmax.near_duplicates(docs, n=5, percent=80)
    gone = groups.where("NOT kept").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == F.col("_gone"), "left_anti")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    hits = decontaminate.contaminated(docs, benchmark)
    gone = hits.select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == F.col("_gone"), "left_anti")


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, its token ids, and digests of the ids and of the bytes they decode to."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ids = tree_bpe.encode(docs, path, public_tokenizers.PATTERN)
    back = tree_bpe.decode(ids, path, public_tokenizers.PATTERN)
    return back.select(
        "doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("near_duplicates", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("byte_bpe", tokenize),
]
#: Models and hashed sketches cannot be stated in SQL; the tests hold a brute-force version against it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, apply in STAGES:
        docs = stage(apply(spark, docs, sf_dir))
    return docs
