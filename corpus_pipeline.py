"""Documents to token ids: language ID, quality rules, near-duplicates, a mix of sources, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tidescore.llm import common, language_id, mixing, quality_rules, sentencepiece_bpe, simhash


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language, or with an unsure one, go."""
    return language_id.spoken_documents(docs)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or the log-likelihood ratio go."""
    return quality_rules.kept_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component stays, that with the smallest id."""
    return simhash.keep_one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document appears once for each pass of its source that takes it; the one at the cut ends there."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, ids, decoded of each row of the mix."""
    import public_tokenizers

    return sentencepiece_bpe.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))


def _entry(stage):
    """A stage in a session whose Arrow batches fit executors of little memory."""
    return lambda spark, docs, sf_dir: stage(common.entry_session(spark), docs, sf_dir)


STAGES = [(name, _entry(stage)) for name, stage in (("language_id", language), ("quality_rules", quality), ("simhash_dedup", deduplicate), ("mix", mix), ("sentencepiece", encode))]

#: SQL can't express the trained stages; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Stages between are written to the session's checkpoint folder and read again.

    A stage's folder goes when the next stage is written; the last one, which the result reads, when the session's JVM ends.
    """
    folder = f"{common.checkpoint_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    files = spark._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    path = lambda k: spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{k}")
    files.deleteOnExit(spark._jvm.org.apache.hadoop.fs.Path(folder))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        files.delete(path(k - 1), True)
    return STAGES[-1][1](spark, docs, sf_dir)
