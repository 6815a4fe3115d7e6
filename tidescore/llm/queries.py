"""The queries of this subpackage, and their DuckDB SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from tidescore.llm import chat, common, embedding_dedup, html_extract, language_id, license_scan, mixing, quality_classifier, quality_rules, sentencepiece_bpe, simhash


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return common.entry_session(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_chat": lambda s, d: chat.op1_chat(_table(s, d, "conversations")),
        "op2_sentencepiece": lambda s, d: sentencepiece_bpe.op2_sentencepiece(_table(s, d, "documents"), model_path()),
        "op3_simhash": lambda s, d: simhash.op3_simhash(_table(s, d, "documents")),
        "op4_mix": lambda s, d: mixing.op4_mix(_table(s, d, "documents")),
        "op5_html": lambda s, d: html_extract.op5_html(_table(s, d, "pages")),
        "op6_quality_rules": lambda s, d: quality_rules.op6_quality_rules(_table(s, d, "documents"), _table(s, d, "labels")),
        "op7_license_scan": lambda s, d: license_scan.op7_license_scan(_table(s, d, "documents")),
        "op8_language_id": lambda s, d: language_id.op8_language_id(_table(s, d, "documents")),
        "op9_quality": lambda s, d: quality_classifier.op9_quality(_table(s, d, "documents"), _table(s, d, "labels")),
        "op10_embedding_dedup": lambda s, d: embedding_dedup.op10_embedding_dedup(_table(s, d, "embeddings")),
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_chat": chat.SQL, "op4_mix": mixing.SQL, "op6_quality_rules": quality_rules.SQL, "op7_license_scan": license_scan.SQL, "op10_embedding_dedup": embedding_dedup.SQL}
