"""op13: tokens of two tokenizers aligned over all documents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from shapelake.llm.token_alignment import ByteLevelRanks, PieceModel, align_tokenizers


def tokenizers() -> tuple[ByteLevelRanks, PieceModel]:
    """byte_bpe_50k as ranks (the same ids as its JSON form) and piece_bpe_32k."""
    ranks = ByteLevelRanks(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return ranks, PieceModel(public_tokenizers.path("piece_bpe_32k.model"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = align_tokenizers(docs, *tokenizers(), digest=True).withColumnRenamed("groups", "groups_sha256")
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_overlaps")


QUERIES = {"op13_token_alignment": op13_token_alignment}
ORACLE_SQL: dict[str, str] = {}
